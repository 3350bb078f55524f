import math
import random
from itertools import product

import numpy as np
import pytest

from tricorpus.functions import plugins
from tricorpus.operators import choices, clusters, groups, spread
from tricorpus.sources import files

ROWS = "cluster string, paper string, subject string, verb string, object string"


def plain_spreads(rows, cats, vectors, method):
    """{(kind, size): spread}, choice by choice."""
    found = {}
    for c in sorted({r[0] for r in rows}):
        papers = {}
        for _, p, _, v, _ in (r for r in rows if r[0] == c):
            papers.setdefault(p, []).append(v)
        first = [cats[p] == "cs" for p in papers]
        n1, n2 = sum(first), len(first) - sum(first)
        sizes = {"first": n1 * (n1 > 1), "other": n2 * (n2 > 1), "mixed": (n1 + n2) * (min(n1, n2) / (n1 + n2) > 0.25)}
        for choice in product(*papers.values()):
            m = [(f, vectors[v]) for f, v in zip(first, choice) if v in vectors]
            pairs = {
                "first": [(x, y) for i, (f, x) in enumerate(m) for j, (g, y) in enumerate(m) if i != j and f and g],
                "other": [(x, y) for i, (f, x) in enumerate(m) for j, (g, y) in enumerate(m) if i != j and not f and not g],
                "mixed": [(x, y) for f, x in m for g, y in m if f and not g],
            }
            for kind, size in sizes.items():
                if size and pairs[kind]:
                    d = [math.dist(x, y) for x, y in pairs[kind]]
                    found.setdefault((kind, size), []).append(np.mean(d) if method == "mean" else np.percentile(d, 75))
    return {k: float(np.mean(v)) for k, v in found.items()}


@pytest.mark.parametrize("method", spread.METHODS)
def test_spread_of_choices_equals_a_plain_version(spark, method, monkeypatch):
    monkeypatch.setattr(spread, "CHOICES", 3)  # clusters in several parts
    monkeypatch.setattr(spread, "BUCKET_ROWS", 5)
    r = random.Random(11)
    rows = sorted({(f"c{r.randrange(4)}", f"p{r.randrange(8)}", f"s{k}", f"v{r.randrange(7)}", f"o{k}") for k in range(60)})
    cats = {f"p{k}": "cs" if k % 2 else "quant" for k in range(8)}
    vectors = {f"v{k}": [float(min(k, 4)), float(min(k, 4) ** 2)] for k in range(6)}  # v4 and v5 are one; v6 has none
    made = spread.choice_spread(spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(cats.items()), "paper string, category string"), spark.createDataFrame(list(vectors.items()), "term string, embedding array<float>"), method)
    got, want = {(x.kind, x.size): x.spread for x in made.collect()}, plain_spreads(rows, cats, vectors, method)
    assert len(want) > 3 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("method", spread.METHODS)
def test_spread_of_more_choices_than_can_be_made(spark, method):
    """70 papers of two triplets each are 2**70 choices; by the number that takes the first there are 71."""
    rows = [("c", f"p{p:02}", "s", f"v{k}", "o") for p in range(70) for k in range(2)]
    cats = spark.createDataFrame([(f"p{p:02}", "cs") for p in range(70)], "paper string, category string")
    vectors = spark.createDataFrame([("v0", [0.0]), ("v1", [1.0])], "term string, embedding array<double>")
    (got,) = spread.choice_spread(spark.createDataFrame(rows, ROWS), cats, vectors, method).collect()
    assert (got.kind, got.size) == ("first", 70)
    assert got.spread == pytest.approx(0.5 if method == "mean" else sum(math.comb(70, a) for a in range(71) if 2 * a * (70 - a) > 0.25 * (70 * 69 - 1)) / 2**70, abs=1e-3)


def test_large_quartile_holds_no_matrix():
    x = np.random.default_rng(3).normal(size=(700, 5))
    c, other = np.arange(700) % 3, np.arange(700) % 2
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    w = c[:, None] * c[None] - np.diag(c)
    assert choices.large_quartile(x, c, None) == pytest.approx(np.percentile(np.repeat(d.ravel(), w.ravel()), 75), abs=1e-12)
    assert choices.large_quartile(x, c, other) == pytest.approx(np.percentile(np.repeat(d.ravel(), np.outer(c, other).ravel()), 75), abs=1e-12)


@pytest.mark.parametrize("mixed", (False, True))
def test_distances_of_large_groups_equal_those_of_small_ones(spark, mixed, monkeypatch):
    """In blocks, no task makes the pairs of a whole group."""
    r = np.random.default_rng(7)
    x = r.integers(-2, 3, size=(90, 3)).astype(float)
    rows = spark.createDataFrame([(f"g{i % 2}", i, bool(i % 3), v.tolist()) for i, v in enumerate(x)] + [("g2", 1, True, [1.0, 2.0, 3.0]), ("g2", 2, False, [0.0, 0.0, 0.0])], "g string, place int, is_first boolean, embedding array<float>")
    want = {m: {k.g: k.spread for k in spread.group_distances(rows, ["g"], mixed, m).collect()} for m in spread.METHODS}
    monkeypatch.setattr(spread, "LARGE", 2)
    monkeypatch.setattr(spread, "BLOCK_ROWS", 16)
    for m in spread.METHODS:
        made = spread.group_distances(rows, ["g"], mixed, m)
        assert {k.g: k.spread for k in made.collect()} == pytest.approx(want[m], abs=1e-12) and len(want[m]) == 3
        if m == "mean":
            assert "GroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ("l2", "cosine"))
def test_pairs_come_from_blocks_to_the_last_bit(spark, metric):
    from pyspark.sql import functions as F

    from tricorpus.functions import vectors as V

    x = np.random.default_rng(9).normal(size=(70, 6)).astype(np.float32)
    x[3] = 0
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(70, 0, None), (71, None, [1.0] * 6)], "vec_id long, label int, embedding array<float>")
    made = spread.pair_distances(rows, "label", metric=metric, block_rows=8)
    assert "GroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()
    a, b = rows.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x")), rows.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    plain = a.join(b, "label").where("a < b").select("label", "a", "b", (V.l2_distance if metric == "l2" else V.cosine_distance)(F.col("x"), F.col("y")).alias("distance"))
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, made.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_equal_vectors_are_one_in_linkage(spark):
    """400 terms of 4 vectors are 4 to compare; with 400 a component of over 10 was an error."""
    eye = np.eye(4)
    df = spark.createDataFrame([(f"t{i:03}", eye[i % 4].tolist()) for i in range(400)], "term string, embedding array<double>")
    got = {r.term: r.cluster for r in clusters.linkage_cut(df, 0.05, max_component=10).collect()}
    assert got == {f"t{i:03}": f"t{i % 4:03}" for i in range(400)}


def test_average_linkage_of_weighted_rows_and_of_ties():
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 6)) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = r.integers(1, 5, 40)
    whole, few = clusters.average_linkage_cut(np.repeat(x, n, axis=0), 0.2), clusters.average_linkage_cut(x, 0.2, n)
    first = np.cumsum(n) - n
    assert (first[few] == whole[first]).all() and 1 < len(set(few)) < 40
    assert set(clusters.average_linkage_cut(np.eye(9), 1.0).tolist()) == {0}  # all equally far
    assert clusters.MAX_COMPONENT >= 102_564  # the vectors of 1 GB hang together


def test_sets_of_terms_are_clustered_by_themselves(spark):
    """Near copies in different sets stay apart."""
    rows = [(f"{s}{i}", s, [1.0, e]) for s in "ab" for i, e in enumerate((0.0, 0.01, 5.0))]
    df = spark.createDataFrame(rows, "term string, id string, embedding array<double>")
    assert {r.term: r.cluster for r in clusters.linkage_cut(df, 0.05, within="id").collect()} == {"a0": "a0", "a1": "a0", "a2": "a2", "b0": "b0", "b1": "b0", "b2": "b2"}
    assert {r.term: r.cluster for r in clusters.linkage_cut(df, 0.05).collect()} == {"a0": "a0", "a1": "a0", "a2": "a2", "b0": "a0", "b1": "a0", "b2": "a2"}


def same_as_sql(spark, name, d):
    """Whether a query and its SQL give the same rows over the tables in d."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in d.iterdir():
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(d)).collect()]
    assert len(want) > 1
    return sorted(map(repr, got)) == sorted(map(repr, want))


def test_categories_of_documents_beyond_five_digits(spark, tmp_path):
    ids = [*range(12), *range(299_994, 300_012), 3_000_001, 3_000_003, 3_000_006]
    spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert same_as_sql(spark, "category_map", tmp_path)


def test_texts_are_files_in_few_folders(spark, tmp_path):
    """Names and texts come back as they were; before, each paper had a folder of its own."""
    rows = [("a b+c.txt", "x"), ("100%.txt", "two\nlines\n"), ("_hidden", ""), (".dot", None), ("x/y=z:é?", "é\r\n"), ("paper=1", "\n"), *((f"n{i}.txt", f"t{i}") for i in range(600))]
    files.write_texts(spark.createDataFrame(rows, "paper string, text string"), str(tmp_path / "t"))
    assert {(r.paper, r.text) for r in files.read_texts(spark, str(tmp_path / "t")).collect()} == {(p, t or "") for p, t in rows}
    assert len([p for p in (tmp_path / "t").rglob("*") if p.is_dir()]) <= files.FOLDERS
    with pytest.raises(FileExistsError):
        files.write_texts(spark.createDataFrame(rows, "paper string, text string"), str(tmp_path / "t"))


def test_plugins_get_few_values_at_a_time(spark):
    """Before, a function got a whole batch, up to 10,000 pages, as Python strings."""
    from pyspark.sql import functions as F

    lens = plugins.from_python(lambda values: [f"{len(values)} {sum(len(v or '') for v in values)}" for _ in values], "string")
    rows = spark.range(0, 3000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 5000)).alias("t"))
    got = [tuple(map(int, r.n.split())) for r in rows.select(lens(F.col("t")).alias("n")).collect()]
    assert len(got) == 3000 and max(n for n, _ in got) <= plugins.SLICE_ROWS and max(b for _, b in got) <= plugins.SLICE_BYTES


def test_first_words_of_long_texts(spark):
    """The whole text is read only where its beginning doesn't tell; before, all of it was searched several times a row."""
    import re

    from pyspark.sql import functions as F

    from tricorpus import stage_queries as S

    texts = ["", "one", "One TWO three", "a b c " * 100 + "abc def ghi jkl", "abc def " + "x" * 900 + " ghi", "abc def " + "ab " * 128 + "longerword end more", "ÀBC abc ded efg " * 80, "K" * 5 + " İstanbul abc " + "z" * 500, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.w for r in rows.select("i", S._first_three(F.col("text")).alias("w")).collect()}
    assert got.pop(8) is None and got == {i: re.findall("[a-z]{3,}", t.lower())[:3] for i, t in enumerate(texts) if t is not None}
    plan = S._defined(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_choices_of_large_clusters_are_dealt_by_members(spark, monkeypatch):
    """64 choices of 20 papers each were one task's work, as they are fewer than CHOICES."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(groups, "MEMBERS", 40)
    rows = spark.createDataFrame([("c", f"p{p:02}", "s", f"v{k}", "o") for p in range(20) for k in range(2 if p < 6 else 1)], ROWS)
    found = groups.fair_groups(rows, spark.createDataFrame([(f"p{p:02}", "cs") for p in range(20)], "paper string, category string"))
    made = found.select(F.array_join(F.transform("members", lambda m: F.concat(m["paper"], m["verb"])), " ").alias("m"), F.spark_partition_id().alias("task")).collect()
    assert len(made) == len({r.m for r in made}) == 64 and len({r.task for r in made}) > 1
