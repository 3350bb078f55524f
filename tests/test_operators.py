import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricorpus.functions import abbreviations, coref, plugins
from tricorpus.functions import text as T
from tricorpus.lineage import components, ranked
from tricorpus.operators import claims, cleaning, clusters, corpus, groups, spread, terms, triplets
from tricorpus.sources import files


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text"))).first()[0]


def test_versions_of_two_digits_and_ids_with_a_v(spark):
    df = spark.createDataFrame([("2101.1v9.pdf",), ("2101.1v10.pdf",), ("solv-int.3v1.pdf",), ("notes.pdf",)], "name string")
    assert {r.name for r in corpus.newest_versions(df).collect()} == {"2101.1v10.pdf", "solv-int.3v1.pdf"}
    assert [r.name for r in corpus.older_versions(df).collect()] == ["2101.1v9.pdf"]


def test_categories_are_whole_words(spark):
    df = spark.createDataFrame([("0704.0010", "cs.C math"), ("2", "cs.CL"), ("3", None)], "id string, categories string")
    assert [r.id for r in corpus.keep_categories(df, ("cs.CL",)).collect()] == ["2"]
    assert {r.id for r in corpus.keep_categories(df, ("cs.CL",), inverse=True).collect()} == {"0704.0010", "3"}
    assert tuple(corpus.category_share(df, ("cs.CL",)).first()) == (3, 1, pytest.approx(1 / 3))
    assert corpus.category_share(df.where("false"), ("cs.CL",)).first().share is None


def plain_sections(text):
    low = text.lower()
    a, i = low.find("abstract"), low.find("introduction")
    start = min(a, i) if a >= 0 and i >= 0 else 100 if a < 0 and i < 0 else max(a, i)
    r, k = low.rfind("reference"), low.rfind("acknowledgement")
    end = k if 0 <= k < r and k > len(text) / 2 else r if r >= 0 else len(text)
    return text[start : max(start, end)]


def test_sections_equal_a_plain_version(spark):
    r = random.Random(1)
    parts = ["Abstract ", "INTRODUCTION ", "References ", "Acknowledgements ", "x" * 40 + " ", "y" * 90 + " ", "é "]
    texts = ["", "short"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 8))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [x[0] for x in df.select(T.strip_sections("text")).collect()] == [plain_sections(t) for t in texts]


def test_et_al_takes_the_next_sentence(spark):
    r = random.Random(2)
    for _ in range(30):
        sentences = [r.choice(["a", "b et al.", "c.", "", "al."]) for _ in range(r.randint(1, 8))]
        want = []
        for i, s in enumerate(sentences):
            if i and sentences[i - 1].endswith("et al."):
                want[-1] += " " + s
            else:
                want.append(s)
        assert one(spark, "\n".join(sentences), lambda t: T.merge_et_al(F.split(t, "\n"))) == want


def test_cleaning_of_lines(spark):
    assert one(spark, "a- b- c\nd-\ne", T.join_broken_words) == "ab- c\nd-\ne"
    text = "x [12] [1, 2] [2020a] (Smith et al., 2020) (A 2019; B 2020) (a & b 2020) [llm2] (3)"
    assert one(spark, text, T.strip_citations) == "x  [1, 2]   (A 2019; B 2020) (a & b 2020) [llm2] "
    df = spark.createDataFrame([("p", "keep\ncut [1] here [2]")], "paper string, text string")
    assert [tuple(r) for r in cleaning.edits(df, "citations", T.strip_citations, T.CITATION).collect()] == [("citations", "p", 1, "cut [1] here [2]", "cut  here ", ["[1]", "[2]"])]


def test_abbreviations():
    pairs = abbreviations.find_pairs("We use random test model (RTM) here. The RTM works.")
    assert pairs == [{"abbr": "RTM", "definition": "random test model"}, {"abbr": "rtm", "definition": "random test model"}]
    assert abbreviations.expand_line("RTM, RTMs, aRTM (RTM)", pairs)[0] == "random test model, RTMs, aRTM (random test model)"
    assert abbreviations.expand_line("C++ is", [{"abbr": "C++", "definition": "see"}])[0] == "see is"
    assert abbreviations.expand_line("C++ is", [{"abbr": "*a", "definition": "x"}], raw_patterns=True) == ("C++ is", [], [])


def test_coreferences():
    text = "The model works. It is fast. We like it, too."
    groups_ = [[(0, 9), (17, 19), (37, 39)]]
    assert coref.rewrite(text, groups_, {"model"})[0] == "The model works. the model is fast. We like the model , too."
    assert coref.rewrite(text, groups_, {"absent"})[0] == text
    assert "".join(coref.chunks("ab\ncd\nefghij", 4)) == "ab\ncd\nefghij" and max(map(len, coref.chunks("ab\ncd\nefghij", 4))) <= 4


def test_claims_need_more_than_five_words(spark):
    df = spark.createDataFrame([("p", "one two three four five. one two three four five six."), ("q", ""), ("r", None)], "paper string, text string")
    assert [(r.paper, r.pos) for r in claims.long_sentences(df).collect()] == [("p", 1)]
    assert claims.claims(df, threshold=1.0).count() == 0


def test_normalising_keeps_or_tells_why(spark):
    rows = [("p", 0, "The Networks of the", "has been shown", "better Results!"), ("p", 1, "the", "is", "model"), ("p", 2, "a b c d e f g", "x", "y"), ("p", 3, "quickly", "runs", "models"), ("p", 4, "models", "the run", "a1")]
    df = spark.createDataFrame(rows, "paper string, pos int, subject string, verb string, object string")
    marked = {r.pos: r for r in triplets.normalise(df, mark=True).collect()}
    kept = {r.pos: r for r in triplets.normalise(df).collect()}
    assert (kept[0].subject, kept[0].verb, kept[0].object) == ("network", "shown", "better result")
    assert {k: v.reason for k, v in marked.items()} == {0: None, 1: "stop words", 2: "length", 3: "tags", 4: "short"}
    assert kept.keys() == {k for k, v in marked.items() if v.reason is None}
    assert {r.reason: r.n for r in triplets.reasons(triplets.normalise(df, mark=True)).collect()}["kept"] == 1


def test_lists_come_back_through_csv(spark, tmp_path):
    df = spark.createDataFrame([("p", 0, 'a "b"', "c, d", "e\nf"), ("p", 1, "x", "y", "z's")], "paper string, pos int, subject string, verb string, object string")
    lists = triplets.nest(df, spark.createDataFrame([("p",), ("none",)], "paper string"))
    files.write_triplet_csv(lists, str(tmp_path / "t"))
    back = files.triplet_csv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, triplets.unnest(back).collect())) == sorted(map(tuple, df.collect()))
    assert triplets.without_empty(back).count() == 1 and back.count() == 2


def test_scores_by_hand(spark):
    c = spark.createDataFrame([("both", 2), ("rare", 1), ("only", 1), ("a-b", 3), ("12", 3)], "term string, df long")
    p = spark.createDataFrame([("both", 20), ("rare", 9), ("new", 10), ("few", 9), ("a-b", 20), ("12", 20)], "term string, df long")
    got = {r.term: r.score for r in terms.term_scores(c, p, 100, 40).collect()}
    assert got == {"both": pytest.approx(math.log(0.5) - math.log(0.02)), "rare": -math.inf, "only": -math.inf, "new": math.inf, "few": -math.inf}
    scores = spark.createDataFrame(list(got.items()), "term string, score double")
    df = spark.createDataFrame([("p", 0, "new thing", "v", "o"), ("p", 1, "few", "v", "new"), ("p", 2, "", "v", "o")], "paper string, pos int, subject string, verb string, object string")
    assert [r.pos for r in terms.domain_flags(df, scores, 0.1).where("domain").collect()] == [0]
    assert {r.pos for r in terms.domain_flags(df, scores, 0.9).where("domain").collect()} == {0, 1}  # the cut is minus infinity
    with pytest.raises(ValueError):
        terms.top_cut(scores, 1.0)


def test_ranks_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert all(r.x == r["rank"] for r in ranked(df, "x").collect())
    assert [r.x for r in terms.first_share(df, "x", 0.0123).orderBy("x").collect()] == list(range(12))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[k] == 100 for k in range(100, 160)) and 200 not in got


def plain_upgma(x, t):
    sets = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(sets) > 1:
        h, a, b = min((np.mean(d[np.ix_(p, q)]), i, j) for i, p in enumerate(sets) for j, q in enumerate(sets) if i < j)
        if h > t:
            break
        sets[a] += sets.pop(b)
    return sorted(map(sorted, sets))


def test_average_linkage_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    for t in (0.05, 0.3, 0.7):
        centres = rng.normal(size=(6, 8))
        x = np.concatenate([c + rng.normal(size=(7, 8)) * 0.4 for c in centres])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 8)], "term string, embedding array<double>")
        found = {}
        for r in clusters.linkage_cut(df, t, block_rows=10).collect():
            found.setdefault(r.cluster, []).append(r.term)
        assert all(k == min(v) for k, v in found.items()) and found.pop("zero") == ["zero"]
        assert sorted(sorted(map(int, v)) for v in found.values()) == plain_upgma(x, t)


def test_mean_spread_needs_no_groups(spark):
    r = random.Random(4)
    rows = [(f"c{r.randrange(6)}", f"p{r.randrange(7)}", f"s{k}", f"v{r.randrange(5)}", f"o{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "cluster string, paper string, subject string, verb string, object string").dropDuplicates()
    cats = spark.createDataFrame([(f"p{k}", "cs" if k % 2 else "quant") for k in range(7)], "paper string, category string")
    vectors = spark.createDataFrame([(f"v{k}", [float(k), float(k * k)]) for k in range(5)], "term string, embedding array<double>")
    found = groups.fair_groups(df, cats, max_product=10**6)
    full = {(x.kind, x.size): x.spread for x in spread.spread(found, vectors).collect()}
    fast = {(x.kind, x.size): x.spread for x in spread.mean_spread(df, cats, vectors).collect()}
    assert full.keys() == fast.keys() and all(abs(full[k] - fast[k]) < 1e-9 for k in full)
    assert {(x.kind, x.size): x.n_groups for x in groups.group_sizes(df, cats).collect()} == {(x.kind, x.size): x["count"] for x in found.groupBy("kind", "size").count().collect()}
    with pytest.raises(Exception, match="max_product"):
        groups.fair_groups(df, cats, max_product=1).collect()
    with pytest.raises(ValueError):
        spread.mean_spread(df, cats, vectors.where("term <> 'v0'"))


def test_quartile_is_over_both_orders(spark):
    df = spark.createDataFrame([("g", 0, [0.0]), ("g", 1, [1.0]), ("g", 2, [3.0])], "g string, place int, embedding array<double>")
    d = [abs(a - b) for i, a in enumerate((0, 1, 3)) for j, b in enumerate((0, 1, 3)) if i != j]
    assert spread.group_distances(df, ["g"], method="third_quartile").first().spread == pytest.approx(np.percentile(d, 75))
    with pytest.raises(ValueError):
        spread.group_distances(df, ["g"], method="median")


def test_language_default(spark):
    assert one(spark, "the cat is in the house", plugins.language) == "en"
    assert one(spark, "der Hund und die Katze", plugins.language) == "de"
    assert one(spark, "zzz", plugins.language) == "err"


def test_svo_default(spark):
    found = one(spark, "The new model improves all results.", plugins.triplets)
    assert [(x.subject, x.verb, x.object) for x in found] == [(["The", "new", "model"], ["improves"], ["all", "results"])]
    assert one(spark, "No such word here", plugins.triplets) == []


def test_stream_equals_batch(spark, tmp_path):
    from tricorpus.plans.pipeline import claim_triplets, clean_texts
    from tricorpus.streaming import papers

    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"p{i}.txt").write_text("Abstract the new model improves all of the results in this table. " * (i + 1))
    stream = papers.triplet_stream(papers.text_stream(spark, str(src)), threshold=0.0)
    papers.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    batch = claim_triplets(clean_texts(files.texts(spark, str(src)).drop("path")), threshold=0.0)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got and got == sorted(map(tuple, batch.select("paper", "pos", "subject", "verb", "object").collect()))


def test_built_in_operators_use_no_python(spark):
    from tricorpus.queries import QUERIES

    for name in "newest_version strip_sections strip_citations claim_gate triplet_cleanup paper_df cluster_by_both".split():
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
