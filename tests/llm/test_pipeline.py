import random

import pytest

import corpus_pipeline
from tricorpus.llm import decontaminate, pii, quality, simhash


def prose(r, n):
    """Words as common as in real texts."""
    return r.choices([f"w{k}" for k in range(300)], [1 / (k + 1) for k in range(300)], k=n)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    item = [f"item{k}" for k in range(30)]
    rows = [(i, " ".join(prose(r, 80)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50, rows[3][1], "en", "s1"), (51, rows[4][1] + " more", "en", "s1"), (52, " ".join(prose(r, 200) + item + prose(r, 200)), "en", "s2")]
    rows += [(53, "too short", "en", "s0"), (54, " ".join(["again"] * 50), "en", "s0"), (55, " ".join(prose(r, 40)) + " mail a.b@example.com now " + " ".join(prose(r, 40)), "en", None), (56, None, None, None)]
    d = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_each_stage_decides_over_what_the_last_one_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.asDict() for r in kept.collect()}
        out = stage(spark, kept, folder)
        assert out.schema == docs.schema, name
        after = {r.doc_id: r.asDict() for r in out.collect()}
        if name == "quality_rules":
            want = {r.doc_id for r in quality.quality(kept).collect() if r.kept}
            assert not want & {53, 54, 56} and want >= set(range(40))
        elif name == "simhash_dedup":
            want = {c for _, _, c in simhash.brute_force([(i, x["text"]) for i, x in before.items()])}
            assert 50 not in want
        elif name == "decontamination":
            want = before.keys() - {r.doc_id for r in decontaminate.contaminated(kept, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
            assert want == before.keys() - {52}
        else:
            want = before.keys()
            assert "[email]" in after[55]["text"] and after[55]["n_chars"] == len(after[55]["text"])
            assert all(not pii.base_spans(x["text"]) for x in after.values())
        assert after.keys() == want, name
        if name != "pii_redaction":
            assert all(after[i] == before[i] for i in after)
        kept = spark.createDataFrame([tuple(x.values()) for x in after.values()], docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert {r.doc_id for r in packed} == set(after)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.n_tokens) for r in whole} == {(r.doc_id, r.n_tokens) for r in packed}
