import random
import re
import time

from pyspark.sql import functions as F

from tricorpus import logs
from tricorpus.functions import abbreviations, plugins
from tricorpus.operators import groups
from tricorpus.sources import files


def test_tags_are_stripped_as_by_patterns():
    r = random.Random(1)
    pieces = ["<p>", "</p>", "<script>", "<script a='1'>", "</script >", "<STYLE>", "</style>", "<scripted>", "text", " ", "\n", "<", ">", "<!-- x -->", "a < b", "é"]
    for _ in range(3000):
        page = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", page)
        assert plugins.strip_tags(page) == re.sub(r"[ \t]+", " ", re.sub(r"(?s)<[^>]*>", " ", plain)).strip(), page


def test_long_pages_and_many_brackets_take_little_time():
    began = time.thread_time()
    for page in ("<" * 400_000, "<script>" * 50_000, "<style><script>" * 30_000, "<a" * 200_000 + ">"):
        plugins.strip_tags(page)
    abbreviations.find_pairs("some words (AB) " * 30_000)
    abbreviations.find_pairs("word" * 100_000 + " (AB)" * 10_000)
    assert time.thread_time() - began < 20


def test_pairs_equal_those_of_whole_sentences_before():
    def plain(text):
        pairs = {}
        for m in abbreviations._BRACKETS.finditer(text):
            short = re.split(r"[,;]", m[1])[0].strip()
            if abbreviations._fits(short):
                words = re.split(r"[.!?\n]\s", text[: m.start()])[-1].rstrip().split(" ")[-min(len(short) + 5, len(short) * 2) :]
                if found := abbreviations._long_form(short, " ".join(words)):
                    pairs[short] = found
        return [{"abbr": k, "definition": v} for k, v in pairs.items()]

    r = random.Random(3)
    pieces = ["random", "test", "model", "(RTM)", "(TM, x)", "(rt m)", "Test.", "Model?", "\n", "a", "  ", ". ", "(A1)", "x" * 300]
    found = 0
    for _ in range(3000):
        text = " ".join(r.choice(pieces) for _ in range(r.randint(0, 20)))
        assert abbreviations.find_pairs(text, False) == plain(text), text
        found += bool(plain(text))
    assert found > 300


def test_detectors_and_extractors_may_fail(spark):
    def picky(text):
        if len(text) > 514:
            raise ValueError("too long")
        if not text:
            raise ValueError("nothing")
        return f"l{len(text)}"

    df = spark.createDataFrame([(1, "x" * 2000), (2, ""), (3, None), (4, "abc")], "id int, text string")
    assert {r.id: r.l for r in df.select("id", plugins.detected(picky)(F.col("text")).alias("l")).collect()} == {1: "l514", 2: "err", 3: "err", 4: "l3"}
    assert {r.id: r.t for r in df.select("id", plugins.extracted(lambda t: t[0] * 2)(F.col("text").cast("binary")).alias("t")).collect()} == {1: "xx", 2: "", 3: "", 4: "aa"}


def test_logs(spark, tmp_path):
    log = logs.get_logger("stage", str(tmp_path / "log"), clear=True)
    assert logs.get_logger("stage") is log and len(log.handlers) == 1
    df, seen = logs.counted(spark.range(7), "seven")
    with logs.timed(log, "counting"):
        df.write.format("noop").mode("overwrite").save()
    log.info("%d rows", seen.get["rows"])
    written = (tmp_path / "log").read_text()
    assert "counting: begins" in written and "counting: took" in written and "7 rows" in written
    edits = spark.createDataFrame([("citations", 1), ("hyphens", 2)], "stage string, line int")
    path = str(tmp_path / "edits")
    for clear in (False, False, True, False):
        logs.write_edits(edits, path, clear)
    assert spark.read.parquet(path).count() == 4


def test_whole_texts_are_read(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("one\ntwo\n")
    (tmp_path / "a" / "b" / "y.txt").write_text("three\nfour")
    assert {r.paper: r.text for r in files.texts(spark, str(tmp_path / "a")).collect()} == {"x.txt": "one\ntwo\n", "y.txt": "three\nfour"}
    assert [r.paper for r in files.texts(spark, str(tmp_path / "a"), recursive=False).collect()] == ["x.txt"]


def test_choices_beyond_one_row(spark):
    """17 papers of two triplets each are 131,072 choices: more than one row makes."""
    rows = [("c", p, f"s{p}", f"v{k}", "o") for p in range(17) for k in range(2)]
    df = spark.createDataFrame(rows, "cluster string, paper int, subject string, verb string, object string")
    cats = spark.createDataFrame([(p, "cs") for p in range(17)], "paper int, category string")
    found = groups.fair_groups(df, cats)
    assert found.count() == 2**17
    assert found.select(F.array_join(F.transform("members", lambda m: m["verb"]), "")).distinct().count() == 2**17
