import random
import re

from pyspark.sql import functions as F

from tricorpus.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(words) < 2000 else set()
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts(spark, docs, rows):
    got = sorted(tuple(r)[1:7] for r in quality.quality(docs).collect())
    assert got == sorted(expected(t) for _, t in rows)


def test_base_counts_of_marks_and_lines(spark):
    texts = ["a # b\na # b\n\n \nc $%", "x\r\nx\r\nx", "one two three four five one two three four five six"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality(df).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_divergent_documents_go_and_clean_ones_stay(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(500)]
    weights = [1 / (k + 1) for k in range(500)]
    clean = [(i, " ".join(r.choices(vocabulary, weights, k=200)), "en") for i in range(60)]
    odd = [(100 + i, " ".join(f"#{r.randrange(10**6)}|" for _ in range(200)), "en") for i in range(3)]
    short = [(200, "#1 #2 #3 #4 #5 #6 #7 #8 #9 #10 #11 #12", "en")]  # under the guard
    df = spark.createDataFrame(clean + odd + short, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    assert all(kept[i] for i, _, _ in clean)
    assert not any(kept[i] for i, _, _ in odd)
    assert kept[200]


def test_a_small_language_of_a_large_corpus_is_judged(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(500)]
    clean = [" ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(500)], k=200)) for _ in range(33)]
    odd = [" ".join(f"#{r.randrange(10**6)}|" for _ in range(200)) for _ in range(2)]
    small = [(i, t, lang) for n, lang in enumerate(("xx", "yy")) for i, t in enumerate(clean[:28] + odd, 100 * n)]
    few = [(300 + i, odd[i % 2], "zz") for i in range(3)]  # under min_docs
    large = spark.range(1000, 33_000).select("id", F.element_at(F.array(*map(F.lit, clean)), (F.col("id") % 33 + 1).cast("int")), F.lit("en"))
    df = spark.createDataFrame(small + few, "doc_id long, text string, lang string").union(large)
    kept = {x.doc_id: x.kept for x in quality.quality(df).where("doc_id < 1000").collect()}
    assert len(kept) == 63
    assert {i for i, k in kept.items() if not k} == {28, 29, 128, 129}
    assert quality.keep_good(df).count() == 32_000 + 59


def test_verdicts_equal_a_plain_version(spark):
    """References, distances and limits from their definition, for languages of 1, 2, 3, 25 and 60 documents, in a table that joins the small ones and in one that doesn't."""
    import math
    from collections import Counter

    r = random.Random(8)
    vocabulary = ["".join(r.choice("etaoinshrdluß9#") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts = lambda n: [" ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=r.randint(50, 220))) for _ in range(n)]
    rows = [(t, lang) for lang, n in (("a", 1), ("b", 2), ("c", 3), ("d", 25), ("e", 60)) for t in texts(n)]
    rows += [(" ".join(f"{r.randrange(10**6)}|" for _ in range(80)), lang) for lang in "de" for _ in range(3)] + [(None, "d"), ("short text", "f"), (texts(1)[0], None)]
    limits = quality.Limits()
    shares = lambda counts: {k: n * 10**6 // sum(counts.values()) for k, n in counts.items()}
    kind = lambda c: "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c in "0123456789" else "space" if c in " \t\n\v\f\r" else "symbol" if c in "#*$%&|<>" else "ascii" if c < "\x80" else "beyond"
    words = lambda t: [w.lower().strip(".,;:!?\"'()") for w in WORD.findall(t)]

    def distance(p, q):
        p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (p, q))
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p | q}
        return math.sqrt(sum(x[k] * math.log2(x[k] / m[k]) for x in (p, q) for k in x if x[k]) / 2)

    judged = {}
    for lang in {x or "" for _, x in rows}:
        own = [t for t, x in rows if (x or "") == lang and len(words(t or "")) >= limits.min_words]
        chars, counts, having = Counter(), Counter(), Counter()
        for t in own:
            chars.update(shares(Counter(map(kind, t))))
            counts.update(shares(Counter(words(t))))
            having.update(set(words(t)))
        common = {w for w in having if having[w] >= limits.common_share * len(own)}
        reference = {w: counts[w] // len(own) for w in common}
        reference[None] = 10**6 - sum(reference.values())
        for t in own:
            slack = lambda of: of / math.sqrt(len(words(t))) + limits.docs_slack / math.sqrt(len(own))
            one = distance(Counter(map(kind, t)), {k: n // len(own) for k, n in chars.items()})
            two = distance(Counter(w if w in common else None for w in words(t)), reference)
            judged[t, lang] = one, two, not (expected(t)[5] or one > limits.chars + slack(limits.chars_slack) or two > limits.words + slack(limits.words_slack))
    assert len({k for _, _, k in judged.values()}) == 2
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, text string, lang string")
    many = df.union(spark.range(1000, 90_000).select("id", F.lit(" ".join(["and"] * 60)), F.lit("zz")))
    for table in (df, many):
        for x in quality.quality(table).where("doc_id < 1000").collect():
            t, lang = rows[x.doc_id]
            one, two, kept = judged.get((t, lang or ""), (None, None, not expected(t)[5]))
            assert x.kept == kept and (x.js_chars is None) == (one is None)
            assert one is None or (abs(x.js_chars - one) < 1e-6 and abs(x.js_words - two) < 1e-6)


def test_js_distance():
    import numpy as np

    d = quality.js_distance(np.array([[1, 0], [1, 1], [0, 0]]), np.array([0.0, 5.0]))
    assert abs(d[0] - 1) < 1e-12 and 0 < d[1] < 1
    assert quality.js_distance(np.array([[2, 6]]), np.array([1.0, 3.0]))[0] < 1e-9


def test_keep_good_returns_the_documents_columns(docs, empty):
    assert quality.keep_good(docs).schema == docs.schema
    assert quality.keep_good(empty).count() == 0
    assert quality.quality(empty).count() == 0
