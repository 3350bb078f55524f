import random

import numpy as np

from tricorpus.llm import simhash, substring_dedup, suffix_dedup

from .conftest import prose


def test_substrings_equal_brute_force(docs, rows):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digest(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(substring_dedup.brute_force(rows), key=key)


def test_substrings_of_random_texts(spark):
    r = random.Random(4)
    passages = [prose(r, r.randint(45, 70), 30) for _ in range(6)]
    rows = [(i, " ".join(sum((prose(r, r.randint(0, 20), 30) + r.choice(passages) for _ in range(r.randint(0, 3))), []))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_digest(df).collect()]
    assert sorted(got) == sorted(substring_dedup.brute_force(rows))


def test_substrings_of_an_empty_table(empty):
    assert substring_dedup.substring_digest(empty).count() == 0


def test_covers_hold_every_difference():
    for v, cover in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_passages_hold_all_long_matches_and_only_matches(spark):
    r = random.Random(8)
    passages = [prose(r, r.randint(50, 90), 3000) for _ in range(5)]
    texts = {i: sum((prose(r, r.randint(0, 30), 3000) + r.choice(passages) for _ in range(r.randint(1, 2))), []) + prose(r, 9, 3000) for i in range(40)}
    texts[40], texts[41] = texts[3], []
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    found = suffix_dedup.repeated_passages(df).collect()
    got = {i: set() for i in texts}
    cuts = {i: set() for i in texts}
    for f in found:
        got[f.doc_id] |= set(range(f.start_word, f.end_word))
        cuts[f.doc_id] |= {k for c in f.cuts for k in range(c.a, c.b)}
    for n, holds in ((50, lambda must, have: must <= have), (50 - suffix_dedup.GAP + 1, lambda may, have: have <= may)):
        grams = {i: windows(w, n) for i, w in texts.items()}
        for i, w in texts.items():
            others = set().union(*(g for j, g in grams.items() if j != i))
            covered = {k + m for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in others for m in range(n)}
            assert holds(covered, got[i]), (i, n)
    for i, w in texts.items():  # what may be dropped is in a smaller doc_id, n-gram by n-gram
        n = 50 - suffix_dedup.GAP + 1
        less = set().union(*(windows(x, n) for j, x in texts.items() if j < i)) if i else set()
        assert cuts[i] <= {k + m for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in less for m in range(n)}


def test_cuts_hold_every_long_match_with_a_smaller_doc_id(spark):
    r = random.Random(15)
    passages = [prose(r, r.randint(50, 70), 3000) for _ in range(8)]
    texts = {i: sum((prose(r, r.randint(0, 20), 3000) + r.choice(passages) for _ in range(r.randint(1, 3))), []) + prose(r, 5, 3000) for i in range(40)}
    base = prose(r, 200, 3000)
    texts |= {40: base[:90], 41: prose(r, 5, 3000) + base[75:150], 42: base[30:82] + prose(r, 8, 3000), 43: prose(r, 9, 3000) + base + prose(r, 9, 3000), 44: base[60:190]}
    found = suffix_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()
    cuts = {i: set() for i in texts}
    for f in found:
        mine = {k for c in f.cuts for k in range(c.a, c.b)}
        assert mine <= set(range(f.start_word, f.end_word))
        cuts[f.doc_id] |= mine
    for i, w in texts.items():
        for n, holds in ((50, lambda must, have: must <= have), (50 - suffix_dedup.GAP + 1, lambda may, have: have <= may)):
            less = set().union(*(windows(x, n) for j, x in texts.items() if j < i))
            assert holds({k + m for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in less for m in range(n)}, cuts[i]), (i, n)


def test_passages_of_messy_rows(docs, empty):
    found = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert (11, 0, 120) in found and (None, 0, 120) in found and (5, 0, 80) in found
    assert {(i, a) for i, a, _ in found} >= {(3, 30), (4, 5), (12, 0), (13, 0)}
    assert not {i for i, _, _ in found} & {6, 7, 8, 9, 10, 15, 17}
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_dropping_repeats_keeps_each_passage_once(spark):
    r = random.Random(5)
    passage = prose(r, 70, 3000)
    rows = [(i, " ".join(prose(r, 20, 3000) + passage + prose(r, 20, 3000))) for i in range(4)]
    kept = {x.doc_id: x.text.split() for x in suffix_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[0] == rows[0][1].split()
    assert all(len(kept[i]) <= 60 and kept[i][:15] == rows[i][1].split()[:15] for i in (1, 2, 3))


def test_simhash_equals_brute_force(docs, rows):
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(simhash.brute_force(rows), key=key)


def test_components_of_fingerprints_in_crowded_buckets(spark):
    r = random.Random(6)
    prints = []
    for _ in range(25):
        centre = r.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            prints.append(x)
    prints += [(5 << 40) | k for k in range(1500)]  # one bucket of many
    label = list(range(len(prints)))
    fps = np.array(prints, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[i]) <= 4
            least = min(np.array(label)[near])
            for j in np.flatnonzero(near):
                if label[j] > least:
                    label[j], changed = int(least), True
    df = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in simhash.components(df).collect()}
    assert [got[i] for i in range(len(fps))] == label


def test_a_large_bucket_is_not_paired_at_large():
    rng = np.random.default_rng(1)
    for first, bits in simhash.segments(4):
        own = np.uint64(((1 << bits) - 1) << first)
        fps = np.unique(rng.integers(0, 2**64, 100_000, dtype=np.uint64, endpoint=False) & ~own)
        assert simhash.Forest(fps, 4).compared < 0.02 * len(fps) ** 2


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    for trial in range(6):
        fps = rng.integers(0, 2**64, 15, dtype=np.uint64)[rng.integers(0, 15, 2500)]
        for _ in range(trial + 1):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 24, len(fps)).astype(np.uint64))
        fps = np.unique(fps)
        label, last = np.arange(len(fps)), None
        while last is None or (label != last).any():
            last = label.copy()
            for i in range(len(fps)):
                near = np.bitwise_count(fps ^ fps[i]) <= 4
                label[near] = label[near].min()
        found = simhash.Forest(fps, 4)
        found.one_tree(np.arange(len(fps)))
        assert (found.parent == label).all()
        assert all(int(fps[i] ^ fps[j]).bit_count() <= 4 for i, j in found.links)


def test_keep_first_has_one_of_each_group(docs, empty):
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 11 not in ids and ids.count(15) == 1 and 19 not in ids
    assert simhash.keep_first(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first_of_rows_without_ids_or_with_one_id(spark):
    r = random.Random(14)
    texts = [" ".join(prose(r, 40, 3000)) for _ in range(6)]
    rows = [(None, t, "x") for t in texts + texts[:3]] + [(1, texts[0], "y"), (7, texts[4], "y"), (7, texts[5], "z"), (7, texts[5], "z")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, __n string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, texts[0], "y"), (7, texts[4], "y"), (7, texts[5], "z")] + [(None, t, "x") for t in texts[1:4]], key=repr)


def passages(df, **options):
    return {(r.doc_id, r.start_word, r.end_word, r.first_doc_id, tuple(sorted((c.a, c.b) for c in r.cuts))) for r in suffix_dedup.repeated_passages(df, **options).collect()}


def test_passages_of_messy_rows_equal_brute_force(docs, rows):
    assert passages(docs) == suffix_dedup.brute_force(rows)


def test_passages_of_random_texts_equal_brute_force(spark):
    """Few words, so that matches branch, with copies, null ids, repeated ids and one passage that most rows hold."""
    r = random.Random(31)
    shared = [prose(r, r.randint(45, 75), 40) for _ in range(6)]
    texts = [sum((prose(r, r.randint(0, 25), 40) + r.choice(shared)[r.randint(0, 9) :] for _ in range(r.randint(0, 3))), []) + prose(r, 6, 40) for _ in range(60)]
    texts += [prose(r, r.randint(0, 9), 3000) + shared[0] + prose(r, r.randint(0, 9), 3000) for _ in range(80)] + [["again"] * 130, ["again"] * 90, ["x", "y"] * 60]
    rows = [(k if r.random() < 0.8 else r.choice([None, 3, 50]), " ".join(t)) for k, t in enumerate(texts)]
    rows += [(200 + k, r.choice(rows)[1]) for k in range(15)] + [r.choice(rows) for _ in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert passages(df) == suffix_dedup.brute_force(rows)
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_digest(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(substring_dedup.brute_force(rows), key=key)


def test_a_prefix_over_many_partitions(spark):
    """Edges of partitions: whole partitions of one prefix, and a prefix whose two rows are in two of them."""
    rows = [(7, t, 0) for t in range(300)] + [(9, 1, 0), (9, 1, 3), (11, 5, 0), (11, 6, 0), (12, 5, 1), (12, 5, 1)] + [(k, 0, 0) for k in range(20, 400)] + [(390, 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    try:
        found = suffix_dedup.matching(spark.createDataFrame(rows, "code long, text_key long, pos int"))
        assert {tuple(x) for x in found.collect()} == {(t, 0) for t in range(300)} | {(5, 0), (6, 0), (0, 0), (1, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_rows_without_id(spark):
    r = random.Random(12)
    shared = prose(r, 60, 3000)
    rows = [(None, " ".join(prose(r, 20, 3000) + shared)) for _ in range(300)] + [(5, " ".join(shared))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = suffix_dedup.drop_repeats(df).collect()
    assert sorted(len(x.text.split()) for x in kept) == [20] * 300 + [60]
    assert sorted(x.n_removed for x in substring_dedup.substring_digest(df).collect()) == [0] + [60] * 300
