import random

from tricorpus.llm import packing


def test_every_item_goes_to_the_tightest_compatible_bin():
    r = random.Random(2)
    items = [(r.randint(1, 90), r.choice(["a", "b", "c", None]), r.choice(["x", "y", None, None, None])) for _ in range(120)]
    rooms, tags = {}, {}
    for k, piece, n, b, start in packing.pack_shard(items, 40):
        own = {("s", items[k][1]), ("c", items[k][2])} - {("s", None), ("c", None)}
        if piece < (items[k][0] - 1) // 40:
            assert n == 40 and start == 0 and b not in rooms
            rooms[b], tags[b] = 0, set()
            continue
        fits = [room for i, room in rooms.items() if room >= n and not tags[i] & own]
        if b in rooms:
            assert rooms[b] == min(fits) and not tags[b] & own and start == 40 - rooms[b]
        else:
            assert not fits and start == 0
            rooms[b], tags[b] = 40, set()
        rooms[b] -= n
        tags[b] |= own


def check(rows, docs_n, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda p: p.start)
        at = 0
        for p in pieces:
            assert p.start == at
            at += p.n_tokens
        assert at <= capacity
        sources = [p.source for p in pieces if p.source is not None]
        assert len(sources) == len(set(sources))
    assert sum(r.piece == 0 for r in rows) == docs_n


def test_messy_rows_are_placed_whole(docs, rows, empty):
    placed = packing.pack(docs, capacity=1024).collect()
    check(placed, len(rows), 1024)
    from tricorpus.llm.tokens import encoder

    code = encoder()
    want = sorted(len(x) // code.dtype.itemsize + 1 for x in code.texts([t or "" for _, t in rows]))
    assert sum(p.n_tokens for p in placed) == sum(want)
    assert packing.pack(empty).count() == 0


def test_one_source_with_most_rows(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 7 + 1), "hot" if i % 3 else f"s{i}") for i in range(300)], "doc_id long, text string, source string")
    check(packing.pack(df, capacity=256).collect(), 300, 256)


def test_copies_are_never_in_one_bin(spark):
    df = spark.createDataFrame([(i, "the very same text" if i % 2 else f"other {i}", f"s{i}") for i in range(100)], "doc_id long, text string, source string")
    placed = packing.pack(df, capacity=4096).collect()
    same = [p.bin for p in placed if p.doc_id % 2]
    assert len(same) == len(set(same)) == 50
