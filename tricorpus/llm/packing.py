"""Conflict-constrained best-fit packing of documents into sequences of `capacity` tokens.

A document is its ids and an end id. Longer ones are cut into pieces of `capacity`; full pieces fill bins of their own, the rest is
packed like a short document. No bin holds two pieces with the same source or the same duplicate cluster. Items are dealt
by hash into shards of about SHARD_ITEMS, so a frequent source or cluster spreads evenly over them, and each shard is packed alone,
longest items first: open bins are ordered by residual room, each with a bitmap of its sources and one of its clusters; the
search goes from the least sufficient residual up until the tightest compatible bin is found, else a bin is opened.

Clusters: texts that are equal after lower-casing and joining words by single spaces are one cluster, unless a cluster column is given.

Result, one row a piece: doc_id, piece, n_pieces, source, n_tokens, bin (unique over all shards), start (in the bin). All documents
are placed whole. Nulls: a null text is the end id alone; null sources, and null clusters of a given column, conflict with nothing; a null doc_id is null in the
result. Repeated rows are packed each, and conflict as duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_slices
from .tokens import Counter, encoder

SHARD_ITEMS = 2048
PIECES = "doc_id long, piece int, n_pieces int, source string, n_tokens int, bin long, start int"


def pack_shard(items: list[tuple[int, str | None, str | None]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, length, bin, start) for items of (length >= 1, source, cluster), in the order given."""
    placed = []
    bits: tuple[dict, dict] = {}, {}
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
    open_rooms = 0  # bit r: some bin has residual r
    sources: list[int] = []
    clusters: list[int] = []
    rest = []
    for k, (n, source, cluster) in enumerate(items):
        full = (n - 1) // capacity
        for piece in range(full):
            placed.append((k, piece, capacity, len(sources), 0))
            sources.append(0)
            clusters.append(0)
        rest.append((n - full * capacity, k, full))
    for n, k, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
        s, c = (0 if v is None else 1 << of.setdefault(v, len(of)) for v, of in zip(items[k][1:], bits))
        least, found = n, None
        while found is None and (rooms := open_rooms >> least):
            room = least + (rooms & -rooms).bit_length() - 1  # the successor: least residual that suffices
            found = next((b for b in by_room[room] if not (sources[b] & s or clusters[b] & c)), None)
            least = room + 1
        if found is None:
            found, room = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        else:
            by_room[room].remove(found)
            if not by_room[room]:
                open_rooms ^= 1 << room
        placed.append((k, piece, n, found, capacity - room))
        sources[found] |= s
        clusters[found] |= c
        if left := room - n:
            by_room[left].append(found)
            open_rooms |= 1 << left
    return placed


def lengths(docs: DataFrame, tokenizer: str, cluster_col: str | None) -> DataFrame:
    """(doc_id, source, cluster, n_tokens) with the end id counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, Counter)
        for batch in row_slices(batches, limit=1 << 20):
            texts = batch.column("text").to_pylist()
            cluster = batch.column("cluster")
            if not cluster_col:
                cluster = pa.array([xxhash.xxh3_128_hexdigest(b" ".join(t.lower().encode().split())) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), cluster, pa.array([n + 1 for n in code.counts(texts)], pa.int64())], ["doc_id", "source", "cluster", "n_tokens"])

    cluster = F.col(cluster_col) if cluster_col else F.lit(None)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"), cluster.cast("string").alias("cluster"))
    return text.mapInArrow(run, "doc_id long, source string, cluster string, n_tokens long")


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = "byte_bpe_50k.json", cluster_col: str | None = None) -> DataFrame:
    """The placement of docs(doc_id, text, source)."""
    items = cut(lengths(docs, tokenizer, cluster_col), "lengths")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    # no doc_id, source or cluster decides the shard alone: equal rows go by their order in their partition
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.lit(shards)))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "source", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32()]

        def out(shard: int, rows: list[tuple]) -> pa.RecordBatch:
            pieces = pack_shard([(n, s, c) for _, n, s, c in rows], capacity)
            found = [(rows[k][0], piece, -(-rows[k][1] // capacity), rows[k][2], n, (shard << 32) | b, start) for k, piece, n, b, start in pieces]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "source", "cluster"))):
                if shard != now and rows:
                    yield out(now, rows)
                    rows = []
                now = shard
                rows.append(tuple(row))
        if rows:
            yield out(now, rows)

    return ordered.mapInArrow(run, PIECES)
