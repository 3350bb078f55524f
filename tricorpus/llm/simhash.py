"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits; bit b is set if over half of the text's shingle hashes (XXH64, seed 42) have it. Cut the
fingerprint into floor(distance / 2) + 1 segments: of two fingerprints that differ in at most `distance` bits, one segment
differs in at most one bit. For each of the 64 bits, index the segment that holds it with that bit left out: two segments that
differ in at most one bit share a variant. Fingerprints that share a variant are compared in full, and only links within
`distance` survive. Equal fingerprints are one node, so copies never meet in a bucket.

Buckets are streamed in key order. A small bucket gives its links; a larger one gives a spanning forest of its links: past BLOCK members
it is split, again and again, by the bits in which its members differ (of distance + 1 parts of those, one is equal in both ends of a
link), and what is connected already isn't looked at again, so its members are never paired at large, and no link between
different texts is lost. A bucket needs some 40 bytes a distinct fingerprint.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null doc_id counts as greater than any other
and is null in the result. Texts with fewer than `k` words have one shingle, the whole sequence. Repeated rows give
repeated result rows in one component; rows with one doc_id and different texts are linked by their fingerprints alone. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import components as connected_components
from .common import byte_texts, cut, plain_docs, real_id, row_slices

SMALL, BLOCK = 24, 1024
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes], k: int = 4) -> np.ndarray:
    """Unsigned fingerprints of UTF-8 texts."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        n = len(words)
        if n > k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            starts = [0, *ends[: n - k].tolist()]
            hashes += [digest(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]
            counts.append(n - k + 1)
        elif n:
            hashes.append(digest(b" ".join(words), 42))
            counts.append(1)
        else:
            counts.append(0)
    h, counts = np.array(hashes, np.uint64), np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # counts of set bits, eight to a word: a lane holds up to 255, so sums are taken over runs of 255 hashes at most
    first = np.cumsum(counts) - counts
    runs = np.concatenate([np.arange(first[i], first[i] + counts[i], 255) for i in full])
    of_run = np.searchsorted(runs, first[full])
    need = counts[full, None]
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, runs).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes, of_run, axis=0, dtype=np.int64)  # [text, byte]: how many have bit 8*byte + j
        ones = (2 * sums > need).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))
        out[full] |= np.bitwise_or.reduce(ones, axis=1)
    return out


def fingerprints(docs: DataFrame, k: int = 4, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and fp of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(fingerprints_of(byte_texts(batch), k).view(np.int64))], [*carry, "fp"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in (*carry, "fp")))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments for links up to `distance`."""
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(nodes: DataFrame, distance: int) -> DataFrame:
    """(key, fp): each fingerprint under its 64 one-wildcard segment variants."""
    keys = []
    for first, bits in segments(distance):
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))
        for i in range(bits):
            rest = part.bitwiseAND(F.lit(~(1 << i) if i < 63 else 2**63 - 1).cast("long"))
            keys.append(rest.bitwiseOR(F.lit((first + i) << 56).cast("long")) if bits <= 56 else F.xxhash64(F.lit(first + i), rest))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


class Forest:
    """Links that connect what the links within `distance` among distinct fingerprints connect; compared counts pairs looked at."""

    def __init__(self, fp: np.ndarray, distance: int) -> None:
        self.fp, self.distance, self.compared = fp, distance, 0
        self.parent = np.arange(len(fp))
        self.links: list[tuple[int, int]] = []
        self.split(np.arange(len(fp)))

    def split(self, rows: np.ndarray) -> None:
        if len(rows) <= BLOCK:
            return self.block(rows)
        fp = self.fp[rows]
        varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
        bits = [b for b in range(64) if varying >> b & 1]
        parts = self.distance + 1
        for j in range(parts):
            if j and self.one_tree(rows):
                return
            # at least log2(BLOCK) bits vary, so a part has some unless the distance is that large
            own = np.uint64(sum(1 << b for b in bits[len(bits) * j // parts : len(bits) * (j + 1) // parts]))
            if not own:
                return self.block(rows)
            part = fp & own
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            first, last = np.concatenate([[0], edges]), np.append(edges, len(rows))
            small = (last - first <= SMALL) & (last - first > 1)
            self.runs(rows[order], first[small], last[small])
            for a, b in zip(first[last - first > SMALL], last[last - first > SMALL]):
                self.split(rows[order[a:b]])

    def one_tree(self, rows: np.ndarray) -> bool:
        up = self.parent[rows]
        while ((root := self.parent[up]) != up).any():
            up = root
        self.parent[rows] = up
        return bool((up == up[0]).all())

    def runs(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """All pairs inside many short runs at once."""
        if not len(first):
            return
        size = last - first
        of = np.repeat(np.arange(len(first)), size)
        own = rows[np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        for lag in range(1, int(size.max())):
            i = np.flatnonzero(of[lag:] == of[:-lag])
            self.compared += len(i)
            i = i[np.bitwise_count(self.fp[own[i]] ^ self.fp[own[i + lag]]) <= self.distance]
            self.join(own[i], own[i + lag])

    def block(self, rows: np.ndarray) -> None:
        """Rows that aren't one tree yet, each with all others, a stretch of them at a time."""
        if self.one_tree(rows):
            return
        fp = self.fp[rows]
        for a in range(0, len(rows), BLOCK):
            x, y = np.nonzero(np.bitwise_count(fp[a : a + BLOCK, None] ^ fp[None, :]) <= self.distance)
            self.compared += len(fp[a : a + BLOCK]) * len(fp)
            own = rows[x + a] != rows[y]
            x, y = rows[x[own] + a], rows[y[own]]
            while len(x):  # join the first open link of each row, then drop what that has connected
                _, i = np.unique(x, return_index=True)
                self.join(x[i], y[i])
                self.one_tree(rows)
                still = self.parent[x] != self.parent[y]
                x, y = x[still], y[still]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = _root(self.parent, i), _root(self.parent, j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((i, j))


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the links of a Forest."""
    links = np.array(Forest(fp, distance).links, np.int64).reshape(-1, 2)
    return fp[links[:, 0]], fp[links[:, 1]]


def bucket_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(a, b) links between fingerprints from (key, fp) rows in key order; a bucket may span batches."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        left, right = [], []
        run = np.repeat(size, size)
        for lag in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & (run[lag:] <= SMALL))
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance]
            left.append(fp[i])
            right.append(fp[i + lag])
        for a, n in zip(first[size > SMALL], size[size > SMALL]):
            x, y = _forest(fp[a : a + n], distance)
            left.append(x)
            right.append(y)
        if not left or not sum(map(len, left)):
            return None
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        new = [batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
        rows = [np.concatenate(x) for x in zip(rest, new)]
        key = rows[0]
        whole = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
        rest = [x[whole:] for x in rows]
        if whole and (out := links(*(x[:whole] for x in rows))):
            yield out
    if len(rest[0]) and (out := links(*rest)):
        yield out


def components(prints: DataFrame, distance: int = 4) -> DataFrame:
    """prints(doc_id, fp, ...) with component_id, the least doc_id of those linked, directly or not."""
    return prints.join(named(prints, distance).select("fp", "component_id"), "fp").select(*prints.columns, "component_id")


def named(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component, component_id) of each fingerprint of prints(doc_id, fp)."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    ordered = variants(nodes, distance).repartition("key").sortWithinPartitions("key")
    links = ordered.mapInArrow(lambda batches: bucket_links(batches, distance), "a long, b long")
    found = cut(nodes.join(connected_components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    least = cut(found.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")  # written first, so that Spark can split a hot component
    return found.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, k: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs."""
    prints = cut(fingerprints(plain_docs(docs, id_col, text_col), k), "fingerprints")
    found = components(prints, distance)
    return found.select(real_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id("component_id"))


def keep_first(docs: DataFrame, k: int = 4, distance: int = 4) -> DataFrame:
    """One row of docs(doc_id, text, ...) of each component, with all its columns: that with the least doc_id, and of several with that id
    the one with the least hash of id and text. Rows without an id come after all others. Of rows with equal id and text one stays."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    keyed = plain_docs(docs).withColumn("__row", F.xxhash64(real_id(), "text"))
    prints = cut(fingerprints(keyed, k, ("doc_id", "__row")), "fingerprints")
    rows = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    firsts = named(prints, distance).join(rows, "fp").groupBy("component").agg(F.min("first").alias("first"))
    same = prints.groupBy("__row").agg(F.count(F.lit(1)).alias("__n"))
    picked = cut(firsts.select("first.__row").distinct().join(same, "__row"), "firsts")
    keyed = docs.withColumn("__row", key)
    alone = keyed.join(picked.where("__n = 1"), "__row", "left_semi")
    again = keyed.join(picked.where("__n > 1"), "__row", "left_semi").dropDuplicates(["__row"])
    return alone.union(again).drop("__row")


def brute_force(rows: list[tuple[int | None, str | None]], k: int = 4, distance: int = 4) -> list[tuple]:
    """The same result from the definition, for small tables."""
    import re

    prints = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[s : s + k]) for s in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        prints.append((2**63 - 1 if i is None else i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    label = [i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for x, (_, a) in enumerate(prints):
            for y, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= distance and label[y] < label[x]:
                    label[x], changed = label[y], True
    return [(i, f"{fp:016x}", None if c == 2**63 - 1 else c) for (i, _), (_, fp), c in zip(rows, prints, label)]
