"""Substring dedup with difference-cover anchors.

A difference cover D modulo v holds, for every d, two members that differ by d. So for any two positions i, j
there is a shift s < v that puts both i+s and j+s on D. Hash windows of m words only where the position modulo v
lies in D: if two texts share `window` >= m + v - 1 words, one anchor window lies inside the shared run at the
same place in both, whatever the two offsets are. Steps:

1. anchors: codes of the windows at cover positions, about |D| / v of the words, written once;
2. anchors whose code two different texts have (partial aggregates, then a join that splits hot codes);
3. extension: in the documents concerned, every `window`-word window around such an anchor is hashed (128 bits)
   and the least doc_id that has it found (shared_windows.py);
4. the words of windows that a smaller doc_id has are dropped.

Whole-text copies take no part in step 3: all windows of a copy are those of the first copy.

Nulls: a null text has no words; a null doc_id counts as greater than any other, several of them as one, and comes back as null. Texts under
`window` words lose nothing. Rows that share a doc_id are judged on their own, against smaller doc_ids only. An empty
table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared_windows
from .common import byte_texts, cut, real_id, row_slices

#: Perfect difference sets, by modulus.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Modulus, cover and anchor length for matches of `window` words: the widest cover that leaves anchors of two fifths."""
    v = max(v for v in COVERS if v == 1 or window - v + 1 >= max(2, 2 * window // 5))
    return v, COVERS[v], window - v + 1


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """The anchors of keyed docs, as shared_windows.scan gives them."""
    v, cover, m = cover_for(window)
    on = np.zeros(v, bool)
    on[list(cover)] = True

    def places(h, sums, lens, local, left, rolling):
        at = np.flatnonzero((left >= m) & on[local % v] & (np.repeat(lens, lens) >= window))
        return at, rolling.runs(sums, at, m)

    return shared_windows.scan(docs, places)


def matching(found: DataFrame) -> DataFrame:
    """(text_key, pos) of the anchors found(code, text_key, pos) that several texts have."""
    several = found.groupBy("code").agg(F.min("text_key").alias("one"), F.max("text_key").alias("last")).where("one < last").select("code")
    return found.join(cut(several, "shared-anchors"), "code").select("text_key", "pos")  # written first, so that Spark can split a hot code


def anchored_windows(docs: DataFrame, texts: DataFrame, at: DataFrame, window: int) -> DataFrame:
    """shared_windows.windows that hold one of the anchors at(text_key, pos)."""
    m = cover_for(window)[2]

    def starts(sums, offsets, lens, rows, pos, rolling):
        near = np.zeros(int(lens.sum()) + 1, np.int32)  # marks where runs of window starts begin and end
        lo, hi = np.maximum(pos - (window - m), 0), np.minimum(pos, lens[rows] - window)
        np.add.at(near, offsets[rows] + lo, 1)
        np.subtract.at(near, offsets[rows] + hi + 1, 1)
        return np.flatnonzero(np.cumsum(near[:-1]) > 0)

    return shared_windows.windows(docs, texts, at, window, starts)


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without the words of windows that a smaller doc_id has."""
    docs = shared_windows.keyed(docs, id_col, text_col)
    found = cut(anchors(docs, window), "anchors")
    rows = shared_windows.document_rows(found)
    texts = shared_windows.distinct_texts(rows)
    windows = anchored_windows(docs, texts, matching(found.where("doc_id is null")), window)
    late = shared_windows.shared(windows).where("first < doc_id").groupBy("text_key", "doc_id").agg(F.collect_set("start").alias("starts"))
    copies = shared_windows.copies(rows, texts).select("text_key", "doc_id", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    marks = cut(late.withColumn("copy", F.lit(False)).union(copies), "marks")
    joined = docs.join(marks, ["text_key", "doc_id"], "left").select("doc_id", "text", "starts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            n, gone, kept = [], [], []
            for text, starts, copy in zip(byte_texts(batch), batch.column("starts"), batch.column("copy").to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if copy and len(words) >= window:
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    s = starts.values.to_numpy()
                    edge[s] += 1
                    np.subtract.at(edge, s + window, 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) <= 0)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string").withColumn("doc_id", real_id())


def substring_digest(docs: DataFrame) -> DataFrame:
    """The query's form: the kept text as its SHA-256."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple]:
    """The same result from the definition, for small tables."""
    texts = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(i, first.get(k, i))
    out = []
    for (i, w), (real, _) in zip(texts, rows, strict=True):
        gone = {s + j for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for j in range(window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((real, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


#: DuckDB SQL for substring_digest(documents).
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, s, array_to_string(w[s : s + 49], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 48)) s from d where len(w) >= 50)),
late as (select doc_id, s from (select doc_id, s, min(doc_id) over (partition by k) f from win) where f < doc_id),
wd as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from d),
flags as (select wd.doc_id, p, x, coalesce(max(late.s) over (partition by wd.doc_id order by p rows between 49 preceding and current row), -1) >= 1 gone
  from wd left join late on late.doc_id = wd.doc_id and late.s = wd.p),
kept as (select doc_id, sum(gone::int) n_removed, string_agg(case when not gone then x end, ' ' order by p) kept from flags group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join kept using (doc_id)
"""
