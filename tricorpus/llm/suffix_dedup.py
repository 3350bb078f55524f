"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where the hash of the next GRAM words is the least of some GAP consecutive ones (minimisers), about
2 / (GAP + 1) of all positions. The choice depends on those words alone: the place of the least hash among the first GAP of a window of
`min_words` words is the same in every text that has the window, and the suffix there shares at least `min_words` - GAP + 1 words to the right,
its prefix. Steps:

1. sampled suffixes, each with its prefix as a 64-bit code, written once;
2. the sparse suffix array: suffixes are dealt by range of (prefix, text, place) and sorted, so one frequent passage spreads over many partitions, and each
   is compared with its neighbours: where neighbours of different texts share the prefix, the suffixes match. What stands at the edges of a
   partition is decided from two rows a partition, the least and greatest text of the edge's prefix;
3. extension: each matching suffix is extended to the left and to the right, up to the windows of `min_words` words in which it is the
   sampled one; these are compared in 128 bits, and those with one doc_id only are dropped (shared_windows.py);
4. windows that touch are joined.

Result of repeated_passages, one row a passage: doc_id, start_word, end_word (exclusive), first_doc_id, cuts. The passages of a document are
exactly the runs of words that lie in windows of `min_words` words which another doc_id has too. first_doc_id is the least doc_id that has a
window of the passage (the document itself, if no smaller one does). cuts are the runs of words in windows that a smaller doc_id has:
what dedup may drop.

Nulls: a null text has no words; a null doc_id counts as greater than any other, several of them as one, and comes back as null. Texts of under
`min_words` words have no passages. Equal rows have one set of passages; rows with one doc_id and different texts have one each, and don't
match each other. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared_windows
from .common import NO_ID, RollingHash, byte_texts, cut, real_id, row_slices

GRAM, GAP = 8, 16
SPAN = pa.struct([("a", pa.int32()), ("b", pa.int32())])
PASSAGES = "doc_id long, start_word int, end_word int, first_doc_id long, cuts array<struct<a:int,b:int>>"
MATCHES = "prefix long, text_key long, pos int, edge boolean"


def _windowed(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + n], for each i, in log n steps."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def minimisers(sums: np.ndarray, left: np.ndarray, rolling: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: the hash of the GRAM words from each word on, and the least of the GAP such hashes from each on."""
    grams = np.full(len(left) + GAP - 1, np.uint64(2**64 - 1))
    at = np.flatnonzero(left >= GRAM)
    grams[at] = rolling.runs(sums, at, GRAM)
    return grams[: len(left)], _windowed(grams, GAP, np.minimum)


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """The sampled suffixes of keyed docs, as shared_windows.scan gives them."""
    length = min_words - GAP + 1

    def places(h, sums, lens, local, left, rolling):
        grams, least = minimisers(sums, left, rolling)
        most = _windowed(np.concatenate([np.zeros(GAP - 1, np.uint64), least]), GAP, np.maximum)  # of the windows that hold a place
        at = np.flatnonzero((grams == most) & (left >= length) & (np.repeat(lens, lens) >= min_words))
        return at, rolling.runs(sums, at, length)

    return shared_windows.scan(docs, places)


def matching(found: DataFrame) -> DataFrame:
    """(text_key, pos) of the suffixes found(code, text_key, pos) whose prefix a suffix of another text has; some may be there twice."""
    keys = ["prefix", "text_key", "pos"]
    ordered = found.select(F.col("code").alias("prefix"), "text_key", "pos").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes that match a neighbour. Rows of the partition's first and last prefix that don't come too, with edge set; if they do, two stand for them."""
        names = [c.split()[0] for c in MATCHES.split(", ")]
        out = lambda p, t, x, edge: pa.RecordBatch.from_arrays([pa.array(p), pa.array(t), pa.array(x), pa.array(np.broadcast_to(edge, len(p)))], names)
        first = None  # the partition's first prefix
        matched = False  # the last prefix so far has two texts already
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]  # rows of the last prefix, all of one text so far
        ends: list[tuple] = []  # first and last row of the last prefix
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in keys]
            if not batch.num_rows:
                continue
            prefix, text, pos = (np.concatenate(x) for x in zip(held, new))
            if first is None:
                first = prefix[0]
            start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            stop = np.append(start[1:], len(prefix))
            several = text[start] != text[stop - 1]
            if ends and ends[0][0] == prefix[0]:
                several[0] |= matched or ends[0][1] != text[0]
            else:
                ends = []
            edge = (prefix[start] == first) & ~several
            keep = several | edge
            keep[-1] = several[-1]
            if (rows := np.flatnonzero(np.repeat(keep, stop - start))).size:
                yield out(prefix[rows], text[rows], pos[rows], np.repeat(edge, stop - start)[rows])
            if several[0] and prefix[0] == first:
                yield out(*(x[[0, stop[0] - 1]] for x in (prefix, text, pos)), True)
            matched = bool(several[-1])
            a = start[-1]
            begin = ends[0] if ends and len(start) == 1 else (prefix[a], text[a], pos[a])
            ends = [begin, (prefix[-1], text[-1], pos[-1])]
            fresh = np.concatenate([[True], pos[a + 1 :] != pos[a:-1]])  # equal rows are copies of one text
            held = [x[:0] if matched else x[a:][fresh] for x in (prefix, text, pos)]
        if len(held[0]):
            yield out(*held, True)
        if ends and matched:
            yield out(*(np.array([e[i] for e in ends], held[i].dtype) for i in range(3)), True)

    rows = cut(ordered.mapInArrow(compare, MATCHES), "matches")
    # two prefixes a partition at most, so their size follows the number of partitions, not of suffixes
    edges = rows.where("edge").groupBy("prefix").agg((F.min("text_key") < F.max("text_key")).alias("several")).where("several").select("prefix")
    return rows.where("not edge").select("text_key", "pos").union(rows.where("edge").join(F.broadcast(edges), "prefix").select("text_key", "pos"))


def repeated_windows(docs: DataFrame, texts: DataFrame, at: DataFrame, min_words: int) -> DataFrame:
    """shared_windows.windows of the suffixes at(text_key, pos), extended to both sides."""

    def starts(sums, offsets, lens, rows, pos, rolling):
        left = np.repeat(offsets + lens, lens) - np.arange(int(lens.sum()))
        grams, least = minimisers(sums, left, rolling)
        chosen = np.zeros(len(left), bool)
        at, room = offsets[rows] + pos, np.minimum(pos, GAP - 1)
        for k in range(GAP):  # windows that begin k words before the suffix
            s = at[room >= k] - k
            chosen[s[(left[s] >= min_words) & (least[s] == grams[s + k])]] = True
        return np.flatnonzero(chosen)

    return shared_windows.windows(docs, texts, at, min_words, starts)


def _keyed_passages(docs: DataFrame, min_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PASSAGES of docs with the text_key of each document; null ids are NO_ID."""
    if min_words < GRAM + GAP:
        raise ValueError(f"min_words must be at least {GRAM + GAP}")
    docs = shared_windows.keyed(docs, id_col, text_col)
    found = cut(suffixes(docs, min_words), "suffixes")
    rows = shared_windows.document_rows(found)
    texts = shared_windows.distinct_texts(rows)
    windows = repeated_windows(docs, texts, matching(found.where("doc_id is null")), min_words)
    marks = shared_windows.shared(windows).groupBy("text_key", "doc_id").agg(F.collect_set(F.struct("start", "first")).alias("marks"))
    whole = F.when((F.col("doc_id") < F.col("last")) & (F.col("n_words") >= min_words), F.col("n_words"))  # its copies have all of it
    firsts = texts.select("text_key", "check", "doc_id", whole.alias("whole")).join(marks, ["text_key", "doc_id"], "left").where("marks is not null or whole is not null")
    passages = cut(_passages(firsts, min_words), "passages")
    least = passages.where("whole").select("text_key", "check", "first_doc_id")
    late = shared_windows.copies(rows, texts).drop("first_doc_id").where(F.col("n_words") >= min_words).join(least, ["text_key", "check"])
    cuts = F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").alias("b")))
    late = late.select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), "first_doc_id", cuts.alias("cuts"), "text_key")
    return passages.select(*late.columns).union(late)


def repeated_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PASSAGES of docs."""
    return _keyed_passages(docs, min_words, id_col, text_col).drop("text_key").withColumns({c: real_id(c) for c in ("doc_id", "first_doc_id")})


def _passages(rows: DataFrame, min_words: int) -> DataFrame:
    """PASSAGES with text_key, check and whole from rows(text_key, check, doc_id, whole, marks): windows' starts with the least doc_id of each;
    whole: the number of words where all of the text is one passage."""

    def runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of windows that touch begin and end among the sorted starts."""
        new = np.flatnonzero(np.concatenate([[True], start[1:] > start[:-1] + min_words])) if len(start) else np.zeros(0, np.int64)
        return new, np.append(new[1:], len(start))[: len(new)]

    def spans(start: np.ndarray) -> list[dict]:
        return [{"a": int(start[i]), "b": int(start[j - 1]) + min_words} for i, j in zip(*runs(start))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            marks = batch.column("marks")
            for key, check, doc, whole, m in zip(*(batch.column(c).to_pylist() for c in ("text_key", "check", "doc_id", "whole")), marks):
                start, first = (np.zeros(0, np.int64),) * 2
                if m.is_valid:
                    start, first = (m.values.field(i).to_numpy() for i in range(2))
                    order = np.argsort(start, kind="stable")
                    start, first = start[order], first[order]
                cuts = start[first < doc]
                if whole is not None:
                    out.append((doc, 0, whole, min(doc, int(first.min(initial=NO_ID))), spans(cuts), key, check, True))
                    continue
                for i, j in zip(*runs(start)):
                    a, b = int(start[i]), int(start[j - 1]) + min_words
                    out.append((doc, a, b, int(first[i:j].min()), spans(cuts[(cuts >= a) & (cuts < b)]), key, check, False))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(SPAN), pa.int64(), pa.int64(), pa.bool_()]
            names = [*(c.split()[0] for c in PASSAGES.split(", ")), "text_key", "check", "whole"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return rows.mapInArrow(run, f"{PASSAGES}, text_key long, check long, whole boolean")


def drop_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs(doc_id, text) with the words of all cuts dropped; texts without cuts are as they were."""
    cuts = _keyed_passages(docs, min_words).where("size(cuts) > 0").groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    keys = {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__key": F.xxhash64(F.coalesce("text", F.lit("")))}
    cuts = cuts.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    joined = docs.select("doc_id", "text").withColumns(keys).join(cuts, list(keys), "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            texts = []
            for text, cuts in zip(byte_texts(batch), batch.column("cuts").to_pylist()):
                if cuts:
                    words = text.split()
                    gone = {i for c in cuts for i in range(c["a"], c["b"])}
                    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return joined.mapInArrow(run, "doc_id long, text string")


def brute_force(rows: list[tuple[int | None, str | None]], min_words: int = 50) -> set[tuple]:
    """The same result from the definition, for small tables: (doc_id, start_word, end_word, first_doc_id, cuts)."""
    texts = {(NO_ID if i is None else i, tuple((t or "").encode().split())) for i, t in rows}
    having: dict[tuple, set[int]] = {}
    for i, w in texts:
        for s in range(len(w) - min_words + 1):
            having.setdefault(w[s : s + min_words], set()).add(i)

    def spans(starts: list[int]) -> list[tuple[int, int]]:
        covered = sorted({s + k for s in starts for k in range(min_words)})
        edges = [k for k, x in enumerate(covered) if not k or covered[k - 1] != x - 1]
        return [(covered[a], covered[b - 1] + 1) for a, b in zip(edges, [*edges[1:], len(covered)])]

    out = set()
    for i, w in texts:
        first = {s: min(d) for s in range(len(w) - min_words + 1) if len(d := having[w[s : s + min_words]]) > 1}
        cuts = spans([s for s, d in first.items() if d < i])
        for a, b in spans(list(first)):
            least = min(d for s, d in first.items() if a <= s < b)
            out.add((None if i == NO_ID else i, a, b, None if least == NO_ID else least, tuple(c for c in cuts if a <= c[0] < b)))
    return out
