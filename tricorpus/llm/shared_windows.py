"""Windows of words that several documents have, found from places where they may be: what both substring operators share.

1. `scan` reads every text once: a row for each candidate place (a code of the words there, the text's key, the place), and one for each
   document (its id, its number of words, a second hash of its text);
2. the operator finds the candidate places whose codes several texts have, each in its own way;
3. `windows` hashes (128 bits) the windows around these places, in one document of each group of whole-text copies;
4. `shared` joins them with the least doc_id that has each window, for windows with several doc_ids.

Everything is keyed by the text, not by the id: rows with a null id or with one id and many texts are rows of their own, and no list grows
beyond what one text holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, WordHashes, byte_texts, cut, mix, plain_docs, positions, row_slices

BASE, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SLICE = 2 << 20
FOUND = "code long, text_key long, pos int, doc_id long"
WINDOWS = "w1 long, w2 long, doc_id long, last long, text_key long, start int"
#: (words' hashes, their prefix sums, words of each text, a word's index in its text, words left from it on) to candidate places and their codes.
Places = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, RollingHash], tuple[np.ndarray, np.ndarray]]
#: (prefix sums, first word and number of words of each text, text and place of each shared candidate) to starts of windows, all by place in the batch.
Starts = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, RollingHash], np.ndarray]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, text_key) without nulls."""
    return plain_docs(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def scan(docs: DataFrame, places: Places) -> DataFrame:
    """FOUND of keyed docs; doc_id is null but in the documents' own rows, whose pos is the number of words and whose code is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), RollingHash(BASE)
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in row_slices(batches, limit=SLICE):
            texts = byte_texts(batch)
            lists = [x.split() for x in texts]
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            check = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(check), batch.column("text_key"), pa.array(lens.astype(np.int32)), batch.column("doc_id")], names)
            local, left = positions(lens)
            if not len(local):
                continue
            h = hashes.of(lists, len(local))
            sums = rolling.prepare(h)
            at, codes = places(h, sums, lens, local, left, rolling)
            if len(at):
                keys = np.repeat(batch.column("text_key").to_numpy(), lens)[at]
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(keys), pa.array(local[at].astype(np.int32)), pa.nulls(len(at), pa.int64())], names)

    return docs.mapInArrow(run, FOUND)


def document_rows(found: DataFrame) -> DataFrame:
    """(text_key, check, doc_id, n_words), one row for each id and text."""
    return found.where("doc_id is not null").groupBy("text_key", F.col("code").alias("check"), "doc_id").agg(F.max("pos").alias("n_words"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text_key, check, doc_id, last, n_words): the least and the greatest id that has each text; written."""
    return cut(rows.groupBy("text_key", "check").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.max("n_words").alias("n_words")), "texts")


def copies(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_key, check, doc_id, n_words, first_doc_id) of the documents whose whole text a smaller doc_id has too."""
    firsts = texts.where("doc_id < last").select("text_key", "check", F.col("doc_id").alias("first_doc_id"))
    return rows.join(firsts, ["text_key", "check"]).where("doc_id > first_doc_id")


def windows(docs: DataFrame, texts: DataFrame, at: DataFrame, window: int, starts: Starts) -> DataFrame:
    """WINDOWS around the places at(text_key, pos) of keyed docs, in the least document that has each text; written."""
    lists = at.groupBy("text_key").agg(F.collect_set("pos").alias("at"))
    lists = cut(lists.join(texts.select("text_key", "doc_id", "last"), "text_key"), "places")
    joined = docs.join(lists, ["text_key", "doc_id"]).select("doc_id", "last", "text_key", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, one, two = WordHashes(), RollingHash(BASE), RollingHash(BASE_2)
        for batch in row_slices(batches, limit=SLICE):
            lists = [x.split() for x in byte_texts(batch)]
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            offsets, n = np.cumsum(lens) - lens, int(lens.sum())
            at = batch.column("at")
            rows = np.repeat(np.arange(len(lists)), np.diff(at.offsets.to_numpy()))
            pos = at.flatten().to_numpy().astype(np.int64)
            inside = (lens[rows] >= window) & (pos < lens[rows])
            h = hashes.of(lists, n)
            sums = one.prepare(h)
            start = starts(sums, offsets, lens, rows[inside], pos[inside], one)
            if not len(start):
                continue
            w1 = one.runs(sums, start, window)
            w2 = two.runs(two.prepare(mix(h)), start, window)
            rows = np.repeat(np.arange(len(lists)), lens)[start]
            ids = [batch.column(c).to_numpy()[rows] for c in ("doc_id", "last", "text_key")]
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), *map(pa.array, ids), pa.array((start - offsets[rows]).astype(np.int32))], [c.split()[0] for c in WINDOWS.split(", ")])

    return cut(joined.mapInArrow(run, WINDOWS), "windows")


def shared(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, first) of the windows that several doc_ids have; first is the least of these.

    The windows' keys are written before they are joined: a join beside its own aggregate would share its partitions, which Spark then can't split when a key is hot."""
    firsts = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("last").alias("last")).where("first < last").drop("last")
    return found.join(cut(firsts, "first-windows"), ["w1", "w2"]).select("doc_id", "text_key", "start", "first")
