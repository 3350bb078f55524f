"""Helpers that the corpus operators share: words, hashes, plain rows.

Words everywhere are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``
(``bytes.split()`` splits on exactly these six), taken from the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut  # noqa: F401

SLICE_BYTES = 4 << 20
NO_ID = 2**63 - 1  # stands for a null id: greater than every other


def row_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, dealt so that no slice of several rows has over `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def byte_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of each row's text; null is empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when it holds too many."""

    limit = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, 7)
        return h

    def of(self, lists: list[list[bytes]], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of runs of words from prefix sums: sum of h[i+j] * base**j modulo 2**64, then mixed."""

    def __init__(self, base: int) -> None:
        self.base = np.uint64(base | 1)
        self.inverse = np.uint64(pow(base | 1, -1, 2**64))
        self.power, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def prepare(self, h: np.ndarray) -> np.ndarray:
        if len(h) >= len(self.power):
            n = max(len(h) + 1, 2 * len(self.power))
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.inverse)]), dtype=np.uint64)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.power[: len(h)], out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return mix((sums[at + length] - sums[at]) * self.back[at])


def positions(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of texts laid end to end: each word's index in its own text, and how many words are left from it on."""
    first = np.repeat(np.cumsum(lens) - lens, lens)
    local = np.arange(int(lens.sum()), dtype=np.int64) - first
    return local, np.repeat(lens, lens) - local


def plain_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): null texts become empty, null ids NO_ID; other columns, whatever their names, are left behind."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def real_id(name: str = "doc_id"):
    """The id column with NO_ID as null again."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
