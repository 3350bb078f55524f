"""Token-id files: whole texts as ids, in blocks of the adaptive context-mixing range coder.

Documents are ordered by doc_id over all partitions; each partition writes one sequence of independent blocks (rangecoder.py)
of whole documents, a new block once BLOCK_IDS ids are in. A block's row tells its partition, its place and how many ids of the partition stand
before it, so reading needs only the partitions' totals to know where in the corpus a document begins. Blocks are stored as binary
values of uncompressed Parquet files, which any store that Spark knows can hold.

Nulls: a null text is empty (its ids are the end id alone); rows with a null doc_id come last and are null when read. Rows that share
a doc_id stand in the order of their texts. An empty table gives no blocks. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, plain_docs, real_id, row_slices
from .rangecoder import decode_block, encode_block
from .tokens import encoder

BLOCK_IDS = 1 << 21
SLICE = 8 << 20  # bytes of text that are encoded at once
BLOCKS = "part int, block int, before long, n_docs long, n_ids long, data binary"


def block_writer(end_id: int, tokenizer: str):
    """Iterator function from batches of (doc_id, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], code.dtype).tobytes()
        held_ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            width = code.dtype.itemsize
            lens = np.array([len(x) // width for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), code.dtype).astype(np.int64)
            data = encode_block(np.array(held_ids, np.int64), lens, ids)
            row = [pa.array([v], t) for v, t in ((part, pa.int32()), (block, pa.int32()), (before, pa.int64()), (len(lens), pa.int64()), (len(ids), pa.int64()), (data, pa.binary()))]
            return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in row_slices(batches, limit=SLICE):
            for i, ids in zip(batch.column("doc_id").to_pylist(), code.texts(batch.column("text").to_pylist())):
                held_ids.append(i)
                held.append(ids + end)
                size += len(held[-1]) // code.dtype.itemsize
                if size >= BLOCK_IDS:
                    yield out()
                    held_ids, held, block, before, size = [], [], block + 1, before + size, 0
        if held:
            yield out()

    return run


def encode_blocks(docs: DataFrame, end_id: int = 2, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of docs' texts, in ascending doc_id order."""
    ordered = plain_docs(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(block_writer(end_id, tokenizer), BLOCKS)


def write_token_files(docs: DataFrame, path: str, **options) -> None:
    """Write the blocks to `path`."""
    encode_blocks(docs, **options).write.option("compression", "none").parquet(path)


def part_starts(blocks: DataFrame) -> DataFrame:
    """(part, start): ids in all earlier partitions; as many rows as partitions wrote."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) as the blocks have them."""
    return _read(blocks, lambda ids: pa.array(ids.tolist(), pa.list_(pa.int32())), "ids", "array<int>")


def read_digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as the blocks have them."""
    return _read(blocks, lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32", "bigint")


class _Lists(list):
    def tolist(self) -> list:
        return [x.tolist() for x in self]


def _read(blocks: DataFrame, column, name: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "data"))):
                doc_ids, lens, ids = decode_block(data)
                ends = np.cumsum(lens)
                each = _Lists(ids[a:b] for a, b in zip(ends - lens, ends))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lens), part, np.int32)), pa.array(doc_ids), pa.array(before + ends - lens), pa.array(lens), column(each)], ["part", "doc_id", "at", "n_tokens", name])

    rows = blocks.select("part", "before", "data").mapInArrow(run, f"part int, doc_id long, at long, n_tokens long, {name} {kind}")
    # one small row for each partition that wrote, so its size follows the number of files, not of documents
    return rows.join(F.broadcast(part_starts(blocks)), "part").select(real_id(), (F.col("start") + F.col("at")).alias("start"), "n_tokens", name)


def token_file_digest(docs: DataFrame) -> DataFrame:
    """The query's form: encode, write, read the files back."""
    blocks = encode_blocks(docs)
    spark = docs.sparkSession
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "none")
    try:
        written = cut(blocks, "token-files")
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", codec)
    return read_digests(written)
