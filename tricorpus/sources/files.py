"""Readers of papers, texts, metadata and triplets, and writers of what stages make.

Nothing is ever deleted from the inputs: where a stage would drop files, the operators give the set of them.
"""

from __future__ import annotations

import ast
import re
import uuid
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

#: id, then v and a version of any number of digits.
FILE_NAME = r"^(.*)v([0-9]+)[.]pdf$"
#: Folders of write_texts, and the name of a paper that has none.
FOLDERS, NO_NAME = 256, "__HIVE_DEFAULT_PARTITION__"


def file_id(name: Column | str) -> Column:
    return F.regexp_extract(T.col(name), FILE_NAME, 1)


def file_version(name: Column | str) -> Column:
    return F.regexp_extract(T.col(name), FILE_NAME, 2).try_cast("int")  # null for names of another form


def papers(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(name, id, version, path, content) of all files below path; content is read only if it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("name"), file_id(name).alias("id"), file_version(name).alias("version"), "path", "content")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; the id is always text, so that 0704.0010 keeps its zero."""
    return spark.read.schema(schemas.METADATA).json(path)


def texts(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = "*.txt") -> DataFrame:
    """(paper, text) of text files; papers of one name in different folders stay apart by `path`."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("paper"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def categories_of(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("cs", "quant")) -> DataFrame:
    """(paper, category) from two sets of files (name); a name in both is of the second."""
    both = first.select("name", F.lit(0).alias("k")).union(second.select("name", F.lit(1).alias("k")))
    best = both.groupBy(F.concat(T.stem("name", ".pdf"), F.lit(".txt")).alias("paper")).agg(F.max("k").alias("k"))
    return best.select("paper", F.when(F.col("k") == 1, names[1]).otherwise(names[0]).alias("category"))


def triplet_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRIPLET_LISTS).parquet(path)


def triplet_csv(spark: SparkSession, path: str) -> DataFrame:
    """TRIPLET_LISTS from a CSV file whose triplets column holds lists of tuples as text; they are read as literals, never run."""

    @F.pandas_udf("array<struct<subject:string,verb:string,object:string>>")
    def parse(values: pd.Series) -> pd.Series:
        one = lambda v: [dict(zip(("subject", "verb", "object"), map(str, t))) for t in ast.literal_eval(v)]
        return pd.Series([None if v is None else one(v) for v in values], dtype=object)

    raw = spark.read.schema("paper string, triplets string").options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return raw.select("paper", parse("triplets").alias("triplets"))


def write_triplet_csv(lists: DataFrame, path: str) -> None:
    """The form that triplet_csv reads."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return pd.Series([repr([(t["subject"], t["verb"], t["object"]) for t in (() if v is None else v)]) for v in values])

    lists.select("paper", form("triplets").alias("triplets")).write.options(header=True, quote='"', escape='"').csv(path)


def write_lines(rows: DataFrame, path: str, papers: DataFrame | None = None) -> None:
    """One row of text a paper from (paper, pos, sentence), lines in order; papers without lines are kept, empty, if `papers` is given."""
    lines = rows.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), "\n").alias("text"))
    if papers is not None:
        lines = papers.select("paper").distinct().join(lines, "paper", "left").select("paper", F.coalesce("text", F.lit("")).alias("text"))
    lines.write.parquet(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """A folder with one plain-text file for each paper of texts(paper, text), as read_texts finds them; for corpora of many papers prefer the Parquet of
    write_lines. Texts of one paper are one below the other.

    Files lie in FOLDERS folders and are written from the tasks, as Spark's writer makes a folder for each. Where pyarrow doesn't know the file system, Spark writes."""
    rows = texts.groupBy("paper").agg(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n").alias("text"))
    context = texts.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    uri = re.sub("^file:/+", "file:///", system.makeQualified(where).toString())
    if system.exists(where):
        raise FileExistsError(path)
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError):
        rows.write.partitionBy("paper").text(path)
        return

    def write(batches):
        store, top = fs.FileSystem.from_uri(uri)
        made = set()
        for batch in batches:
            for folder, paper, text in zip(*(batch.column(c).to_pylist() for c in ("folder", "paper", "text")), strict=True):
                if folder not in made:
                    store.create_dir(f"{top}/{folder}")
                    made.add(folder)
                name = f"{top}/{folder}/paper={NO_NAME if paper is None else quote(str(paper), safe='')}"
                with store.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as out:
                    out.write(text.encode() + b"\n")
                store.move(own, name)  # whole, whichever attempt of a task is the last
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    system.mkdirs(where)
    folder = F.format_string("%03d", F.pmod(F.xxhash64("paper"), F.lit(FOLDERS)))
    dealt = rows.select(folder.alias("folder"), F.col("paper").cast("string").alias("paper"), "text")
    dealt.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(paper, text) of write_texts; the line end that the writer puts at a text's end is taken off."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.url_decode(F.regexp_extract(F.url_decode("_metadata.file_path"), "/paper=([^/]*)(/[^/]*)?$", 1))
    text = F.when(F.endswith("value", F.lit("\n")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return raw.select(F.when(name != NO_NAME, name).alias("paper"), text.alias("text"))


def load_or_make(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written there first if there is none. Nothing is recomputed while it is there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
