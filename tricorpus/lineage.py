"""Cutting lineage, ranks over all rows, and connected components, on DataFrames alone.

Everything that is written goes to the folder that the cluster names in spark.checkpoint.dir, so any executor can be lost at any time.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Drops the shuffle files of a write once it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors see, deleted when the driver ends. Where spark.checkpoint.dir is unset: a temporary one if driver and executors are one
    process, as in tests; else an error, as each machine would write to its own disk."""
    context = spark.sparkContext
    app, told = context.applicationId, context.getConf().get("spark.checkpoint.dir")
    if told:
        path = f"{told.rstrip('/')}/tricorpus-{app}"
        if path not in _marked:
            _marked.add(path)
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            system = where.getFileSystem(context._jsc.hadoopConfiguration())
            system.mkdirs(where)
            system.deleteOnExit(where)
        return path
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tricorpus-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: lineage ends there, so a lost executor costs only the stage that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with `rank`, the 0-based place of each row in the given order, found without bringing all rows together.

    Rows are dealt by range and sorted; a partition's first place is the sum of the sizes of those before it (one small row a partition)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()  # the partition above 33 bits of the row's place in it
    placed = cut(dealt.withColumns({"__part": F.shiftright(local, 33), "__place": local.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(a, b) of any one ordered type; a component is named by its least node.

    Large-star and small-star rounds (Kiveris et al., 2014), with minima and joins only: no neighbour list is gathered. Minima are written before they
    are joined, as Spark can't split a hot node where a join shares the partitions of an aggregate. The loop ends once a round leaves the edges as they were;
    what a round wrote is deleted when the next one stands."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    known = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        met = large.join(lower, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small, "stars")
        for old in (now, least, large, lower):
            discard(old)
        now = after
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == known:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return found.union(now.select("v", "v").distinct())  # those that name a component are in it
        known = state
