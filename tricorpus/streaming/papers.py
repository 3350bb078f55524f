"""Papers as they arrive: the stages that judge each text alone, over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plugins
from ..plans.pipeline import claim_triplets, clean_texts


def text_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(paper, text) of text files as they come into the folder."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", str(per_trigger)).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("paper"), F.col("value").alias("text"))


def triplet_stream(texts: DataFrame, language: plugins.Plugin | str = plugins.language, **options) -> DataFrame:
    """Triplets of a stream of texts; no stage keeps state, so each paper is done once, in the batch it comes with."""
    return claim_triplets(clean_texts(texts, language), **options)


def start(triplets: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append to Parquet at `path`, exactly once through the checkpoint; with `once`, what is there now and no more."""
    writer = triplets.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
