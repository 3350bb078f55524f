"""Logging of runs: loggers, timed stages with row counts, and the table of edits."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

FORM = "%(asctime)s %(name)s %(levelname)s %(message)s"


def get_logger(name: str, path: str | None = None, level: int = logging.INFO, clear: bool = False) -> logging.Logger:
    """The logger of a name, writing to the driver's console, or to a file there if `path` is given (emptied before, if `clear`). Asking again adds no second handler."""
    logger = logging.getLogger(f"tricorpus.{name}")
    logger.setLevel(level)
    if not logger.handlers:
        handler = logging.FileHandler(path, mode="w" if clear else "a", encoding="utf-8") if path else logging.StreamHandler()
        handler.setFormatter(logging.Formatter(FORM))
        logger.addHandler(handler)
        logger.propagate = False
    return logger


@contextmanager
def timed(logger: logging.Logger, what: str) -> Iterator[None]:
    """Logs how long the block took, also if it fails."""
    began = time.monotonic()
    logger.info("%s: begins", what)
    try:
        yield
    except BaseException:
        logger.error("%s: failed after %.1f s", what, time.monotonic() - began)
        raise
    logger.info("%s: took %.1f s", what, time.monotonic() - began)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and the number of its rows (`.get["rows"]`) once some action has read it: counted in passing, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_edits(edits: DataFrame, path: str, clear: bool = False) -> None:
    """Append a stage's edits to the table of edits at `path`, or begin it anew."""
    edits.write.mode("overwrite" if clear else "append").partitionBy("stage").parquet(path)
