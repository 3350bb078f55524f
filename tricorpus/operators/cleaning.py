"""Cleaning of texts line by line, without leaving the row a text is in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import abbreviations, coref, plugins
from ..functions import text as T
from ..schemas import PAIRS


def join_broken_words(texts: DataFrame) -> DataFrame:
    """A hyphen and blanks inside a line join the words beside them; blanks don't reach over line ends."""
    return texts.withColumn("text", T.join_broken_words("text"))


def strip_citations(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", T.strip_citations("text"))


def find_abbreviations(texts: DataFrame, lower_aliases: bool = True) -> DataFrame:
    """texts with `pairs`: the abbreviations each text defines, in order, then their lower-case forms."""

    @F.pandas_udf(PAIRS)
    def find(values: pd.Series) -> pd.Series:
        return pd.Series([abbreviations.find_pairs(v, lower_aliases) for v in values], dtype=object)

    # a definition needs a bracket: texts without one don't go to Python
    return texts.withColumn("pairs", F.when(F.contains("text", F.lit("(")), find("text")).otherwise(F.array().cast(PAIRS)))


def expand_abbreviations(texts: DataFrame, raw_patterns: bool = False, lower_aliases: bool = True) -> DataFrame:
    """texts with the abbreviations they define written out, at their definition too."""

    @F.pandas_udf("string")
    def expand(values: pd.Series) -> pd.Series:
        return pd.Series([abbreviations.expand_text(v, abbreviations.find_pairs(v, lower_aliases), raw_patterns) for v in values], dtype=object)

    return texts.withColumn("text", F.when(F.contains("text", F.lit("(")), expand("text")).otherwise(F.col("text")))


def resolve_coreferences(texts: DataFrame, find=None, nouns=None, limit: int = coref.CHUNK) -> DataFrame:
    """texts with mentions replaced by their heads. find: text -> groups of (start, end); nouns: text -> nouns in it. Without a model nothing changes."""
    if find is None:
        return texts
    return texts.withColumn("text", plugins.from_python(coref.resolver(find, nouns or (lambda t: set(t.split())), limit), "string")(F.col("text")))


def preprocess(texts: DataFrame, find_coreferences=None, nouns=None) -> DataFrame:
    """Broken words, citations, abbreviations and, with a model, coreferences, in this order."""
    out = texts.transform(join_broken_words).transform(strip_citations).transform(expand_abbreviations)
    return resolve_coreferences(out, find_coreferences, nouns)


def edits(texts: DataFrame, stage: str, change, pattern: str, key: str = "paper") -> DataFrame:
    """The audit of a change: (stage, key, line, before, after, found) for each line that `change` alters; found: matches of `pattern`."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line", "before")).withColumn("after", change(F.col("before")))
    return lines.where("before <> after").select(F.lit(stage).alias("stage"), key, "line", "before", "after", F.regexp_extract_all("before", F.lit(pattern), F.lit(0)).alias("found"))
