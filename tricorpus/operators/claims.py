"""Sentences that make claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as T


def long_sentences(texts: DataFrame, min_tokens: int = 5, split: plugins.Plugin = T.split_sentences, key: str = "paper") -> DataFrame:
    """(key, pos, sentence) of sentences of more than `min_tokens` words; pos counts all sentences."""
    return texts.where("text <> ''").select(key, F.posexplode(split(F.col("text"))).alias("pos", "sentence")).where(T.n_tokens("sentence") > min_tokens)


def with_chars(sentences: DataFrame) -> DataFrame:
    """sentences with `chars`: their characters, spaced."""
    return sentences.withColumn("chars", T.spaced_chars("sentence"))


def score(sentences: DataFrame, model: plugins.Plugin = plugins.claim_score) -> DataFrame:
    """sentences with `score`; the model sees the fields sentence and chars."""
    return sentences.withColumn("score", model(F.struct("sentence", T.spaced_chars("sentence").alias("chars"))))


def claims(texts: DataFrame, threshold: float = 0.05, min_tokens: int = 5, model: plugins.Plugin = plugins.claim_score, key: str = "paper") -> DataFrame:
    """(key, pos, sentence, score) of sentences that score over the threshold; a null score is no claim."""
    return score(long_sentences(texts, min_tokens, key=key), model).where(F.col("score") > threshold)
