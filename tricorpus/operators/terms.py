"""Terms: in how many documents they stand, how special they are, and what they let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut, ranked
from .triplets import ROLES

INFINITY = float("inf")


def vocabulary(rows: DataFrame) -> DataFrame:
    """(term): distinct words of two or more characters in triplets."""
    return rows.select(F.explode(T.tokens(F.concat_ws(" ", *ROLES))).alias("term")).where(F.length("term") > 1).distinct()


def document_frequency(texts: DataFrame, vocab: DataFrame | None = None, at_least: int = 5, lower: bool = True, key: str = "paper") -> DataFrame:
    """(term, df): in how many of texts(key, text) a term stands `at_least` times; only terms of vocab(term), if given.

    Words are counted by document first, before anything is shuffled by term alone; the vocabulary cuts rows before the first shuffle."""
    words = texts.select(key, F.explode(T.tokens(F.lower("text") if lower else F.col("text"))).alias("term"))
    if vocab is not None:
        words = words.join(vocab.select("term"), "term", "left_semi")
    often = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return often.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def generic_counts(texts: DataFrame, key: str = "paper") -> DataFrame:
    """(term, df) with case kept, of terms that stand more than five times in a document."""
    return document_frequency(texts, at_least=6, lower=False, key=key)


def first_share(rows: DataFrame, order: str, share: float) -> DataFrame:
    """The first int(n * share) of the n rows in order of the column `order`."""
    if share >= 1:
        return rows
    n = rows.count()
    return ranked(rows, order).where(F.col("rank") < int(n * share)).drop("rank")


def term_scores(corpus_df: DataFrame, paper_df: DataFrame, n_corpus: int, n_papers: int, min_papers: int = 10) -> DataFrame:
    """(term, score): log of the term's share of papers over its share of the background corpus.

    Infinite if it isn't in the corpus at all; minus infinity if fewer than `min_papers` papers have it. Terms with ASCII punctuation, of digits
    only or of one character are left out."""
    both = corpus_df.select("term", F.col("df").alias("c")).join(paper_df.select("term", F.col("df").alias("p")), "term", "full_outer")
    score = F.when(F.coalesce("p", F.lit(0)) < min_papers, -INFINITY).when(F.col("c").isNull(), INFINITY).otherwise(F.log(F.col("p") / F.lit(float(n_papers))) - F.log(F.col("c") / F.lit(float(n_corpus))))
    good = ~T.has_punctuation("term") & ~F.rlike("term", F.lit("^[0-9]+$")) & (F.length("term") >= 2)
    return both.where(good).select("term", score.alias("score"))


def top_cut(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """(n, place, cut): the score at place int(n * share), from 0, of all n in descending order. ValueError if there is no such place."""
    scores = cut(scores.select("score"), "scores")
    n = scores.count()
    place = int(n * share)
    if place >= n:
        raise ValueError("share must be below 1, and there must be scores")
    at = ranked(scores, F.desc("score")).where(F.col("rank") == place)
    return at.select(F.lit(n).cast("long").alias("n"), F.lit(place).cast("long").alias("place"), F.col("score").alias("cut"))


def domain_flags(rows: DataFrame, scores: DataFrame, share: float = 0.1) -> DataFrame:
    """rows with `domain`: whether a word of the subject scores at least the top share's cut; unknown words score minus infinity.

    Distinct subjects are judged, so a frequent subject is one row here, and its many rows only meet that row in the last join."""
    scores = cut(scores, "term-scores")
    limit = top_cut(scores, share).first().cut
    subjects = rows.select("subject").distinct()
    words = subjects.select("subject", F.explode(T.tokens("subject")).alias("term"))
    if limit == -INFINITY:
        good = words.select("subject").distinct()
    else:
        good = words.join(scores.where(F.col("score") >= limit).select("term"), "term", "left_semi").select("subject").distinct()
    return rows.join(good.withColumn("__good", F.lit(True)), "subject", "left").withColumn("domain", F.coalesce("__good", F.lit(False))).drop("__good").select(*rows.columns, "domain")


def filter_with_corpus(rows: DataFrame, corpus: DataFrame, papers: DataFrame, share: float = 0.1, min_papers: int = 10, at_least: int = 5, prefix: float = 0.3, max_chars: int = 30_000, order: str = "paper", key: str = "paper") -> DataFrame:
    """rows with `domain`, by term frequencies in corpus(order, text) and papers(key, text), for the triplets' own words.

    The first `prefix` of the corpus texts shorter than max_chars is counted, while its size in the scores is that of all of them."""
    rows = cut(rows, "triplets")  # read for the vocabulary, the subjects and the result
    corpus = corpus.where(F.length("text") < max_chars)
    vocab = cut(vocabulary(rows), "vocabulary")  # both counts use it
    corpus_df = document_frequency(first_share(corpus, order, prefix), vocab, at_least, key=order)
    paper_df = document_frequency(papers, vocab, at_least, key=key)
    return domain_flags(rows, term_scores(corpus_df, paper_df, corpus.count(), papers.count(), min_papers), share)


def drop_generic(rows: DataFrame, counts: DataFrame, threshold: int = 5) -> DataFrame:
    """rows whose whole subject is a term of fewer than `threshold` documents, or of none."""
    return rows.join(counts.where(F.col("df") >= threshold).select(F.col("term").alias("subject")), "subject", "left_anti").select(*rows.columns)
