"""Toxicity: a logistic classifier of word presence, regularised by counterfactual swaps of identity terms.

Labelled rows whose crc32(doc_id) modulo 5 is 0 are held out and never seen. Of the others, MAX_TRAIN at most (those with
the least hash of their doc_id) are learned from; that bound is the one limit, and their whole texts are read. Words are in
lower case (A-Z) without marks at their ends. Words that at least MIN_DOCS of these documents have and whose share differs between
the classes by Z_LIMIT standard errors become features, and all identity terms do.

Counterfactuals: in each training document every identity term is swapped for another of its language; a document without one
gets one put in, in two versions. The loss adds LAMBDA times the mean squared change of score (in logits) between the versions, so what a
text says of a group counts, not which group it names, nor that it names one.

Scores need one pass over the documents with the weights (of words of the learned documents). Nulls: a null text is
empty; a null label or doc_id isn't learned from; a null doc_id is held out (its crc32 is taken as 0). Repeated labels of a doc_id: toxic if any is; of several texts with one doc_id the least is learned from. Every row of docs
gives one row. Without labelled rows of both classes the score is the share of toxic ones (0 if none). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, cut, row_slices

MAX_TRAIN, MIN_DOCS, Z_LIMIT, LAMBDA, RIDGE = 20_000, 5, 4.0, 1.0, 1e-4
STRIP = b".,;:!?\"'()"
IDENTITIES = tuple(
    tuple(w.encode() for w in words.split())
    for words in (
        "women men muslims muslim christians christian jews jewish hindus buddhists atheists gay lesbian bisexual transgender trans queer straight black white asian african latino arab immigrants immigrant refugees foreigners disabled blind deaf elderly teenagers",
        "femmes hommes musulmans chrétiens juifs athées homosexuels noirs blancs arabes africains immigrés réfugiés étrangers handicapés vieux jeunes",
        "frauen männer muslime christen juden atheisten schwule lesben schwarze weiße araber afrikaner einwanderer flüchtlinge ausländer behinderte alte junge",
        "mujeres hombres musulmanes cristianos judíos ateos homosexuales negros blancos árabes africanos inmigrantes refugiados extranjeros discapacitados ancianos jóvenes",
    )
)


def words_of(text: bytes) -> set[bytes]:
    return {w.strip(STRIP) for w in set(text.lower().split())}


def held_out(doc_id="doc_id"):
    return F.pmod(F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)), F.lit(5)) == 0


def sample(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most MAX_TRAIN labelled rows that aren't held out."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, toxic) over rows(toxic, text): documents with the word, and toxic ones; the word "" stands for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        bad: Counter = Counter()
        for batch in row_slices(batches):
            for toxic, text in zip(batch.column("toxic").to_pylist(), byte_texts(batch)):
                found = words_of(text) | {b""}
                n.update(found)
                if toxic:
                    bad.update(found)
        if n:
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], ["word", "n", "toxic"])

    return rows.mapInArrow(run, "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def chosen_words(rows: DataFrame) -> list[bytes]:
    counts = word_counts(rows)
    every = counts.where("word = ''").first()
    if not every or every.toxic in (0, every.n):
        return []
    n1, n0, p = every.toxic, every.n - every.toxic, F.col("n") / F.lit(float(every.n))
    z = (F.col("toxic") / n1 - (F.col("n") - F.col("toxic")) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    picked = counts.where(f"word <> '' and n >= {MIN_DOCS} and n < {every.n}").withColumn("z", z).where(F.abs("z") >= Z_LIMIT)
    return [r.word.encode() for r in picked.orderBy(F.desc(F.abs("z")), "word").collect()]  # words of at most MAX_TRAIN documents


def fit(features: list[list[int]], toxic: np.ndarray, places: list[list[int]], n_words: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias; features: the words of each document by number; places: numbers of the identity terms, by language."""
    lens = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.fromiter((i for f in features for i in f), np.int64, int(lens.sum()))
    row = np.repeat(np.arange(len(features)), lens)
    rng = np.random.default_rng(11)
    language = {i: k for k, p in enumerate(places) for i in p}
    left, right = [], []  # swapped terms; -1: none
    for f in features:
        named = [i for i in f if i in language]
        if named:
            left += named
            right += [int(rng.choice(places[language[i]])) for i in named]
        else:
            a, b = rng.choice(places[int(rng.integers(len(places)))], 2)
            left += [int(a), int(a)]
            right += [int(b), -1]
    left, right = np.array(left), np.array(right)
    w, b = np.zeros(n_words + 1), np.log((toxic.mean() + 1e-6) / (1 - toxic.mean() + 1e-6))
    m, v = np.zeros(n_words + 2), np.zeros(n_words + 2)
    for k in range(1, rounds + 1):
        score = b + np.bincount(row, weights=w[flat], minlength=len(features))
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - toxic) / len(toxic)
        g = np.bincount(flat, weights=error[row], minlength=n_words + 1)
        change = (w[left] - w[right]) * (2 * LAMBDA / len(left))  # the last weight stands for no term and stays 0
        g += np.bincount(left, weights=change, minlength=n_words + 1)
        np.subtract.at(g, right, change)
        g = np.append(g + RIDGE * w, error.sum())
        g[n_words] = 0
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)
        w -= step[:-1]
        b -= step[-1]
    return w[:-1], float(b)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[bytes, float], float]:
    """Weights by word, and the bias."""
    # MAX_TRAIN rows of two numbers bound what is broadcast; one text each bounds what is learned from, and is read three times below
    rows = docs.select("doc_id", "text").join(F.broadcast(sample(labels)), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = cut(rows.select("toxic", "text"), "labelled")
    words = chosen_words(rows)
    terms = [w for group in IDENTITIES for w in group]
    index = {w: i for i, w in enumerate(dict.fromkeys([*words, *terms]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            found = [sorted(index[w] for w in words_of(t) & index.keys()) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "words"])

    known = rows.mapInArrow(run, "toxic int, words array<int>").toPandas()  # MAX_TRAIN rows of word numbers
    known = known.assign(k=known["words"].map(str)).sort_values(["k", "toxic"], kind="stable")  # the same order each time
    toxic = known["toxic"].to_numpy(float)
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return {}, 40.0 if share else -40.0
    weights, bias = fit([list(x) for x in known["words"]], toxic, [[index[w] for w in g] for g in IDENTITIES], len(index))
    return {w: float(weights[i]) for w, i in index.items() if weights[i]}, bias


def score(docs: DataFrame, weights: dict[bytes, float], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for batch in row_slices(batches):
            z = np.array([bias + sum(sorted(weights[w] for w in words_of(t) & known)) for t in byte_texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    scored = score(docs, *train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
