"""Clusters of phrases by embedding, and of triplets by their phrases' clusters.

Average linkage is monotone: two clusters that merge at height h have a pair of members within h. So the cut at height t splits into the
connected components of the graph of pairs within t, each cut alone. For unit vectors the mean cosine distance of two clusters is
1 - (sum of one) . (sum of the other) / (their sizes), so a component needs its vectors and cluster sums only, never its distance matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..lineage import components, cut
from .triplets import ROLES

BLOCK_ROWS, BUCKET_ROWS, MAX_COMPONENT = 2048, 16_384, 1_000_000
HELD = 1 << 23  # similarities at a time
SLACK = 1e-6  # links a little beyond the cut only make components larger, never the result wrong


def distinct_triplets(rows: DataFrame, key: str = "paper") -> DataFrame:
    """(key, subject, verb, object), each once: triplets deduplicated in their paper, the paper named."""
    return rows.select(key, *ROLES).distinct()


def distinct_phrases(rows: DataFrame) -> DataFrame:
    """(role, term): the different subjects, verbs and objects, in one pass."""
    each = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("term")) for r in ROLES))
    return rows.select(F.explode(each).alias("p")).select("p.role", "p.term").distinct()


def phrase_embeddings(phrases: DataFrame, model: plugins.Plugin = plugins.embed, known: DataFrame | None = None) -> DataFrame:
    """(term, embedding) of the terms of phrases(term), each embedded once; those of known(term, embedding) aren't computed again."""
    terms = phrases.select("term").where("term is not null").distinct()
    if known is None:
        return terms.select("term", model(F.col("term")).alias("embedding"))
    had = known.join(terms, "term", "left_semi").select("term", "embedding")
    return had.unionByName(terms.join(known, "term", "left_anti").select("term", model(F.col("term")).alias("embedding")))


def _matrix(values) -> np.ndarray:
    x = np.array(values.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row that can be reached: each row is looked at once."""
    label = np.full(len(close), -1)
    for start in range(len(close)):
        if label[start] < 0:
            label[start] = start
            edge = np.array([start])
            while len(edge):
                edge = np.flatnonzero(close[edge].any(axis=0) & (label < 0))
                label[edge] = start
    return label


def links(vectors: DataFrame, distance: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) terms that connect what all pairs within `distance` of vectors(term, embedding) connect.

    Vectors are dealt by hash into blocks of about block_rows; each pair of blocks is one task of bounded size, which gives the forest of its links, not
    all of them. This exact search compares all vectors with all, in blocks."""
    blocks = max(1, -(-vectors.count() // block_rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    pair = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    spread = dealt.select("term", "embedding", "block", pair).select("term", "embedding", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("term", ignore_index=True)
        x = _matrix(rows["embedding"])
        close = np.zeros((len(x), len(x)), bool)
        for a in range(0, len(x), 512):
            close[a : a + 512] = 1 - x[a : a + 512] @ x.T <= distance + SLACK
        root = _roots(close | close.T)
        own = np.flatnonzero(root != np.arange(len(x)))
        return pd.DataFrame({"a": rows["term"].to_numpy()[own], "b": rows["term"].to_numpy()[root[own]]})

    return spread.repartition(min(blocks * (blocks + 1) // 2, 10_000), "i", "j").groupBy("i", "j").applyInPandas(run, "a string, b string")


def average_linkage_cut(x: np.ndarray, distance: float, n: np.ndarray | None = None) -> np.ndarray:
    """Labels (the least row of each cluster) of unit rows x, of which row i stands for n[i] equal ones, merged while the mean cosine distance is at most
    `distance`.

    In rounds: all pairs of clusters that are each other's nearest merge, which gives what merging one pair after the other gives, as a merger comes no
    nearer to a third than its nearer part is. So only mergers, and those whose nearest is gone, look for theirs again, and a cluster with none within
    `distance` is final. Similarities are made some rows at a time."""
    n = np.ones(len(x)) if n is None else n.astype(np.float64)
    sums, label, name = x * n[:, None], np.arange(len(x)), np.arange(len(x))
    near, far = np.full(len(x), -1), np.full(len(x), np.inf)
    while len(sums) > 1:
        mean = sums / n[:, None]
        asks = np.flatnonzero(near < 0)
        rows = max(1, HELD // len(sums))
        for a in range(0, len(asks), rows):
            i = asks[a : a + rows]
            like = mean[i] @ mean.T
            like[np.arange(len(i)), i] = -np.inf
            near[i] = like.argmax(axis=1)
            far[i] = 1 - like[np.arange(len(i)), near[i]]
        every = np.arange(len(sums))
        stays = far <= distance
        if not stays.any():
            break
        a = np.flatnonzero(stays & (near[near] == every) & (every < near) & stays[near])
        if not len(a):  # a ring of equal distances
            k = int(far.argmin())
            a = np.array([min(k, near[k])])
            near[a] = max(k, near[k])
            stays[[a[0], near[a[0]]]] = True
        b = near[a]
        sums[a] += sums[b]
        n[a] += n[b]
        owner = np.arange(len(x))
        owner[name[b]] = name[a]
        label = owner[label]
        stays[b] = False
        gone = ~stays
        gone[a] = True
        near[gone[near]] = -1
        near[a] = -1
        place = np.cumsum(stays) - 1
        near = np.where(near >= 0, place[near], -1)[stays]
        sums, n, name, far = sums[stays], n[stays], name[stays], far[stays]
    return label


def linkage_cut(embeddings: DataFrame, distance: float, block_rows: int = BLOCK_ROWS, max_component: int = MAX_COMPONENT, within: str | None = None) -> DataFrame:
    """(term, cluster) of embeddings(term, embedding): the cut of average linkage under cosine distance at height `distance`.

    A cluster is named by its least term. Zero vectors and terms without a neighbour are clusters of their own. Terms of equal vectors merge first, so only
    different vectors are compared. A component of more than max_component of these is an error: it is one task's work, of its square in time (in memory,
    of its size). If the column `within` is named, each of its values, as text, is a set of terms that is clustered by itself."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    own = ["set"] if within else []
    columns = ["term", "embedding", *([F.coalesce(F.col(within).cast("string"), F.lit("")).alias("set")] if within else [])]
    all_terms = cut(embeddings.select(*columns).where("term is not null").dropDuplicates(["term"]), "vectors")
    vectors = cut(all_terms.where(norm > 0).groupBy(*own, "embedding").agg(F.min("term").alias("term"), F.count(F.lit(1)).alias("n")), "different")
    if within:
        found = vectors.select(F.col("term").alias("node"), F.col("set").alias("component"))
    else:
        found = cut(components(links(vectors, distance, block_rows)), "components")
    sizes = found.groupBy("component").count().agg(F.max("count"), F.sum("count")).first()
    if (sizes[0] or 0) > max_component:
        raise ValueError(f"{sizes[0]} vectors hang together within {distance}; max_component is {max_component}")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["component", "term"], ignore_index=True)
        x, n, term = _matrix(rows["embedding"]), rows["n"].to_numpy(), rows["term"].to_numpy()
        ends = [0, *(np.flatnonzero(rows["component"].to_numpy()[1:] != rows["component"].to_numpy()[:-1]) + 1).tolist(), len(rows)]
        names = [term[a + average_linkage_cut(x[a:b], distance, n[a:b])] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pd.DataFrame({"first": term, "cluster": np.concatenate(names)})

    grouped = vectors.drop("set").join(found.select(F.col("node").alias("term"), "component"), "term")
    buckets = max(1, -(-(sizes[1] or 0) // BUCKET_ROWS))
    dealt = grouped.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int"))
    merged = dealt.repartition(min(buckets, 10_000), "bucket").groupBy("bucket").applyInPandas(run, "first string, cluster string")
    same = vectors.withColumnRenamed("term", "first").join(merged, "first", "left").select(*own, "embedding", F.coalesce("cluster", "first").alias("cluster"))
    named = all_terms.where(norm > 0).join(same, [*own, "embedding"]).select("term", "cluster")
    return named.unionByName(all_terms.where(norm.isNull() | ~(norm > 0)).select("term", F.col("term").alias("cluster")))


def assign(rows: DataFrame, clusters: DataFrame, role: str, name: str) -> DataFrame:
    """rows with the cluster of their phrase in `role` as the column `name`; rows whose phrase has none are left out."""
    return rows.join(clusters.select(F.col("term").alias(role), F.col("cluster").alias(name)), role)


def cluster_triplets(rows: DataFrame, subjects: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """rows with sub_cluster and/or obj_cluster, by the clusters given: the modes subject, object, and both."""
    if subjects is None and objects is None:
        raise ValueError("give clusters of subjects, objects or both")
    if subjects is not None:
        rows = assign(rows, subjects, "subject", "sub_cluster")
    return rows if objects is None else assign(rows, objects, "object", "obj_cluster")


def members(clustered: DataFrame, key: str = "paper") -> DataFrame:
    """One row a cluster, with its members in order as an array."""
    keys = [c for c in ("sub_cluster", "obj_cluster") if c in clustered.columns]
    return clustered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ROLES, F.col(key).alias("paper")))).alias("members"))
