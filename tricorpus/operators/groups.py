"""Fair groups: sets of co-clustered triplets, one a paper, of one category or of two in balance.

Rows are (cluster, paper, subject, verb, object); categories are (paper, category), of which `first` is one kind and all others are the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triplets import ROLES

CHOICES, MEMBERS = 65_536, 1 << 20
LEAST_SHARE = 0.25
KINDS = ("first", "other", "mixed")


def with_category(rows: DataFrame, categories: DataFrame, first: str = "cs") -> DataFrame:
    """rows with is_first; rows of papers without a category are left out (see `without_category`)."""
    return rows.join(categories.select("paper", (F.col("category") == first).alias("is_first")), "paper")


def without_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    return rows.join(categories, "paper", "left_anti")


def _kinds(n_first: Column, n_other: Column) -> list[tuple[str, Column, Column]]:
    """(kind, whether a group has it, its size)."""
    total = n_first + n_other
    mixed = (n_first > 0) & (n_other > 0) & (n_first / total > LEAST_SHARE) & (n_other / total > LEAST_SHARE)
    return [("first", n_first > 1, n_first), ("other", n_other > 1, n_other), ("mixed", mixed, total)]


def fair_groups(rows: DataFrame, categories: DataFrame, one_per_paper: bool = True, first: str = "cs", max_product: int | None = None) -> DataFrame:
    """(kind, size, group_id, members) of all groups.

    With one_per_paper a cluster gives every choice of one of its triplets a paper, else itself. A group gives its members of the first category if
    they are over one, those of the others likewise, and all of them if both kinds have over a quarter. Equal lists from different choices all
    stay: they weigh in means. Choices are numbered, and made from their numbers, CHOICES to a row at a time (fewer if they have over MEMBERS members) over all
    tasks, so no row holds them all. It
    is an error if a cluster has more than max_product, if that is given, or than 2**62; `group_sizes` and spread.mean_spread need no choices."""
    most = 2**62 if max_product is None else max_product
    t = F.struct(*ROLES, "paper", "is_first")
    known = with_category(rows, categories, first)
    if one_per_paper:
        papers = known.groupBy("cluster", "paper").agg(F.array_sort(F.collect_list(t)).alias("t"))
        lists = papers.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("paper", "t"))).alias("papers"))
        # strides[i]: choices among the papers after the i-th, so that the last paper changes fastest
        sizes = F.reverse(F.transform("papers", lambda p: F.size(p["t"])))
        product = lambda s: F.aggregate(s, F.lit(1.0), lambda n, k: n * k)
        lists = lists.withColumn("sizes", sizes).withColumn("all", product("sizes"))
        checked = F.when(F.col("all") <= float(most), F.col("all").cast("long")).otherwise(F.raise_error(F.lit("a cluster has more than max_product choices of one triplet a paper")).cast("long"))
        strides = F.reverse(F.transform("sizes", lambda _, i: product(F.slice("sizes", F.lit(1), i)).cast("long")))
        # so many choices a row of `stretches` that they have MEMBERS members at most, and one at least
        several = F.greatest(F.lit(1), F.least(F.lit(CHOICES), F.floor(F.lit(MEMBERS) / F.size("papers")))).cast("long")
        stretches = lists.select("cluster", "papers", strides.alias("strides"), checked.alias("all"), several.alias("several")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("all") - 1).cast("long"), F.col("several"))).alias("begin"))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else small rows, of which each makes many, come together
        each = stretches.repartition(parts, "cluster", "begin").select("cluster", "papers", "strides", F.explode(F.sequence("begin", F.least(F.col("begin") + F.col("several") - 1, F.col("all") - 1))).alias("choice"))
        member = lambda p, i: F.get(p["t"], (F.call_function("div", F.col("choice"), F.get("strides", i)) % F.size(p["t"])).cast("int"))
        groups = each.select("cluster", "choice", F.transform("papers", member).alias("members"))
    else:
        groups = known.groupBy("cluster").agg(F.array_sort(F.collect_list(t)).alias("members")).select("cluster", F.lit(0).alias("choice"), "members")
    one, other = F.filter("members", lambda x: x["is_first"]), F.filter("members", lambda x: ~x["is_first"])
    parts = {"first": one, "other": other, "mixed": F.col("members")}
    found = [F.when(has, F.struct(F.lit(k).alias("kind"), size.cast("int").alias("size"), parts[k].alias("members"))) for k, has, size in _kinds(F.size(one), F.size(other))]
    out = groups.select("cluster", "choice", F.explode(F.array_compact(F.array(*found))).alias("g"))
    return out.select("g.kind", "g.size", F.concat_ws("#", "cluster", "choice").alias("group_id"), "g.members")


def paper_counts(rows: DataFrame, categories: DataFrame, first: str = "cs") -> DataFrame:
    """(cluster, n_first, n_other, choices): papers of each kind, and how many choices of one triplet a paper there are."""
    papers = with_category(rows, categories, first).groupBy("cluster", "paper", "is_first").agg(F.count(F.lit(1)).alias("n"))
    n = lambda c: F.count(F.when(c, 1))
    return papers.groupBy("cluster").agg(n(F.col("is_first")).alias("n_first"), n(~F.col("is_first")).alias("n_other"), F.product("n").alias("choices"))


def group_sizes(rows: DataFrame, categories: DataFrame, first: str = "cs") -> DataFrame:
    """(kind, size, n_groups) of fair_groups with one triplet a paper, from counts alone: no group is made."""
    counts = paper_counts(rows, categories, first)
    found = [F.when(has, F.struct(F.lit(k).alias("kind"), size.cast("int").alias("size"))) for k, has, size in _kinds(F.col("n_first"), F.col("n_other"))]
    out = counts.select("choices", F.explode(F.array_compact(F.array(*found))).alias("g"))
    return out.groupBy("g.kind", "g.size").agg(F.sum("choices").alias("n_groups"))
