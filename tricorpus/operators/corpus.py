"""Choosing papers and taking their text apart.

Frames are keyed by `paper` (or `name`, `id` for files); texts are whole in one row, so cleaning them needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as T
from ..sources.files import file_id, file_version


def newest_versions(files: DataFrame) -> DataFrame:
    """(id, version, name) of the newest version of each paper among files(name); names of another form are left out."""
    parsed = files.select(file_id("name").alias("id"), file_version("name").alias("version"), "name").where("version is not null")
    best = parsed.groupBy("id").agg(F.max(F.struct("version", "name")).alias("b"))
    return best.select("id", "b.version", "b.name")


def older_versions(files: DataFrame) -> DataFrame:
    """The rows of files(name) that are not the newest of their paper: what a clean-up would delete. Nothing is deleted here."""
    return files.where(file_version("name").isNotNull()).join(newest_versions(files).select("name"), "name", "left_anti")


def in_categories(categories: Column | str, wanted: tuple[str, ...]) -> Column:
    """Whether one of the space-separated categories is wanted, as a whole word."""
    return F.arrays_overlap(F.split(T.col(categories), T.WHITE), F.array(*map(F.lit, wanted)))


def keep_categories(metadata: DataFrame, wanted: tuple[str, ...], inverse: bool = False) -> DataFrame:
    """Rows of metadata(id, categories) with a wanted category, or (inverse) with none of them."""
    hit = F.coalesce(in_categories("categories", wanted), F.lit(False))
    return metadata.where(~hit if inverse else hit)


def category_share(metadata: DataFrame, wanted: tuple[str, ...], inverse: bool = False) -> DataFrame:
    """(n_all, n_kept, share) in one row; share is null for an empty table."""
    hit = F.coalesce(in_categories("categories", wanted), F.lit(False))
    n = F.count(F.when(~hit if inverse else hit, 1))
    return metadata.agg(F.count(F.lit(1)).alias("n_all"), n.alias("n_kept"), (n / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"))


def files_with(files: DataFrame, ids: DataFrame, inverse: bool = False) -> DataFrame:
    """Rows of files(name) whose id, without its version, is among ids(id); the rest of them if inverse."""
    return files.withColumn("id", file_id("name")).join(ids.select("id").distinct(), "id", "left_anti" if inverse else "left_semi")


def sample_exact(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if there are fewer), the same ones each time: those whose key has the least digest with the seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def shorter_than(texts: DataFrame, n_chars: int) -> DataFrame:
    return texts.where(F.length("text") < n_chars)


def keep_language(texts: DataFrame, language: plugins.Plugin | str = plugins.language, wanted: tuple[str, ...] = ("en", "err")) -> DataFrame:
    """Non-empty texts whose language is wanted; `language` is a model, or the name of a column that has it (its filter reaches the scan)."""
    label = F.col(language) if isinstance(language, str) else language(F.col("text"))
    return texts.where(label.isin(*wanted)).where("text <> ''")


def strip_sections(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", T.strip_sections("text"))


def sentences(texts: DataFrame, split: plugins.Plugin = T.split_sentences, merge_et_al: bool = True, key: str = "paper") -> DataFrame:
    """(key, pos, sentence) of texts(key, text)."""
    parts = split(F.col("text"))
    return texts.select(key, F.posexplode(T.merge_et_al(parts) if merge_et_al else parts).alias("pos", "sentence"))


def process_papers(papers: DataFrame, extract: plugins.Plugin = plugins.html_text, language: plugins.Plugin | str = plugins.language) -> DataFrame:
    """SENTENCES of papers(name, content): text out of the content, English (or undecided) ones, sections cut, sentences split and joined."""
    texts = papers.select(T.stem("name", ".pdf").alias("paper"), extract(F.col("content")).alias("text"))
    return sentences(strip_sections(keep_language(texts, language)))
