"""The three pipelines: papers to clean text, clean text to triplets, triplets to clusters and their spread.

Each is one lazy plan; `write` modes are left to the caller, and sources.files.load_or_make keeps what is there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lineage
from ..functions import plugins
from ..functions import text as T
from ..operators import claims, cleaning, clusters, corpus, groups, spread, terms, triplets


def clean_texts(texts: DataFrame, language: plugins.Plugin | str = plugins.language, coreferences=None, key: str = "paper") -> DataFrame:
    """(key, text) of texts(key, text): language kept, sections cut, a sentence a line, then broken words, citations, abbreviations."""
    cut = corpus.strip_sections(corpus.keep_language(texts, language))
    lines = F.array_join(T.merge_et_al(T.split_sentences("text")), "\n")
    return cleaning.preprocess(cut.select(key, lines.alias("text")), coreferences)


def claim_triplets(texts: DataFrame, threshold: float = 0.05, claim_model: plugins.Plugin = plugins.claim_score, svo: plugins.Plugin = plugins.triplets, key: str = "paper") -> DataFrame:
    """(key, pos, subject, verb, object) of the claims in clean texts."""
    return triplets.extract_triplets(claims.claims(texts, threshold, model=claim_model, key=key), svo, key)


def domain_triplets(rows: DataFrame, background: DataFrame, papers: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Normalised triplets that are kept, and those removed, of rows; options as for terms.filter_with_corpus."""
    flagged = terms.filter_with_corpus(triplets.normalise(rows), background, papers, **options)
    return flagged.where("domain").drop("domain"), flagged.where("not domain").drop("domain")


def cluster(rows: DataFrame, papers: DataFrame, by: str = "subj_obj", subject_cut: float = 0.05, object_cut: float = 0.1, threshold: int = 5, model: plugins.Plugin = plugins.embed, key: str = "paper") -> DataFrame:
    """rows, each once a paper and without generic subjects, with the clusters of their subjects and/or objects."""
    if by not in ("subj", "obj", "subj_obj"):
        raise ValueError("by must be subj, obj or subj_obj")
    own = lineage.cut(clusters.distinct_triplets(terms.drop_generic(rows, terms.generic_counts(papers, key), threshold), key), "triplets")
    phrases = clusters.distinct_phrases(own)
    cut = lambda role, t: clusters.linkage_cut(clusters.phrase_embeddings(phrases.where(phrases["role"] == role), model), t)
    return clusters.cluster_triplets(own, cut("subject", subject_cut) if by != "obj" else None, cut("object", object_cut) if by != "subj" else None)


def diameters(clustered: DataFrame, categories: DataFrame, embeddings: DataFrame, by: str = "subj_obj", method: str = "mean", one_per_paper: bool = True) -> DataFrame:
    """(kind, size, spread) of clustered rows(paper, subject, verb, object, cluster)."""
    if one_per_paper:
        return spread.choice_spread(clustered, categories, embeddings, method, by)
    return spread.spread(groups.fair_groups(clustered, categories, False), embeddings, method, by)
