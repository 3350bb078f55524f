"""Triplets: extraction and normalisation.

A triplet is a row (paper, pos, ..., subject, verb, object). Each step is a function of rows to rows. In marking form (`mark=True`) a step
drops nothing: it fills `reason` of the rows it would drop, the first step's reason staying, so that kept and removed rows are one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as T
from ..functions.words import LIGHT_VERBS, OBJECT_TAGS, STOP_WORDS, SUBJECT_TAGS

ROLES = ("subject", "verb", "object")


def extract_triplets(sentences: DataFrame, model: plugins.Plugin = plugins.triplets, key: str = "paper") -> DataFrame:
    """(key, pos, subject, verb, object) of sentences(key, pos, sentence); a sentence may have several, none is deduplicated."""
    found = sentences.select(key, "pos", F.explode(model(F.col("sentence"))).alias("t"))
    return found.select(key, "pos", *(F.array_join(f"t.{r}", " ").alias(r) for r in ROLES))


def _once(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """rows with the columns `new`, computed once a row: through a generator, as filters above plain projections would be pushed below them, each
    with a copy of all the expressions it looks at."""
    rest = [c for c in rows.columns if c not in new]
    made = rows.select(*rest, F.inline(F.array(F.struct(*(v.alias(k) for k, v in new.items())))))
    return made.select(*rows.columns, *(c for c in new if c not in rows.columns))


def _drop(rows: DataFrame, when: Column, reason: str, mark: bool) -> DataFrame:
    when = F.coalesce(when, F.lit(True))
    if not mark:
        return rows.where(~when)
    known = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("reason", F.coalesce(known, F.when(when, reason)))


def lower_case(rows: DataFrame) -> DataFrame:
    return _once(rows, {r: F.lower(r) for r in ROLES})


def filter_length(rows: DataFrame, most: int = 6, mark: bool = False) -> DataFrame:
    """Drops triplets of which a part has more than `most` words."""
    return _drop(rows, F.greatest(*(T.n_tokens(r) for r in ROLES)) > most, "length", mark)


def remove_stop_words(rows: DataFrame, mark: bool = False) -> DataFrame:
    """Stop words out of subject and object, light verbs out of verbs of several words; drops triplets left without subject or object."""
    verb = F.when(T.n_tokens("verb") > 1, T.without_words("verb", LIGHT_VERBS)).otherwise(F.col("verb"))
    out = _once(rows, {"subject": T.without_words("subject", STOP_WORDS), "verb": verb, "object": T.without_words("object", STOP_WORDS)})
    return _drop(out, (F.col("subject") == "") | (F.col("object") == ""), "stop words", mark)


def keep_plain_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({r: T.keep_plain(r) for r in ROLES})


def has_tag(tags: Column, allowed: tuple[str, ...]) -> Column:
    return F.exists(tags, lambda t: t["tag"].isin(*allowed))


def tag_fault(subject_tags: Column, object_tags: Column, subject: tuple[str, ...] = SUBJECT_TAGS, object_: tuple[str, ...] = OBJECT_TAGS) -> Column:
    """"subject" or "object", whichever first has no allowed tag (an empty one has none); null if both have one."""
    return F.when(~has_tag(subject_tags, subject), "subject").when(~has_tag(object_tags, object_), "object")


def with_allowed(tags: Column, allowed: tuple[str, ...]) -> Column:
    """The words that have an allowed tag, joined by spaces."""
    return F.array_join(F.transform(F.filter(tags, lambda t: t["tag"].isin(*allowed)), lambda t: t["word"]), " ")


def filter_tags(rows: DataFrame, model: plugins.Plugin = plugins.pos_tags, mark: bool = False) -> DataFrame:
    """Drops triplets whose subject or object has no allowed tag; of the others' subject and object, only words with one stay."""
    tagged = _once(rows, {"__s": model(F.col("subject")), "__o": model(F.col("object"))})
    out = _drop(tagged.withColumn("__fault", tag_fault(F.col("__s"), F.col("__o"))), F.col("__fault").isNotNull(), "tags", mark)
    changed = {"subject": with_allowed(F.col("__s"), SUBJECT_TAGS), "object": with_allowed(F.col("__o"), OBJECT_TAGS)}
    return out.withColumns({k: F.when(F.col("__fault").isNull(), v).otherwise(F.col(k)) for k, v in changed.items()}).drop("__s", "__o", "__fault")


def lemmatize(rows: DataFrame, model: plugins.Plugin = plugins.lemma) -> DataFrame:
    """Each word's lemma, verbs' by the same rules."""
    return _once(rows, {r: F.array_join(F.transform(T.tokens(r), model), " ") for r in ROLES})


def clean_up(rows: DataFrame, mark: bool = False) -> DataFrame:
    """Words of one or two characters out of subject and object; drops triplets whose subject or object is then shorter than three
    characters or whose verb is empty; runs of spaces become one."""
    long = lambda r: F.array_join(F.filter(T.tokens(r), lambda w: F.length(w) > 2), " ")
    out = _once(rows, {"subject": long("subject"), "object": long("object")})
    out = _drop(out, (F.length("subject") < 3) | (F.length("object") < 3) | (F.length("verb") < 1), "short", mark)
    return out.withColumns({r: F.regexp_replace(r, " +", " ") for r in ROLES})


def normalise(rows: DataFrame, most: int = 6, tags: plugins.Plugin = plugins.pos_tags, lemma: plugins.Plugin = plugins.lemma, mark: bool = False) -> DataFrame:
    """All steps in their order: case, length, stop words, characters, tags, lemmas, clean-up."""
    out = remove_stop_words(filter_length(lower_case(rows), most, mark), mark)
    return clean_up(lemmatize(filter_tags(keep_plain_text(out), tags, mark), lemma), mark)


def reasons(marked: DataFrame) -> DataFrame:
    """(reason, n) of rows in marking form; kept ones have the reason "kept"."""
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def nest(rows: DataFrame, papers: DataFrame | None = None, key: str = "paper") -> DataFrame:
    """(key, triplets) with each paper's triplets in order; papers(key) without any are kept, with an empty list, if given."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *ROLES))).alias("t"))
    out = lists.select(key, F.transform("t", lambda t: F.struct(*(t[r].alias(r) for r in ROLES))).alias("triplets"))
    if papers is None:
        return out
    empty = F.array().cast(out.schema["triplets"].dataType)
    return papers.select(key).distinct().join(out, key, "left").select(key, F.coalesce("triplets", empty).alias("triplets"))


def unnest(lists: DataFrame, key: str = "paper") -> DataFrame:
    """Rows of (key, triplets)."""
    return lists.select(key, F.posexplode("triplets").alias("pos", "t")).select(key, "pos", *(f"t.{r}" for r in ROLES))


def without_empty(lists: DataFrame) -> DataFrame:
    """Papers that have a triplet."""
    return lists.where(F.size("triplets") > 0)
