"""The catalogue: each operator over the driver's tables, and the same in DuckDB SQL.

The tables have no scholarly structure, so views put it in by rule (file names, categories, section words, citations, broken words), the same
rule on both sides. Triplets are positional: words 1-2, 3 and 4-6 of each English sentence of over five words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coref, plugins
from .functions import text as T
from .functions.words import CITATION, LIGHT_VERBS, OBJECT_TAGS, STOP_WORDS, SUBJECT_TAGS
from .lineage import cut, shared_dir
from .operators import claims, cleaning, clusters, corpus, groups, spread, terms, triplets
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# --- views, in Spark and in DuckDB

NAMES_SQL = "names as (select doc_id, concat('2101.', lpad(cast(cast(floor(doc_id / 3) as int) as varchar), 5, '0'), 'v', cast(1 + (doc_id % 3) * 5 as varchar), '.pdf') as name from documents)"
CATEGORIES_SQL = "cats as (select cast(doc_id as varchar) id, concat_ws(' ', case when doc_id % 2 = 0 then 'cs.C' else 'cs.CL' end, case when doc_id % 3 = 0 then 'math.CO' end, case when doc_id % 5 = 0 then 'cs.LG' end) categories from documents)"
WANTED = ("cs.CL", "cs.LG")
PAPERS_SQL = "papers as (select doc_id, text from documents where lang = 'en')"
SENTS_SQL = (
    PAPERS_SQL
    + r""", sents as (select doc_id, cast(i - 1 as int) pos, sentence from (select doc_id, unnest(string_split(t, chr(10))) sentence, generate_subscripts(string_split(t, chr(10)), 1) i
  from (select doc_id, regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \t]+', '\1' || chr(10), 'g') t from papers)))"""
)
WORDS_SQL = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f]+'), lambda x: x <> '')"
FX_SQL = SENTS_SQL + f""", fx as (select doc_id, pos, concat_ws(' ', w[1], w[2]) subject, w[3] verb, concat_ws(' ', w[4], w[5], w[6]) object
  from (select doc_id, pos, {WORDS_SQL.format("sentence")} w from sents) where len(w) > 5)"""
HASH_SQL = "cast(('0x' || md5({})[1:7]) as bigint)"


def names(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return documents(spark, d).select(*more, F.concat(F.lit("2101."), F.lpad(F.floor(F.col("doc_id") / 3).cast("string"), 5, "0"), F.lit("v"), (1 + F.col("doc_id") % 3 * 5).cast("string"), F.lit(".pdf")).alias("name"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    cats = F.concat_ws(" ", F.when(i % 2 == 0, "cs.C").otherwise("cs.CL"), F.when(i % 3 == 0, "math.CO"), F.when(i % 5 == 0, "cs.LG"))
    return documents(spark, d).select(i.cast("string").alias("id"), cats.alias("categories"))


def papers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.keep_language(documents(spark, d), "lang", ("en",)).select("doc_id", "text")


def sents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sentences(papers(spark, d), merge_et_al=False, key="doc_id")


def fx(spark: SparkSession, d: str) -> DataFrame:
    return triplets.extract_triplets(sents(spark, d), plugins.positional_triplets, "doc_id")


def hashed(c: Column | str) -> Column:
    return F.conv(F.substr(F.md5(c), F.lit(1), F.lit(7)), 16, 10).cast("long")


# --- choosing papers


@query(f"with {NAMES_SQL}, p as (select regexp_extract(name, '^(.*)v([0-9]+)[.]pdf$', 1) id, cast(regexp_extract(name, '^(.*)v([0-9]+)[.]pdf$', 2) as int) version, name from names) select id, max(version) as version, arg_max(name, version) as name from p group by id")
def newest_version(spark, d):
    return corpus.newest_versions(names(spark, d))


@query(f"with {NAMES_SQL}, p as (select regexp_extract(name, '^(.*)v([0-9]+)[.]pdf$', 1) id, cast(regexp_extract(name, '^(.*)v([0-9]+)[.]pdf$', 2) as int) version, name from names) select name from p where version < (select max(version) from p q where q.id = p.id)")
def older_versions(spark, d):
    return corpus.older_versions(names(spark, d))


@query(f"with {CATEGORIES_SQL} select id, categories from cats where list_has_any(string_split(categories, ' '), {sql_list(WANTED)})")
def keep_categories(spark, d):
    return corpus.keep_categories(metadata(spark, d), WANTED)


@query(f"with {CATEGORIES_SQL} select id, categories from cats where not list_has_any(string_split(categories, ' '), {sql_list(WANTED)})")
def drop_categories(spark, d):
    return corpus.keep_categories(metadata(spark, d), WANTED, inverse=True)


@query(f"with {CATEGORIES_SQL}, h as (select list_has_any(string_split(categories, ' '), {sql_list(WANTED)}) k from cats) select count(*) n_all, count(*) filter (k) n_kept, round(count(*) filter (k) / cast(count(*) as double), 9) share from h")
def category_share(spark, d):
    return corpus.category_share(metadata(spark, d), WANTED).withColumn("share", F.round("share", 9))


def _kept_ids(spark, d):
    return corpus.keep_categories(metadata(spark, d), ("math.CO",)).select(F.concat(F.lit("2101."), F.lpad("id", 5, "0")).alias("id"))


@query(f"with {NAMES_SQL}, {CATEGORIES_SQL}, p as (select regexp_extract(name, '^(.*)v([0-9]+)[.]pdf$', 1) id, name from names) select id, name from p where id in (select concat('2101.', lpad(id, 5, '0')) from cats where list_contains(string_split(categories, ' '), 'math.CO'))")
def files_kept(spark, d):
    return corpus.files_with(names(spark, d), _kept_ids(spark, d))


@query(f"with {NAMES_SQL}, {CATEGORIES_SQL}, p as (select regexp_extract(name, '^(.*)v([0-9]+)[.]pdf$', 1) id, name from names) select id, name from p where id not in (select concat('2101.', lpad(id, 5, '0')) from cats where list_contains(string_split(categories, ' '), 'math.CO'))")
def files_removed(spark, d):
    return corpus.files_with(names(spark, d), _kept_ids(spark, d), inverse=True)


@query("select doc_id from documents order by md5(doc_id || '|7'), doc_id limit 50")
def sample_exact(spark, d):
    return corpus.sample_exact(documents(spark, d).select("doc_id"), "doc_id", 50, 7)


@query("select doc_id, md5(text) text_md5 from documents where lang in ('en', 'err') and text <> ''")
def language_gate(spark, d):
    return corpus.keep_language(documents(spark, d), "lang").select("doc_id", F.md5("text").alias("text_md5"))


_VOTES = ", ".join(f"len(list_filter(w, lambda x: list_contains({sql_list(tuple(s.split()))}, x))) v_{k}" for k, s in plugins.COMMON.items())


@query(
    f"with v as (select doc_id, {_VOTES} from (select doc_id, {WORDS_SQL.format('lower(left(text, 1300))')} w from documents)) "
    "select doc_id, case when greatest(v_en, v_de, v_fr, v_es) = 0 then 'err' when v_en = greatest(v_en, v_de, v_fr, v_es) then 'en' when v_de = greatest(v_en, v_de, v_fr, v_es) then 'de' when v_fr = greatest(v_en, v_de, v_fr, v_es) then 'fr' else 'es' end as language from v"
)
def language_model(spark, d):
    return documents(spark, d).select("doc_id", plugins.language(F.col("text")).alias("language"))


@query("select item_id, text from benchmark where length(text) < 250")
def short_corpus(spark, d):
    return corpus.shorter_than(table(spark, d, "benchmark"), 250)


# --- cleaning

SECTIONS_SQL = """sections as (select doc_id, concat(case when doc_id % 4 in (0, 1) then 'Title Author Abstract ' else 'Title Author ' end, case when doc_id % 4 in (1, 2) then 'Introduction ' else '' end, text,
  case when doc_id % 5 in (0, 1) then ' Acknowledgements thanks' else '' end, case when doc_id % 5 in (1, 2, 3) then ' References [1] X' else '' end) t from documents)"""


@query(
    f"""with {SECTIONS_SQL}, p as (select doc_id, t, lower(t) l from sections),
q as (select doc_id, t, strpos(l, 'abstract') - 1 a, strpos(l, 'introduction') - 1 i,
  case when contains(l, 'reference') then length(l) - strpos(reverse(l), reverse('reference')) + 1 - length('reference') else -1 end r,
  case when contains(l, 'acknowledgement') then length(l) - strpos(reverse(l), reverse('acknowledgement')) + 1 - length('acknowledgement') else -1 end k from p),
s as (select doc_id, t, case when a >= 0 and i >= 0 then least(a, i) when a < 0 and i < 0 then 100 else greatest(a, i) end b,
  case when k >= 0 and k < r and k > length(t) / 2 then k when r >= 0 then r else length(t) end e from q)
select doc_id, md5(substring(t, b + 1, greatest(e - b, 0))) text_md5 from s"""
)
def strip_sections(spark, d):
    i = F.col("doc_id") % 4
    j = F.col("doc_id") % 5
    text = F.concat(
        F.when(i.isin(0, 1), "Title Author Abstract ").otherwise("Title Author "),
        F.when(i.isin(1, 2), "Introduction ").otherwise(""),
        "text",
        F.when(j.isin(0, 1), " Acknowledgements thanks").otherwise(""),
        F.when(j.isin(1, 2, 3), " References [1] X").otherwise(""),
    )
    return corpus.strip_sections(documents(spark, d).select("doc_id", text.alias("text"))).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"with {SENTS_SQL} select doc_id, pos, sentence from sents")
def split_sentences(spark, d):
    return sents(spark, d)


@query(
    f"""with {SENTS_SQL}, c as (select doc_id, pos, case when pos % 3 = 1 then sentence || ' et al.' else sentence end s from sents),
g as (select *, case when ends_with(lag(s) over (partition by doc_id order by pos), 'et al.') then 0 else 1 end n from c),
i as (select *, sum(n) over (partition by doc_id order by pos) k from g)
select doc_id, cast(k - 1 as int) pos, string_agg(s, ' ' order by pos) sentence from i group by doc_id, k"""
)
def merge_et_al(spark, d):
    marked = F.array_join(F.transform(T.split_sentences("text"), lambda s, i: F.when(i % 3 == 1, F.concat(s, F.lit(" et al."))).otherwise(s)), "\n")
    return corpus.sentences(papers(spark, d).withColumn("text", marked), split=lambda t: F.split(t, "\n"), key="doc_id")


@query(r"select doc_id, md5(regexp_replace(replace(text, ' th', '- th'), '([\p{L}\p{N}_])-[ \t]+([\p{L}\p{N}_])', '\1\2', 'g')) text_md5 from documents")
def dehyphenate(spark, d):
    broken = documents(spark, d).select("doc_id", F.regexp_replace("text", " th", "- th").alias("text"))
    return cleaning.join_broken_words(broken).select("doc_id", F.md5("text").alias("text_md5"))


CITED = ("[12]", "[1, 2]", "[2020a]", "(Smith et al., 2020)", "(A 2019; B 2020)", "(a & b 2020)", "[llm2]", "(3)")
CITED_SQL = f"cited as (select doc_id, concat({sql_list(CITED)}[doc_id % 8 + 1], ' ', text) t from documents)"


def cited(spark, d):
    return documents(spark, d).select("doc_id", F.concat(F.get(F.array(*map(F.lit, CITED)), (F.col("doc_id") % 8).cast("int")), F.lit(" "), "text").alias("text"))


@query(f"with {CITED_SQL} select doc_id, md5(regexp_replace(t, '{CITATION.replace(chr(39), chr(39) * 2)}', '', 'g')) text_md5 from cited")
def strip_citations(spark, d):
    return cleaning.strip_citations(cited(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    f"""with {CITED_SQL}, l as (select doc_id, cast(i - 1 as int) line, b from (select doc_id, unnest(string_split(t, chr(10))) b, generate_subscripts(string_split(t, chr(10)), 1) i from cited)),
e as (select doc_id, line, b as before, regexp_replace(b, '{CITATION.replace(chr(39), chr(39) * 2)}', '', 'g') as after, len(regexp_extract_all(b, '{CITATION.replace(chr(39), chr(39) * 2)}')) n_found from l)
select 'citations' as stage, * from e where before <> after"""
)
def audit_edits(spark, d):
    found = cleaning.edits(cited(spark, d), "citations", T.strip_citations, CITATION, "doc_id")
    return found.withColumn("n_found", F.size("found")).drop("found")


def _abbreviated(spark, d):
    return documents(spark, d).select("doc_id", F.concat(F.lit("random test model (RTM). The RTM works, RTMs do. "), "text").alias("text"))


@query()
def abbreviation_pairs(spark, d):
    return cleaning.find_abbreviations(_abbreviated(spark, d)).select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.abbr", "p.definition")


@query()
def expand_abbreviations(spark, d):
    return cleaning.expand_abbreviations(_abbreviated(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))




def _spans(spark, d):
    i = F.col("doc_id")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return documents(spark, d).select("doc_id", F.array(span(i % 7, i % 7 + 3), span(i % 5 + 4, i % 5 + 12), span(i % 3 + 6, i % 3 + 9)).alias("spans"))


SPANS_SQL = "spans as (select doc_id, [{'s': doc_id % 7, 'e': doc_id % 7 + 3}, {'s': doc_id % 5 + 4, 'e': doc_id % 5 + 12}, {'s': doc_id % 3 + 6, 'e': doc_id % 3 + 9}] sp from documents)"


@query(f"with {SPANS_SQL}, x as (select doc_id, unnest(sp) o, generate_subscripts(sp, 1) i, sp from spans) select doc_id, cast(i - 1 as int) pos, len(list_filter(sp, lambda p: p.s >= o.s and p.e <= o.e and (p.s <> o.s or p.e <> o.e))) > 0 as contains_another from x")
def coref_contains(spark, d):
    return _spans(spark, d).select("doc_id", F.posexplode(coref.contains_another(F.col("spans"))).alias("pos", "contains_another"))


@query(f"with {SPANS_SQL}, h as (select doc_id, list_filter(sp, lambda p: contains(substring(text, cast(p.s + 1 as int), cast(p.e - p.s as int)), 'on'))[1] h from spans join documents using (doc_id)) select doc_id, cast(h.s as int) head_start, cast(h.e as int) head_end from h")
def coref_head(spark, d):
    has = _spans(spark, d).join(documents(spark, d).select("doc_id", "text"), "doc_id")
    noun = F.transform("spans", lambda s: F.contains(F.substr("text", s["start"] + 1, s["end"] - s["start"]), F.lit("on")))
    return has.select("doc_id", coref.head(F.col("spans"), noun).alias("h")).select("doc_id", F.col("h.start").alias("head_start"), F.col("h.end").alias("head_end"))


def _capital_mentions(text: str) -> list[list[tuple[int, int]]]:
    """Stand-in for a model: equal capitalised words of a chunk refer to each other, and so do all that follow the first."""
    import re

    found = [m.span() for m in re.finditer(r"\b[A-Z][a-z]+\b", text)]
    return [found] if found else []


@query()
def coref_rewrite(spark, d):
    return cleaning.resolve_coreferences(documents(spark, d).select("doc_id", "text"), _capital_mentions).select("doc_id", F.md5("text").alias("text_md5"))


# --- claims


@query(f"with {SENTS_SQL} select doc_id, pos, sentence from sents where len({WORDS_SQL.format('sentence')}) > 5")
def min_len_sentences(spark, d):
    return claims.long_sentences(papers(spark, d), key="doc_id")


@query(f"with {SENTS_SQL} select doc_id, pos, md5(array_to_string(string_split(sentence, ''), ' ')) chars_md5 from sents where len({WORDS_SQL.format('sentence')}) > 5")
def spaced_chars(spark, d):
    return claims.with_chars(claims.long_sentences(papers(spark, d), key="doc_id")).select("doc_id", "pos", F.md5("chars").alias("chars_md5"))


_HITS = f"len(list_filter({WORDS_SQL.format('lower(sentence)')}, lambda x: list_contains({sql_list(plugins.CLAIM_CUES)}, regexp_replace(x, '[.,;:]$', ''))))"


@query(f"with {SENTS_SQL}, h as (select doc_id, pos, sentence, {_HITS} n from sents where len({WORDS_SQL.format('sentence')}) > 5), s as (select doc_id, pos, n / (n + 2.0::double) + least(length(sentence) / 10000.0::double, 0.1::double) sc from h) select doc_id, pos, round(sc, 6) score from s where sc > 0.005")
def claim_gate(spark, d):
    return claims.claims(papers(spark, d), 0.005, key="doc_id").select("doc_id", "pos", F.round("score", 6).alias("score"))


# --- triplets

LOWER_SQL = FX_SQL + ", lo as (select doc_id, pos, lower(subject) subject, lower(verb) verb, lower(object) object from fx)"
SHORT_SQL = LOWER_SQL + ", le as (select * from lo where length(subject) + length(verb) + length(object) < 60)"
_without = lambda c, words: f"array_to_string(list_filter({WORDS_SQL.format(c)}, lambda x: not list_contains({sql_list(words)}, x)), ' ')"
STOP_SQL = LOWER_SQL + f", st as (select * from (select doc_id, pos, {_without('subject', STOP_WORDS)} subject, case when len({WORDS_SQL.format('verb')}) > 1 then {_without('verb', LIGHT_VERBS)} else verb end verb, {_without('object', STOP_WORDS)} object from lo) where subject <> '' and object <> '')"
PLAIN_SQL = STOP_SQL + ", pl as (select doc_id, pos, " + ", ".join(f"regexp_replace({r}, '[^A-Za-z0-9\\- ]', '', 'g') {r}" for r in triplets.ROLES) + " from st)"
TAG_SQL = (
    "case when regexp_matches(x, '^[0-9.,-]+$') then 'CD' when regexp_matches(x, '^(the|a|an|this|that|these|those)$') then 'DT' when regexp_matches(x, '^(of|in|on|by|with|for|from|at|to|as)$') then 'IN' "
    "when regexp_matches(x, 'ly$') then 'RB' when regexp_matches(x, 'ing$') then 'VBG' when regexp_matches(x, 'ed$') then 'VBD' when regexp_matches(x, '(ous|ful|ive|al|able|ible|ic)$') then 'JJ' when regexp_matches(x, '[^s]s$') then 'NNS' else 'NN' end"
)
_tagged = lambda c, tags: f"list_filter({WORDS_SQL.format(c)}, lambda x: list_contains({sql_list(tags)}, {TAG_SQL}))"
TAGS_SQL = PLAIN_SQL + f", tg as (select doc_id, pos, {_tagged('subject', SUBJECT_TAGS)} s, verb, {_tagged('object', OBJECT_TAGS)} o from pl), po as (select doc_id, pos, array_to_string(s, ' ') subject, verb, array_to_string(o, ' ') object from tg where len(s) > 0 and len(o) > 0)"
LEMMA_SQL = (
    "case when length(x) < 4 then x " + " ".join(f"when x = '{a}' then '{b}'" for a, b in plugins.IRREGULAR.items()) + " when regexp_matches(x, '(ss|us|is)$') then x when regexp_matches(x, 'ies$') then regexp_replace(x, 'ies$', 'y') "
    "when regexp_matches(x, '(ch|sh|x|ss|z)es$') then regexp_replace(x, 'es$', '') when regexp_matches(x, 's$') then regexp_replace(x, 's$', '') else x end"
)
LEMMAS_SQL = TAGS_SQL + ", lm as (select doc_id, pos, " + ", ".join(f"array_to_string(list_transform({WORDS_SQL.format(r)}, lambda x: {LEMMA_SQL}), ' ') {r}" for r in triplets.ROLES) + " from po)"
_long = lambda c: f"array_to_string(list_filter({WORDS_SQL.format(c)}, lambda x: length(x) > 2), ' ')"
CLEAN_SQL = LEMMAS_SQL + f", cl as (select * from (select doc_id, pos, {_long('subject')} subject, regexp_replace(verb, ' +', ' ', 'g') verb, {_long('object')} object from lm) where length(subject) >= 3 and length(object) >= 3 and length(verb) >= 1)"
ROW = "doc_id, pos, subject, verb, object"


@query(f"with {LOWER_SQL} select {ROW} from lo")
def triplet_lower(spark, d):
    return triplets.lower_case(fx(spark, d))


@query(f"with {LOWER_SQL} select doc_id, pos, subject, verb, object || ' x y z' as object from lo where pos % 4 = 0 union all select {ROW} from lo where pos % 2 = 1 and len({WORDS_SQL.format('object')}) <= 6")
def triplet_length(spark, d):
    """Objects of six words stay, those of seven go."""
    more = F.when(F.col("pos") % 4 == 0, " x y z").when(F.col("pos") % 4 == 2, " w x y z").otherwise("")
    rows = triplets.lower_case(fx(spark, d)).withColumn("object", F.concat("object", more))
    return triplets.filter_length(rows, 6)


@query(f"with {STOP_SQL} select {ROW} from st")
def triplet_stopwords(spark, d):
    return triplets.remove_stop_words(triplets.lower_case(fx(spark, d)))


@query(f"with {PLAIN_SQL} select {ROW} from pl")
def triplet_charset(spark, d):
    return triplets.keep_plain_text(triplet_stopwords(spark, d))


@query(f"with {TAGS_SQL} select {ROW} from po")
def triplet_pos(spark, d):
    return triplets.filter_tags(triplet_charset(spark, d))


@query(f"with {TAGS_SQL} select doc_id, pos, case when len(s) = 0 then 'subject' when len(o) = 0 then 'object' end as fault from tg")
def triplet_pos_fault(spark, d):
    tags = triplet_charset(spark, d).select("doc_id", "pos", plugins.pos_tags(F.col("subject")).alias("s"), plugins.pos_tags(F.col("object")).alias("o"))
    return tags.select("doc_id", "pos", triplets.tag_fault(F.col("s"), F.col("o")).alias("fault"))


@query(f"with {LEMMAS_SQL} select {ROW} from lm")
def triplet_lemma(spark, d):
    return triplets.lemmatize(triplet_pos(spark, d))


@query(f"with {CLEAN_SQL} select {ROW} from cl")
def triplet_cleanup(spark, d):
    return triplets.normalise(fx(spark, d))


@query(
    f"with {CLEAN_SQL}, n as (select (select count(*) from lo) a, (select count(*) from st) b, (select count(*) from po) c, (select count(*) from cl) e) "
    "select * from (select 'stop words' as reason, a - b as n from n union all select 'tags', b - c from n union all select 'short', c - e from n union all select 'kept', e from n) where n > 0"
)
def removal_reasons(spark, d):
    return triplets.reasons(triplets.normalise(fx(spark, d), mark=True))


@query(f"with {FX_SQL} select doc_id, count(*) n_triplets, md5(string_agg(subject || '|' || verb || '|' || object, ';' order by pos)) triplets_md5 from fx group by doc_id union all select doc_id, 0, null from documents where doc_id not in (select doc_id from fx)")
def nest_triplets(spark, d):
    """Papers without triplets are kept."""
    lists = triplets.nest(fx(spark, d), documents(spark, d), "doc_id")
    text = F.array_join(F.transform("triplets", lambda t: F.concat_ws("|", *(t[r] for r in triplets.ROLES))), ";")
    return lists.select("doc_id", F.size("triplets").cast("long").alias("n_triplets"), F.when(F.size("triplets") > 0, F.md5(text)).alias("triplets_md5"))


@query(f"with {FX_SQL} select {ROW} from (select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as int) pos, subject, verb, object from fx)")
def csv_roundtrip(spark, d):
    """Lists of triplets written as CSV and read back."""
    import uuid

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.write_triplet_csv(triplets.nest(fx(spark, d), key="doc_id").withColumnRenamed("doc_id", "paper"), path)
    return triplets.unnest(files.triplet_csv(spark, path)).select(F.col("paper").cast("long").alias("doc_id"), "pos", *triplets.ROLES)


@query()
def svo_triplets(spark, d):
    return triplets.extract_triplets(claims.long_sentences(papers(spark, d), key="doc_id"), key="doc_id")


@query()
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", plugins.html_text(F.col("html")).alias("text"))


@query()
def processed_papers(spark, d):
    """Raw pages to sentences."""
    raw = table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("name"), F.col("html").alias("content"))
    return corpus.process_papers(raw)


# --- terms

TERMS_SQL = CLEAN_SQL + f", vocab as (select distinct term from (select unnest({WORDS_SQL.format(chr(34) + 'all' + chr(34))}) term from (select concat_ws(' ', subject, verb, object) as \"all\" from cl)) where length(term) > 1)"


def _df_sql(name: str, source: str, key: str, text: str, least: int, vocab: bool = True) -> str:
    return f"{name} as (select term, count(*) df from (select {key}, term, count(*) n from (select {key}, unnest({WORDS_SQL.format(text)}) term from {source}) {'where term in (select term from vocab)' if vocab else ''} group by all having n >= {least}) group by term)"


PREFIX = 0.3
BACKGROUND_SQL = "background as (select conv_id * 1000 + turn as id, text from conversations where length(text) < 30000), prefixed as (select * from background qualify row_number() over (order by id) <= (select floor(count(*) * 0.3::double) from background))"
SCORE_SQL = (
    TERMS_SQL + ", " + BACKGROUND_SQL + ", " + _df_sql("corpus_df", "prefixed", "id", "lower(text)", 2) + ", " + _df_sql("paper_df", "papers", "doc_id", "lower(text)", 5)
    + r""", scores as (select term, case when coalesce(p, 0) < 10 then cast('-inf' as double) when c is null then cast('inf' as double) else ln(p / (select count(*) from papers)::double) - ln(c / (select count(*) from background)::double) end score
  from (select term, df c from corpus_df) full outer join (select term, df p from paper_df) using (term)
  where not regexp_matches(term, '[!-/:-@\[-`{-~]') and not regexp_matches(term, '^[0-9]+$') and length(term) >= 2)"""
)
SHARE = 0.1
CUT_SQL = SCORE_SQL + ", cut as (select n, place, score as cut from (select score, row_number() over (order by score desc) - 1 r, count(*) over () n, cast(floor(count(*) over () * 0.1::double) as bigint) place from scores) where r = place)"
DOMAIN_SQL = CUT_SQL + f""", good as (select distinct subject from (select subject, unnest({WORDS_SQL.format('subject')}) term from (select distinct subject from cl)) s left join scores using (term) where coalesce(score, cast('-inf' as double)) >= (select cut from cut))"""


def normal(spark, d):
    return triplets.normalise(fx(spark, d))


def background(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _dfs(spark, d, rows=None):
    vocab = cut(terms.vocabulary(normal(spark, d) if rows is None else rows), "vocabulary")
    texts = corpus.shorter_than(background(spark, d), 30_000)
    return terms.document_frequency(terms.first_share(texts, "id", PREFIX), vocab, 2, key="id"), terms.document_frequency(papers(spark, d), vocab, 5, key="doc_id")


def _scores(spark, d, rows=None):
    return terms.term_scores(*_dfs(spark, d, rows), background(spark, d).where(F.length("text") < 30_000).count(), papers(spark, d).count())


def _flags(spark, d):
    rows = cut(normal(spark, d), "triplets")
    return terms.domain_flags(rows, _scores(spark, d, rows), SHARE)


@query(f"with {TERMS_SQL} select term from vocab")
def vocabulary(spark, d):
    return terms.vocabulary(normal(spark, d))


@query(f"with {TERMS_SQL}, {BACKGROUND_SQL}, {_df_sql('corpus_df', 'prefixed', 'id', 'lower(text)', 2)} select term, df from corpus_df")
def corpus_df(spark, d):
    return _dfs(spark, d)[0]


@query(f"with {TERMS_SQL}, {_df_sql('paper_df', 'papers', 'doc_id', 'lower(text)', 5)} select term, df from paper_df")
def paper_df(spark, d):
    return _dfs(spark, d)[1]


@query(f"with {_df_sql('g', 'documents', 'doc_id', 'text', 6, False)} select term, df from g")
def generic_counts(spark, d):
    return terms.generic_counts(documents(spark, d), "doc_id")


_FINITE = "case when isinf(score) then null else round(score, 6) end as score, case when score = cast('inf' as double) then 1 when score = cast('-inf' as double) then -1 else 0 end as infinite"


def _finite(scores: DataFrame) -> DataFrame:
    inf = F.abs("score") == float("inf")
    return scores.select("term", F.when(~inf, F.round("score", 6)).alias("score"), F.when(inf, F.signum("score")).otherwise(0).cast("int").alias("infinite"))


@query(f"with {SCORE_SQL} select term, {_FINITE} from scores")
def term_scores(spark, d):
    return _finite(_scores(spark, d))


@query(f"with {CUT_SQL} select n, place, case when isinf(cut) then null else round(cut, 6) end as cut from cut")
def term_cut(spark, d):
    return terms.top_cut(_scores(spark, d), SHARE).withColumn("cut", F.when(F.abs("cut") != float("inf"), F.round("cut", 6)))


@query(f"with {DOMAIN_SQL} select {ROW} from cl where subject in (select subject from good)")
def domain_filter(spark, d):
    return _flags(spark, d).where("domain").drop("domain")


@query(f"with {DOMAIN_SQL} select {ROW} from cl where subject not in (select subject from good)")
def domain_removed(spark, d):
    return _flags(spark, d).where("not domain").drop("domain")


@query(f"with {CLEAN_SQL}, {_df_sql('g', 'papers', 'doc_id', 'text', 6, False)} select {ROW} from cl left join g on g.term = cl.subject where coalesce(g.df, 0) < 5")
def generic_filter(spark, d):
    return terms.drop_generic(normal(spark, d), terms.generic_counts(papers(spark, d), "doc_id"))


# --- clusters of triplets: a phrase's cluster is its digest's, as a given labelling

OWN_SQL = FX_SQL + ", own as (select distinct doc_id as paper, subject, verb, object from fx)"
SUB_SQL, OBJ_SQL = (HASH_SQL.format(c) + " % 400" for c in ("subject", "object"))
ROLES4 = "paper, subject, verb, object"
CLUSTERED_SQL = OWN_SQL + f", clustered as (select {SUB_SQL} sub_cluster, {OBJ_SQL} obj_cluster, {ROLES4} from own)"
CATEGORY_SQL = "cat as (select doc_id as paper, case when cast(substr(source, 4) as int) % 2 = 0 then 'cs' else 'quant' end category from documents)"


def own(spark, d):
    return clusters.distinct_triplets(fx(spark, d).withColumnRenamed("doc_id", "paper"))


def labelled(phrases: DataFrame, role: str) -> DataFrame:
    return phrases.where(F.col("role") == role).select("term", (hashed("term") % 400).alias("cluster"))


def clustered(spark, d, by: str = "subj_obj"):
    rows = cut(own(spark, d), "triplets")
    phrases = clusters.distinct_phrases(rows)
    return clusters.cluster_triplets(rows, labelled(phrases, "subject") if by != "obj" else None, labelled(phrases, "object") if by != "subj" else None)


def categories(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("paper"), F.when(F.substr("source", F.lit(4)).cast("int") % 2 == 0, "cs").otherwise("quant").alias("category"))


def grouped(spark, d):
    return clustered(spark, d).withColumn("cluster", F.concat_ws("-", "sub_cluster", "obj_cluster")).drop("sub_cluster", "obj_cluster")


@query(f"with {OWN_SQL} select {ROLES4} from own")
def dedupe_triplets(spark, d):
    return own(spark, d)


@query(f"with {OWN_SQL} select distinct role, term from (select 'subject' as role, subject as term from own union all select 'verb', verb from own union all select 'object', object from own)")
def distinct_phrases(spark, d):
    return clusters.distinct_phrases(own(spark, d))


def _members(keys: str) -> str:
    return f"with {CLUSTERED_SQL} select {keys}, count(*) n_members, md5(string_agg(concat_ws('|', subject, verb, object, paper), ';' order by subject, verb, object, paper)) members_md5 from clustered group by {keys}"


def _digest(members: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("members", lambda m: F.concat_ws("|", *(m[c].cast("string") for c in (*triplets.ROLES, "paper")))), ";")
    return members.select(*members.columns[:-1], F.size("members").cast("long").alias("n_members"), F.md5(text).alias("members_md5"))


@query(_members("sub_cluster"))
def cluster_by_subject(spark, d):
    return _digest(clusters.members(clustered(spark, d, "subj")))


@query(_members("obj_cluster"))
def cluster_by_object(spark, d):
    return _digest(clusters.members(clustered(spark, d, "obj")))


@query(_members("sub_cluster, obj_cluster"))
def cluster_by_both(spark, d):
    return _digest(clusters.members(clustered(spark, d)))


@query(f"with {NAMES_SQL} select replace(name, '.pdf', '.txt') as paper, case when bool_or(doc_id % 2 = 1) then 'quant' else 'cs' end as category from (select name, doc_id from names union all select name, doc_id + 1 from names where doc_id % 6 = 0) group by name")
def category_map(spark, d):
    """Every file is in one folder, by its document's number (names hold five digits of a third of it), and some are in both: those count as of the second."""
    i = F.col("doc_id")
    named = names(spark, d, "doc_id")
    return files.categories_of(named.where(i % 2 == 0), named.where((i % 2 == 1) | (i % 6 == 0)))


GROUPED_SQL = CLUSTERED_SQL + ", " + CATEGORY_SQL + ", grouped as (select concat_ws('-', sub_cluster, obj_cluster) as cluster, " + ROLES4 + ", category = 'cs' as f from clustered join cat using (paper))"
_KIND_SQL = "select cluster, 'first' as kind, n1 as size from {0} where n1 > 1 union all select cluster, 'other', n2 from {0} where n2 > 1 union all select cluster, 'mixed', n1 + n2 from {0} where n1 > 0 and n2 > 0 and n1 / (n1 + n2)::double > 0.25 and n2 / (n1 + n2)::double > 0.25"
COUNTS_SQL = GROUPED_SQL + ", per_paper as (select cluster, paper, any_value(f) f, count(*) n from grouped group by cluster, paper), counts as (select cluster, count(*) filter (f) n1, count(*) filter (not f) n2, product(n) choices from per_paper group by cluster), kinds as (" + _KIND_SQL.format("counts") + ")"
WHOLE_SQL = GROUPED_SQL + ", counts as (select cluster, count(*) filter (f) n1, count(*) filter (not f) n2 from grouped group by cluster), kinds as (" + _KIND_SQL.format("counts") + ")"
#: Each choice of one triplet a paper, built paper by paper.
CHOICES_SQL = COUNTS_SQL + """, ranked as (select *, dense_rank() over (partition by cluster order by paper) r, concat_ws('|', subject, verb, object, paper) m from grouped),
tree as (with recursive tree(cluster, r, ms, fs, vs) as (
  select cluster, r, [m], [f], [verb] from ranked where r = 1 union all
  select t.cluster, x.r, list_append(t.ms, x.m), list_append(t.fs, x.f), list_append(t.vs, x.verb) from tree t join ranked x on x.cluster = t.cluster and x.r = t.r + 1) select * from tree),
choices as (select t.* from tree t join (select cluster, max(r) r from ranked group by cluster) using (cluster, r))"""


@query(COUNTS_SQL.join(("with ", " select kind, cast(size as int) as size, sum(choices) as n_groups from kinds join counts using (cluster) group by kind, size")))
def fair_group_sizes(spark, d):
    return groups.group_sizes(grouped(spark, d), categories(spark, d))


@query("with " + WHOLE_SQL + " select kind, cast(size as int) as size, cluster || '#0' as group_id, cast((select count(*) from grouped g where g.cluster = k.cluster and (kind = 'mixed' or (kind = 'first') = g.f)) as bigint) as n_members from kinds k")
def fair_groups_cluster(spark, d):
    return groups.fair_groups(grouped(spark, d), categories(spark, d), one_per_paper=False).select("kind", "size", "group_id", F.size("members").cast("long").alias("n_members"))


@query(
    "with " + CHOICES_SQL + ", parts as (select k.kind, k.size, list_filter(list_zip(ms, fs), lambda z: k.kind = 'mixed' or z[2] = (k.kind = 'first')) z from choices c join kinds k using (cluster)) "
    "select kind, cast(size as int) as size, array_to_string(list_transform(z, lambda y: y[1]), ';') as members from parts"
)
def fair_groups_one_per_paper(spark, d):
    found = groups.fair_groups(grouped(spark, d), categories(spark, d))
    return found.select("kind", "size", F.array_join(F.transform("members", lambda m: F.concat_ws("|", *(m[c].cast("string") for c in (*triplets.ROLES, "paper")))), ";").alias("members"))


# --- spread

VECTORS_SQL = "vecs as (select term, embedding from (select distinct verb as term from own) join embeddings on vec_id = " + HASH_SQL.format("term") + " % 500)"


def verb_vectors(spark, d):
    """(term, embedding) of the verbs: the vector that a verb's digest names."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    terms_ = own(spark, d).select(F.col("verb").alias("term")).distinct().withColumn("vec_id", hashed("term") % 500)
    return terms_.join(vectors, "vec_id").select("term", "embedding")


def _pairs_sql(mixed: bool) -> str:
    keep = "list_filter(list_zip(vs, fs), lambda z: k.kind = 'mixed' or z[2] = (k.kind = 'first'))"
    return f"mem as (select row_number() over () g, k.kind, k.size, unnest({keep}) z, generate_subscripts({keep}, 1) i from choices c join kinds k using (cluster) where k.kind {'=' if mixed else '<>'} 'mixed'), e as (select g, kind, size, i, z[2] f, embedding from mem join vecs on term = z[1])"


def _spread_sql(mixed: bool, agg: str) -> str:
    on = "a.f and not b.f" if mixed else "a.i <> b.i"
    return "with " + CHOICES_SQL + ", " + VECTORS_SQL + ", " + _pairs_sql(mixed) + f", s as (select a.kind, a.size, a.g, {agg.format('list_distance(a.embedding::double[], b.embedding::double[])')} sp from e a join e b on a.g = b.g and {on} group by all) select kind, cast(size as int) as size, round(avg(sp), 6) as spread from s group by kind, size"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("spread", F.round("spread", 6))


def _spread(spark, d, method: str):
    return spread.choice_spread(grouped(spark, d), categories(spark, d), verb_vectors(spark, d), method)


@query(_spread_sql(False, "avg({})"))
def spread_mean(spark, d):
    return _rounded(_spread(spark, d, "mean")).where("kind <> 'mixed'")


@query(_spread_sql(False, "quantile_cont({}, 0.75)"))
def spread_q3(spark, d):
    return _rounded(_spread(spark, d, "third_quartile")).where("kind <> 'mixed'")


@query(_spread_sql(True, "avg({})"))
def spread_mixed(spark, d):
    return _rounded(_spread(spark, d, "mean")).where("kind = 'mixed'")


@query(_spread_sql(False, "avg({})") + " union all (" + _spread_sql(True, "avg({})") + ")")
def diameter_all(spark, d):
    """All kinds at once, without making a group."""
    return _rounded(spread.mean_spread(grouped(spark, d), categories(spark, d), verb_vectors(spark, d)))


@query("select a.label, a.vec_id as a, b.vec_id as b, round(1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) as distance from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id")
def pairwise_cosine(spark, d):
    return spread.pair_distances(table(spark, d, "embeddings"), "label", metric="cosine").withColumn("distance", F.round("distance", 6))


@query("select a.label, a.vec_id as a, b.vec_id as b, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as distance from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id")
def pairwise_l2(spark, d):
    return spread.pair_distances(table(spark, d, "embeddings"), "label").withColumn("distance", F.round("distance", 6))


@query("select label, round(quantile_cont(d, 0.75), 6) as spread from (select a.label, list_distance(a.embedding::double[], b.embedding::double[]) d from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id) group by label")
def label_quartile(spark, d):
    vectors = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("place"), "embedding")
    return _rounded(spread.group_distances(vectors, ["label"], method="third_quartile"))


@query()
def upgma_clusters(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("term"), "embedding")
    return clusters.linkage_cut(vectors, 0.65)


@query()
def phrase_embeddings(spark, d):
    return clusters.phrase_embeddings(clusters.distinct_phrases(own(spark, d)))
