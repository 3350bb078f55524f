"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask looks at some of the words of a window and ignores the others; the words it looks at are hashed, so a window whose
ignored words were replaced still has the same hash. Hashes of all windows of the documents are joined with those of the
benchmark; each hit fixes an alignment (document word minus item word), and the words on it are compared: an
item is found in a document if some `window` aligned words (the whole item, if shorter) are equal but for `substitutions` of them.

With the three MASKS no allowed pattern of replaced words is missed in items of 8 words and more; shorter items have masks of their own, used only where
the benchmark has such items (a test enumerates all patterns). `contaminated` leaves items of fewer than `least` words out; the query and the
pipeline's stage search every item that has a word.

Words here are runs of letters and digits, in lower case. The hashes of the benchmark are broadcast only where Spark's own
size limit allows; else both sides are shuffled by hash, as short rows without text.

Candidates are kept by the text, not by the id, and gathered for each text, so a text is split once however many hits it has.

Result, one row for each document and item: doc_id, item_id, start_word (where the item's first word lies or would lie),
item_words, equal_words (on the alignment), window_words and window_equal (of its best window). Nulls: a null text has no
words; rows with a null id are searched, and the id in the result is null. Repeated rows or ids give one result row with their best
alignment. Empty tables give an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, plain_docs, real_id

MASKS = ("110111", "1101000111", "11001011")
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11011", "10111", "11101"), 6: ("1111", "11011"), 7: ("1111", "11011")}
SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def masks_for(words: int) -> tuple[str, ...]:
    """The masks that find items of so many words: the first two are enough for all but some lengths."""
    return SHORT[words] if words in SHORT else MASKS if words in (8, 10, 11, 15) else MASKS[:2]


def seeds(rows: DataFrame, row_id: str, masks: list[str]) -> DataFrame:
    """(row_id, pos, seed) of all masked windows of rows(row_id, words)."""
    at = rows.select(row_id, "words", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "word"))  # outer: else Spark filters on size(words) first, splitting texts twice
    hashes = [F.when(F.col("pos") + len(m) <= F.col("n"), F.xxhash64(F.lit(m), *(F.get("words", F.col("pos") + i) for i, c in enumerate(m) if c == "1"))) for m in masks]
    return at.select(row_id, "pos", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, substitutions: float, least: int) -> DataFrame:
    """(doc_id, text_key, item_id, s) of docs(doc_id, text): every alignment that has enough equal words."""
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") >= max(1, least)).distinct()
    keyed = items.select(F.xxhash64("item_id", "words").alias("item_key"), "item_id", F.col("words").alias("item"))
    short = items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect()  # under `window` numbers
    masks = list(dict.fromkeys(m for n in sorted({window} | {r.n for r in short}) for m in masks_for(n)))
    item_seeds = seeds(keyed.select("item_key", F.col("item").alias("words")), "item_key", masks).select("item_key", F.col("pos").alias("item_pos"), "seed")
    hits = seeds(docs.select("text_key", words_of("text").alias("words")), "text_key", masks).join(item_seeds, "seed")
    aligned = hits.select("text_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("start")).distinct().join(keyed.select("item_key", F.size("item").alias("n")), "item_key")
    of_text = aligned.groupBy("text_key").agg(F.collect_list(F.struct("item_key", "start", "n")).alias("hits"))
    # a generator, so that Spark doesn't split the text anew for each hit; then the aligned words alone, so that no row carries a long text on
    split = docs.join(of_text, "text_key").select("doc_id", "text_key", "hits", F.explode(F.array(words_of("text"))).alias("words"))
    lead = lambda h: F.greatest(-h["start"], F.lit(0))
    part = lambda h: F.slice("words", F.greatest(h["start"], F.lit(0)) + 1, F.greatest(h["n"] - lead(h), F.lit(0)))
    parts = split.select("doc_id", "text_key", F.explode(F.transform("hits", lambda h: F.struct(h["item_key"].alias("item_key"), h["start"].alias("start"), lead(h).alias("lead"), part(h).alias("part")))).alias("h"))
    both = parts.select("doc_id", "text_key", "h.*").join(keyed, "item_key")
    equal = F.zip_with(F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("lead")), "part"), "item", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    scored = both.select("doc_id", "text_key", "item_id", "start", F.size("item").alias("item_words"), F.least(F.size("item"), F.lit(window)).alias("w"), equal.alias("e"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("item_words") - F.col("w") + 1), lambda i: total(F.slice("e", i, F.col("w")))))
    s = F.struct(best.alias("window_equal"), total("e").alias("equal_words"), (-F.col("start")).alias("back"), "item_words", F.col("w").alias("window_words"))
    return scored.select("doc_id", "text_key", "item_id", s.alias("s")).where(F.col("s.window_equal") >= F.ceil(F.col("s.window_words") * F.lit(1 - substitutions)))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 16, substitutions: float = 0.2, least: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = _found(plain_docs(docs, id_col, text_col), benchmark, window, substitutions, least).groupBy("doc_id", "item_id").agg(F.max("s").alias("s"))
    return found.select(real_id(), "item_id", (-F.col("s.back")).alias("start_word"), *(f"s.{c}" for c in ("item_words", "equal_words", "window_words", "window_equal")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 16, substitutions: float = 0.2, least: int = 1) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with all their columns; each row is judged by its own text."""
    # written first, so that its size is known: Spark broadcasts it where it is small, and need not shuffle whole texts for it
    bad = cut(_found(plain_docs(docs), benchmark, window, substitutions, least).select(F.col("text_key").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__bad"], "left_anti")


#: DuckDB SQL for contaminated(documents, benchmark, least=1) from the definition, without seeds: all alignments with enough equal words.
ORACLE_ALL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
b as (select item_id, w, len(w) n, row_number() over () k from (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark) where len(w) >= 1),
dp as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from d),
bp as (select k, item_id, n, unnest(range(1, n + 1)) p, unnest(w) x from b),
e as (select doc_id, k, item_id, n, dp.p - bp.p st, bp.p j from dp join bp on dp.x = bp.x),
al as (select doc_id, k, item_id, n, st, count(*) te, list(j) js from e group by all having count(*) >= ceil(least(n, 16) * 0.8)),
wn as (select *, unnest(range(1, n - least(n, 16) + 2)) a from al),
bw as (select doc_id, item_id, n, st, te, max(len(list_filter(js, lambda j: j >= a and j < a + 16))) ws from wn group by all),
ok as (select *, row_number() over (partition by doc_id, item_id order by ws desc, te desc, st) r from bw where ws >= ceil(least(n, 16) * 0.8))
select doc_id, item_id, cast(st as int) start_word, cast(n as int) item_words, cast(te as int) equal_words, cast(least(n, 16) as int) window_words, cast(ws as int) window_equal from ok where r = 1
"""

#: DuckDB SQL for contaminated(documents, benchmark) with the parameters above; seeds are compared as the words themselves.
ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
b as (select distinct item_id, w from (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark) where len(w) >= 8),
dp as (select doc_id, w, unnest(range(1, len(w) + 1)) p from d),
bp as (select item_id, w, unnest(range(1, len(w) + 1)) p from b),
ds as (
  select doc_id, p, 0 k, concat_ws(' ', w[p], w[p+1], w[p+3], w[p+4], w[p+5]) s from dp where p + 5 <= len(w)
  union all select doc_id, p, 1, concat_ws(' ', w[p], w[p+1], w[p+3], w[p+7], w[p+8], w[p+9]) from dp where p + 9 <= len(w)),
bs as (
  select item_id, p, 0 k, concat_ws(' ', w[p], w[p+1], w[p+3], w[p+4], w[p+5]) s from bp where p + 5 <= len(w)
  union all select item_id, p, 1, concat_ws(' ', w[p], w[p+1], w[p+3], w[p+7], w[p+8], w[p+9]) from bp where p + 9 <= len(w)),
al as (select distinct ds.doc_id, bs.item_id, ds.p - bs.p st from ds join bs on ds.s = bs.s and ds.k = bs.k),
jj as (select al.doc_id, al.item_id, al.st, b.w iw, d.w dw, unnest(range(1, len(b.w) + 1)) j from al join b using (item_id) join d using (doc_id)),
eq as (select doc_id, item_id, st, len(iw) n, j, case when st + j >= 1 and st + j <= len(dw) and dw[st + j] = iw[j] then 1 else 0 end e from jj),
wn as (select *, least(n, 16) lw, sum(e) over (partition by doc_id, item_id, st order by j rows between current row and 15 following) s, sum(e) over (partition by doc_id, item_id, st) te from eq),
bw as (select doc_id, item_id, st, n, lw, te, max(s) ws from wn where j <= n - lw + 1 group by all),
ok as (select *, row_number() over (partition by doc_id, item_id order by ws desc, te desc, st) r from bw where ws >= ceil(lw * 0.8))
select doc_id, item_id, cast(st as int) start_word, cast(n as int) item_words, cast(te as int) equal_words, cast(lw as int) window_words, cast(ws as int) window_equal from ok where r = 1
"""
