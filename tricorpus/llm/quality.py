"""Quality rules: distribution divergence from language references, over plain text counts.

Each language has two reference histograms, both means over its documents of at least `min_words` words, in whole parts per
million so that sums don't depend on order: the shares of character classes, and the shares of the language's common words
(those in at least `common_share` of its documents) with all other words as one. A document whose Jensen-Shannon distance
to its language's reference passes a limit is rejected. Guard: documents of under `min_words` words are not judged by
divergence. Every language is judged: the limits rise by slack / sqrt(n) both in the words of the document and in the documents of the reference,
as small samples stray further, and a language of one document is its own reference. A language has at most (mean distinct words of a
document) / common_share common words. The references of languages with a thousandth of all documents or more (so at most a thousand) are sent to the executors; those
of smaller languages, however many, are joined to their documents, with the same verdicts.

The base rule rejects documents of fewer than 10 words, and those with over a fifth of their words in repeated 5-word windows.

Nulls: a null text has no words (rejected by the base rule); a null or unknown lang is a language of its own name ''. Every
row gives one result row, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, WordHashes, byte_texts, cut, positions, row_slices

STRIP = b".,;:!?\"'()"
SPACE = [0x20, 9, 10, 11, 12, 13]
SYMBOLS = list(b"#*$%&|<>")
#: Character classes by first UTF-8 byte: lower, upper, digit, space, symbol, other ASCII, beyond ASCII; 7: later bytes.
CLASSES = 7
_CLASS = np.full(256, 5)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[SPACE], _CLASS[SYMBOLS], _CLASS[0xC0:], _CLASS[0x80:0xC0] = 3, 4, 6, 7
_TO_CLASS = np.eye(8, dtype=np.int64)[_CLASS]
MILLION = 1_000_000
CELLS = 1 << 18  # of a table of texts and common words


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    common_share: float = 0.1
    chars: float = 0.13
    words: float = 0.36
    chars_slack: float = 1.5  # the limits rise by slack / sqrt(n_words): small samples stray further
    words_slack: float = 2.0
    docs_slack: float = 0.4


def _byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def _word_counts(words: list[bytes]) -> dict[bytes, int]:
    """Counts of words in lower case (A-Z) without marks at their ends."""
    out: dict[bytes, int] = {}
    for w, n in Counter(words).items():
        w = w.strip(STRIP)
        out[w] = out.get(w, 0) + n
    return out


class Places(dict):
    """A word as it stands to the place of the common word that it is, remembered; all others have the last place."""

    limit = 1 << 17

    def __init__(self, common: dict[bytes, int]) -> None:
        self.common = common

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = at = self.common.get(word.lower().strip(STRIP), len(self.common))
        return at

    def counts(self, words: list[bytes]) -> np.ndarray:
        return np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), minlength=len(self.common) + 1)


def reference_counts(docs: DataFrame, limits: Limits) -> DataFrame:
    """(lang, kind, item, docs, ppm) over docs(lang, text): how many documents have the item, and the sum of its shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = 1 << 40  # a count of documents above 40 bits of shares, which hold those of a million documents
        sums: dict[tuple[str, str], dict[bytes, int]] = {}
        most = limit = 200_000

        def out() -> pa.RecordBatch:
            keys = [(lang, kind, w, v) for (lang, kind), of in sums.items() for w, v in of.items()]
            cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(2)] + [pa.array([k[2] for k in keys], pa.binary()).cast(pa.string())]
            batch = pa.RecordBatch.from_arrays([*cols, pa.array([k[3] // one for k in keys], pa.int64()), pa.array([k[3] % one for k in keys], pa.int64())], ["lang", "kind", "item", "docs", "ppm"])
            sums.clear()
            return batch

        done = 0
        for batch in row_slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), byte_texts(batch)):
                words = text.lower().split()
                if len(words) < limits.min_words:
                    continue
                done += 1
                of = sums.setdefault((lang, "docs"), {})
                of[b""] = of.get(b"", 0) + one
                classes = _byte_counts(text) @ _TO_CLASS
                of = sums.setdefault((lang, "class"), {})
                for i, c in enumerate((classes[:CLASSES] * MILLION // classes[:CLASSES].sum()).tolist()):
                    k = b"%d" % i
                    of[k] = of.get(k, 0) + one + c
                of = sums.setdefault((lang, "word"), {})
                get, size = of.get, len(words)
                for w, c in _word_counts(words).items():
                    of[w] = get(w, 0) + one + c * MILLION // size
            if done > most or sum(map(len, sums.values())) > limit:
                yield out()
                done = 0
        if sums:
            yield out()

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(run, "lang string, kind string, item string, docs long, ppm long")
    return rows.groupBy("lang", "kind", "item").agg(F.sum("docs").alias("docs"), F.sum("ppm").alias("ppm"))


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray, int]


def _reference(n: int, items: list) -> Reference:
    """Class shares, places of the common words, their shares and last that of all others, and n, from a language's n and (kind, item, docs, ppm)."""
    chars = np.zeros(CLASSES)
    for kind, item, _, ppm in items:
        if kind == "class":
            chars[int(item)] = ppm // n
    common = sorted((r for r in items if r[0] == "word"), key=lambda r: (-r[2], r[1]))
    words = np.array([r[3] // n for r in common], float)
    return chars, {r[1].encode(): i for i, r in enumerate(common)}, np.append(words, max(0, MILLION - words.sum())), n


def language_references(docs: DataFrame, limits: Limits) -> tuple[dict[str, Reference], DataFrame | None]:
    """References by language, and a table (__of, __chars, __items, __words, __n) of those of languages under a thousandth, if there are any."""
    counts = cut(reference_counts(docs, limits), "references")  # read several times below
    share = F.lit(limits.common_share)
    of = counts.where("kind = 'docs'").select("lang", F.col("docs").alias("n"))
    total, least = of.agg(F.sum("n"), F.min("n")).first()
    if not total:
        return {}, None
    picked = counts.where("kind <> 'docs'").join(of, "lang").where((F.col("kind") == "class") | (F.col("docs") >= share * F.col("n")))
    rows: dict[str, list] = {}
    size: dict[str, int] = {}
    for r in picked.where(1000 * F.col("n") >= total).toLocalIterator():
        rows.setdefault(r.lang, []).append((r.kind, r.item, r.docs, r.ppm))
        size[r.lang] = r.n
    out = {lang: _reference(size[lang], items) for lang, items in rows.items()}
    if 1000 * least >= total:
        return out, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_reference(n, [tuple(x.values()) for x in items]) for n, items in zip(batch.column("n").to_pylist(), batch.column("items").to_pylist())]
            cols = [[x[0].tolist() for x in found], [[w.decode() for w in x[1]] for x in found], [x[2].tolist() for x in found], [x[3] for x in found]]
            kinds = [pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *map(pa.array, cols, kinds)], ["__of", "__chars", "__items", "__words", "__n"])

    small = picked.where(1000 * F.col("n") < total).groupBy("lang", "n").agg(F.collect_list(F.struct("kind", "item", "docs", "ppm")).alias("items"))
    return out, cut(small.mapInArrow(run, "__of string, __chars array<double>, __items array<string>, __words array<double>, __n long"), "small-references")


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row's shares from the reference's."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(half / 2, 0))


def repeat_words(lists: list[list[bytes]], lens: np.ndarray, hashes: WordHashes, rolling: RollingHash, span: int = 5) -> np.ndarray:
    """For each text, its words in `span`-word windows that it has at least twice."""
    local, left = positions(lens)
    at = np.flatnonzero(left >= span)
    out = np.zeros(len(lens), np.int64)
    if not len(at):
        return out
    doc = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
    h = rolling.runs(rolling.prepare(hashes.of(lists, len(local))), at, span) + doc[at] * np.uint64(0x9FB21C651E98DF25)
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return out
    start = at[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
    edge = np.zeros(len(local) + span + 1, np.int32)
    edge[start] += 1
    np.subtract.at(edge, start + span, 1)
    inside = np.cumsum(edge[: len(local)]) > 0
    np.add.at(out, doc[inside].astype(np.int64), 1)
    return out


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double"


def judge(docs: DataFrame, references: dict[str, Reference], small: DataFrame | None, limits: Limits, carry: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The carried columns of each row with RESULT after them; small: the table of references that are not in `references`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    inner = docs.select(*carry, F.coalesce(F.col(lang_col), F.lit("")).alias("__lang"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), RollingHash(0xA0761D6478BD642F)
        places = {lang: Places(place) for lang, (_, place, _, _) in references.items()}
        joined: dict[str, tuple[Reference, Places]] = {}
        for batch in row_slices(batches, "__text", 1 << 20):
            texts = byte_texts(batch, "__text")
            lists = [x.split() for x in texts]
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            repeats = repeat_words(lists, lens, hashes, rolling)
            chars = np.stack([_byte_counts(x) for x in texts])
            classes = (chars @ _TO_CLASS)[:, :CLASSES]
            dup = [len(x) - len(set(x)) for x in ([line for line in t.split(b"\n") if line.strip()] for t in texts)]
            js = np.full((2, len(texts)), np.nan)
            known = np.ones(len(texts))
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column("__lang").to_pylist()):
                if lens[i] >= limits.min_words and (lang in references or ("__of" in batch.schema.names and batch.column("__of")[i].is_valid)):
                    by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                if lang in references:
                    (shares, _, words, n), place = references[lang], places[lang]
                else:
                    if lang not in joined:
                        if len(joined) >= 100:
                            joined.clear()
                        chars_of, items, words_of, n = (batch.column(c)[rows[0]].as_py() for c in ("__chars", "__items", "__words", "__n"))
                        at = {w.encode(): i for i, w in enumerate(items)}
                        joined[lang] = (np.array(chars_of), at, np.array(words_of), n), Places(at)
                    (shares, _, words, n), place = joined[lang]
                known[rows] = n
                js[0, rows] = js_distance(classes[rows], shares)
                some = max(1, CELLS // len(words))  # texts at once, so that short texts don't make large tables
                for at in range(0, len(rows), some):
                    js[1, rows[at : at + some]] = js_distance(np.stack([place.counts(lists[i]) for i in rows[at : at + some]]), words)
            root, more = np.sqrt(np.maximum(lens, 1)), limits.docs_slack / np.sqrt(known)
            failed = (lens < 10) | (100 * repeats > 20 * lens)
            odd = (js[0] > limits.chars + limits.chars_slack / root + more) | (js[1] > limits.words + limits.words_slack / root + more)  # not a number: not judged
            spaces = chars[:, SPACE].sum(axis=1)
            cols = [lens, classes.sum(axis=1) - spaces, chars[:, SYMBOLS].sum(axis=1), np.array(dup, np.int64), repeats, failed, ~failed & ~odd]
            arrays = [batch.column(c) for c in carry] + [pa.array(c) for c in cols] + [pa.array(np.round(x, 9), mask=np.isnan(x)) for x in js]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, *(x.split()[0] for x in RESULT.split(", "))])

    result = ", ".join(filter(None, [schema, RESULT]))
    if small is None:
        return inner.mapInArrow(run, result)
    large = F.col("__lang").isin(list(references))
    rest = inner.where(~large).join(small, F.col("__lang") == F.col("__of"), "left")
    return inner.where(large).mapInArrow(run, result).union(rest.mapInArrow(run, result))


def quality(docs: DataFrame, limits: Limits = Limits(), carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs' carried columns (doc_id by default) with counts, divergences and the verdict `kept`."""
    references, small = language_references(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), limits)
    return judge(docs, references, small, limits, ["doc_id"] if carry is None else carry, text_col, lang_col)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # whatever names docs has, none clashes with RESULT
    safe = docs.toDF(*own.values())
    judged = quality(safe, limits, list(own.values()), own["text"], own["lang"])
    return judged.where("kept").select(*(F.col(v).alias(k) for k, v in own.items()))
