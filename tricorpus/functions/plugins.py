"""Models as plug-ins: each has a fixed signature and a deterministic default that needs no files.

A plug-in is a function Column -> Column. `from_python` wraps a plain function on lists of values as one, run over slices of Arrow batches.
The defaults are stand-ins for trained models: they keep the contract (types, gates, order), not a model's answers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from . import text as T

TRIPLET_WORDS = "array<struct<subject:array<string>,verb:array<string>,object:array<string>>>"
Plugin = Callable[[Column], Column]


SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def slices(values: pa.Array) -> Iterator[pa.Array]:
    """The values in parts of at most SLICE_ROWS, and of about SLICE_BYTES where there are several in one."""
    at = 0
    while at < len(values):
        n = min(SLICE_ROWS, len(values) - at)
        while n > 1 and values.slice(at, n).nbytes > SLICE_BYTES:
            n //= 2
        yield values.slice(at, n)
        at += n


def from_python(function: Callable[[list], list], returns: str) -> Plugin:
    """A plug-in from a function that maps a list of values to a list of results of the same length. It gets few values at a time, so that not a whole
    batch is there as Python objects."""

    def use(c: Column) -> Column:
        kind = to_arrow_type(_parse_datatype_string(returns))

        @F.arrow_udf(returns)
        def run(values: pa.Array) -> pa.Array:
            made = [pa.array(function(part.to_pylist()), kind) for part in slices(values)]
            return pa.concat_arrays(made) if made else pa.array([], kind)

        return run(c)

    return use


# language of a text: the language with most of its words among the text's first 1300 characters, "err" if none has any
COMMON = {
    "en": "the of and is to in that it was for with are on as",
    "de": "der die und das ist nicht von mit zu ein eine den im auf",
    "fr": "le la les des est et dans pour qui sur une par que au",
    "es": "el los las y en que por con una para del es se lo",
}


def language(text: Column) -> Column:
    words = T.tokens(F.lower(F.substr(text, F.lit(1), F.lit(1300))))

    def vote(place: int, name: str, common: str) -> Column:
        n = F.size(F.filter(words, lambda w: w.isin(common.split())))
        return F.struct(n.alias("n"), F.lit(-place).alias("place"), F.lit(name).alias("name"))

    best = F.greatest(*(vote(i, k, s) for i, (k, s) in enumerate(COMMON.items())))
    return F.when(best["n"] > 0, best["name"]).otherwise("err")


CLAIM_CUES = tuple("show shows demonstrate propose proposed find found outperform outperforms improve improves achieve achieves suggest suggests result results significantly therefore better".split())


def claim_score(claim: Column) -> Column:
    """From the fields sentence and chars of `claim`: how claim-like a sentence is, from 0 to 1, by its words."""
    hits = F.size(F.filter(T.tokens(F.lower(claim["sentence"])), lambda w: F.regexp_replace(w, "[.,;:]$", "").isin(*CLAIM_CUES)))
    return T.let(hits, lambda n: n / (n + F.lit(2.0))) + F.least(F.length(claim["sentence"]) / 10000.0, F.lit(0.1))


_VERB_END = r"(ed|es|ing|ize|izes|ise|ises|ify|ifies)$"


def triplets(sentence: Column) -> Column:
    """Subject, verb and object word lists: cut around the first word with a verb's ending that has words on both sides."""

    def cut(words: Column) -> Column:
        inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w.rlike(_VERB_END))
        return T.let(F.array_position(inner, True).cast("int"), lambda at: F.when(at > 0, F.array(F.struct(F.slice(words, 1, at).alias("subject"), F.array(F.get(words, at)).alias("verb"), F.slice(words, at + 2, F.size(words)).alias("object")))))

    return F.coalesce(T.let(T.tokens(F.regexp_replace(sentence, "[.!?]+$", "")), cut), F.array().cast(TRIPLET_WORDS))


def positional_triplets(sentence: Column) -> Column:
    """Words 1-2, 3 and 4-6 of sentences of over five words: a stand-in that every SQL engine can repeat."""
    three = lambda w: F.when(F.size(w) > 5, F.array(F.struct(F.slice(w, 1, 2).alias("subject"), F.slice(w, 3, 1).alias("verb"), F.slice(w, 4, 3).alias("object"))))
    return F.coalesce(T.let(T.tokens(sentence), three), F.array().cast(TRIPLET_WORDS))


def pos_tags(phrase: Column) -> Column:
    """(word, tag) of each word, by endings."""

    def tag(w: Column) -> Column:
        return (
            F.when(w.rlike("^[0-9.,-]+$"), "CD")
            .when(w.rlike("^(the|a|an|this|that|these|those)$"), "DT")
            .when(w.rlike("^(of|in|on|by|with|for|from|at|to|as)$"), "IN")
            .when(w.rlike("ly$"), "RB")
            .when(w.rlike("ing$"), "VBG")
            .when(w.rlike("ed$"), "VBD")
            .when(w.rlike("(ous|ful|ive|al|able|ible|ic)$"), "JJ")
            .when(w.rlike("[^s]s$"), "NNS")
            .otherwise("NN")
        )

    return F.transform(T.tokens(phrase), lambda w: F.struct(w.alias("word"), tag(w).alias("tag")))


IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "mice": "mouse", "data": "datum", "criteria": "criterion", "analyses": "analysis", "matrices": "matrix"}


def lemma(word: Column) -> Column:
    """Nouns' singular by endings and a few exceptions."""
    out = F.when(F.length(word) < 4, word)
    for many, one in IRREGULAR.items():
        out = out.when(word == many, F.lit(one))
    return (
        out.when(word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|x|ss|z)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def embed(phrase: Column, width: int = 64) -> Column:
    """Unit vector of hashed character trigrams."""
    import numpy as np

    def run(values: list) -> list:
        out = []
        for v in values:
            s = f"  {v or ''}  "
            x = np.zeros(width)
            for i in range(len(s) - 2):
                h = zlib.crc32(s[i : i + 3].encode())
                x[h % width] += 1 if h >> 31 else -1
            n = float(np.sqrt((x * x).sum()))
            out.append((x / n if n else x).astype(np.float32).tolist())
        return out

    return from_python(run, "array<float>")(phrase)


def no_coreferences(text: Column) -> Column:
    return F.array().cast("array<array<struct<start:int,end:int>>>")


def strip_tags(page: str) -> str:
    """A page without scripts, styles and tags, each character looked at once: what isn't closed isn't looked for again."""
    out, at, missing = [], 0, set()
    while opened := _BLOCK_START.search(page, at):
        kind = opened[1].lower()
        closed = None if kind in missing else _BLOCK_END[kind].search(page, opened.end())
        if closed:
            out += [page[at : opened.start()], " "]
        else:
            missing.add(kind)
            out.append(page[at : opened.end()])
        at = closed.end() if closed else opened.end()
    page = "".join([*out, page[at:]])
    out, at = [], 0
    while (a := page.find("<", at)) >= 0 and (b := page.find(">", a)) >= 0:
        out += [page[at:a], " "]
        at = b + 1
    return re.sub(r"[ \t]+", " ", "".join([*out, page[at:]])).strip()


_BLOCK_START = re.compile(r"(?i)<(script|style)\b")
_BLOCK_END = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style")}


def html_text(content: Column) -> Column:
    """Text of an HTML page, or of bytes that hold one: tags, scripts and styles dropped."""
    return extracted(strip_tags)(content)


def extracted(extract: Callable[[str], str]) -> Plugin:
    """A plug-in for texts of files, from a function of one page's text; a file on which it fails has an empty text."""

    def run(values: list) -> list:
        out = []
        for v in values:
            try:
                out.append(extract(v.decode("utf-8", "replace") if isinstance(v, bytes | bytearray) else v or ""))
            except Exception:  # noqa: BLE001  one bad file must not end the others' work
                out.append("")
        return out

    return from_python(run, "string")


def detected(detect: Callable[[str], str], sizes: tuple[int, ...] = (1300, 514)) -> Plugin:
    """A language plug-in from a detector of one text: it gets the first characters of the text, fewer where it fails, and the label is "err" where
    it fails each time."""

    def one(text: str) -> str:
        for n in sizes:
            try:
                return detect(text[:n])
            except Exception:  # noqa: BLE001  detectors fail on texts they can't tell
                continue
        return "err"

    return from_python(lambda values: [one(v or "") for v in values], "string")
