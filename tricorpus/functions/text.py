"""Text expressions, all built from Spark SQL functions.

Null in, null out, unless said otherwise. White space is ASCII (space, tab, newline, return, form feed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CITATION, PUNCTUATION

WHITE = r"[ \t\n\r\f]+"
BROKEN_WORD = r"([\p{L}\p{N}_])-[ \t]+([\p{L}\p{N}_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(col(text), WHITE), lambda w: w != "")


def n_tokens(text: Column | str) -> Column:
    return F.size(tokens(text))


def first_index(text: Column, word: str) -> Column:
    """0-based place of the first occurrence, -1 if none."""
    return F.instr(text, word) - 1


def last_index(text: Column, word: str) -> Column:
    """0-based place of the last occurrence, -1 if none."""
    place = F.length(text) - F.length(F.substring_index(text, word, -1)) - len(word)
    return F.when(F.contains(text, F.lit(word)), place).otherwise(F.lit(-1))


def strip_sections(text: Column | str) -> Column:
    """The text from its first "abstract" or "introduction" (else from its 101st character) to its last "reference", or to its
    last "acknowledgement" if that stands before it and in the text's second half. Words are found in any case."""
    text = col(text)
    low = F.lower(text)
    a, i = first_index(low, "abstract"), first_index(low, "introduction")
    start = F.when((a >= 0) & (i >= 0), F.least(a, i)).when((a < 0) & (i < 0), F.lit(100)).otherwise(F.greatest(a, i))
    r, k = last_index(low, "reference"), last_index(low, "acknowledgement")
    end = F.when((k >= 0) & (k < r) & (k > F.length(text) / 2), k).when(r >= 0, r).otherwise(F.length(text))
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def one_line(text: Column | str) -> Column:
    return F.translate(col(text), "\n", " ")


def split_sentences(text: Column | str) -> Column:
    """Sentences of a text taken as one line: cut after . ! or ? before blanks."""
    return F.split(F.regexp_replace(one_line(text), r"([.!?])[ \t]+", "$1\n"), "\n")


def join_broken_words(text: Column | str) -> Column:
    """Words broken by a hyphen and blanks inside a line are joined, left to right."""
    return F.regexp_replace(col(text), BROKEN_WORD, "$1$2")


def strip_citations(text: Column | str) -> Column:
    return F.regexp_replace(col(text), CITATION, "")


def spaced_chars(text: Column | str) -> Column:
    """The characters of a text with a space between each two."""
    return F.array_join(F.split(col(text), ""), " ")


def keep_plain(text: Column | str) -> Column:
    """ASCII letters, digits, hyphens and spaces; other characters are dropped."""
    return F.regexp_replace(col(text), "[^A-Za-z0-9\\- ]", "")


def without_words(text: Column | str, words: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(tokens(text), lambda w: ~w.isin(*words)), " ")


def merge_et_al(sentences: Column) -> Column:
    """An array of one-line sentences in which each that ends with "et al." takes the next one on."""
    return F.split(F.regexp_replace(F.array_join(sentences, "\n"), r"(et al[.])\n", "$1 "), "\n")


def has_punctuation(text: Column | str) -> Column:
    return F.rlike(col(text), F.lit(f"[{PUNCTUATION}]"))


def stem(name: Column | str, ending: str) -> Column:
    """A file name without its ending."""
    return F.regexp_replace(col(name), ending.replace(".", "[.]") + "$", "")
