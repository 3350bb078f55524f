"""Rewriting of mentions by the head of their group. Spans are (start, end) in code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 50_000


def contains_another(spans: Column) -> Column:
    """For each of `spans`, whether another lies inside it."""
    inside = lambda s: F.exists(spans, lambda o: (o["start"] >= s["start"]) & (o["end"] <= s["end"]) & ((o["start"] != s["start"]) | (o["end"] != s["end"])))
    return F.transform(spans, inside)


def head(spans: Column, has_noun: Column) -> Column:
    """The first of `spans` that has a noun, by the flags `has_noun`; null if none has."""
    return F.get(F.filter(F.arrays_zip(spans.alias("span"), has_noun.alias("noun")), lambda z: z["noun"])["span"], F.lit(0))


def chunks(text: str, limit: int = CHUNK) -> list[str]:
    """The text in parts of at most `limit` characters, cut after their last newline, or at the limit where there is none."""
    out, at = [], 0
    while len(text) - at > limit:
        end = text.rfind("\n", at, at + limit) + 1
        end = end if end > at else at + limit
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def rewrite(text: str, groups: list[list[tuple[int, int]]], nouns: set[str]) -> tuple[str, list[tuple[int, int]]]:
    """The text with each mention replaced by its group's head, and the spans replaced.

    The head is the group's first mention that has one of `nouns` in it; groups without one are left. A mention that holds another of any
    group stays, as does one that overlaps an earlier replacement. The head is put in in lower case, without full stops and commas, with a
    space on each side where none stands."""
    every = [s for g in groups for s in g]
    edits: dict[tuple[int, int], str] = {}
    for group in groups:
        first = next((s for s in group if any(n in text[s[0] : s[1]] for n in nouns)), None)
        if first is None:
            continue
        words = text[first[0] : first[1]].lower().replace(".", "").replace(",", "")
        for s in group:
            if s != first and words and not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in every):
                edits.setdefault(s, words)
    out, at, done = [], 0, []
    for (a, b), words in sorted(edits.items()):
        if a < at:
            continue
        before = text[a - 1 : a] if a else ""
        after = text[b : b + 1]
        out += [text[at:a], " " if before and not before.isspace() else "", words, " " if after and not after.isspace() else ""]
        at = b
        done.append((a, b))
    return "".join([*out, text[at:]]), done


def resolver(find: Callable[[str], list[list[tuple[int, int]]]], nouns: Callable[[str], set[str]], limit: int = CHUNK) -> Callable[[list], list]:
    """A function for plugins.from_python: texts with their mentions resolved, chunk by chunk."""

    def run(texts: list) -> list:
        return [t if t is None else "".join(rewrite(c, find(c), nouns(c))[0] for c in chunks(t, limit)) for t in texts]

    return run
