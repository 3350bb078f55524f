"""Abbreviations: definitions by the method of Schwartz and Hearst (2003), and their expansion line by line."""

from __future__ import annotations

import re
from bisect import bisect_right

_BRACKETS = re.compile(r"\(([^()]{2,})\)")


def _fits(short: str) -> bool:
    return 2 <= len(short) <= 10 and len(short.split()) <= 2 and short[0].isalnum() and any(c.isalpha() for c in short)


def _long_form(short: str, before: str) -> str | None:
    """The shortest end of `before` that has the short form's letters and digits in order, the first at a word's start."""
    at = len(before)
    for i in range(len(short) - 1, -1, -1):
        c = short[i].lower()
        if not c.isalnum():
            continue
        at -= 1
        while at >= 0 and (before[at].lower() != c or (i == 0 and at > 0 and before[at - 1].isalnum())):
            at -= 1
        if at < 0:
            return None
    start = before.rfind(" ", 0, at) + 1
    found = before[start:].strip()
    if len(found) <= len(short) or short in found.split() or len(found.split()) > min(len(short) + 5, len(short) * 2):
        return None
    return found


def _words_before(text: str, begin: int, end: int, most: int) -> str:
    """The last `most` words of text[begin:end], looking no further back than these."""
    width = 256
    while True:
        start = max(begin, end - width)
        words = text[start:end].rstrip().split(" ")
        if start == begin or len(words) > most:
            return " ".join(words[-most:])
        width *= 2


def find_pairs(text: str | None, lower_aliases: bool = True) -> list[dict]:
    """(abbr, definition) pairs in order of appearance, a later definition of the same form in the earlier one's place; then, if asked
    for, each in lower case."""
    pairs: dict[str, str] = {}
    starts = [0, *(m.end() for m in re.finditer(r"[.!?\n]\s", text or ""))] if text and "(" in text else [0]
    for m in _BRACKETS.finditer(text or ""):
        short = re.split(r"[,;]", m[1])[0].strip()
        if not _fits(short):
            continue
        sentence = starts[bisect_right(starts, m.start()) - 1]
        if found := _long_form(short, _words_before(text, sentence, m.start(), min(len(short) + 5, len(short) * 2))):
            pairs[short] = found
    if lower_aliases:
        for k, v in list(pairs.items()):
            pairs[k.lower()] = v.lower()
    return [{"abbr": k, "definition": v} for k, v in pairs.items()]


def expand_line(line: str, pairs: list[dict], raw_patterns: bool = False) -> tuple[str, list[tuple[int, int]], list[str]]:
    """The line with its abbreviations written out, the spans replaced, and forms that are no patterns (raw only).

    A match that touches a letter is left. Of matches that overlap or touch, the leftmost stays; of those at one place, that of the earlier pair."""
    found, broken = [], []
    for p in pairs:
        if p["abbr"] not in line:
            continue
        try:
            matches = re.finditer(p["abbr"] if raw_patterns else re.escape(p["abbr"]), line)
        except re.error:
            broken.append(p["abbr"])
            continue
        for m in matches:
            if not (line[m.start() - 1 : m.start()].isalpha() or line[m.end() : m.end() + 1].isalpha()):
                found.append((m.start(), m.end(), p["definition"]))
    kept: list[tuple[int, int, str]] = []
    for f in sorted(found, key=lambda f: f[0]):
        if not kept or f[0] > kept[-1][1]:
            kept.append(f)
    for a, b, full in reversed(kept):
        line = line[:a] + full + line[b:]
    return line, [(a, b) for a, b, _ in kept], broken


def expand_text(text: str | None, pairs: list[dict] | None, raw_patterns: bool = False) -> str | None:
    if text is None or not pairs:
        return text
    return "\n".join(expand_line(line, pairs, raw_patterns)[0] for line in text.split("\n"))
