"""Token ids of texts with a public tokenizer file, fast enough for whole corpora.

The byte-level pre-tokenizer cuts before any single space or newline that stands between other characters, and between ASCII letters or digits and
ASCII marks (but after an apostrophe, as contractions begin with one), whatever is around them. So a text without two white-space characters in a
row and without special tokens is the sequence of its parts, each with the space or newline before it. Distinct parts are found for many texts at once,
encoded once and remembered (words recur), and their ids laid out by numpy; every other text is encoded whole. A text's first part is taken
as if a newline stood before it, whose id is dropped. Runs of letters and runs of ASCII marks are pieces of their own for the pre-tokenizer
(but for contractions, which are left to it); the letters go to the tokenizer's model directly, in the alphabet that stands for bytes there.
"""

from __future__ import annotations

import os
import sys
import types
from array import array
from codecs import charmap_decode
from string import ascii_letters, digits
from string import punctuation as MARKS

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GAP, MARK, ALNUM = 1, 2, 4
KINDS = bytes(GAP if b in b" \n" else MARK if chr(b) in MARKS else ALNUM if chr(b) in ascii_letters + digits else 0 for b in range(256))


class Encoder(dict):
    """Ids of texts as little-endian unsigned 16- or 32-bit integers. As a dict: ids of the parts met lately; an older generation is
    kept beside it."""

    limit = 1 << 19

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.old: dict[str, bytes] = {}
        self.newline = self._encode("\n")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs: dict[str, bytes] = {}  # of marks
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        # bytes that aren't printable in Latin-1 are moved to 256 and up, in order, as byte-level vocabularies have it
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = (b for b in range(256) if b not in printable)
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self.alphabet = "".join(letter[b] for b in range(256))

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _letters(self, text: str) -> bytes:
        """Of letters, or a space and letters."""
        return array(self.code, [t.id for t in self.model.tokenize(charmap_decode(text.encode(), "strict", self.alphabet)[0])]).tobytes()

    def _marks(self, text: str) -> bytes:
        ids = self.runs.get(text)
        if ids is None:
            if len(self.runs) > 10_000:
                self.runs.clear()
            ids = self.runs[text] = self._encode(text)
        return ids

    def _part(self, part: str) -> bytes:
        gap = part[0] if part[0] in " \n" else ""
        body = part[len(gap) :]
        if body.isalpha():
            return self.newline + self._letters(body) if gap == "\n" else self._letters(part)
        core = body.strip(MARKS)
        if not core.isalpha() or "'" in body:
            return self._encode(part)
        at = body.index(core)
        lead, trail = body[:at], body[at + len(core) :]
        ids = self._marks(gap + lead) + self[core] if lead else self[gap + core]
        return ids + self._marks(trail) if trail else ids

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self._part(part)
        self[part] = ids
        return ids

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, end to end."""
        return self._each(texts, self._laid)

    def _each(self, texts: list[str], join) -> list:
        plain, out = [], []
        for t in texts:
            flat = t.replace("\n", " ")
            if flat.isprintable() and "  " not in flat and flat[:1] != " " and flat[-1:] not in ("", " ") and not any(s in t for s in self.special):
                plain.append(t.encode())
                out.append(None)
            else:
                out.append(self._encode(t))
        joined = iter(join(*self._parts(plain)) if plain else ())
        return [next(joined) if x is None else x for x in out]

    def _parts(self, texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
        """What the distinct parts of the texts are encoded as; which of them each part is; and where each text's first part is, and the end."""
        data = b"\n" + b"\n".join(texts)
        byte = np.frombuffer(data, np.uint8)
        kind = np.frombuffer(data.translate(KINDS), np.uint8)
        cut = kind[:-1] | kind[1:] == MARK | ALNUM
        cut &= byte[:-1] != ord("'")
        cut |= kind[1:] == GAP
        at = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(data)]])
        found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        distinct = found.dictionary
        # no part has a tab, so this is the quickest way to Python's strings
        parts = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), pa.scalar("\t", pa.large_string()))[0].as_py().split("\t")
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return list(map(self.__getitem__, parts)), found.indices.to_numpy().astype(np.intp), np.searchsorted(at, ends)

    def _laid(self, ids: list[bytes], which: np.ndarray, first: np.ndarray) -> list[bytes]:
        flat = np.frombuffer(b"".join(ids), self.dtype)
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        start, n = (np.cumsum(lens) - lens).take(which), lens.take(which)
        skip = len(self.newline) // self.dtype.itemsize
        start[first[:-1]] += skip
        n[first[:-1]] -= skip
        at = np.concatenate([[0], np.cumsum(n)])  # where each part's ids go
        place = np.repeat(start - at[:-1], n)
        place += np.arange(len(place))
        data, ends = flat.take(place).tobytes(), (at.take(first) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


class Counter(Encoder):
    """How many ids texts have: remembers numbers in place of ids."""

    def _encode(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, text: str) -> int:
        return len(self.model.tokenize(charmap_decode(text.encode(), "strict", self.alphabet)[0]))

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return self._each(texts, self._sums)

    def _sums(self, numbers: list[int], which: np.ndarray, first: np.ndarray) -> list[int]:
        return (np.add.reduceat(np.array(numbers, np.int64).take(which), first[:-1]) - self.newline).tolist()


def encoder(name: str = "byte_bpe_50k.json", kind: type[Encoder] = Encoder) -> Encoder:
    """This process's encoder of a kind for a tokenizer file (a path, or a name among the public tokenizers), loaded once."""
    kept = sys.modules.setdefault("_tricorpus_encoders", types.ModuleType("_tricorpus_encoders"))
    key = f"{kind.__name__}:{name}"
    if key not in kept.__dict__:
        import public_tokenizers

        setattr(kept, key, kind(name if os.path.isabs(name) else public_tokenizers.path(name)))
    return kept.__dict__[key]
