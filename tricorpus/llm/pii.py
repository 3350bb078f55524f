r"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds to them.

Base kinds (whole text, leftmost and non-overlapping for each kind; what fails its test is dropped without another try):
email, ip (four numbers up to 255), card (13 to 19 digits that pass Luhn), phone (+, 9 to 15 digits).

The field labels the words of each line. Features of a word: its shape (letters, digits and marks, runs shortened), lengths, marks, and the
word itself if it is one of a few cues; the same of the words beside it. Weights come from a small labelled table (`labelled_lines`),
fitted by maximum likelihood (forward-backward) with a ridge, the same each time. Decoding is Viterbi in numpy over many lines at once;
lines in which no word's label can outweigh its cost on any path are known to be all "other" and are not decoded. Labelled runs become spans of kind
secret, id, phone, email, ip or card, unless they touch a base span. Names of people are not a kind: a word's shape doesn't tell
them from any capitalised word, and trained on them the field marked thousands of clean words.

Offsets are code points, ends exclusive. Nulls: a null text is empty; a null doc_id stays null. Every row gives one result row, in any number of
repeats. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, row_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "id")
LABELS = ("other", *KINDS)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
# A match starts where its first run of characters starts or where the last match ended, and no part gives characters back, so a run is looked at once.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(rb"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _run_start(text: str, at: int) -> int:
    """Where the run of email characters that `at` is in begins."""
    while at:
        part = text[max(0, at - 64) : at]
        rest = len(part.rstrip(_LOCAL + "@"))
        at -= len(part) - rest
        if rest:
            break
    return at


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text, by kind as listed, then start."""
    out = []
    at = text.find("@")
    while at >= 0:
        run = _EMAIL_RUN.match(text, _run_start(text, at))  # no match reaches beyond what an email can have around this sign
        pos, end = run.span()
        while m := _EMAIL.match(text, pos, end) or _EMAIL_NEXT.search(text, pos, end):
            out.append(("email", *m.span()))
            pos = m.end()
        at = text.find("@", end)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# --- the field

CUES = set("mr mrs ms dr prof name named sir madame herr frau señor señora monsieur password passwd pwd secret token key apikey api_key ssn iban passport id account social security phone tel call mobile email mail e-mail contact at dot ip address card visa the is my number no by with version page chapter section year since in on of and de la le der die".split())


def shape(word: str) -> str:
    """Letters as X, x or h (lower-case hexadecimal), digits as d, marks as they are; runs of over two are cut to two."""
    out = []
    for c in word[:40]:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def features(word: str) -> list[str]:
    bare = word.strip(".,;:!?\"'()").lower()
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    out = ["s=" + shape(word), f"d={min(digits, 17)}", f"n={min(len(word) // 4, 9)}"]
    if bare in CUES:
        out.append("w=" + bare)
    if digits and letters:
        out.append(f"mixed={min(letters, digits) // 4}")
    head = re.match(r"[A-Za-z_]+(?==)", word)
    if head:
        out.append("set=" + (head[0].lower() if head[0].lower() in CUES else "other"))
    if digits >= 8 and letters >= 2 and re.fullmatch(r"\W*[0-9a-f]{16,}\W*", word):
        out.append("hex")
    if letters >= 8 and digits and re.fullmatch(r"\W*[A-Z0-9]{16,}\W*", word):
        out.append("caps")
    return out


def labelled_lines(n: int = 600, seed: int = 5) -> list[list[tuple[str, str]]]:
    """The labelled table: (word, label) lines, made from patterns of each kind among invented words and numbers that are nobody's."""
    r = random.Random(seed)
    parts = "an er in on st re th ti ou le ment eau ung sch ado cio que ie ha es or ing ble".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(k))

    def plain() -> str:
        w = word()
        w = w.capitalize() if r.random() < 0.15 else w
        return w + r.choice(["", "", "", "", "", ",", ".", ";", ":"])

    def numbers() -> list[tuple[str, str]]:  # nobody's
        return [(x, "other") for x in r.choice([[str(r.randint(1, 99)) + "."], [str(r.randint(1900, 2030))], [f"{r.randint(0, 9)}.{r.randint(0, 9)}."], ["version", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}"], [f"{r.randint(1, 99)}%"], ["page", str(r.randint(1, 900))], [f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}"], [f"({r.randint(1, 99)})"], [f"{word()}-{r.randint(1, 99)}"], [f"{r.randint(1, 99)},{digit(3)}"], [f"{r.randint(1, 23)}:{digit(2)}"], [f"[{r.randint(1, 60)}]"], [word().upper()], [f"{word()}={word()}"], [f"{word()}***"], ["|"], ["#"], ["***"], ["Apache", "2.0"], ["token"], ["the", "key"], ["password"], ["mail"], ["AT"], [word().upper() + "!!"], [word().capitalize(), "at"]])]

    def entity() -> list[tuple[str, str]]:
        kind = r.choice(["secret"] * 4 + ["id"] * 2 + ["phone", "email", "ip", "card"])
        end = r.choice(["", "", "", ".", ","])
        if kind == "secret":
            body, cue = r.choice([(upper(4) + upper(16), []), (f"password={hexa(r.randint(12, 24))}", []), (f'"{hexa(40)}"', ["token", "="]), (f'"{hexa(32)}"', ["key", "="]), (f"secret={upper(20)}", []), (f"token={hexa(32)}", []), (f"sk-{hexa(24)}", []), (f"api_key={hexa(32)}", [])])
            return [(c, "other") for c in cue] + [(body + end, kind)]
        if kind == "id":
            body, cue = r.choice([(f"{digit(3)}-{digit(2)}-{digit(4)}", []), (f"{digit(3)}-{digit(2)}-{digit(4)}", ["ssn"]), (r.choice("ABCDEFGH") * 2 + digit(18), ["iban"]), (r.choice("XYPQ") + digit(8), ["passport"])])
            return [(c, "other") for c in cue] + [(body + end, kind)]
        if kind == "phone":
            return r.choice([[(f"({digit(3)})", kind), (f"{digit(3)}-{digit(4)}{end}", kind)], [("+1", kind), (f"({digit(3)})", kind), (f"{digit(3)}-{digit(4)}{end}", kind)], [("tel", "other"), (f"{digit(3)}-{digit(3)}-{digit(4)}{end}", kind)]])
        if kind == "email":
            return [(f"{word()}.{digit(2)}@{word()}{digit(1)}.example.com{end}", kind)]
        if kind == "ip":
            return [(".".join(str(r.randint(1, 254)) for _ in range(4)) + end, kind)]
        return [(digit(16) + end, kind)] if r.random() < 0.6 else [(digit(4), kind), (digit(4), kind), (digit(4), kind), (digit(4) + end, kind)]

    lines = []
    for i in range(n):
        line = []
        for _ in range(r.randint(1, 4)):
            line += [(plain(), "other") for _ in range(r.randint(0, 5))]
            line += entity() if i % 3 else numbers()
        line += [(plain(), "other") for _ in range(r.randint(0, 4))]
        lines.append(line)
    return lines


class Field:
    """Weights of the field, ready to decode: per known feature set (signature) a row of scores for a word, its right and its left neighbour."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray) -> None:
        self.index, self.weights, self.steps = index, weights, steps  # weights: [place, feature, label]

    def signature(self, word: str) -> tuple[int, ...]:
        return tuple(sorted(i for f in features(word) if (i := self.index.get(f)) is not None))


@functools.lru_cache(maxsize=2)
def train(n: int = 600, rounds: int = 100, ridge: float = 1.0) -> Field:
    """Maximum likelihood on labelled_lines(n), by Adam; the same result each time."""
    lines = labelled_lines(n)
    index: dict[str, int] = {}
    for line in lines:
        for word, _ in line:
            for f in features(word):
                index.setdefault(f, len(index))
    L, T = len(LABELS), max(map(len, lines))
    real = np.zeros((len(lines), T), bool)
    gold = np.zeros((len(lines), T), int)
    V = len(index)
    at: list[tuple[int, int]] = []  # (word, feature of itself, of its left or of its right neighbour)
    k = 0
    for i, line in enumerate(lines):
        known = [[index[f] for f in features(w)] for w, _ in line]
        for t, (_, label) in enumerate(line):
            real[i, t], gold[i, t] = True, LABELS.index(label)
            for place, u in ((0, t), (1, t - 1), (2, t + 1)):
                if 0 <= u < len(line):
                    at += [(k, place * V + f) for f in known[u]]
            k += 1
    row, col = np.array(at).T
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # every word has features
    flat = gold[real]
    gather = lambda y: np.stack([np.bincount(col, weights=y[row, l], minlength=3 * V) for l in range(L)], axis=1)  # noqa: E731, E741
    w, trans = np.zeros((3 * V, L)), np.zeros((L, L))
    want_w, want_t = gather(np.eye(L)[flat]), np.zeros((L, L))
    pairs = real[:, 1:]
    np.add.at(want_t, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    lse = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    for k in range(1, rounds + 1):
        e = np.zeros((*real.shape, L))
        e[real] = np.add.reduceat(w[col], first)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, T):
            alpha[:, t] = np.where(real[:, t, None], lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t], alpha[:, t - 1])
        for t in range(T - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])[real]
        edge = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])[pairs].sum(axis=0)
        for p, g, a, b in ((w, want_w - gather(node) - ridge * w, m[0], v[0]), (trans, want_t - edge - ridge * trans, m[1], v[1])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.15 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return Field(index, w.reshape(3, len(index), L), trans)


class Decoder(dict):
    """Words to rows of score tables, remembered; decodes lines of words."""

    limit = 300_000

    def __init__(self, field: Field) -> None:
        self.field = field
        self.rows: dict[tuple[int, ...], int] = {}
        self.tables = np.zeros((3, 4096, len(LABELS)), np.float32)
        steps = field.steps
        self.bonus = 2 * max(0.0, float(steps.max() - steps[0, 0]))

    def __missing__(self, word: bytes) -> int:
        sig = self.field.signature(word.decode())
        row = self.rows.get(sig)
        if row is None:
            row = self.rows[sig] = len(self.rows) + 1  # row 0: no word
            if row >= self.tables.shape[1]:
                self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
            self.tables[:, row] = self.field.weights[:, list(sig)].sum(axis=1)
        if len(self) >= self.limit:
            self.clear()
        self[word] = row
        return row

    def decode(self, lines: list[list[bytes]]) -> list[tuple[int, np.ndarray]]:
        """(line, labels) of the lines that have any label but "other"."""
        lens = np.fromiter(map(len, lines), np.int64, len(lines))
        n = int(lens.sum())
        if not n:
            return []
        rows = np.fromiter((self[w] for line in lines for w in line), np.int64, n)
        first = np.cumsum(lens) - lens
        inner = np.ones(n, bool)
        inner[first[lens > 0]] = False
        left = np.where(inner, np.roll(rows, 1), 0)
        right = np.where(np.append(inner[1:], False), np.roll(rows, -1), 0)
        own = self.tables[0]
        gains = np.stack([(t[:, 1:] - t[:, :1]).max(axis=1) for t in self.tables])
        # most that any label can gain over "other" at this word; the three tables' maxima bound the maximum of their sum
        maybe = np.flatnonzero(gains[0][rows] + gains[1][left] + gains[2][right] + self.bonus > 0)
        if not len(maybe):
            return []
        picked = np.unique(np.searchsorted(first + lens, maybe, side="right"))
        picked = picked[np.argsort(-lens[picked], kind="stable")]
        size = lens[picked]
        T, L = int(size[0]), len(LABELS)
        steps = self.field.steps.astype(np.float32)
        back = [np.zeros((len(picked), L), np.int8)]
        score = np.zeros((len(picked), L), np.float32)
        for t in range(T):
            k = int(np.searchsorted(-size, -t, side="left"))  # lines longer than t
            at = first[picked[:k]] + t
            e = own[rows[at]] + self.tables[1][left[at]] + self.tables[2][right[at]]
            if t:
                through = score[:k, :, None] + steps
                back.append(through.argmax(axis=1).astype(np.int8))
                e = e + through.max(axis=1)
            score[:k] = e
        out = []
        labels = np.zeros(n, np.int8)  # of all words: a table of lines and places would grow with the longest line
        now = score.argmax(axis=1)
        for t in range(T - 1, -1, -1):
            k = int(np.searchsorted(-size, -t, side="left"))
            labels[first[picked[:k]] + t] = now[:k]
            if t:
                now[:k] = back[t][np.arange(k), now[:k]]
        marked = np.zeros(n + 1, np.int64)
        np.cumsum(labels != 0, out=marked[1:])
        for j in picked[marked[first[picked] + lens[picked]] > marked[first[picked]]]:
            out.append((int(j), labels[first[j] : first[j] + lens[j]]))
        return out


def field_spans(text: str, marked: list[tuple[int, str]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of runs of words with one label; marked: (word number, kind) in order. Marks around them and what touches base spans are left out."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, k = [], 0
    while k < len(marked):
        j = k
        while j + 1 < len(marked) and marked[j + 1] == (marked[j][0] + 1, marked[k][1]) and "\n" not in text[places[marked[j][0]][1] : places[marked[j + 1][0]][0]]:
            j += 1
        a, b = places[marked[k][0]][0], places[marked[j][0]][1]
        while a < b and text[a] in "\"'(,;:":
            a += 1
        while a < b and text[b - 1] in "\"').,;:":
            b -= 1
        if a < b and not any(a < y and x < b for _, x, y in base):
            out.append((marked[k][1], a, b))
        k = j + 1
    return out


def find_all(texts: list[bytes], decoder: Decoder) -> Iterator[tuple[str, list, list]]:
    """For each UTF-8 text: itself, its base spans, and all its spans by kind, then start."""
    lines, owner, begins = [], [], []
    for i, text in enumerate(texts):
        n = 0
        for line in text.split(b"\n"):
            if words := line.split():
                lines.append(words)
                owner.append(i)
                begins.append(n)
                n += len(words)
    marked: dict[int, list[tuple[int, str]]] = {}
    for j, labels in sorted(decoder.decode(lines)):
        marked.setdefault(owner[j], []).extend((begins[j] + int(t), LABELS[labels[t]]) for t in np.flatnonzero(labels))
    for i, raw in enumerate(texts):
        text = raw.decode()
        base = base_spans(text) if b"@" in raw or _DIGIT.search(raw) else []
        spans = base + (field_spans(text, marked[i], base) if i in marked else [])
        yield text, base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT for each row: counts and digest of the base spans, and all spans."""
    field = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in row_slices(batches):
            rows = []
            for _, base, spans in find_all(byte_texts(batch), decoder):
                kinds = [k for k, _, _ in base]
                rows.append([*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets (earlier and longer spans first where they overlap; a later
    one's kind stands for the rest of it, if there is one), and the length column, where there is one, set to the new length; null texts stay null. All other columns are as they were."""
    field = train()
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    safe, at = docs.toDF(*own.values()), own[text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in row_slices(batches, at):
            texts: list[str | None] = []
            for (text, _, spans), valid in zip(find_all(byte_texts(batch, at), decoder), batch.column(at).is_valid().to_pylist()):
                out, end = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if b > end:  # what an earlier span has already taken is left out
                        out += [text[end:a], f"[{kind}]"]
                        end = b
                texts.append("".join(out) + text[end:] if valid else None)
            i = batch.schema.get_field_index(at)
            yield batch.set_column(i, at, pa.array(texts, pa.string()))

    out = safe.mapInArrow(run, safe.schema)
    size = F.length(at).cast(dict(docs.dtypes)[length_col]) if length_col in own else None
    return out.select(*((F.coalesce(size, own[c]) if c == length_col else F.col(v)).alias(c) for c, v in own.items()))
