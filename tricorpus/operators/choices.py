"""Spread over all choices of one triplet a paper, cluster by cluster, from counts of papers that choose among the same vectors."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.vectors import l2_block
from .groups import LEAST_SHARE

STRIP, WHOLE = 512, 2048  # rows of distances at a time; vectors of which all distances are held at once
BINS = 65_536


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w D w^T for the matrix D of distances of the rows of x, of which a strip is held at a time."""
    out = np.zeros((len(w), len(w)))
    for a in range(0, len(x), STRIP):
        d = l2_block(x[a : a + STRIP], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = 0
        out += w[:, a : a + STRIP] @ (d @ w.T)
    return out


def _binomials(n: dict[float, int]) -> np.ndarray:
    """Chances of 0, 1, ... successes, of n[q] trials with the chance q each."""
    out = np.ones(1)
    for q, m in n.items():
        if m and 0 < q < 1:
            logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, m + 1)))])
            k = np.arange(m + 1)
            out = np.convolve(out, np.exp(logs[m] - logs - logs[::-1] + k * math.log(q) + (m - k) * math.log1p(-q)))
    return np.concatenate([np.zeros(n.get(1.0, 0)), out])


def _without(n: dict[float, int], *taken: float) -> dict[float, int]:
    n = dict(n)
    for q in taken:
        n[q] -= 1
    return n


def means(first: np.ndarray, options: list[np.ndarray], n: np.ndarray, papers: np.ndarray, x: np.ndarray, kinds: list[str]) -> dict[str, tuple[float, float]]:
    """For each kind: the sum of the groups' means, and the number of groups that have one, both as shares of the cluster's choices.

    The mean of a choice is the sum over its pairs, by its number of pairs; so each pair of papers adds its own mean distance by the expected inverse of
    that number, which hangs on how many others have a vector. Papers are taken together by the share q of their triplets that have one."""
    share = [len(o) / k for o, k in zip(options, n, strict=True)]
    keys = sorted({(bool(f), q) for f, q in zip(first, share, strict=True) if q})
    place = {k: i for i, k in enumerate(keys)}
    w, own = np.zeros((len(keys), len(x))), np.zeros(len(keys))
    had: dict[bool, dict[float, int]] = {True: defaultdict(int), False: defaultdict(int)}
    for f, o, k, m, q in zip(first.tolist(), options, n.tolist(), papers.tolist(), share, strict=True):
        if q:
            i = place[f, q]
            had[f][q] += m
            if len(o) == 1:
                w[i, o[0]] += m / k
            else:
                np.add.at(w[i], o, m / k)
                used, times = np.unique(o, return_counts=True)
                if len(used) > 1:
                    own[i] += m * _sums(x[used], times[None, :] / k)[0, 0]
    s, out = _sums(x, w), {}
    for kind in kinds:
        if kind == "mixed":
            num = 0.0
            for (f, q), i in place.items():
                for (g, r), j in place.items():
                    if f and not g:
                        a, b = _binomials(_without(had[True], q)), _binomials(_without(had[False], r))
                        num += s[i, j] * (a / np.arange(1, len(a) + 1)).sum() * (b / np.arange(1, len(b) + 1)).sum()
            a, b = _binomials(had[True]), _binomials(had[False])
            out[kind] = num, (1 - a[0]) * (1 - b[0])
            continue
        side, num = kind == "first", 0.0
        for (f, q), i in place.items():
            for (g, r), j in place.items():
                if f == g == side and i <= j and had[side][q] > (i == j):
                    pairs = (s[i, i] - own[i]) / 2 if i == j else s[i, j]
                    a = _binomials(_without(had[side], q, r))
                    k = np.arange(1, len(a) + 1)
                    num += pairs * (a * 2 / (k * (k + 1.0))).sum()
        out[kind] = num, _binomials(had[side])[2:].sum()
    return out


def rank_value(values: np.ndarray, ends: np.ndarray) -> float:
    """The third quartile, between neighbours, of sorted values of which ends[i] is the number up to the i-th."""
    at = 0.75 * float(ends[-1] - 1)
    low = math.floor(at)
    a, b = values[np.searchsorted(ends, [low, math.ceil(at)], side="right")]
    return float(a + (b - a) * (at - low))


def strips(x: np.ndarray, c: np.ndarray, other: np.ndarray | None):
    """(distances, weights) of the pairs of rows that c counts, in strips: each with itself and all others in both orders, or with those that `other` counts."""
    for a in range(0, len(x), STRIP):
        d = l2_block(x[a : a + STRIP], x)
        i = np.arange(len(d))
        d[i, i + a] = 0
        w = c[a : a + STRIP, None] * (c if other is None else other)[None, :]
        if other is None:
            w[i, i + a] -= c[a : a + STRIP]
        yield d.ravel(), w.ravel()


def large_quartile(x: np.ndarray, c: np.ndarray, other: np.ndarray | None) -> float:
    """As of sorted distances, of which only those in the bins of both neighbours are held."""
    top = 2.0 * math.sqrt(np.einsum("ij,ij->i", x, x).max()) + 1e-9
    counts = np.zeros(BINS, np.int64)
    for d, w in strips(x, c, other):
        counts += np.bincount((d * (BINS / top)).astype(np.int64), w, BINS).astype(np.int64)
    ends = np.cumsum(counts)
    at = 0.75 * float(ends[-1] - 1)
    bins = np.unique(np.searchsorted(ends, [math.floor(at), math.ceil(at)], side="right"))
    values: dict[float, int] = defaultdict(int)
    for d, w in strips(x, c, other):
        held = np.isin((d * (BINS / top)).astype(np.int64), bins) & (w > 0)
        for v, k in zip(d[held].tolist(), w[held].tolist(), strict=True):
            values[v] += k
    keys = np.array(sorted(values))
    if len(keys) == 0:
        return math.nan
    inside = np.cumsum([values[k] for k in keys.tolist()]) + (ends[bins[0] - 1] if bins[0] else 0)
    low = math.floor(at)
    a, b = keys[np.searchsorted(inside, [low, math.ceil(at)], side="right")]
    return float(a + (b - a) * (at - low))


def _takes(classes: list[tuple[np.ndarray, np.ndarray, int]], width: int, begin: int, step: int):
    """(chance, counts by vector) of the different choices begin, begin + step, ...; a class is vectors, their chances and a number of papers.
    What is beyond the vectors of a class has none."""
    sizes = [math.comb(m + len(q) - 1, len(q) - 1) for _, q, m in classes]
    for number in range(begin, math.prod(sizes), step):
        chance, c = 1.0, np.zeros(width, np.int64)
        for (o, q, m), size in zip(classes, sizes, strict=True):
            number, k = divmod(number, size)
            took = _composition(m, len(q), k)
            chance *= math.exp(math.lgamma(m + 1) + sum(t * math.log(p) - math.lgamma(t + 1) for t, p in zip(took, q.tolist(), strict=True)))
            np.add.at(c, o, took[: len(o)])
        yield chance, c


def _composition(total: int, parts: int, number: int) -> list[int]:
    """The number-th way to write total as a sum of so many parts, each 0 or more."""
    out = []
    while parts > 1:
        k = 0
        while number >= (ways := math.comb(total - k + parts - 2, parts - 2)):
            number -= ways
            k += 1
        out.append(k)
        total -= k
        parts -= 1
    return [*out, total]


def quartiles(first: np.ndarray, options: list[np.ndarray], n: np.ndarray, papers: np.ndarray, x: np.ndarray, kinds: list[str], part: int = 0, parts: int = 1) -> dict[str, tuple[float, float]]:
    """As means(), for the third quartile, over the different choices part, part + parts, ..."""
    fixed = np.zeros((2, len(x)), np.int64)
    classes: dict[int, list] = {0: [], 1: []}
    for f, o, k, m in zip(first.tolist(), options, n.tolist(), papers.tolist(), strict=True):
        used, times = np.unique(o, return_counts=True)
        if len(used) == 1 and len(o) == k:
            fixed[int(f), used[0]] += m
        elif len(used):
            classes[int(f)].append((used, np.append(times, k - len(o))[: len(used) + (len(o) < k)] / k, m))
    for side in classes.values():
        side.sort(key=lambda c: (c[0].tolist(), c[1].tolist()))  # all parts number alike
    small = len(x) <= WHOLE
    if small:
        d = l2_block(x, x)
        np.fill_diagonal(d, 0)
        order = np.argsort(d, axis=None, kind="stable")
        values = d.ravel()[order]
    out = {}
    for kind in kinds:
        num = den = 0.0
        sides = [1, 0] if kind == "mixed" else [int(kind == "first")]
        sets = [(c[0] + len(x) * i, *c[1:]) for i, side in enumerate(sides) for c in classes[side]]
        base = np.concatenate([fixed[side] for side in sides])
        for chance, c in _takes(sets, len(base), part, parts):
            c = c + base
            a, b = (c, None) if len(sides) == 1 else (c[: len(x)], c[len(x) :])
            if (a.sum() < 2) if b is None else not (a.sum() and b.sum()):
                continue
            if small:
                w = a[:, None] * (a if b is None else b)[None, :]
                if b is None:
                    w[np.diag_indices(len(x))] -= a
                value = rank_value(values, np.cumsum(w.ravel()[order]))
            else:
                value = large_quartile(x, a, b)
            num, den = num + chance * value, den + chance
        out[kind] = num, den
    return out


def spreads(alike: pa.Table, vectors: pa.Table, method: str) -> list[dict]:
    """{kind, size, log, num, den} of the clusters of alike(cluster, part, parts, is_first, options, n, papers): sums over the clusters of one kind and
    size, by the exponential of the log."""
    alike = alike.combine_chunks().sort_by([("cluster", "ascending"), ("part", "ascending")])
    if not alike.num_rows:
        return []
    vectors = vectors.sort_by("vector")
    x = np.array(vectors["embedding"].to_pylist(), np.float64).reshape(vectors.num_rows, -1)
    lists = alike["options"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    found = pc.index_in(lists.flatten(), vectors["vector"].combine_chunks()).to_numpy(zero_copy_only=False) if vectors.num_rows else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    first, n, papers, part, parts = (alike[c].to_numpy(zero_copy_only=False) for c in ("is_first", "n", "papers", "part", "parts"))
    key = pc.dictionary_encode(alike["cluster"].combine_chunks())
    key = (key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(key)]
    total: dict[tuple[str, int], list[tuple[float, float, float]]] = defaultdict(list)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        f, m = first[a:b], papers[a:b]
        n1, n2 = int(m[f].sum()), int(m[~f].sum())
        sizes = {k: s for k, has, s in (("first", n1 > 1, n1), ("other", n2 > 1, n2), ("mixed", min(n1, n2) / (n1 + n2) > LEAST_SHARE, n1 + n2)) if has}
        own = found[ends[a] : ends[b]]
        if not sizes or not len(own):
            continue
        used, local = np.unique(own, return_inverse=True)
        options = np.split(local, ends[a + 1 : b] - ends[a])
        more = (int(part[a]), int(parts[a])) if method != "mean" else ()
        log = float((m * np.log(n[a:b])).sum())
        for kind, (num, den) in (means if method == "mean" else quartiles)(f, options, n[a:b], m, x[used], list(sizes), *more).items():
            if den > 0:
                total[kind, sizes[kind]].append((log, num, den))
    out = []
    for (kind, size), each in total.items():
        v = np.array(each)
        top = v[:, 0].max()
        w = np.exp(v[:, 0] - top)
        out.append({"kind": kind, "size": size, "log": top, "num": float(w @ v[:, 1]), "den": float(w @ v[:, 2])})
    return out
