"""Distances between vectors held as arrays, in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def l2_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L2 distances of the rows of x from those of y; those of near rows come from their difference, as products lose their digits."""
    s, t = squares(x), squares(y)
    d = x @ y.T
    d *= -2
    d += s[:, None]
    d += t
    at = np.flatnonzero(d.ravel() <= 1e-4 * (s.max(initial=0) + t.max(initial=0)))
    for k in range(0, len(at), 1 << 16):
        i, j = np.divmod(at[k : k + (1 << 16)], len(y))
        d[i, j] = squares(x[i] - y[j])
    return np.sqrt(d, out=d)


def _in_order(x: np.ndarray, y: np.ndarray, term) -> np.ndarray:
    """The sum over the places of term(x at the place, y at the place) for all pairs of rows, added place by place as the expressions above do."""
    out = np.zeros((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    rows = max(1, 32_768 // max(1, len(y)))
    for a in range(0, len(x), rows):
        part, held = out[a : a + rows], np.empty((min(rows, len(x) - a), len(y)))
        for k in range(x.shape[1]):
            part += term(x[a : a + rows, k, None], columns[k], held)
    return out


def l2_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """l2_distance of all pairs of rows, the same to the last bit."""
    out = _in_order(x, y, lambda a, b, held: np.square(np.subtract(a, b, out=held), out=held))
    return np.sqrt(out, out=out)


def cosine_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """cosine_distance of all pairs of rows, the same to the last bit; NaN where a vector is zero."""
    out = _in_order(x, y, lambda a, b, held: np.multiply(a, b, out=held))
    norms = [np.sqrt(sum((z[:, k] * z[:, k] for k in range(z.shape[1])), np.zeros(len(z)))) for z in (x, y)]
    with np.errstate(invalid="ignore", divide="ignore"):
        out /= norms[0][:, None] * norms[1]
    return np.subtract(1, out, out=out)
