"""Vector arithmetic: Column expressions, their NumPy counterparts, and the registry of metrics.

Sums are left folds over doubles on both paths, so both give the same bits.
A metric is lower-is-better and symmetric.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences, not rooted; 0 for empty vectors."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return F.lit(0.0) - dot_product(a, b)  # not unary minus, which would give -0.0


def norm_squared(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x * x))


def l2_from_norms(norm_a: Column, norm_b: Column, dot: Column) -> Column:
    """The norm identity; rounding below zero is cut off."""
    return F.greatest(F.lit(0.0), norm_a + norm_b - F.lit(2.0) * dot)


def np_squared_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in the order of a left fold."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        step = a[:, i] - b[:, i]
        out += step * step
    return out


def np_negative_inner_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return 0.0 - out


#: Terms of a row that a tile folds at once: they and the components they come from stay in a core's cache; and the fewest columns of them.
TERMS, NARROW = 1 << 14, 64


def folded(term: Callable[..., np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Left folds of term(x, y, out) over the components of each row of a with each of b, in strips of b's rows."""
    if len(b) == 1:  # a sum along one column alone would not be a left fold
        return folded(term, a, np.repeat(b, 2, axis=0))[:, :1]
    sums, d = np.empty((len(a), len(b))), a.shape[1]
    strips = math.ceil(len(b) / max(NARROW, TERMS // max(1, d)))
    for i in range(strips):
        at = slice(len(b) * i // strips, len(b) * (i + 1) // strips)
        columns = np.ascontiguousarray(b[at].T)
        terms = np.empty(columns.shape)
        for x, s in zip(a, sums[:, at], strict=True):
            np.add.reduce(term(x[:, None], columns, terms), axis=0, out=s, initial=0.0)
    return sums


def _squared_difference(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.subtract(x, y, out=out)
    return np.multiply(out, out, out=out)


def _tile_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return folded(_squared_difference, a, b)


def _tile_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return folded(np.multiply, a, b)


def _tile_ip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dots = _tile_dot(a, b)
    return np.subtract(0.0, dots, out=dots)


def np_norm_squared(a: np.ndarray) -> np.ndarray:
    return 0.0 - np_negative_inner_product(a, a)


def tile_l2_from_norms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """l2_from_norms of each row of a with each of b; a row's norm is computed once a tile."""
    dots = _tile_dot(a, b)
    dots *= 2.0
    np.subtract(np.add.outer(np_norm_squared(a), np_norm_squared(b)), dots, out=dots)
    return np.maximum(0.0, dots, out=dots)


def _bound_l2(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The fold over the nearest corner: rounding keeps order, so no computed distance to a point of the box is less."""
    out = np.zeros((len(a), len(low)))
    for x, lo, hi in zip(a.T, low.T, high.T, strict=True):
        gap = x[:, None] - np.clip(x[:, None], lo, hi)
        out += gap * gap
    return out


def _bound_ip(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(low)))
    for x, lo, hi in zip(a.T, low.T, high.T, strict=True):
        out += np.maximum(x[:, None] * lo, x[:, None] * hi)
    return 0.0 - out


def _apart_l2(low_a: np.ndarray, high_a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """_bound_l2's least for the rows of a box: each step is rounded, and keeps order, as there."""
    out = np.zeros(len(low))
    for p, q, lo, hi in zip(low_a, high_a, low.T, high.T, strict=True):
        gap = np.maximum(0.0, np.maximum(lo - q, p - hi))
        out += gap * gap
    return out


def _apart_ip(low_a: np.ndarray, high_a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros(len(low))
    for p, q, lo, hi in zip(low_a, high_a, low.T, high.T, strict=True):
        out += np.maximum(np.maximum(p * lo, p * hi), np.maximum(q * lo, q * hi))
    return 0.0 - out


def _block_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ (-2.0 * b).T
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)
    return np.maximum(0.0, out, out=out)


def _block_ip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -(a @ b.T)


@dataclass(frozen=True)
class Metric:
    """column, rows and tile give exact distances of pairs; block gives fast distances of two blocks, right to within rounding.

    tile has a row of the result for each row of its first block; without it rows is called for one row after the other.
    bound has, for each row of a and each box, a number that no distance, as computed, from the row to a point of the box is less than.
    apart has, for one box and each of others, a number that no bound of a row in that box is less than.
    """

    name: str
    wire_id: int
    file_tag: str
    column: Callable[[Column, Column], Column]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    tile: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    bound: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None
    apart: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact distances of each row of a to each of b."""
        if self.tile is not None:
            return self.tile(a, b)
        return np.array([self.rows(np.broadcast_to(x, b.shape), b) for x in a]).reshape(len(a), len(b))


METRICS: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    """Makes a metric known by name; without block it is computed pair by pair."""
    METRICS[metric.name] = metric
    return metric


L2 = register(Metric("l2", 0, "l2", squared_l2, np_squared_l2, _block_l2, _tile_l2, _bound_l2, _apart_l2))
INNER_PRODUCT = register(Metric("inner_product", 1, "negip", negative_inner_product, np_negative_inner_product, _block_ip, _tile_ip, _bound_ip, _apart_ip))


def metric(name: str | Metric) -> Metric:
    if isinstance(name, Metric):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]
