"""Distances between feature vectors, as Column expressions and as block kernels.

``classic`` and ``standard`` are the two published readings of a metric where they differ.
Columns compute in double over arrays of any width; kernels accumulate dimension by
dimension, so a pair has the same value in every block and in either direction.

Defined cases: empty vectors are at distance 0; a null vector gives null; terms whose
denominator is not positive are left out, as each formula says.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the scale of the logarithmic arc weight.
MAX_ARC_WEIGHT = 100_000.0


def _sum(x: Column, y: Column, term: Callable[[Column, Column], Column]) -> Column:
    wide = F.zip_with(x.cast("array<double>"), y.cast("array<double>"), term)
    return F.aggregate(wide, F.lit(0.0), lambda s, t: s + t)


def _total(x: Column) -> Column:
    return F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda s, t: s + t)


def _guard(ok: Column, value: Callable[[], Column]) -> Column:
    return F.when(ok, value()).otherwise(0.0)


def _over(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def _square(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: (a - b) * (a - b))


def _chi_classic(x: Column, y: Column) -> Column:
    sx, sy = _total(x), _total(y)
    return F.sqrt(_sum(x, y, lambda a, b: _over(F.pow(_over(a, sx) - _over(b, sy), F.lit(2.0)), a + b + 1e-9)))


def _ratio(x: Column, y: Column) -> Column:
    den = _sum(x, y, lambda a, b: a + b)
    return F.when(den > 0, F.try_divide(_sum(x, y, lambda a, b: F.abs(a - b)), den)).otherwise(F.when(den.isNotNull(), 0.0))


_Pair = tuple[np.ndarray, np.ndarray]


def _loop(term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(y)))
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(x.shape[1]):
                out += term(x[:, j, None], y[None, :, j])
        return out

    return run


_square_block = _loop(lambda a, b: (a - b) * (a - b))


def _chi_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    sx, sy, out = x.sum(1), y.sum(1), np.zeros((len(x), len(y)))
    px = np.divide(x, sx[:, None], out=np.zeros_like(x), where=sx[:, None] != 0)
    py = np.divide(y, sy[:, None], out=np.zeros_like(y), where=sy[:, None] != 0)
    for j in range(x.shape[1]):
        out += (px[:, j, None] - py[None, :, j]) ** 2 / (x[:, j, None] + y[None, :, j] + 1e-9)
    return np.sqrt(out)


def _ratio_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    num, den = _loop(lambda a, b: np.abs(a - b))(x, y), _loop(lambda a, b: a + b)(x, y)
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


@dataclass(frozen=True)
class Distance:
    """A pluggable arc weight: a Column builder and a numpy block kernel."""

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]


def gaussian(gamma: float) -> Distance:
    """Similarity exp(-gamma * euclidean)."""
    return Distance(f"gaussian({gamma})", lambda x, y: F.exp(-gamma * F.sqrt(_square(x, y))), lambda x, y: np.exp(-gamma * np.sqrt(_square_block(x, y))))


def _safe(num: np.ndarray, den: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return np.where(ok, num / np.where(ok, den, 1.0), 0.0)


DISTANCES: dict[str, Distance] = {
    d.name: d
    for d in (
        Distance("euclidean_classic", _square, _square_block),
        Distance("euclidean_standard", lambda x, y: F.sqrt(_square(x, y)), lambda x, y: np.sqrt(_square_block(x, y))),
        Distance("euclid_log", lambda x, y: MAX_ARC_WEIGHT * F.log(_square(x, y) + 1), lambda x, y: MAX_ARC_WEIGHT * np.log(_square_block(x, y) + 1)),
        Distance("chi_square_classic", _chi_classic, _chi_block),
        Distance("chi_square_standard", lambda x, y: _sum(x, y, lambda a, b: _guard(a + b > 0, lambda: F.try_divide((a - b) * (a - b), a + b))), _loop(lambda a, b: _safe((a - b) ** 2, a + b, a + b > 0))),
        Distance("manhattan", lambda x, y: _sum(x, y, lambda a, b: F.abs(a - b)), _loop(lambda a, b: np.abs(a - b))),
        Distance("canberra_classic", lambda x, y: _sum(x, y, lambda a, b: _guard(F.abs(a + b) > 0, lambda: F.try_divide(F.abs(a - b), F.abs(a + b)))), _loop(lambda a, b: _safe(np.abs(a - b), np.abs(a + b), np.abs(a + b) > 0))),
        Distance("canberra_standard", lambda x, y: _sum(x, y, lambda a, b: _guard(a + b > 0, lambda: F.try_divide(F.abs(a - b), F.abs(a) + F.abs(b)))), _loop(lambda a, b: _safe(np.abs(a - b), np.abs(a) + np.abs(b), a + b > 0))),
        Distance("squared_chord", lambda x, y: _sum(x, y, lambda a, b: _guard((a >= 0) & (b >= 0), lambda: F.pow(F.sqrt(F.greatest(a, F.lit(0.0))) - F.sqrt(F.greatest(b, F.lit(0.0))), F.lit(2.0)))), _loop(lambda a, b: np.where((a >= 0) & (b >= 0), (np.sqrt(np.maximum(a, 0)) - np.sqrt(np.maximum(b, 0))) ** 2, 0.0))),
        Distance("squared_chi_squared", lambda x, y: _sum(x, y, lambda a, b: _guard(F.abs(a + b) > 0, lambda: F.try_divide((a - b) * (a - b), F.abs(a + b)))), _loop(lambda a, b: _safe((a - b) ** 2, np.abs(a + b), np.abs(a + b) > 0))),
        Distance("bray_curtis_classic", lambda x, y: _sum(x, y, lambda a, b: _guard(a + b > 0, lambda: F.try_divide(F.abs(a - b), a + b))), _loop(lambda a, b: _safe(np.abs(a - b), a + b, a + b > 0))),
        Distance("bray_curtis_standard", _ratio, _ratio_block),
        gaussian(1.0),
    )
}


def distance(name: str) -> Distance:
    """A registered distance; unknown names raise ValueError."""
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(DISTANCES)}")
    return DISTANCES[name]
