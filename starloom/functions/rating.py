"""Column expressions of the rating model: clamping, shrinkage and similarity weighting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.schema import MAX_STARS, MIN_STARS


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: str | Column, low: float = MIN_STARS, high: float = MAX_STARS) -> Column:
    """``x`` held inside the scale. NULL stays NULL (``greatest``/``least`` would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def shrink(mean: Column, count: Column, prior: Column, strength: float) -> Column:
    """Bayesian mean: ``count`` observations of ``mean`` against ``strength`` of ``prior``."""
    return (mean * count + prior * F.lit(float(strength))) / (count + F.lit(float(strength)))


def confidence(count: Column, strength: float) -> Column:
    return count / (count + F.lit(float(strength)))


def warm_or_cold(count: Column, warm: Column, cold: Column) -> Column:
    return F.when(count > 0, warm).otherwise(cold)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where ``whole`` is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def weigh_similarity(r: Column, n: Column, full_weight_at: int, amplification: float) -> Column:
    """Significance weighting, then case amplification; the sign of ``r`` is kept."""
    weighted = r * F.least(n, F.lit(full_weight_at)) / F.lit(float(full_weight_at))
    return weighted * F.pow(F.abs(weighted), F.lit(amplification))


def min_coraters(min_abs_sim: float, full_weight_at: int, amplification: float) -> int:
    """The fewest co-raters with which a weighted similarity can exceed ``min_abs_sim``.

    |r| <= 1, so a kept pair has (min(n, N)/N)^(1+a) > t, i.e. n > N * t^(1/(1+a)).  A small margin
    keeps pairs at the edge, where rounding decides; the exact threshold test follows anyway.
    """
    edge = full_weight_at * min_abs_sim ** (1.0 / (1.0 + amplification))
    return max(2, math.floor(edge - 1e-9) + 1)


def expand_around(prediction: Column, centre: Column, slope: float, shift: float) -> Column:
    """Linear calibration around the global mean, clamped to the scale."""
    return clamp(centre + F.lit(slope) * (prediction - centre) + F.lit(shift))
