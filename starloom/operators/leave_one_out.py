"""Leave-one-out statistics: each rating's user and item statistics without that rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.skew import lookup
from starloom.operators.stats import HIGH_FROM, LOW_UP_TO, rating_distribution
from starloom.schema import DEFAULT_COLUMNS, MAX_STARS, MIN_STARS, RatingColumns

STAT_NAMES = ["avg", "cnt", "var", "min", "max", "low_rate", "high_rate", "one_rate", "five_rate"]


def without_rating(rating: Column, d: Column, mean: Column) -> dict[str, Column]:
    """The nine statistics of distribution ``d`` after removing one ``rating``."""
    left = d["cnt"] - 1
    some = left > 0
    denominator = F.when(some, left)
    avg = (d["sum"] - rating) / denominator
    var = F.greatest(F.lit(0.0), (d["sumsq"] - rating * rating) / denominator - avg * avg)
    lone_min = (rating == d["min"]) & (d["min_count"] == 1)
    lone_max = (rating == d["max"]) & (d["max_count"] == 1)
    rate = lambda count, hit: (count - hit.cast("int")) / denominator
    filled = {
        "avg": (avg, mean),
        "cnt": (left, F.lit(0).cast("bigint")),
        "var": (var, F.lit(0.0)),
        "min": (F.when(lone_min, d["second_min"]).otherwise(d["min"]), mean),
        "max": (F.when(lone_max, d["second_max"]).otherwise(d["max"]), mean),
        "low_rate": (rate(d["low"], rating <= LOW_UP_TO), F.lit(0.0)),
        "high_rate": (rate(d["high"], rating >= HIGH_FROM), F.lit(0.0)),
        "one_rate": (rate(d["one"], rating == MIN_STARS), F.lit(0.0)),
        "five_rate": (rate(d["five"], rating == MAX_STARS), F.lit(0.0)),
    }
    return {name: F.when(some, value).otherwise(empty) for name, (value, empty) in filled.items()}


def leave_one_out(
    ratings: DataFrame, key: str, prefix: str, cols: RatingColumns = DEFAULT_COLUMNS, mean: Column | None = None
) -> DataFrame:
    """``ratings`` plus ``{prefix}_avg .. {prefix}_five_rate``.

    One aggregate and one lookup; a window over the key would put a hot key in one task.  A key
    with no other rating gets the global mean (which is not leave-one-out) and zeros.
    """
    distribution = rating_distribution(ratings, key, cols)
    packed = distribution.select(key, F.struct(*[c for c in distribution.columns if c != key]).alias("_dist"))
    with_mean = ratings if mean is not None else ratings.withColumn(
        "_mean", ratings.agg(F.avg(cols.rating)).scalar()
    )
    joined = lookup(with_mean, packed, key, label="distribution")
    stats = without_rating(F.col(cols.rating), F.col("_dist"), mean if mean is not None else F.col("_mean"))
    return joined.select(*ratings.columns, *[stats[name].alias(f"{prefix}_{name}") for name in STAT_NAMES])
