"""Keyed rating statistics: means, spreads and the rating distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starloom.schema import DEFAULT_COLUMNS, MAX_STARS, MIN_STARS, RatingColumns

LOW_UP_TO = 2.0
HIGH_FROM = 4.0


def global_mean(ratings: DataFrame, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row: ``global_mean`` over all ratings, repeated pairs included."""
    return ratings.agg(F.avg(cols.rating).alias("global_mean"))


def with_global_mean(df: DataFrame, ratings: DataFrame, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Attach the mean as a column: a scalar subquery of exactly one row."""
    return df.withColumn("global_mean", global_mean(ratings, cols).scalar())


def key_stats(ratings: DataFrame, key: str, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``key, avg, cnt, var, min, max`` with the population variance.

    All five are algebraic, so a hot key is combined before the shuffle.
    """
    r = F.col(cols.rating)
    return ratings.groupBy(key).agg(
        F.avg(r).alias("avg"), F.count("*").alias("cnt"), F.var_pop(r).alias("var"),
        F.min(r).alias("min"), F.max(r).alias("max"),
    )


def rating_histogram(ratings: DataFrame, key: str, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``key, rating, n``."""
    return ratings.groupBy(key, cols.rating).agg(F.count("*").alias("n"))


def rating_distribution(ratings: DataFrame, key: str, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Per key: count, sum, sum of squares, both extremes with their counts and runners-up, and four counts.

    Built on the (key, rating) histogram.  The two smallest and two largest distinct ratings come from a
    rank filter, which Spark applies before the shuffle as well, so no task ever holds a key's whole history.
    ``second_min`` / ``second_max`` are NULL for a key with a single distinct rating.
    """
    histogram = rating_histogram(ratings, key, cols)
    r, n = F.col(cols.rating), F.col("n")
    counted = lambda predicate: F.sum(F.when(predicate, n).otherwise(F.lit(0)))
    totals = histogram.groupBy(key).agg(
        F.sum(n).alias("cnt"), F.sum(r * n).alias("sum"), F.sum(r * r * n).alias("sumsq"),
        counted(r <= LOW_UP_TO).alias("low"), counted(r >= HIGH_FROM).alias("high"),
        counted(r == MIN_STARS).alias("one"), counted(r == MAX_STARS).alias("five"),
    )
    ends = histogram.select(
        key, "n", F.explode(F.array(F.struct(F.lit(True).alias("low_end"), r.alias("v")),
                                    F.struct(F.lit(False).alias("low_end"), (-r).alias("v")))).alias("end"),
    ).select(key, "n", "end.low_end", "end.v")
    rank = F.row_number().over(Window.partitionBy(key, "low_end").orderBy("v"))
    ends = ends.withColumn("rank", rank).where(F.col("rank") <= 2)
    pick = lambda low_end, place, value: F.max(
        F.when((F.col("low_end") == low_end) & (F.col("rank") == place), value)
    )
    extremes = ends.groupBy(key).agg(
        pick(True, 1, F.col("v")).alias("min"), pick(True, 1, n).alias("min_count"), pick(True, 2, F.col("v")).alias("second_min"),
        pick(False, 1, -F.col("v")).alias("max"), pick(False, 1, n).alias("max_count"), pick(False, 2, -F.col("v")).alias("second_max"),
    )
    return totals.join(extremes, key)


def distribution_stats(distribution: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """``key``, columns to ``keep`` and the nine statistics of a distribution table (variance from the sums, floored at 0)."""
    cnt = F.col("cnt")
    avg = F.col("sum") / cnt
    return distribution.select(
        key, *(keep or []), avg.alias("avg"), "cnt", F.greatest(F.lit(0.0), F.col("sumsq") / cnt - avg * avg).alias("var"), "min", "max",
        *[(F.col(c) / cnt).alias(f"{c}_rate") for c in ["low", "high", "one", "five"]],
    )
