"""Accuracy of predictions: RMSE of one or many prediction columns, and the error histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bands of the error histogram, in stars.
ERROR_BANDS = ["below 1", "1 to 2", "2 to 3", "above 3"]


def rmse(label: str, prediction: str) -> Column:
    error = F.col(label) - F.col(prediction)
    return F.sqrt(F.avg(error * error))


def rmse_ladder(rows: DataFrame, label: str, predictions: list[str]) -> DataFrame:
    """``model, rmse``: all columns in a single pass."""
    wide = rows.agg(*[rmse(label, p).alias(p) for p in predictions])
    return wide.unpivot([], predictions, "model", "rmse")


def error_histogram(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """``band, n`` of the absolute error: below 1, [1, 2), [2, 3), 3 and above."""
    error = F.abs(F.col(label) - F.col(prediction))
    below, one, two, above = map(F.lit, ERROR_BANDS)
    band = F.when(error < 1, below).when(error < 2, one).when(error < 3, two).otherwise(above)
    return rows.where(error.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
