"""The de-duplicated (user, item) rating matrix, in long form, for all folds at once.

The last rating of a pair wins; a neighbour tie goes to the pair that was rated first.  Both depend on the
held-out fold: without fold f, the last (first) rating of a pair is its overall last (first) one unless that
one lies in f, and then the last (first) one outside f.  So one row per pair holds all K answers, and nothing
is replicated per fold before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.schema import DEFAULT_COLUMNS, RatingColumns

CELL = ["value", "value_fold", "value_alt"]
ORDER = ["first", "first_fold", "first_alt"]


def dedupe_last(ratings: DataFrame, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``user, item, rating``: the last rating of each pair, combined before the shuffle."""
    return ratings.groupBy(*cols.pair).agg(F.max_by(cols.rating, cols.seq).alias(cols.rating))


def rating_matrix(ratings: DataFrame, cols: RatingColumns = DEFAULT_COLUMNS, folds: int | None = None) -> DataFrame:
    """``user, item, value, first`` and, with ``folds``, the fold of each and its alternative without that fold.

    With ``folds`` the ratings need a ``fold`` column in 0 .. folds-1.
    """
    if folds is None:
        return ratings.groupBy(*cols.pair).agg(
            F.max_by(cols.rating, cols.seq).alias("value"), F.min(cols.seq).alias("first")
        )
    seq, rating = F.col(cols.seq), F.col(cols.rating)
    per_fold = []
    for f in range(folds):
        here = F.col(cols.fold) == f
        per_fold += [
            F.max(F.when(here, seq)).alias(f"_last{f}"),
            F.max_by(F.when(here, rating), F.when(here, seq)).alias(f"_value{f}"),
            F.min(F.when(here, seq)).alias(f"_first{f}"),
        ]
    grouped = ratings.groupBy(*cols.pair).agg(*per_fold)

    def ordered(kind: str, payload: str, ascending: bool) -> Column:
        entries = F.array(
            *[
                F.when(
                    F.col(f"_{kind}{f}").isNotNull(),
                    F.struct(F.col(f"_{kind}{f}").alias("seq"), F.lit(f).alias("fold"), F.col(f"_{payload}{f}").alias("v")),
                )
                for f in range(folds)
            ]
        )
        return F.sort_array(F.filter(entries, lambda e: e.isNotNull()), asc=ascending)

    ranked = grouped.select(
        *cols.pair, ordered("last", "value", False).alias("_by_last"), ordered("first", "first", True).alias("_by_first")
    )
    return ranked.select(
        *cols.pair,
        F.get("_by_last", F.lit(0))["v"].alias("value"),
        F.get("_by_last", F.lit(0))["fold"].alias("value_fold"),
        F.get("_by_last", F.lit(1))["v"].alias("value_alt"),
        F.get("_by_first", F.lit(0))["v"].alias("first"),
        F.get("_by_first", F.lit(0))["fold"].alias("first_fold"),
        F.get("_by_first", F.lit(1))["v"].alias("first_alt"),
    )


def without_fold(kind: str, fold: Column | None, of: str = "") -> Column:
    """``value`` or ``first`` of a matrix row (of a struct/alias ``of``) for the model that leaves ``fold`` out."""
    at = lambda name: F.col(f"{of}.{name}" if of else name)
    if fold is None:
        return at(kind)
    return F.when(at(f"{kind}_fold") == fold, at(f"{kind}_alt")).otherwise(at(kind))


def fold_ids(folds: int) -> Column:
    """One row per fold."""
    return F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))


def matrix_means(matrix: DataFrame, key: str, prefix: str, folds: int | None = None) -> DataFrame:
    """``key, {prefix}_means, {prefix}_pairs``: one mean per fold left out (NULL where nothing is left)."""
    every = [None] if folds is None else [F.lit(f) for f in range(folds)]
    means = F.array(*[F.avg(without_fold("value", f)) for f in every])
    return matrix.groupBy(key).agg(means.alias(f"{prefix}_means"), F.count("*").alias(f"{prefix}_pairs"))


def fold_global_means(ratings: DataFrame, cols: RatingColumns = DEFAULT_COLUMNS, folds: int | None = None) -> DataFrame:
    """One row, one array: the mean of all ratings outside each fold, repeated pairs included."""
    rating = F.col(cols.rating)
    every = [rating] if folds is None else [F.when(F.col(cols.fold) != f, rating) for f in range(folds)]
    return ratings.agg(F.array(*[F.avg(r) for r in every]).alias("global_means"))


def for_fold(means: Column, fold: Column | None) -> Column:
    """The entry of a per-fold array."""
    return F.get(means, F.lit(0) if fold is None else fold)
