"""Joins that stay balanced when one key holds a large share of the rows: one plan for all sizes, nothing counted ahead.

* A lookup has one row per key.  Where it is a written table, a shuffle feeds each side of the join directly, so Spark
  splits the partition of a hot key by itself, or broadcasts a table whose real size is small.
* A join of many to many rows of a key is quadratic, so its rows are dealt into blocks: the number of rows of the key is
  carried as a column, and blocks are joined with blocks, so that a task is bounded by what it makes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.session import stage

# Rows of a key in a block; two blocks make at most this number squared.
BLOCK = 2_000


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "left", label: str = "lookup") -> DataFrame:
    """``left.join(right, keys, how)`` for a ``right`` of one row per key, which is written first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    joined = left.join(stage(right, label), keys, how)
    return joined.select(*left.columns, *([] if how == "left_semi" else [c for c in right.columns if c not in keys]))


def block_counts(df: DataFrame, key: str, name: str, block: int = BLOCK) -> DataFrame:
    """``key, name``: the number of blocks of each key."""
    return df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias(name))


def block_of(by: str, blocks: str) -> Column:
    """The block of a row, by the hash of what tells the rows of a key apart."""
    return F.pmod(F.xxhash64(by), F.coalesce(F.col(blocks), F.lit(1))).cast("int")


def every_block(blocks: str) -> Column:
    """One row per block."""
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(blocks), F.lit(1)) - F.lit(1)))
