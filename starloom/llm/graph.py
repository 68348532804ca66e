"""Connected components of links that may form very large stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import stage


def _shape(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    ``edges`` has ids ``u, v``.  Large-star and small-star rounds alternate until nothing changes: each links nodes to
    the smallest neighbour, by an aggregate and a join, so no node's links meet in one place.  Rounds are written tables.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, label)
    shape = _shape(edges)
    while shape[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stage(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        rest = large.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stage(rest.unionByName(low.select("u", F.col("low").alias("v"))).where("u != v").distinct(), label)
        last, shape = shape, _shape(edges)
        if shape == last:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
