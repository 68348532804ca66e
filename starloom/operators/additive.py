"""Boosted trees with penalised leaves: an additive loop over single Spark trees.

Spark finds the splits of each tree.  The leaf values are then set from two sums per leaf, so that L1 and L2 penalties hold,
every tree (the first one too) is shrunk, and the start value is the caller's.  The residual is a column of a written table.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.session import stage

# A tree as nested pairs: a leaf is its number; a node is (feature, threshold, left, right).
Node = int | tuple[int, float, "Node", "Node"]
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


@dataclass(frozen=True)
class AdditiveParams:
    """``tree_columns`` is the share of columns a tree may use, ``node_columns`` the share of these tried at each node.

    Columns drawn anew for each level have no counterpart: their share goes into that of the nodes.  A least gain per split
    (gamma) has none either.
    """

    trees: int = 600
    depth: int = 6
    learning_rate: float = 0.02
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    tree_columns: float = 1.0
    node_columns: float = 1.0
    min_rows_per_leaf: int = 1
    max_bins: int = 256
    seed: int = 42
    # Rounds after which the residuals are written, which cuts the lineage; changes no result.
    write_every: int = 10


# The tuned settings of the two models.
STACKED_ADDITIVE = AdditiveParams(
    learning_rate=0.007080805948990546, l1=0.49999999999999994, l2=2.0, row_share=0.6, tree_columns=0.45765817440007944, node_columns=0.4 * 0.4,
    min_rows_per_leaf=10,
)
RICH_ADDITIVE = AdditiveParams(
    learning_rate=0.02, l1=0.6052439683929954, l2=3.0255954163146557, row_share=0.5983273008793066, tree_columns=0.567536501065443,
    node_columns=0.5330728248161238, min_rows_per_leaf=17,
)


@dataclass(frozen=True)
class Tree:
    """Splits on places of the feature vector, and a value for each leaf, which are numbered from the left."""

    root: Node
    values: tuple[float, ...] = ()

    def sql(self, x: str, leaf: bool = False) -> str:
        """The value (or the leaf's number) of a row whose features are the array ``x``, as SQL text."""

        def of(node: Node) -> str:
            if isinstance(node, int):
                return str(node) if leaf else f"{self.values[node]!r}D"
            feature, threshold, left, right = node
            return f"CASE WHEN {x}[{feature}] <= {threshold!r}D THEN {of(left)} ELSE {of(right)} END"

        return of(self.root)


def read_tree(text: str, columns: list[int]) -> Node:
    """The tree in Spark's own description of it; its feature numbers are places in ``columns``."""
    lines: Iterator[str] = (line.strip() for line in text.splitlines()[1:] if line.strip())
    leaves = iter(range(1 << 31))

    def node() -> Node:
        line = next(lines)
        if line.startswith("Predict:"):
            return next(leaves)
        feature, threshold = _SPLIT.match(line).groups()
        left = node()
        next(lines)  # the else of the same split
        return columns[int(feature)], float(threshold), left, node()

    return node()


@dataclass(frozen=True)
class AdditiveModel:
    """``start`` plus ``learning_rate`` times the values of all trees."""

    start: float
    learning_rate: float
    features: str = "features"
    trees: tuple[Tree, ...] = field(default_factory=tuple)

    @property
    def centre(self) -> float:
        return self.start

    def predict(self, rows: DataFrame, raw: str = "raw_prediction", at_a_time: int = 25) -> DataFrame:
        """Add the unclamped prediction.  The trees are expressions, some of them in a column at a time."""
        out = rows.withColumn("_x", vector_to_array(self.features)).withColumn(raw, F.lit(float(self.start)))
        for i in range(0, len(self.trees), at_a_time):
            total = " + ".join(tree.sql("_x") for tree in self.trees[i : i + at_a_time])
            out = out.withColumn(raw, F.col(raw) + F.lit(self.learning_rate) * F.expr(total))
        return out.drop("_x")


def leaf_value(total: float, rows: int, l1: float, l2: float) -> float:
    """The best value of a leaf for squared loss: the residuals' sum, moved towards zero by L1, over rows plus L2."""
    moved = max(abs(total) - l1, 0.0)
    return (moved if total > 0 else -moved) / (rows + l2) if moved else 0.0


def tree_columns(count: int, share: float, seed: int) -> list[int]:
    """The columns that a tree may use: a seeded draw, one at least, in ascending order."""
    return sorted(random.Random(seed).sample(range(count), max(1, round(count * share))))


def _sampled(share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))


def fit_additive(
    rows: DataFrame, params: AdditiveParams = AdditiveParams(), label: str = "stars", features: str = "features",
    start: float | None = None, after: AdditiveModel | None = None,
) -> AdditiveModel:
    """Train on a vector column, from ``start`` (the mean label by default), or go on where the model ``after`` ended.

    Each tree is fitted to the residuals of a seeded share of the rows, on a seeded share of the columns.  Rows with a null
    label are left out; without any row the model is its start, which must then be given.
    """
    data = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_label"), F.col(features).alias("_features"))
    data = stage(data.withColumns({"_x": vector_to_array("_features"), "_row": F.monotonically_increasing_id()}), "vectors")
    first = data.select("_x").first()
    if after is not None:
        if after.learning_rate != params.learning_rate:
            raise ValueError("a model goes on with its own learning rate")
        start = after.start
    elif start is None:
        start = data.agg(F.avg("_label")).first()[0]
        if start is None:
            raise ValueError("no rows with a label to train on, and no start value")
    model = AdditiveModel(float(start), params.learning_rate, features, after.trees if after else ())
    if first is None:
        return model
    so_far = AdditiveModel(model.start, params.learning_rate, "_features", model.trees).predict(data, "_raw")
    data = so_far.withColumn("_residual", F.col("_label") - F.col("_raw")).drop("_raw", "_label").withColumn("_x", vector_to_array("_features"))
    for number in range(len(model.trees), params.trees):
        if (number - len(model.trees)) % params.write_every == 0:
            data = stage(data, "residuals")
        seed = params.seed + number
        columns = tree_columns(len(first[0]), params.tree_columns, seed)
        sample = data.where(_sampled(params.row_share, seed)) if params.row_share < 1 else data
        part = VectorSlicer(inputCol="_features", outputCol="_part", indices=columns).transform(sample.select("_features", "_residual"))
        forest = RandomForestRegressor(
            labelCol="_residual", featuresCol="_part", numTrees=1, bootstrap=False, maxDepth=params.depth, maxBins=params.max_bins,
            featureSubsetStrategy="all" if params.node_columns >= 1 else str(params.node_columns), minInstancesPerNode=params.min_rows_per_leaf, seed=seed,
        )
        root = read_tree(forest.fit(part).trees[0].toDebugString, columns)
        leaf = F.expr(Tree(root).sql("_x", leaf=True)).alias("leaf")
        found = {r.leaf: r for r in sample.groupBy(leaf).agg(F.count("*").alias("n"), F.sum("_residual").alias("s")).collect()}
        values = [leaf_value(found[i].s, found[i].n, params.l1, params.l2) if i in found else 0.0 for i in range(max(found, default=0) + 1)]
        tree = Tree(root, tuple(values) + (0.0,) * (1 << params.depth))
        model = AdditiveModel(model.start, model.learning_rate, features, (*model.trees, tree))
        data = data.withColumn("_residual", F.col("_residual") - F.lit(params.learning_rate) * F.expr(tree.sql("_x")))
    return model
