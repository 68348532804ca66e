"""The additive loop over single trees: leaves, shrinkage, columns, resuming."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.linalg import Vectors

from starloom.operators.additive import AdditiveModel, AdditiveParams, Tree, fit_additive, leaf_value, read_tree, tree_columns


def rows(spark, seed=0, n=400, width=4):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = [float(rng.randrange(6)) for _ in range(width)]
        out.append((3.0 + (x[0] > 2) - 2.0 * (x[1] > 3) * (x[2] > 1) + rng.gauss(0, 0.1), Vectors.dense(x)))
    return spark.createDataFrame(out, ["stars", "features"]).repartition(3)


def replayed(data, model, params):
    """The leaf values that the rows give, tree after tree, and the final predictions."""
    residual = [y - model.start for y, _ in data]
    for tree in model.trees:
        def leaf(x, node):
            while not isinstance(node, int):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            return node

        at = [leaf(x, tree.root) for _, x in data]
        for i in set(at):
            mine = [e for e, j in zip(residual, at) if j == i]
            assert tree.values[i] == pytest.approx(leaf_value(sum(mine), len(mine), params.l1, params.l2))
            assert len(mine) >= params.min_rows_per_leaf
        residual = [e - params.learning_rate * tree.values[j] for e, j in zip(residual, at)]
    return [y - e for (y, _), e in zip(data, residual)]


def test_leaf_values():
    assert leaf_value(10.0, 4, 2.0, 4.0) == 1.0
    assert leaf_value(-10.0, 4, 2.0, 4.0) == -1.0
    assert leaf_value(1.5, 4, 2.0, 4.0) == 0.0
    assert leaf_value(0.0, 0, 0.0, 0.0) == 0.0


def test_tree_from_text_and_as_sql(spark):
    text = "DecisionTree\n  If (feature 1 <= -0.5)\n   Predict: 7.0\n  Else (feature 1 > -0.5)\n   If (feature 0 <= 1.0E-5)\n    Predict: 1\n   Else (feature 0 > 1.0E-5)\n    Predict: 2\n"
    tree = Tree(read_tree(text, [3, 5]), (1.5, -2.0, 1e-7))
    assert tree.root == (5, -0.5, 0, (3, 1e-05, 1, 2))
    df = spark.createDataFrame([([0.0] * 5 + [-1.0],), ([0.0] * 6,), ([0.0, 0.0, 0.0, 1.0, 0.0, 0.0],)], "x array<double>")
    assert [tuple(r) for r in df.selectExpr(tree.sql("x"), tree.sql("x", leaf=True)).collect()] == [(1.5, 0), (-2.0, 1), (1e-07, 2)]


def test_every_tree_is_shrunk_and_penalised(spark):
    params = AdditiveParams(trees=5, depth=3, learning_rate=0.3, l1=1.5, l2=3.0, min_rows_per_leaf=7, write_every=2)
    data = rows(spark)
    model = fit_additive(data, params, start=2.0)
    assert model.start == 2.0 and len(model.trees) == 5
    plain = [(r.stars, r.features.toArray()) for r in data.collect()]
    want = replayed(plain, model, params)
    got = [r.raw_prediction for r in model.predict(data, at_a_time=2).collect()]
    assert sorted(got) == pytest.approx(sorted(want))
    # From 2.0 the first tree alone goes no further than its rate.
    first = AdditiveModel(2.0, 0.3, trees=model.trees[:1]).predict(data)
    assert max(abs(r.raw_prediction - 2.0) for r in first.collect()) <= 0.3 * max(map(abs, model.trees[0].values)) + 1e-9


def test_a_tree_uses_its_columns_only(spark):
    params = AdditiveParams(trees=6, depth=3, tree_columns=0.5, node_columns=0.5, row_share=0.7, seed=5)
    model = fit_additive(rows(spark, 1), params)

    def used(node):
        return set() if isinstance(node, int) else {node[0]} | used(node[2]) | used(node[3])

    drawn = [set(tree_columns(4, 0.5, 5 + i)) for i in range(6)]
    assert all(used(tree.root) <= columns and len(columns) == 2 for tree, columns in zip(model.trees, drawn))
    assert len({tuple(c) for c in drawn}) > 1


def test_resuming_gives_the_same_trees(spark):
    params = AdditiveParams(trees=4, depth=2, learning_rate=0.2, l2=1.0, write_every=3)
    data = rows(spark, 2)
    whole = fit_additive(data, params)
    half = fit_additive(data, AdditiveParams(trees=2, depth=2, learning_rate=0.2, l2=1.0))
    resumed = fit_additive(data, params, after=half)
    assert [t.root for t in resumed.trees] == [t.root for t in whole.trees]
    assert [v for t in resumed.trees for v in t.values] == pytest.approx([v for t in whole.trees for v in t.values])
    with pytest.raises(ValueError):
        fit_additive(data, AdditiveParams(trees=4, learning_rate=0.5), after=half)


def test_no_rows_and_null_labels(spark):
    empty = spark.createDataFrame([], rows(spark, n=1).schema)
    assert fit_additive(empty, AdditiveParams(trees=2), start=3.5).trees == ()
    with pytest.raises(ValueError):
        fit_additive(empty, AdditiveParams(trees=2))
    some = spark.createDataFrame([(None, Vectors.dense([1.0])), (4.0, Vectors.dense([1.0])), (4.0, Vectors.dense([1.0]))], rows(spark, n=1).schema)
    model = fit_additive(some, AdditiveParams(trees=2))
    assert [r.raw_prediction for r in model.predict(some).collect()] == [4.0] * 3
