"""Keyed and leave-one-out statistics against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from starloom.operators import stats
from starloom.operators.leave_one_out import STAT_NAMES, leave_one_out
from starloom.operators.skew import lookup


def ratings_frame(spark, rows):
    return spark.createDataFrame(
        [(u, i, float(s), n) for n, (u, i, s) in enumerate(rows)], "user_id string, item_id string, stars double, seq bigint"
    )


def random_rows(seed, n, users, items):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(users)}", f"i{rng.randrange(items)}", rng.choice([1, 1.5, 2, 3, 4, 4.5, 5])) for _ in range(n)]


def expected(values, mean):
    if not values:
        return [mean, 0, 0.0, mean, mean, 0.0, 0.0, 0.0, 0.0]
    n = len(values)
    avg = sum(values) / n
    share = lambda f: sum(map(f, values)) / n
    return [
        avg, n, sum((v - avg) ** 2 for v in values) / n, min(values), max(values),
        share(lambda v: v <= 2), share(lambda v: v >= 4), share(lambda v: v == 1), share(lambda v: v == 5),
    ]


def hot_rows_case():
    rows = random_rows(3, 120, 12, 15)
    return rows + [("hot", f"i{k % 15}", 1 + k % 5) for k in range(60)] + [("solo", "only", 4), ("pair", "i1", 2), ("pair", "i2", 5)]


def test_key_stats(spark):
    rows = random_rows(1, 200, 20, 10)
    got = {r.user_id: r for r in stats.key_stats(ratings_frame(spark, rows), "user_id").collect()}
    groups = defaultdict(list)
    for u, _, s in rows:
        groups[u].append(s)
    assert set(got) == set(groups)
    for u, values in groups.items():
        want = expected(values, None)
        assert [got[u].avg, got[u].cnt, got[u]["var"], got[u].min, got[u].max] == pytest.approx(want[:5])


def test_rating_distribution(spark):
    rows = hot_rows_case()
    got = {r.user_id: r.asDict() for r in stats.rating_distribution(ratings_frame(spark, rows), "user_id").collect()}
    groups = defaultdict(list)
    for u, _, s in rows:
        groups[u].append(s)
    assert set(got) == set(groups)
    for u, v in groups.items():
        distinct = sorted(set(v))
        want = {
            "user_id": u, "cnt": len(v), "sum": sum(v), "sumsq": sum(x * x for x in v), "low": sum(x <= 2 for x in v),
            "high": sum(x >= 4 for x in v), "one": v.count(1), "five": v.count(5), "min": distinct[0],
            "min_count": v.count(distinct[0]), "second_min": distinct[1] if len(distinct) > 1 else None, "max": distinct[-1],
            "max_count": v.count(distinct[-1]), "second_max": distinct[-2] if len(distinct) > 1 else None,
        }
        assert got[u] == want


@pytest.mark.parametrize("key,position", [("user_id", 0), ("item_id", 1)])
def test_leave_one_out(spark, key, position):
    rows = hot_rows_case()
    mean = sum(r[2] for r in rows) / len(rows)
    out = leave_one_out(ratings_frame(spark, rows), key, "k").collect()
    assert len(out) == len(rows)
    for r in out:
        others = [x[2] for n, x in enumerate(rows) if n != r.seq and x[position] == rows[r.seq][position]]
        assert [r[f"k_{name}"] for name in STAT_NAMES] == pytest.approx(expected(others, mean), abs=1e-9)


def test_leave_one_out_ignores_own_rating(spark):
    rows = hot_rows_case()
    changed = [(u, i, 3.0 if (n == 5) else s) for n, (u, i, s) in enumerate(rows)]
    pick = lambda rs: leave_one_out(ratings_frame(spark, rs), "user_id", "k").where("seq = 5").drop("stars").collect()
    assert pick(rows) == pick(changed)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_equals_plain_join(spark, how):
    left = spark.createDataFrame([("a", n) for n in range(40)] + [("b", 1), ("c", 2)], "k string, x int")
    right = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, y double")
    got, want = lookup(left, right, "k", how), left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_last_and_merged_rows_are_aggregated_in_place(spark):
    """Fixed-width buffers: no sort-based aggregate where the order is a number."""
    from starloom.operators.matrix import dedupe_last, rating_matrix

    frame = ratings_frame(spark, random_rows(5, 50, 5, 5)).withColumn("fold", F.col("seq").cast("int") % 3)
    for df in (dedupe_last(frame), rating_matrix(frame), rating_matrix(frame, folds=3)):
        assert "SortAggregate" not in df._jdf.queryExecution().toString()


def test_oracles_use_nothing_of_the_library():
    import ast
    from pathlib import Path

    tree = ast.parse((Path(__file__).parent.parent / "workload" / "oracles.py").read_text())
    names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
    assert not [n for n in names if n.startswith(("starloom", "workload"))]
