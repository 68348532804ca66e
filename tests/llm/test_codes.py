"""Codes of vectors: plain rounds over all entries give the same codebooks, codes and errors."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from starloom.llm import vector_codes
from starloom.llm.vector_codes import CodeParams, compress

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def plain(rows, params):
    """``(vec_id, label, code, error)`` of the rows and the codebooks, without trees."""
    kept = [(i, label, [math.floor(params.scale * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // params.parts
    cut = [[v[p * width : (p + 1) * width] for p in range(params.parts)] for _, _, v in kept]
    books = [[list(v[p]) for v in cut[: params.entries]] for p in range(params.parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(params.rounds):
        for p, book in enumerate(books):
            members = {}
            for v in cut:
                members.setdefault(nearest(v[p], book)[1], []).append(v[p])
            for i, found in members.items():
                book[i] = [sum(x) // len(found) for x in zip(*found)]
    out = []
    for (i, label, _), v in zip(kept, cut):
        found = [nearest(v[p], books[p]) for p in range(params.parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def compare(spark, rows, params, schema=SCHEMA, extra=()):
    coded, books = compress(spark.createDataFrame([r + tuple(extra) for r in rows], schema), params)
    want, want_books = plain(rows, params)
    got = [(r.vec_id, r.label, r.code, r.error) for r in coded.collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert books.transpose(0, 1, 2).tolist() == want_books
    text = ",".join(str(x) for book in want_books for e in book for x in e)
    assert vector_codes.fingerprint(books) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed,spread", [(0, 3.0), (1, 0.02), (2, 40.0)])
def test_codes_against_plain_rounds(spark, seed, spread):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, spread) for _ in range(8)] for _ in range(7)]
    rows = [(rng.randrange(10**6) * 2000 + i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)], rng.choice([None, 1, 2])) for i in range(700)]
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    # Slices of 37 vectors, so that many trees with few and with many nodes occur.
    compare(spark, rows, CodeParams(parts=4, entries=16, rounds=3, slice_values=300, leaf=3))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, -1.0], 1), (5, [1.0, -1.0], 1), (None, [0.5, 0.25], None), (6, [-0.001, 0.0], None), (7, [0.0, nan], 1), (8, [inf, 0.0], 1)]
    rows += [(9, None, 1), (10, [], 1), (11, [None, 1.0], 2), (2, [2.0, 2.0], 2)] + [(20 + i, [3.0, 3.0], 3) for i in range(50)]
    names = ["key", "cell", "total", "code", "error", "components", "points"]
    schema = SCHEMA + "".join(f", `{n}` STRING" for n in names)
    compare(spark, rows, CodeParams(parts=2, entries=4, leaf=1), schema, ["x"] * len(names))


def test_few_and_no_vectors(spark):
    compare(spark, [(1, [0.5, 1.5], None)], CodeParams(parts=2))
    coded, books = compress(spark.createDataFrame([], SCHEMA), CodeParams(parts=2))
    assert coded.columns == ["vec_id", "label", "code", "error"] and not coded.collect() and not books.size
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA), CodeParams(parts=2))


def test_trees_cover_and_prune():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-2000, 2000, (400, 3)), np.repeat([[5, 5, 5]], 100, axis=0), rng.integers(0, 3, (500, 3))])
    forest = vector_codes.grow(np.concatenate([points, points[::-1]]), 2, 4)
    assert sorted(forest.order) == list(range(2000))
    for centre, lo, hi, child, children, radius2 in forest.nodes:
        members = forest.points[forest.order[lo:hi]]
        assert centre in forest.order[lo:hi] and ((members - forest.points[centre]) ** 2).sum(1).max() == radius2
        if children:
            below = forest.nodes[child : child + children]
            assert below[0][1] == lo and below[-1][2] == hi and (below[1:, 1] == below[:-1, 2]).all()
    # Far entries: each part's whole tree goes to one of them at the root.
    books = np.array([[[0, 0, 0], [10**6, 0, 0]]] * 2)
    nodes, entries, places, _ = vector_codes.walk(forest, books)
    assert nodes.tolist() == [0, 1] and not entries.any() and not len(places)


def test_query(spark):
    from tests.conftest import SF_DIR

    rows = vector_codes.op11_cover_tree_codes(spark, SF_DIR).collect()
    source = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    want, books = plain([(r.vec_id, r.embedding, r.label) for r in source.collect()], CodeParams())
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    text = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert sorted(map(tuple, rows)) == sorted((i, code, error, totals[label], text) for i, label, code, error in want)
