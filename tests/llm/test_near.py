"""Near-duplicate classes and the graph below them, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import dart_minhash as near
from starloom.llm.graph import components
from starloom.llm.text import normal_shingles
from tests.llm.helpers import Sets, prose, shingle_counts, similarity, table


def classes_of(rows, least=0.8):
    sets = Sets([i for i, _ in rows])
    shingles = {i: shingle_counts(t) for i, t in rows}
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a == b or similarity(shingles[i], shingles[j]) >= least:
                sets.join(i, j)
    return {i: sets.find(i) for i, _ in rows}


def changed(rng, text, places):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), min(places, len(words))):
        words[at] = "changed" + str(rng.randint(0, 99))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = prose(rng, rng.choice([8, 60, 150, 400]))
        rows += [base, base]
        rows += [changed(rng, base, rng.choice([1, 2, 3, 6])) for _ in range(6)]
    # A group whose members are near to some and far from others.
    base = prose(rng, 120)
    rows += [changed(rng, base, n % 9) for n in range(60)]
    rows += [prose(rng, 40) for _ in range(30)]
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark, corpus):
    got = {r.doc_id: (r.class_id, r.class_size) for r in near.near_duplicates(table(spark, corpus)).collect()}
    want = classes_of(corpus)
    sizes = {c: sum(x == c for x in want.values()) for c in want.values()}
    assert got == {i: (c, sizes[c]) for i, c in want.items()}


def test_keep_one_keeps_the_lowest_of_each_class(spark, corpus):
    docs = table(spark, corpus, extra=True)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes_of(corpus).values()))


def test_rows_of_every_kind(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, ""), (6, " \n"), (7, "one"), (8, "One!"), (9, "two")]
    got = near.near_duplicates(table(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].class_id == by_id[2].class_id == 1 and by_id[1].class_size == 4
    assert by_id[3].class_id is None and by_id[3].class_size == 1
    assert by_id[4].class_id == by_id[5].class_id == 4 and by_id[6].class_id == 6
    # Equal but for case and punctuation: equal shingles.
    assert by_id[7].class_id == by_id[8].class_id == 7 and by_id[9].class_id == 9
    kept = near.keep_one(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, "-" if r.text is None else r.text) for r in kept) == [(0, "-"), (1, text), (3, "-"), (4, ""), (6, " \n"), (7, "one"), (9, "two")]
    # No ids at all: the class stays one.
    alone = [(None, text), (None, text), (None, text.upper())]
    assert near.keep_one(table(spark, alone)).count() == 1


def test_empty_table(spark):
    empty = table(spark, [])
    assert near.near_duplicates(empty).count() == 0 and near.keep_one(empty).count() == 0


@pytest.mark.parametrize("words", [5, 12, 300, 5000])
def test_signatures_agree_as_often_as_the_similarity(words):
    rng = random.Random(words)
    params = near.NearParams(bands=100, rows=5)
    base = prose(rng, words)
    texts = [base, changed(rng, base, max(1, words // 40)), base + " " + base, prose(rng, words)]
    prints, first = normal_shingles(pa.array(texts), 5)
    signature = near.signatures(prints, first, params)
    assert (signature != 0).all()
    for j in range(1, 4):
        want = similarity(shingle_counts(texts[0]), shingle_counts(texts[j]))
        got = (signature[0] == signature[j]).mean()
        assert abs(got - want) < 5 * (0.25 / 500) ** 0.5 + 0.01
    exact = near.similarities(pa.array([texts[0]] * 4), pa.array(texts), 5)
    assert np.allclose(exact, [similarity(shingle_counts(texts[0]), shingle_counts(t)) for t in texts])


def test_a_signature_does_not_depend_on_the_batch():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (3, 50, 7, 900)]
    together = near.signatures(*normal_shingles(pa.array(texts), 5))
    for i, text in enumerate(texts):
        assert (near.signatures(*normal_shingles(pa.array([text]), 5))[0] == together[i]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 340)]
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()}
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def test_the_sketch_filter_passes_pairs_at_the_threshold():
    params = near.NearParams()
    # Of independent bins, the share that agrees falls below this once in 30,000 times (4 deviations).
    least = params.similarity - 4 * (params.similarity * (1 - params.similarity) / params.bins) ** 0.5
    assert (1 - least) * 14 / 15 <= params.most_different
