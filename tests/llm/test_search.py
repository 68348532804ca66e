"""Benchmark items and license notices inside documents, against brute force."""

from __future__ import annotations

import random

import pytest

from starloom.llm import decontaminate, licenses
from starloom.llm.decontaminate import ContainmentParams
from tests.llm.helpers import NORMAL_WORD, prose, shingle_counts, table


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id BIGINT, text STRING")


def contained(docs, items, least=0.8):
    sets = [(i, len(NORMAL_WORD.findall(t.lower())), set(shingle_counts(t))) for i, t in items if t is not None]
    out = set()
    for d, text in docs:
        # Short items are shingles of their own length.
        mine = {width: set(shingle_counts(text or "", width)) for width in range(1, 6)}
        out |= {(d, i) for i, n, s in sets if s and len(s & mine[min(n, 5)]) >= least * len(s) - 1e-9}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([2, 3, 4, 5, 6, 9, 12, 20, 35, 60, 140, 400]))) for i in range(60)]
    docs = []
    for d in range(150):
        words = prose(rng, rng.choice([10, 200, 3000])).split(" ")
        for _ in range(rng.choice([0, 1, 1, 2])):
            passage = rng.choice(items)[1].split(" ")
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = "other"
            if rng.random() < 0.3:
                passage = [w.upper() + "," for w in passage]
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    return docs, items


def test_equal_to_brute_force(spark, corpus):
    docs, items = corpus
    want = contained(docs, items)
    assert len(want) > 60
    got = decontaminate.contained_items(table(spark, docs), items_table(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    # In several sets of items nothing changes.
    small = ContainmentParams(set_bytes=2000)
    got = decontaminate.contained_items(table(spark, docs), items_table(spark, items), small).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontaminate.without_items(table(spark, docs, extra=True), items_table(spark, items), small)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_rows_of_every_kind(spark):
    passage = "the quick brown fox jumps over the lazy dog today"
    long = " ".join(f"w{i}" for i in range(30_000)) + " " + passage + " " + " ".join(f"v{i}" for i in range(30_000))
    docs = [(1, long), (1, long), (None, passage), (2, None), (3, ""), (4, "..."), (5, "Just four words here"), (6, "just four words here too")]
    items = [(10, passage), (10, passage), (None, "just FOUR words here"), (11, None), (12, ""), (13, "...")]
    got = decontaminate.contained_items(table(spark, docs, extra=True), items_table(spark, items)).collect()
    count = {}
    for r in got:
        count[r.doc_id, r.item_id] = count.get((r.doc_id, r.item_id), 0) + 1
    assert count == {(1, 10): 4, (None, 10): 2, (5, None): 1, (6, None): 1}
    kept = decontaminate.without_items(table(spark, docs), items_table(spark, items)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 4]


def test_empty_tables(spark):
    none, some = items_table(spark, []), items_table(spark, [(1, "a b c d e f")])
    assert decontaminate.contained_items(table(spark, [(1, "a b")]), none).count() == 0
    assert decontaminate.contained_items(table(spark, []), some).count() == 0
    assert decontaminate.without_items(table(spark, [(1, "a b")]), none).count() == 1


def test_license_notices(spark):
    rng = random.Random(1)
    docs = [(0, None), (1, ""), (2, prose(rng, 500))]
    for n, (_, text) in enumerate(licenses.TEMPLATES):
        words = prose(rng, rng.choice([20, 2000])).split(" ")
        at = rng.randrange(len(words))
        words[at:at] = text.replace(",", " ,").upper().split(" ")
        docs.append((10 + n, " ".join(words)))
    got = licenses.license_notices(table(spark, docs, extra=True)).collect()
    assert {(r.doc_id, r.template) for r in got} == contained(docs, list(enumerate(t for _, t in licenses.TEMPLATES)))
    assert {(10 + n, n) for n in range(len(licenses.TEMPLATES))} <= {(r.doc_id, r.template) for r in got}
    assert licenses.license_notices(table(spark, [])).count() == 0


def test_short_notices_and_whole_licenses_inside_texts(spark):
    rng = random.Random(4)
    known = licenses.TEMPLATES + licenses.SHORT_NOTICES + licenses.whole_texts()
    docs = [(-1, prose(rng, 300))]
    for n, (_, text) in enumerate(known[len(licenses.TEMPLATES) :], len(licenses.TEMPLATES)):
        docs.append((n, f"{prose(rng, 300)}\n{text.upper()}\n{prose(rng, 300)}"))
    got = {(r.doc_id, r.template) for r in licenses.license_notices(table(spark, docs), known).collect()}
    assert {(n, n) for n in range(len(licenses.TEMPLATES), len(known))} <= got
    assert not any(d == -1 for d, _ in got)
    assert {"GPL-3.0", "LGPL-2.1", "CC0-1.0"} <= {name for name, _ in licenses.whole_texts()}
