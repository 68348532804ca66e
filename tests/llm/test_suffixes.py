"""Repeated strings: a dictionary of all strings of the length finds the same bytes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from starloom.llm import suffixes
from starloom.llm.suffixes import RepeatParams, op12_deep_shallow, remove_repeats
from starloom.llm.text import Texts
from tests.llm.helpers import prose, table

SMALL = RepeatParams(length=12, anchor=4, piece_bytes=400, part_bytes=3000, shallow=8, hot_pieces=4)


def plain(rows, length):
    order = lambda i: -(2**63) if i is None else i
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            key = data[s : s + length]
            first[key] = min(first.get(key, (order(i), s)), (order(i), s))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (order(i), s):
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shallow", [8, 16, 200])
def test_order_of_strings(shallow):
    rng = random.Random(shallow)
    words = [bytes(rng.choices(b"ab\x00\xff", k=40)) for _ in range(6)]
    data = np.frombuffer(b"".join(rng.choice(words) for _ in range(300)) + bytes(40) + b"a" * 200, np.uint8)
    starts = np.array([rng.randrange(len(data) - 60) for _ in range(4000)])
    lengths = np.array([rng.choice([0, 1, 7, 8, 9, 31, 32, 33, 60]) for _ in starts])
    order, new = suffixes.sort_strings(data, starts, lengths, shallow)
    strings = [(int(n), data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    found = [strings[i] for i in order]
    assert found == sorted(strings)
    assert new.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


def test_equal_strings_have_equal_anchors():
    rng = random.Random(1)
    passage = bytes(rng.choices(b"abc", k=80))
    texts = [bytes(rng.choices(b"abc", k=rng.randint(0, 50))) + passage + b"a" * 30 for _ in range(20)] + [b"", b"ab" * 100]
    data = np.frombuffer(b"".join(texts), np.uint8)
    runs = suffixes.anchor_runs(Texts(data, np.cumsum([0] + [len(t) for t in texts])), 20, 5)
    starts = [(int(s) + j, int(h)) for s, n, h in zip(runs.start, runs.count, runs.hash) for j in range(n)]
    ends = np.cumsum([len(t) for t in texts])
    assert [s for s, _ in starts] == [s for s in range(len(data) - 19) if s + 20 <= ends[np.searchsorted(ends, s, "right")]]
    anchors = {}
    for s, h in starts:
        assert anchors.setdefault(data[s : s + 20].tobytes(), h) == h


def corpus(seed, letters="abcd"):
    rng = random.Random(seed)
    passages = [prose(rng, 12, letters) for _ in range(4)] + ["é中" * 10, "x" * 50]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else prose(rng, rng.randint(1, 10), letters) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(2000 + i, rows[i % 3][1]) for i in range(20)] + [(3000 + i, rows[i][1][:-1] + "!") for i in range(10)]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_strings(spark, seed):
    rows = corpus(seed)
    assert got(remove_repeats(table(spark, rows).repartition(3), SMALL)) == plain(rows, SMALL.length)


def test_edge_cases(spark):
    rng = random.Random(9)
    long = prose(rng, 8000, "abcdefgh")
    rows = [(1, None), (2, ""), (3, "a" * 400), (4, "ab" * 300), (None, long[:3000]), (5, long), (5, long), (6, "b" + long[500:900]), (6, long[500:700] + "z"), (7, "short"), (8, "short")]
    for params in (RepeatParams(), SMALL):
        assert got(remove_repeats(table(spark, rows, extra=True), params)) == plain(rows, params.length)
    assert got(remove_repeats(table(spark, []), SMALL)) == []


def test_long_texts_in_segments(spark, monkeypatch):
    """Anchors of a text longer than one segment are those of the whole text."""
    rng = random.Random(4)
    texts = [prose(rng, 500, "abc").encode() for _ in range(3)]
    data = Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    each = lambda r: [(int(s) + j, int(h)) for s, n, h in zip(r.start, r.count, r.hash) for j in range(n)]
    want = each(suffixes.anchor_runs(data, 100, 24))
    monkeypatch.setattr(suffixes, "SEGMENT", 333)
    assert each(suffixes.anchor_runs(data, 100, 24)) == want


def test_kept_bytes(spark):
    rows = corpus(3)
    for r in remove_repeats(table(spark, rows), SMALL, texts=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_query(spark):
    from tests.conftest import SF_DIR

    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert got(op12_deep_shallow(spark, SF_DIR)) == plain(source, 100)
