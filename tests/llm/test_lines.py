"""Repeated and nearly repeated lines, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import line_edits
from starloom.llm.line_edits import LineParams
from tests.llm.helpers import edit_distance, table

PARAMS = LineParams(min_chars=20)


def edited(rng, line, times):
    chars = list(line)
    for _ in range(times):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars.insert(at, rng.choice("xyzé"))
        elif kind == 1:
            chars.pop(at)
        else:
            chars[at] = rng.choice("xyzé")
    return "".join(chars)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcde é") for _ in range(rng.randint(15, 90))) for _ in range(60)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool)
            lines.append(edited(rng, line, rng.choice([0, 0, 1, 2, 3, 4])))
        docs.append((d, "\n".join(lines)))
    return docs


def brute(docs):
    """Report and remaining text of each document."""
    first, report, texts = {}, {}, {}
    for d, text in sorted(docs):
        for n, line in enumerate(text.split("\n")):
            if len(line) >= PARAMS.min_chars:
                first.setdefault(line, (d, n))
    links = {x: [y for y in first if y != x and abs(len(x) - len(y)) <= 2 and edit_distance(x, y) <= 2] for x in first}
    for d, text in docs:
        lines = text.split("\n")
        long = [x for x in lines if len(x) >= PARAMS.min_chars]
        exact = near = 0
        kept = []
        seen = set()
        for line in lines:
            if len(line) < PARAMS.min_chars:
                kept.append(line)
                continue
            again = line in seen or first[line][0] < d
            close = any(first[y] < first[line] for y in links[line])
            exact += again
            near += not again and close
            seen.add(line)
            if not again and not close:
                kept.append(line)
        report[d] = (len(lines), len(long), exact, near, sum(len(links[x]) for x in set(long)))
        texts[d] = "\n".join(kept)
    return report, texts


def test_report_equals_brute_force(spark, corpus):
    got = {r.doc_id: tuple(r)[1:] for r in line_edits.line_report(table(spark, corpus), PARAMS).collect()}
    assert got == brute(corpus)[0]
    assert sum(x[3] for x in got.values()) > 20


def test_texts_equal_brute_force(spark, corpus):
    docs = table(spark, corpus, extra=True)
    out = line_edits.without_repeats(docs, PARAMS)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = brute(corpus)[1]
    assert got == {d: t for d, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_rows_of_every_kind(spark):
    a, b = "a line that is long enough to count", "a line that is lonk enough to count"
    long = "x" * 70_000
    rows = [(1, a), (1, a), (2, f"{a}\nshort"), (3, b), (None, a), (4, None), (5, ""), (6, "\n\n"), (7, long), (8, long + "y"), (9, f"{b}\n{b}")]
    report = line_edits.line_report(table(spark, rows, extra=True), PARAMS).collect()
    assert len(report) == len(rows)
    got = {r.doc_id: (r.n_lines, r.n_long, r.n_exact, r.n_near) for r in report}
    assert got == {
        1: (1, 1, 0, 0), 2: (2, 1, 1, 0), 3: (1, 1, 0, 1), None: (1, 1, 1, 0), 4: (0, 0, 0, 0), 5: (1, 0, 0, 0), 6: (3, 0, 0, 0),
        7: (1, 1, 0, 0), 8: (1, 1, 0, 1), 9: (2, 2, 2, 0),
    }
    kept = sorted(((r.doc_id, r.text) for r in line_edits.without_repeats(table(spark, rows), PARAMS).collect()), key=str)
    assert kept == sorted([(1, a), (1, a), (2, "short"), (4, None), (5, ""), (6, "\n\n"), (7, long)], key=str)


def test_empty_table(spark):
    assert line_edits.line_report(table(spark, [])).count() == 0
    assert line_edits.without_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_probes_and_distance(edits):
    rng = random.Random(edits)
    left = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    right = [edited(rng, x, rng.randint(0, edits + 2)) if len(x) > edits + 2 else x + "a" for x in left]
    want = np.array([min(edit_distance(a, b), edits + 1) for a, b in zip(left, right)])
    assert (line_edits.within_edits(pa.array(left), pa.array(right), edits) == want).all()
    one, two = line_edits.Lines(pa.array(left), 0, split=False), line_edits.Lines(pa.array(right), 0, split=False)
    keys = [(line_edits.index_keys(x, edits), line_edits.probe_keys(x, edits), x.bigrams().view(np.uint64)) for x in (one, two)]
    for i in range(len(left)):
        if want[i] <= edits and min(len(left[i]), len(right[i])) > edits:
            assert set(keys[0][0][i]) & set(keys[1][1][i]) or set(keys[1][0][i]) & set(keys[0][1][i])
            assert int(keys[0][2][i] ^ keys[1][2][i]).bit_count() <= 4 * edits


def most_edits(length):
    return -1 if length < 10 else 1 if length < 20 else 2 if length < 96 else min(length // 32, 31)


def test_growing_threshold_equals_brute_force(spark):
    rng = random.Random(21)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (4, 9, 12, 19, 25, 60, 94, 97, 127, 130, 205, 260, 400, 555, 1000, 1300)]
    lines = set(base)
    for line in base:
        k = max(most_edits(len(line)), 0)
        for times in (1, max(k - 1, 1), k, k, k + 1, k + 2):
            lines.add(edited(rng, line, times))
        at = len(line) // 2
        lines.add(line[:at] + line[at + max(k, 1) :])
    lines = sorted(x for x in lines if x.strip())
    lines += [" ", "\u3000\u3000", "Of, edti oner.", "Of, edti oner."]
    docs = [(i, x) for i, x in enumerate(lines)]
    got = {r.doc_id: (r.n_long, r.n_exact, r.n_near, r.n_links) for r in line_edits.line_report(table(spark, docs), line_edits.WHOLE).collect()}
    distinct = {}
    for d, x in docs:
        if x.strip():
            distinct.setdefault(x, d)
    links = {x: [] for x in distinct}
    for x in distinct:
        for y in distinct:
            if x < y and abs(len(x) - len(y)) <= 31 and edit_distance(x, y) <= most_edits(min(len(x), len(y))):
                links[x].append(y)
                links[y].append(x)
    want = {}
    for d, x in docs:
        if not x.strip():
            want[d] = (0, 0, 0, 0)
            continue
        again = distinct[x] < d
        want[d] = (1, int(again), int(not again and any(distinct[y] < d for y in links[x])), len(links[x]))
    assert got == want
    assert sum(len(v) for x, v in links.items() if len(x) > 200) > 40


def test_short_repeated_lines_count(spark):
    rows = [(i, "Of, edti oner.\n\n   \nunique line " + "abcdefghij"[i] * 5) for i in range(4)]
    got = {r.doc_id: (r.n_long, r.n_exact) for r in line_edits.line_report(table(spark, rows), line_edits.WHOLE).collect()}
    assert got == {0: (2, 0), 1: (2, 1), 2: (2, 1), 3: (2, 1)}


def test_shares_of_slots_give_the_same(spark, monkeypatch):
    """Text for many parts is dealt by slot; a pair that meets in several shares counts once."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (14, 60, 130, 300)]
    docs = [(i, edited(rng, base[i % 4], i % 3)) for i in range(24)]
    want = {r.doc_id: tuple(r) for r in line_edits.line_report(table(spark, docs), line_edits.WHOLE).collect()}
    assert sum(r[5] for r in want.values()) > 40
    monkeypatch.setattr(line_edits, "PART_CHARS", 300)
    assert {r.doc_id: tuple(r) for r in line_edits.line_report(table(spark, docs), line_edits.WHOLE).collect()} == want


def test_shares_of_slots_repeat_no_pair(spark, monkeypatch):
    """A pair is verified in one batch however many shares it meets in, and only buckets of much text are shared out."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (14, 60, 130, 300)]
    docs = table(spark, [(i, edited(rng, base[i % 4], i % 3)) for i in range(24)])
    lines = line_edits.distinct_lines(line_edits._occurrences(docs, line_edits.WHOLE))

    def pairs():
        found = []
        for r in line_edits._batches(docs, lines, line_edits.WHOLE).where("pairs is not null").collect():
            u, v = np.frombuffer(r.pairs, np.int32).reshape(2, -1)
            found += [tuple(sorted((r.keys[a], r.keys[b]))) for a, b in zip(u.tolist(), v.tolist())]
        return sorted(found)

    want = pairs()
    monkeypatch.setattr(line_edits, "PART_CHARS", 300)
    assert pairs() == want and len(set(want)) == len(want) > 20
    shares = line_edits._shares(lines, line_edits.WHOLE)
    assert shares[0] > 1 and shares.max() > 3 and (shares == 1).sum() > 25


@pytest.mark.parametrize("kinds", [4, 300, 70_000])
def test_distances_at_many_thresholds(kinds):
    """Whatever number of characters a word holds; a pair beyond its own threshold gets one more than that."""
    rng = random.Random(kinds)
    every = [chr(i) for i in range(0x4E00, 0x4E00 + kinds + 2048) if not 0xD800 <= i < 0xE000][:kinds]
    left = ["".join(rng.choice(every) for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 90]))) for _ in range(150)] + ["".join(every)]
    right = [edited(rng, x, rng.randint(0, 12)) if len(x) > 12 else x[::-1] + "a" for x in left[:-1]] + [left[-1][1:] + "é"]
    most = np.array([rng.randint(0, 12) for _ in left], np.int64)
    at = np.arange(len(left))
    got = line_edits.within_own_edits(pa.array(left + right), at, at + len(left), most)
    want = [min(edit_distance(a, b), m + 1) for a, b, m in zip(left[:-1], right, most.tolist())] + [min(2, most[-1] + 1)]
    assert got.tolist() == want


def test_slots_of_one_line_are_left_out():
    """What a part holds in memory beside its blocks are the entries of slots that lines share."""
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefgh é") for _ in range(300)) for _ in range(200)]
    lines += [edited(rng, x, 3) for x in lines[:5]]
    texts, blocks = pa.array(lines), []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            blocks.extend(run([pa.RecordBatch.from_arrays([texts], ["text"])]))

    line_edits._blocks(Rows(), line_edits.WHOLE, 1)
    parts = {}
    for batch in blocks:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block")):
            parts.setdefault(part, []).append(line_edits._unpack(block.as_buffer()))
    held = sum(len(x[4]) for part in parts.values() for x in part)
    kept = 0
    for part in parts.values():
        n = sum(len(x[0]) for x in part)
        line, slot, *_ = line_edits._shared(part, np.ones(n, bool), np.arange(n, dtype=np.int32))
        all_lines = np.concatenate([np.repeat(np.arange(len(x[3])), x[3]) for x in part])
        all_slots = np.concatenate([x[4] for x in part])
        shared = {s for s in set(all_slots.tolist()) if len(set(all_lines[all_slots == s].tolist())) > 1}
        owned = set(np.concatenate([x[4][x[7]] for x in part]).tolist())
        assert shared & owned <= set(slot.tolist())
        kept += len(line)
    assert kept < 0.1 * held


def test_texts_of_owners_only_are_joined(spark):
    rows = table(spark, [(i, f"text {i}") for i in range(400)])
    lists = spark.createDataFrame([(i, [i]) for i in range(0, 400, 50)], "doc_id BIGINT, keys ARRAY<BIGINT>")
    got = {r.doc_id for r in line_edits._with_bit_of(rows.select("doc_id", "text"), lists).collect()}
    assert got >= set(range(0, 400, 50)) and len(got) < 20


def test_only_repeated_or_linked_lines_are_decided(spark):
    docs = [(i, "\n".join(f"line number {i} {j} ".ljust(30, chr(97 + j)) + str(i * 7919 + j) * 4 for j in range(5))) for i in range(20)]
    docs += [(20, docs[0][1].split("\n")[0])]
    long, decided = line_edits.line_decisions(table(spark, docs), LineParams(min_chars=20, edits=1))
    assert long.count() == 101
    assert sorted((r.doc_id, r.times, r.exact) for r in decided.collect() if not r.links) == [(0, 1, False), (20, 1, True)]


def test_line_texts_are_found_without_a_shuffle_of_documents(spark):
    docs = table(spark, [(i, f"the line number {i} of all lines here\nmet by document {i % 7} as well\n") for i in range(60)])
    lines = line_edits.distinct_lines(line_edits._occurrences(docs, line_edits.WHOLE))
    wanted = lines.where("length > 30")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = line_edits._texts(docs, wanted, line_edits.WHOLE)
        assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()
        rows = found.join(wanted, ["key", "total", "length"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r.line for r in rows) == sorted(f"the line number {i} of all lines here" for i in range(60))
