"""The pipeline stage by stage against a brute-force version, over a small made corpus and over the given small tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from starloom.llm import language
from starloom.session import stage
from tests.conftest import SF_DIR
from tests.llm.helpers import SCHEMA, prose, table
from tests.llm.test_near import classes_of
from tests.llm.test_output import encode
from tests.llm.test_search import contained


def distance_within(a, b, most):
    """Edit distance along a band; ``most + 1`` beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
        row = new
    return min(row.get(len(b), far), far)


def brute_language(rows, model, params):
    """Ids of the documents that are not rejected, by counting n-grams one by one."""
    def slot(gram):
        h = gram * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - (params.dimensions - 1).bit_length())

    kept = []
    for i, text in rows:
        counts = np.zeros(params.dimensions)
        data = [0 if b < 128 and not chr(b).isalpha() else b for b in (text or "").lower().encode()]
        for at, b in enumerate(data):
            one = data[at - 1] if at else 0
            two = data[at - 2] if at > 1 else 0
            if b:
                counts[slot(b)] += 1
            if b or one:
                counts[slot(one << 8 | b | 1 << 24)] += 1
            if one and (b or two):
                counts[slot(two << 16 | one << 8 | b | 2 << 24)] += 1
        vector = np.log1p(counts) * model.weights
        length = np.linalg.norm(vector)
        score = max(model.centroids @ (vector / length)) if length else 0.0
        cls = int(np.clip(math.floor(math.log2(max(counts.sum(), 1))) - 3, 0, params.length_classes - 1))
        if any(c.isalpha() for c in text or "") and score >= model.lowest[cls]:
            kept.append(i)
    return kept


def most_edits(shorter):
    return 0 if shorter < 10 else 1 if shorter < 20 else 2 if shorter < 96 else min(shorter // 32, 31)


def brute_lines(rows):
    """Every line with a visible character: equal ones of any length, and near ones by the threshold of the shorter."""
    first = {}
    for d, text in sorted(rows):
        for n, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line, (d, n))
    lines = list(first)
    near = set()
    for n, x in enumerate(lines):
        for y in lines[:n]:
            edits = most_edits(min(len(x), len(y)))
            if abs(len(x) - len(y)) <= edits and edits and distance_within(x, y, edits) <= edits:
                near.add(max(x, y, key=first.get))
    out = []
    for d, text in rows:
        kept, seen = [], set()
        for line in text.split("\n"):
            if not line.strip() or (line not in seen and first[line][0] >= d and line not in near):
                kept.append(line)
            seen.add(line)
        if "\n".join(kept) == text or "\n".join(kept).strip():
            out.append((d, "\n".join(kept)))
    return out


def check_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    columns, sizes = docs.columns, [docs.count()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    params = language.LanguageParams()
    for name, function in corpus_pipeline.STAGES:
        if name == "language":
            kept = set(brute_language(rows, language.fit(docs, params), params))
            want = [(i, t) for i, t in rows if i in kept]
        elif name == "lines":
            want = brute_lines(rows)
        elif name == "near_duplicates":
            kept = set(classes_of(rows).values())
            want = [(i, t) for i, t in rows if i in kept]
        elif name == "benchmark":
            hit = {d for d, _ in contained(rows, items)}
            want = [(i, t) for i, t in rows if i not in hit]
        docs = stage(function(spark, docs, sf_dir), name)
        if name == "packing":
            got = docs.collect()
            assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(encode(t)) + 1) for i, t in rows)
            assert all(r.bucket_len >= r.n_tokens for r in got) and len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
            break
        assert docs.columns == columns
        rows = sorted((r.doc_id, r.text) for r in docs.collect())
        assert rows == sorted(want), name
        sizes.append(len(rows))
    return sizes


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(6)]
    docs = []
    for i in range(90):
        letters = ("abcdefghij", "mnopqrstuv")[i % 2]
        text = prose(rng, rng.choice([5, 40, 120]), letters)
        if i % 10 == 3:
            text = docs[rng.randrange(len(docs))][1].replace("a", "b", 1)
        if i % 20 == 9:  # the same words in other lines: no line repeats, the document does
            text = " ".join(max((t for _, t, _ in docs[-4:]), key=len).split())
        if i % 15 == 4:
            text += "\n" + docs[0][1].split("\n")[0]
        if i % 12 == 5:
            text += "\n" + rng.choice(items)[1]
        if i % 30 == 7:
            text = ("12345 ", "привет мир ", "")[i // 30] * 40
        docs.append((i, text, "aa" if i % 2 else "zz"))
    path = str(tmp_path_factory.mktemp("made"))
    table(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_made_corpus(spark, made):
    sizes = check_stages(spark, made)
    assert all(b < a for a, b in zip(sizes, sizes[1:])), sizes


def test_given_tables(spark):
    check_stages(spark, SF_DIR)


def test_empty_and_odd_rows(spark, tmp_path):
    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None), (1, None, "aa", "s", 0), (2, "", None, "s", 0)])):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, "a b c d e f")], "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
        assert corpus_pipeline.run(spark, path).count() == 0


def test_run_gives_the_last_stage(spark, made):
    out = corpus_pipeline.run(spark, made)
    assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"] and out.count() > 0
