"""Language, quality and language-model scores: brute force where there is one, else held-out figures."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from starloom.llm import attention, importance, language, lm_score
from tests.conftest import SF_DIR
from tests.llm.helpers import WORD, prose, table


def remainder(doc_id, divisor):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor


# Language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in got)
    judged = [r for r in got if r.held_out and r.n_chars > 100]
    assert sum(r.lang_pred == r.lang for r in judged) > 0.98 * len(judged)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in judged)


def test_language_rows_of_every_kind(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60, letters), lang) for i in range(60) for letters, lang in [("abcdef", "aa"), ("uvwxyz", "zz")][i % 2 : i % 2 + 1]]
    odd = [(100, None, "aa"), (101, "", "aa"), (102, "12 34 !", "zz"), (None, prose(rng, 60, "uvwxyz"), None), (103, "привет мир " * 50, None), (104, "abc " * 40_000, "aa"), (105, prose(rng, 40_000, "abcdef"), "aa")]
    docs = table(spark, rows + odd + odd, extra=True)
    model = language.fit(docs)
    assert model.languages == ["aa", "zz"]
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) + 2 * len(odd)
    by_id = {r.doc_id: r for r in got}
    for i in (100, 101, 102):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[None].lang_pred == "zz" and not by_id[None].rejected
    # A single word over and over is unlike all other texts, label or not.
    assert by_id[103].rejected and by_id[104].rejected and not by_id[105].rejected
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows)
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} | {None, 105}


def test_language_without_labels_or_rows(spark):
    docs = table(spark, [(1, "abc", None), (2, "abd", None)])
    assert {(r.lang_pred, r.rejected) for r in language.predict(docs, language.fit(docs)).collect()} == {("und", True)}
    empty = table(spark, [])
    assert language.predict(empty, language.fit(empty)).count() == 0


def test_copies_do_not_displace_other_texts_of_the_sample(spark):
    rng = random.Random(17)
    texts = [prose(rng, 30) for _ in range(30)]
    ids = [i for i in range(3000) if remainder(i, 5) != 0]
    made = []
    for copied in texts[:6]:  # one of them has a low hash
        made.append([(i, t, "aa") for i, t in zip(ids, texts + [copied] * 60)])
    params = language.LanguageParams(sample=40)
    for rows in made:
        assert {r.text for r in language.sample_of(table(spark, rows), params).collect()} == set(texts)


def test_statistics_take_all_learnable_rows(spark):
    rng = random.Random(18)
    ids = [i for i in range(400) if remainder(i, 5) != 0][:80]
    docs = table(spark, [(i, prose(rng, 60), "aa") for i in ids])
    params = language.LanguageParams(sample=5)
    model = language.fit(docs, params)
    counted = language.counts(language.pa.array([r.text for r in docs.collect()]), params.dimensions)
    weights = np.log((1 + len(ids)) / (1 + (counted > 0).sum(axis=0))) + 0.05
    assert np.allclose(model.weights, weights, atol=1e-5)
    cosine = (language.normalised(counted, model.weights) @ model.centroids.T).max(axis=1)
    cls = language.length_class(counted.sum(axis=1), params.length_classes)
    bins = np.zeros((params.length_classes, params.cosine_bins))
    for c, x in zip(cls, cosine):
        bins[c, min(int(x * params.cosine_bins), params.cosine_bins - 1)] += 1
    assert np.allclose(model.lowest, language.threshold(bins, params), atol=params.slack / params.cosine_bins + 1e-6)


def test_junk_with_a_label_is_rejected_at_every_size(spark):
    rng = random.Random(19)
    ids = [i for i in range(6000) if remainder(i, 5) != 0]
    for size in (300, 2400):
        rows = [(i, prose(rng, 60, letters), lang) for i in ids[:size] for letters, lang in [("abcdef", "aa"), ("uvwxyz", "zz")][i % 2 : i % 2 + 1]]
        # One row in a hundred is of other letters than its label says.
        junk = [(i, prose(rng, 60, "гджзий"), "aa" if i % 2 else "zz") for i in ids[size : size + size // 100]]
        docs = table(spark, rows + junk)
        kept = {r.doc_id for r in language.accepted(docs, language.fit(docs)).collect()}
        assert kept == {r[0] for r in rows}


def test_thresholds_of_histograms():
    params = language.LanguageParams(length_classes=5, short_classes=1, cosine_bins=10, tail=0.1, slack=0.5, least_class=0.1)
    bins = np.zeros((5, 10))
    bins[1, [0, 6]] = 1, 99  # the tail holds the outlier
    bins[3, 0] = 4  # so few rows are judged together with shorter ones
    assert np.allclose(language.threshold(bins, params), [0.02, 0.3, 0.3, 0.3, 0.3])
    bins[3, [0, 9]] = 50, 50
    assert language.threshold(bins, params).tolist() == [0.02, 0.0, 0.0, 0.0, 0.0]
    bins[:3] = 0
    bins[3, [0, 9]] = 1, 50  # no shorter rows: all take the next longer class
    assert np.allclose(language.threshold(bins, params), [0.02, 0.45, 0.45, 0.45, 0.45])
    assert language.threshold(np.zeros((5, 10)), params).tolist() == [1.0] * 5


def test_more_labels_than_languages(spark):
    rng = random.Random(20)
    ids = [i for i in range(500) if remainder(i, 5) != 0]
    rows = [(i, prose(rng, 30, "abcdef" if k % 2 else "uvwxyz"), "aa" if k % 2 else "zz") for k, i in enumerate(ids[:100])]
    rare = [(i, prose(rng, 30, "abcdef"), f"label {i}") for i in ids[100:110]]
    docs = table(spark, rows + rare)
    params = language.LanguageParams(languages=2)
    model = language.fit(docs, params)
    assert model.languages == ["aa", "zz"]
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model, params).collect()}
    assert all(got[i] == "aa" for i, _, _ in rare) and all(got[i] == lang for i, _, lang in rows)


# Quality


def base_counts(text):
    words = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if times[run] > 1:
            covered.update(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(5)
    made = []
    for _ in range(300):
        parts = [rng.choice(["a", "b", "éß", "c#", "|", "\n", "\r\n", "\x0b", " ", "  ", " ", "中文", "x y z v w ", "\n \n"]) for _ in range(rng.randint(0, 60))]
        made.append(" ".join(parts) if rng.random() < 0.5 else "".join(parts))
    rows = list(enumerate(made)) + [(1000, None), (1000, None), (None, "a " * 50), (1001, "word " * 30_000)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, 1), (None, 1, 0), (7, 0, 0)], "doc_id BIGINT, quality INT, toxic INT")
    got = importance.quality(table(spark, rows, extra=True), labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=str) == sorted(((i, *base_counts(t)) for i, t in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    got = importance.quality(docs, labels).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


def test_quality_scores_and_edges(spark):
    rows = [(i, prose(random.Random(i), 40)) for i in range(20)]
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    got = importance.quality(table(spark, rows), none).collect()
    assert all(r.score == 0.0 and r.kept != r.base_failed for r in got)
    assert importance.quality(table(spark, []), none).count() == 0
    # The ratio of bucket shares, each with one more count.
    params = importance.QualityParams(bucket_bits=4)
    trusted = spark.createDataFrame([(i,) for i in range(5)], "doc_id BIGINT")
    weights = importance.ngram_weights(table(spark, rows), trusted, params)
    import pyarrow as pa

    def counted(some):
        words, first = importance.words_of(importance.Texts.of(pa.array([t for _, t in some])))
        return np.bincount(importance._buckets(words, first, 4)[1], minlength=16)

    raw, good = counted(rows), counted(rows[:5])
    want = np.log((good + 1) / (good.sum() + 16)) - np.log((raw + 1) / (raw.sum() + 16))
    assert np.allclose(weights, want)


# Language model


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_scores(rows):
    words = [(i, WORD.findall(lowered(t)) + [None]) for i, t in rows]
    count = Counter()
    for i, w in words:
        if remainder(i, 7) != 2:
            count.update(w)
    total, distinct = sum(count.values()), len(count)
    return [
        (i, remainder(i, 7) == 2, len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w))
        for i, w in words
    ]


def test_base_scores_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 80), "abCé")) for i in range(120)] + [(500, None), (501, ""), (None, "a b c"), (None, "a b c"), (502, "long " * 30_000)]
    params = lm_score.LmParams(chunk_bytes=3000, train_one_in=2)
    got = [tuple(r)[:6] + (r.score,) for r in lm_score.scores(table(spark, rows, extra=True), params).collect()]
    want = base_scores(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert math.isfinite(g[6]) and g[6] < 0


def test_scores_without_training_rows(spark):
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    got = lm_score.scores(table(spark, [(held, "a b")])).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and math.isclose(got.base_score, 0.0, abs_tol=1e-12)
    assert math.isfinite(got.score)
    assert lm_score.scores(table(spark, [])).count() == 0


def test_training_helps_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plain, trained = (
        lm_score.scores(docs, lm_score.LmParams(train_one_in=4, rates=rates)).where("held_out").groupBy().sum("score").first()[0]
        for rates in ((), (0.01, 0.006, 0.003))
    )
    assert trained > 0.9 * plain and trained > plain


def test_production_training_beats_the_small_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small = lm_score.LmParams(shape=attention.ModelShape(window=16, overlap=4), train_one_in=128, rates=(0.01, 0.004))
    small, production = (lm_score.scores(docs, p).where("held_out").groupBy().sum("score").first()[0] for p in (small, lm_score.LmParams()))
    assert production > small + 1e-6 * abs(small)


def test_query_trains_on_every_learnable_window_once(spark, monkeypatch):
    rng = random.Random(17)
    docs = table(spark, [(i, prose(rng, 300 if i % 3 else 5)) for i in range(40)] + [(90, None), (91, "")])
    asked = []
    monkeypatch.setattr(lm_score, "scores", lambda docs, params=lm_score.LmParams(): asked.append(params))
    lm_score.op8_attention_lm(spark, SF_DIR)
    vocabulary = lm_score.bpe.vocabulary_path(lm_score.bpe.RANKS)
    gathered = lm_score.gather(docs, vocabulary, asked[0])
    learnable = dict(gathered.where("kind = 1").groupBy("key").sum("n").collect())
    scored = Counter(i for r in gathered.where("kind = 2").collect() for i in r.ids[1:] if i >= 0)
    assert scored == learnable
    assert asked[0].once and len(asked[0].rates) == 3


def test_production_windows_and_their_share(spark):
    params = lm_score.LmParams()
    rng = random.Random(13)
    docs = table(spark, [(i, prose(rng, 3000)) for i in range(40)])
    vocabulary = lm_score.bpe.vocabulary_path(lm_score.bpe.RANKS)
    gathered = lm_score.gather(docs, vocabulary, params)
    rows = [r.ids for r in gathered.where("kind = 2").collect()]
    learnable_ids = gathered.where("kind = 1").groupBy().sum("n").first()[0]
    scored = sum(i >= 0 for ids in rows for i in ids[1:])
    assert max(len(ids) for ids in rows) == 33
    assert 1 / 64 < scored / learnable_ids < 1 / 36
    assert len(params.rates) == 3 and params.shape.overlap == 8


def small_model():
    shape = attention.ModelShape(classes=4, per_class=3, width=5, window=8, overlap=3)
    ids = np.arange(30)
    known = attention.Vocabulary(ids, np.arange(1, 31)[::-1].copy(), 40, shape)
    return shape, known, attention.initial(known, shape)


def test_probabilities_sum_to_one():
    shape, known, p = small_model()
    context = np.array([[shape.known + 1, 3, 1, 12, 0, 5, 2, 7]])
    place = np.zeros((1, 8), bool)
    place[0, 6] = True
    total = 0.0
    for id_ in range(40):
        targets = np.full((1, 8), known.rank[id_], np.int64)
        total += math.exp(attention.log_probabilities(p, context, targets, place)[0] + known.rest[id_])
    assert math.isclose(total, 1.0, rel_tol=1e-5)


def test_later_ids_do_not_matter():
    shape, _, p = small_model()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 12, (1, 8))
    b = a.copy()
    b[0, 5:] = (b[0, 5:] + 1) % 12
    places = np.zeros((1, 8), bool)
    places[0, :5] = True
    targets = rng.integers(0, 13, (1, 8))
    assert np.allclose(attention.log_probabilities(p, a, targets, places), attention.log_probabilities(p, b, targets, places))


def test_gradients():
    shape, _, p = small_model()
    p = {name: x.astype(np.float64) for name, x in p.items()}
    rng = np.random.default_rng(2)
    inputs, targets = rng.integers(0, 14, (6, 8)), rng.integers(0, 13, (6, 8))
    scored = rng.random((6, 8)) < 0.7
    _, gradient = attention._gradients(p, inputs, targets, scored)
    for name, x in p.items():
        at = np.unravel_index(np.abs(gradient[name]).argmax(), x.shape)
        losses = []
        for step in (1e-3, -1e-3):
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += step
            losses.append(attention._gradients(moved, inputs, targets, scored)[0])
        assert math.isclose((losses[0] - losses[1]) / 2e-3, gradient[name][at], rel_tol=2e-2, abs_tol=1e-5)


@pytest.mark.parametrize("sizes", [[0], [1], [8], [9, 0, 13], [40, 5, 8, 14]])
def test_windows_score_each_id_once(sizes):
    shape, _, _ = small_model()
    first = np.concatenate([[0], np.cumsum(sizes)])
    ranks = np.arange(first[-1]) % 13
    inputs, targets, scored = attention.windows(ranks, first, shape)
    assert (targets[scored] == ranks).all()
    start = shape.known + 1
    before = np.concatenate([np.concatenate([[start], ranks[a : b - 1]]) for a, b in zip(first, first[1:]) if b > a] or [np.zeros(0)])
    assert (inputs[scored] == before).all()
