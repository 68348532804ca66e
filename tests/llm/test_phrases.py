"""Phrases: counting every run of words gives the same candidates, scores and ranks."""

from __future__ import annotations

import random
import re
from collections import Counter

from starloom.llm.phrases import PhraseParams, collocations, frequent_phrases, op13_partitioned_phrases
from tests.llm.helpers import table


def plain_counts(rows, most_words):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def plain(rows, params):
    f, n = plain_counts(rows, params.most_words)
    candidates = []
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= params.support:
            score, _, l, r = min((params.factor * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            candidates.append((lang, words, a, l, r, n[lang], score))

    def inside(x, y):
        return len(y) > len(x) and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))

    kept = [c for c in candidates if not any(o[0] == c[0] and inside(c[1], o[1]) and 100 * o[2] >= params.contained_percent * c[2] for o in candidates)]
    out = []
    for lang in {c[0] for c in kept}:
        mine = sorted((c for c in kept if c[0] == lang), key=lambda c: (-c[6], -c[2], " ".join(c[1]).encode()))
        out += [(lang, i, " ".join(c[1]), *c[2:]) for i, c in enumerate(mine[: params.top], 1)]
    return sorted(out)


def corpus(seed, documents=120):
    rng = random.Random(seed)
    names = ["ab", "Cd", "ef", "gh", "É", "zu", "x-y", "中", "é", "a\x1cb"]
    fixed = ["new york city", "once upon a time there was", "zu zu zu zu", "ab, cd"]
    rows = []
    for i in range(documents):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(names) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!"]) for p in parts), rng.choice(["aa", "aa", "bb", None])))
    return rows + rows[:10]


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def test_against_counting_everything(spark):
    for seed, params in enumerate([PhraseParams(support=12, shards=3, shard_ids=2, block_words=500, filter_bits=12, top=40), PhraseParams(support=7, block_words=10**6, contained_percent=80, most_words=4)]):
        rows = corpus(seed)
        found = got(collocations(table(spark, rows).repartition(5), params))
        assert len(found) > 20 and found == plain(rows, params)


def test_a_full_filter_changes_nothing(spark):
    """Six bits of filter let nearly every phrase through; counts stay exact."""
    rows = corpus(5)
    assert got(collocations(table(spark, rows), PhraseParams(support=12, filter_bits=6))) == plain(rows, PhraseParams(support=12))


def test_all_frequent_phrases_are_found(spark):
    rows, params = corpus(7), PhraseParams(support=9, shard_ids=1, block_words=200)
    phrases, totals = frequent_phrases(table(spark, rows).repartition(3), params)
    f, n = plain_counts(rows, 5)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in phrases.collect()} == {k: v for k, v in f.items() if v >= 9}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_edge_cases(spark):
    long = "one two three four five six. " * 20_000
    rows = [(1, None, None), (2, "", "aa"), (None, long, "bb"), (3, " .,! \n", "cc"), (4, "lone", None), (5, "a b " * 150, "bb"), (5, "a b " * 150, "bb")]
    params = PhraseParams()
    assert got(collocations(table(spark, rows, extra=True), params)) == plain(rows, params)
    assert got(collocations(table(spark, []), params)) == []


def test_large_numbers(spark):
    """1000 * a * n passes 64 bits long before the counts do."""
    from starloom.llm.phrases import scored

    big = 5 * 10**13
    phrases = spark.createDataFrame([("aa", "x y", 2, big), ("aa", "x", 1, big + 3), ("aa", "y", 1, big + 7)], "lang STRING, phrase STRING, words INT, f BIGINT")
    totals = spark.createDataFrame([("aa", 7 * 10**16)], "lang STRING, n BIGINT")
    row = scored(phrases, totals).first()
    assert row.score == 1000 * big * 7 * 10**16 // ((big + 3) * (big + 7))


def test_query(spark):
    from tests.conftest import SF_DIR

    source = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert got(op13_partitioned_phrases(spark, SF_DIR)) == plain(source, PhraseParams())
