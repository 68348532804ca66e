"""Token files, subword ids, pseudonyms and packing: exact round trips and brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import bpe, packing, pseudonyms, token_files
from starloom.llm.text import Texts
from starloom.session import fresh_path
from tests.llm.helpers import prose, table

ODD = ["a", " ", "\n", "\t", "é", "中", "1", "'s", "!", "  ", "\x1c", "\x85", " ", "　", "😀", "B", "<|endoftext|>", "ß", "́"]


def encode(text):
    return bpe.load(bpe.vocabulary_path()).encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(3000)] + [prose(rng, 500)]
    ids, first = bpe.PieceCache(bpe.vocabulary_path()).encode(Texts.of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [encode(t) for t in texts]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_packing_of_bits(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    payload = token_files.pack(ids, bits)
    assert len(payload) == -(-1001 * bits // 8)
    assert (token_files.unpack(payload, bits, 0, 1001) == ids).all()
    assert (token_files.unpack(payload, bits, 333, 77) == ids[333:410]).all()


def test_token_files(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(ODD, k=rng.randint(0, 40)))) for i in rng.sample(range(1000), 200)]
    rows += [(2000, None), (2001, ""), (2002, prose(rng, 30_000)), (None, "x"), (5000, "a a"), (5000, "a a"), (5000, "b")]
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, rows, extra=True), path, block_bytes=500, parts=5)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(encode(t or "") + [0])
    at, stream = 0, []
    for r in got:
        mine = next(x for x in texts[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        texts[r.doc_id].remove(mine)
        assert (r.start, r.n_tokens) == (at, len(mine))
        at += len(mine)
        stream += mine
    parts = sorted(token_files.read_tokens(spark, path, 700, 900).collect(), key=lambda r: r.start)
    assert len(parts) > 1 and [i for r in parts for i in r.ids] == stream[700:1600]


def test_token_files_of_nothing(spark):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, []), path)
    assert token_files.read_documents(spark, path).count() == 0


# Pseudonyms

VALUES = [
    ("card", "4921 9869 3038 2054"), ("card", "4111111111111111"), ("date", "2021-02-28"), ("date", "28/2/2021"), ("date", "03/04/2020"),
    ("date", "3.12.1999"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "GB82WEST12345698765432"), ("phone", "+1 (735) 555-5082"),
    ("phone", "735-555-5082"), ("phone", "+1 (135) 055-5082"), ("phone", "+44 20 7946 0958"), ("social", "078-05-1120"), ("address", "10.0.0.1"),
    ("mail", "jo.12@mail3.example.com"), ("token", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"),
]
NO_VALUES = ["4921 9869 3038 2055", "2021-02-30", "31/4/2021", "DE88 3704 0044 0532 0130 00", "135-555-5082", "000-05-1120", "256.1.1.1", "1.2.3", "Version 2.0.", "12345", "@", "a@b"]


def test_values_keep_their_format(spark):
    f = pseudonyms.Feistel(b"k" * 32)
    for kind, value in VALUES:
        (found,) = pseudonyms.spans_of(f"see {value}, then", f)
        assert found[2] == kind and found[0] == 4 and found[1] == 4 + len(value) and found[3] != value
        (again,) = pseudonyms.spans_of(f"see {found[3]}, then", f, back=True)
        assert again[2] == kind
        if kind != "date":
            assert again[3] == value and [c.isdigit() for c in value] == [c.isdigit() for c in found[3]] or kind in ("token", "address")
    for text in NO_VALUES:
        assert pseudonyms.spans_of(text, f) == []
    # The same number in two shapes stays one number; another key gives another.
    a, b = (pseudonyms.spans_of(x, f)[0][3] for x in ("(735) 555-5082", "735.555.5082"))
    assert "".join(filter(str.isdigit, a)) == "".join(filter(str.isdigit, b))
    assert pseudonyms.spans_of("735.555.5082", pseudonyms.Feistel(b"o" * 32))[0][3] != b


def test_permutations_are_permutations():
    f = pseudonyms.Feistel(b"k" * 32)
    assert sorted(f.within("x", i, 1000) for i in range(1000)) == list(range(1000))
    assert all(f.within("x", f.within("x", i, 777), 777, back=True) == i for i in range(777))
    assert sorted(f.characters("c", f"{i:03d}", ["0123456789"] * 3) for i in range(1000)) == [f"{i:03d}" for i in range(1000)]


def test_documents_go_there_and_back(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = prose(rng, 60).split(" ")
        for _, value in rng.sample(VALUES, 3):
            words.insert(rng.randrange(len(words)), f"({value})")
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (None, "call 735-555-5082"), (102, "call 735-555-5082"), (102, "call 735-555-5082"), (103, "w " * 60_000 + "10.0.0.1")]
    docs = table(spark, rows, extra=True)
    got = pseudonyms.pseudonymised(docs, b"key").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].n_values == 3 and len(by_id[i].spans) == 3 for i in range(40))
    assert by_id[None].text == by_id[102].text != "call 735-555-5082" and by_id[103].n_values == 1
    assert by_id[100].text is None and by_id[101].text == "" and by_id[100].n_values == 0
    assert not any(value in by_id[i].text for i in range(40) for _, value in VALUES)
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in got], "doc_id BIGINT, text STRING"), b"key", back=True).collect()}
    assert back == dict(rows)
    assert pseudonyms.pseudonymised(table(spark, []), b"key").count() == 0


# Packing


def least_padding(lengths, buckets):
    """By trying all ends."""
    from itertools import combinations

    values = sorted(set(lengths))
    best = None
    for k in range(min(buckets, len(values))):
        for cut in combinations(values[:-1], k):
            ends = [*cut, values[-1]]
            cost = sum(min(e for e in ends if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_buckets_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([3, 4, 9, 10, 11, 30, 31, 80, 200]) for _ in range(rng.randint(1, 60))]
    values = sorted(set(lengths))
    counts = np.array([lengths.count(v) for v in values])
    ends = [values[i] for i in packing.best_ends(np.array(values), counts, 4)]
    assert sum(min(e for e in ends if e >= x) - x for x in lengths) == least_padding(lengths, 4)


def test_packed_documents(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 20, 100, 400]))) for i in range(200)] + [(500, None), (501, ""), (None, "a b"), (3, "a"), (3, "a"), (502, prose(rng, 20_000))]
    params = packing.PackingParams(buckets=5, budget=1000)
    got = packing.pack_documents(table(spark, rows, extra=True), params).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, len(encode(t or "")) + 1) for i, t in rows), key=str)
    batches = {}
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len({r.bucket_len for r in members}) == 1
        size = max(1, 1000 // members[0].bucket_len)
        assert len(members) <= size and (len(members) == size or (bucket, batch + 1) not in batches)
    # Every length below 256 is a bin of its own, so here the ends are the best there are.
    small = [r for r in got if r.n_tokens < 256]
    assert len({r.bucket for r in got}) == 5 and small
    assert packing.pack_documents(table(spark, []), params).count() == 0


def test_bins_are_ordered_and_few(spark):
    lengths = sorted({*range(1, 3000), *(int(1.01**i) for i in range(600, 3000))})
    rows = [(n, 0, 0) for n in lengths if n < 1 << 40]
    bins = [r.bin for r in spark.createDataFrame(rows, "n BIGINT, part INT, place INT").select(packing.length_bin(packing.F.col("n"), 256).alias("bin")).collect()]
    assert bins == sorted(bins) and bins[:255] == list(range(1, 256)) and max(bins) < 64 * 256
