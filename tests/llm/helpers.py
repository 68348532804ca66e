"""Brute-force versions and small corpora for the document operators."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL_WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
# Names that operators use for columns of their own.
CLASHES = ["key", "band", "bands", "node", "u", "v", "part", "place", "bucket", "score", "chunk", "trusted", "row_key", "id", "kind"]


def prose(rng: random.Random, words: int, letters: str = "abcdefghij") -> str:
    out = []
    for i in range(words):
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))))
        if i % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def table(spark, rows, extra: bool = False):
    """``documents`` of ``(doc_id, text)`` or ``(doc_id, text, lang)``."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "aa", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    if not extra:
        return spark.createDataFrame(full, SCHEMA)
    names = ", ".join(f"`{c}` STRING" for c in CLASHES)
    return spark.createDataFrame([r + ("x",) * len(CLASHES) for r in full], f"{SCHEMA}, {names}")


def shingle_counts(text: str, width: int = 5) -> Counter:
    words = NORMAL_WORD.findall(text.lower())
    if len(words) < width:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    union = sum((a | b).values())
    return shared / union if union else 0.0


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Sets:
    """Disjoint sets, named by their smallest member."""

    def __init__(self, members):
        self.parent = {m: m for m in members}

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
