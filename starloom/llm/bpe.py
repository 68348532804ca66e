"""Subword ids of whole texts: a tokenizer library, asked once for each distinct piece of text.

The same vocabulary comes as a file for the tokenizers library and as one for tiktoken; the ids are equal.

A byte-level vocabulary never joins characters across the border between a visible character and white space, so a
text is cut there and the ids of its pieces are put together again.  Pieces repeat a lot; a task keeps those it has seen.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from starloom.llm.text import WHITE, Texts, expand

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
KEPT_PIECES = 1_000_000
KEPT_WORDS = 500_000
ENCODED_AT_ONCE = 4096


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def load_ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str) -> Callable[[list[str]], Iterator[list[int]]]:
    """The ids of each string, by the library that the file is for."""
    if path.endswith(".tiktoken"):
        ranks = load_ranks(path)
        return lambda strings: map(ranks.encode_ordinary, strings)
    tokenizer = load(path)
    return lambda strings: (e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False))


def vocabulary_size(path: str) -> int:
    """The number of ids; a file of ranks has one free id behind them, for ends of texts."""
    return load_ranks(path).n_vocab + 1 if path.endswith(".tiktoken") else load(path).get_vocab_size()


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and the first piece of each text (and a last).

    A piece is white space and the visible characters behind it.  It starts at ASCII white space behind a visible
    ASCII character or a two-byte letter; other white space exists among longer characters, so no cut is made there.
    """
    data, n = texts.data, len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    safe = (data > 0x20) & (data < 0x7F)
    safe[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    cut = WHITE[data]
    cut[1:] &= safe[:-1]
    cut[0] = True
    begins = texts.offsets[:-1]
    cut[begins[np.diff(texts.offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, texts.offsets)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and which of them each key is."""
    distinct, back = np.unique(keys, return_inverse=True)
    where = np.zeros(len(distinct), np.int64)
    where[back] = np.arange(len(keys))
    return distinct, where, back


class PieceCache:
    """Ids of pieces by their fingerprint."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.encoder, self.kept = encoder(path), kept
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.lengths, self.places, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def lookup(self, keys: np.ndarray, texts: Texts, starts: np.ndarray, ends: np.ndarray, prefix: str = "") -> np.ndarray:
        """The entry of each span; unknown ones are encoded, with ``prefix`` before them."""
        distinct, where, back = distinct_keys(keys)
        return self.entries_of(distinct, where, texts, starts, ends, prefix)[back]

    def entries_of(
        self, distinct: np.ndarray, where: np.ndarray, texts: Texts, starts: np.ndarray, ends: np.ndarray, prefix: str = ""
    ) -> np.ndarray:
        """The same for ascending distinct keys; ``where`` is a span of each."""
        if len(self.keys) > self.kept:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        entries = np.zeros(len(distinct), np.int64)
        entries[known] = self.entry[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, lengths = self._encode([(starts[i], ends[i]) for i in where[new]], texts, prefix)
            entries[new] = len(self.lengths) + np.arange(len(new))
            self.places = np.append(self.places, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, ids)
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.entry = np.insert(self.entry, at[new], entries[new])
        return entries

    def _encode(self, spans: list[tuple[int, int]], texts: Texts, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans in a row, and how many each has; some thousands at a time, as encodings are large."""
        ids, lengths = [], []
        for at in range(0, len(spans), ENCODED_AT_ONCE):
            strings = [prefix + texts.data[a:b].tobytes().decode() for a, b in spans[at : at + ENCODED_AT_ONCE]]
            for mine in self.encoder(strings):
                ids.extend(mine)
                lengths.append(len(mine))
        return np.array(ids, np.uint32), np.array(lengths, np.int64)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the first of each text (and a last)."""
        starts, ends, first = pieces(texts)
        entries = self.lookup(texts.fingerprints(starts, ends), texts, starts, ends)
        lengths = self.lengths[entries]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[expand(self.places[entries], lengths)], upto[first]

    def count(self, texts: Texts) -> np.ndarray:
        """The number of ids of each text."""
        starts, ends, first = pieces(texts)
        entries = self.lookup(texts.fingerprints(starts, ends), texts, starts, ends)
        return np.diff(np.concatenate([[0], np.cumsum(self.lengths[entries])])[first])


@lru_cache(maxsize=4)
def cache(path: str, use: str = "pieces") -> PieceCache:
    """One for all tasks of a worker; ``words`` are kept beside larger tables, so fewer of them."""
    return PieceCache(path, KEPT_WORDS if use == "words" else KEPT_PIECES)
