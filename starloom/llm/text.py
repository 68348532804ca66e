"""Texts of an Arrow batch as numpy arrays: words, lines and shingles as 64-bit fingerprints, without Python loops."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 8192
_U = np.uint64
_BASE, _ODD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters and digits; bytes of other characters belong to words.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=_U))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd base and of its inverse, modulo 2^64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE), np.full(n, _U(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


@dataclass
class Texts:
    """UTF-8 bytes of several texts in a row; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    _prefix: np.ndarray | None = None

    @staticmethod
    def of(column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        return Texts(data, offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without separator bytes, and the first run of each text (and a last)."""
        inside = ~separator[self.data]
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def prefix(self) -> np.ndarray:
        """Prefix sums for :meth:`fingerprints`, computed once."""
        if self._prefix is None:
            n = len(self.data)
            up, _ = powers(room(n + 1))
            self._prefix = np.zeros(n + 1, _U)
            np.cumsum(BYTE_VALUE[self.data] * up[:n], out=self._prefix[1:])
        return self._prefix

    def fingerprints(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint of each span; equal bytes give equal ones."""
        prefix = self.prefix()
        _, down = powers(room(len(self.data) + 1))
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U) * _ODD)


def room(n: int) -> int:
    """A size of the table of powers that fits ``n`` and few other sizes, so that it is kept between texts."""
    return max(SLICE_BYTES + 4096, 1 << int(n - 1).bit_length() if n > SLICE_BYTES + 4096 else 0)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``width`` words, and the first run of each text (and a last).

    A text of fewer words, but at least one, has a single run of all its words; a text without words has none.
    """
    factors = mix(np.arange(1, width + 1, dtype=_U)) | _U(1)
    counts = np.diff(first)
    n = len(words)
    out = np.zeros(n, _U)
    for j in range(min(width, n)):
        out[: n - j] += words[j:] * factors[j]
    keep = np.ones(n, bool)
    for j in range(1, width):  # the last starts of a text have no full run
        at = first[1:][counts >= j] - j
        keep[at] = False
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        keep[first[short]] = True
        for k in range(1, width):
            at = first[short[counts[short] == k]]
            out[at] = sum((words[at + j] * factors[j] for j in range(k)), np.full(len(at), _U(k)))
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    return mix(out[keep]), np.concatenate([[0], np.cumsum(runs)])


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words, which are runs of letters, digits and characters beyond ASCII."""
    texts = Texts.of(lower(column))
    starts, ends, first = texts.spans(NOT_ALNUM)
    return texts.fingerprints(starts, ends), first


def normal_shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the normal words."""
    return shingles(*normal_words(column), width)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text, one row at least and ``SLICE_ROWS`` at most, which bounds
    the memory of a task.  At the end, Arrow gives back what it holds for later: a worker that waits shall not keep it."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(sizes):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
            upto = min(upto, at + SLICE_ROWS)
            yield batch.slice(at, upto - at)
            at = upto
        del batch
    pa.default_memory_pool().release_unused()


def over_slices(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES):
    """A ``mapInArrow`` function out of one for a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, limit):
            yield function(piece)

    return run


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
