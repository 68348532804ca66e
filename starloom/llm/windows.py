"""MinHash over overlapping windows of the shingles of long texts, to find short texts inside them.

The short texts (items) are divided by size: class ``c`` holds those of more than ``2^(c-1)`` and up to ``2^c`` shingles.
For each class a document is covered by windows of ``2^(c+1)`` shingles that start every ``2^c``, so any passage as long
as an item of the class lies whole in a window of like size, and containment in the window becomes a similarity that
MinHash can see.  The windows of all classes are built from the minima over blocks of ``BLOCK`` shingles, so every
shingle is hashed once per function, however many classes there are.  Items of up to ``BLOCK`` shingles form class 0,
whose windows are the single shingles: a window agrees with an item if it is the item's minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from starloom.llm.text import expand, mix, shingles

_U = np.uint64
BLOCK = 8
SMALLEST = 3  # log2(BLOCK)
# With 12 functions an item of class 0 that has 80 % of its shingles in a document is missed once in 10^8 times.
FUNCTIONS_OF_SINGLES = 12
FILTER_BITS = 18


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes <= BLOCK, 0, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    factors = mix(np.arange(1, count + 1, dtype=_U)).astype(np.uint32) | np.uint32(1)
    return factors, mix(np.arange(101, count + 101, dtype=_U)).astype(np.uint32)


def _scrambled(prints: np.ndarray, factor: np.uint32, shift: np.uint32) -> np.ndarray:
    x = (prints >> _U(32)).astype(np.uint32) * factor
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x += shift
    x ^= x >> np.uint32(13)
    return x


@dataclass
class Blocks:
    """The minima over blocks of a batch's documents, one array per hash function."""

    first: np.ndarray  # first block of each document, and a last
    minima: list[np.ndarray]
    prints: np.ndarray
    first_print: np.ndarray

    @staticmethod
    def of(prints: np.ndarray, first: np.ndarray, functions: int) -> Blocks:
        counts = np.diff(first)
        blocks = -(-counts // BLOCK)
        start = np.concatenate([[0], np.cumsum(blocks)])
        # Documents are filled up with their last shingle, which changes no minimum.
        at = np.minimum(
            np.repeat(first[:-1] - start[:-1] * BLOCK, blocks * BLOCK) + np.arange(start[-1] * BLOCK),
            np.repeat(first[1:] - 1, blocks * BLOCK),
        )
        padded = prints[at].reshape(-1, BLOCK)
        columns = [np.ascontiguousarray(padded[:, j]) for j in range(BLOCK)]
        minima = []
        for factor, shift in zip(*hash_functions(functions)):
            low = _scrambled(columns[0], factor, shift)
            for column in columns[1:]:
                np.minimum(low, _scrambled(column, factor, shift), out=low)
            minima.append(low)
        return Blocks(start, minima, prints, first)

    def windows(self, cls: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first block and end block of the windows of a class; of single shingles in class 0."""
        if not cls:
            at = np.arange(len(self.prints))
            return np.repeat(np.arange(len(self.first_print) - 1), np.diff(self.first_print)), at, at + 1
        stride = 1 << (cls - SMALLEST)
        blocks = np.diff(self.first)
        count = np.where(blocks > 0, np.maximum(1, -(-blocks // stride) - 1), 0)
        doc = np.repeat(np.arange(len(blocks)), count)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin = self.first[doc] + number * stride
        end = np.minimum(begin + 2 * stride, self.first[doc + 1])
        # The last window takes what is left.
        last = np.cumsum(count)[count > 0] - 1
        end[last] = self.first[1:][count > 0]
        return doc, begin, end

    def window_minima(self, cls: int, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        """For each function, the minimum over each window."""
        if not cls:
            for factor, shift in zip(*hash_functions(len(self.minima))):
                yield _scrambled(self.prints, factor, shift)
            return
        stride = 1 << (cls - SMALLEST)
        for low in self.minima:
            if not len(begin):
                yield low[:0]
                continue
            # Minima over the ``2 * stride`` blocks from each block on, by doubling; two of them cover a window.
            span, width = low, 1
            while width < stride * 2 and width < len(low):
                longer = span.copy()
                np.minimum(longer[:-width], span[width:], out=longer[:-width])
                span, width = longer, width * 2
            length = end - begin
            full = length >= width
            out = np.empty(len(begin), np.uint32)
            out[full] = np.minimum(span[begin[full]], span[end[full] - width])
            rest = np.flatnonzero(~full)
            if len(rest):  # shorter than a whole window: the end of a document, or a short one
                cuts = np.column_stack([begin[rest], end[rest]]).ravel()
                padded = np.append(low, np.uint32(0xFFFFFFFF))
                out[rest] = np.minimum.reduceat(padded, cuts)[::2]
            yield out


@dataclass
class ItemIndex:
    """Items by class with their minima, ready to be looked up by window minima; and their shingles to verify with.

    ``bands`` bands of ``rows`` functions: a window is a candidate for an item if they agree in all functions of a band.
    """

    prints: np.ndarray
    first: np.ndarray
    bands: int
    rows: int = 1
    tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)

    @staticmethod
    def of(prints: np.ndarray, first: np.ndarray, bands: int, rows: int = 1) -> ItemIndex:
        """``prints`` must be the distinct shingles of each item."""
        index = ItemIndex(prints, first, bands, rows)
        sizes = np.diff(first)
        used = np.flatnonzero(sizes > 0)
        classes = size_class(sizes[used])
        factors, shifts = hash_functions(bands * rows)
        for cls in np.unique(classes):
            items = used[classes == cls]
            tables = []
            for band in range(min(bands, FUNCTIONS_OF_SINGLES) if not cls else bands):
                minima = []
                for j in range(band * rows, (band + 1) * rows):
                    scrambled = _scrambled(prints, factors[j], shifts[j])
                    minima.append(np.array([scrambled[first[i] : first[i + 1]].min() for i in items], np.uint32))
                keys = _band_key(minima)
                order = np.argsort(keys, kind="stable")
                hit = np.zeros(1 << FILTER_BITS, bool)
                hit[keys & _U((1 << FILTER_BITS) - 1)] = True
                tables.append((keys[order], items[order], hit))
            index.tables[int(cls)] = tables
        return index

    def candidates(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of document and item that agree in a band of some window."""
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cls, tables in self.tables.items():
            doc, begin, end = blocks.windows(cls)
            if not len(doc):
                continue
            minima = blocks.window_minima(cls, begin, end)
            for keys, of, hit in tables:
                probe = _band_key([next(minima) for _ in range(self.rows)])
                maybe = np.flatnonzero(hit[probe & _U((1 << FILTER_BITS) - 1)])
                low = np.searchsorted(keys, probe[maybe], "left")
                count = np.searchsorted(keys, probe[maybe], "right") - low
                docs.append(np.repeat(doc[maybe], count))
                items.append(of[np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))])
        doc, item = np.concatenate(docs), np.concatenate(items)
        pairs = np.unique(doc * (len(self.first) - 1) + item)
        return pairs // (len(self.first) - 1), pairs % (len(self.first) - 1)

    def contained(self, doc: np.ndarray, item: np.ndarray, prints: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many shingles of the item each candidate document has: exact, over the whole document."""
        shared = np.zeros(len(doc), np.int64)
        for d in np.unique(doc):
            mine = np.unique(prints[first[d] : first[d + 1]])
            for k in np.flatnonzero(doc == d):
                theirs = self.prints[self.first[item[k]] : self.first[item[k] + 1]]
                shared[k] = np.isin(theirs, mine, assume_unique=True).sum()
        return shared


@dataclass
class ShortItems:
    """Items of fewer words than a shingle, found wherever all their words stand in a row."""

    width: int
    keys: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted fingerprints of all the words, and their items

    @staticmethod
    def of(words: np.ndarray, first: np.ndarray, width: int) -> ShortItems:
        """``words`` are word fingerprints of all items, ``first`` the first word of each (and a last)."""
        keys, n_words = {}, np.diff(first)
        for n in range(1, width):
            those = np.flatnonzero(n_words == n)
            if len(those):
                run = shingles(words[expand(first[those], n_words[those])], np.arange(len(those) + 1) * n, n)[0]
                order = np.argsort(run, kind="stable")
                keys[n] = (run[order], those[order])
        return ShortItems(width, keys)

    def inside(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of text and item found in it."""
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (keys, those) in self.keys.items():
            runs, at = shingles(words, first, n)
            hit = np.flatnonzero(np.isin(runs, keys))
            low = np.searchsorted(keys, runs[hit], "left")
            count = np.searchsorted(keys, runs[hit], "right") - low
            docs.append(np.repeat(np.searchsorted(at, hit, "right") - 1, count))
            items.append(those[expand(low, count)])
        return tuple(np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1))


def without_short(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the items of ``width`` words and more; the others have none."""
    prints, at = distinct_shingles(*shingles(words, first, width))
    long = np.diff(first) >= width
    sizes = np.diff(at)
    return prints[np.repeat(long, sizes)], np.concatenate([[0], np.cumsum(np.where(long, sizes, 0))])


def _band_key(minima: list[np.ndarray]) -> np.ndarray:
    key = minima[0].astype(_U)
    for low in minima[1:]:
        key = mix(key) + low.astype(_U)
    return mix(key)


def distinct_shingles(prints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles without repeats."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((prints, doc))
    doc, prints = doc[order], prints[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])
    return prints[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(first) - 1))])
