"""Repeated and nearly repeated lines of a corpus, by a segment-partition edit join.

Two lines within ``edits`` edits of each other share a segment: cut one into ``edits + 1`` segments, and one of them
occurs unchanged in the other, near its own place.  Lines are indexed by their segments under their length and probed
with the few substrings of their own that can match.  A bit set of the line's bigrams, which every edit changes by four
bits at most, thins out the pairs inside the join; what remains is verified by its edit distance, diagonal by diagonal.

With a threshold that grows with the length (``WHOLE``), the segments of long lines are too many to probe every place of
every length for.  A long segment is therefore indexed by its least gram, and a line is probed with the least grams of all
its substrings of that size, which are few, as neighbours share theirs.  Lines of like length meet in parts, where the
index is sorted by slot and length: a segment's partners are one range of it.  Hashed counts of characters thin them out.
Each part gets packed blocks, so that a line costs some bytes per gram and no row per gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.phrases import bit_filter, is_set
from starloom.llm.text import expand, mix, over_slices, powers, room, slices
from starloom.session import stage

_U = np.uint64
LAST = (1 << 63) - 1
_ONE_BIT = _U(1) << np.arange(64, dtype=_U)


@dataclass(frozen=True)
class LineParams:
    """Lines of fewer than ``min_chars`` characters (code points) are never compared or removed.

    ``classes``: from which length on how many edits count, instead of ``edits`` for all; from ``LONG`` characters on
    ``edits_of_long``.  Lines shorter than the first class are compared for equality only, and blank ones not at all.
    The threshold of a pair is that of its shorter line.
    """

    edits: int = 2
    min_chars: int = 40
    classes: tuple[tuple[int, int], ...] | None = None


    def steps(self) -> tuple[tuple[int, int], ...]:
        return self.classes or ((self.min_chars, self.edits),)

    def long(self) -> int:
        """From which length on the threshold grows."""
        return LONG if self.classes else 1 << 40


WHOLE = LineParams(min_chars=1, classes=((10, 1), (20, 2)))
LONG = 96
GRAM = 12
BATCH_PAIRS, BATCH_CHARS = 1 << 17, 1 << 21
SLICE = 512 << 10  # bytes of text at a time: a task's arrays take some hundred times as much
FILTER_BITS = 24  # of the tables that tell which documents, lines and texts are needed
PART_CHARS = 48_000_000  # characters of a bucket's lines per part
MOST_EDITS = 31  # of any threshold


def edits_of_long(length: np.ndarray) -> np.ndarray:
    return np.minimum(length // 32, MOST_EDITS)


_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


class Lines:
    """The lines of several texts as code points, with prefix sums that give substring fingerprints."""

    def __init__(self, column: pa.Array, min_chars: int, split: bool = True, visible: bool = False):
        texts = column.to_pylist()
        # A line feed ends each text; it belongs to no line.
        joined = "\n".join(t or "" for t in texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if split:
            ends = np.flatnonzero(self.points == 10)
        else:
            ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        per_text = np.array([t.count("\n") + 1 if t else 1 for t in texts]) if split else np.ones(len(texts), np.int64)
        self.row = np.repeat(np.arange(len(texts)), per_text)
        first = np.cumsum(per_text) - per_text
        self.number = np.arange(len(starts)) - first[self.row]
        long = ends - starts >= min_chars
        if visible:
            shown = np.concatenate([[0], np.cumsum(~_BLANK[np.minimum(self.points, 0x3001)])])
            long &= shown[ends] > shown[starts]
        self.total = per_text
        self.row, self.number, self.starts, self.ends = self.row[long], self.number[long], starts[long], ends[long]
        n = len(self.points)
        up, self.down = powers(room(n + 1))
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum((self.points + np.uint32(1)) * up[:n], out=self.prefix[1:])

    def fingerprint(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(_U))

    def keys(self) -> np.ndarray:
        return self.fingerprint(self.starts, self.ends).view(np.int64)

    def totals(self) -> np.ndarray:
        """The sum of the code points of each line: tells lines apart that share a fingerprint by chance."""
        upto = np.zeros(len(self.points) + 1, np.int64)
        np.cumsum(self.points, out=upto[1:])
        return upto[self.ends] - upto[self.starts]

    def bigrams(self) -> np.ndarray:
        """A bit per hashed bigram, set if it occurs an odd number of times."""
        pair = self.points[:-1] * np.uint32(0x9E3779B1) + self.points[1:] * np.uint32(0x85EBCA77)
        pair ^= pair >> np.uint32(15)
        pair *= np.uint32(0xC2B2AE3D)
        bits = np.zeros(len(self.points) + 1, _U)
        np.bitwise_xor.accumulate(_ONE_BIT[pair >> np.uint32(26)], out=bits[1:-1])
        return (bits[np.maximum(self.ends - 1, self.starts)] ^ bits[self.starts]).view(np.int64)

    def some(self, rows: np.ndarray) -> Lines:
        """These lines only, of the same texts."""
        out = copy(self)
        out.row, out.number, out.starts, out.ends = self.row[rows], self.number[rows], self.starts[rows], self.ends[rows]
        return out

    def character_counts(self) -> np.ndarray:
        """Eight counts of hashed characters, modulo 256, in the bytes of a word: an edit changes two of them by one."""
        slot = ((self.points * np.uint32(0x9E3779B1)) >> np.uint32(29)).astype(np.int64)
        out = np.zeros(len(self.starts), _U)
        upto = np.zeros(len(slot) + 1, _U)
        for half in (0, 4):  # four sums at a time, of 16 bits each
            step = np.zeros(8, _U)
            step[half : half + 4] = _U(1) << np.arange(0, 64, 16, dtype=_U)
            np.cumsum(step[slot], out=upto[1:])
            sums = upto[self.ends] - upto[self.starts]
            for i in range(4):
                out |= ((sums >> _U(16 * i)) & _U(255)) << _U(8 * (half + i))
        for i in np.flatnonzero(self.ends - self.starts > 65535).tolist():  # their sums may pass 16 bits
            counts = np.bincount(slot[self.starts[i] : self.ends[i]], minlength=8) & 255
            out[i] = np.bitwise_or.reduce(counts.astype(_U) << np.arange(0, 64, 8, dtype=_U))
        return out.view(np.int64)

    def least_grams(self, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each size, ascending, the least gram of that many characters from each place on: its hash, and its place in
        the low 27 bits.  Places at the end have no such number of characters, and no entry."""
        n = len(self.points) - GRAM + 1
        if n <= 0:
            yield from ((size, np.zeros(0, _U)) for size in sorted(sizes))
            return
        least = self.prefix[GRAM:] - self.prefix[:n]
        least *= self.down[:n]
        least += _U(GRAM)
        least = (mix(least) & ~_PLACE) | (np.arange(n, dtype=_U) & _PLACE)
        wide = 1
        for size in sorted(sizes):
            while wide < size - GRAM + 1:  # a window of twice the width, or of what is left
                step = min(wide, size - GRAM + 1 - wide)
                least = np.minimum(least[:-step], least[step:])
                wide += step
            yield size, least


_PLACE = _U((1 << 27) - 1)
_LARGEST = 65535  # lengths and places in blocks
_LOWS = np.unique(np.floor(LONG * 2.0 ** (np.arange(4 * 8) / 4)).astype(np.int64))  # least length of each bucket


def _bucket(length: np.ndarray) -> np.ndarray:
    """0 for lines shorter than ``LONG``."""
    return np.searchsorted(_LOWS, length, "right")


@cache
def _least_segment(bucket: int) -> int:
    """The size of the least segment of the bucket's lines; from 32 edits on no segment is shorter than 32."""
    low = int(_LOWS[bucket - 1])
    length = np.arange(low, max(low + 1, min(int(_LOWS[bucket]) if bucket < len(_LOWS) else low + 1, 1025)))
    return int((length // (edits_of_long(length) + 1)).min())


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Place and length of each segment: as even as can be, the longer ones last."""
    base, longer = length // (edits + 1), length % (edits + 1)
    out, place = [], np.zeros_like(length)
    for i in range(edits + 1):
        size = base + (i > edits - longer)
        out.append((place, size))
        place = place + size
    return out


def _slot(print_: np.ndarray, length: np.ndarray, number: int) -> np.ndarray:
    return mix(print_ ^ mix(length.astype(_U) * _U(16) + _U(number))).view(np.int64)


def index_keys(lines: Lines, edits: int) -> np.ndarray:
    """Keys of each line's own segments."""
    length = lines.ends - lines.starts
    out = []
    for i, (place, size) in enumerate(segments(length, edits)):
        out.append(_slot(lines.fingerprint(lines.starts + place, lines.starts + place + size), length, i))
    return np.column_stack(out)


def probe_keys(lines: Lines, edits: int) -> np.ndarray:
    """Keys of the substrings that can match a segment of a line of equal or smaller length.

    With ``gap`` characters more than that line, segment ``i`` (from 0) can only match where at most ``i`` edits are
    left of it and at most ``edits - i`` right of it.
    """
    length = lines.ends - lines.starts
    out = []
    for gap in range(edits + 1):
        other = np.maximum(length - gap, 1)
        for i, (place, size) in enumerate(segments(other, edits)):
            low = max(-i, gap - (edits - i))
            high = min(i, gap + (edits - i))
            for shift in range(low, high + 1):
                begin = np.clip(place + shift, 0, length - size)
                print_ = lines.fingerprint(lines.starts + begin, lines.starts + begin + size)
                out.append(_slot(print_, other, i))
    return np.column_stack(out)


def _packed(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """For each character of all strings the next ones packed in a word, where each string starts, and how many a word holds."""
    texts = strings.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[points] = True
    # Characters are numbered, so that a word holds as many as there are kinds for.
    kind = next(x for x in (np.uint8, np.uint16, np.uint32) if int(used.sum()) <= np.iinfo(x).max)
    size = np.dtype(kind).itemsize
    number = np.zeros(len(points) + 8, kind)
    number[: len(points)] = np.cumsum(used, dtype=np.uint32).astype(kind)[points]
    words = np.ascontiguousarray(np.ndarray(len(points) + 1, "<u8", number, strides=(size,)))
    return words, np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64), 8 // size


def _distances(words: np.ndarray, per_word: int, a: np.ndarray, m: np.ndarray, b: np.ndarray, t: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The edit distance of the strings of ``m`` and ``t`` characters at ``a`` and ``b``, or ``most + 1`` if it is larger.

    All rows advance together by one edit at a time.  A row keeps, for each diagonal of the matrix, the furthest place that
    so many edits reach; from there it slides on over equal characters, a word at a time.  Diagonals from which the
    edits left don't lead back to the last one are given up, and rows that are decided are dropped.
    """
    out, bits, never = most + 1, 64 // per_word, np.int32(-(1 << 30))
    rows = np.flatnonzero(np.abs(t - m) <= most)
    a, m, b, t, k = a[rows], m[rows], b[rows], t[rows], most[rows]
    width = int(k.max(initial=0))
    reach = np.full((len(rows), 2 * width + 3), never, np.int32)
    for e in range(width + 1):
        low, high = width + 1 - e, width + 2 + e
        diagonal = np.arange(-e, e + 1, dtype=np.int32)
        if e:
            now = np.maximum(reach[:, low:high], reach[:, low + 1 : high + 1])
            now += 1
            np.maximum(now, reach[:, low - 1 : high - 1], out=now)
        else:
            now = np.zeros((len(rows), 1), np.int32)
        np.minimum(now, m[:, None], out=now, casting="unsafe")
        np.minimum(now, (t[:, None] - diagonal), out=now, casting="unsafe")
        row, at = np.nonzero((now >= np.maximum(-diagonal, 0)) & (np.abs(diagonal - (t - m)[:, None]) <= (k - e)[:, None]))
        place = now[row, at].astype(np.int64)
        left = np.minimum(m[row], t[row] - diagonal[at]) - place
        x, y = a[row] + place, b[row] + place + diagonal[at]
        some = np.flatnonzero(left > 0)
        while len(some):
            apart = words[x[some]] ^ words[y[some]]
            # The lowest bit that differs; all bits below it are equal.
            step = np.minimum(np.bitwise_count((apart & (~apart + _U(1))) - _U(1)) // bits, left[some])
            x[some] += step
            y[some] += step
            left[some] -= step
            some = some[(step == per_word) & (left[some] > 0)]
        now.fill(never)
        now[row, at] = x - a[row]
        reach[:, low:high] = now
        shift = t - m
        done = np.abs(shift) <= e
        done[done] = now[done, shift[done] + e] == m[done]
        out[rows[done]] = e
        on = ~done & (k > e)
        if not on.any():
            break
        if not on.all():
            rows, a, m, b, t, k, reach = (z[on] for z in (rows, a, m, b, t, k, reach))
    return out


def within_edits(left: pa.Array, right: pa.Array, edits: int) -> np.ndarray:
    """The edit distance of the strings in each row, or ``edits + 1`` if it is larger."""
    n = len(left)
    at = np.arange(n)
    return within_own_edits(pa.concat_arrays([left, right]), at, at + n, np.full(n, edits, np.int64))


def within_own_edits(strings: pa.Array, u: np.ndarray, v: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The edit distance of strings ``u[i]`` and ``v[i]``, or ``most[i] + 1`` if it is larger than ``most[i]``."""
    words, starts, per_word = _packed(strings)
    out, length = np.zeros(len(most), np.int64), np.diff(starts)
    rows = np.argsort(most, kind="stable")
    at = 0
    while at < len(rows):  # as many as a bounded matrix holds; the thresholds ascend
        fits = np.arange(1, min(len(rows) - at, 1 << 16) + 1) * (2 * most[rows[at : at + (1 << 16)]] + 3) <= 1 << 19
        some = rows[at : at + max(1, int(np.count_nonzero(fits)))]
        out[some] = _distances(words, per_word, starts[u[some]], length[u[some]], starts[v[some]], length[v[some]], most[some])
        at += len(some)
    return out


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"),
        _row_key(docs).alias("row_key"),
    )


def _occurrences(docs: DataFrame, params: LineParams) -> DataFrame:
    """A written table with one narrow row for each distinct long line of each document."""

    def lines_of(piece: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(piece.column("text"), params.min_chars, visible=params.classes is not None)
        keys, length = lines.keys(), lines.ends - lines.starts
        order = np.lexsort((keys, lines.row))  # numbers ascend already
        row, key = lines.row[order], keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(order)))
        pick = order[at]
        of = pa.array(lines.row[pick])
        return pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id").take(of), "row_key": piece.column("row_key").take(of),
            "line_no": pa.array(lines.number[pick].astype(np.int32)), "times": pa.array(times), "key": pa.array(keys[pick]),
            "total": pa.array(lines.totals()[pick]), "length": pa.array(length[pick].astype(np.int32)),
        })

    schema = "doc_id BIGINT, row_key BIGINT, line_no INT, times BIGINT, key BIGINT, total BIGINT, length INT"
    return stage(_rows(docs).mapInArrow(over_slices(lines_of, limit=SLICE), schema), "lines")


def _short_entries(lines: Lines, params: LineParams) -> Iterator[tuple[np.ndarray, ...]]:
    """Line, slot, first and last place and whether it is a segment: of lines that have a partner of a class, whose slots tell the place."""
    length = lines.ends - lines.starts
    bounds = [low for low, _ in params.steps()] + [params.long()]
    for (low, edits), high in zip(params.steps(), bounds[1:]):
        for own in (True, False):
            rows = np.flatnonzero((length >= low) & (length < high + (0 if own else edits)))
            if len(rows):
                table = (index_keys if own else probe_keys)(lines.some(rows), edits)
                # Slots are of a class, or its lines would meet at another threshold.
                slot = mix(table.view(_U) + _U(edits)).ravel()
                of = np.repeat(rows, table.shape[1])
                yield of, slot, np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.full(len(of), own)


def _long_entries(lines: Lines) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for each bucket of longer lines; a line is probed in the next lower bucket too if partners can be there."""
    length = lines.ends - lines.starts
    home, away = _bucket(length), _bucket(length - edits_of_long(length))
    buckets = np.unique(np.concatenate([home, away]))
    sizes = {bucket: _least_segment(bucket) for bucket in buckets[buckets > 0].tolist()}
    for bucket, least in ((x, least) for size, least in lines.least_grams(set(sizes.values())) for x in sizes if sizes[x] == size):
        size = sizes[bucket]
        rows = np.flatnonzero((length >= LONG) & ((home == bucket) | (away == bucket)))
        starts, chars = lines.starts[rows], length[rows]
        windows = chars - size + 1
        of = np.repeat(np.arange(len(rows)), windows)
        grams = least[expand(starts, windows)]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
        of, grams = of[new], grams[new]
        place = (grams & _PLACE).astype(np.int64)
        # The places of the segments' grams, among those of all windows, which ascend.
        mine = np.flatnonzero(home[rows] == bucket)
        edits = edits_of_long(chars[mine])
        segment = np.arange(int(edits.sum() + len(mine))) - np.repeat(np.cumsum(edits + 1) - edits - 1, edits + 1)
        k, whole, start = (np.repeat(x, edits + 1) for x in (edits, chars[mine], starts[mine]))
        base, longer = whole // (k + 1), whole % (k + 1)
        begin = segment * base + np.maximum(segment - (k + 1 - longer), 0)
        own = np.zeros(len(of), bool)
        own[np.searchsorted(place, (least[start + begin] & _PLACE).astype(np.int64))] = True
        slot = mix((grams & ~_PLACE) ^ mix(np.full(len(grams), bucket + 977, _U)))
        # A gram that a line has at several places is one entry.
        order = np.lexsort((slot, of))
        of, slot, place, own = of[order], slot[order], (place - starts[of])[order], own[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (slot[1:] != slot[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(of)) - 1
        yield bucket, rows[of[at]], slot[at], place[at], place[last], np.logical_or.reduceat(own, at)


def _shares(lines: DataFrame, params: LineParams) -> np.ndarray:
    """Among how many parts the slots of each bucket of lengths are shared out, by the text of its lines.

    A line's key, sketch and length go to every part that has a slot of it, so a bucket of little text stays in few.
    """
    length = F.col("length")
    away = length - F.least(F.floor(length / 32), F.lit(MOST_EDITS))
    bucket = lambda x: reduce(add, [(x >= F.lit(int(low))).cast("int") for low in _LOWS])
    both = F.array_distinct(F.array(bucket(length), bucket(away))) if params.classes else F.array(F.lit(0))
    out = np.ones(len(_LOWS) + 1, np.int64)
    by_length = lines.groupBy("length").agg(F.sum("length").alias("chars"))
    for number, chars in by_length.select("chars", F.explode(both).alias("bucket")).groupBy("bucket").agg(F.sum("chars")).collect():
        out[number] = max(1, -(-chars // PART_CHARS))
    return out


def _blocks(rows: DataFrame, params: LineParams, shares: np.ndarray | int) -> DataFrame:
    """``part`` and packed entries of the distinct lines of a slice of text for that part.

    Parts are of a bucket of lengths and, if its lines have more text than for one part, of a share of the slots.
    """
    shares = np.broadcast_to(np.asarray(shares, np.int64), len(_LOWS) + 1)
    before = np.cumsum(shares) - shares

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(piece.column("text"), params.steps()[0][0], visible=params.classes is not None)
        _, first = np.unique(lines.keys(), return_index=True)
        lines = lines.some(np.sort(first))
        length, keys = lines.ends - lines.starts, lines.keys()
        parts, blocks = [], []
        short = list(_short_entries(lines, params))
        groups = [(0, *(np.concatenate(x) for x in zip(*short)))] if short else []
        sketches = {True: lines.bigrams(), False: lines.character_counts()}
        for bucket, of, slot, first, last, own in [*groups, *(_long_entries(lines) if params.classes else [])]:
            share = (slot >> _U(32)) % _U(shares[bucket])
            order = np.lexsort((of, share))
            cuts = np.searchsorted(share[order], np.arange(shares[bucket] + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[i] : cuts[i + 1]]
                line, count = np.unique(of[some], return_counts=True)
                parts.append(int(before[bucket]) + i)
                blocks.append(b"".join((
                    np.array([len(line), len(some)], np.int64).tobytes(), keys[line].tobytes(), sketches[bucket == 0][line].tobytes(),
                    _planes(np.minimum(length[line], _LARGEST).astype(np.uint16)), _planes(count.astype(np.int32)),
                    slot[some].astype(np.uint32).tobytes(), *(np.minimum(x[some], _LARGEST).astype(np.uint16).tobytes() for x in (first, last - first)),
                    np.packbits(own[some]).tobytes(),
                )))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    return rows.select("text").mapInArrow(over_slices(run, limit=SLICE), "part INT, block BINARY")


def _planes(numbers: np.ndarray) -> bytes:
    """The low bytes of all numbers first: the high ones are mostly zero, which Spark's compression takes only in one run."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _unpack(block: pa.Buffer) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(block, np.int64, 2).tolist()
    at, out = 16, []
    for kind, many in ((np.int64, n), (np.int64, n), (np.uint16, n), (np.int32, n), (np.uint32, m), (np.uint16, m), (np.uint16, m)):
        size = np.dtype(kind).itemsize
        if len(out) in (2, 3):
            planes = np.frombuffer(block, np.uint8, many * size, at).reshape(size, many)
            out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        else:
            out.append(np.frombuffer(block, kind, many, at))
        at += many * size
    return (*out, np.unpackbits(np.frombuffer(block, np.uint8, -1, at), count=m).astype(bool))


def _shared(parts: list[tuple[np.ndarray, ...]], kept: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """Line, slot, first and last place and kind of the entries of kept lines whose slot may be a segment and of two lines.

    Most slots are of one line alone.  Tables of a fixed size tell them, so some of these stay.
    """

    def entries(table: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        at = 0
        for _, _, _, count, slot, place, span, own in parts:
            lines = slice(at, at + len(count))
            at = lines.stop
            some = np.flatnonzero(np.repeat(kept[lines], count) & table[slot >> np.uint32(8)])
            first = place[some].astype(np.int32)
            yield np.repeat(number[lines], count)[some], slot[some], first, first + span[some], own[some]

    segment = np.zeros(1 << 24, bool)
    for x in parts:
        segment[x[4][x[7]] >> np.uint32(8)] = True
    code = np.concatenate([(slot.astype(_U) << _U(32)) | line.astype(_U) for line, slot, *_ in entries(segment)])
    code.sort()
    code = code[1:][(code[1:] != code[:-1]) & (code[1:] >> _U(32) == code[:-1] >> _U(32))]
    twice = np.zeros(1 << 24, bool)
    twice[code >> _U(40)] = True
    twice &= segment
    return tuple(np.concatenate(x) for x in zip(*entries(twice)))


def _meet(blocks: list[pa.Buffer], short: bool, params: LineParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidate pairs of a part in batches of bounded text: the keys of a batch's lines, and pairs of places among them."""
    parts = [_unpack(block) for block in blocks]
    key, sketch, length, count = (np.concatenate([x[i] for x in parts]) for i in range(4))
    # Equal lines of several slices are one; lines of equal least slots, as near copies mostly are, get near numbers.
    least = np.concatenate([np.minimum.reduceat(x[4], np.cumsum(x[3]) - x[3]) for x in parts])
    order = np.lexsort((key, length, least))
    kept = np.zeros(len(key), bool)
    kept[np.unique(key, return_index=True)[1]] = True
    order = order[kept[order]]
    number = np.zeros(len(key), np.int32)
    number[order] = np.arange(len(order))
    key, sketch, length = key[order], sketch[order].view(_U), length[order].astype(np.int64)
    line, slot, first, last, own = _shared(parts, kept, number)
    most = _most(length, params)
    code = (slot.astype(_U) << _U(16)) | length[line].astype(_U)
    order = np.argsort(code, kind="stable")
    code, line, first, last, own = code[order], line[order], first[order], last[order], own[order]
    mine = np.flatnonzero(own)
    low = np.searchsorted(code, code[mine], "left")
    upper = (code[mine] & ~_U(0xFFFF)) | np.minimum(length[line[mine]] + most[line[mine]], _LARGEST).astype(_U)
    wide = np.searchsorted(code, upper, "right") - low
    # By line, so that a pair that meets at several segments is met in one piece.
    order = np.argsort(line[mine], kind="stable")
    order = order[wide[order] > 1]
    mine, low, wide = mine[order], low[order], wide[order]
    total = np.concatenate([[0], np.cumsum(wide)])
    ends = np.append(np.flatnonzero(np.diff(line[mine])) + 1, len(mine)) if len(mine) else np.zeros(0, np.int64)
    at = 0
    while at < len(mine):
        upto = int(ends[max(np.searchsorted(total[ends], total[at] + (1 << 20), "right") - 1, np.searchsorted(ends, at, "right"))])
        a, b = np.repeat(mine[at:upto], wide[at:upto]), expand(low[at:upto], wide[at:upto])
        at = upto
        x, y = line[a].astype(np.int64), line[b].astype(np.int64)
        near = (length[x] < length[y]) | ((length[x] == length[y]) & (x < y))
        near &= (first[a] <= last[b] + most[x]) & (first[b] <= last[a] + most[x])
        pair = np.unique(x[near] * len(key) + y[near])
        a, b = pair // len(key), pair % len(key)
        if short:
            near = np.bitwise_count(sketch[a] ^ sketch[b]) <= 4 * most[a]
        else:
            apart = np.abs(sketch[a].view(np.uint8).reshape(-1, 8).astype(np.int16) - sketch[b].view(np.uint8).reshape(-1, 8))
            near = np.minimum(apart, 256 - apart).sum(axis=1) <= 2 * most[a]
        waiting = [(a[near], b[near])] if near.any() else []
        while waiting:
            a, b = waiting.pop()
            members, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            if len(a) > 1 and (len(a) > BATCH_PAIRS or length[members].sum() > BATCH_CHARS):
                half = len(a) // 2
                waiting += [(a[half:], b[half:]), (a[:half], b[:half])]
            else:
                yield key[members], places.reshape(2, -1)


def _batch(keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([keys.tolist()], pa.list_(pa.int64())), pa.array([places.astype(np.int32).tobytes()])], ["keys", "pairs"])


def _candidates(rows: DataFrame, params: LineParams, shares: np.ndarray) -> DataFrame:
    """A written table of batches of candidate pairs: ``batch, keys, pairs``, the pairs packed as places in ``keys``.

    A pair is in one batch.  Where the slots are shared out it may meet in several parts; the pairs, which are narrow, are
    then made distinct before any text is fetched for them.
    """
    several, short = bool((shares > 1).any()), int(shares[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(part: int, blocks: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
            for number, (keys, places) in enumerate(_meet(blocks, part < short, params)):
                if several:
                    a, b = np.sort(keys[places], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), (part << 32) + number))], ["a", "b", "spot"])
                else:
                    yield _batch(keys, places)

        part, held = -1, []
        for batch in batches:  # sorted by part
            for p, block in zip(batch.column("part").to_pylist(), batch.column("block")):
                if p != part and held:
                    yield from pairs(part, held)
                    held = []
                part = p
                held.append(block.as_buffer())
        if held:
            yield from pairs(part, held)
        held = batch = block = None
        pa.default_memory_pool().release_unused()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            ends = [np.concatenate([x.column(c).to_numpy() for x in pieces]) for c in ("a", "b")]
            keys, places = np.unique(np.concatenate(ends), return_inverse=True)
            return _batch(keys, places.reshape(2, -1))

        spot, held = -1, []
        for batch in batches:  # sorted by spot and pair
            spots = batch.column("spot").to_numpy()
            starts = np.append(np.flatnonzero(np.diff(spots, prepend=-1)), len(spots)).tolist()
            for at, upto in zip(starts, starts[1:]):
                if spots[at] != spot and held:
                    yield packed(held)
                    held = []
                spot = spots[at]
                held.append(batch.slice(at, upto - at))
        if held:
            yield packed(held)

    parts = min(int(shares.sum()), 100_000)
    dealt = _blocks(rows, params, shares).repartition(parts, "part").sortWithinPartitions("part")
    if several:
        # A pair stays in the first batch that has it: near copies, which meet in most parts, stay together and their texts travel once.
        met = dealt.mapInArrow(run, "a BIGINT, b BIGINT, spot BIGINT").groupBy("a", "b").agg(F.min("spot").alias("spot"))
        found = met.repartition("spot").sortWithinPartitions("spot", "a", "b").mapInArrow(gathered, "keys ARRAY<BIGINT>, pairs BINARY")
    else:
        found = dealt.mapInArrow(run, "keys ARRAY<BIGINT>, pairs BINARY")
    return stage(found.withColumn("batch", F.monotonically_increasing_id()), "line-pairs", compression="zstd")


def _most(shorter: np.ndarray, params: LineParams) -> np.ndarray:
    """The threshold of pairs by the length of the shorter line."""
    out = np.full(len(shorter), -1, np.int64)
    for low, edits in params.steps():
        out[shorter >= low] = edits
    return np.where(shorter >= params.long(), edits_of_long(shorter), out)


def distinct_lines(occurrences: DataFrame) -> DataFrame:
    """A written table of the distinct long lines, without their texts: ``key, total, length, first_doc, line_no, often``."""
    return stage(
        occurrences.groupBy("key", "total", "length").agg(
            F.min("doc_id").alias("first_doc"), F.min_by("line_no", "doc_id").alias("line_no"), F.sum("times").alias("often")
        ),
        "distinct-lines",
    )


def _with_bit_of(rows: DataFrame, lists: DataFrame, column: str = "doc_id", also: Column | None = None) -> DataFrame:
    """The ``rows`` whose ``column`` may be among those of ``lists``, and those of ``also``, so that few are shuffled to be joined.

    The bits are a small table of a fixed size: with very many values, more rows stay than are needed.
    """
    bit = F.xxhash64(column).bitwiseAND((1 << FILTER_BITS) - 1)
    word, mask = F.shiftright(bit, 6).alias("_word"), F.expr(f"shiftleft(1L, int(xxhash64({column}) & 63))")
    bits = lists.groupBy(word).agg(F.bit_or(mask).alias("_bits"))
    met = rows.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(bits), "_word", "inner" if also is None else "left")
    near = F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))
    return met.where(near if also is None else near | also).select(*rows.columns)


def _texts(docs: DataFrame, wanted: DataFrame, params: LineParams) -> DataFrame:
    """``key, total, length, line`` of the lines ``wanted``, out of the documents in which they first occur.

    Few other lines may be among them, as a filter of a fixed size tells which lines of a document are wanted.
    """
    asked = wanted.select(F.col("key").bitwiseXOR(F.col("first_doc")).alias("mark"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(asked, "mark", FILTER_BITS))

    def pick(piece: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(piece.column("text"), params.min_chars, visible=params.classes is not None)
        keys, doc = lines.keys(), piece.column("doc_id").to_numpy()
        some = np.flatnonzero(is_set(shared.value, (keys ^ doc[lines.row]).view(_U)))
        # Once for each document, however often it has the line.
        keys, totals, rows = keys[some], lines.totals()[some], lines.row[some]
        order = np.lexsort((totals, keys, rows))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (rows, keys, totals)], axis=0)
        lines = lines.some(some[order[new]])
        spans = zip(lines.starts.tolist(), lines.ends.tolist())
        return pa.RecordBatch.from_pydict({
            "key": pa.array(lines.keys()), "total": pa.array(lines.totals()), "length": pa.array((lines.ends - lines.starts).astype(np.int32)),
            "line": pa.array([lines.points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in spans], pa.string()),
        })

    owners = _with_bit_of(_rows(docs).select("doc_id", "text"), wanted.select(F.col("first_doc").alias("doc_id")), "doc_id")
    return owners.mapInArrow(over_slices(pick, limit=SLICE), "key BIGINT, total BIGINT, length INT, line STRING")


def edit_links(docs: DataFrame, lines: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``a, a_total, b, b_total``: all pairs of different lines within the threshold, once each, ``a`` occurring first."""
    def pairs(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("a", "a_total", "b", "b_total"), _verified(table, params))))

    return _batches(docs, lines, params).groupBy("batch").applyInArrow(pairs, "a BIGINT, a_total BIGINT, b BIGINT, b_total BIGINT")


def link_counts(docs: DataFrame, lines: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``key, total, links, later`` of the lines of :func:`edit_links`: how many partners, and 1 if one occurs earlier.

    Pairs are counted in their batch, which no other one shares, and their links never become rows.
    """
    def counted(table: pa.Table) -> pa.Table:
        a, a_total, b, b_total = _verified(table, params)
        key, total = np.concatenate([a, b]), np.concatenate([a_total, b_total])
        ends = pa.table({"key": key, "total": total, "later": np.repeat(np.array([0, 1], np.int32), len(a))})
        out = ends.group_by(["key", "total"]).aggregate([("later", "count"), ("later", "max")])
        return out.select(["key", "total", "later_count", "later_max"]).rename_columns(["key", "total", "links", "later"])

    ends = _batches(docs, lines, params).groupBy("batch").applyInArrow(counted, "key BIGINT, total BIGINT, links BIGINT, later INT")
    return stage(ends.groupBy("key", "total").agg(F.sum("links").alias("links"), F.max("later").alias("later")), "line-links")


def _batches(docs: DataFrame, lines: DataFrame, params: LineParams) -> DataFrame:
    """The batches with the texts of their lines."""
    batches = _candidates(_rows(docs), params, _shares(lines, params))
    members = batches.select("batch", F.explode("keys").alias("key"))
    wanted = _with_bit_of(lines, members, "key").join(members.select("key").distinct(), "key")
    wanted = stage(wanted.select(*lines.columns), "line-owners", compression="zstd")
    # A line's text meets its first place by its key alone, as its batches then do, so that texts are dealt by it once.
    both = _texts(docs, wanted, params).unionByName(wanted.drop("often"), allowMissingColumns=True).repartition("key")
    texts = both.groupBy("key", "total", "length").agg(*(F.first(x, ignorenulls=True).alias(x) for x in ("line", "first_doc", "line_no")))
    texts = texts.where("line is not null and first_doc is not null").select("key", "total", "line", "first_doc", "line_no")
    # The pairs of a batch are a row of their own beside its lines.
    pairs = batches.select("batch", *(F.lit(None).cast(kind).alias(name) for name, kind in texts.dtypes), "keys", "pairs")
    return members.join(texts, "key").select("batch", *texts.columns).unionByName(pairs, allowMissingColumns=True)


def _verified(table: pa.Table, params: LineParams) -> tuple[np.ndarray, ...]:
    """Key and total of the earlier and of the later line of each pair of a batch that is within the threshold."""
    is_line = pc.is_valid(table.column("key"))
    some, (asked,) = table.filter(is_line), table.filter(pc.invert(is_line)).to_pylist()
    key, total, doc, number = (some.column(c).to_numpy() for c in ("key", "total", "first_doc", "line_no"))
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((total, key, number, doc))] = np.arange(len(key))
    keys = np.array(asked["keys"], np.int64)
    low, high = (np.searchsorted(key[order], keys, side) for side in ("left", "right"))
    u, v = np.frombuffer(asked["pairs"], np.int32).reshape(2, -1).astype(np.int64)
    # Mostly one line has a key; lines that share one by chance are all compared.
    many = high - low
    u, v = np.repeat(u, many[u] * many[v]), np.repeat(v, many[u] * many[v])
    turn = np.arange(len(u)) - np.searchsorted(u * len(keys) + v, u * len(keys) + v)
    u, v = order[low[u] + turn // np.maximum(many[v], 1)], order[low[v] + turn % np.maximum(many[v], 1)]
    column = some.column("line").combine_chunks()
    length = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    most = _most(np.minimum(length[u], length[v]), params)
    near = within_own_edits(column, u, v, most) <= most
    u, v = u[near], v[near]
    a, b = np.where(rank[u] < rank[v], u, v), np.where(rank[u] < rank[v], v, u)
    return key[a], total[a], key[b], total[b]


def _decided(occurrences: DataFrame, lines: DataFrame, per_line: DataFrame) -> DataFrame:
    # Most lines occur once and have no link; these are counted without meeting their occurrences.
    some = _with_bit_of(lines, per_line, "key", also=F.col("often") > 1)
    known = some.join(per_line, ["key", "total"], "left").select(
        "key", "total", "length", "first_doc", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("later", F.lit(0)).alias("later"), "often",
    )
    known = stage(known.where("often > 1 or links > 0").drop("often"), "line-repeats")
    occurrences = _with_bit_of(occurrences, known, "key")
    return occurrences.join(known, ["key", "total", "length"]).select(
        "doc_id", "row_key", "line_no", "key", "times", "links", (F.col("doc_id") > F.col("first_doc")).alias("exact"), (F.col("later") == 1).alias("near"),
    )


def line_decisions(docs: DataFrame, params: LineParams = LineParams()) -> tuple[DataFrame, DataFrame]:
    """``row_key, times`` of all distinct long lines of each document, and ``doc_id, row_key, line_no, key, times, links,
    exact, near`` of those that occur more than once or have links.

    ``exact``: an equal line occurs in a document of lower id.  ``near``: a different line within the threshold first
    occurs earlier (by document id, then line number; null ids last).  ``links``: number of such lines, earlier or not.
    """
    occurrences = _occurrences(docs, params)
    lines = distinct_lines(occurrences)
    return occurrences.select("row_key", "times"), _decided(occurrences, lines, link_counts(docs, lines, params))


def line_report(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``doc_id, n_lines, n_long, n_exact, n_near, n_links``, one row per row of ``docs``.

    Lines are split at line feeds; a null text has none, an empty one has one.  ``n_exact`` counts long lines that occur
    before, in the document or in one of lower id; ``n_near`` the others that differ little from a line that first
    occurs earlier; ``n_links`` the different lines within the threshold of each of its distinct long lines.  Rows that
    share a ``doc_id`` are separate; neither removes lines of the other.
    """
    long, decided = line_decisions(docs, params)
    marks = decided.groupBy("row_key").agg(
        F.sum(F.when(F.col("exact"), F.col("times")).otherwise(F.col("times") - 1)).alias("n_exact"),
        F.sum((~F.col("exact") & F.col("near")).cast("bigint")).alias("n_near"), F.sum("links").alias("n_links"),
    )
    per_row = long.groupBy("row_key").agg(F.sum("times").alias("times")).join(marks, "row_key", "left")
    # Equal rows are counted together above and divided again here.
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), _row_key(docs).alias("row_key"),
        F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
    )
    equal = rows.groupBy("row_key").agg(F.count("*").alias("rows"))
    shared = per_row.join(equal, "row_key")
    each = [F.expr(f"cast({c} div rows as bigint)").alias(c) for c in ("times", "n_exact", "n_near", "n_links")]
    out = rows.join(shared.select("row_key", *each), "row_key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_exact", "n_near", "n_links")]
    return out.select("doc_id", "n_lines", F.coalesce("times", F.lit(0)).cast("bigint").alias("n_long"), *zero)


def without_repeats(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """The documents without repeated lines: all columns as they are, ``text`` (and ``n_chars``, if there) shortened.

    Lines that :func:`line_report` counts as exact or near go; documents of which no visible character is left by this
    go, others stay even if they were blank before.
    """
    _, decided = line_decisions(docs, params)
    gone = decided.where(F.col("exact") | F.col("near") | (F.col("times") > 1))
    lists = gone.groupBy("row_key").agg(
        F.array_distinct(F.collect_list(F.when(F.col("exact") | F.col("near"), F.col("key")))).alias("_starloom_gone")
    ).withColumnRenamed("row_key", "_starloom_row")
    marked = docs.join(lists, _row_key(docs) == F.col("_starloom_row"), "left").drop("_starloom_row")
    at, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            texts = piece.column("text").to_pylist()
            gone = piece.column("_starloom_gone").to_pylist()
            touched = [i for i, g in enumerate(gone) if g is not None]
            keep = np.ones(len(texts), bool)
            if touched:
                chosen = piece.column("text").take(pa.array(touched))
                lines = Lines(chosen, params.min_chars, visible=params.classes is not None)
                keys = lines.keys()
                bounds = np.searchsorted(lines.row, np.arange(len(touched) + 1))
                for k, i in enumerate(touched):
                    drop, seen, left = set(gone[i]), set(), texts[i].split("\n")
                    cut = set()
                    for key, number in zip(keys[bounds[k] : bounds[k + 1]].tolist(), lines.number[bounds[k] : bounds[k + 1]].tolist()):
                        if key in drop or key in seen:
                            cut.add(number)
                        seen.add(key)
                    texts[i] = "\n".join(x for number, x in enumerate(left) if number not in cut)
                    keep[i] = bool(texts[i].strip())
            columns = [piece.column(c) for c in range(piece.num_columns - 1)]
            columns[at] = pa.array(texts, columns[at].type)
            if n_chars is not None and touched:
                sizes = columns[n_chars].to_pylist()
                for i in touched:
                    sizes[i] = len(texts[i])
                columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, piece.schema.names[:-1]).filter(pa.array(keep))

    return marked.mapInArrow(rebuild, docs.schema)


def op1_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines of every document."""
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), WHOLE)
