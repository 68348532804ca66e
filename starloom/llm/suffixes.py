"""Removal of repeated passages by sorting suffixes: every byte of a string of given length that also starts earlier.

Deep-shallow sorting: suffixes are split by their first words of eight bytes, multikey quicksort fashion, to a shallow depth;
what is still together then has a long common prefix, and blind tries order it: one suffix of a group is compared with the
others' bytes, which hang off its path at the place and byte where they leave it, and so on for what hangs at one branch.

To sort a corpus in parts, equal strings must meet in one part.  Every string of the length has an anchor, its k-gram of
least hash, so equal ones have equal anchors.  Anchors are counted first, as hashes; only texts around repeated anchors are
sent to the part of their anchor's hash and sorted there.  Texts travel compressed, in pieces of some megabytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.text import BYTE_VALUE, Texts, expand, mix, powers, room, slices
from starloom.session import stage_by

_U = np.uint64
# Starts whose anchors are found at a time; their places fit into so many bits beside a hash's leading ones.
SEGMENT, PLACE_BITS = 1 << 19, 24
NULL_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class RepeatParams:
    length: int = 100
    anchor: int = 24
    # Bytes of text in a piece, and at most around repeated anchors in a part: the memory of a task.
    piece_bytes: int = 4 << 20
    part_bytes: int = 8 << 20
    # Depth of the first phase of sorting.
    shallow: int = 32
    # Strings of an anchor in so many pieces are dealt out by their own hashes.
    hot_pieces: int = 1024


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number of the same order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), ">u8", buffer=padded, strides=(1,))


def _word(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The word at a depth of each string, zeros beyond its end."""
    left = lengths - depth
    word = words[np.minimum(starts + depth, len(words) - 1)].astype(_U)
    cut = (8 * np.clip(8 - left, 0, 7)).astype(_U)
    return np.where(left > 0, word >> cut << cut, _U(0))


def sort_strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings ``data[start:start + length]`` by length, then bytes, and which differ from their predecessor."""
    words = _words(data)
    order = np.argsort(lengths, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = lengths[order][1:] != lengths[order][:-1]
    longest = int(lengths.max(initial=0))
    # Multikey quicksort: the members of a group are sorted by their next word; those equal in it form a group again.
    places = _together(new)
    for depth in range(0, min(shallow, longest), 8):
        if not len(places):
            return order, new
        member = order[places]
        group = np.cumsum(new[places])
        word = _word(words, starts[member], lengths[member], depth)
        by = np.argsort(word) if group[-1] == group[0] else np.lexsort((word, group))
        order[places] = member[by]
        word = word[by]
        new[places[1:]] |= word[1:] != word[:-1]
        places = _together(new)
    return _blind_tries(data, words, starts, lengths, shallow, order, new, places)


def _together(new: np.ndarray) -> np.ndarray:
    """The places that are in a group with others."""
    alone = new & np.concatenate([new[1:], [True]])
    return np.flatnonzero(~alone)


def _blind_tries(data, words, starts, lengths, shallow, order, new, places) -> tuple[np.ndarray, np.ndarray]:
    """Order groups with a common prefix, all at once; see :func:`sort_strings`."""
    longest = int(lengths.max(initial=0))
    end = longest + 1
    while len(places):
        member = order[places]
        group = np.cumsum(new[places]) - 1
        head = member[np.flatnonzero(new[places])][group]
        # Where a member leaves the path of its group's first one; the length if nowhere.
        leaves = np.full(len(member), end)
        open_ = np.flatnonzero(member != head)
        for depth in range(shallow, longest, 8):
            mine, first = member[open_], head[open_]
            differ = _word(words, starts[mine], lengths[mine], depth) ^ _word(words, starts[first], lengths[first], depth)
            found = differ != 0
            at = open_[found]
            leaves[at] = depth + sum((differ[found] >> _U(8 * (7 - i)) == 0).astype(np.int64) for i in range(7))
            open_ = open_[~found]
            if not len(open_):
                break
        apart = np.flatnonzero(leaves < end)
        byte = data[starts[member[apart]] + leaves[apart]].astype(np.int64)
        other = data[starts[head[apart]] + leaves[apart]]
        # Below the path: what leaves it first comes first; above: last.  The path's own end is between them.
        branch = np.full(len(member), end * 256)
        branch[apart] = np.where(byte < other, leaves[apart], 2 * end - leaves[apart]) * 256 + byte
        by = np.lexsort((branch, group))
        order[places] = member[by]
        branch = branch[by]
        new[places[1:]] |= branch[1:] != branch[:-1]
        # Equal to the path's end: done; members of one branch go on together.
        rest = places[branch != end * 256]
        joins = np.zeros(len(new) + 1, bool)
        joins[rest] = True
        tail = joins[:-1] & ~new
        places = np.flatnonzero(tail | (joins[:-1] & np.concatenate([tail[1:], [False]])))
    return order, new


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` bytes."""
    words, lengths, out = _words(data), np.broadcast_to(np.int64(length), len(starts)), np.zeros(len(starts), _U)
    for depth in range(0, length, 8):
        out = mix(out + _word(words, starts, lengths, depth))
    return out


def repeats(data, starts, lengths, ids, places, shallow) -> np.ndarray:
    """Which strings also start earlier: with a smaller id, or the same and a smaller place."""
    order, new = sort_strings(data, starts, lengths, shallow)
    group = np.cumsum(new) - 1
    shared = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
    member, group = order[shared], group[shared]
    by = np.lexsort((places[member], ids[member], group))
    member, group = member[by], group[by]
    head = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
    first = member[head][np.cumsum(head) - 1]
    out = np.zeros(len(starts), bool)
    out[member] = (ids[member] != ids[first]) | (places[member] != places[first])
    return out


@dataclass
class Runs:
    """Successive starts of one text with one anchor: the first start, how many, and the anchor's hash."""

    start: np.ndarray
    count: np.ndarray
    hash: np.ndarray


def anchor_runs(texts: Texts, length: int, width: int) -> Runs:
    """All starts of strings of ``length`` bytes that lie within a text.  Least hashes are small, so they are mixed anew."""
    size = length - width + 1
    room_left = np.repeat(texts.offsets[1:], np.diff(texts.offsets)) if len(texts.data) <= SEGMENT else None
    parts: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(0, len(texts.data) - length + 1), SEGMENT):
        piece = texts.data[begin : begin + SEGMENT + length - 1]
        n = len(piece)
        up, down = powers(room(n + 1))
        prefix = np.zeros(n + 1, _U)
        np.cumsum(BYTE_VALUE[piece] * up[:n], out=prefix[1:])
        grams = mix((prefix[width:] - prefix[:-width]) * down[: n - width + 1])
        least = (grams >> _U(PLACE_BITS) << _U(PLACE_BITS)) | np.arange(len(grams), dtype=_U)
        reach = 1
        while reach < size:  # the least of ``size`` successive values, by doubling
            step = min(reach, size - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        at = (least & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(begin, begin + len(at))
        end = room_left[starts] if room_left is not None else texts.offsets[np.searchsorted(texts.offsets, starts, "right")]
        inside = np.flatnonzero(starts + length <= end)
        if not len(inside):
            continue
        head = np.concatenate([[True], (np.diff(at[inside]) != 0) | (np.diff(inside) != 1)])
        first = np.flatnonzero(head)
        parts.append((starts[inside[first]], np.diff(np.concatenate([first, [len(inside)]])), mix(~grams[at[inside[first]]])))
    if not parts:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and where."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(part[at[0]]), at


def pieces(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``piece, ids, sizes, text``: the documents' texts in compressed pieces, a written table dealt out by piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", params.piece_bytes):
            texts = Texts.of(batch.column("text"))
            row = {
                "piece": pa.array([number]), "ids": pa.array([batch.column("doc_id")], pa.list_(pa.int64())),
                "sizes": pa.array([np.diff(texts.offsets)], pa.list_(pa.int64())),
                "text": pa.array([pa.compress(pa.py_buffer(texts.data.tobytes()), codec="zstd", asbytes=True)], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(row)
            number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(cut, "piece BIGINT, ids ARRAY<BIGINT>, sizes ARRAY<BIGINT>, text BINARY")
    return stage_by(made, "pieces", "piece", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _texts_of(batch: pa.RecordBatch, i: int) -> Texts:
    offsets = np.concatenate([[0], np.cumsum(batch.column("sizes")[i].values.to_numpy(zero_copy_only=False))]).astype(np.int64)
    data = pa.decompress(batch.column("text")[i].as_buffer(), int(offsets[-1]), codec="zstd") if offsets[-1] else b""
    return Texts(np.frombuffer(data, np.uint8), offsets)


def repeated_anchors(table: DataFrame, parts: int, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``piece, part, marks``: which of a piece's distinct anchors (in order of their hashes) occur again, and which in many pieces."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                hashes, counts = np.unique(anchor_runs(_texts_of(batch, i), params.length, params.anchor).hash, return_counts=True)
                rows = [(part, hashes[at].tobytes(), np.packbits(counts[at] > 1).tobytes()) for part, at in _by_part(part_of(hashes, parts))]
                part, own, twice = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(part, pa.int32()), "piece": pa.array([batch.column("piece")[i].as_py()] * len(part), pa.int64()),
                    "hashes": pa.array(own, pa.binary()), "twice": pa.array(twice, pa.binary()),
                })

    def compare(rows: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), _U) for x in rows.column("hashes")]
        twice = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(o)) for x, o in zip(rows.column("twice"), own, strict=True)]
        distinct, at, among = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        again = (among > 1) | (np.bincount(at, np.concatenate(twice)) > 0)
        cuts = np.cumsum([len(o) for o in own])[:-1]
        marks = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(again[at], cuts), np.split(among[at] >= params.hot_pieces, cuts), strict=True)]
        return pa.table({"piece": rows.column("piece"), "part": rows.column("part"), "marks": pa.array(marks, pa.binary())})

    each = table.select("piece", "sizes", "text").mapInArrow(collect, "part INT, piece BIGINT, hashes BINARY, twice BINARY")
    return each.groupBy("part").applyInArrow(compare, "piece BIGINT, part INT, marks BINARY")


def _spans(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Successive starts of repeated strings, for :func:`_removed`."""
    return np.stack([docs, starts, counts]).astype("<i8").tobytes()


def strings_by_part(table: DataFrame, marks: DataFrame, parts: int, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``part, piece, head, text, spans``: the texts around repeated anchors, and what already repeats within a piece.

    Of equal texts around an anchor in one piece only the first goes on.  A hot anchor's strings are compared one by one
    and go to the parts of their own hashes, so no part gets all of them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                texts, piece = _texts_of(batch, i), batch.column("piece")[i].as_py()
                ids = np.array([NULL_ID if x is None else x for x in batch.column("ids")[i].as_py()], np.int64)
                runs = anchor_runs(texts, params.length, params.anchor)
                distinct, which = np.unique(runs.hash, return_inverse=True)
                again, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
                part = part_of(distinct, parts)
                for mark in batch.column("marks")[i].as_py():
                    lo, hi = np.searchsorted(part, [mark["part"], mark["part"] + 1])
                    bits = np.frombuffer(mark["marks"], np.uint8)
                    again[lo:hi] = np.unpackbits(bits[: len(bits) // 2], count=hi - lo)
                    hot[lo:hi] = np.unpackbits(bits[len(bits) // 2 :], count=hi - lo)
                plain, single = again[which] & ~hot[which], hot[which]
                starts = np.concatenate([runs.start[plain], expand(runs.start[single], runs.count[single])])
                counts = np.concatenate([runs.count[plain], np.ones(len(starts) - int(plain.sum()), np.int64)])
                own = expand(runs.start[single], runs.count[single])
                hashes = np.concatenate([runs.hash[plain], string_hashes(texts.data, own, params.length)])
                docs = np.searchsorted(texts.offsets, starts, "right") - 1
                lengths = counts + params.length - 1
                known = repeats(texts.data, starts, lengths, ids[docs], starts - texts.offsets[docs], params.shallow)
                spans = _spans(docs[known], (starts - texts.offsets[docs])[known], counts[known])
                rows = [(piece % parts, None, None, spans)] if known.any() else []
                go = np.flatnonzero(~known)
                for number, at in _by_part(part_of(hashes[go], parts)):
                    at = go[at]
                    head = np.stack([ids[docs[at]], starts[at] - texts.offsets[docs[at]], docs[at], counts[at]]).astype("<i8").tobytes()
                    body = texts.data[expand(starts[at], lengths[at])].tobytes()
                    rows.append((number, head, pa.compress(body, codec="zstd", asbytes=True), None))
                number, head, body, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(number, pa.int32()), "piece": pa.array([piece] * len(rows), pa.int64()),
                    "head": pa.array(head, pa.binary()), "text": pa.array(body, pa.binary()), "spans": pa.array(spans, pa.binary()),
                })

    listed = marks.groupBy("piece").agg(F.collect_list(F.struct("part", "marks")).alias("marks"))  # as many as parts, bits of one piece
    joined = table.join(listed, "piece").select("piece", "ids", "sizes", "text", "marks")
    return joined.mapInArrow(send, "part INT, piece BIGINT, head BINARY, text BINARY, spans BINARY")


def sorted_parts(sent: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``piece, spans``: the strings that start earlier elsewhere, found by sorting each part."""

    def sort(rows: pa.Table) -> pa.Table:
        full = [i for i, x in enumerate(rows.column("head")) if x.is_valid]
        out_piece = rows.column("piece").to_pylist()
        found = [(p, s.as_py()) for p, s in zip(out_piece, rows.column("spans"), strict=True) if s.is_valid]
        if full:
            heads = [np.frombuffer(rows.column("head")[i].as_buffer(), "<i8").reshape(4, -1) for i in full]
            ids, places, docs, counts = np.concatenate(heads, axis=1)
            owner = np.repeat(np.arange(len(full)), [h.shape[1] for h in heads])
            lengths = counts + params.length - 1
            sizes = np.bincount(owner, lengths, len(full)).astype(np.int64)
            bodies = [pa.decompress(rows.column("text")[i].as_buffer(), int(n), codec="zstd") for i, n in zip(full, sizes, strict=True)]
            data = np.concatenate([np.frombuffer(b, np.uint8) for b in bodies])
            del bodies, heads
            starts = np.cumsum(lengths) - lengths
            # Whole texts first: all strings of an equal one repeat.
            whole = repeats(data, starts, lengths, ids, places, params.shallow)
            rest = np.flatnonzero(~whole)
            of = np.repeat(rest, counts[rest])
            begin = expand(starts[rest], counts[rest])
            place = begin - starts[of] + places[of]
            again = repeats(data, begin, np.broadcast_to(np.int64(params.length), len(begin)), ids[of], place, params.shallow)
            of, place = of[again], place[again]
            # Successive starts of one text as one span.
            head = np.concatenate([[True], (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)])[: len(of)]
            first = np.flatnonzero(head)
            number = np.diff(np.concatenate([first, [len(of)]]))
            run = np.concatenate([np.flatnonzero(whole), of[first]])
            run_place = np.concatenate([places[whole], place[first]])
            run_count = np.concatenate([counts[whole], number])
            for j, at in _by_part(owner[run]):
                found.append((out_piece[full[j]], _spans(docs[run[at]], run_place[at], run_count[at])))
        return pa.table({"piece": pa.array([p for p, _ in found], pa.int64()), "spans": pa.array([s for _, s in found], pa.binary())})

    return sent.groupBy("part").applyInArrow(sort, "piece BIGINT, spans BINARY")


def without_repeats(table: DataFrame, spans: DataFrame, params: RepeatParams = RepeatParams(), texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes that stay, if ``texts``) of all documents."""
    fields = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    fields |= {"kept": pa.binary()} if texts else {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                whole = _texts_of(batch, i)
                change = np.zeros(len(whole.data) + 1, np.int32)
                for span in batch.column("spans")[i].as_py() or ():
                    docs, starts, counts = np.frombuffer(span, "<i8").reshape(3, -1)
                    np.add.at(change, whole.offsets[docs] + starts, 1)
                    np.add.at(change, whole.offsets[docs] + starts + counts + params.length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edges = whole.offsets[:-1][np.diff(whole.offsets) > 0]
                begins[edges] = gone[edges]
                upto, begun = (np.concatenate([[0], np.cumsum(x)])[whole.offsets] for x in (gone, begins))
                stays = whole.data[~gone].tobytes()
                cuts = whole.offsets - upto
                kept = [stays[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = {
                    "doc_id": batch.column("ids")[i].values, "n_bytes": np.diff(whole.offsets), "n_removed": np.diff(upto), "n_spans": np.diff(begun),
                    "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept": kept,
                }
                yield pa.RecordBatch.from_pydict({k: pa.array(columns[k], kind) for k, kind in fields.items()})

    listed = spans.groupBy("piece").agg(F.collect_list("spans").alias("spans"))  # at most one for each string of the piece
    joined = table.join(listed, "piece", "left").select("ids", "sizes", "text", "spans")
    kinds = {pa.int64(): "BIGINT", pa.string(): "STRING", pa.binary(): "BINARY"}
    return joined.mapInArrow(cut, ", ".join(f"{k} {kinds[kind]}" for k, kind in fields.items()))


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams(), texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: one row per row of ``docs``; with ``texts`` also ``kept``.

    A byte of a text's UTF-8 form goes if it lies in a string of ``length`` bytes that also starts earlier: in a document of
    smaller id, or of the same id at an earlier place; a null id counts as the smallest.  Rows of the same id at the same
    place aren't earlier than each other, so exact copies of a row with its id all stay.  A null text is empty; texts
    shorter than ``length`` stay.  ``kept`` is bytes, as a cut may go through a character.  Only ``doc_id`` and ``text`` are
    read; an empty table gives none.
    """
    table = pieces(docs, params)
    size = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
    # Successive anchors are half a window apart on average, and each has a string around it.
    step = (params.length - params.anchor + 2) / 2
    parts = max(1, -(-int(size * (params.length + step) / step) // params.part_bytes))
    marks = repeated_anchors(table, parts, params)
    return without_repeats(table, sorted_parts(strings_by_part(table, marks, parts, params), params), params, texts)


def op12_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes leave of every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH rows AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
    SELECT r, doc_id, h, unnest(range(len(h) // 200)) AS k FROM rows
), blocks AS (
    SELECT r, doc_id, k, h[200 * k + 1 : 200 * k + 400] AS b FROM starts
), strings AS (
    SELECT r, doc_id, 100 * k + i AS s, md5_number(b[2 * i + 1 : 2 * i + 200]) AS key
    FROM blocks, range(100) AS t(i) WHERE 2 * i + 200 <= len(b)
), firsts AS (
    SELECT key, min({'d': doc_id, 's': s}) AS f FROM strings GROUP BY key HAVING count(*) > 1
), again AS (
    SELECT r, s, coalesce(s > 100 + lag(s) OVER (PARTITION BY r ORDER BY s), true) AS opens
    FROM strings JOIN firsts USING (key) WHERE (doc_id, s) > (f.d, f.s)
), spans AS (
    SELECT r, min(s) AS lo, max(s) + 100 AS hi FROM (
        SELECT r, s, sum(CAST(opens AS INT)) OVER (PARTITION BY r ORDER BY s) AS span FROM again
    ) GROUP BY r, span
), cuts AS (
    SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM spans
), gone AS (
    SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM spans GROUP BY r
), kept AS (
    SELECT c.r, string_agg(h[2 * since + 1 : 2 * lo], '' ORDER BY lo) AS head FROM cuts c JOIN rows USING (r) GROUP BY c.r
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM rows LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
