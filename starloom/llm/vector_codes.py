"""Product-quantised codes of vectors: codebooks by Lloyd's rounds over cover trees.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own.  A slice of vectors
carries one cover tree per part position, built once and kept in a written table.  A tree lays its points out so that every
subtree is a range, and cumulative sums over that layout give the count and the sum of any subtree.  A round walks the
trees from their roots: by the triangle inequality a node keeps only the entries that can be nearest to one of its points,
and with one entry left the whole subtree goes to it.  What is still ambiguous at the leaves is compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.text import expand
from starloom.operators.skew import lookup
from starloom.session import stage

NODE_FIELDS = 6  # centre, lo, hi, first child, number of children, squared radius


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    # A component becomes the floor of this times it.
    scale: int = 256
    # Components in one slice, which bounds the memory of a task; nodes of so few points are not split further.
    slice_values: int = 1 << 19
    leaf: int = 8


@dataclass
class Forest:
    """One cover tree per part over ``n`` points each; the points of part ``k`` are ``points[k * n:(k + 1) * n]``.

    ``order`` lists the points so that node ``i`` has those at places ``lo[i]`` to ``hi[i]``; ``centre`` is a point.
    """

    points: np.ndarray
    parts: int
    order: np.ndarray
    nodes: np.ndarray

    def column(self, name: str) -> np.ndarray:
        return self.nodes[:, ["centre", "lo", "hi", "child", "children", "radius2"].index(name)]


def grow(points: np.ndarray, parts: int, leaf: int) -> Forest:
    """Cover trees of all parts, level by level.

    A node covers its points within its radius.  Its children cover theirs within half of it, and their centres lie further
    apart than that: the node's own centre first, then, as long as points are left, the first of them.
    """
    n = len(points) // parts
    starts = np.arange(parts) * n
    order = np.arange(parts * n)
    distance2 = ((points - np.repeat(points[starts], n, axis=0)) ** 2).sum(1)
    level = np.stack([starts, starts, starts + n], axis=1)
    levels: list[np.ndarray] = []
    made = parts
    while len(level):
        centre, lo, hi = level.T
        # Sibling ranges of one level may have gaps between them, so each range is reduced on its own.
        inside = expand(lo, hi - lo)
        radius2 = np.maximum.reduceat(distance2[inside], np.cumsum(hi - lo) - (hi - lo))
        split = np.flatnonzero((hi - lo > leaf) & (radius2 > 0))
        children = np.zeros(len(level), np.int64)
        child = np.zeros(len(level), np.int64)
        following = np.zeros((0, 3), np.int64)
        if len(split):
            places = expand(lo[split], (hi - lo)[split])
            owner = np.repeat(np.arange(len(split)), (hi - lo)[split])
            reach2 = (radius2[split] // 4)[owner]
            near = distance2[places]
            slot = np.zeros(len(places), np.int64)
            centres = [(np.arange(len(split)), np.zeros(len(split), np.int64), centre[split])]
            left = np.flatnonzero(near > reach2)
            rest, own, limit = points[order[places[left]]], owner[left], reach2[left]
            while len(left):
                head = np.concatenate([[True], own[1:] != own[:-1]])
                group = np.cumsum(head) - 1
                found = ((rest - rest[head][group]) ** 2).sum(1)
                centres.append((own[head], np.full(head.sum(), len(centres)), order[places[left[head]]]))
                covered = found <= limit
                slot[left[covered]], near[left[covered]] = len(centres) - 1, found[covered]
                left, rest, own, limit = left[~covered], rest[~covered], own[~covered], limit[~covered]
            width = len(centres)
            key = owner * width + slot
            by_child = np.argsort(key, kind="stable")
            order[places], distance2[places] = order[places[by_child]], near[by_child]
            keys, counts = np.unique(key, return_counts=True)
            whose, which, point = (np.concatenate(x) for x in zip(*centres, strict=True))
            point = point[np.argsort(whose * width + which)]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] // width != keys[:-1] // width]))
            number = np.diff(np.concatenate([first, [len(keys)]]))
            begin = np.cumsum(counts) - counts
            begin = begin - np.repeat(begin[first], number) + lo[split][keys // width]
            following = np.stack([point, begin, begin + counts], axis=1)
            children[split], child[split] = number, made + first
            made += len(keys)
        levels.append(np.stack([centre, lo, hi, child, children, radius2], axis=1))
        level = following
    return Forest(points, parts, order, np.concatenate(levels))


def squared_distances(a: np.ndarray, b: np.ndarray, floats: bool) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b``; ``floats`` if they stay below 2^53."""
    if floats:
        a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def walk(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries: the whole subtrees given away and their entries, single places and theirs.

    ``books`` is parts x entries x width.  Of equally near entries the lowest wins.
    """
    n = len(forest.order) // forest.parts
    centre, lo, hi, child, children, radius2 = forest.nodes.T
    width = books.shape[2]
    most = max(int(np.abs(forest.points).max(initial=0)), int(np.abs(books).max(initial=0)))
    floats = width * (2 * most) ** 2 < 1 << 53
    never = np.inf if floats else np.iinfo(np.int64).max
    frontier = np.arange(forest.parts)
    possible = np.ones((forest.parts, books.shape[1]), bool)
    whole, whole_entry, single, single_entry = [], [], [], []
    while len(frontier):
        part = lo[frontier] // n
        cuts = np.searchsorted(part, np.arange(forest.parts + 1))
        descend, kept = [], []
        for k in range(forest.parts):
            nodes, can = frontier[cuts[k] : cuts[k + 1]], possible[cuts[k] : cuts[k + 1]]
            if not len(nodes):
                continue
            found = np.where(can, squared_distances(forest.points[centre[nodes]], books[k], floats), never)
            best = found.argmin(1)
            root = np.sqrt(found.astype(np.float64))
            radius = np.sqrt(radius2[nodes].astype(np.float64))
            bound = (root[np.arange(len(nodes)), best] + 2 * radius) * (1 + 1e-9)
            near = can & (root <= bound[:, None])
            sure = (near.sum(1) == 1) | (radius2[nodes] == 0)
            whole.append(nodes[sure])
            whole_entry.append(best[sure])
            open_leaf = ~sure & (children[nodes] == 0)
            if open_leaf.any():
                size = (hi - lo)[nodes[open_leaf]]
                places = expand(lo[nodes[open_leaf]], size)
                exact = squared_distances(forest.points[forest.order[places]], books[k], floats)
                single.append(places)
                single_entry.append(np.where(np.repeat(near[open_leaf], size, axis=0), exact, never).argmin(1))
            deeper = ~sure & (children[nodes] > 0)
            descend.append(nodes[deeper])
            kept.append(near[deeper])
        above = np.concatenate(descend)
        frontier = expand(child[above], children[above])
        possible = np.repeat(np.concatenate(kept), children[above], axis=0)
    nothing = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or nothing) for x in (whole, whole_entry, single, single_entry))


def sums(forest: Forest, books: np.ndarray) -> np.ndarray:
    """Count and component sums of the points nearest to each entry: parts x entries x (1 + width)."""
    n, (parts, entries, width) = len(forest.order) // forest.parts, books.shape
    laid_out = forest.points[forest.order]
    upto = np.zeros((len(laid_out) + 1, width + 1), np.int64)
    upto[1:, 0] = np.arange(1, len(laid_out) + 1)
    np.cumsum(laid_out, axis=0, out=upto[1:, 1:])
    lo, hi = forest.column("lo"), forest.column("hi")
    nodes, node_entry, places, place_entry = walk(forest, books)
    out = np.zeros((parts * entries, width + 1), np.int64)
    np.add.at(out, lo[nodes] // n * entries + node_entry, upto[hi[nodes]] - upto[lo[nodes]])
    np.add.at(out, places // n * entries + place_entry, upto[places + 1] - upto[places])
    return out.reshape(parts, entries, width + 1)


def codes(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's entries (vectors x parts) and its squared distance to them, summed over the parts."""
    parts, n = forest.parts, len(forest.order) // forest.parts
    lo, hi = forest.column("lo"), forest.column("hi")
    nodes, node_entry, places, place_entry = walk(forest, books)
    at = np.zeros(len(forest.order), np.int64)
    size = (hi - lo)[nodes]
    at[forest.order[expand(lo[nodes], size)]] = np.repeat(node_entry, size)
    at[forest.order[places]] = place_entry
    gap = forest.points - books[np.repeat(np.arange(parts), n), at]
    return at.reshape(parts, n).T, (gap * gap).sum(1).reshape(parts, n).sum(0)


def usable(vectors: DataFrame, params: CodeParams = CodeParams()) -> DataFrame:
    """``vec_id, label, components`` (integers) of the rows whose vector has components, all of them finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = vectors.where(F.col("embedding").isNotNull()).where(F.size("embedding") > 0).where(~bad)
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(params.scale))))
    return good.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", whole.alias("components"))


def first_books(rows: DataFrame, params: CodeParams = CodeParams()) -> np.ndarray:
    """The parts of the vectors with the smallest ids, as many as a codebook has entries."""
    by = [F.col("vec_id").asc_nulls_last(), F.col("components")]
    first = [r.components for r in rows.orderBy(*by).limit(params.entries).collect()]
    first = [v for v in first if len(v) == len(first[0])]
    width = len(first[0]) // params.parts if first else 0
    if first and len(first[0]) % params.parts:
        raise ValueError(f"vectors of {len(first[0])} components can't be cut into {params.parts} equal parts")
    return np.array(first, np.int64).reshape(len(first), params.parts, width).transpose(1, 0, 2)


def trees(rows: DataFrame, length: int, params: CodeParams = CodeParams()) -> DataFrame:
    """The written table of slices with their trees; vectors of another length than ``length`` are left out."""
    size = max(1, params.slice_values // max(1, length))
    limit = int(((1 << 63) - 1) / max(1, length)) ** 0.5 / 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            vectors = np.concatenate(values)
            if len(vectors) and max(-int(vectors.min()), int(vectors.max())) >= limit:
                raise ValueError("components are so large that distances don't fit into 64 bits")
            points = vectors.reshape(len(vectors), params.parts, -1).transpose(1, 0, 2).reshape(params.parts * len(vectors), -1)
            forest = grow(np.ascontiguousarray(points), params.parts, params.leaf)
            row = {
                "vec_ids": pa.array([pa.concat_arrays(ids)], pa.list_(pa.int64())),
                "labels": pa.array([pa.concat_arrays(labels)], pa.list_(labels[0].type)),
                "points": pa.array([points.astype("<i4").tobytes()], pa.binary()),
                "places": pa.array([forest.order.astype("<i4").tobytes()], pa.binary()),
                "nodes": pa.array([forest.nodes.astype("<i8").tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            at = 0
            while at < len(batch):
                piece = batch.slice(at, size - held)
                ids.append(piece.column("vec_id"))
                labels.append(piece.column("label"))
                values.append(piece.column("components").flatten().to_numpy(zero_copy_only=False).reshape(len(piece), length))
                held, at = held + len(piece), at + len(piece)
                if held == size:
                    yield flush()
                    ids, labels, values, held = [], [], [], 0
        if held:
            yield flush()

    kind = rows.schema["label"].dataType.simpleString()
    fields = f"vec_ids ARRAY<BIGINT>, labels ARRAY<{kind}>, points BINARY, places BINARY, nodes BINARY"
    # Small row groups, as a reader holds one at a time.
    return stage(rows.where(F.size("components") == length).mapInArrow(cut, fields), "trees", **{"parquet.block.size": str(8 << 20)})


def _forests(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[int, Forest]]:
    for i in range(len(batch)):
        points, places, nodes = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("points", "<i4"), ("places", "<i4"), ("nodes", "<i8")))
        yield i, Forest(points.astype(np.int64).reshape(-1, width), parts, places.astype(np.int64), nodes.reshape(-1, NODE_FIELDS))


def one_round(forests: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after assigning all parts once: floors of the means; an entry without parts stays."""
    parts, entries, width = books.shape
    shared = forests.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for _, forest in _forests(batch, width, parts):
                total += sums(forest, shared.value)
        cell = np.flatnonzero(np.repeat(total[:, :, 0].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "total": pa.array(total.ravel()[cell])})

    each = forests.select("points", "places", "nodes").mapInArrow(add_up, "cell BIGINT, total BIGINT")
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for r in each.groupBy("cell").agg(F.sum("total").alias("total")).collect():  # as many rows as the codebooks have numbers
        total[r.cell] = r.total
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, params: CodeParams = CodeParams()) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every usable row of ``vectors``, and the codebooks (parts x entries x width).

    ``code`` has two hex digits per part; ``error`` is the squared distance in integers.  Rows whose vector is null, empty or
    holds a null or non-finite component are left out, as are vectors of another length than the first one's (by id).
    Repeated rows count as often as they occur; a null id comes last among the starting vectors.  With fewer vectors
    than entries the codebooks are as small; without any the result is empty.  Only ``vec_id, embedding, label`` are read.
    Components whose distances could pass 64 bits raise an error.
    """
    if params.entries > 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    rows = usable(vectors, params)
    books = first_books(rows, params)
    parts, _, width = books.shape
    if not books.size:
        return rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), books
    forests = trees(rows, parts * width, params)
    for _ in range(params.rounds):
        books = one_round(forests, books)
    shared = forests.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, forest in _forests(batch, width, parts):
                at, error = codes(forest, shared.value)
                text = at.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_ids")[i].values, "label": batch.column("labels")[i].values,
                    "code": pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)]), "error": pa.array(error),
                })

    kind = rows.schema["label"].dataType.simpleString()
    return forests.mapInArrow(encode, f"vec_id BIGINT, label {kind}, code STRING, error BIGINT"), books


def op11_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and the errors summed by label."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = stage(coded, "codes")
    # Null labels are equal to each other here, which a join's keys are not.
    coded = coded.withColumns({"unlabelled": F.col("label").isNull(), "named": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    by_label = coded.groupBy("unlabelled", "named").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return lookup(coded, by_label, ["unlabelled", "named"]).select(
        "vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256")
    )


ORACLE_SQL = """
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
    SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS r(p)
), book0 AS (
    SELECT p, rank AS e, x FROM (
        SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS rank FROM cut
    ) WHERE rank < 64
), near0 AS (
    SELECT c.vec_id, c.p, any_value(c.x) AS x,
           min(CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + b.e) AS m
    FROM cut c JOIN book0 b ON c.p = b.p GROUP BY c.vec_id, c.p
), book1 AS (
    SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book0 b LEFT JOIN (
        SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / k) AS BIGINT) ORDER BY place) AS x FROM (
            SELECT p, m % 64 AS e, place, sum(x[place]) AS s, count(*) AS k
            FROM near0, range(1, 1 + (SELECT max(len(x)) FROM near0)) AS r(place) GROUP BY ALL
        ) GROUP BY p, e
    ) n ON b.p = n.p AND b.e = n.e
), near1 AS (
    SELECT c.vec_id, c.p, any_value(c.x) AS x,
           min(CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + b.e) AS m
    FROM cut c JOIN book1 b ON c.p = b.p GROUP BY c.vec_id, c.p
), book2 AS (
    SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book1 b LEFT JOIN (
        SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / k) AS BIGINT) ORDER BY place) AS x FROM (
            SELECT p, m % 64 AS e, place, sum(x[place]) AS s, count(*) AS k
            FROM near1, range(1, 1 + (SELECT max(len(x)) FROM near1)) AS r(place) GROUP BY ALL
        ) GROUP BY p, e
    ) n ON b.p = n.p AND b.e = n.e
), near2 AS (
    SELECT c.vec_id, c.p, any_value(c.label) AS label,
           min(CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + b.e) AS m
    FROM cut c JOIN book2 b ON c.p = b.p GROUP BY c.vec_id, c.p
), coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code,
           CAST(sum(m // 64) AS BIGINT) AS error
    FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded
"""
