"""Near-duplicate documents by DartMinHash signatures of their weighted shingles.

A document is the multiset of its five-word shingles.  Every shingle owns the same random darts in every document: a
dart has a weight, a rank and a coordinate, and hits a document in which the shingle weighs more than the dart's weight.
A signature keeps the hit of lowest rank per coordinate; two signatures agree in a coordinate with the probability of
the weighted Jaccard similarity.  Darts are thrown by dyadic regions of weight and rank, so that a document looks at a
number of darts that depends on the coordinates only, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.graph import components
from starloom.llm.text import mix, normal_shingles, over_slices, slices
from starloom.session import stage

_U = np.uint64
_STEP = _U(0xA24BAED4963EE407)
FIRST_RANK = 0.125


@dataclass(frozen=True)
class NearParams:
    """At 20 bands of 5 a pair of similarity 0.8 shares a band with probability 0.9996."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    # Expected hits per document: coordinates * (ln coordinates + surplus); empty coordinates get more darts.
    surplus: float = 2.0

    # A sketch has four bits for each of so many bins.  Texts are compared if the share of equal bins is not further
    # below that of the wanted similarity than these deviations; a long pair just at it is left out 3 times in a million.
    bins: int = 512
    deviations: float = 4.5
    # Members of a bucket that all others are compared with, in each of so many rounds.
    hubs: int = 4
    rounds: int = 1

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        return self.bins // 16

    @property
    def most_different(self) -> float:
        """The largest plausible share of used bins that differ."""
        least = self.similarity - self.deviations * (self.similarity * (1 - self.similarity) / self.bins) ** 0.5
        return (1 - least) * 14 / 15


@lru_cache(maxsize=256)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a region."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    logs = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.cumsum(np.exp(k * np.log(mean) - mean - logs))


def weighted(fingerprints: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts: document, fingerprint, weight."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((fingerprints, doc)) if len(first) > 8193 else np.argsort(
        (doc.astype(_U) << _U(51)) | (fingerprints >> _U(13))
    )
    doc, fingerprints = doc[order], fingerprints[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (fingerprints[1:] != fingerprints[:-1])
    at = np.flatnonzero(new)
    return doc[at], fingerprints[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def _throw(
    doc: np.ndarray, element: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, coordinates: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hits with ranks from ``low`` to ``high`` of their document: slot (document and coordinate), rank and dart."""
    if not len(doc):
        return
    top = float(high.max())
    heaviest = float(weight.max())
    least, most, level = 0.0, 1.0, 0
    while least < heaviest:
        heavy = np.flatnonzero(weight > least) if least else np.arange(len(doc))
        start, stop, band = 0.0, FIRST_RANK, 0
        while start < top:
            d = doc[heavy]
            at = heavy[(high[d] > start) & (low[d] < stop)]
            if len(at):
                region = mix(np.array([level * 1024 + band + 1], _U))[0]
                seed = mix(element[at] ^ region)
                count = np.searchsorted(_poisson((most - least) * (stop - start)), (seed >> _U(11)) * 2.0**-53, "right")
                of = np.repeat(at, count)
                number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + 1
                dart = mix(np.repeat(seed, count) + number.astype(_U) * _STEP)
                rank = start + (stop - start) * ((dart >> _U(14)) & _U((1 << 30) - 1)) * 2.0**-30
                d = doc[of]
                keep = (rank < high[d]) & (rank >= low[d])
                if least or most > 1.0 or heaviest < 1.0:
                    keep &= least + (most - least) * (dart >> _U(44)) * 2.0**-20 < weight[of]
                dart = dart[keep]
                yield d[keep] * coordinates + ((dart & _U(0x3FFF)) % _U(coordinates)).astype(np.int64), rank[keep], dart
            start, stop, band = stop, stop * 2.0, band + 1
        least, most, level = most, most * 2.0, level + 1


def signatures(fingerprints: np.ndarray, first: np.ndarray, params: NearParams = NearParams()) -> np.ndarray:
    """One row of darts per document; rows of documents without shingles are zero."""
    k, n = params.coordinates, len(first) - 1
    doc, element, weight = weighted(fingerprints, first)
    out = np.zeros(n * k, _U)
    best = np.full(n * k, np.inf)
    total = np.bincount(doc, weight, n)
    low = np.zeros(n)
    high = np.zeros(n)
    filled = total > 0
    high[filled] = k * (np.log(k) + params.surplus) / total[filled]
    while len(doc):
        thrown = list(_throw(doc, element, weight, low, high, k))
        for slot, rank, _ in thrown:
            np.minimum.at(best, slot, rank)
        for slot, rank, dart in thrown:
            won = rank == best[slot]
            out[slot[won]] = dart[won]
        open_ = np.isinf(best.reshape(n, k)).any(axis=1) & filled
        again = open_[doc]
        doc, element, weight = doc[again], element[again], weight[again]
        # Coordinates already filled keep their lower rank.
        low, high = high, high * 2.0
    return out.reshape(n, k)


def band_keys(signature: np.ndarray, params: NearParams) -> np.ndarray:
    rows = signature.reshape(len(signature), params.bands, params.rows)
    keys = np.zeros(rows.shape[:2], _U)
    for j in range(params.rows):
        keys = mix(keys + rows[:, :, j] + _U(j))
    return mix(keys + np.arange(params.bands, dtype=_U)).view(np.int64)


def sketches(fingerprints: np.ndarray, first: np.ndarray, params: NearParams) -> np.ndarray:
    """One-permutation sketches: every copy of a shingle falls into a bin, and each bin keeps four bits of its least.

    The copies 1, 2 ... of a shingle are different elements, so that their Jaccard similarity is the weighted one.
    Short texts have nearly all their elements in a sketch, so it tells their similarity almost exactly.
    """
    n = len(first) - 1
    doc, element, weight = weighted(fingerprints, first)
    weight = weight.astype(np.int64)
    copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    value = mix(np.repeat(element, weight) + copy.astype(_U) * _STEP)
    slot = np.repeat(doc, weight) * params.bins + (value % _U(params.bins)).astype(np.int64)
    least = np.full(n * params.bins, np.iinfo(np.uint64).max, _U)
    np.minimum.at(least, slot, value)
    nibbles = np.where(least == np.iinfo(np.uint64).max, _U(0), mix(least) % _U(15) + _U(1))
    words = nibbles.reshape(n, params.words, 16) << (_U(4) * np.arange(16, dtype=_U))
    return np.bitwise_or.reduce(words, axis=2).view(np.int64)


def _nibbles(x: Column) -> Column:
    """How many of a word's groups of four bits are not zero."""
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _plausible(left: str, right: str, params: NearParams) -> Column:
    """Whether two sketches, in columns ``<left>_0`` and so on, allow for the wanted similarity."""
    pairs = [(F.col(f"{left}_{i}"), F.col(f"{right}_{i}")) for i in range(params.words)]
    different = sum((_nibbles(a.bitwiseXOR(b)) for a, b in pairs[1:]), _nibbles(pairs[0][0].bitwiseXOR(pairs[0][1])))
    used = sum((_nibbles(a.bitwiseOR(b)) for a, b in pairs[1:]), _nibbles(pairs[0][0].bitwiseOR(pairs[0][1])))
    return different <= used * F.lit(params.most_different)


def similarities(left: pa.Array, right: pa.Array, width: int) -> np.ndarray:
    """The exact weighted Jaccard similarity of the texts in each row."""

    def keyed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        prints, first = normal_shingles(column, width)
        doc, element, weight = weighted(prints, first)
        return mix(element + doc.astype(_U) * _STEP), doc, weight, np.bincount(doc, weight, len(column))

    a, doc, a_weight, a_total = keyed(left)
    b, _, b_weight, b_total = keyed(right)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.bincount(doc[at_a], np.minimum(a_weight[at_a], b_weight[at_b]), len(left))
    union = a_total + b_total - shared
    return np.divide(shared, union, out=np.zeros(len(left)), where=union > 0)


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for the text; null for a null text."""
    return F.unhex(F.md5(F.col(text)))


def _signed(docs: DataFrame, params: NearParams) -> DataFrame:
    def sign(piece: pa.RecordBatch) -> pa.RecordBatch:
        prints, first = normal_shingles(piece.column("text"), params.width)
        signature = signatures(prints, first, params)
        keys, sketch = band_keys(signature, params), sketches(prints, first, params)
        used = np.diff(first) > 0
        offsets = np.concatenate([[0], np.cumsum(used * params.bands)]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[used].ravel()))
        ends = np.arange(len(used) + 1, dtype=np.int32) * params.words
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch.ravel()))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), bands, words], ["doc_id", "key", "bands", "sketch"])

    return docs.mapInArrow(over_slices(sign), "doc_id BIGINT, key BINARY, bands ARRAY<BIGINT>, sketch ARRAY<BIGINT>")


class _Buckets:
    """The nodes of all buckets with several members, with what is needed to compare them."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, params: NearParams):
        self.nodes, self.params = nodes, params
        buckets = nodes.select("node", F.explode("bands").alias("band"))
        shared = buckets.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
        self.members = stage(buckets.join(shared, "band"), "buckets")
        involved = self.members.select("node").distinct().join(nodes.select("node", "key"), "node")
        # Equal texts count once.
        texts = rows.select("key", "text").join(involved, "key").dropDuplicates(["node"])
        self.texts = stage(texts.select("node", "text"), "texts")

    def _sketched(self, some: DataFrame, node: str, bands: bool = False) -> DataFrame:
        """``some`` with the sketch of its column ``node``, and with the node's bands if asked for."""
        words = [F.get("sketch", F.lit(i)).alias(f"{node}_{i}") for i in range(self.params.words)]
        keys = [F.get("bands", F.lit(i)).alias(f"{node}_band_{i}") for i in range(self.params.bands)] if bands else []
        return some.join(self.nodes.select(F.col("node").alias(node), *keys, *words), node)

    def spokes(self, parted: DataFrame, seed: int) -> DataFrame:
        """Plausible pairs of each node and the hubs of its buckets, if they are not of one component.

        ``parted`` has ``band, node, component``.  A hub is the lowest node of its share of the bucket by hash.
        """
        share = F.pmod(F.xxhash64("band", "node", F.lit(seed)), F.lit(self.params.hubs))
        one = F.struct(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
        hubs = parted.withColumn("share", share).groupBy("band", "share").agg(F.min(one).alias("one")).select("band", "one.*")
        left, right = self._sketched(parted.select("band", "node", "component"), "node"), self._sketched(hubs, "hub")
        apart = F.col("component") != F.col("hub_component")
        pairs = left.join(right, (left.band == right.band) & apart & _plausible("node", "hub", self.params))
        return pairs.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()

    def crossing(self, parted: DataFrame) -> DataFrame:
        """All plausible pairs of a bucket's nodes of different components.  ``parted`` also has ``main``, the bucket's
        largest component, so that its many members are not paired among each other only to be dropped.

        A pair that shares several bands is made in the first of them only.
        """
        left = parted.where("component != main").select("band", F.col("node").alias("a"), F.col("component").alias("a_part"))
        right = parted.select("band", F.col("node").alias("b"), F.col("component").alias("b_part"), "main")
        left, right = self._sketched(left, "a", bands=True), self._sketched(right, "b", bands=True)
        apart = (F.col("a_part") != F.col("b_part")) & ((F.col("b_part") == F.col("main")) | (F.col("a") < F.col("b")))
        first = reduce(
            lambda later, i: F.when(F.col(f"a_band_{i}") == F.col(f"b_band_{i}"), F.col(f"a_band_{i}")).otherwise(later),
            reversed(range(self.params.bands)), F.lit(None).cast("bigint"),
        )
        made_here = first == left.band
        pairs = left.join(right, (left.band == right.band) & apart & made_here & _plausible("a", "b", self.params))
        return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose texts are similar enough, by exact comparison."""
        params = self.params

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, "u_text"):
                near = similarities(piece.column("u_text"), piece.column("v_text"), params.width) >= params.similarity
                yield piece.select(["u", "v"]).filter(pa.array(near))

        u = self.texts.select(F.col("node").alias("u"), F.col("text").alias("u_text"))
        v = self.texts.select(F.col("node").alias("v"), F.col("text").alias("v_text"))
        texts = pairs.join(u, "u").join(v, "v").select("u", "v", "u_text", "v_text")
        return stage(texts.mapInArrow(compare, "u BIGINT, v BIGINT"), "near-links")

    def open(self, joined: DataFrame) -> DataFrame:
        """``band, node, component, main`` of the buckets of several components."""
        wide = self.members.where(F.col("members") > 2).select("band", "node").join(joined, "node", "left")
        wide = wide.select("band", "node", F.coalesce("component", "node").alias("component"))
        sizes = wide.groupBy("band", "component").agg(F.count("*").alias("size"))
        split = sizes.groupBy("band").agg(
            F.count("*").alias("parts"), F.max_by("component", F.struct("size", "component")).alias("main")
        )
        return stage(wide.join(split.where("parts > 1").drop("parts"), "band"), "open-buckets")

    def joined(self) -> DataFrame:
        """``node, component`` of all nodes with a verified link."""
        parted = self.members.select("band", "node", F.col("node").alias("component"))
        done = links = None
        for number in range(self.params.rounds + 1):
            pairs = self.spokes(parted, number) if number < self.params.rounds else self.crossing(parted)
            pairs = stage(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "near-pairs")
            done = pairs if done is None else done.unionByName(pairs)
            if not pairs.isEmpty():
                found = self.verified(pairs)
                links = found if links is None else links.unionByName(found)
            joined = components(links if links is not None else pairs.limit(0))
            if number < self.params.rounds:
                parted = self.open(joined)
                if parted.isEmpty():
                    break
        return joined


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``doc_id, class_id, class_size, text_key, class_key``, one row per row of ``docs``.

    Rows are of one class if their texts are linked by pairs of equal or near-duplicate texts; ``class_id`` is the
    lowest ``doc_id`` of the class (nulls aside), ``class_size`` its number of rows,
    ``class_key`` its lowest text key.  Texts without words are duplicates of equal texts only.  A null text is of no
    class: nulls, and size 1.  Other columns are not read.

    Equal texts are one node.  In a bucket of a band every node is compared with a few hubs, and again with others where
    several components remain; then, in buckets that still have several, the nodes outside the largest component are
    compared with those of other components.  So all pairs that share a band are compared or already joined.  Sketches
    are compared first; texts are read, and compared exactly, for pairs whose sketches do not rule the similarity out.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("key")
    ).where("text IS NOT NULL")
    signed = _signed(rows, params)
    nodes = signed.groupBy("key").agg(
        F.min("doc_id").alias("lowest"), F.count("*").alias("copies"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    joined = _Buckets(rows, nodes, params).joined()
    part = nodes.join(joined, "node", "left").select(
        "key", "lowest", "copies", F.coalesce("component", "node").alias("component")
    )
    classes = part.groupBy("component").agg(F.min("lowest").alias("class_id"), F.sum("copies").alias("class_size"), F.min("key").alias("class_key"))
    of_text = part.join(classes, "component").select(F.col("key").alias("text_key"), "class_id", "class_size", "class_key")
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("string"))).alias("text_key"))
    out = every.join(of_text, "text_key", "left")
    size = F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size")
    return out.select("doc_id", "class_id", size, "text_key", "class_key")


def keep_one(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """The documents without near duplicates: of each class the row of lowest ``doc_id`` stays, all columns as they are.

    Nulls count as highest; among rows that share the lowest id, the lowest text key decides, and of rows equal in both
    any one stays.  Null texts all stay.
    """
    classes = stage(near_duplicates(docs, params), "classes")
    many = classes.where("class_size > 1")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    keepers = many.groupBy("class_key").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("keep_id"), F.col("best.text_key").alias("keep_key"))
    grouped = many.select("text_key").distinct()
    keyed = docs.withColumn("_starloom_key", F.unhex(F.md5(F.col("text").cast("string"))))
    # One pass over the texts: those of single classes pass, those of larger ones if they are the keeper.
    marks = grouped.join(keepers, grouped.text_key == keepers.keep_key, "left").select(
        F.col("text_key").alias("_starloom_mark"), F.col("keep_id").alias("_starloom_id"), F.col("keep_key").isNotNull().alias("_starloom_keeper")
    )
    marked = keyed.join(marks, F.col("_starloom_key") == F.col("_starloom_mark"), "left")
    same_id = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_starloom_id"))
    kept = marked.where(F.col("_starloom_mark").isNull() | (F.col("_starloom_keeper") & same_id))
    single = kept.where("_starloom_mark IS NULL").select(*docs.columns)
    chosen = kept.where("_starloom_mark IS NOT NULL").dropDuplicates(["_starloom_key"]).select(*docs.columns)
    return single.unionByName(chosen)


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "class_key")
