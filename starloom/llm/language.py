"""Language identification by the nearest of several centroids per language.

A text is the normalised TF-IDF vector of its hashed letter n-grams (one to three bytes of lower-cased words with their
borders).  Each language has a few centroids, found by spherical k-means over a bounded sample of its labelled texts; the
language of the centroid of highest cosine wins.  A text that is much further from every centroid than nearly all labelled
texts of like length is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.text import NOT_ALNUM, Texts, lower, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``sample`` bounds the labelled texts per language that the centroids are fitted on, ``languages`` the languages learned:
    those of most learnable texts, so that free-form labels do no harm."""

    dimensions: int = 2048
    centroids: int = 4
    sample: int = 400
    languages: int = 400
    # This share of a language's sample, the furthest from its mean, makes no centroid.
    outliers: float = 0.05
    # A text is rejected below ``slack`` times the cosine that all but ``tail`` of the learnable texts of like length reach.
    tail: float = 0.05
    slack: float = 0.45
    # Classes of a smaller share of the rows are judged together with shorter ones.
    least_class: float = 0.2
    cosine_bins: int = 1000
    length_classes: int = 8
    # Texts of the two shortest classes tell little: they are rejected only if they share next to nothing.
    short_classes: int = 2
    short_cosine: float = 0.02


@dataclass
class LanguageModel:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    weights: np.ndarray  # inverse document frequencies
    lowest: np.ndarray  # least accepted cosine by length class


def learnable() -> Column:
    """Rows that a model may learn from: the checksum of the id leaves a remainder, and there is a label."""
    return ~held_out() & F.col("lang").isNotNull()


def held_out() -> Column:
    """A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


# The bytes of words as they are, all others as one border.
_SYMBOL = np.where(NOT_ALNUM | (np.arange(256) < 128) & np.array([chr(i).isdigit() for i in range(256)]), 0, np.arange(256)).astype(np.uint32)


def counts(column: pa.Array, dimensions: int) -> np.ndarray:
    """Hashed n-gram counts, one row per text; texts without letters have zeros."""
    texts = Texts.of(lower(column))
    symbol, n = _SYMBOL[texts.data], len(texts)
    out = np.zeros(n * dimensions, np.float32)
    if not len(symbol):
        return out.reshape(n, dimensions)
    row = np.repeat(np.arange(n), np.diff(texts.offsets)) * dimensions
    # What stands before a text's first byte is a border.
    one = np.concatenate([np.zeros(1, np.uint32), symbol[:-1]])
    begins = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    one[begins] = 0
    two = np.concatenate([np.zeros(1, np.uint32), one[:-1]])
    two[begins] = 0
    for gram, used in (
        (symbol, symbol > 0), (one << 8 | symbol | 1 << 24, (symbol > 0) | (one > 0)),
        (two << 16 | one << 8 | symbol | 2 << 24, (one > 0) & ((symbol > 0) | (two > 0))),
    ):
        hashed = gram[used] * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        slot = (hashed * np.uint32(0x85EBCA77)) >> np.uint32(32 - (dimensions - 1).bit_length())
        out += np.bincount(row[used] + slot, minlength=n * dimensions)
    return out.reshape(n, dimensions)


def normalised(counted: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    vectors = np.log1p(counted)
    if weights is not None:
        vectors *= weights
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _letters(column: pa.Array) -> np.ndarray:
    """Number of letters of each text."""
    stripped = pc.replace_substring_regex(pc.fill_null(column, ""), r"[^\p{L}]+", "")
    return pc.utf8_length(stripped).to_numpy(zero_copy_only=False)


def length_class(grams: np.ndarray, classes: int) -> np.ndarray:
    """By octaves from 16 n-grams on."""
    return np.clip(np.log2(np.maximum(grams, 1)).astype(np.int64) - 3, 0, classes - 1)


def _by_rows(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """Pieces whose dense vectors stay small, however short the texts are."""
    most = max(1, (8 << 20) // (4 * dimensions))
    for piece in slices(batches, "text"):
        for at in range(0, piece.num_rows, most):
            yield piece.slice(at, most)


# Groups of tasks that rank a language's texts before they meet.
_RANKERS = 64


def learned_languages(docs: DataFrame, params: LanguageParams) -> list[str]:
    """The ``languages`` labels of most learnable texts, equally frequent ones by name."""
    rows = docs.where(learnable() & F.col("text").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"))
    return sorted(r.lang for r in rows.orderBy(F.desc("n"), "lang").limit(params.languages).collect())


def sample_of(docs: DataFrame, params: LanguageParams, names: list[str] | None = None) -> DataFrame:
    """Up to ``sample`` texts of each learned language, those of lowest hash; equal texts count once."""
    names = learned_languages(docs, params) if names is None else names
    wanted = docs.where(learnable() & F.col("text").isNotNull() & F.col("lang").isin(names))
    rows = wanted.select("lang", F.xxhash64("text").alias("pick"))
    # Each task sends its lowest hashes of a language only, and groups of tasks thin them out before the last ranking: that
    # one gets at most ``sample`` rows of every group, however many tasks there are.
    group = F.pmod(F.spark_partition_id(), F.lit(_RANKERS)).alias("group")
    picks = rows.distinct().select("lang", "pick", group)
    for by in (["lang", "group"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("pick"))
        picks = picks.withColumn("rank", rank).where(F.col("rank") <= params.sample).drop("rank")
    texts = wanted.select("lang", F.xxhash64("text").alias("pick"), "text")
    return texts.join(F.broadcast(picks.drop("group")), ["lang", "pick"]).dropDuplicates(["lang", "pick"]).select("lang", "text")


def _clusters(vectors: np.ndarray, k: int, outliers: float) -> np.ndarray:
    """Spherical k-means, started from mutually distant vectors; empty clusters vanish.

    Distant starts would be outliers, so the share ``outliers`` of vectors that lie furthest from the mean takes no part:
    mislabelled and junk texts must not get a centroid of their own.
    """
    near = vectors @ vectors.sum(axis=0)
    vectors = vectors[near >= np.quantile(near, outliers)]
    chosen = [int(np.argmax(vectors @ vectors.sum(axis=0)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(12):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = [vectors[own == i].sum(axis=0) for i in range(len(centroids)) if (own == i).any()]
        centroids = np.array([x / max(np.linalg.norm(x), 1e-9) for x in sums], np.float32)
    return centroids


def threshold(bins: np.ndarray, params: LanguageParams) -> np.ndarray:
    """Least accepted cosine by length class, out of the histograms of cosines of the learnable rows (class x bin).

    A small class might hold outliers only, so it is judged together with as many shorter ones as make up the share
    ``least_class`` of all rows, or with all of them; without any row it takes the threshold of the next longer class.
    Outliers of up to ``tail * least_class`` of all rows thus change no threshold that rests on such a share.
    """
    least = params.least_class * bins.sum()
    low = np.full(params.length_classes, np.nan)
    for c in range(params.length_classes):
        sizes = np.cumsum(bins[c::-1].sum(axis=1))
        pooled = bins[c - min(int(np.searchsorted(sizes, least)), c) : c + 1].sum(axis=0)
        if pooled.any():
            # The lower end of the bin in which the tail ends, so a few outliers move nothing, however many rows there are.
            low[c] = np.argmax(np.cumsum(pooled) > params.tail * pooled.sum()) / params.cosine_bins
    if np.isnan(low).all():
        return np.ones(params.length_classes)
    # Shorter texts are never nearer to rejection than longer ones.
    low = np.fmin.accumulate(low[::-1])[::-1] * params.slack
    low[: params.short_classes] = params.short_cosine
    return low


def _cosines(
    learned: DataFrame, names: list[str], of: np.ndarray, middles: np.ndarray, weights: np.ndarray, params: LanguageParams
) -> np.ndarray:
    """By length class, a histogram of the cosines of all learnable rows to the nearest centroid of their own language."""
    place = {name: i for i, name in enumerate(names)}
    shape = (params.length_classes, params.cosine_bins)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for piece in _by_rows(batches, params.dimensions):
            counted = counts(piece.column("text"), params.dimensions)
            own = np.array([place.get(x, -1) for x in piece.column("lang").to_pylist()], np.int64)
            used = counted.any(axis=1) & (own >= 0)
            if used.any():
                counted, own = counted[used], own[used]
                cosine = np.where(of == own[:, None], normalised(counted, weights) @ middles.T, 0.0).max(axis=1)
                at = np.clip((cosine * params.cosine_bins).astype(np.int64), 0, params.cosine_bins - 1)
                np.add.at(total, (length_class(counted.sum(axis=1), params.length_classes), at), 1)
        cls, at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"class": pa.array(cls), "bin": pa.array(at), "n": pa.array(total[cls, at])})

    each = learned.mapInArrow(count, "class BIGINT, bin BIGINT, n BIGINT").groupBy("class", "bin").agg(F.sum("n").alias("n"))
    out = np.zeros(shape)
    for r in each.collect():  # one row per length class and bin
        out[r["class"], r.bin] = r.n
    return out


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the learnable rows.  No such row gives a model without languages.

    Rows of a label that is not among the ``languages`` most frequent ones count in the document frequencies only.
    """
    dims = params.dimensions

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(dims, np.int64)
        for piece in _by_rows(batches, dims):
            counted = counts(piece.column("text"), dims)
            n += len(counted)
            seen += (counted > 0).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "seen": pa.array([seen], pa.list_(pa.int64()))})

    learnt = learned_languages(docs, params)
    sample = sample_of(docs, params, learnt).persist()
    learned = docs.where(learnable() & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    try:
        # Document frequencies of all learnable rows, not of the sample.
        partial = learned.select("text").mapInArrow(frequencies, "n BIGINT, seen ARRAY<BIGINT>")
        each = partial.select("n", F.posexplode("seen").alias("slot", "seen")).groupBy("slot").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
        found = each.collect()
        seen = np.zeros(dims)
        for r in found:
            seen[r.slot] = r.seen
        total = found[0].n if found else 0
        weights = np.log((1 + total) / (1 + seen)).astype(np.float32) + np.float32(0.05)

        def centroids(group: pd.DataFrame) -> pd.DataFrame:
            counted = counts(pa.array(group["text"], pa.large_string()), dims)
            counted = counted[counted.any(axis=1)]
            if not len(counted):
                return pd.DataFrame({"lang": [], "centroid": []})
            vectors = normalised(counted, weights)
            middles = _clusters(vectors, params.centroids, params.outliers)
            return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": list(middles)})

        rows = sample.groupBy("lang").applyInPandas(centroids, "lang STRING, centroid ARRAY<FLOAT>")
        rows = sorted(rows.collect(), key=lambda r: (r.lang, tuple(r.centroid)))
    finally:
        sample.unpersist()
    names = sorted({r.lang for r in rows})
    of = np.array([names.index(r.lang) for r in rows], np.int64)
    middles = np.array([r.centroid for r in rows], np.float32).reshape(len(rows), dims)
    bins = _cosines(learned, names, of, middles, weights, params) if rows else np.zeros((params.length_classes, params.cosine_bins))
    return LanguageModel(names, of, middles, weights, threshold(bins, params))


def _predict(model: LanguageModel, column: pa.Array, params: LanguageParams):
    """Language, cosine and rejection of each text."""
    counted = counts(column, params.dimensions)
    names = np.full(len(counted), UNKNOWN, object)
    score, rejected = np.zeros(len(counted)), np.ones(len(counted), bool)
    letters = _letters(column) > 0
    if len(model.of):
        cosine = normalised(counted, model.weights) @ model.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.where(letters, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0), 0.0).astype(np.float64)
        names = np.where(letters, np.array(model.languages, object)[model.of[best]], UNKNOWN)
        rejected = ~letters | (score < model.lowest[length_class(counted.sum(axis=1), params.length_classes)])
    return names, score, rejected


def predict(docs: DataFrame, model: LanguageModel, params: LanguageParams = LanguageParams()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, one row per row of ``docs``.

    ``score`` is the cosine to the nearest centroid.  ``lang_pred`` is ``und`` with score 0 for a null text, one without
    letters, or a model without languages; these are rejected, as are texts that lie too far from every centroid.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _by_rows(batches, params.dimensions):
            names, score, rejected = _predict(shared.value, piece.column("text"), params)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(label, "doc_id BIGINT, held_out BOOLEAN, lang_pred STRING, score DOUBLE, rejected BOOLEAN")


def accepted(docs: DataFrame, model: LanguageModel, params: LanguageParams = LanguageParams()) -> DataFrame:
    """The documents that are not rejected, all columns as they are.  Null texts, texts without letters and, with a model that
    has learned nothing, all texts are rejected; of rows with equal text all stay or go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _by_rows(batches, params.dimensions):
            yield piece.filter(pa.array(~_predict(shared.value, piece.column("text"), params)[2]))

    return docs.mapInArrow(keep, docs.schema)


def op3_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the learnable rows of ``documents`` and predict all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
