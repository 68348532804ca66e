"""Batches of like-sized documents: length buckets of least padding, filled up to a token budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm import bpe
from starloom.llm.text import Texts, slices
from starloom.session import stage


@dataclass(frozen=True)
class PackingParams:
    """``budget`` bounds the padded tokens of a batch, but for a single longer document."""

    buckets: int = 16
    budget: int = 65_536
    # Bucket ends are taken from the lengths up to this one and from this many places per octave beyond.
    fine: int = 256


def length_bin(length: Column, fine: int) -> Column:
    """The histogram's bin: every length of its own up to ``fine``, then ``fine`` bins per octave.

    So there are at most 64 * ``fine`` bins, whatever the lengths; bins are ordered as lengths are.
    """
    octave = F.floor(F.log2(length / F.lit(float(fine)))).cast("int")
    step = F.floor((length.cast("double") / F.pow(F.lit(2.0), octave) - fine)).cast("int")
    return F.when(length < fine, length.cast("int")).otherwise(fine * (octave + 1) + step)


def best_ends(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Indexes of the bucket ends of least padding.

    ``lengths`` ascend; each document of a bucket is padded to the bucket's last length.  Dynamic programming over the
    number of buckets and the end of the last one; among equal sums the shorter ends win.
    """
    n = len(lengths)
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choices = []
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        for j in range(1, n + 1):
            padded = cost[:j] + (before[j] - before[:j]) * float(lengths[j - 1])
            choice[j] = int(np.argmin(padded))
            new[j] = padded[choice[j]]
        cost = new
        choices.append(choice)
    ends, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        ends.append(j - 1)
        j = int(choice[j])
    return ends[::-1]


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A written table ``doc_id, n_tokens, part, place``: the ids of each text and one end id; a null text is empty."""
    vocabulary = vocabulary or bpe.vocabulary_path(bpe.RANKS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, cache = TaskContext.get().partitionId(), 0, bpe.cache(vocabulary)
        for piece in slices(batches, "text"):
            count = cache.count(Texts.of(piece.column("text"))) + 1
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(count), pa.array(np.full(len(count), part, np.int32)), pa.array(done + np.arange(len(count)))],
                ["doc_id", "n_tokens", "part", "place"],
            )
            done += len(count)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(measure, "doc_id BIGINT, n_tokens BIGINT, part INT, place BIGINT"), "lengths")


def packed(lengths: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_len, batch, slot, padding`` of rows ``doc_id, n_tokens, part, place``.

    Every row gets a place: batches of a bucket are numbered and filled in the order of part and place, so all but the
    last of a bucket are full.  Ranks come from counts per part, so no bucket meets in one task.  No rows give none.
    """
    spark = lengths.sparkSession
    binned = lengths.withColumn("bin", length_bin(F.col("n_tokens"), params.fine))
    histogram = binned.groupBy("bin").agg(F.max("n_tokens").alias("length"), F.count("*").alias("rows")).orderBy("bin").collect()
    ends = best_ends(np.array([r.length for r in histogram]), np.array([r["rows"] for r in histogram]), params.buckets)
    table, bucket = [], 0
    for i, r in enumerate(histogram):
        bucket += i > ends[bucket]
        table.append((r.bin, bucket, histogram[ends[bucket]].length))
    of_bin = spark.createDataFrame(table, "bin INT, bucket INT, bucket_len BIGINT")
    placed = binned.join(F.broadcast(of_bin), "bin")
    counts = placed.groupBy("bucket", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("place")) - 1
    ranked = placed.withColumn("local", local).join(starts, ["bucket", "part"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(params.budget) / F.col("bucket_len")))
    index = F.col("before") + F.col("local")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(index / capacity).alias("batch"),
        (index % capacity).cast("bigint").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, params: PackingParams = PackingParams(), vocabulary: str | None = None) -> DataFrame:
    """Bucket, batch and slot of every document; see :func:`packed`.  Only ``doc_id`` and ``text`` are read."""
    return packed(token_lengths(docs, vocabulary), params)


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
