"""Token ids in fixed-width files: each id takes the bits that the vocabulary needs.

A table of files is a Parquet folder; a row is a block: the documents' ids and token counts, the tokens before the block
in its part, and the packed ids.  Blocks follow each other in ascending document order, parts too.  The container gives
atomic writes and any store that Spark reads; the payload is the packed format itself and is read with numpy only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm import bpe
from starloom.llm.text import SLICE_BYTES, Texts, slices
from starloom.session import fresh_path

BLOCK_SCHEMA = (
    "part INT, block INT, bits INT, start_in_part BIGINT, doc_ids ARRAY<BIGINT>, counts ARRAY<BIGINT>, payload BINARY"
)
DOC_SCHEMA = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, part INT, block INT"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian: id ``i`` takes the bits ``i * bits`` and following, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shifts = np.arange(bits, dtype=np.uint32)
    table = ((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8)
    return np.packbits(table.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; only the bytes that hold them are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, (((start + count) * bits) + 7) // 8
    bit = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    bit = bit[start * bits - low * 8 :][: count * bits].reshape(count, bits)
    return (bit.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, block_bytes: int = SLICE_BYTES,
    parts: int | None = None,
) -> None:
    """Encode ``text`` of all documents, in ascending ``doc_id`` order, to token files at ``path``.

    A null text is an empty one (its end id remains); a null ``doc_id`` comes first; equal ids are ordered by text.
    Other columns are not read.  ``block_bytes`` bounds the text of a block, but for a single longer text.
    """
    vocabulary = vocabulary or bpe.vocabulary_path()
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bits = bits_for(bpe.vocabulary_size(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before, cache = TaskContext.get().partitionId(), 0, 0, bpe.cache(vocabulary)
        for piece in slices(batches, "text", block_bytes):
            ids, first = cache.encode(Texts.of(piece.column("text")))
            n = len(first) - 1
            counts = np.diff(first)
            whole = np.insert(ids, first[1:], end_id)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                    "bits": pa.array([bits], pa.int32()), "start_in_part": pa.array([before], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), piece.column("doc_id").cast(pa.int64())),
                    "counts": pa.array([counts + 1], pa.list_(pa.int64())),
                    "payload": pa.array([pack(whole, bits)], pa.binary()),
                }
            )
            block, before = block + 1, before + len(whole)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The second key divides an id that very many rows share.
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``: the tokens of all blocks before.  The parts' totals are one row per part, so a broadcast."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("part").alias("of_part"), before.alias("part_start"))
    joined = blocks.join(F.broadcast(starts), F.col("part") == F.col("of_part"))
    return joined.withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("of_part", "part_start")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: first token, number of tokens and checksum of its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.asarray(row["counts"], np.int64)
                upto = np.cumsum(counts)
                ids = unpack(row["payload"], row["bits"], 0, int(upto[-1])).astype("<u4").tobytes()
                begins = upto - counts
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), upto.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(begins + row["start"]),
                        "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64()),
                        "part": pa.array([row["part"]] * n, pa.int32()), "block": pa.array([row["block"]] * n, pa.int32()),
                    }
                )

    return read_blocks(spark, path).mapInArrow(decode, DOC_SCHEMA)


def read_tokens(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """Random access: the ids ``start`` to ``start + count`` of the whole corpus, one row per touched block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = max(0, start - row["start"])
                high = min(sum(row["counts"]), start + count - row["start"])
                ids = unpack(row["payload"], row["bits"], low, high - low)
                yield pa.RecordBatch.from_pydict(
                    {"start": pa.array([row["start"] + low]), "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))}
                )

    tokens = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    touched = read_blocks(spark, path).where((F.col("start") < start + count) & (F.col("start") + tokens > start))
    return touched.mapInArrow(cut, "start BIGINT, ids ARRAY<BIGINT>")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files in the shared folder and describe each from what is read back."""
    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
