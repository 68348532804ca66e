"""Benchmark items found inside documents: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.text import normal_words, shingles, slices
from starloom.llm.windows import Blocks, ItemIndex, ShortItems, without_short

PAIR_SCHEMA = "doc_id BIGINT, item_id BIGINT, n_shared BIGINT, n_shingles BIGINT, containment DOUBLE"


@dataclass(frozen=True)
class ContainmentParams:
    """An item is found if a document has at least ``containment`` of its distinct shingles.

    An item of class c has over half of the class's largest size, a window twice that size, so at containment 0.8 their
    similarity is at least 0.19 and one of 48 functions agrees with probability 0.99996 or more.
    """

    width: int = 5
    containment: float = 0.8
    functions: int = 48
    # Items are looked up in sets of about this many bytes of text, each sent to all tasks; every set sees every document.
    set_bytes: int = 16 << 20


def item_sets(items: DataFrame, params: ContainmentParams) -> Iterator[tuple[list[int | None], list[str]]]:
    """The items with words in sets of bounded size, by a hash of their text."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = 1 + 2 * size // params.set_bytes if size else 0
    for k in range(sets):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k).collect()
        if part:
            yield [r.item_id for r in part], [r.text for r in part]


def _indexed(docs: DataFrame, ids: list[int | None], texts: list[str], params: ContainmentParams):
    """The set's index, on all executors."""
    words, at = normal_words(pa.array(texts, pa.large_string()))
    index = ItemIndex.of(*without_short(words, at, params.width), params.functions)
    return docs.sparkSession.sparkContext.broadcast((ids, index, ShortItems.of(words, at, params.width)))


def _found(
    items: ItemIndex, short: ShortItems, texts: pa.Array, params: ContainmentParams
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, number of shared shingles and of the item's shingles for every item found."""
    words, at = normal_words(texts)
    prints, first = shingles(words, at, params.width)
    doc, item = items.candidates(Blocks.of(prints, first, params.functions))
    shared, sizes = items.contained(doc, item, prints, first), np.diff(items.first)[item]
    found = shared >= np.ceil(params.containment * sizes - 1e-9)
    more_doc, more = short.inside(words, at)
    one = np.ones(len(more), np.int64)
    parts = (doc[found], more_doc), (item[found], more), (shared[found], one), (sizes[found], one)
    return tuple(np.concatenate(p) for p in parts)


def _search(docs: DataFrame, ids: list[int | None], texts: list[str], params: ContainmentParams) -> DataFrame:
    index = _indexed(docs, ids, texts, params)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, short = index.value
        for piece in slices(batches, "text"):
            doc, item, shared, sizes = _found(items, short, piece.column("text"), params)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": piece.column("doc_id").take(pa.array(doc)), "item_id": pa.array([names[i] for i in item], pa.int64()),
                    "n_shared": pa.array(shared), "n_shingles": pa.array(sizes), "containment": pa.array(shared / sizes),
                }
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, PAIR_SCHEMA)


def contained_items(docs: DataFrame, items: DataFrame, params: ContainmentParams = ContainmentParams()) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment``: one row per row of ``docs`` and item found in it.

    Words are lower-cased runs of letters and digits.  Items of one to four words are one shingle of that
    length, found wherever these words stand in a row; items and documents without words, or null, are never found.  Repeated rows of either
    side give repeated pairs; a null id stays null.  No items or no documents give an empty table.
    """
    found = [_search(docs, ids, texts, params) for ids, texts in item_sets(items, params)]
    if not found:
        return docs.sparkSession.createDataFrame([], PAIR_SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_items(docs: DataFrame, items: DataFrame, params: ContainmentParams = ContainmentParams()) -> DataFrame:
    """The documents in which no item is found, all columns as they are; null texts stay.  Nothing is shuffled."""

    def dropping(index):
        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, items, short = index.value
            for piece in slices(batches, "text"):
                keep = np.ones(piece.num_rows, bool)
                keep[_found(items, short, piece.column("text"), params)[0]] = False
                yield piece.filter(pa.array(keep))

        return drop

    for ids, texts in item_sets(items, params):
        docs = docs.mapInArrow(dropping(_indexed(docs, ids, texts, params)), docs.schema)
    return docs


def op4_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items found in any document."""
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
