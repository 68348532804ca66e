"""Document quality: simple counts, and how much more likely a text is under trusted documents than under the corpus.

Words and word pairs fall into hashed buckets.  Two multinomials over the buckets are counted, one over trusted
documents and one over all; a text's score is the mean log-likelihood ratio of its n-grams.  The least accepted score
follows from the scores of all trusted documents, and every document is held against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.text import WHITE, Texts, over_slices, shingles, slices
from starloom.session import stage

NEWLINE = np.arange(256) == 10
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class QualityParams:
    bucket_bits: int = 13
    least_words: int = 10
    most_repeated_percent: int = 20
    # The least score: as far below the lowest ``low_share`` of the trusted scores as half of the way to their median.
    low_share: float = 0.001
    margin: float = 0.5
    # Scores are counted in steps of this width to find those two places.
    step: float = 0.0005


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words, and the first word of each text (and a last)."""
    starts, ends, first = texts.spans(WHITE)
    return texts.fingerprints(starts, ends), first


def _buckets(words: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of all words and word pairs."""
    pairs, pair_first = shingles(words, first, 2)
    rows = np.arange(len(first) - 1)
    row = np.concatenate([np.repeat(rows, np.diff(first)), np.repeat(rows, np.diff(pair_first))])
    return row, (np.concatenate([words, pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def _of_texts(mask: np.ndarray, texts: Texts) -> np.ndarray:
    """How many bytes of each text are marked."""
    upto = np.concatenate([[0], np.cumsum(mask)])
    return np.diff(upto[texts.offsets])


def base_counts(texts: Texts, words: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the contract, one per text."""
    n, data = len(texts), texts.data
    white = WHITE[data]
    begins_point = (data & 0xC0) != 0x80
    # Lines with a word that occurred before in the text.
    starts, ends, line_first = texts.spans(NEWLINE)
    visible = np.concatenate([[0], np.cumsum(~white)])
    used = visible[ends] > visible[starts]
    row = np.repeat(np.arange(n), np.diff(line_first))[used]
    prints = texts.fingerprints(starts[used], ends[used])
    order = np.lexsort((prints, row))
    same = (row[order][1:] == row[order][:-1]) & (prints[order][1:] == prints[order][:-1])
    repeated_lines = np.bincount(row[order][1:][same], minlength=n)
    # Words inside a run of five words that the text has more than once.
    runs, run_first = shingles(words, first, 5)
    run_row = np.repeat(np.arange(n), np.diff(run_first))
    order = np.lexsort((runs, run_row))
    equal = (run_row[order][1:] == run_row[order][:-1]) & (runs[order][1:] == runs[order][:-1])
    twice = np.zeros(len(runs), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.flatnonzero(twice)
    word = first[run_row[at]] + at - run_first[run_row[at]]
    change = np.zeros(len(words) + 6, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change)[: len(words)] > 0)])
    return {
        "n_words": np.diff(first), "word_chars": _of_texts(begins_point & ~white, texts), "n_symbols": _of_texts(SYMBOL[data], texts),
        "n_dup_lines": repeated_lines, "n_repeat_words": np.diff(covered[first]),
    }


def ngram_weights(docs: DataFrame, trusted: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray:
    """The log-likelihood ratio of each bucket, counted over all documents.

    ``trusted`` has the distinct ``doc_id`` of trusted documents.  Without trusted words all ratios are zero.
    """
    size = 1 << params.bucket_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for piece in slices(batches, "text"):
            words, first = words_of(Texts.of(piece.column("text")))
            row, bucket = _buckets(words, first, params.bucket_bits)
            good = piece.column("trusted").to_numpy(zero_copy_only=False)
            total[0] += np.bincount(bucket, minlength=size)
            total[1] += np.bincount(bucket[good[row]], minlength=size)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "raw": pa.array(total[0][at]), "good": pa.array(total[1][at])})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Labels grow with the documents, so they are never sent to all tasks; the plan is the same at all sizes.
    mark = trusted.select(F.col("doc_id").alias("_starloom_id"), F.lit(True).alias("trusted")).hint("merge")
    marked = rows.join(mark, F.col("doc_id") == F.col("_starloom_id"), "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    each = marked.mapInArrow(count, "bucket BIGINT, raw BIGINT, good BIGINT")
    raw, good = np.zeros(size), np.zeros(size)
    for r in each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    if not good.sum():
        return np.zeros(size)
    return np.log((good + 1) / (good.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))


def _measured(docs: DataFrame, weights: np.ndarray, params: QualityParams) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def measure(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(piece.column("text"))
        words, first = words_of(texts)
        counted = base_counts(texts, words, first)
        row, bucket = _buckets(words, first, params.bucket_bits)
        grams = np.bincount(row, minlength=len(texts))
        score = np.bincount(row, shared.value[bucket], len(texts)) / np.maximum(grams, 1)
        failed = (counted["n_words"] < params.least_words) | (
            100 * counted["n_repeat_words"] > params.most_repeated_percent * counted["n_words"]
        )
        columns = {"doc_id": piece.column("doc_id")} | {k: pa.array(v.astype(np.int64)) for k, v in counted.items()}
        columns |= {"base_failed": pa.array(failed), "score": pa.array(score, mask=grams == 0)}
        return pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        over_slices(measure),
        "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, "
        "base_failed BOOLEAN, score DOUBLE",
    )


def least_score(scored: DataFrame, params: QualityParams = QualityParams()) -> float:
    """The threshold from the ``score`` of all trusted documents; minus infinity without any."""
    step = F.floor(F.col("score") / F.lit(params.step)).alias("step")
    rows = scored.where("score IS NOT NULL AND NOT base_failed").groupBy(step).agg(F.count("*").alias("n")).collect()
    if not rows:
        return -np.inf
    # Log ratios of counts lie within +-50, so there are at most 100 / step rows.
    rows = sorted((r["step"], r["n"]) for r in rows)
    upto = np.cumsum([n for _, n in rows])
    low, middle = (rows[int(np.searchsorted(upto, share * upto[-1]))][0] * params.step for share in (params.low_share, 0.5))
    return low - params.margin * (middle - low)


def quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score``, ``kept``: one row per row of ``docs``.

    Documents with a label of ``quality`` 1 are trusted; repeated labels count once, a null id is never trusted.  A null
    text has no words; a text without words fails with a null score.  Without trusted documents all scores are zero and
    only the counts decide.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    scored = stage(_measured(docs, ngram_weights(docs, trusted, params), params), "quality")
    least = least_score(scored.join(trusted, "doc_id", "left_semi"), params)
    passed = F.coalesce(F.col("score") >= F.lit(float(least)), F.lit(False))
    return scored.withColumn("kept", ~F.col("base_failed") & passed)


def op2_ngram_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, trusting the labelled good ones."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return quality(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
