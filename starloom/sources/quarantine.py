"""Tolerant scans that keep what they leave out: one pass over the files, written once, read as two tables.

A line is either accepted, and read as :mod:`starloom.sources.files` and :mod:`~starloom.sources.profiles` read it, or rejected
with its text, its place and the reason.  Only the header of each CSV file is neither.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.schema import DEFAULT_COLUMNS, RatingColumns
from starloom.session import stage
from starloom.sources import files

TOO_FEW_FIELDS = "too few fields"
REPEATED_HEADER = "repeated header"
NOT_AN_OBJECT = "not an object"
BROKEN_JSON = "broken JSON"


@dataclass(frozen=True)
class Sifted:
    """``accepted`` as the plain reader gives it; ``rejected``: ``line, file, block, reason``."""

    accepted: DataFrame
    rejected: DataFrame


def _sift(tagged: DataFrame, label: str) -> Sifted:
    """``tagged`` has ``seq``, ``_line`` and ``_reason`` (NULL if accepted) among its columns."""
    table = stage(tagged, label)
    place = [F.col("_seq.file").alias("file"), F.col("_seq.block").alias("block")]
    return Sifted(
        table.where("_reason IS NULL").drop("_line", "_reason", "_seq"),
        table.where("_reason IS NOT NULL").select(F.col("_line").alias("line"), *place, F.col("_reason").alias("reason")),
    )


def _sift_csv(spark: SparkSession, path: str, names: list[str], columns: list[Column], label: str) -> Sifted:
    raw = files.read_csv(spark, path, names).withColumn("_seq", files.file_order())
    reason = F.when(F.col("_short"), TOO_FEW_FIELDS).when(files.is_header(), REPEATED_HEADER)
    # A line of the right number of fields is not kept by the reader, but a header is known.
    line = F.when(F.col("_short"), F.col(files.BROKEN)).when(files.is_header(), F.concat_ws(",", *names))
    return _sift(raw.select(*columns, "_seq", line.alias("_line"), reason.alias("_reason")), label)


def sift_ratings(spark: SparkSession, path: str, cols: RatingColumns = DEFAULT_COLUMNS) -> Sifted:
    """As :func:`files.read_ratings`; rejected are lines of fewer than three fields and repeated headers."""
    columns = files.rating_columns(cols, F.col("_seq"))
    return _sift_csv(spark, path, ["user_id", "business_id", "stars"], columns, "sifted-ratings")


def sift_pairs(spark: SparkSession, path: str, cols: RatingColumns = DEFAULT_COLUMNS) -> Sifted:
    """As :func:`files.read_pairs`; rejected are lines of fewer than two fields and repeated headers."""
    return _sift_csv(spark, path, ["user_id", "business_id"], files.pair_columns(cols, F.col("_seq")), "sifted-pairs")


def sift_json_lines(spark: SparkSession, path: str) -> Sifted:
    """Accepted are ``seq, doc``, parsed lines that every ``profiles.parse_*`` takes as they are; rejected are blank lines,
    other JSON than objects, and broken JSON."""
    lines = files.read_json_lines(spark, path)
    looks_right = r"value RLIKE r'^\s*\{'"
    # Generated, not projected, as in parse_documents: a line is parsed once.
    doc = F.explode(F.expr(f"array(CASE WHEN {looks_right} THEN try_parse_json(value) END)"))
    parsed = lines.select("value", "seq", doc.alias("doc"))
    rejected = F.col("doc").isNull()
    reason = F.when(rejected, F.when(F.expr(looks_right), BROKEN_JSON).otherwise(NOT_AN_OBJECT))
    line = F.when(rejected, F.col("value"))
    return _sift(parsed.select("seq", "doc", F.col("seq").alias("_seq"), line.alias("_line"), reason.alias("_reason")), "sifted-json")
