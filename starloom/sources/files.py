"""File scans that remember where each row came from, and the prediction sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starloom.functions.parsing import float_text
from starloom.schema import DEFAULT_COLUMNS, RatingColumns

_LOCATION = ["_metadata.file_path", "_metadata.file_block_start"]


def file_order() -> Column:
    """Total order of scanned rows: file, block in the file, row in the block.

    A block is read by one task in row order, so the task-local id orders its rows; blocks and files
    are ordered by name and offset.  Needs no pass over the data.
    """
    return F.struct(
        F.col("file_path").alias("file"),
        F.col("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def with_row_index(df: DataFrame, seq: str = "seq", index: str = "row_index") -> DataFrame:
    """Dense 0-based position in file order.

    Rows per block are counted once and summed over the (few) blocks; each row adds its offset in the
    block.  The block table has one line per input split, so it is the only thing sorted globally.
    """
    blocks = df.groupBy(F.col(f"{seq}.file").alias("_file"), F.col(f"{seq}.block").alias("_block")).agg(
        F.count("*").alias("_rows"), F.min(f"{seq}.row").alias("_first")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    located = df.join(
        offsets,
        (F.col(f"{seq}.file") == F.col("_file")) & (F.col(f"{seq}.block") == F.col("_block")),
    )
    position = F.col("_offset") + F.col(f"{seq}.row") - F.col("_first")
    return located.select(*df.columns, position.alias(index))


BROKEN = "_broken_line"


def read_csv(spark: SparkSession, path: str, names: list[str], strict: bool = False) -> DataFrame:
    """The named fields as text, the whole line in ``BROKEN`` if it has another number of fields, and ``_short``: whether it
    has fewer of them (an empty field is one)."""
    raw = (
        spark.read.schema(", ".join(f"`{n}` STRING" for n in [*names, BROKEN]))
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .csv(path)
        .select(*names, BROKEN, *_LOCATION)
    )
    # Spark hands over lines of another number of fields as broken ones; those with more fields are read as usual.
    short = F.coalesce(F.size(F.split(BROKEN, ",")) < len(names), F.lit(False))
    if strict:
        short = F.when(short, F.raise_error(F.concat(F.lit("too few fields: "), F.col(BROKEN))).cast("boolean")).otherwise(False)
    return raw.withColumn("_short", short)


def is_header() -> Column:
    return F.coalesce((F.col("user_id") == "user_id") & (F.col("business_id") == "business_id"), F.lit(False))


def pair_columns(cols: RatingColumns, seq: Column) -> list[Column]:
    """The output of :func:`read_pairs` from the text fields; an empty id is kept as ''."""
    ids = {cols.user: "user_id", cols.item: "business_id"}
    return [*(F.coalesce(field, F.lit("")).alias(name) for name, field in ids.items()), seq.alias(cols.seq)]


def rating_columns(cols: RatingColumns, seq: Column) -> list[Column]:
    """The output of :func:`read_ratings` from the text fields."""
    user, item, place = pair_columns(cols, seq)
    return [user, item, float_text(F.coalesce("stars", F.lit(""))).alias(cols.rating), place]


def read_ratings(
    spark: SparkSession, path: str, cols: RatingColumns = DEFAULT_COLUMNS, strict: bool = False
) -> DataFrame:
    """``user, item, rating, seq`` from CSV with a header; repeated headers are dropped.

    An empty rating and text that is no number become 0.0, an empty id is kept as ''.  Lines of fewer than three fields
    are dropped (:func:`short_lines` counts them, :mod:`~starloom.sources.quarantine` keeps them), or fail the job when ``strict``.
    """
    raw = read_csv(spark, path, ["user_id", "business_id", "stars"], strict)
    return raw.where(~F.col("_short") & ~is_header()).select(*rating_columns(cols, file_order()))


def read_pairs(
    spark: SparkSession, path: str, cols: RatingColumns = DEFAULT_COLUMNS, strict: bool = False
) -> DataFrame:
    """``user, item, seq`` of the pairs to predict; further CSV columns are ignored, lines of one field as above."""
    raw = read_csv(spark, path, ["user_id", "business_id"], strict)
    return raw.where(~F.col("_short") & ~is_header()).select(*pair_columns(cols, file_order()))


def short_lines(spark: SparkSession, path: str, fields: int = 3) -> DataFrame:
    """One row: ``n``, the number of lines that :func:`read_ratings` (3 fields) or :func:`read_pairs` (2) leaves out."""
    lines = spark.read.text(path).where("value != ''")
    return lines.agg(F.count_if(F.size(F.split("value", ",")) < fields).alias("n"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, seq``: the raw lines with their file order."""
    lines = spark.read.text(path).select("value", *_LOCATION)
    return lines.select("value", file_order().alias("seq"))


def write_predictions(
    predictions: DataFrame,
    path: str,
    cols: RatingColumns = DEFAULT_COLUMNS,
    order_by: str | None = None,
    format: str = "csv",
    prediction: str = "prediction",
) -> None:
    """Write ``user_id, business_id, prediction`` as CSV with headers, or as parquet.

    ``order_by`` keeps the order of the pairs file across the part files (a range-partitioned sort).
    """
    ordered = predictions.orderBy(order_by) if order_by else predictions
    out = ordered.select(
        F.col(cols.user).alias("user_id"), F.col(cols.item).alias("business_id"), F.col(prediction).alias("prediction")
    )
    writer = out.write.mode("errorifexists")
    if format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(format).save(path)
