"""Rating-like DataFrames over the given tables: customers rate suppliers by the quantity they order.

The hold-out is by time and by region: late orders, and all customers and suppliers of one nation each, so that
known pairs, cold users, cold items and pairs with both cold occur.  Profiles are written as JSON lines first and
go through the tolerant parsers; every customer or supplier in debt has a broken line and so no profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.features import Profiles
from starloom.session import stage
from starloom.sources import profiles

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, item_id, stars, seq, fold, is_test``, one row per line item.

    ``seq`` orders the line items by order, line and part; a number, so that "last" is a fixed-width maximum.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    return rows.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("item_id"),
        (F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        (F.col("l_orderkey") * 2**24 + F.col("l_linenumber") * 2**21 + F.col("l_partkey")).cast("bigint").alias("seq"),
        ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % FOLDS).cast("int").alias("fold"),
        (
            (F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp"))
            | (F.col("c_nationkey") == 19)
            | (F.col("s_nationkey") == 15)
        ).alias("is_test"),
    )


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where(~F.col("is_test")).drop("is_test")


def train_and_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both parts, of one table that is written once."""
    rows = stage(ratings(spark, sf_dir), "ratings")
    return rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test", "fold")


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value, seq``: JSON lines of customers with typed, textual, missing, null and malformed fields."""
    n, balance, segment = F.col("c_nationkey"), F.abs("c_acctbal"), F.col("c_mktsegment")
    fields = F.struct(
        F.col("c_custkey").cast("string").alias("user_id"),
        (F.lit(1.0) + n * 0.125).alias("average_stars"),
        F.floor(balance / 50).alias("review_count"),
        F.when(segment == "MACHINERY", F.lit("3.0")).otherwise(F.floor(balance / 600).cast("string")).alias("fans"),
        F.concat(F.lit(" "), F.floor(balance / 100).cast("string"), F.lit(" ")).alias("useful"),
        F.when(segment == "AUTOMOBILE", F.lit("x")).otherwise(n.cast("string")).alias("compliment_hot"),
        (n * 2).alias("compliment_photos"),
        F.when(segment != "BUILDING", F.concat((F.lit(2004) + F.floor(n / 2)).cast("string"), F.lit("-03-01"))).alias("yelping_since"),
        F.when(segment == "BUILDING", F.lit("None")).when(segment == "FURNITURE", F.lit("")).when(segment == "MACHINERY", F.lit("a"))
        .when(segment == "HOUSEHOLD", F.lit("a,, b,c")).alias("friends"),
        F.when(n > 12, F.lit("2012,2013")).otherwise(F.lit("None")).alias("elite"),
    )
    stale = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("user_id"), F.lit(1).alias("average_stars")))
    line = F.when(F.col("c_acctbal") < 0, F.concat(F.lit('{"user_id": '), F.col("c_name"))).otherwise(F.to_json(fields))
    versions = F.array(F.struct(stale.alias("value"), F.lit(0).alias("v")), F.struct(line.alias("value"), F.lit(1).alias("v")))
    kept = F.when((segment == "FURNITURE") & (F.col("c_acctbal") >= 0), versions).otherwise(F.slice(versions, 2, 1))
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.explode(kept).alias("_l"))
    return lines.select("_l.value", F.struct("c_custkey", "_l.v").alias("seq"))


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value, seq``: JSON lines of suppliers with attributes, hours and categories."""
    n, balance = F.col("s_nationkey"), F.col("s_acctbal")
    by_nation = lambda *words: F.get(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int"))
    attributes = F.struct(
        F.floor(balance / 2500).cast("string").alias("RestaurantsPriceRange2"),
        by_nation("none", "full_bar", "beer_and_wine", None).alias("Alcohol"),
        by_nation("True", "False", None).alias("GoodForKids"),
        by_nation("False", "True").alias("OutdoorSeating"),
        by_nation("quiet", "average", "loud", "very_loud", "?", None).alias("NoiseLevel"),
        by_nation("no", "free", None, "u'no'").alias("WiFi"),
        by_nation("True", "False", "x").alias("HasTV"),
        by_nation("casual", "dressy", "formal", None).alias("RestaurantsAttire"),
    )
    hours = F.struct(
        F.concat((n % 24).cast("string"), F.lit(":0-"), ((n * 7) % 24).cast("string"), F.lit(":30")).alias("Monday"),
        by_nation("11:0-21:0", "22:0-2:30", "0:0-0:0", "bad", None).alias("Saturday"),
    )
    fields = F.struct(
        F.col("s_suppkey").cast("string").alias("business_id"),
        (F.lit(1.0) + n * 0.125).alias("stars"),
        F.floor(balance / 40).alias("review_count"),
        (balance / 128).cast("string").alias("latitude"),
        (-n * 1.5).alias("longitude"),
        F.when(n % 3 != 0, n % 2).alias("is_open"),
        F.when(n != 3, attributes).alias("attributes"),
        F.when(n != 4, hours).alias("hours"),
        by_nation("Restaurants, Food", "Bars,, Nightlife ", "", "Pizza", None, "Coffee & Tea,Fast Food").alias("categories"),
    )
    line = F.when(balance < 0, F.lit("[1, 2]")).otherwise(F.to_json(fields))
    return table(spark, sf_dir, "supplier").select(line.alias("value"), F.struct("s_suppkey").alias("seq"))


def checkin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value, seq``: one map of 'Day-hour' counts per item; error events fall under a malformed key."""
    key = F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(
        F.concat(F.date_format("ts", "EEE"), F.lit("-"), F.hour("ts").cast("string"))
    )
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), key.alias("k")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("time"))
    line = F.to_json(F.struct(F.col("item").cast("string").alias("business_id"), "time"))
    return maps.select(line.alias("value"), F.struct("item").alias("seq"))


def tip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    item = F.get_json_object("props", "$.k")
    return clicks.select(
        F.to_json(
            F.struct(
                F.col("user_id").cast("string").alias("user_id"), item.alias("business_id"),
                F.floor("value").cast("string").alias("likes"),
            )
        ).alias("value")
    )


def photo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("business_id"))).alias("value"))


def _numeric(df: DataFrame, *keys: str) -> DataFrame:
    """Ids of the given tables are numbers; ids of JSON files are text."""
    return df.withColumns({k: F.col(k).try_cast("bigint") for k in keys})


def _spread(lines: DataFrame) -> DataFrame:
    """The lines over all cores: a small file is one task, which parsing its lines may keep busy for long."""
    return lines.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism, "value")


def all_profiles(spark: SparkSession, sf_dir: str, rich: bool) -> Profiles:
    return Profiles(
        users=_numeric(profiles.parse_users(_spread(user_lines(spark, sf_dir))), "user_id"),
        items=_numeric(profiles.parse_items(_spread(item_lines(spark, sf_dir)), rich=rich), "item_id"),
        checkins=_numeric(profiles.parse_checkins(checkin_lines(spark, sf_dir), strict_keys=rich), "item_id"),
        tips=_numeric(profiles.parse_tips(tip_lines(spark, sf_dir)), "user_id", "item_id"),
        photos=_numeric(profiles.parse_photos(photo_lines(spark, sf_dir)), "item_id"),
    )
