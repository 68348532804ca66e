"""Profile entities from JSON lines: users, items, check-ins, tips and photos.

Each ``parse_*`` takes a DataFrame with a ``value`` column (and ``seq`` where the last record of a key
must win); each ``read_*`` does the same from files.  Lines that cannot be parsed are dropped.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import encoders as enc
from starloom.functions.parsing import JsonField, parse_documents
from starloom.functions.rating import ratio
from starloom.schema import COMPLIMENT_KINDS
from starloom.sources.files import read_json_lines


def last_per_key(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One row per key, the one with the greatest ``seq``; ``seq`` is dropped.

    A plain aggregate: copies of a hot key are reduced before the shuffle.
    """
    fields = [c for c in df.columns if c not in (key, seq)]
    last = df.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(seq)).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in fields])


def parse_users(lines: DataFrame) -> DataFrame:
    whole = lambda name: JsonField("doc", name).integer()
    users = parse_documents(lines).select(
        JsonField("doc", "user_id").key().alias("user_id"),
        "seq",
        JsonField("doc", "average_stars").floating().alias("average_stars"),
        *[whole(c).alias(c) for c in ["review_count", "fans", "useful", "funny", "cool"]],
        JsonField("doc", "yelping_since").year(default=2000).alias("since_year"),
        reduce(add, [whole(f"compliment_{kind}") for kind in COMPLIMENT_KINDS]).alias("compliments"),
        JsonField("doc", "friends").list_length().alias("friend_count"),
        JsonField("doc", "elite").list_length().alias("elite_count"),
    )
    users = last_per_key(users, "user_id")
    return users.select(
        "*",
        ratio(F.col("fans"), F.col("review_count")).alias("fans_per_review"),
        ratio(F.col("useful"), F.col("review_count")).alias("useful_per_review"),
    )


def parse_items(lines: DataFrame, item: str = "item_id", rich: bool = True) -> DataFrame:
    """Item profiles; ``rich`` adds attributes, hours and category flags.

    The two modes differ in poisoned records: with ``rich`` a record whose categories are neither text
    nor empty (or whose noise/attire value is nested) is dropped, without it the category count is 0.
    """
    attribute = lambda name: JsonField("doc", f"attributes.{name}")
    categories = JsonField("doc", "categories")
    docs = parse_documents(lines)
    columns = [
        JsonField("doc", "business_id").key().alias(item),
        F.col("seq"),
        JsonField("doc", "stars").floating().alias("item_stars"),
        JsonField("doc", "review_count").integer().alias("item_review_count"),
        JsonField("doc", "latitude").floating().alias("latitude"),
        JsonField("doc", "longitude").floating().alias("longitude"),
        JsonField("doc", "is_open").integer(absent=1).alias("is_open"),
        attribute("RestaurantsPriceRange2").integer().alias("price"),
        enc.category_count(categories.string_only()).alias("category_count"),
    ]
    if rich:
        docs = docs.where(
            (categories.string_only().isNotNull() | categories.truthy_text().isNull())
            & ~attribute("NoiseLevel").is_nested
            & ~attribute("RestaurantsAttire").is_nested
        )
        hours = F.transform_values(
            JsonField("doc", "hours").string_map(),
            lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
        )
        columns += [
            enc.alcohol_flag(attribute("Alcohol").truthy_text()).alias("alcohol"),
            enc.true_flag(attribute("GoodForKids").string_only()).alias("kids"),
            enc.true_flag(attribute("OutdoorSeating").string_only()).alias("outdoor"),
            enc.noise_code(attribute("NoiseLevel").string_only()).alias("noise"),
            enc.wifi_flag(attribute("WiFi").truthy_text()).alias("wifi"),
            enc.true_flag(attribute("HasTV").string_only()).alias("tv"),
            enc.attire_code(attribute("RestaurantsAttire").string_only()).alias("attire"),
            enc.weekly_hours(hours).alias("weekly_hours"),
            enc.weekend_flag(hours).alias("weekend_open"),
            *enc.category_flags(categories.string_only()),
        ]
    return last_per_key(docs.select(*columns), item)


def parse_checkins(lines: DataFrame, item: str = "item_id", strict_keys: bool = True) -> DataFrame:
    """Check-in totals; ``strict_keys`` counts 'Day-hour' keys only and adds the two ratios.

    A record with a non-numeric count (among the counted keys) is dropped.
    """
    entries = JsonField("doc", "time").string_map()
    counted = enc.valid_day_hours(entries) if strict_keys else entries
    docs = parse_documents(lines).select(
        JsonField("doc", "business_id").key().alias(item), "seq", counted.alias("entries")
    )
    numeric = F.forall(
        F.map_values("entries"), lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    )
    docs = docs.where(F.coalesce(numeric, F.lit(True)))
    counts = F.transform_values(
        F.col("entries"),
        lambda _, v: F.coalesce(
            F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double")
        ),
    )
    if strict_keys:
        docs = docs.withColumn("counts", counts)
        evening, weekend, total = enc.checkin_ratios(F.col("counts"))
        columns = [evening.alias("evening_ratio"), weekend.alias("weekend_ratio"), total.alias("checkins")]
    else:
        columns = [enc.map_total(counts).alias("checkins")]
    return last_per_key(docs.select(item, "seq", *columns), item)


def parse_tips(lines: DataFrame, item: str = "item_id") -> DataFrame:
    return parse_documents(lines).select(
        JsonField("doc", "user_id").key().alias("user_id"),
        JsonField("doc", "business_id").key().alias(item),
        JsonField("doc", "likes").integer().alias("likes"),
    )


def parse_photos(lines: DataFrame, item: str = "item_id") -> DataFrame:
    return parse_documents(lines).select(JsonField("doc", "business_id").key().alias(item))


def tip_stats(tips: DataFrame, key: str, prefix: str) -> DataFrame:
    """Tips and likes per key: ``{prefix}_tips, {prefix}_tip_likes``."""
    return tips.groupBy(key).agg(
        F.count("*").alias(f"{prefix}_tips"), F.sum("likes").alias(f"{prefix}_tip_likes")
    )


def photo_counts(photos: DataFrame, item: str = "item_id") -> DataFrame:
    return photos.groupBy(item).agg(F.count("*").alias("photos"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return parse_users(read_json_lines(spark, path))


def read_items(spark: SparkSession, path: str, item: str = "item_id", rich: bool = True) -> DataFrame:
    return parse_items(read_json_lines(spark, path), item, rich)


def read_checkins(spark: SparkSession, path: str, item: str = "item_id", strict_keys: bool = True) -> DataFrame:
    return parse_checkins(read_json_lines(spark, path), item, strict_keys)


def read_tips(spark: SparkSession, path: str, item: str = "item_id") -> DataFrame:
    return parse_tips(read_json_lines(spark, path), item)


def read_photos(spark: SparkSession, path: str, item: str = "item_id") -> DataFrame:
    return parse_photos(read_json_lines(spark, path), item)
