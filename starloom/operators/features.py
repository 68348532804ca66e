"""Wide feature rows for the rating model: two lookups, then one projection.

Everything known about a user (rating statistics, profile, tips) is first combined into one row per user, and the
same per item, so that the rating rows - by far the largest table - are shuffled once per side only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.functions.rating import clamp, confidence, shrink, warm_or_cold
from starloom.operators.leave_one_out import without_rating
from starloom.operators.stats import key_stats, rating_distribution
from starloom.schema import DEFAULT_COLUMNS, TOP_CATEGORIES, RatingColumns
from starloom.session import stage
from starloom.sources.profiles import photo_counts, tip_stats

# Shrinkage strengths, defaults of entities without a profile, and the year ages count back from.
USER_STRENGTH = 12
ITEM_STRENGTH = 32
PROFILE_STRENGTH = 8
USER_EXTRA_STRENGTHS = [5, 15]
ITEM_EXTRA_STRENGTHS = [10, 35]
UNKNOWN_SINCE_YEAR = 2015
AGE_REFERENCE_YEAR = 2019
FULL_NEIGHBOURHOOD = 50

USER_DEFAULTS = {
    "review_count": 0, "fans": 0, "useful": 0, "since_year": UNKNOWN_SINCE_YEAR, "compliments": 0, "friend_count": 0,
    "elite_count": 0, "fans_per_review": 0.0, "useful_per_review": 0.0,
}
ITEM_DEFAULTS = {"item_review_count": 0, "latitude": 0.0, "longitude": 0.0, "is_open": 1, "price": 0, "category_count": 0}
ATTRIBUTE_DEFAULTS = {"alcohol": 0, "kids": 0, "outdoor": 0, "noise": -1, "wifi": 0, "tv": 0, "attire": 0}
EXTRA_DEFAULTS = {**ATTRIBUTE_DEFAULTS, "weekly_hours": 0.0, "weekend_open": 0}
CHECKIN_DEFAULTS = {"evening_ratio": 0.0, "weekend_ratio": 0.0}
CATEGORY_COLUMNS = [f"cat_{i:02d}" for i in range(1, len(TOP_CATEGORIES) + 1)]

STACKED_FEATURES = """
user_mean item_mean pair_mean pair_mean_sq user_profile_mean item_profile_mean
user_mean_c5 user_mean_c15 item_mean_c10 item_mean_c35 user_conf item_conf
log_user_cnt log_item_cnt log_user_reviews log_item_reviews
mean_gap abs_mean_gap user_bias item_bias user_var item_var user_range item_range user_cold item_cold
log_fans log_useful log_compliments log_friends elite_count fans_per_review useful_per_review account_years
item_stars latitude longitude is_open price category_count
log_checkins log_photos log_item_tips log_user_tips item_tip_likes user_tip_likes
mean_product bias_product gap_x_user_var gap_x_item_var var_product log_cnt_product
user_mean_x_price item_var_x_log_cnt user_mean_x_conf item_mean_x_conf gap_x_conf pair_mean_x_item_conf
cf_pred n_neighbours cf_conf cf_minus_user cf_minus_item cf_minus_pair cf_x_cf_conf cf_x_item_conf cf_x_user_conf
cf_abs_minus_user
""".split()

RICH_FEATURES = [
    *STACKED_FEATURES, *ATTRIBUTE_DEFAULTS, "weekly_hours", "weekend_open", "evening_ratio", "weekend_ratio",
    *"""
    user_low_rate user_high_rate item_low_rate item_high_rate low_rate_product high_rate_product
    user_one_rate user_five_rate item_one_rate item_five_rate one_rate_product five_rate_product
    user_one_x_item_low user_five_x_item_high
    """.split(),
    *CATEGORY_COLUMNS,
]


@dataclass(frozen=True)
class Profiles:
    """Profile tables as the readers give them; item tables are keyed by ``cols.item``."""

    users: DataFrame
    items: DataFrame
    checkins: DataFrame
    tips: DataFrame
    photos: DataFrame


def user_table(ratings: DataFrame, profiles: Profiles, rich: bool, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row per user: ``user_dist`` (rating statistics) and all profile columns, NULL where unknown."""
    users = profiles.users.select(
        F.col("user_id").alias(cols.user), "average_stars", *USER_DEFAULTS, F.lit(True).alias("has_user_profile")
    )
    tips = tip_stats(profiles.tips.withColumnRenamed("user_id", cols.user), cols.user, "user")
    return _merge([_packed_stats(ratings, cols.user, "user_dist", rich, cols), users, tips], cols.user)


def item_table(ratings: DataFrame, profiles: Profiles, rich: bool, cols: RatingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row per item: ``item_dist`` and all profile, check-in, tip and photo columns."""
    extra = [*EXTRA_DEFAULTS, *CATEGORY_COLUMNS] if rich else []
    ratios = [*CHECKIN_DEFAULTS] if rich else []
    items = profiles.items.select(
        cols.item, "item_stars", *ITEM_DEFAULTS, *extra, F.lit(True).alias("has_item_profile")
    )
    checkins = profiles.checkins.select(cols.item, "checkins", *ratios)
    return _merge(
        [
            _packed_stats(ratings, cols.item, "item_dist", rich, cols), items, checkins,
            tip_stats(profiles.tips, cols.item, "item"), photo_counts(profiles.photos, cols.item),
        ],
        cols.item,
    )


def _packed_stats(ratings: DataFrame, key: str, name: str, rich: bool, cols: RatingColumns) -> DataFrame:
    table = rating_distribution(ratings, key, cols) if rich else key_stats(ratings, key, cols)
    return table.select(key, F.struct(*[c for c in table.columns if c != key]).alias(name))


def _merge(tables: list[DataFrame], key: str) -> DataFrame:
    """All columns of tables that have at most one row per key, for every key of any of them.

    A union and one aggregate: a chain of full outer joins would shuffle the growing rows again for each table.  Structs
    are taken apart before and put together behind, as numbers are aggregated in place, without sorting.
    """
    flat, rebuilt = [], []
    for n, t in enumerate(tables):
        columns = []
        for field in (f for f in t.schema.fields if f.name != key):
            if isinstance(field.dataType, StructType):
                parts = {c: f"_t{n}_{field.name}_{c}" for c in field.dataType.names}
                columns += [F.col(f"{field.name}.{c}").alias(name) for c, name in parts.items()]
                known = f"_t{n}_{field.name}"
                columns.append(F.col(field.name).isNotNull().alias(known))
                whole = F.struct(*[F.col(name).alias(c) for c, name in parts.items()])
                rebuilt.append(F.when(F.col(known), whole).alias(field.name))
            else:
                columns.append(F.col(field.name).alias(f"_t{n}_{field.name}"))
                rebuilt.append(F.col(f"_t{n}_{field.name}").alias(field.name))
        flat.append(t.select(key, *columns))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)
    merged = stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in stacked.columns if c != key])
    return merged.select(key, *rebuilt)


def with_entities(
    rows: DataFrame,
    users: DataFrame,
    items: DataFrame,
    cols: RatingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """Left-join both entity tables, which should be written ones, to rating rows or pairs."""
    joined = rows.join(users, cols.user, "left").join(items, cols.item, "left")
    return joined.select(*rows.columns, *[c for c in (*users.columns, *items.columns) if c not in cols.pair])


def _full_stats(dist: Column, mean: Column, rich: bool) -> dict[str, Column]:
    """Statistics of an entity over all its ratings; global mean and zeros for an unseen one."""
    seen = dist["cnt"].isNotNull()
    or_else = lambda value, empty: F.when(seen, value).otherwise(empty)
    zero = F.lit(0.0)
    stats = {
        "cnt": or_else(dist["cnt"], F.lit(0).cast("bigint")), "min": or_else(dist["min"], mean), "max": or_else(dist["max"], mean)
    }
    if not rich:
        return {**stats, "avg": or_else(dist["avg"], mean), "var": or_else(dist["var"], zero)}
    n, total = dist["cnt"], dist["sum"]
    stats["avg"] = or_else(total / n, mean)
    stats["var"] = or_else(F.greatest(zero, (n * dist["sumsq"] - total * total) / (n * n)), zero)
    for kind in ["low", "high", "one", "five"]:
        stats[f"{kind}_rate"] = or_else(dist[kind] / n, zero)
    return stats


def bias_proxy(u: dict[str, Column], i: dict[str, Column], mean: Column) -> Column:
    """User mean + item mean - global mean; the known mean alone, or the global mean, where one is missing."""
    user_known, item_known = u["cnt"] > 0, i["cnt"] > 0
    return clamp(
        F.when(user_known & item_known, u["avg"] + i["avg"] - mean)
        .when(user_known, u["avg"])
        .when(item_known, i["avg"])
        .otherwise(mean)
    )


def assemble(
    joined: DataFrame,
    mean: Column,
    rich: bool,
    held_out: bool,
    keep: list[str],
    cf: str = "columns",
    cols: RatingColumns = DEFAULT_COLUMNS,
    vector: str | None = None,
) -> DataFrame:
    """``keep`` and the 68 (or, ``rich``, 117) features of rows joined by :func:`with_entities`.

    ``held_out`` takes each training row's own rating out of its statistics (``rich`` tables only).  ``cf`` is
    'columns' to use ``cf_pred, n_neighbours`` of the rows, or 'proxy' for the bias estimate.  With ``vector`` the
    features come as one ML vector, which avoids a row of over a hundred fields.
    """
    if held_out and not rich:
        raise ValueError("leave-one-out statistics need the rich entity tables")

    def stats(dist: str) -> dict[str, Column]:
        if held_out:
            return without_rating(F.col(cols.rating), F.col(dist), F.col("g"))
        return _full_stats(F.col(dist), F.col("g"), rich)

    rows = joined.withColumn("g", mean)
    u, i = stats("user_dist"), stats("item_dist")
    if cf == "proxy":
        rows = rows.withColumns({"cf_pred": bias_proxy(u, i, F.col("g")), "n_neighbours": F.lit(0)})
    defaults = {**USER_DEFAULTS, **ITEM_DEFAULTS, "checkins": 0, "photos": 0}
    defaults |= {f"{side}_{c}": 0 for side in ("user", "item") for c in ("tips", "tip_likes")}
    if rich:
        defaults |= {**EXTRA_DEFAULTS, **CHECKIN_DEFAULTS, **{c: 0 for c in CATEGORY_COLUMNS}}
    base = rows.select(
        *keep, "g", F.col("cf_pred").cast("double").alias("cf_pred"), F.col("n_neighbours").cast("double").alias("n_neighbours"),
        *[c.alias(f"u_{name}") for name, c in u.items()],
        *[c.alias(f"i_{name}") for name, c in i.items()],
        F.when(F.col("has_user_profile"), F.col("average_stars")).otherwise(F.col("g")).alias("average_stars"),
        F.when(F.col("has_item_profile"), F.col("item_stars")).otherwise(F.col("g")).alias("item_stars"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(float(value))).alias(c) for c, value in defaults.items()],
    )
    c = F.col
    logged = {
        "log_user_cnt": "u_cnt", "log_item_cnt": "i_cnt", "log_user_reviews": "review_count", "log_item_reviews": "item_review_count",
        "log_fans": "fans", "log_useful": "useful", "log_compliments": "compliments", "log_friends": "friend_count",
        "log_checkins": "checkins", "log_photos": "photos", "log_item_tips": "item_tips", "log_user_tips": "user_tips",
    }
    base = base.withColumns(
        {
            "user_profile_mean": shrink(c("average_stars"), c("review_count"), c("g"), PROFILE_STRENGTH),
            "item_profile_mean": shrink(c("item_stars"), c("item_review_count"), c("g"), PROFILE_STRENGTH),
            "user_conf": confidence(c("u_cnt"), USER_STRENGTH),
            "item_conf": confidence(c("i_cnt"), ITEM_STRENGTH),
            **{f"user_mean_c{k}": shrink(c("u_avg"), c("u_cnt"), c("average_stars"), k) for k in USER_EXTRA_STRENGTHS},
            **{f"item_mean_c{k}": shrink(c("i_avg"), c("i_cnt"), c("item_stars"), k) for k in ITEM_EXTRA_STRENGTHS},
            **{name: F.log1p(source) for name, source in logged.items()},
            "cf_conf": F.least(c("n_neighbours"), F.lit(float(FULL_NEIGHBOURHOOD))) / F.lit(float(FULL_NEIGHBOURHOOD)),
        }
    )
    base = base.withColumns(
        {
            "user_mean": warm_or_cold(c("u_cnt"), shrink(c("u_avg"), c("u_cnt"), c("average_stars"), USER_STRENGTH), c("user_profile_mean")),
            "item_mean": warm_or_cold(c("i_cnt"), shrink(c("i_avg"), c("i_cnt"), c("item_stars"), ITEM_STRENGTH), c("item_profile_mean")),
        }
    )
    base = base.withColumns(
        {
            "pair_mean": (c("user_mean") + c("item_mean")) / 2.0,
            "mean_gap": c("user_mean") - c("item_mean"),
            "user_bias": c("user_mean") - c("g"),
            "item_bias": c("item_mean") - c("g"),
        }
    )
    formulas = {
        "pair_mean_sq": c("pair_mean") * c("pair_mean"),
        "abs_mean_gap": F.abs("mean_gap"),
        "user_var": c("u_var"), "item_var": c("i_var"),
        "user_range": c("u_max") - c("u_min"), "item_range": c("i_max") - c("i_min"),
        "user_cold": c("u_cnt") == 0, "item_cold": c("i_cnt") == 0,
        "account_years": F.lit(float(AGE_REFERENCE_YEAR)) - c("since_year"),
        "mean_product": c("user_mean") * c("item_mean"), "bias_product": c("user_bias") * c("item_bias"),
        "gap_x_user_var": c("mean_gap") * c("u_var"), "gap_x_item_var": c("mean_gap") * c("i_var"),
        "var_product": c("u_var") * c("i_var"), "log_cnt_product": c("log_user_cnt") * c("log_item_cnt"),
        "user_mean_x_price": c("user_mean") * c("price"), "item_var_x_log_cnt": c("i_var") * c("log_item_cnt"),
        "user_mean_x_conf": c("user_mean") * c("user_conf"), "item_mean_x_conf": c("item_mean") * c("item_conf"),
        "gap_x_conf": c("mean_gap") * (c("user_conf") + c("item_conf")),
        "pair_mean_x_item_conf": c("pair_mean") * c("item_conf"),
        "cf_minus_user": c("cf_pred") - c("user_mean"), "cf_minus_item": c("cf_pred") - c("item_mean"),
        "cf_minus_pair": c("cf_pred") - c("pair_mean"), "cf_x_cf_conf": c("cf_pred") * c("cf_conf"),
        "cf_x_item_conf": c("cf_pred") * c("item_conf"), "cf_x_user_conf": c("cf_pred") * c("user_conf"),
        "cf_abs_minus_user": F.abs(c("cf_pred") - c("user_mean")),
    }
    if rich:
        rates = {f"{side}_{kind}_rate": c(f"{side[0]}_{kind}_rate") for side in ("user", "item") for kind in ("low", "high", "one", "five")}
        formulas |= rates
        formulas |= {f"{kind}_rate_product": c(f"u_{kind}_rate") * c(f"i_{kind}_rate") for kind in ("low", "high", "one", "five")}
        formulas |= {
            "user_one_x_item_low": c("u_one_rate") * c("i_low_rate"), "user_five_x_item_high": c("u_five_rate") * c("i_high_rate"),
        }
    names = RICH_FEATURES if rich else STACKED_FEATURES
    values = [formulas.get(name, c(name)).cast("double") for name in names]
    if vector:
        return base.select(*keep, array_to_vector(F.array(*values)).alias(vector))
    return base.select(*keep, *[v.alias(name) for name, v in zip(names, values)])


def bias_scores(
    rows: DataFrame, ratings: DataFrame, held_out: bool, cols: RatingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """``rows`` plus ``cf_pred, n_neighbours`` of the bias estimate; ``held_out`` leaves each row's own rating out."""
    users = stage(_packed_stats(ratings, cols.user, "user_dist", True, cols), "users")
    items = stage(_packed_stats(ratings, cols.item, "item_dist", True, cols), "items")
    joined = with_entities(rows, users, items, cols).withColumn("_g", ratings.agg(F.avg(cols.rating)).scalar())
    if held_out:
        u, i = [without_rating(F.col(cols.rating), F.col(d), F.col("_g")) for d in ("user_dist", "item_dist")]
    else:
        u, i = [_full_stats(F.col(d), F.col("_g"), True) for d in ("user_dist", "item_dist")]
    return joined.select(
        *rows.columns, bias_proxy(u, i, F.col("_g")).alias("cf_pred"), F.lit(0).cast("bigint").alias("n_neighbours")
    )
