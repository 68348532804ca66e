"""One query per operator, over the given tables.  Names and columns match ``workload.oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import encoders as enc
from starloom.functions.rating import confidence, shrink, warm_or_cold
from starloom.operators import evaluation, stats
from starloom.operators.additive import AdditiveParams, fit_additive
from starloom.operators.boosting import BoostingParams, calibrated, clamped, fit_boosting, fit_calibration
from starloom.operators.features import RICH_FEATURES, STACKED_FEATURES, bias_scores
from starloom.operators.leave_one_out import STAT_NAMES, leave_one_out
from starloom.operators.matrix import dedupe_last as last_ratings
from starloom.operators.matrix import matrix_means, rating_matrix
from starloom.operators.scoring import assign_folds, attach_scores, fit_cf, out_of_fold_cf, score_cf
from starloom.operators.similarity import CfParams, corater_sums
from starloom.operators.similarity import item_similarity as similar_items
from starloom.operators.similarity import top_similar
from starloom.plans import jobs
from starloom.session import fresh_path, small_methods, stage
from starloom.sources import files, profiles, quarantine
from workload import views

DIGITS = 6
# Added before rounding, here and in the oracles: values half-way between two roundings are common among
# ratios of counts, and sums in another order put them on either side.
TIE = 3.3e-9
# Off in the benchmark: rounding over a hundred columns would be timed instead of the operators.
COMPARABLE = True
LOOSE = 1e-4


def round_half_up(x: Column) -> Column:
    """``F.round(x, DIGITS)``, which takes some microseconds as decimal text, by arithmetic where that can't differ.

    Below 10^6 a scaled value is off by less than 10^-3, so the text is needed only that near to half-way.
    """
    scale = F.lit(10.0**DIGITS)
    near = F.rint(x * scale)
    plain = (F.abs(x) < F.lit(1e6)) & (F.abs(x * scale - near) < F.lit(0.499))
    return F.when(plain, near / scale + F.lit(0.0)).otherwise(F.round(x, DIGITS))


def rounded(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Round computed doubles for comparison; ``keep`` names exact columns."""
    if not COMPARABLE:
        return df
    keep = keep or ["stars"]
    return df.select(
        *[
            round_half_up(F.col(name) + F.lit(TIE)).alias(name) if kind == "double" and name not in keep else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def staged_train(spark: SparkSession, sf: str) -> DataFrame:
    return stage(views.train(spark, sf), "train")


def global_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.global_mean(views.train(spark, sf)))


def _key_stats(key: str):
    return lambda spark, sf: rounded(stats.key_stats(views.train(spark, sf), key))


def _distribution(key: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        dist = stats.rating_distribution(views.train(spark, sf), key)
        return rounded(stats.distribution_stats(dist, key, keep=[c for c in dist.columns if c not in (key, "cnt", "min", "max")]))

    return query


def _loo(key: str, prefix: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = leave_one_out(staged_train(spark, sf), key, prefix)
        return rounded(out.select(key, "stars", "seq", *[f"{prefix}_{n}" for n in STAT_NAMES]))

    return query


def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    return last_ratings(views.train(spark, sf))


def cf_means(spark: SparkSession, sf: str) -> DataFrame:
    matrix = stage(rating_matrix(views.train(spark, sf)), "matrix")

    def side(key: str, name: str) -> DataFrame:
        means = matrix_means(matrix, key, name)
        return means.select(
            F.lit(name).alias("side"), F.col(key).alias("id"), F.get(f"{name}_means", F.lit(0)).alias("mean"),
            F.col(f"{name}_pairs").alias("pairs"),
        )

    return rounded(side("user_id", "user").unionByName(side("item_id", "item")))


def corater_counts(spark: SparkSession, sf: str) -> DataFrame:
    matrix = stage(rating_matrix(views.train(spark, sf)), "matrix")
    return corater_sums(matrix)


def item_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(similar_items(stage(rating_matrix(views.train(spark, sf)), "matrix")))


def topk_similar_items(spark: SparkSession, sf: str) -> DataFrame:
    matrix = stage(rating_matrix(views.train(spark, sf)), "matrix")
    return rounded(top_similar(similar_items(matrix, CfParams(min_abs_sim=LOOSE)), 5))


def _score(params: CfParams):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        train, test = views.train_and_test(spark, sf)
        return rounded(score_cf(test, fit_cf(train, params, targets=test)))

    return query


def _out_of_fold(params: CfParams):
    return lambda spark, sf: rounded(out_of_fold_cf(staged_train(spark, sf), views.FOLDS, params))


def bias_proxy_train(spark: SparkSession, sf: str) -> DataFrame:
    train = staged_train(spark, sf)
    return rounded(bias_scores(train, train, True).select("user_id", "item_id", "seq", "cf_pred", "n_neighbours"))


def bias_proxy_test(spark: SparkSession, sf: str) -> DataFrame:
    train, test = views.train_and_test(spark, sf)
    out = bias_scores(test, train, False)
    return rounded(out.select("user_id", "item_id", "seq", "cf_pred", "n_neighbours"))


def shrunk_means(spark: SparkSession, sf: str) -> DataFrame:
    """Every smoothed mean of users and items, with profile priors where there is a profile."""
    train = staged_train(spark, sf)
    known = views.all_profiles(spark, sf, rich=True)

    def side(name: str, key: str, people: DataFrame, prior: str, reviews: str, strength: int, extra: tuple[int, int]) -> DataFrame:
        table = stats.with_global_mean(stats.key_stats(train, key).join(people.select(key, prior, reviews), key, "full_outer"), train)
        g = F.col("global_mean")
        cnt, avg = F.coalesce("cnt", F.lit(0)), F.coalesce("avg", g)
        prior_mean = F.coalesce(prior, g)
        profile_mean = shrink(prior_mean, F.coalesce(reviews, F.lit(0)), g, 8)
        return table.select(
            F.lit(name).alias("side"), F.col(key).alias("id"), cnt.alias("cnt"), profile_mean.alias("profile_mean"),
            warm_or_cold(cnt, shrink(avg, cnt, prior_mean, strength), profile_mean).alias("final_mean"),
            confidence(cnt, strength).alias("confidence"),
            shrink(avg, cnt, prior_mean, extra[0]).alias("light_mean"), shrink(avg, cnt, prior_mean, extra[1]).alias("heavy_mean"),
        )

    users = side("user", "user_id", known.users, "average_stars", "review_count", 12, (5, 15))
    items = side("item", "item_id", known.items, "item_stars", "item_review_count", 32, (10, 35))
    return rounded(users.unionByName(items))


def profile_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.parse_users(views.user_lines(spark, sf)))


def users_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same through text files: written by Spark, scanned, parsed, last line per user kept."""
    path = fresh_path(spark, "user-lines")
    views.user_lines(spark, sf).select("value").write.text(path)
    return rounded(profiles.read_users(spark, path))


def ratings_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings through the CSV sink and scan; the position in the files must come back dense."""
    path = fresh_path(spark, "ratings")
    rows = views.train(spark, sf).select("user_id", F.col("item_id").alias("business_id"), "stars")
    rows.write.option("header", True).csv(path)
    indexed = stage(files.with_row_index(files.read_ratings(spark, path)), "indexed")
    per_pair = indexed.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.sum("stars").alias("stars_sum"))
    return per_pair.withColumns(
        {
            "positions": indexed.agg(F.count_distinct("row_index")).scalar(),
            "last_position": indexed.agg(F.max("row_index")).scalar(),
        }
    )


def predictions_to_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bias predictions of the test rows through the prediction sink and back."""
    path = fresh_path(spark, "predictions")
    train, test = views.train_and_test(spark, sf)
    scored = bias_scores(test, train, False)
    files.write_predictions(scored.withColumn("prediction", F.round(F.col("cf_pred") + F.lit(TIE), 4)), path, order_by="seq")
    back = spark.read.schema("user_id BIGINT, business_id BIGINT, prediction DOUBLE").csv(path, header=True)
    return back.groupBy("user_id", "business_id").agg(F.count("*").alias("n"), F.max("prediction").alias("prediction"))


def pairs_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs to predict through CSV, with lines that are too short among them."""
    return files.read_pairs(spark, _odd_pairs(spark, sf)).groupBy("user_id", "item_id").agg(F.count("*").alias("n"))


def _odd_pairs(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "pairs")
    names = ["user_id", "business_id"]
    pairs = views.train_and_test(spark, sf)[1].select(*(F.col(c).cast("string").alias(n) for c, n in zip(("user_id", "item_id"), names)))
    # One more header among the lines is dropped by the reader, as are lines that are too short.
    header = spark.range(1).select(*(F.lit(n).alias(n) for n in names))
    pairs.unionByName(header).write.option("header", True).csv(path)
    pairs.select("user_id").write.mode("append").option("header", True).csv(path)
    return path


def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What the scans leave out, line by line, and how many lines they accept: user and item records and pairs through files."""

    def written(name: str, lines: DataFrame) -> str:
        path = fresh_path(spark, name)
        lines.select("value").write.text(path)
        return path

    sifted = {
        "pairs": quarantine.sift_pairs(spark, _odd_pairs(spark, sf)),
        "users": quarantine.sift_json_lines(spark, written("user-lines", views.user_lines(spark, sf))),
        "items": quarantine.sift_json_lines(spark, written("item-lines", views.item_lines(spark, sf))),
    }
    out = None
    for name, parts in sifted.items():
        taken = parts.accepted.groupBy().agg(F.count("*").alias("n")).select(
            F.lit(name).alias("source"), F.lit("accepted").alias("reason"), F.lit(None).cast("string").alias("line"), "n"
        )
        left = parts.rejected.groupBy("reason", "line").agg(F.count("*").alias("n"))
        both = taken.unionByName(left.select(F.lit(name).alias("source"), "reason", "line", "n"))
        out = both if out is None else out.unionByName(both)
    return out


def _through_files(lines, read):
    """Records through text files: written by Spark, scanned and parsed."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = fresh_path(spark, "records")
        lines(spark, sf).select("value").write.text(path)
        return rounded(read(spark, path))

    return query


def fold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Folds by place in the file: a CSV written in order, scanned, numbered and dealt."""
    path = fresh_path(spark, "ordered")
    rows = staged_train(spark, sf).orderBy("seq", "item_id", "stars").select("user_id", F.col("item_id").alias("business_id"), "stars")
    rows.write.option("header", True).csv(path)
    indexed = stage(files.with_row_index(stage(files.read_ratings(spark, path), "read")), "indexed")
    return assign_folds(indexed, views.FOLDS).groupBy("user_id", "item_id", "fold").agg(F.count("*").alias("n"))


def attribute_codes(spark: SparkSession, sf: str) -> DataFrame:
    items = profiles.parse_items(views.item_lines(spark, sf))
    names = ["item_id", "item_stars", "item_review_count", "latitude", "longitude", "is_open", "price"]
    return rounded(items.select(*names, "alcohol", "kids", "outdoor", "noise", "wifi", "tv", "attire"))


def weekly_hours(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.parse_items(views.item_lines(spark, sf)).select("item_id", "weekly_hours", "weekend_open"))


PART_WORDS = ["ring", "widget", "bolt", "gear", "gizmo", "small", "red", "blue", "hot"]


def category_flags(spark: SparkSession, sf: str) -> DataFrame:
    words = F.replace(F.concat_ws(" , ", F.initcap("p_name"), "p_type"), F.lit(" "), F.lit(", "))
    parts = views.table(spark, sf, "part").select("p_partkey", words.alias("words"))
    flags = enc.category_flags(F.col("words"), PART_WORDS)
    return parts.select("p_partkey", enc.category_count(F.col("words")).alias("category_count"), *flags)


def item_categories(spark: SparkSession, sf: str) -> DataFrame:
    items = profiles.parse_items(views.item_lines(spark, sf))
    return items.select("item_id", "category_count", *[c for c in items.columns if c.startswith("cat_")])


def _checkins(strict: bool):
    return lambda spark, sf: rounded(profiles.parse_checkins(views.checkin_lines(spark, sf), strict_keys=strict))


def _tips(key: str, prefix: str):
    return lambda spark, sf: profiles.tip_stats(profiles.parse_tips(views.tip_lines(spark, sf)), key, prefix)


def photo_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.photo_counts(profiles.parse_photos(views.photo_lines(spark, sf)))


def _features(rich: bool, train_side: bool):
    """Feature rows as the jobs make them."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        small_methods(spark)
        train, test = views.train_and_test(spark, sf)
        prepared = jobs.prepare(train, test, views.all_profiles(spark, sf, rich), rich)
        rows = (jobs.train_vectors if train_side else jobs.test_vectors)(prepared)
        values = rows.select("user_id", "item_id", "seq", vector_to_array("features").alias("values"))
        names = RICH_FEATURES if rich else STACKED_FEATURES
        columns = [F.get("values", F.lit(i)).alias(name) for i, name in enumerate(names)]
        return rounded(values.select("user_id", "item_id", "seq", *columns), ["seq"])

    return query


def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration line of the bias estimate on the test rows, and the fixed expansion of its extremes."""
    train, test = views.train_and_test(spark, sf)
    g = F.col("global_mean")
    expanded = calibrated(F.col("cf_pred"), g)
    scored = stage(stats.with_global_mean(bias_scores(test, train, False), train), "scored")
    line = fit_calibration(scored, g, prediction="cf_pred")
    ends = {"lowest": F.min(expanded), "highest": F.max(expanded), "mean": F.avg(expanded)}
    return rounded(line.withColumns({name: scored.agg(value).scalar() for name, value in ends.items()}))


def rmse_ladder(spark: SparkSession, sf: str) -> DataFrame:
    train, test = views.train_and_test(spark, sf)
    cf = score_cf(test, fit_cf(train, targets=test)).withColumnRenamed("cf_pred", "item_cf").drop("n_neighbours")
    rows = bias_scores(attach_scores(test, cf), train, False).withColumnRenamed("cf_pred", "bias_estimate")
    rows = stats.with_global_mean(rows, train)
    return rounded(evaluation.rmse_ladder(rows, "stars", ["global_mean", "bias_estimate", "item_cf"]))


def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    train, test = views.train_and_test(spark, sf)
    cf = score_cf(test, fit_cf(train, targets=test))
    return evaluation.error_histogram(attach_scores(test, cf).withColumn("p", F.round("cf_pred", 9)), "stars", "p")


SPLIT_FEATURES = ["line", "part_group", "segment"]


def _few_valued(rows: DataFrame) -> DataFrame:
    """Ratings with a vector of three features of few values, by which no two splits part the rows alike."""
    line = F.floor(F.col("seq") % 2**24 / 2**21)
    part = F.floor(F.col("seq") % 2**21)
    features = [line, part % 5, F.col("user_id") % 11]
    named = rows.withColumns({name: x.cast("double") for name, x in zip(SPLIT_FEATURES, features)})
    return named.withColumn("features", array_to_vector(F.array(*SPLIT_FEATURES)))


def boosted_one_split(spark: SparkSession, sf: str) -> DataFrame:
    """A model of one tree of depth one: the best of all splits, and the mean stars of its two sides."""
    rows = stage(_few_valued(views.train(spark, sf)).select(*SPLIT_FEATURES, "stars", "features"), "few-valued")
    model = fit_boosting(rows, BoostingParams(trees=1, depth=1), staged=False)
    out = model.predict(rows).groupBy(*SPLIT_FEATURES).agg(F.count("*").alias("n"), F.avg("raw_prediction").alias("raw_prediction"))
    value = calibrated(F.col("raw_prediction"), F.lit(model.centre))
    return rounded(out.withColumns({"clamped": clamped(), "calibrated": value}))


def _additive(trees: int):
    """Trees of depth one with penalised leaves, all of them shrunk, from a start value that is not the mean."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = stage(_few_valued(views.train(spark, sf)).select(*SPLIT_FEATURES, "stars", "features"), "few-valued")
        model = fit_additive(rows, AdditiveParams(trees=trees, depth=1, learning_rate=0.5, l1=40.0, l2=25.0), start=2.5)
        return rounded(model.predict(rows).groupBy(*SPLIT_FEATURES).agg(F.count("*").alias("n"), F.avg("raw_prediction").alias("raw_prediction")))

    return query


CONTRACT_BOOSTING = BoostingParams(trees=20, depth=4, learning_rate=0.1, row_share=0.8, min_rows_per_leaf=10)


def boosted_contract(spark: SparkSession, sf: str) -> DataFrame:
    """What any right model of these settings must meet, in one row: every test pair predicted once, within the stars, and
    the training error not above that of the mean."""
    train, test = (_few_valued(x) for x in views.train_and_test(spark, sf))
    train = stage(train.select("stars", "features"), "few-valued")
    model = fit_boosting(train, CONTRACT_BOOSTING, staged=False)
    scored = model.predict(test).select("user_id", "item_id", "seq", "stars", clamped().alias("p"))
    keys = test.agg(F.sum(F.xxhash64("user_id", "item_id", "seq").cast("decimal(38,0)")).alias("k")).scalar()
    error = model.predict(train).agg(
        F.avg((F.col("stars") - F.col("raw_prediction")) ** 2) <= F.avg((F.col("stars") - F.lit(model.centre)) ** 2)
    ).scalar()
    return scored.agg(
        F.count("*").alias("rows"), (F.sum(F.xxhash64("user_id", "item_id", "seq").cast("decimal(38,0)")) == keys).alias("keys_kept"),
        F.coalesce(F.bool_and((F.col("p") >= 1) & (F.col("p") <= 5)), F.lit(True)).alias("within_stars"),
        F.count_if(F.col("p").isNull()).alias("missing"),
    ).withColumn("no_worse_than_mean", error)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "global_mean": global_mean,
    "user_stats": _key_stats("user_id"),
    "item_stats": _key_stats("item_id"),
    "user_rating_distribution": _distribution("user_id"),
    "item_rating_distribution": _distribution("item_id"),
    "loo_user_stats": _loo("user_id", "user"),
    "loo_item_stats": _loo("item_id", "item"),
    "dedupe_last": dedupe_last,
    "cf_means": cf_means,
    "corater_counts": corater_counts,
    "item_similarity": item_similarity,
    "topk_similar_items": topk_similar_items,
    "cf_score_test": _score(CfParams()),
    "cf_score_topk3": _score(CfParams(neighbours=3, min_abs_sim=LOOSE)),
    "cf_score_loose": _score(CfParams(min_abs_sim=LOOSE)),
    "cf_score_k20": _score(CfParams(neighbours=20, min_abs_sim=LOOSE)),
    "cf_out_of_fold": _out_of_fold(CfParams()),
    "cf_out_of_fold_loose": _out_of_fold(CfParams(min_abs_sim=LOOSE)),
    "fold_assignment": fold_assignment,
    "bias_proxy_train": bias_proxy_train,
    "bias_proxy_test": bias_proxy_test,
    "shrunk_means": shrunk_means,
    "profile_scalars": profile_scalars,
    "users_from_files": users_from_files,
    "ratings_from_files": ratings_from_files,
    "predictions_to_files": predictions_to_files,
    "pairs_from_files": pairs_from_files,
    "rejected_lines": rejected_lines,
    "items_from_files": _through_files(views.item_lines, profiles.read_items),
    "checkins_from_files": _through_files(views.checkin_lines, profiles.read_checkins),
    "item_tips_from_files": _through_files(views.tip_lines, lambda spark, path: profiles.tip_stats(profiles.read_tips(spark, path), "item_id", "item")),
    "photos_from_files": _through_files(views.photo_lines, lambda spark, path: profiles.photo_counts(profiles.read_photos(spark, path))),
    "attribute_codes": attribute_codes,
    "weekly_hours": weekly_hours,
    "category_flags": category_flags,
    "item_categories": item_categories,
    "checkin_ratios": _checkins(True),
    "checkin_totals": _checkins(False),
    "user_tip_stats": _tips("user_id", "user"),
    "item_tip_stats": _tips("item_id", "item"),
    "photo_counts": photo_counts,
    "features_stacked_train": _features(False, True),
    "features_stacked_test": _features(False, False),
    "features_rich_train": _features(True, True),
    "features_rich_test": _features(True, False),
    "calibrate": calibrate,
    "rmse_ladder": rmse_ladder,
    "error_histogram": error_histogram,
    "boosted_one_split": boosted_one_split,
    "boosted_penalised_leaves": _additive(1),
    "boosted_shrunk_trees": _additive(3),
    "boosted_contract": boosted_contract,
}
