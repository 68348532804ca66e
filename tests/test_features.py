"""Feature rows, boosting, evaluation and the two jobs, on hand-made files."""

from __future__ import annotations

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from starloom.functions.rating import clamp
from starloom.operators import boosting, evaluation
from starloom.operators.additive import AdditiveParams
from starloom.operators.boosting import BoostingParams, fit_boosting, fit_calibration
from starloom.operators.features import RICH_FEATURES, STACKED_FEATURES, assemble, item_table, user_table, with_entities
from starloom.plans import jobs
from starloom.plans.jobs import InputFiles, predict_files, read_profiles
from starloom.session import COMPILED_BYTES, METHOD_LIMIT, small_methods
from starloom.sources import files
from workload import queries, views

BOOSTING = BoostingParams(trees=3, depth=3, min_rows_per_leaf=5)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Ratings with user and item effects, and profiles for most of them."""
    rng = random.Random(7)
    path = tmp_path_factory.mktemp("input")
    mood = {f"u{k}": rng.uniform(-1.2, 1.2) for k in range(40)}
    level = {f"b{k}": rng.uniform(-1.0, 1.0) for k in range(15)}
    pairs = sorted({(rng.choice(list(mood)), rng.choice(list(level))) for _ in range(900)})
    rng.shuffle(pairs)
    stars = {p: min(5, max(1, round(3.3 + mood[p[0]] + level[p[1]] + rng.gauss(0, 0.4)))) for p in pairs}
    train, test = pairs[:340], pairs[340:] + [("u0", "new"), ("new", "b0"), ("new", "new")]
    write = lambda name, lines: (path / name).write_text("\n".join(lines) + "\n")
    write("train.csv", ["user_id,business_id,stars", *[f"{u},{b},{stars[u, b]}" for u, b in train]])
    write("pairs.csv", ["user_id,business_id", *[f"{u},{b}" for u, b in test]])
    write("user.json", [json.dumps({"user_id": u, "average_stars": 3.0, "review_count": k, "fans": k % 3, "yelping_since": "2010-01-01", "friends": "a,b", "elite": "None"}) for k, u in enumerate(list(mood)[:35])])
    write("business.json", [json.dumps({"business_id": b, "stars": 3.5, "review_count": 5, "categories": "Pizza, Bars", "attributes": {"NoiseLevel": "loud", "RestaurantsPriceRange2": "2"}, "hours": {"Saturday": "9:0-17:30"}}) for b in list(level)[:13]])
    write("checkin.json", [json.dumps({"business_id": b, "time": {"Sat-18": 3, "Mon-9": 1, "bad": 2}}) for b in list(level)[:10]])
    write("tip.json", [json.dumps({"user_id": "u1", "business_id": "b1", "likes": 2})] * 3)
    write("photo.json", [json.dumps({"business_id": "b1"})] * 4)
    return str(path), {p: stars.get(p) for p in test}, test


def test_stacked_vectors_of_ratings_without_neighbours(spark, folder):
    """Items b0 and b1 are similar without fold 1, where the one pair of b0 is of a user who rated nothing else."""
    rows = [(f"u{k}", item, float(1 + k % 5), 2 * k + place, 0) for k in range(12) for place, item in enumerate(["b0", "b1"])]
    rows.append(("alone", "b0", 4.0, 100, 1))
    ratings = spark.createDataFrame(rows, "user_id string, item_id string, stars double, seq bigint, fold int")
    prepared = jobs.prepare(ratings, ratings.select("user_id", "item_id", "seq"), read_profiles(spark, InputFiles(folder[0]), False), False, "oof", folds=2)
    values = {(r.user_id, r.item_id): r.features for r in jobs.train_vectors(prepared).collect()}
    assert set(values) == {r[:2] for r in rows} and all(len(v) == len(STACKED_FEATURES) for v in values.values())


def rows_of(spark, folder, rich, held_out, cf="proxy"):
    source = InputFiles(folder)
    ratings = files.read_ratings(spark, source.path("ratings"))
    rows = ratings if held_out else files.read_pairs(spark, folder + "/pairs.csv")
    if cf == "columns":
        rows = rows.withColumns({"cf_pred": F.lit(4.0), "n_neighbours": F.lit(60)})
    known = read_profiles(spark, source, rich)
    joined = with_entities(rows, user_table(ratings, known, rich), item_table(ratings, known, rich))
    mean = ratings.agg(F.avg("stars")).scalar()
    keep = ["user_id", "item_id", *(["stars"] if held_out else [])]
    return ratings, assemble(joined, mean, rich, held_out, keep, cf)


def test_rich_training_features(spark, folder):
    ratings, features = rows_of(spark, folder[0], True, True)
    everything = ratings.collect()
    got = features.collect()
    assert features.columns[3:] == RICH_FEATURES and len(RICH_FEATURES) == 117 and len(STACKED_FEATURES) == 68
    assert len(got) == len(everything)
    g = sum(r.stars for r in everything) / len(everything)
    for r in got[::29]:
        mine = [x.stars for x in everything if x.user_id == r.user_id and x.item_id != r.item_id]
        theirs = [x.stars for x in everything if x.item_id == r.item_id and x.user_id != r.user_id]
        has_user, has_item = int(r.user_id[1:]) < 35, int(r.item_id[1:]) < 13
        u, b = sum(mine) / len(mine), sum(theirs) / len(theirs)
        uf = (sum(mine) + 12 * (3.0 if has_user else g)) / (len(mine) + 12)
        bf = (sum(theirs) + 32 * (3.5 if has_item else g)) / (len(theirs) + 32)
        assert (r.user_mean, r.item_mean) == pytest.approx((uf, bf))
        assert r.cf_pred == pytest.approx(max(1, min(5, u + b - g))) and r.n_neighbours == 0
        assert r.user_range == max(mine) - min(mine)
        assert r.user_five_rate == pytest.approx(mine.count(5) / len(mine))
        assert r.user_one_x_item_low == pytest.approx(mine.count(1) / len(mine) * sum(x <= 2 for x in theirs) / len(theirs))
        assert r.log_item_cnt == pytest.approx(math.log1p(len(theirs)))
        assert (r.noise, r.price, r.is_open, r.weekly_hours, r.cat_17, r.cat_04) == ((2, 2, 1, 8.5, 1, 1) if has_item else (-1, 0, 1, 0, 0, 0))
        assert r.account_years == (9 if has_user else 4)
        assert (r.evening_ratio, r.log_checkins) == ((0.75, math.log1p(4)) if int(r.item_id[1:]) < 10 else (0, 0))
        assert r.item_tip_likes == (6 if r.item_id == "b1" else 0)


def test_cold_pairs_and_given_scores(spark, folder):
    ratings, features = rows_of(spark, folder[0], False, False, "columns")
    g = ratings.agg(F.avg("stars")).first()[0]
    got = {(r.user_id, r.item_id): r for r in features.collect()}
    both = got["new", "new"]
    assert (both.user_mean, both.item_mean, both.user_cold, both.item_cold, both.user_range) == (g, g, 1, 1, 0)
    assert (both.cf_pred, both.n_neighbours, both.cf_conf, both.account_years) == (4.0, 60, 1.0, 4)
    assert both.cf_minus_user == pytest.approx(4.0 - g)
    assert max(r.log_checkins for r in got.values()) == pytest.approx(math.log1p(6))


def test_leave_one_out_needs_rich_tables(spark, folder):
    with pytest.raises(ValueError):
        rows_of(spark, folder[0], False, True)


def made_so_far(spark):
    from pathlib import Path

    from starloom.session import shared_folder

    return {str(p) for p in Path(shared_folder(spark)).glob("*")}


@pytest.mark.parametrize("job,options", [("stacked", {}), ("stacked", {"by_file_order": False}), ("rich", {}), ("rich", {"cf": "oof"})])
def test_jobs_end_to_end(spark, folder, tmp_path, job, options):
    path, truth, order = folder
    out = str(tmp_path / "out")
    before = made_so_far(spark)
    boosting = BoostingParams(trees=8, depth=3, learning_rate=0.3, min_rows_per_leaf=5)
    result = predict_files(spark, InputFiles(path), path + "/pairs.csv", out, job, boosting, **options)
    assert result.count() == len(order)
    # What is left is the trees' own checkpoint folder at most.
    assert not [p for p in made_so_far(spark) - before if any(Path(p).rglob("*.parquet"))]
    text = [line for p in sorted((tmp_path / "out").glob("part-*.csv")) for line in p.read_text().splitlines()[1:]]
    assert [tuple(line.split(",")[:2]) for line in text] == order
    predicted = {tuple(line.split(",")[:2]): float(line.split(",")[2]) for line in text}
    assert all(1.0 <= v <= 5.0 for v in predicted.values())
    known = [p for p, s in truth.items() if s is not None]
    g = files.read_ratings(spark, path + "/train.csv").agg(F.avg("stars")).first()[0]
    error = lambda f: math.sqrt(sum((truth[p] - f(p)) ** 2 for p in known) / len(known))
    assert error(predicted.get) < 0.85 * error(lambda _: g)


def test_job_with_penalised_trees(spark, folder, tmp_path):
    path, truth, order = folder
    params = AdditiveParams(trees=6, depth=3, learning_rate=0.4, l1=0.5, l2=1.0, tree_columns=0.8, min_rows_per_leaf=5)
    result = predict_files(spark, InputFiles(path), path + "/pairs.csv", str(tmp_path / "out"), "rich", params)
    assert result.count() == len(order)
    text = [line.split(",") for p in sorted((tmp_path / "out").glob("part-*.csv")) for line in p.read_text().splitlines()[1:]]
    predicted = {tuple(x[:2]): float(x[2]) for x in text}
    known = [p for p, s in truth.items() if s is not None]
    g = files.read_ratings(spark, path + "/train.csv").agg(F.avg("stars")).first()[0]
    error = lambda f: math.sqrt(sum((truth[p] - f(p)) ** 2 for p in known) / len(known))
    assert error(predicted.get) < 0.95 * error(lambda _: g)


def test_vectors_of_the_jobs(spark, folder):
    source = InputFiles(folder[0])
    ratings = files.with_row_index(files.read_ratings(spark, source.path("ratings")))
    ratings = ratings.withColumn("seq", F.col("row_index")).drop("row_index")
    pairs = files.read_pairs(spark, folder[0] + "/pairs.csv")
    for rich, size in ((False, 68), (True, 117)):
        prepared = jobs.prepare(ratings, pairs, read_profiles(spark, source, rich), rich)
        train, test = jobs.train_vectors(prepared), jobs.test_vectors(prepared)
        assert train.count() == ratings.count() and test.count() == pairs.count()
        assert train.first()["features"].size == test.first()["features"].size == size
    with pytest.raises(ValueError):
        jobs.prepare(ratings, pairs, read_profiles(spark, source, False), False, "proxy")


def test_submitted_job(spark, folder, tmp_path, monkeypatch):
    from starloom import __main__ as command

    monkeypatch.setattr(command, "build_session", lambda name: spark)
    asked = {}
    monkeypatch.setattr(command, "predict_files", lambda *a, **k: asked.update(files=a[1:], options=k))
    command.main([folder[0], "pairs.csv", str(tmp_path / "out"), "--job", "stacked"])
    assert asked == {"files": (InputFiles(folder[0]), "pairs.csv", str(tmp_path / "out"), "stacked"), "options": {}}
    command.main([folder[0], "pairs.csv", str(tmp_path / "out"), "--cf", "oof"])
    assert asked["files"][3] == "rich" and asked["options"] == {"cf": "oof"}


def test_boosting_starts_from_the_mean(spark, folder):
    _, features = rows_of(spark, folder[0], True, True)
    from pyspark.ml.functions import array_to_vector

    vectors = features.select("stars", array_to_vector(F.array(*RICH_FEATURES)).alias("features"))
    model = fit_boosting(vectors, BOOSTING)
    assert model.centre == pytest.approx(features.agg(F.avg("stars")).first()[0])
    assert model.predict(vectors).columns == ["stars", "features", "raw_prediction"]


def test_calibration_and_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (2.0, 5.0)], "stars double, raw_prediction double")
    line = fit_calibration(df.where("raw_prediction < 5"), F.lit(3.0)).first()
    assert (line.slope, line["shift"]) == pytest.approx((2.0, 0.0))
    ladder = {r.model: r.rmse for r in evaluation.rmse_ladder(df.withColumn("flat", F.lit(3.0)), "stars", ["raw_prediction", "flat"]).collect()}
    assert ladder == pytest.approx({"raw_prediction": math.sqrt(11 / 4), "flat": math.sqrt(9 / 4)})
    bands = {r.band: r.n for r in evaluation.error_histogram(df, "stars", "raw_prediction").collect()}
    assert bands == {"below 1": 1, "1 to 2": 2, "above 3": 1}


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(0.2,), (None,), (7.0,), (3.5,)], "x double")
    assert [r.y for r in df.select(clamp("x").alias("y")).collect()] == [1.0, None, 5.0, 3.5]


def test_training_rows_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 20)
    most, fit = [], GBTRegressor.fit

    def seen(self, data):
        most.append(data.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return fit(self, data)

    monkeypatch.setattr(GBTRegressor, "fit", seen)
    rows = spark.createDataFrame([(float(i % 5), Vectors.dense([float(i % 5)])) for i in range(400)], ["stars", "features"]).coalesce(1)
    model = fit_boosting(rows, BoostingParams(trees=1, depth=3), staged=False)
    assert most[0] <= 21
    assert model.predict(rows).where("abs(raw_prediction - stars) > 1e-9").isEmpty()


def test_arithmetic_rounding_is_that_of_decimal_text(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 0.1234565, 1.0000005, 999999.9999995, 1e6, 1e15, 1e300, math.inf, -math.inf, math.nan, None, 5e-324]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-9, 8) for _ in range(3000)]
    values += [(2 * rng.randrange(-(10**9), 10**9) + 1) / 2e6 for _ in range(1000)]  # half-way, or next to it
    df = spark.createDataFrame([(x,) for x in values], "x DOUBLE")
    same = queries.round_half_up(F.col("x")).eqNullSafe(F.round("x", queries.DIGITS))
    assert df.where(~same).collect() == []
    assert "CASE WHEN" in queries.rounded(df)._jdf.queryExecution().analyzed().toString()


def test_method_limit_is_lowered_only(spark):
    before = spark.conf.get(METHOD_LIMIT)
    try:
        for given, kept in (("65535", COMPILED_BYTES), ("4000", "4000")):
            spark.conf.set(METHOD_LIMIT, given)
            small_methods(spark)
            assert spark.conf.get(METHOD_LIMIT) == kept
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def test_lines_of_one_file_are_parsed_by_several_tasks(spark):
    lines = spark.range(500).select(F.col("id").cast("string").alias("value"), F.struct("id").alias("seq")).coalesce(1)
    spread = views._spread(lines)
    assert spread.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(spread.collect()) == sorted(lines.collect())
