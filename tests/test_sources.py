"""Tolerant scans: every hand-written edge case of the input files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from starloom.operators.scoring import assign_folds
from starloom.sources import files, profiles, quarantine


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_ratings_csv(spark, tmp_path):
    path = write(
        tmp_path,
        "r.csv",
        ["user_id,business_id,stars", "u1,b1,5", "user_id,business_id,stars", "u1,b1,abc", "", "u2,b2,1d", "u3", "u4,b4, 1_0.5e0 ", "u5,,2", "u6,b6", "u7,b7,", "u8,b8,3,more"],
    )
    rows = [(r.user_id, r.item_id, r.stars) for r in files.read_ratings(spark, path).orderBy("seq").collect()]
    assert rows == [("u1", "b1", 5.0), ("u1", "b1", 0.0), ("u2", "b2", 0.0), ("u4", "b4", 10.5), ("u5", "", 2.0), ("u7", "b7", 0.0), ("u8", "b8", 3.0)]
    # A line without the third field is no rating of 0.0; an empty third field is one.
    assert files.short_lines(spark, path).first().n == 2
    with pytest.raises(Exception):
        files.read_ratings(spark, path, strict=True).collect()


def test_pairs_ignore_extra_columns(spark, tmp_path):
    path = write(tmp_path, "p.csv", ["user_id,business_id,stars", "u1,b1,5", "u2,b2,4"])
    rows = [(r.user_id, r.item_id) for r in files.read_pairs(spark, path).orderBy("seq").collect()]
    assert rows == [("u1", "b1"), ("u2", "b2")]


def test_folds_do_not_depend_on_the_split(spark, tmp_path):
    path = write(tmp_path, "r.csv", ["user_id,business_id,stars", *[f"u{i % 97},b{i % 31},{i % 5 + 1}" for i in range(4000)]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("2048", "1048576"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        ratings = files.read_ratings(spark, path)
        hashed = assign_folds(ratings, 5).groupBy("user_id", "item_id", "stars", "fold").count().collect()
        placed = assign_folds(files.with_row_index(ratings), 5).select("row_index", "fold").collect()
        found.append((sorted(hashed), sorted(placed)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and [r.fold for r in found[0][1]] == [i % 5 for i in range(4000)]


def test_row_index_follows_file_order_over_many_blocks(spark, tmp_path):
    lines = [f"u{i},b{i % 7},{i % 5 + 1}" for i in range(5000)]
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, "part-0.csv", ["user_id,business_id,stars", *lines[:3000]])
    write(folder, "part-1.csv", ["user_id,business_id,stars", *lines[3000:]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        indexed = files.with_row_index(files.read_ratings(spark, str(folder))).repartition(5)
        rows = {r.row_index: r.user_id for r in indexed.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {i: f"u{i}" for i in range(5000)}


def test_users(spark, tmp_path):
    full = {
        "user_id": "full", "average_stars": 3.5, "review_count": 4, "fans": 2, "useful": 6, "funny": 1, "cool": True,
        "yelping_since": "2011-05-02", "compliment_hot": 3, "compliment_photos": "4", "compliment_plain": "x",
        "friends": "a,,b", "elite": "2012,2013",
    }
    path = write(
        tmp_path,
        "user.json",
        [
            full, "not json", [1], "5", {"user_id": "empty"},
            {"user_id": "odd", "average_stars": "abc", "review_count": 0, "fans": "3.0", "useful": "1d", "yelping_since": None, "friends": " ", "elite": "None"},
            {"user_id": "num", "review_count": 3.7, "fans": " 12 ", "useful": "1_000", "average_stars": "1e1", "friends": ["a", "b"], "elite": [], "yelping_since": 2013},
            {"user_id": "dup", "fans": 1}, {"user_id": "dup", "fans": 9}, {"fans": 7},
        ],
    )
    got = by_key(profiles.read_users(spark, path), "user_id")
    assert set(got) == {"full", "empty", "odd", "num", "dup", ""}
    f = got["full"]
    assert (f["average_stars"], f["review_count"], f["fans"], f["useful"], f["cool"]) == (3.5, 4, 2, 6, 1)
    assert (f["since_year"], f["compliments"], f["friend_count"], f["elite_count"]) == (2011, 7, 3, 2)
    assert (f["fans_per_review"], f["useful_per_review"]) == (0.5, 1.5)
    e = got["empty"]
    assert (e["average_stars"], e["since_year"], e["friend_count"], e["fans_per_review"]) == (0.0, 2000, 0, 0.0)
    o = got["odd"]
    assert (o["average_stars"], o["fans"], o["useful"], o["since_year"], o["friend_count"], o["elite_count"]) == (0.0, 0, 0, 2000, 0, 0)
    n = got["num"]
    assert (n["review_count"], n["fans"], n["useful"], n["average_stars"]) == (3, 12, 1000, 10.0)
    assert (n["friend_count"], n["elite_count"], n["since_year"]) == (2, 0, 2013)
    assert got["dup"]["fans"] == 9


ITEM_LINES = [
    {"business_id": "plain"},
    {
        "business_id": "full", "stars": 4.5, "review_count": 10, "latitude": "36.1", "longitude": -115.2, "is_open": 0,
        "categories": "Restaurants, Food ,, pizza",
        "attributes": {"RestaurantsPriceRange2": "2", "Alcohol": "full_bar", "GoodForKids": "True", "OutdoorSeating": "False",
                       "NoiseLevel": "very_loud", "WiFi": "free", "HasTV": "True", "RestaurantsAttire": "formal"},
        "hours": {"Monday": "11:0-21:0", "Friday": "22:0-2:30", "Tuesday": "0:0-0:0", "Sunday": "bad"},
    },
    {"business_id": "null", "is_open": None, "attributes": None, "hours": None, "categories": None},
    {"business_id": "bools", "attributes": {"GoodForKids": True, "Alcohol": False, "WiFi": True, "NoiseLevel": "?"}, "hours": [1]},
    {"business_id": "quoted", "attributes": {"WiFi": "u'no'", "Alcohol": "none"}, "hours": {"Saturday": 5, "Monday": "1:0-2:x", "Tuesday": "0:0-24:0"}},
    {"business_id": "badcat", "categories": ["Food"]},
    {"business_id": "poison", "attributes": {"NoiseLevel": {"a": 1}}},
    {"business_id": "dup", "stars": 1}, {"business_id": "dup", "stars": 2},
]


def test_items_rich(spark, tmp_path):
    got = by_key(profiles.read_items(spark, write(tmp_path, "b.json", ITEM_LINES)), "item_id")
    assert set(got) == {"plain", "full", "null", "bools", "quoted", "dup"}
    assert (got["plain"]["is_open"], got["null"]["is_open"], got["full"]["is_open"]) == (1, 0, 0)
    f = got["full"]
    assert (f["item_stars"], f["item_review_count"], f["latitude"], f["longitude"], f["price"]) == (4.5, 10, 36.1, -115.2, 2)
    assert f["category_count"] == 4
    assert [k for k, v in f.items() if k.startswith("cat_") and v == 1] == ["cat_01", "cat_02", "cat_17"]
    assert [f[c] for c in ["alcohol", "kids", "outdoor", "noise", "wifi", "tv", "attire"]] == [1, 1, 0, 3, 1, 1, 2]
    assert (f["weekly_hours"], f["weekend_open"]) == (14.5, 1)
    n = got["null"]
    assert [n[c] for c in ["alcohol", "kids", "outdoor", "noise", "wifi", "tv", "attire", "weekly_hours", "weekend_open"]] == [0, 0, 0, -1, 0, 0, 0, 0.0, 0]
    b = got["bools"]
    assert [b[c] for c in ["alcohol", "kids", "noise", "wifi", "weekly_hours"]] == [0, 0, -1, 1, 0.0]
    q = got["quoted"]
    assert [q[c] for c in ["alcohol", "wifi", "weekly_hours", "weekend_open"]] == [0, 1, 24.0, 1]
    assert got["dup"]["item_stars"] == 2.0


def test_items_basic_keeps_poisoned_records(spark, tmp_path):
    got = by_key(profiles.read_items(spark, write(tmp_path, "b.json", ITEM_LINES), rich=False), "item_id")
    assert set(got) == {"plain", "full", "null", "bools", "quoted", "dup", "badcat", "poison"}
    assert got["badcat"]["category_count"] == 0


def test_checkins(spark, tmp_path):
    path = write(
        tmp_path,
        "c.json",
        [
            {"business_id": "a", "time": {"Fri-17": 2, "Sat-3": 1, "bad": 5}},
            {"business_id": "b", "time": {"Mon-1": "x"}},
            {"business_id": "c", "time": {}}, {"business_id": "d"}, {"business_id": "e", "time": [1]},
            {"business_id": "f", "time": {"Fri--5": 2, "Sun-x": 1, "Sun- 30 ": 4, "bad": "x"}},
        ],
    )
    strict = by_key(profiles.read_checkins(spark, path), "item_id")
    assert set(strict) == {"a", "c", "d", "e", "f"}
    a = strict["a"]
    assert (a["checkins"], a["evening_ratio"], a["weekend_ratio"]) == (3.0, 2 / 3, 1 / 3)
    assert (strict["f"]["checkins"], strict["f"]["evening_ratio"], strict["f"]["weekend_ratio"]) == (4.0, 1.0, 1.0)
    assert strict["c"]["checkins"] == strict["d"]["checkins"] == strict["e"]["checkins"] == 0.0
    total = by_key(profiles.read_checkins(spark, path, strict_keys=False), "item_id")
    assert set(total) == {"a", "c", "d", "e"}
    assert total["a"]["checkins"] == 8.0


def test_tips_and_photos(spark, tmp_path):
    tips = profiles.read_tips(
        spark,
        write(tmp_path, "t.json", [{"user_id": "u", "business_id": "b", "likes": 2}, {"user_id": "u", "business_id": "c", "likes": None}, "x"]),
    )
    assert by_key(profiles.tip_stats(tips, "user_id", "user"), "user_id")["u"] == {"user_id": "u", "user_tips": 2, "user_tip_likes": 2}
    photos = profiles.read_photos(spark, write(tmp_path, "f.json", [{"business_id": "b"}, {"business_id": "b"}, {"x": 1}]))
    assert {r.item_id: r.photos for r in profiles.photo_counts(photos).collect()} == {"b": 2, "": 1}


def test_prediction_sink_keeps_order(spark, tmp_path):
    df = spark.range(100).select(
        F.concat(F.lit("u"), F.col("id")).alias("user_id"), F.lit("b").alias("item_id"), (F.col("id") * 1.0).alias("prediction"), F.col("id").alias("pos")
    ).repartition(3)
    out = str(tmp_path / "out")
    files.write_predictions(df, out, order_by="pos")
    back = spark.read.csv(out, header=True, inferSchema=True)
    assert back.columns == ["user_id", "business_id", "prediction"]
    text = [p.read_text().splitlines()[1:] for p in sorted((tmp_path / "out").glob("part-*.csv"))]
    assert [line.split(",")[0] for part in text for line in part] == [f"u{i}" for i in range(100)]


def test_pairs_query_reads_no_file_as_one_row(spark, monkeypatch):
    from pyspark.sql import DataFrameReader

    from workload import queries

    whole = []
    text = DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **k: whole.append(k.get("wholetext")) or text(self, *a, **k))
    assert queries.pairs_from_files(spark, "/root/testdata/sf0.001").count() > 0
    assert True not in whole


def test_rejected_lines_and_accepted_ones_make_up_the_files(spark, tmp_path):
    ratings = tmp_path / "ratings"
    ratings.mkdir()
    (ratings / "a.csv").write_text("user_id,business_id,stars\nu,i,3.0\nu\nuser_id,business_id,stars\n,i,x\nu,i,2,more\n")
    (ratings / "b.csv").write_text("user_id,business_id,stars\nv,j,\nv,j\n")
    sifted = quarantine.sift_ratings(spark, str(ratings))
    names = ["user_id", "item_id", "stars"]
    plain = files.read_ratings(spark, str(ratings))
    assert sifted.accepted.columns == plain.columns
    assert sorted(map(tuple, sifted.accepted.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))
    got = {(r.line, r.reason, r.file.rsplit("/", 1)[1], r.block) for r in sifted.rejected.collect()}
    assert got == {
        ("u", "too few fields", "a.csv", 0), ("user_id,business_id,stars", "repeated header", "a.csv", 0), ("v,j", "too few fields", "b.csv", 0),
    }
    assert sifted.accepted.count() + sifted.rejected.count() == 7

    users = tmp_path / "users.json"
    users.write_text('{"user_id": "a", "fans": 1}\n[1]\n\n{"user_id": \n{"user_id": "a", "fans": 2}\n  {"user_id": "b"}\n"x"\n')
    sifted = quarantine.sift_json_lines(spark, str(users))
    assert sorted((r.line, r.reason) for r in sifted.rejected.collect()) == [
        ("", "not an object"), ('"x"', "not an object"), ("[1]", "not an object"), ('{"user_id": ', "broken JSON"),
    ]
    assert {(r.user_id, r.fans) for r in profiles.parse_users(sifted.accepted).collect()} == {("a", 2), ("b", 0)}

    empty = tmp_path / "empty.json"
    empty.write_text("")
    sifted = quarantine.sift_json_lines(spark, str(empty))
    assert sifted.accepted.count() == 0 and sifted.rejected.count() == 0
