"""The two end-to-end jobs: DataFrames in, predictions out; and their file-to-file forms."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.additive import RICH_ADDITIVE, STACKED_ADDITIVE, AdditiveParams, fit_additive
from starloom.operators.boosting import (
    BoostingParams, calibrated, clamped, fit_boosting,
)
from starloom.operators.features import Profiles, assemble, item_table, user_table, with_entities
from starloom.operators.scoring import assign_folds, attach_scores, fit_cf, out_of_fold_cf, score_cf
from starloom.operators.similarity import CfParams
from starloom.schema import DEFAULT_COLUMNS, RatingColumns
from starloom.session import stage, temporary_tables
from starloom.sources import files
from starloom.sources import profiles as entities

FOLDS = 5


@dataclass(frozen=True)
class JobResult:
    """``predictions`` has the columns of the pairs and ``prediction``; the vectors are those the model saw."""

    predictions: DataFrame
    train_vectors: DataFrame
    test_vectors: DataFrame


@dataclass(frozen=True)
class Prepared:
    """The written tables that the vectors of a job are made from.

    ``cf`` says where the neighbourhood score comes from: 'oof' for out-of-fold scores, 'proxy' for the bias estimate.
    """

    ratings: DataFrame
    pairs: DataFrame
    users: DataFrame
    items: DataFrame
    rich: bool
    cf: str
    params: CfParams
    folds: int
    cols: RatingColumns


def prepare(
    ratings: DataFrame, pairs: DataFrame, profiles: Profiles, rich: bool, cf: str | None = None, params: CfParams = CfParams(),
    folds: int = FOLDS, cols: RatingColumns = DEFAULT_COLUMNS,
) -> Prepared:
    cf = cf or ("proxy" if rich else "oof")
    if cf not in ("proxy", "oof") or (cf == "proxy" and not rich):
        raise ValueError("cf must be 'oof', or 'proxy' for the rich job")
    if cf == "oof" and cols.fold not in ratings.columns:
        ratings = assign_folds(ratings, folds, cols=cols)
    fold = [cols.fold] if cf == "oof" else []
    ratings = stage(ratings.select(*cols.pair, cols.rating, cols.seq, *fold), "ratings")
    profiles = replace(profiles, tips=stage(profiles.tips, "tips"))
    users = stage(user_table(ratings, profiles, rich, cols), "users")
    items = stage(item_table(ratings, profiles, rich, cols), "items")
    return Prepared(ratings, stage(pairs, "to-score"), users, items, rich, cf, params, folds, cols)


def _vectors(p: Prepared, rows: DataFrame, scores: DataFrame | None, held_out: bool, keep: list[str]) -> DataFrame:
    if scores is not None:
        rows = attach_scores(rows, scores, p.cols)
    mean = p.ratings.agg(F.avg(p.cols.rating)).scalar()
    source = "columns" if p.cf == "oof" else "proxy"
    return assemble(with_entities(rows, p.users, p.items, p.cols), mean, p.rich, held_out, keep, source, p.cols, "features")


def train_vectors(p: Prepared) -> DataFrame:
    """Pair, rating, order and feature vector of each rating.

    The rich job leaves each rating out of its statistics; of the stacked job only the neighbourhood score is out of fold.
    """
    scores = out_of_fold_cf(p.ratings, p.folds, p.params, p.cols) if p.cf == "oof" else None
    return _vectors(p, p.ratings, scores, p.rich, [*p.cols.pair, p.cols.rating, p.cols.seq])


def test_vectors(p: Prepared) -> DataFrame:
    """The columns of the pairs and their feature vectors."""
    scores = None
    if p.cf == "oof":
        scores = score_cf(p.pairs, fit_cf(p.ratings, p.params, p.cols, targets=p.pairs))
    return _vectors(p, p.pairs, scores, False, p.pairs.columns)


def fit_and_predict(p: Prepared, boosting: AdditiveParams | BoostingParams) -> JobResult:
    """Trees over the vectors, then calibration (rich) or a clamp (stacked).

    ``BoostingParams`` asks for Spark's own booster, without penalties.
    """
    train, test = stage(train_vectors(p), "train-vectors"), test_vectors(p)
    if isinstance(boosting, AdditiveParams):
        model = fit_additive(train, boosting, label=p.cols.rating)
    else:
        model = fit_boosting(train, boosting, label=p.cols.rating, staged=False)
    scored = model.predict(test)
    value = calibrated(F.col("raw_prediction"), F.lit(model.centre)) if p.rich else clamped()
    return JobResult(scored.select(*p.pairs.columns, value.alias("prediction")), train, test)


def run_stacked(
    ratings: DataFrame, pairs: DataFrame, profiles: Profiles, params: CfParams = CfParams(),
    boosting: AdditiveParams | BoostingParams = STACKED_ADDITIVE, folds: int = FOLDS, cols: RatingColumns = DEFAULT_COLUMNS,
) -> JobResult:
    """Out-of-fold neighbourhood scores stacked into trees over 68 features."""
    return fit_and_predict(prepare(ratings, pairs, profiles, False, "oof", params, folds, cols), boosting)


def run_rich(
    ratings: DataFrame, pairs: DataFrame, profiles: Profiles, boosting: AdditiveParams | BoostingParams = RICH_ADDITIVE, cf: str = "proxy",
    params: CfParams = CfParams(), folds: int = FOLDS, cols: RatingColumns = DEFAULT_COLUMNS,
) -> JobResult:
    """Trees over 117 features with leave-one-out statistics, then calibration.

    ``cf='proxy'`` fills the neighbourhood slots with the bias estimate, ``cf='oof'`` with out-of-fold scores.
    """
    return fit_and_predict(prepare(ratings, pairs, profiles, True, cf, params, folds, cols), boosting)


@dataclass(frozen=True)
class InputFiles:
    """File names below one folder."""

    folder: str
    ratings: str = "train.csv"
    users: str = "user.json"
    items: str = "business.json"
    checkins: str = "checkin.json"
    tips: str = "tip.json"
    photos: str = "photo.json"

    def path(self, kind: str) -> str:
        return posixpath.join(self.folder, getattr(self, kind))


def read_profiles(spark: SparkSession, source: InputFiles, rich: bool, cols: RatingColumns = DEFAULT_COLUMNS) -> Profiles:
    return Profiles(
        users=entities.read_users(spark, source.path("users")),
        items=entities.read_items(spark, source.path("items"), cols.item, rich),
        checkins=entities.read_checkins(spark, source.path("checkins"), cols.item, strict_keys=rich),
        tips=entities.read_tips(spark, source.path("tips"), cols.item),
        photos=entities.read_photos(spark, source.path("photos"), cols.item),
    )


def predict_files(
    spark: SparkSession,
    source: InputFiles,
    pairs_path: str,
    output_path: str,
    job: str = "rich",
    boosting: AdditiveParams | BoostingParams | None = None,
    by_file_order: bool = True,
    cols: RatingColumns = DEFAULT_COLUMNS,
    **options,
) -> DataFrame:
    """Read the six files and the pairs, run ``job`` ('stacked' or 'rich'), write the predictions and read them back.

    The output keeps the order of the pairs file.  Ratings are numbered by their place in the file, which orders them and
    gives their folds; ``by_file_order=False`` assigns folds by hash.  Intermediate tables are removed at the end.
    """
    with temporary_tables(spark):
        ratings = stage(files.read_ratings(spark, source.path("ratings"), cols), "read")
        ratings = files.with_row_index(ratings, cols.seq)
        if by_file_order:
            ratings = assign_folds(ratings, options.get("folds", FOLDS), cols=cols)
        ratings = ratings.withColumn(cols.seq, F.col("row_index")).drop("row_index")
        pairs = files.read_pairs(spark, pairs_path, cols)
        profiles = read_profiles(spark, source, job == "rich", cols)
        run = {"stacked": run_stacked, "rich": run_rich}[job]
        default = STACKED_ADDITIVE if job == "stacked" else RICH_ADDITIVE
        result = run(ratings, pairs, profiles, boosting=boosting or default, cols=cols, **options)
        files.write_predictions(stage(result.predictions, "predictions"), output_path, cols, order_by=cols.seq)
    return spark.read.schema("user_id STRING, business_id STRING, prediction DOUBLE").csv(output_path, header=True)
