"""Model queries: fitted scores have no SQL statement, so they register without one."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions import parse
from boutline.operators import attributions as at
from boutline.operators import backtest as bt
from boutline.operators import features as fx
from boutline.operators import model as md
from boutline.operators import summary as sm
from boutline.plans.history import cleaned, entity_skew
from boutline.plans.registry import query
from boutline.plans.scoring import CUTOFF, epochs
from boutline.session import stage
from boutline.sources import tables as t

TRIALS = 8
MEMBERS = [{"subsamplingRate": s} for s in (0.5, 0.6, 0.7, 0.8, 1.0)]


def staged_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows written once: boosting reads them again for every tree."""
    feats = fx.bout_features(cleaned(spark, sf), t.master(spark, sf), skew=entity_skew(spark, sf))
    return stage(feats)


def side_columns() -> list[str]:
    return [f"{s}_{c}" for c in fx.feature_columns() for s in ("red", "blue")]


def fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Training rows (mirrored), test rows and their inputs: the columns that survive the correlation prune, and flags
    where the prune kept one side only, whose value a mirrored row does not have."""
    split = sm.time_split(staged_features(spark, sf), F.lit(CUTOFF).cast("date"))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    cols = side_columns()
    kept = sm.kept_columns(sm.correlation_pairs(train, cols), cols)
    flags = md.half_pairs(kept)
    return md.training_rows(train, kept, flags), md.numeric_inputs(test, kept, flags), md.input_names(kept, flags)


@query("gbt_scores")
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test, kept = fitted(spark, sf)
    return md.score(md.fit_early(train, kept), test)


@query("gbt_ensemble")
def gbt_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Five models with their own settings and seeds, averaged."""
    train, test, kept = fitted(spark, sf)
    scores = md.ensemble_scores(train, test, kept, MEMBERS)
    return sm.ensemble_mean(scores.select("bout_id", F.col("p_win").alias("p")))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute attribution of each input over all test rows and the five models of the ensemble."""
    train, test, kept = fitted(spark, sf)
    return at.mean_attribution(md.fit_ensemble(train, kept, MEMBERS), test, kept)


def tuning_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Training rows without mirrored copies, and the kept columns."""
    train = staged_features(spark, sf).where(F.col("d") < F.lit(CUTOFF).cast("date"))
    cols = side_columns()
    kept = sm.kept_columns(sm.correlation_pairs(train, cols), cols)
    return md.numeric_inputs(train, kept).select("bout_id", "label", *kept), kept


@query("cv_losses")
def cv_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Log loss of each expanding-window fold."""
    rows, kept = tuning_rows(spark, sf)
    return spark.createDataFrame(list(enumerate(md.cross_validate(rows, kept))), "fold bigint, log_loss double")


@query("tuning_trials")
def tuning_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Settings drawn by the search, the rounds each one reached and its mean log loss there, best first."""
    rows, kept = tuning_rows(spark, sf)
    found = md.successive_halving(rows, kept, TRIALS, survivors=len(MEMBERS))
    kinds = {int: "bigint", float: "double", str: "string"}
    names = {k: kinds[type(v[0])] for k, v in md.SEARCH_SPACE.items()}
    form = "place bigint, draw bigint, stage bigint, rounds bigint, survived boolean, log_loss double, " + ", ".join(f"{k} {v}" for k, v in names.items())
    reached = ("draw", "stage", "rounds", "survived", "log_loss")
    return spark.createDataFrame([(i, *[x[k] for k in reached], *[x["settings"][k] for k in names]) for i, x in enumerate(found)], form)


@query("walk_forward_scores")
def walk_forward_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Both corner orders scored by the newest model trained before each bout, on the columns kept from that past."""
    feats = staged_features(spark, sf)
    days = epochs(feats)
    cols = side_columns()

    def scored(i: int) -> DataFrame:
        known = feats if i + 1 == len(days) else feats.where(F.col("d") < F.lit(days[i + 1]))
        kept = sm.kept_columns(sm.correlation_pairs(feats.where(F.col("d") < F.lit(days[i])), cols), cols)
        inputs = md.input_names(kept, md.half_pairs(kept))
        return md.walk_forward(known, kept, [days[i]], fit=lambda train: md.fit_early(train, inputs))

    with ThreadPool(md.PARALLEL) as pool:  # an epoch's model does not wait for another's; the longest histories first
        parts = pool.map(scored, range(len(days) - 1, 0, -1), 1)
    return reduce(DataFrame.unionByName, reversed(parts))


@query("walk_forward_backtest")
def walk_forward_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """The whole backtest: retrained models, odds, stakes of every strategy, and how each one grew."""
    scores = walk_forward_scores(spark, sf).select("bout_id", "p_ab", "p_ba")
    odds = cleaned(spark, sf).select("bout_id", "d", "red", "blue", "winner", "red_odds", "blue_odds")
    bets = stage(bt.for_strategies(bt.priced_bets(odds.join(scores, "bout_id"))))
    return bt.bankroll_path(bets).groupBy("strategy").agg(
        F.count("*").alias("predictions"),
        F.count("share").alias("bets"),
        F.count_if("correct").alias("correct_predictions"),
        F.max_by("log_growth", "bout_id").alias("log_growth"),
    )


@query("rf_baseline")
def rf_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Random forest on physique alone, split by a hash of the bout."""
    master = t.master(spark, sf).select(
        "entity",
        parse.height_inches(F.col("height_text")).alias("height"),
        parse.first_int(F.col("weight_text")).alias("weight"),
        parse.lenient_number(F.col("acc_text")).alias("accuracy"),
    )
    cols = [f"{s}_{c}" for s in ("red", "blue") for c in ("height", "weight", "accuracy")]
    b = t.bouts(spark, sf).where(F.col("winner").isNotNull())
    result = F.when(F.col("winner") == F.col("red"), F.lit("win")).otherwise(F.lit("loss"))
    rows = fx.with_master(b.select("bout_id", "red", "blue", result.alias("result")), master, ["height", "weight", "accuracy"])
    rows = stage(md.numeric_inputs(rows.na.drop(subset=cols).select("bout_id", "result", *cols), cols))
    in_train = F.pmod(F.xxhash64("bout_id"), F.lit(5)) != 0
    return md.score(md.fit_forest(rows.where(in_train), cols), rows.where(~in_train))
