"""Scores, correlations, trial statistics and position-based splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.operators import scan
from boutline.operators.scan import ALL_KEYS, Run, running

FLAT = 1e-10  # a variance below this share of the second moment is rounding
CLIP = 1e-15


def score_metrics(scored: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Accuracy of the more likely class and log loss; ``label`` is 0/1, ``p`` the chance of 1."""
    hit = (F.col(p) > 0.5).cast("int") == F.col(label)
    safe = F.least(F.greatest(F.when(F.col(label) == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(CLIP)), F.lit(1 - CLIP))
    return scored.agg(
        F.count("*").alias("bouts"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(-F.log(safe)).alias("log_loss")
    )


def ensemble_mean(scores: DataFrame, key: Sequence[str] = ("bout_id",), p: str = "p") -> DataFrame:
    """Mean probability over models and the likelier label; a tie goes to the first class."""
    mean = scores.groupBy(*key).agg(F.avg(p).alias("p"), F.count("*").alias("models"))
    return mean.withColumn("predicted", F.when(F.col("p") > 0.5, F.lit("win")).otherwise(F.lit("loss")))


def prediction_report(scored: DataFrame, bouts: DataFrame) -> DataFrame:
    """Names, predicted label, its probability and the actual label, joined on the bout."""
    actual = F.when(F.col("winner") == F.col("red"), F.lit("win")).when(F.col("winner") == F.col("blue"), F.lit("loss"))
    names = bouts.select("bout_id", "red", "blue", actual.alias("actual_result"))
    return scored.join(names, "bout_id").select(
        "bout_id",
        "red",
        "blue",
        F.when(F.col("p") > 0.5, F.lit("win")).otherwise(F.lit("loss")).alias("predicted_result"),
        F.greatest(F.col("p"), 1 - F.col("p")).alias("probability"),
        "actual_result",
    )


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absolute correlation of every pair (earlier column, later column) as rows, for any number of columns.

    Each pair uses the rows where both columns have a number. Every task reduces its rows to sums per pair (matrix
    products over Arrow batches of centred values), so only pairs are shuffled. Without variance ``r`` is NULL.
    """
    cols = list(cols)
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"_{i}") for i, c in enumerate(cols)])
    centre = [x or 0.0 for x in numbers.agg(*[F.avg(c) for c in numbers.columns]).first()]
    i, j = np.triu_indices(len(cols), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, p = np.zeros((4, len(cols), len(cols)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            n += known.T @ known
            s += x.T @ known
            ss += (x * x).T @ known
            p += x.T @ x
        parts = {"pos_a": i.astype(np.int32), "pos_b": j.astype(np.int32), "n": n[i, j], "x": s[i, j], "y": s[j, i], "xx": ss[i, j], "yy": ss[j, i], "xy": p[i, j]}
        yield pa.RecordBatch.from_pydict(parts)

    schema = "pos_a int, pos_b int, n double, x double, y double, xx double, yy double, xy double"
    total = numbers.mapInArrow(sums, schema).groupBy("pos_a", "pos_b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = lambda one, two: F.expr(f"CASE WHEN n * {two} - {one} * {one} > {FLAT} * n * {two} THEN n * {two} - {one} * {one} END")
    r = F.least(F.lit(1.0), F.abs(F.expr("n * xy - x * y")) / F.sqrt(spread("x", "xx")) / F.sqrt(spread("y", "yy")))
    r = F.when(spread("x", "xx").isNotNull() & spread("y", "yy").isNotNull(), r)
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(F.get(names, F.col("pos_a")).alias("col_a"), F.get(names, F.col("pos_b")).alias("col_b"), "pos_a", "pos_b", r.alias("r"))


def prune_correlated(pairs: DataFrame, limit: float = 0.95) -> DataFrame:
    """Later columns with their largest correlation to an earlier one and whether they are dropped.

    Columns without variance have no correlation; they stay.
    """
    return pairs.groupBy(F.col("col_b").alias("column"), F.col("pos_b").alias("position")).agg(
        F.max("r").alias("max_r"), F.coalesce(F.max("r") > limit, F.lit(False)).alias("dropped")
    )


def kept_columns(pairs: DataFrame, cols: Sequence[str], limit: float = 0.95) -> list[str]:
    dropped = {r["column"] for r in prune_correlated(pairs, limit).where("dropped").collect()}  # column names
    return [c for c in cols if c not in dropped]


def label_correlation(df: DataFrame, cols: Sequence[str], label: Column) -> DataFrame:
    """(feature, importance): absolute correlation of every column with a label."""
    pairs = correlation_pairs(df.select(*cols, label.cast("double").alias("_label")), [*cols, "_label"])
    return pairs.where(F.col("col_b") == "_label").select(F.col("col_a").alias("feature"), F.col("r").alias("importance"))


def low_importance(importance: DataFrame, share: float = 0.15) -> DataFrame:
    """Features strictly below the given percentile of importance; one row per feature."""
    cut = importance.agg(F.percentile("importance", F.lit(share))).scalar()
    return importance.where(F.col("importance") < cut)


def trial_summary(trials: DataFrame, value: str = "bankroll", start: float = 1000.0) -> DataFrame:
    return trials.agg(
        F.count("*").alias("trials"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_bankroll"),
        F.count_if(F.col(value) > start).alias("above"),
        F.count_if(F.col(value) < start).alias("below"),
    )


def after_last_peak(trials: DataFrame, order: str, value: str, limit: float = 3000.0) -> DataFrame:
    """Rows after the last value above the limit; all rows when there is none."""
    last = trials.where(F.col(value) > limit).agg(F.max(order)).scalar()
    return trials.where(F.coalesce(F.col(order) > last, F.lit(True)))


def with_position(df: DataFrame, order: str = "bout_id") -> DataFrame:
    """0-based position over the whole table and its row count; no task sees all rows.

    Rows are counted per segment of consecutive ``order``; the line of these counts gives both where a segment begins
    and how many rows there are, so nothing is counted by a job of its own. Rows without an order come first.
    """
    cut = df.withColumn("_seg", F.coalesce(F.floor(F.col(order) / scan.GLOBAL_SEGMENT_ROWS), F.lit(-(2**62)))).repartition("_seg")
    line = Window.partitionBy(F.lit(0)).orderBy("_seg")  # one row per segment
    begin = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counts = cut.groupBy("_seg").agg(F.count("*").alias("_n")).select("_seg", begin.alias("_begin"), total.alias("total"))
    within = F.row_number().over(Window.partitionBy("_seg").orderBy(order)) - 1
    return cut.join(counts, "_seg").select(*df.columns, (F.col("_begin") + within).alias("position"), "total")


def numbered(df: DataFrame, order: str = "bout_id", name: str = "position") -> DataFrame:
    return running(df, [], order, [Run(name, "count", F.lit(1))], ALL_KEYS)


def position_split(df: DataFrame, order: str = "bout_id", train: float = 0.95, prune: float = 0.3) -> DataFrame:
    """``split`` is pruned, train or test by position: the oldest share of the training rows is pruned."""
    cut = F.floor(F.col("total") * train)
    early = F.floor(cut * prune)
    pos = F.col("position")
    split = F.when(pos < early, F.lit("pruned")).when(pos < cut, F.lit("train")).otherwise(F.lit("test"))
    return with_position(df, order).withColumn("split", split).drop("total")


def cv_folds(df: DataFrame, order: str = "bout_id", folds: int = 5) -> DataFrame:
    """``fold`` is the validation block of a row (NULL: training only); fold f trains on all earlier rows."""
    size = F.floor(F.col("total") / (folds + 1))
    first = F.col("total") - size * folds
    fold = F.when(F.col("position") >= first, F.floor((F.col("position") - first) / size))
    return with_position(df, order).withColumn("fold", fold).drop("total")


def time_split(df: DataFrame, cutoff: Column, floor: Column | None = None, day: str = "d") -> DataFrame:
    kept = df if floor is None else df.where(F.col(day) >= floor)
    return kept.withColumn("split", F.when(F.col(day) < cutoff, F.lit("train")).otherwise(F.lit("test")))
