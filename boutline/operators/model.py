"""Win-probability models on Spark ML: training, tuning, ensembles, walk-forward scoring, importance."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators.features import mirrored, swap_name
from boutline.operators.summary import CLIP, cv_folds, with_position
from boutline.session import stage

FIT_ROWS = 20_000
PARALLEL = 3  # independent fits at a time: one computes while another waits for its driver or for the last task of a level
DEFAULTS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 20}
# fixed values: ranges the tuner draws from
SEARCH_SPACE = {
    "maxDepth": (3, 4, 5),
    "stepSize": (0.03, 0.1, 0.3),
    "subsamplingRate": (0.5, 0.65, 0.8, 1.0),
    "minInstancesPerNode": (20, 35, 50),
    "featureSubsetStrategy": ("0.5", "0.65", "0.8"),
}


def numeric_inputs(features: DataFrame, cols: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Missing values as 0 with a 0/1 flag column for the names in ``flags``; ``label`` is 1 for a win."""
    out = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]
    out += [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in flags]
    keep = [c for c in features.columns if c not in cols]
    label = (F.col("result") == "win").cast("double").alias("label")
    return features.select(*keep, *out, label)


def input_names(cols: Sequence[str], flags: Sequence[str] = ()) -> list[str]:
    return [*cols, *[f"{c}_missing" for c in flags]]


def half_pairs(cols: Sequence[str]) -> list[str]:
    """Columns of one side without the other side's among ``cols``: a corner-swapped row does not know their values."""
    return [c for c in cols if swap_name(c) not in cols]


def spread(rows: DataFrame, order: str = "bout_id") -> DataFrame:
    """``rows`` stored and dealt out evenly by ``order``, in its order within a partition.

    A boosted fit runs a job per level of every tree, with two tasks per partition, so it is as slow as the fullest partition and
    pays for each empty one. Partitions get about ``FIT_ROWS`` rows: as many of them as there are cores, more for large tables.
    """
    stored = stage(rows)
    cores = stored.sparkSession.sparkContext.defaultParallelism
    count = stored.count()
    parts = max(1, min(cores, count // FIT_ROWS), count // (FIT_ROWS * 10))
    return stored.repartition(parts, order).sortWithinPartitions(order)


@contextmanager
def dealt(rows: DataFrame, order: str = "bout_id") -> Iterator[DataFrame]:
    """``rows`` as ``spread`` deals them out, kept as long as fits read them again."""
    kept = spread(rows, order).cache()
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_boosted(train: DataFrame, inputs: Sequence[str], seed: int = 42, **params) -> PipelineModel:
    """Gradient-boosted trees; ``validationIndicatorCol`` among the params stops early."""
    gbt = GBTClassifier(featuresCol="inputs", labelCol="label", seed=seed, **{**DEFAULTS, **params})
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="inputs"), gbt]).fit(train)


def fit_early(train: DataFrame, inputs: Sequence[str], seed: int = 42, share: float = 0.1, order: str = "bout_id", **params) -> PipelineModel:
    """As ``fit_boosted``; the newest ``share`` of bouts tells how many rounds help, then all rows are fitted with so many.

    Both corner orders of a bout fall on the same side. The rows are made once for all passes and dealt out evenly.
    """
    with dealt(train, order) as rows:
        return _fit_early(rows, inputs, seed, share, order, **params)


def _fit_early(train: DataFrame, inputs: Sequence[str], seed: int = 42, share: float = 0.1, order: str = "bout_id", **params) -> PipelineModel:
    cut = train.agg(F.percentile_approx(order, 1 - share)).scalar()
    trial = fit_boosted(train.withColumn("_held", F.col(order) > cut), inputs, seed, validationIndicatorCol="_held", **params)
    return fit_boosted(train, inputs, seed, **{**params, "maxIter": trial.stages[-1].getNumTrees})


def fit_forest(train: DataFrame, inputs: Sequence[str], seed: int = 42, trees: int = 20, depth: int = 5) -> PipelineModel:
    forest = RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="inputs"), forest]).fit(train)


def training_rows(features: DataFrame, cols: Sequence[str], flags: Sequence[str] = (), mirror: bool = True) -> DataFrame:
    """Pruned to the used columns first, then doubled by corner-swapped copies."""
    pruned = features.select("bout_id", "result", *cols)
    return numeric_inputs(mirrored(pruned) if mirror else pruned, cols, flags)


def score(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("bout_id",)) -> DataFrame:
    """Win and lose probabilities of each row."""
    p = vector_to_array("probability")
    return model.transform(rows).select(*keep, p[1].alias("p_win"), p[0].alias("p_lose"))


def score_both_orders(model: PipelineModel, features: DataFrame, cols: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """p_ab from the row as it is and p_ba from its corner-swapped copy, scored in one pass."""
    rows = numeric_inputs(mirrored(features.select("bout_id", "result", *cols)), cols, flags)
    s = score(model, rows, ("bout_id", "mirrored"))
    return s.groupBy("bout_id").agg(
        F.max(F.when(~F.col("mirrored"), F.col("p_win"))).alias("p_ab"),
        F.max(F.when(F.col("mirrored"), F.col("p_win"))).alias("p_ba"),
    )


def log_loss_of(label: Column, p: Column) -> Column:
    right = F.when(label == 1, p).otherwise(1 - p)
    return -F.log(F.least(F.greatest(right, F.lit(CLIP)), F.lit(1 - CLIP)))


def fit_ensemble(train: DataFrame, inputs: Sequence[str], param_sets: Sequence[dict], seed: int = 42) -> list[PipelineModel]:
    """One early-stopped model per setting, each with a seed of its own; all read the same stored rows, some at a time."""
    with dealt(train) as rows, ThreadPool(PARALLEL) as pool:
        return pool.map(lambda x: _fit_early(rows, inputs, seed + x[0], **x[1]), list(enumerate(param_sets)), 1)


def ensemble_scores(
    train: DataFrame, test: DataFrame, inputs: Sequence[str], param_sets: Sequence[dict], seed: int = 42
) -> DataFrame:
    """One row per test row and model; the caller averages them."""
    out = None
    for i, model in enumerate(fit_ensemble(train, inputs, param_sets, seed)):
        s = score(model, test).withColumn("model", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out


def cross_validate(rows: DataFrame, inputs: Sequence[str], folds: int = 5, order: str = "bout_id", **params) -> list[float]:
    """Log loss of each expanding-window fold; ``rows`` must not hold mirrored copies."""
    split = spread(cv_folds(rows, order, folds), order).cache()
    losses = []
    try:
        for f in range(folds):
            train = split.where(F.col("fold").isNull() | (F.col("fold") < f))
            model = fit_boosted(train, inputs, **params)
            s = score(model, split.where(F.col("fold") == f), ("label",))
            losses.append(s.agg(F.avg(log_loss_of(F.col("label"), F.col("p_win")))).first()[0])
    finally:
        split.unpersist()
    return losses


def successive_halving(
    rows: DataFrame, inputs: Sequence[str], trials: int = 8, rounds: Sequence[int] = (2, 5, 10), survivors: int = 5, seed: int = 42,
    folds: int = 5, parallel: int = 4, **fixed,
) -> list[dict]:
    """Seeded draws tried with few boosting rounds on all folds; the better half goes on with more, never fewer than ``survivors``.

    A trial stops early by falling behind. One dict per draw: its settings, ``stage`` and ``rounds`` it reached, its mean log loss
    there and whether it ``survived`` to the end; best first. Trials of a stage are independent Spark jobs on the same cached folds.
    """
    rng = random.Random(seed)
    split = spread(cv_folds(rows, "bout_id", folds)).cache()

    def loss_of(params: dict, iterations: int) -> float:
        losses = []
        for f in range(folds):
            model = fit_boosted(split.where(F.col("fold").isNull() | (F.col("fold") < f)), inputs, **{**params, **fixed, "maxIter": iterations})
            s = score(model, split.where(F.col("fold") == f), ("label",))
            losses.append(s.agg(F.avg(log_loss_of(F.col("label"), F.col("p_win")))).first()[0])
        return sum(losses) / folds

    open_ = [{"draw": i, "settings": {k: rng.choice(v) for k, v in SEARCH_SPACE.items()}} for i in range(trials)]
    done: list[dict] = []
    try:
        with ThreadPool(parallel) as pool:
            for number, iterations in enumerate(rounds):
                losses = pool.map(lambda x, n=iterations: loss_of(x["settings"], n), open_)
                open_ = [{**x, "stage": number, "rounds": iterations, "log_loss": v} for x, v in zip(open_, losses, strict=True)]
                open_.sort(key=lambda x: (x["log_loss"], x["draw"]))
                keep = len(open_) if number + 1 == len(rounds) else max(survivors, len(open_) // 2)
                done += [{**x, "survived": False} for x in open_[keep:]]
                open_ = open_[:keep]
    finally:
        split.unpersist()
    done.sort(key=lambda x: (-x["stage"], x["log_loss"], x["draw"]))
    return [{**x, "survived": True} for x in open_] + done


def random_search(rows: DataFrame, inputs: Sequence[str], trials: int, seed: int = 42, folds: int = 5, **fixed) -> list[tuple[float, dict]]:
    """Seeded draws from the search space, best mean log loss first."""
    rng = random.Random(seed)
    results = []
    for _ in range(trials):
        params = {k: rng.choice(v) for k, v in SEARCH_SPACE.items()}
        losses = cross_validate(rows, inputs, folds, **{**params, **fixed})
        results.append((sum(losses) / len(losses), params))
    return sorted(results, key=lambda x: x[0])


def walk_forward(
    features: DataFrame, cols: Sequence[str], epochs: Sequence, fit=None, day: str = "d", **params
) -> DataFrame:
    """Train on everything before each epoch day, score the bouts from that day to the next one.

    Half pairs among ``cols`` get flags, so the inputs are ``input_names(cols, half_pairs(cols))``.
    """
    flags = half_pairs(cols)
    fit = fit or (lambda train: fit_boosted(train, input_names(cols, flags), **params))
    out = None
    for i, start in enumerate(epochs):
        train = training_rows(features.where(F.col(day) < F.lit(start)), cols, flags)
        part = features.where(F.col(day) >= F.lit(start))
        if i + 1 < len(epochs):
            part = part.where(F.col(day) < F.lit(epochs[i + 1]))
        s = score_both_orders(fit(train), part, cols, flags).withColumn("model_epoch", F.lit(start))
        out = s if out is None else out.unionByName(s)
    return out


def split_importance(model: PipelineModel, inputs: Sequence[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(((c, float(v)) for c, v in zip(inputs, values, strict=True)), key=lambda x: (-x[1], x[0]))


def permutation_importance(model: PipelineModel, rows: DataFrame, inputs: Sequence[str], order: str = "bout_id") -> DataFrame:
    """Rise in log loss when one input at a time takes the value of another row.

    Rows are paired by position (each row with the one half the table away), every pair is expanded to
    one variant per input, and the losses are averaged map-side: two shuffles for all inputs.
    """
    packed = with_position(rows.select(order, "label", F.array(*inputs).alias("x")), order)
    half = F.floor(F.col("total") / 2)
    partner = packed.select(F.pmod(F.col("position") + half, F.col("total")).alias("position"), F.col("x").alias("y"))
    paired = packed.join(partner, "position")
    names = F.array(F.lit("(none)"), *[F.lit(c) for c in inputs])
    variants = paired.select("label", "x", "y", F.posexplode(names).alias("pick", "feature"))
    x = F.transform("x", lambda v, i: F.when(i + 1 == F.col("pick"), F.get(F.col("y"), i)).otherwise(v))
    ready = variants.select("label", "feature", array_to_vector(x).alias("inputs"))
    scored = model.stages[-1].transform(ready)
    loss = log_loss_of(F.col("label"), vector_to_array("probability")[1])
    by_feature = scored.groupBy("feature").agg(F.avg(loss).alias("loss"))
    base = by_feature.where(F.col("feature") == "(none)").agg(F.max("loss")).scalar()
    return by_feature.where(F.col("feature") != "(none)").select("feature", (F.col("loss") - base).alias("importance"))


def with_inputs(model: PipelineModel, cols: Sequence[str], flags: Sequence[str] = ()) -> PipelineModel:
    """A model that carries its columns: it picks and fills them from raw feature rows itself, also after it was stored.

    Missing values become 0, names in ``flags`` get their 0/1 column; other columns of the rows do not matter. The extra
    columns it adds begin with ``in_``.
    """
    picked = [f"coalesce(CAST(`{c}` AS DOUBLE), 0.0D) AS `in_{c}`" for c in cols]
    picked += [f"CAST(`{c}` IS NULL AS DOUBLE) AS `in_{c}_missing`" for c in flags]
    pick = SQLTransformer(statement=f"SELECT *, {', '.join(picked)} FROM __THIS__")
    names = [f"in_{c}" for c in input_names(cols, flags)]
    return PipelineModel(stages=[pick, VectorAssembler(inputCols=names, outputCol="inputs"), model.stages[-1]])


def kept_inputs(model: PipelineModel) -> list[str]:
    """The inputs of a model made by ``with_inputs``, in order."""
    return [c.removeprefix("in_") for c in model.stages[1].getInputCols()]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
