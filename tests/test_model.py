import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import model as md

FAST = {"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 5}
COLS = ["red_x", "blue_x"]


@pytest.fixture(scope="module")
def features(spark):
    """The side with the larger x usually wins; red_z is noise."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        r, b = rng.random(), rng.random()
        win = (r > b) if rng.random() < 0.9 else (r < b)
        rows.append((i, f"2024-01-{1 + i // 20:02d}", "win" if win else "loss", r, b, rng.random()))
    df = spark.createDataFrame(rows, "bout_id bigint, d string, result string, red_x double, blue_x double, red_z double")
    return df.withColumn("d", F.col("d").cast("date")).cache()


@pytest.fixture(scope="module")
def fitted(features):
    return md.fit_boosted(md.training_rows(features, COLS), COLS, **FAST)


def test_missing_values_get_flags(spark):
    df = spark.createDataFrame([(1, "win", None), (2, "loss", 2.0)], "bout_id int, result string, x double")
    got = md.numeric_inputs(df, ["x"], ["x"]).orderBy("bout_id").collect()
    assert [(r["x"], r["x_missing"], r["label"]) for r in got] == [(0.0, 1.0, 1.0), (2.0, 0.0, 0.0)]
    assert md.input_names(["x"], ["x"]) == ["x", "x_missing"]


def test_scores_and_saved_model(features, fitted, tmp_path):
    rows = md.numeric_inputs(features, COLS)
    s = md.score(fitted, rows, ("bout_id", "label")).collect()
    assert len(s) == 400
    assert all(r["p_win"] + r["p_lose"] == pytest.approx(1) for r in s)
    assert sum((r["p_win"] > 0.5) == (r["label"] == 1) for r in s) > 300
    md.save_model(fitted, str(tmp_path / "m"))
    again = md.score(md.load_model(str(tmp_path / "m")), rows).orderBy("bout_id").collect()
    assert [r["p_win"] for r in again] == [r["p_win"] for r in sorted(s, key=lambda r: r["bout_id"])]


def test_both_orders(features, fitted):
    s = md.score_both_orders(fitted, features.limit(50), COLS).collect()
    assert len(s) == 50 and all(r["p_ab"] is not None and r["p_ba"] is not None for r in s)


def test_importance(features):
    cols = [*COLS, "red_z"]
    model = md.fit_boosted(md.numeric_inputs(features, cols), cols, **FAST)
    imp = {r["feature"]: r["importance"] for r in md.permutation_importance(model, md.numeric_inputs(features, cols), cols).collect()}
    assert set(imp) == set(cols)
    assert imp["red_z"] < min(imp["red_x"], imp["blue_x"])
    assert {c for c, _ in md.split_importance(model, cols)[:2]} == set(COLS)


def test_tuning(features):
    rows = md.numeric_inputs(features, COLS)
    losses = md.cross_validate(rows, COLS, folds=2, **FAST)
    assert len(losses) == 2 and all(0 < x < 0.8 for x in losses)
    found = md.random_search(rows, COLS, trials=1, folds=2, maxIter=2)
    assert found[0][0] > 0 and set(found[0][1]) == set(md.SEARCH_SPACE)


def test_successive_halving(features):
    rows = md.numeric_inputs(features, COLS)
    found = md.successive_halving(rows, COLS, trials=4, rounds=(1, 2), survivors=2, folds=2, maxDepth=2, minInstancesPerNode=5)
    assert [x["survived"] for x in found] == [True, True, False, False]
    assert [x["rounds"] for x in found] == [2, 2, 1, 1] and {x["draw"] for x in found} == set(range(4))
    assert found[0]["log_loss"] <= found[1]["log_loss"] and found[2]["log_loss"] <= found[3]["log_loss"]
    assert all(set(x["settings"]) == set(md.SEARCH_SPACE) for x in found)
    again = md.successive_halving(rows, COLS, trials=4, rounds=(1, 2), survivors=2, folds=2, parallel=1, maxDepth=2, minInstancesPerNode=5)
    assert [x["draw"] for x in again] == [x["draw"] for x in found]


def test_stored_model_carries_its_columns(features, tmp_path):
    """Raw rows with gaps, other columns and another order are scored from the reloaded model alone."""
    gaps = features.withColumn("red_x", F.when(F.col("bout_id") % 7 != 0, F.col("red_x")))
    ready = md.numeric_inputs(gaps, COLS, ["red_x"])
    names = md.input_names(COLS, ["red_x"])
    fitted = md.fit_boosted(ready, names, **FAST)
    md.save_model(md.with_inputs(fitted, COLS, ["red_x"]), str(tmp_path / "m"))
    loaded = md.load_model(str(tmp_path / "m"))
    assert md.kept_inputs(loaded) == names
    raw = gaps.select("red_z", "blue_x", "bout_id", "red_x")
    got = {r["bout_id"]: r["p_win"] for r in md.score(loaded, raw).collect()}
    want = {r["bout_id"]: r["p_win"] for r in md.score(fitted, ready).collect()}
    assert got == want and len(got) == 400


def test_walk_forward_trains_on_the_past_only(features):
    days = [r["d"] for r in features.select("d").distinct().orderBy("d").collect()]
    seen = []

    def fit(train):
        seen.append(train.agg(F.max("bout_id")).first()[0])
        return md.fit_boosted(train, COLS, **FAST)

    out = md.walk_forward(features, COLS, [days[10], days[15]], fit=fit)
    got = out.groupBy("model_epoch").agg(F.min("bout_id").alias("lo"), F.count("*").alias("n")).orderBy("model_epoch").collect()
    assert [(r["lo"], r["n"]) for r in got] == [(200, 100), (300, 100)]
    assert seen == [199, 299]


def test_ensemble(features):
    train, test = md.training_rows(features.where("bout_id < 300"), COLS), md.numeric_inputs(features.where("bout_id >= 300"), COLS)
    s = md.ensemble_scores(train, test, COLS, [FAST, {**FAST, "stepSize": 0.3}])
    assert s.count() == 200 and s.select("model").distinct().count() == 2
