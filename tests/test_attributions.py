"""Attributions against the model's margin and against enumeration over all subsets of inputs."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from boutline.operators import attributions as at
from boutline.operators import model as md
from boutline.operators import summary as sm

COLS = ["a", "b", "c", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(500):
        a, b, c, e = (round(rng.random(), 2) for _ in range(4))
        data.append((i, float((a > b) if rng.random() < 0.9 else (c > 0.5)), a, b, c, e))
    return spark.createDataFrame(data, "bout_id bigint, label double, a double, b double, c double, e double").cache()


@pytest.fixture(scope="module")
def model(rows):
    return md.fit_boosted(rows, COLS, maxIter=5, maxDepth=4, minInstancesPerNode=5)


def test_values_add_up_to_the_margin(rows, model):
    want = {r["bout_id"]: r["m"] for r in model.transform(rows).select("bout_id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    got = at.attributions(model, rows, COLS).collect()
    assert len(got) == 500
    for r in got:
        assert r["margin_mean"] + sum(r["values"]) == pytest.approx(want[r["bout_id"]], abs=1e-9)


def expected(nodes, at_node, x, known):
    """Mean of a tree with only the ``known`` inputs given."""
    n = nodes[at_node]
    if n["leftChild"] < 0:
        return n["prediction"]
    i, bound = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
    if i in known:
        return expected(nodes, n["leftChild"] if x[i] <= bound else n["rightChild"], x, known)
    return sum(nodes[c]["rawCount"] / n["rawCount"] * expected(nodes, c, x, known) for c in (n["leftChild"], n["rightChild"]))


def test_values_equal_enumeration(spark, rows, model, tmp_path):
    model.stages[-1].write().save(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m" / "data")).select("treeID", "nodeData.*").collect()
    trees = [{r["id"]: r.asDict(recursive=True) for r in stored if r["treeID"] == t} for t in range(5)]
    weights = model.stages[-1].treeWeights
    given = {r["bout_id"]: [r[c] for c in COLS] for r in rows.limit(25).collect()}
    for r in at.attributions(model, rows.limit(25), COLS).collect():
        x = given[r["bout_id"]]
        f = lambda s: sum(w * expected(t, 0, x, s) for w, t in zip(weights, trees, strict=True))
        for j in range(4):
            others = [k for k in range(4) if k != j]
            phi = sum(factorial(n) * factorial(3 - n) / 24 * (f({*s, j}) - f(set(s))) for n in range(4) for s in combinations(others, n))
            assert r["values"][j] == pytest.approx(phi, abs=1e-9)


def test_leaf_values_by_hand():
    got = at.leaf_values(2.0, [0.25])
    assert got.tolist() == [[-0.5], [1.5]]
    assert np.allclose(at.leaf_values(1.0, [0.5, 0.5])[3], [0.375, 0.375])


def test_mean_over_models_feeds_the_cut(rows, model):
    other = md.fit_boosted(rows, COLS, seed=7, maxIter=3, maxDepth=2)
    mean = {r["feature"]: r["importance"] for r in at.mean_attribution([model, other], rows, COLS).collect()}
    both = [np.abs([r["values"] for r in at.attributions(m, rows, COLS).collect()]).mean(axis=0) for m in (model, other)]
    assert mean == pytest.approx(dict(zip(COLS, np.mean(both, axis=0), strict=True)))
    assert set(sorted(mean, key=mean.get)[-2:]) == {"a", "b"}
    cut = sm.low_importance(at.mean_attribution([model, other], rows, COLS)).collect()
    assert {r["feature"] for r in cut} == {min(mean, key=mean.get)}


def test_no_rows(rows, model):
    assert at.attributions(model, rows.where(F.lit(False)), COLS).count() == 0
