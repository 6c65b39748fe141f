"""The registered model queries fit with the operators' own defaults and all kept columns."""

import pytest

from boutline.operators import model as md
from boutline.plans import models


@pytest.fixture
def fits(monkeypatch):
    """Inputs and settings of every fit; the fits themselves are kept small."""
    seen, boosted, forest = [], md.fit_boosted, md.fit_forest

    def small_boosted(train, inputs, seed=42, **params):
        seen.append((list(inputs), params))
        return boosted(train, inputs, seed, **{**params, "maxIter": 1, "maxDepth": 1})

    def small_forest(train, inputs, seed=42, **params):
        seen.append((list(inputs), params))
        return forest(train, inputs, seed, trees=1, depth=1)

    monkeypatch.setattr(md, "fit_boosted", small_boosted)
    monkeypatch.setattr(md, "fit_forest", small_forest)
    return seen


def check(fits):
    for inputs, params in fits:
        assert len(inputs) > 6
        assert "maxDepth" not in params and ("maxIter" not in params or "validationIndicatorCol" not in params)
    assert sum("validationIndicatorCol" in p for _, p in fits) * 2 == len(fits)


def test_boosted_queries_use_the_defaults(spark, sf, fits):
    assert models.gbt_scores(spark, sf).count() > 0
    assert len(fits) == 2
    check(fits)


def test_walk_forward_uses_all_kept_columns(spark, sf, fits):
    assert models.walk_forward_scores(spark, sf).count() > 0
    assert len(fits) > 2
    check(fits)


def test_forest_uses_the_default_trees(spark, sf, fits):
    assert models.rf_baseline(spark, sf).count() > 0
    assert [p for _, p in fits] == [{}]


def test_tuning_queries(spark, sf, fits, monkeypatch):
    monkeypatch.setattr(models, "TRIALS", 1)
    losses = models.cv_losses(spark, sf).collect()
    assert [r["fold"] for r in losses] == [0, 1, 2, 3, 4] and all(r["log_loss"] > 0 for r in losses)
    (trial,) = models.tuning_trials(spark, sf).collect()
    assert set(md.SEARCH_SPACE) < set(trial.asDict()) and trial["log_loss"] > 0
    assert (trial["stage"], trial["rounds"], trial["survived"]) == (2, 10, True)
    assert [p.get("maxIter") for _, p in fits] == [None] * 5 + [2] * 5 + [5] * 5 + [10] * 5
