"""Rows of early-stopped fits are made and dealt out once; models come in the order of their settings."""

import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from boutline.operators import model as md


@pytest.fixture
def dealt(monkeypatch):
    """How often rows were dealt out, and of every fit: its seed, its rows and the partitions they lie in."""
    seen = SimpleNamespace(spreads=0, fits=[], kept=[])
    spread, lock = md.spread, threading.Lock()

    def counted(rows, order="bout_id"):
        seen.spreads += 1
        seen.kept.append(spread(rows, order))
        return seen.kept[-1]

    def fit(train, inputs, seed=42, **params):
        with lock:
            seen.fits.append((seed, train.count(), train.rdd.getNumPartitions(), params))
        return SimpleNamespace(stages=[SimpleNamespace(getNumTrees=7)], seed=seed)

    monkeypatch.setattr(md, "FIT_ROWS", 100)
    monkeypatch.setattr(md, "spread", counted)
    monkeypatch.setattr(md, "fit_boosted", fit)
    return seen


def lumped(spark):
    """800 rows of 400 bouts, all in one of 16 partitions."""
    return spark.range(800).select((F.col("id") / 2).cast("long").alias("bout_id"), F.lit(1.0).alias("label"), F.rand(1).alias("x")).repartition(16, F.lit(0))


def test_ensembles_read_rows_that_are_dealt_out_once(spark, dealt):
    models = md.fit_ensemble(lumped(spark), ["x"], [{"subsamplingRate": s} for s in (0.5, 0.6, 0.7, 0.8)])
    assert [m.seed for m in models] == [42, 43, 44, 45]
    assert dealt.spreads == 1 and len(dealt.fits) == 8
    assert {n for _, n, _, _ in dealt.fits} == {800} and {p for _, _, p, _ in dealt.fits} == {min(8, spark.sparkContext.defaultParallelism)}
    assert sorted(p.get("maxIter", 0) for *_, p in dealt.fits) == [0] * 4 + [7] * 4
    assert not any(df.is_cached or df.storageLevel.useMemory for df in dealt.kept)


def test_one_fit_deals_out_its_rows(spark, dealt):
    md.fit_early(lumped(spark), ["x"])
    assert dealt.spreads == 1 and [n for _, n, _, _ in dealt.fits] == [800, 800]
