"""Positions without a count job, events that make no bout, and inputs of half pairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from boutline.operators import model as md
from boutline.operators import scan
from boutline.operators import summary as sm
from boutline.sources import tables as t


@pytest.mark.parametrize("size", [3, 200_000])
def test_position_and_total(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "GLOBAL_SEGMENT_ROWS", size)
    ids = [0, 1, 5, 6, 7, 20, 21, 40, None]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "bout_id bigint, v string")
    got = sorted(tuple(r) for r in sm.with_position(df).select("position", "v", "total").collect())
    assert got == [(n, str(i), 9) for n, i in enumerate([None, *ids[:-1]])]
    assert sm.with_position(df.limit(0)).count() == 0


def test_positions_need_no_job_of_their_own(spark, monkeypatch):
    jobs = []
    df = spark.range(50).withColumnRenamed("id", "bout_id")
    for name in ("count", "collect", "first"):
        monkeypatch.setattr(type(df), name, lambda *a, **k: jobs.append(a))
    sm.position_split(df), sm.cv_folds(df)
    assert not jobs


def test_events_that_make_no_bout(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(0, 1), (1, 2), (2, 3), (4, 5), (5, 5), (6, 1), (6, 1), (7, 2), (8, None), (9, 4), (None, 7)]
    events = spark.createDataFrame([(i, at, u, "view", 1.0, '{"k": 1}') for i, u in rows], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    got = sorted((tuple(r) for r in t.unpaired_events(events).collect()), key=str)
    want = [(2, 1, "missing corner"), (4, 2, "same entity"), (5, 2, "same entity"), *[(6, 3, "repeated event")] * 2, (7, 3, "repeated event")]
    want += [(8, 4, "unknown entity"), (9, 4, "unknown entity"), (None, None, "missing corner")]
    assert got == sorted(want, key=str)
    bouts = t.bouts_from_events(events)
    assert [r["bout_id"] for r in bouts.collect()] == [0]


def test_half_pairs_are_flagged(spark):
    cols = ["red_a", "blue_a", "red_b", "c"]
    assert md.half_pairs(cols) == ["red_b"]
    feats = spark.createDataFrame([(1, "win", 1.0, 2.0, 3.0, 4.0)], "bout_id bigint, result string, red_a double, blue_a double, red_b double, c double")
    flags = md.half_pairs(cols)
    rows = md.training_rows(feats, cols, flags).orderBy("mirrored").select(*md.input_names(cols, flags), "label").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 3, 4, 0, 1), (2, 1, 0, 4, 1, 0)]
    assert md.numeric_inputs(feats, cols, flags).select(F.max("red_b_missing")).first()[0] == 0


def test_fits_get_rows_dealt_out_evenly(spark, monkeypatch):
    monkeypatch.setattr(md, "FIT_ROWS", 100)
    rows = sm.cv_folds(spark.range(2000).withColumnRenamed("id", "bout_id"))  # all of one segment
    sizes = [len(p) for p in md.spread(rows).rdd.glom().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 2 and max(sizes) < 2 * min(sizes)
    assert md.spread(rows.limit(0)).count() == 0
