import random

import pytest
from pyspark.sql import functions as F
from tests.helpers import frame, random_bouts, replay_ratings

from boutline.operators import ratings as rt
from boutline.operators import scan
from boutline.operators.components import connected_components


def pooled(spark, rows):
    return frame(spark, rows).select(F.col("method").alias("pool"), "bout_id", "d", "red", "blue", "winner")


def check(got, want):
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["red_pre"], r["blue_pre"]) == pytest.approx(want[r["bout_id"]], abs=1e-7)


@pytest.mark.parametrize("names,bound", [(6, 1000), (6, 30), (60, 12), (150, 8)])
def test_groups_equal_loop(spark, monkeypatch, names, bound):
    """One group per pool; short slices in one group each; slices cut into components, and halved where one is too large."""
    seen = []
    parts = rt._parts
    monkeypatch.setattr(rt, "_parts", lambda *a: (seen.append(p[1]) or p for p in parts(*a)))
    monkeypatch.setattr(rt, "BOUTS_PER_ENTITY", 0.7)
    rows = random_bouts(140, names=names)
    check(rt.replay(pooled(spark, rows), group_bouts=bound), replay_ratings(rows))
    assert len(seen) >= (0 if bound == 1000 else 3)
    assert any("pmod" in str(g) for g in seen) == (names >= 60)


def test_components_are_halved(spark, monkeypatch):
    """Slices of the whole pool: every component above the bound sends both halves through again."""
    monkeypatch.setattr(rt, "BOUTS_PER_ENTITY", 100.0)
    rows = random_bouts(60, names=40)
    check(rt.replay(pooled(spark, rows), group_bouts=10), replay_ratings(rows))


def test_replay_with_hot_entity(spark, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 20)
    rows = random_bouts(80, names=8, hot="e0")
    check(rt.replay(pooled(spark, rows), group_bouts=25), replay_ratings(rows))


@pytest.mark.parametrize("days,bound", [(10, 20), (40, 7), (3, 5), (10, 1000)])
def test_period_replay_equals_loop(spark, days, bound):
    """Slices of several days, and days with more bouts than a group may have."""
    rows = random_bouts(60, names=30, days=days)
    check(rt.replay_by_period(pooled(spark, rows), group_bouts=bound), replay_ratings(rows, frozen=True))
    if bound < 1000:
        check(rt.replay_by_period(pooled(spark, rows), fixed_k=32.0, group_bouts=bound), replay_ratings(rows, frozen=True, fixed_k=32))


def test_period_replay_with_hot_entity(spark, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 5)
    rows = random_bouts(50, hot="e0", days=4)
    check(rt.replay_by_period(pooled(spark, rows), group_bouts=5), replay_ratings(rows, frozen=True))


@pytest.mark.parametrize("bound", [1000, 10])
def test_continued_replay(spark, bound):
    rows = random_bouts(60)
    first, known = rt.replay_after(pooled(spark, rows[:35]), None, group_bouts=bound)
    second, _ = rt.replay_after(pooled(spark, rows[35:]), known, group_bouts=bound)
    check(first.unionByName(second), replay_ratings(rows))


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(p, r.randrange(60), r.randrange(60)) for p in "AB" for _ in range(35)] + [("C", i, i + 1) for i in range(50)]
    root = {(p, v): v for p, a, b in edges for v in (a, b)}
    for _ in range(60):
        for p, a, b in edges:
            root[p, a] = root[p, b] = min(root[p, a], root[p, b])
    got = connected_components(spark.createDataFrame(edges, "pool string, a long, b long"), ["pool"]).collect()
    assert {(x["pool"], x["vertex"]): x["root"] for x in got} == root and len(got) == len(root)


def test_equal_k_keeps_the_sum(spark):
    final = rt.final_ratings(rt.replay(pooled(spark, random_bouts(80)), fixed_k=32.0)).collect()
    assert sum(r["rating"] for r in final) == pytest.approx(1000.0 * len(final))


def test_first_bout(spark):
    rows = [r[:4] + (r[2],) + r[5:] for r in random_bouts(1)]
    final = {r["entity"]: r["rating"] for r in rt.final_ratings(rt.replay(pooled(spark, rows))).collect()}
    assert final == {rows[0][2]: 1020.0, rows[0][3]: 980.0}


def test_no_bouts(spark):
    assert rt.replay(pooled(spark, random_bouts(3)).where("false")).count() == 0


def test_opponent_rating(spark):
    rows = random_bouts(60)
    want = replay_ratings(rows)
    got = rt.mean_opponent_rating(rt.rating_sides(rt.replay(pooled(spark, rows)))).collect()
    for r in got:
        past = [
            want[x[0]][1 if x[2] == r["entity"] else 0]
            for x in rows
            if x[0] < r["bout_id"] and x[5] == r["pool"] and r["entity"] in x[2:4]
        ]
        assert r["opponent_rating"] == (pytest.approx(sum(past) / len(past), abs=1e-6) if past else None)


def test_ratings_before_a_slice_are_not_broadcast(spark):
    known = spark.createDataFrame([("p", "a", 5.0, 2)], "pool string, entity string, gain double, bouts bigint")
    part = spark.createDataFrame([("p", 1, "a", "b"), ("p", 2, "c", "a")], "pool string, bout_id bigint, red string, blue string")
    out = rt._with_base(part, known)
    assert [(r["red_base"], r["blue_base"], r["red_seen"], r["blue_seen"]) for r in out.orderBy("bout_id").collect()] == [
        (1005.0, 1000.0, 2, 0), (1000.0, 1005.0, 0, 2)
    ]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_groups_pass_in_batches(spark):
    """A group's rows are never one frame: batches of three rows, several groups and pools in a task, frozen days across batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        rows = random_bouts(70, names=25, days=4)
        for frozen in (False, True):
            got = rt.replay(pooled(spark, rows), frozen=frozen)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "FlatMapGroups" not in plan
            check(got, replay_ratings(rows, frozen=frozen))
            check(rt.replay(pooled(spark, rows), frozen=frozen, group_bouts=9), replay_ratings(rows, frozen=frozen))
    finally:
        spark.conf.set(key, before)
