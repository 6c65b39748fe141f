import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import scan
from boutline.operators.scan import ALL_KEYS, Run, find_skew, running

KINDS = ("sum", "count", "max", "min", "product", "last")


def brute(rows, kind, prior):
    out = {}
    seen = {}
    for key, order, v in sorted(rows, key=lambda r: (r[0], r[1])):
        past = seen.setdefault(key, [])
        if not prior and v is not None:
            past.append(v)
        known = list(past)
        if kind == "count":
            res = len(known)
        elif not known:
            res = None
        elif kind == "last":
            res = known[-1]
        elif kind == "product":
            res = 1.0
            for x in known:
                res *= x
        else:
            res = {"sum": sum, "max": max, "min": min}[kind](known)
        out[key, order] = res
        if prior and v is not None:
            past.append(v)
    return out


@pytest.mark.parametrize("mode", ["plain", "heavy", "all"])
@pytest.mark.parametrize("prior", [True, False])
def test_running_matches_loop(spark, mode, prior):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", i, None if rng.random() < 0.2 else rng.choice([0.5, 1.5, 2.0])) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, seq bigint, v double").repartition(5)
    skew = {"plain": scan.NO_SKEW, "heavy": find_skew(df, ["key"], 20), "all": ALL_KEYS}[mode]
    if mode == "heavy":
        assert [r["key"] for r in skew.heavy.collect()] == ["hot"]
    runs = [Run(k, k, F.col("v"), prior) for k in KINDS]
    got = running(df, ["key"], "seq", runs, skew, segment=F.floor(F.col("seq") / 7)).collect()
    assert len(got) == len(rows)
    for kind in KINDS:
        want = brute(rows, kind, prior)
        for r in got:
            w = want[r["key"], r["seq"]]
            assert r[kind] == (pytest.approx(w) if w is not None else None), (kind, r)


def test_scan_without_keys_needs_segments(spark):
    df = spark.range(50).withColumnRenamed("id", "seq")
    with pytest.raises(ValueError, match="segments"):
        running(df, [], "seq", [Run("n", "count", F.lit(1))])
    got = running(df, [], "seq", [Run("n", "count", F.lit(1))], ALL_KEYS, F.floor(F.col("seq") / 8))
    assert all(r["n"] == r["seq"] for r in got.collect())


def test_too_many_heavy_keys_segment_everyone(spark, monkeypatch):
    monkeypatch.setattr(scan, "MAX_LISTED_KEYS", 2)
    df = spark.createDataFrame([(k, i) for k in range(4) for i in range(5)], "key int, seq bigint")
    assert find_skew(df, ["key"], 3) == ALL_KEYS
    assert find_skew(df, ["key"], 5) == scan.NO_SKEW


def test_plain_scan_has_one_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("key"), F.rand(1).alias("v"))
    a = running(df, ["key"], "seq", [Run("n", "count", F.lit(1))])
    b = running(a, ["key"], "seq", [Run("s", "sum", F.col("v") * F.col("n"))])
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_segments_of_a_heavy_key_are_spread(spark):
    """Even when the input is already partitioned by the key alone."""
    df = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    df = df.repartition(4, "key")
    skew = find_skew(df, ["key"], 100)
    out = running(df, ["key"], "seq", [Run("n", "count", F.lit(1))], skew, F.floor(F.col("seq") / 100))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") >= 1
    hot = out.where("key = 0").collect()
    assert all(r["n"] == r["seq"] // 3 for r in hot)


@pytest.mark.parametrize("mode", ["heavy", "all"])
def test_null_keys_keep_their_carry(spark, mode):
    rows = [(None, i) for i in range(20)] + [("a", i) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, seq bigint")
    skew = find_skew(df, ["key"], 10) if mode == "heavy" else ALL_KEYS
    got = running(df, ["key"], "seq", [Run("n", "count", F.lit(1))], skew, segment=F.floor(F.col("seq") / 3)).collect()
    assert sorted((r["key"] is None, r["seq"], r["n"]) for r in got) == sorted((k is None, i, i) for k, i in rows)
