import datetime as dt

import pytest
from pyspark.sql import functions as F
from tests.helpers import frame, random_bouts, replay_features

from boutline.operators import features as fx
from boutline.operators import running as run
from boutline.operators import scan
from boutline.operators.running import BASE_STATS
from boutline.operators.scan import find_skew

DAY = dt.date(2024, 1, 1)


def sides_of(spark, rows, skew=scan.NO_SKEW, compat=False):
    long = fx.entity_long(frame(spark, rows)).withColumn("dob", F.lit("1990-05-05").cast("date"))
    return fx.side_features(long, BASE_STATS, skew, compat)


def master_of(spark, names, missing=()):
    return spark.createDataFrame([(n, None if n in missing else dt.date(1990, 1, 1)) for n in names], "entity string, dob date")


def bout(i, red, blue, winner, minutes=5.0, rkd=1.0, bkd=1.0, bpct=0.5, title=False):
    return (i, DAY + dt.timedelta(days=i), red, blue, winner, "A", title, minutes, rkd, bkd, 1.0, 1.0, 0.5, bpct, 1.0, 1.0)


@pytest.mark.parametrize("segment_rows", [10**6, 15])
def test_side_features_match_loop(spark, monkeypatch, segment_rows):
    monkeypatch.setattr(scan, "SEGMENT_ROWS", segment_rows)
    rows = random_bouts(120, hot="e1")
    long = fx.entity_long(frame(spark, rows))
    skew = find_skew(long, ["entity"])
    assert (skew.heavy is None) == (segment_rows > 1000)
    want = replay_features(rows)
    got = sides_of(spark, rows, skew).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        for name, v in want[r["bout_id"], r["side"]].items():
            assert r[name] == (pytest.approx(v) if v is not None else None), (name, r)


def test_hand_computed_recency(spark):
    rows = [bout(0, "x", "y", "x", rkd=2.0, bkd=1.0, bpct=0.4), bout(1, "x", "z", "x", rkd=3.0, bkd=5.0, bpct=0.5), bout(2, "x", "y", "x")]
    third = lambda compat: [r for r in sides_of(spark, rows, compat=compat).collect() if r["bout_id"] == 2 and r["side"] == "red"][0]
    r = third(False)
    assert (r["kd_rate"], r["kd_diff"], r["sig_pct_def"]) == pytest.approx((0.56, -1.4, 0.52))
    assert third(True)["sig_pct_def"] == pytest.approx(run.pyramid(1.3))


def test_streak_sequence(spark):
    results = ["x", "x", None, "x", "y", "x"]
    rows = [bout(i, "x", "y", w) for i, w in enumerate(results)]
    got = sorted((r["bout_id"], r["win_streak"], r["lose_streak"]) for r in sides_of(spark, rows).collect() if r["entity"] == "x")
    assert got == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 2, 0), (4, 3, 0), (5, 0, 1)]
    long = fx.entity_long(frame(spark, rows))
    reset = run.streaks(long, draws_reset=True).where("entity = 'x'").orderBy("bout_id").collect()
    assert [r["win_streak"] for r in reset] == [0, 1, 2, 0, 1, 0]


def test_no_leak(spark):
    rows = random_bouts(80)
    master = master_of(spark, [f"e{i}" for i in range(6)])
    full = fx.bout_features(frame(spark, rows), master).where("bout_id < 50")
    cut = fx.bout_features(frame(spark, rows[:50]), master)
    key = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert key(full) == key(cut)


def test_eligibility(spark):
    rows = random_bouts(60)
    master = master_of(spark, [f"e{i}" for i in range(6)], missing=("e3",))
    got = fx.bout_features(frame(spark, rows), master).collect()
    want = replay_features(rows)
    ok = {
        r[0] for r in rows
        if r[4] is not None and "e3" not in r[2:4] and min(want[r[0], s]["prior_bouts"] for s in ("red", "blue")) >= 2
    }
    assert {r["bout_id"] for r in got} == ok
    for r in got:
        assert r["win_streak_oppdiff"] == r["red_win_streak"] - r["blue_win_streak"]


def test_swap_is_its_own_inverse(spark):
    feats = fx.bout_features(frame(spark, random_bouts(60)), master_of(spark, [f"e{i}" for i in range(6)]))
    twice = fx.swapped(fx.swapped(feats))
    assert sorted(map(str, twice.collect())) == sorted(map(str, feats.collect()))
    both = fx.mirrored(feats)
    assert both.count() == 2 * feats.count()
    balance = both.groupBy("result").count().collect()
    assert len({r["count"] for r in balance}) == 1
    assert abs(both.agg(F.sum("kd_diff_oppdiff")).first()[0]) < 1e-9


def test_card_features_equal_next_bout(spark):
    rows = random_bouts(60)
    names = [f"e{i}" for i in range(6)]
    nxt = bout(60, "e0", "e1", "e0")
    whole = fx.bout_features(frame(spark, [*rows, nxt]), master_of(spark, names)).where("bout_id = 60").first()
    state = fx.entity_state(fx.entity_long(frame(spark, rows)))
    card = spark.createDataFrame([(1, "e0", "e1"), (2, "e0", "nobody")], "bout_id bigint, red string, blue string")
    got = {r["corner_order"]: r for r in fx.card_features(card, state, master_of(spark, names), F.lit(nxt[1])).collect()}
    assert set(got) == {"ab", "ba"}
    for c in fx.feature_columns():
        assert got["ab"][f"red_{c}"] == pytest.approx(whole[f"red_{c}"]), c
        assert got["ba"][f"red_{c}"] == pytest.approx(whole[f"blue_{c}"]), c
        assert got["ba"][f"{c}_oppdiff"] == pytest.approx(-whole[f"{c}_oppdiff"]), c


def test_power_rating_by_hand(spark):
    rows = [bout(i, "x", "y", "x" if i != 3 else "y") for i in range(6)]
    recs = spark.createDataFrame([("x", 3, 1, 0, 0.5), ("y", 1, 3, 0, 0.0)], "entity string, wins int, losses int, draws int, acc double")
    got = {r["entity"]: r["power"] for r in run.power_rating(fx.entity_long(frame(spark, rows)), recs, {"acc": 3.0}).collect()}
    # x, newest first: win win loss win win against y, who won a quarter
    assert got["x"] == pytest.approx(1.5 + 25 * 0.25 + 22 * 0.25 - 19 * 0.75 + 16 * 0.25 + 13 * 0.25)


def test_invalid_matchups_and_compare(spark):
    known = spark.createDataFrame([("a",), ("b",)], "entity string")
    asked = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", "q"), (4, None, "a")], "id int, red string, blue string")
    got = {r["id"]: r["reason"] for r in fx.invalid_matchups(asked, known).collect()}
    assert got == {2: "same entity", 3: "unknown entity", 4: "missing name"}
    state = spark.createDataFrame([("a", 3), ("b", 5)], "entity string, wins int")
    row = fx.compare_entities(state, F.lit("b"), F.lit("a"), ["wins"]).first()
    assert (row["a_entity"], row["a_wins"], row["b_wins"]) == ("b", 5, 3)


def test_prefixed_pairs(spark):
    state = spark.createDataFrame([(1, 3, 2), (2, 2, None), (3, 1, 1), (None, 9, 9)], "entity long, bouts long, wins long")
    asked = spark.createDataFrame([(10, 1, 2), (11, 2, 1), (12, 1, 3), (13, 1, 99), (14, None, 1), (15, 1, 1)], "bout_id long, red long, blue long")
    got = fx.prefixed_pairs(asked, state)
    assert got.columns == ["bout_id", *[f"{p}_{c}" for p in ("fighter", "opponent") for c in ("entity", "bouts", "wins")], "result", "date"]
    ends = ("unknown", "unknown")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(10, 1, 3, 2, 2, 2, None, *ends), (11, 2, 2, None, 1, 3, 2, *ends), (15, 1, 3, 2, 1, 3, 2, *ends)]
    assert fx.prefixed_pairs(asked.limit(0), state).count() == 0
