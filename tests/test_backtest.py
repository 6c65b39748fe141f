import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import backtest as bt
from boutline.operators import summary as sm
from boutline.operators import textlog as tl
from boutline.operators.scan import ALL_KEYS, NO_SKEW, find_skew

DAY = dt.date(2024, 1, 1)


def settled_frame(spark, rets):
    rows = [("s", i, DAY + dt.timedelta(days=i // 10), float(abs(r)), float(r)) for i, r in enumerate(rets)]
    return spark.createDataFrame(rows, "strategy string, bout_id bigint, d date, share double, ret double").repartition(3)


@pytest.mark.parametrize(("segment_rows", "skew"), [(1000, ALL_KEYS), (7, ALL_KEYS), (7, NO_SKEW)])
def test_bankroll_path_equals_loop(spark, segment_rows, skew):
    rng = random.Random(5)
    rets = [rng.uniform(-0.05, 0.06) for _ in range(60)]
    got = {r["bout_id"]: r for r in bt.bankroll_path(settled_frame(spark, rets), segment_rows=segment_rows, skew=skew).collect()}
    money, top, low = 1000.0, 1000.0, 1000.0
    for i, r in enumerate(rets):
        assert got[i]["bankroll_before"] == pytest.approx(money)
        money *= 1 + r
        top, low = max(top, money), min(low, money)
        assert (got[i]["bankroll"], got[i]["max_bankroll"], got[i]["min_bankroll"]) == pytest.approx((money, top, low))


def test_two_bets(spark):
    df = settled_frame(spark, [0.04, -0.02])
    assert [r["bankroll"] for r in bt.bankroll_path(df).orderBy("bout_id").collect()] == pytest.approx([1040, 1019.2])
    card = bt.card_path(df).first()
    assert (card["bankroll"], card["card_stake"]) == pytest.approx((1020, 60))


def test_cards_compound(spark):
    cards = bt.card_path(settled_frame(spark, [0.01] * 25)).orderBy("d").collect()
    assert [c["bankroll"] for c in cards] == pytest.approx([1100, 1210, 1210 * 1.05])
    s = bt.card_summary(bt.card_path(settled_frame(spark, [0.01] * 25))).first()
    assert s["max_card_stake"] == pytest.approx(110) and s["min_bankroll"] == 1000


def bet_rows(spark):
    rows = [
        (1, DAY, "a", "b", "a", -150, 130, 0.7, 0.35),
        (2, DAY, "a", "b", "b", 120, -140, 0.6, 0.45),
        (3, DAY, "c", "d", None, 100, 100, 0.8, 0.2),
        (4, DAY, "c", "d", "d", None, 100, 0.8, 0.2),
    ]
    schema = "bout_id bigint, d date, red string, blue string, winner string, red_odds int, blue_odds int, p_ab double, p_ba double"
    return spark.createDataFrame(rows, schema)


def test_summary_counts(spark):
    bets = bt.priced_bets(bet_rows(spark))
    assert bets.count() == 3  # missing odds drop out
    flat = bt.for_strategies(bets, [bt.Strategy("flat", 0.05, 0.05, 0.01)])
    s = bt.backtest_summary(bt.bankroll_path(flat)).first()
    assert (s["predictions"], s["correct_predictions"], s["bets"], s["correct_bets"]) == (3, 1, 2, 1)
    assert s["bet_pct"] == 50 and s["final_bankroll"] == pytest.approx(1000 + s["favourite_gain"] + s["underdog_gain"] - s["favourite_loss"] - s["underdog_loss"])
    none = bt.backtest_summary(bt.bankroll_path(bt.for_strategies(bets.where("false"), [bt.PRESETS[0]])))
    assert none.count() == 0


def test_prediction_lookup_first_and_last(spark):
    rows = spark.createDataFrame([("a", "b", 0.1, 1), ("a", "b", 0.9, 2), ("b", "a", 0.4, 3)], "red string, blue string, p double, row_no int")
    pick = lambda keep: {(r["red"], r["blue"]): r["p"] for r in bt.prediction_table(rows, keep).collect()}
    assert pick("last") == {("a", "b"): 0.9, ("b", "a"): 0.4}
    assert pick("first") == {("a", "b"): 0.1, ("b", "a"): 0.4}
    matched = bt.match_predictions(bet_rows(spark).drop("p_ab", "p_ba"), bt.prediction_table(rows))
    assert {r["bout_id"]: (r["p_ab"], r["p_ba"]) for r in matched.collect()} == {1: (0.9, 0.4), 2: (0.9, 0.4)}


def test_winner_lookup(spark):
    b = spark.createDataFrame([(1, "a", "b", "win"), (2, "b", "a", "?"), (3, "x", "y", "?"), (4, "a", "b", "draw")], "id int, red string, blue string, corner_outcome string")
    res = spark.createDataFrame([("a", "b", "a", 1), ("b", "a", None, 2)], "red string, blue string, winner string, row_no int")
    got = {r["id"]: r["winner_name"] for r in bt.resolve_winner(b, res).collect()}
    assert got == {1: "b", 2: "draw/no contest", 3: "", 4: "draw/no contest"}


def test_retraining_days(spark):
    days = [DAY + dt.timedelta(days=i) for i in (0, 3, 8, 9, 20, 21)]
    found = bt.retrain_days(days, DAY, 7, days[-1])
    assert found == [DAY, days[2], days[4]]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"]: r["model_epoch"] for r in bt.with_epoch(df, found).collect()}
    assert got == dict(zip(days, [DAY, DAY, days[2], days[2], days[4], days[4]], strict=True))


def test_epochs_by_cards(spark):
    days = [DAY + dt.timedelta(days=i * i) for i in range(1, 26)]
    bouts = [(2 * i, d) for i, d in enumerate(days)] + [(2 * i + 1, d) for i, d in enumerate(days)] + [(99, None)]
    df = spark.createDataFrame(bouts, "bout_id long, d date")
    model, state, want = None, None, {}
    for n, d in enumerate(days, 1):  # a card is scored before it is learned from
        want[d] = (n, model, state)
        if n % 8 == 0 or n % 10 == 0:
            state = d
        if n % 10 == 0:
            model = d
    got = [(r["bout_id"], r["d"], (r["card"], r["model_through"], r["state_through"])) for r in bt.with_card_epochs(df).collect()]
    assert sorted(got) == sorted((b, d, want[d]) for b, d in bouts if d)
    assert bt.card_training_days(df, 10) == [days[10], days[20]]
    registry = sorted(map(tuple, bt.card_registry(bt.cards(df), 10).select("version", "through", "valid_from", "valid_to").collect()))
    assert registry == [(0, None, 1, 10), (1, days[9], 11, 20), (2, days[19], 21, 30)]
    assert bt.with_card_epochs(df.limit(0)).count() == 0 and bt.card_training_days(df.limit(0)) == []


def test_cv_folds(spark):
    df = spark.range(20).withColumnRenamed("id", "bout_id")
    got = sm.cv_folds(df).orderBy("bout_id").collect()
    assert [r["fold"] for r in got] == [None] * 5 + [f for f in range(5) for _ in range(3)]


def test_position_split(spark):
    df = spark.range(100).withColumnRenamed("id", "bout_id")
    got = [r["split"] for r in sm.position_split(df).orderBy("bout_id").collect()]
    assert got == ["pruned"] * 28 + ["train"] * 67 + ["test"] * 5


def test_trials(spark):
    vals = [900.0, 3100.0, 1000.0, 1200.0]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    assert [r["i"] for r in sm.after_last_peak(df, "i", "v").orderBy("i").collect()] == [2, 3]
    assert sm.after_last_peak(df.where("v < 3000"), "i", "v").count() == 3
    assert sm.trial_summary(df, "v").first().asDict() == {"trials": 4, "mean_bankroll": 1550.0, "above": 2, "below": 1}


def test_scores_and_pruning(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.4), (1, 0.5)], "label int, p double")
    s = sm.score_metrics(df).first()
    assert s["accuracy"] == pytest.approx(2 / 3) and s["log_loss"] == pytest.approx(0.47570, abs=1e-4)
    rows = [(float(i), 2.0 * i + (i % 2) * 0.01, float((i * 7) % 5)) for i in range(40)]
    num = spark.createDataFrame(rows, "a double, b double, c double")
    narrow = sm.correlation_pairs(num, ["a", "b", "c"])
    assert sm.kept_columns(narrow, ["a", "b", "c"]) == ["a", "c"]
    wide = num.select("a", "b", "c", *[(F.col("a") * (i % 3) + F.rand(i)).alias(f"x{i}") for i in range(20)])
    cols = wide.columns
    big = {(r["col_a"], r["col_b"]): r["r"] for r in sm.correlation_pairs(wide, cols).collect()}
    for r in narrow.collect():
        assert big[r["col_a"], r["col_b"]] == pytest.approx(r["r"], abs=1e-9)


def test_pruning_with_constant_null_and_many_columns(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    data = rng.normal(5, 2, (300, 22))
    data[:, 4] = data[:, 1] * 3 + 1
    data[:, 2] = 0.1
    data[rng.random(data.shape) < 0.15] = np.nan
    data[:, 9] = np.nan
    cols = [f"c{i}" for i in range(22)]
    pdf = pd.DataFrame(data, columns=cols)
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in data], ", ".join(f"{c} double" for c in cols))
    want = pdf.corr().abs()
    for width in (5, 22):
        pairs = sm.correlation_pairs(df.repartition(3), cols[:width])
        got = {(r["col_a"], r["col_b"]): r["r"] for r in pairs.collect()}
        assert len(got) == width * (width - 1) // 2
        for (a, b), r in got.items():
            w = want.loc[a, b]
            assert (r is None and np.isnan(w)) or ("c2" in (a, b) and r is None) or r == pytest.approx(w, abs=1e-9)
        assert sm.kept_columns(pairs, cols[:width]) == [c for c in cols[:width] if c != "c4"]


def test_ruin_stays_ruin(spark):
    rows = [("s", i, r) for i, r in enumerate([0.5, -1.0, 0.5])] + [(None, i, 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, "strategy string, bout_id long, ret double")
    path = bt.bankroll_path(df, segment_rows=2).collect()
    assert len(path) == 23
    ruined = {r["bout_id"]: (r["bankroll"], r["log_growth"]) for r in path if r["strategy"]}
    assert ruined[0][0] == pytest.approx(1500.0) and ruined[1] == ruined[2] == (0.0, float("-inf"))
    last = max((r for r in path if r["strategy"] is None), key=lambda r: r["bout_id"])
    assert last["bankroll"] == pytest.approx(1000 * 1.1**20)


def test_low_importance(spark):
    df = spark.createDataFrame([(f"f{i}", float(i)) for i in range(21)], "feature string, importance double")
    assert sorted(r["feature"] for r in sm.low_importance(df).collect()) == ["f0", "f1", "f2"]


@pytest.mark.parametrize("limit", [10**6, 10])
def test_log_sections(spark, limit):
    lines = ["fighter_names", "1 ann*bob", "2 cat*dan", "dtype: object", "9 stray", "probability_win", "1   0.25", "2   0.75"]
    rows = [(f, i, x) for f in ("p", "q") for i, x in enumerate(lines * 2 if f == "q" else lines)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, line string")
    header = (
        F.when(F.col("line") == "fighter_names", "names")
        .when(F.col("line").startswith("dtype:"), "end")
        .when(F.col("line") == "probability_win", "probability")
    )
    skew = find_skew(df, ["file"], limit)
    tagged = tl.tag_sections(df, header, ["file"], skew=skew if limit > 10 else ALL_KEYS)
    ident = F.regexp_extract("line", r"^(\d+)\s", 1).try_cast("int")
    got = tl.lookup_across_sections(tagged.where("file = 'p'"), ["file"], ident, "names", "probability").collect()
    assert sorted((r["left_line"], r["right_line"]) for r in got) == [("1 ann*bob", "1   0.25"), ("2 cat*dan", "2   0.75")]


def test_bankroll_marks(spark):
    text = ["*** Bankroll: $1059.32 ***", "Bankroll: $100.00", "Fight Card: x", "Bankroll: 1182.49"]
    df = spark.createDataFrame(list(enumerate(text)), "line_no int, line string")
    got = [(r["kind"], r["bankroll"]) for r in tl.bankroll_marks(df).orderBy("line_no").collect()]
    assert got == [("marked", 1059.32), ("plain", 100.0), ("plain", 1182.49)]


def test_whole_bankroll_report_beyond_doubles(spark):
    """Gains and losses of one bankroll that outgrows a double, and of one that is ruined."""
    n = 4000
    rows = [("up", i, 0.5 if i % 4 else -0.1, 0.1, 1 if i % 4 else 2, 1, -150 if i % 2 else 130) for i in range(n)]
    rows += [("ruin", i, r, s, 1, w, 120) for i, (r, s, w) in enumerate([(0.2, 0.1, 1), (-1.0, 1.0, 2), (0.5, 0.5, 1), (0.0, 0.5, None)])]
    schema = "strategy string, bout_id bigint, ret double, share double, pick bigint, winner bigint, pick_odds int"
    settled = spark.createDataFrame(rows, schema).withColumn("correct", F.coalesce(F.col("pick") == F.col("winner"), F.lit(False)))
    got = {r["strategy"]: r for r in bt.bankroll_report(bt.bankroll_path(settled, segment_rows=300)).collect()}

    def log_sum(terms):
        top = max(terms)
        return top + math.log(sum(math.exp(x - top) for x in terms))

    log, want = 0.0, {"log_favourite_gain": [], "log_underdog_gain": [], "log_underdog_loss": []}
    for _, i, ret, share, pick, winner, odds in rows[:n]:
        hit, kind = pick == winner, "favourite" if odds < 0 else "underdog"
        want[f"log_{kind}_{'gain' if hit else 'loss'}"].append(log + math.log(ret if hit else share))
        log += math.log(1 + ret)
    assert log > 800  # e^800 is beyond a double
    assert got["up"]["log_growth"] == pytest.approx(log)
    for name, terms in want.items():
        assert got["up"][name] == pytest.approx(log_sum(terms)), name
    assert got["up"]["log_favourite_loss"] is None
    ruin = got["ruin"]
    assert (ruin["bets"], ruin["correct_bets"], ruin["predictions"]) == (3, 2, 4)
    assert ruin["log_growth"] == float("-inf")
    assert ruin["log_underdog_gain"] == pytest.approx(math.log(0.2))
    assert ruin["log_underdog_loss"] == pytest.approx(math.log(1.2))
