import datetime as dt

import pytest
from pyspark.sql import functions as F

from boutline.functions import betting, parse, rating


def values(spark, column, rows, schema="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_ratio(spark):
    assert values(spark, parse.ratio_landed(F.col("a")), ["12 of 40", "0 of 0", "---", "7"]) == [12, 0, None, 7]
    assert values(spark, parse.ratio_share(F.col("a")), ["12 of 40", "0 of 0", "---"]) == [0.3, 0, None]


def test_clock(spark):
    assert values(spark, F.round(parse.clock_minutes(F.col("a")), 6), ["4:35", "--", "2.5"]) == [4.583333, None, 2.5]
    assert values(spark, parse.bout_minutes(F.lit(3), F.lit(2.5)), ["x"]) == [12.5]


def test_dates(spark):
    texts = ["October 01, 1990", "Oct 01, 1990", "Oct. 01, 1990", "Oct 1 1990", "Monday, October 1, 1990", "--", None]
    assert values(spark, parse.any_date(F.col("a")), texts) == [dt.date(1990, 10, 1)] * 5 + [None, None]


def test_physique_and_record(spark):
    assert values(spark, parse.height_inches(F.col("a")), ["6' 4\"", "--"]) == [76, None]
    assert values(spark, parse.first_int(F.col("a")), ['155 lbs.', '72"', "--"]) == [155, 72, None]
    for i, want in ((1, 27), (2, 1), (3, 0)):
        assert values(spark, parse.record_part(F.col("a"), i), ["27-1-0 (1 NC)"]) == [want]


def test_lenient_number(spark):
    assert values(spark, parse.lenient_number(F.col("a")), ["45% foo", "3.5", "x", None, "125 lbs."]) == [0.45, 3.5, 0, 0, 125]


def test_odds_and_names(spark):
    assert values(spark, parse.odds_int(F.col("a")), ["−170", "-", "+140", "250"]) == [-170, None, 140, 250]
    assert values(spark, parse.plain_name(F.col("a")), [" José Jiří "]) == ["Jose Jiri"]
    assert values(spark, parse.label_code(F.col("a")), ["loss", "win", "draw"]) == [0, 1, None]


def test_implied_and_kelly(spark):
    got = values(spark, F.round(betting.implied_prob(F.col("a")), 6), [140, -170, 100, -100], "a int")
    assert got == [0.416667, 0.62963, 0.5, 0.5]
    rows = [(440, 0.57), (-200, 0.6), (100, 0.5), (0, 0.7)]
    got = values(spark, F.round(betting.kelly(F.col("a"), F.col("p")), 6), rows, "a int, p double")
    assert got == [0.472273, -0.2, 0, None]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((0.6, 0.55, -150, 100), {"closer": (0.525, 0.475), "independent": (0.6, 0.55), "b_decides": (0.45, 0.55), "average": (0.525, 0.475)}),
        ((0.6, 0.5, 100, -120), {"closer": (0.5, 0.5), "independent": (0.5, 0.5), "b_decides": (0.5, 0.5), "average": (0.55, 0.45)}),
    ],
)
def test_reconcile(spark, args, want):
    df = spark.createDataFrame([args], "p double, q double, a int, b int")
    for mode, pair in want.items():
        x, y = betting.reconcile(mode, *(F.col(c) for c in "pqab"))
        assert df.select(F.round(x, 9), F.round(y, 9)).first() == pair
    with pytest.raises(ValueError, match="unknown mode"):
        betting.reconcile("none", *(F.col(c) for c in "pqab"))


@pytest.mark.parametrize(
    ("rule", "fraction", "want"),
    [
        ("kelly", 0.05, [0.02, 0.005, 0.005, None, None]),
        ("tenth", 0.1, [0.04, 0.002, 0.005, 0.005, None]),
        ("positive", 0.05, [0.02, 0.001, None, None, None]),
        ("flat", 0.05, [0.005, 0.005, None, None, None]),
    ],
)
def test_stakes(spark, rule, fraction, want):
    share = F.round(betting.stake_share(F.col("k"), fraction, 0.05, 0.005, rule), 9)
    assert values(spark, share, [0.4, 0.02, -0.3, -0.5, None], "k double") == want


def test_settle(spark):
    rows = [(0.02, 200, "a", "a"), (0.02, 200, "a", None), (0.02, 200, "a", "b"), (None, 200, "a", "a")]
    c = betting.settle(F.col("s"), F.col("o"), F.col("p"), F.col("w"))
    assert values(spark, F.round(c, 9), rows, "s double, o int, p string, w string") == [0.04, 0, -0.02, 0]


def test_elo_formulas(spark):
    rows = [(1000.0, 1000.0), (1400.0, 1000.0)]
    got = values(spark, F.round(rating.expected_score(F.col("a"), F.col("b")), 6), rows, "a double, b double")
    assert got == [0.5, 0.909091]
    assert values(spark, rating.k_factor(F.col("n")), [4, 5, 9, 10, 19, 20], "n int") == [40, 35, 35, 30, 30, 25]
