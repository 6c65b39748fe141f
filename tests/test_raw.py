import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import clean
from boutline.operators import features as fx
from boutline.operators import ratings as rt
from boutline.sources import files, raw

BASE = ["KD", "Sig. str.", "Total str.", "Td", "Sub. att", "Rev.", "Ctrl", "Head", "Body", "Leg", "Distance", "Clinch", "Ground"]
RATIOS = {"Sig. str.", "Total str.", "Td", "Head", "Body", "Leg", "Distance", "Clinch", "Ground"}
HEADER = [
    "Title", "Winner", "Loser", "Draw", "Method", "Round", "Time", "Details", "Date", "Red Fighter", *[f"Red {s}" for s in BASE],
    "Blue Fighter", *[f"Blue {s}" for s in BASE],
]


def csv_rows(count, seed=4):
    """Newest bout first; several bouts share a day."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(6)]
    out = []
    for i in range(count):
        red, blue = rng.sample(names, 2)
        win = rng.choice([red, blue])
        stat = lambda s: f"{rng.randint(0, 9)} of {rng.randint(9, 20)}" if s in RATIOS else "1:30" if s == "Ctrl" else str(rng.randint(0, 3))
        title = "Title Bout" if i % 5 == 0 else "Bout"
        out.append(
            [title, win, blue if win == red else red, "False", "KO/TKO", "2", "2:30", "", f"March {1 + i // 4}, 2021", red,
             *map(stat, BASE), blue, *map(stat, BASE)]
        )
    return out[::-1]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "bouts.csv"
    rows = csv_rows(48)
    path.write_text("\n".join(",".join(f'"{v}"' for v in r) for r in [HEADER, *rows]))
    read = raw.read_newest_first(spark, str(path), HEADER)
    cleaned = clean.clean_raw(read, drop=["Details"])
    bouts, stats = raw.typed_bouts(cleaned)
    return rows[::-1], cleaned.columns, bouts, stats


def test_order_and_stats(built):
    rows, _, bouts, stats = built
    got = bouts.orderBy("bout_id").collect()
    assert [(r["red"], r["blue"], r["winner"]) for r in got] == [(r[9], r[23], r[1]) for r in rows]
    assert len(stats) == 22 and sum(s.share for s in stats) == 9
    assert got[0]["minutes"] == 7.5 and got[0]["red_ctrl"] == 1.5 and got[0]["is_title"]


def test_report_has_all_columns(spark, built):
    _, header, bouts, stats = built
    people = spark.createDataFrame([(i, f"n{i % 6}", "Oct 01, 1990") for i in range(8)], "id int, name string, DOB string")
    master = raw.first_master(people)
    assert master.count() == 6
    sides = rt.rating_sides(rt.replay(bouts.withColumn("pool", F.lit("all"))))
    rated = rt.mean_opponent_rating(sides).select(
        "bout_id", "entity", F.col("own_pre").alias("elo"), F.col("opponent_rating").alias("opp_elo")
    )
    feats = fx.bout_features(bouts, master, stats, ratings=rated)
    report = raw.report_frame(feats, header)
    assert len(report.columns) == len(set(report.columns)) == 197
    wanted = {
        "Red Sig. str.% differential", "Blue Ground% defense", "Total str. oppdiff", "Red oppelo", "last_fight oppdiff", "Result",
        "Blue avg age", "Red totalfights", "KD differential oppdiff", "Title", "Date", "Red Fighter",
    }
    assert wanted <= set(report.columns)
    assert report.count() > 20
    assert files.columns_without(report.columns, words=["oppdiff"], names=["Result"])[:1] == ["Date"]


def test_undated_bouts_come_last(spark, tmp_path):
    """A date that cannot be read must not move a bout in front of the dated ones."""
    rows = csv_rows(12)
    rows[7][HEADER.index("Date")] = "soon"
    path = tmp_path / "bouts.csv"
    path.write_text("\n".join(",".join(f'"{v}"' for v in r) for r in [HEADER, *rows]))
    bouts, _ = raw.typed_bouts(clean.clean_raw(raw.read_newest_first(spark, str(path), HEADER)))
    days = [r["d"] for r in bouts.orderBy("bout_id").collect()]
    assert days[-1] is None and days[:-1] == sorted(days[:-1])
