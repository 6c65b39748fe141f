"""As-of lookups against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boutline.operators.asof import as_of, validity
from boutline.operators.scan import ALL_KEYS, NO_SKEW

DAY = dt.date(2024, 1, 1)


def tables(spark, seed=3):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.05 else DAY + dt.timedelta(days=rng.randrange(12))
    key = lambda: rng.choice(["a", "b", "c", None])
    history = [(key(), day(), i, float(i)) for i in range(40)]
    points = [(key(), day(), f"p{i}") for i in range(60)] + [("new", DAY, "x"), ("a", DAY, "p0")]
    return (
        points,
        history,
        spark.createDataFrame(points, "k string, d date, name string"),
        spark.createDataFrame(history, "k string, d date, n bigint, v double"),
    )


@pytest.mark.parametrize("skew", [NO_SKEW, ALL_KEYS])
@pytest.mark.parametrize("inclusive", [True, False])
def test_newest_row_known(spark, skew, inclusive):
    """Null keys, null times, ties, unknown keys and repeated points; heavy keys cut at days."""
    points, history, p, h = tables(spark)
    got = as_of(p, h, ["k"], "d", "n", ["v"], inclusive, skew)
    assert got.columns == ["k", "d", "name", "v"]

    def plain(k, d):
        known = [(x[1], x[2], x[3]) for x in history if k and d and x[0] == k and x[1] and (x[1] < d or inclusive and x[1] == d)]
        return max(known)[2] if known else None

    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.collect()) == order((k, d, name, plain(k, d)) for k, d, name in points)


def test_empty_tables(spark):
    _, _, p, h = tables(spark)
    assert as_of(p.limit(0), h, ["k"], "d", "n", ["v"]).count() == 0
    assert as_of(p, h.limit(0), ["k"], "d", "n", ["v"]).where("v IS NOT NULL").count() == 0


def test_clashing_columns_are_an_error(spark):
    _, _, p, h = tables(spark)
    with pytest.raises(ValueError, match="name"):
        as_of(p, h.withColumn("name", F.lit(1)), ["k"], "d", "n", ["name"])


@pytest.mark.parametrize("skew", [NO_SKEW, ALL_KEYS])
def test_validity_ends_with_the_next_row(spark, skew):
    _, history, _, h = tables(spark)
    dated = sorted((x for x in history if x[0] and x[1]), key=lambda x: x[:3])
    want = {x[2]: next((y[1] for y in dated[i + 1 :] if y[0] == x[0]), None) for i, x in enumerate(dated)}
    got = validity(h.where("k IS NOT NULL AND d IS NOT NULL"), ["k"], "d", "n", skew)
    assert {r["n"]: r["valid_to"] for r in got.collect()} == want
