"""Elo formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_RATING = 1000.0
# fixed values: bouts below the bound (counting the current one) and their K
K_TIERS = ((5, 40.0), (10, 35.0), (20, 30.0))
K_REST = 25.0


def expected_score(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


def k_factor(bouts: Column) -> Column:
    (first, k), *rest = K_TIERS
    c = F.when(bouts < first, F.lit(k))
    for bound, k in rest:
        c = c.when(bouts < bound, F.lit(k))
    return c.otherwise(F.lit(K_REST))


def score_of(outcome: Column) -> Column:
    return F.when(outcome == "win", F.lit(1.0)).when(outcome == "loss", F.lit(0.0)).otherwise(F.lit(0.5))


def rating_change(k: Column, score: Column, own: Column, other: Column) -> Column:
    return k * (score - expected_score(own, other))
