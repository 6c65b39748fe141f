"""Two rows per bout, one for each side, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome_of(entity: Column, winner: Column) -> Column:
    return F.when(winner.isNull(), F.lit("draw")).when(winner == entity, F.lit("win")).otherwise(F.lit("loss"))


def long_form(bouts: DataFrame, shared: Sequence[str] = (), sided: Sequence[str] = ()) -> DataFrame:
    """``sided`` names columns that exist as red_x and blue_x; they become own_x and opp_x."""

    def half(side: str, other: str) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.col(side).alias("entity"),
            F.col(other).alias("opponent"),
            outcome_of(F.col(side), F.col("winner")).alias("outcome"),
            *[F.col(f"{side}_{c}").alias(f"own_{c}") for c in sided],
            *[F.col(f"{other}_{c}").alias(f"opp_{c}") for c in sided],
        )

    pair = F.array(half("red", "blue"), half("blue", "red"))
    return bouts.select("bout_id", "d", *shared, F.inline(pair))


def sides_to_wide(long: DataFrame, values: Sequence[str], keys: Sequence[str] = ("bout_id",)) -> DataFrame:
    """red_x and blue_x columns by one aggregation over the bout key, at most two rows per group."""
    cols = [
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}") for c in values for side in ("red", "blue")
    ]
    return long.groupBy(*keys).agg(*cols)


def first_perspective(rows: DataFrame, event: str, order: Sequence[str]) -> DataFrame:
    """Keep one of the mirrored rows (entity, opponent, event) / (opponent, entity, event).

    The rank filter is applied per input partition before the shuffle, so heavy copies stay local.
    """
    key = [F.least("entity", "opponent"), F.greatest("entity", "opponent"), F.col(event)]
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
