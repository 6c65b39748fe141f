"""As-of lookup: for each point in time the newest row of a history that was known then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators.scan import NO_SKEW, Run, Skew, running


def as_of(
    points: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    values: Sequence[str],
    inclusive: bool = True,
    skew: Skew = NO_SKEW,
    segment: Column | None = None,
) -> DataFrame:
    """``points`` with the ``values`` of the newest row of ``history`` (keys, time, tie, values) at or before its time.

    Both tables are laid on one line of time per key and sorted once; the last value is carried forward, so nothing
    is joined by a range. ``tie`` orders rows of ``history`` of one time. Without ``inclusive`` a row of the same time
    is not known yet. Heavy keys (``skew``) are cut at days, or by ``segment``, a column that never falls with time.

    Points without a time, or before all history, keep null values, and so do those with a null key. History rows
    without a time or a key are never found. Names of ``points`` and ``values`` must differ.
    """
    clash = set(points.columns) & set(values)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    known = history.where(F.col(time).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    first = 0 if inclusive else 1
    found = F.struct(*values)
    asked = points.select(
        *keys, time, F.lit(1 - first).alias("_kind"), F.lit(None).cast(history.schema[tie].dataType).alias("_tie"),
        F.struct(*points.columns).alias("_point"),
    )
    told = known.select(*keys, time, F.lit(first).alias("_kind"), F.col(tie).alias("_tie"), found.alias("_known"))
    rows = asked.unionByName(told, allowMissingColumns=True).withColumn("_order", F.struct(time, "_kind", "_tie"))
    if segment is None:
        segment = F.coalesce(F.unix_date(F.col(time).cast("date")), F.lit(-(2**31)))
    out = running(rows, keys, "_order", [Run("_last", "last", F.col("_known"))], skew, segment)
    return out.where(F.col("_point").isNotNull()).select("_point.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def validity(history: DataFrame, keys: Sequence[str], time: str, tie: str, skew: Skew = NO_SKEW) -> DataFrame:
    """``history`` with ``valid_to``, the time of the key's next row (null for its newest); a row holds from its time to that.

    Of rows with one time only the last by ``tie`` holds for longer than no time at all. Rows without a time sort first.
    """
    # the next row is the last one seen on a line of time that runs backwards
    back = history.withColumn("_back", F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), (-F.col(tie)).alias("n")))
    segment = F.coalesce(-F.unix_date(F.col(time).cast("date")), F.lit(2**31 - 1))
    return running(back, keys, "_back", [Run("valid_to", "last", F.col(time))], skew, segment).drop("_back")
