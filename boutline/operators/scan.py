"""Running aggregates that stay parallel when one key holds a large share of the rows.

A plain window puts every row of a key into one task. That is right for keys of ordinary size and
needs one shuffle. Keys above ``SEGMENT_ROWS`` rows are instead cut into segments of consecutive
order values: each segment is reduced to one row, the few segment rows are scanned, and the carried
value is joined back and combined with the running value inside the segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 1_000_000
GLOBAL_SEGMENT_ROWS = 200_000
MAX_LISTED_KEYS = 10_000


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``kind`` is sum, count, max, min, product or last (non-null)."""

    name: str
    kind: str
    value: Column
    prior: bool = True


@dataclass(frozen=True)
class Skew:
    """Which keys need segments: none (``heavy`` is None), the listed ones, or all of them."""

    everyone: bool = False
    heavy: DataFrame | None = None


NO_SKEW = Skew()
ALL_KEYS = Skew(everyone=True)


def find_skew(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> Skew:
    """Count rows per key (combined map-side) and list the keys above ``limit``.

    At most rows/limit keys can be heavy. A longer list than ``MAX_LISTED_KEYS`` is not collected;
    every key then gets segments, which gives the same result.
    """
    limit = SEGMENT_ROWS if limit is None else limit
    rows = (
        df.groupBy(*keys)
        .count()
        .where(F.col("count") > limit)
        .select(*keys)
        .limit(MAX_LISTED_KEYS + 1)
        .collect()
    )
    if not rows:
        return NO_SKEW
    if len(rows) > MAX_LISTED_KEYS:
        return ALL_KEYS
    return Skew(heavy=df.sparkSession.createDataFrame(rows, df.select(*keys).schema))


def _reduce(run: Run, order: str) -> Column:
    v = run.value
    if run.kind == "last":
        return F.max_by(v, F.when(v.isNotNull(), F.col(order)))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "product": F.product}[run.kind](v)


def _over(run: Run, value: Column, window: Window, prior: bool) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if prior else 0)
    if run.kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    if run.kind == "count":
        return F.count(value).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product}[run.kind](value).over(frame)


def _carry(run: Run, column: str, window: Window) -> Column:
    """Scan of segment totals; counts of segments add up."""
    kind = "sum" if run.kind == "count" else run.kind
    return _over(Run(run.name, kind, run.value), F.col(column), window, True)


def _combine(run: Run, carried: Column, local: Column) -> Column:
    if run.kind == "count":
        return F.coalesce(carried, F.lit(0)) + local
    if run.kind == "sum":
        return F.coalesce(carried + local, carried, local)
    if run.kind == "product":
        return F.coalesce(carried * local, carried, local)
    if run.kind == "max":
        return F.greatest(carried, local)
    if run.kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def _together(keys: Sequence[str]) -> Column:
    """The keys as one value that is never null: fields of equal structs may be null, so null keys meet as well."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    runs: Sequence[Run],
    skew: Skew = NO_SKEW,
    segment: Column | None = None,
) -> DataFrame:
    """Add one column per run; rows of a key are ordered by ``order`` (an integer unique in the key).

    ``segment`` must not decrease with ``order`` and must bound the rows of one (key, segment).
    """
    keys = list(keys)
    if not keys and not skew.everyone:
        raise ValueError("a scan over all rows needs segments: pass skew=ALL_KEYS")
    if not skew.everyone and skew.heavy is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[_over(r, r.value, w, r.prior).alias(r.name) for r in runs])

    if segment is None:
        size = SEGMENT_ROWS if keys else GLOBAL_SEGMENT_ROWS
        segment = F.floor(F.col(order) / size)
    if skew.everyone:
        cut = df.withColumn("_seg", segment)
    else:
        flag = skew.heavy.select(_together(keys).alias("_key"), F.lit(True).alias("_heavy"))
        cut = (
            df.withColumn("_key", _together(keys))
            .join(F.broadcast(flag), "_key", "left")  # at most MAX_LISTED_KEYS rows
            .withColumn("_seg", F.when(F.col("_heavy"), segment).otherwise(F.lit(None)))
            .drop("_heavy", "_key")
        )
    cut = cut.withColumn("_key", _together(keys))
    part = ["_key", "_seg"]
    # Without this, rows already partitioned by the keys alone would count as partitioned by (keys, segment)
    # and all segments of a heavy key would stay in one task.
    cut = cut.repartition(*part)
    totals = (
        cut.where(F.col("_seg").isNotNull())
        .groupBy(*part)
        .agg(*[_reduce(r, order).alias(f"_t_{r.name}") for r in runs])
    )
    w_seg = Window.partitionBy("_key").orderBy("_seg")
    carried = totals.select(*part, *[_carry(r, f"_t_{r.name}", w_seg).alias(f"_c_{r.name}") for r in runs])
    w_in = Window.partitionBy(*part).orderBy(order)
    local = cut.join(carried, part, "left")
    local = local.select("*", *[_over(r, r.value, w_in, r.prior).alias(f"_l_{r.name}") for r in runs])
    return local.select(
        *df.columns,
        *[_combine(r, F.col(f"_c_{r.name}"), F.col(f"_l_{r.name}")).alias(r.name) for r in runs],
    )
