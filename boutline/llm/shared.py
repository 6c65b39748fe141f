"""What several operators need: word patterns, row keys, staged tables, prefix sums without a single task."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.session import checkpoint_root, stage

__all__ = ["stage"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
PIECES = 4096  # a key with more than this part of all rows is split in joins
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder, for files that executors write and read."""
    return os.path.join(checkpoint_root(spark), f"{kind}-{uuid.uuid4().hex}")


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, at most about ``rows`` rows of a few numbers each, in as many partitions as they fill.

    At least one per core and at most one per partition of a shuffle. A stored step has a file for each, also where the
    engine does not merge small partitions, and on local disks every new file costs several child processes.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, min(parts, max(spark.sparkContext.defaultParallelism, rows // FILE_ROWS))))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored step that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, also not in other case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas of higher-order functions."""
    return F.transform(F.array(value), body)[0]


def same(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str]) -> Column:
    """Null-safe equality of two column lists."""
    cond = F.lit(True)
    for a, b in zip(left_cols, right_cols, strict=True):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def split_join(rows: DataFrame, names: DataFrame, keys: list[str], weight: str, spread: Column | None = None) -> DataFrame:
    """``rows`` joined with ``names`` (one row per ``keys``, not null) where no key is one task's work.

    ``weight`` of ``names`` says how much of ``rows`` a key has. Keys above a share of 1 / PIECES of all are dealt over as
    many pieces as they have shares, and their names are repeated for each piece; fewer than 2 * PIECES keys can be above
    it, so the list of their pieces is broadcast. ``spread`` deals rows to pieces; by default their place in the files of
    ``rows`` does, which must then be a stored table, whose order is the same when a lost task runs again. The weight is
    dropped.
    """
    share = max(1, int(names.agg(F.sum(weight)).first()[0] or 0) // PIECES)
    heavy = names.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) / share).cast("int").alias("_pieces"))
    piece = F.pmod(F.monotonically_increasing_id() if spread is None else spread, F.coalesce("_pieces", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("_piece", piece).drop("_pieces")
    shares = F.when(F.col(weight) > share, F.ceil(F.col(weight) / share)).otherwise(1).cast("int")
    named = names.withColumn("_piece", F.explode(F.sequence(F.lit(0), shares - 1))).drop(weight)
    return dealt.join(named, [*keys, "_piece"]).drop("_piece")


def segment_count(rows: int, per_segment: int = 256, most: int = 65536) -> int:
    """Segments of a line of ``rows`` rows: many small ones, and so few that one task can scan their totals."""
    return max(1, min(most, rows // per_segment))


def prefix_sums(
    df: DataFrame, line: list[str], seg: str, order: list[str], amount: str, out: str, seg_out: DataFrame | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows before this one in its line.

    A line (the rows with equal ``line`` columns) may hold a third of the table. It is therefore cut into segments
    (column ``seg``); rows are summed within segments, and only the totals of segments are scanned per line. ``line``
    columns must not be null.
    """
    totals = seg_out if seg_out is not None else df.groupBy(*line, seg).agg(F.sum(amount).alias("_seg_sum"))
    before = Window.partitionBy(*line).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_seg_before", F.coalesce(F.sum("_seg_sum").over(before), F.lit(0).cast("long"))).drop("_seg_sum")
    inner = Window.partitionBy(*line, seg).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals.hint("shuffle_hash"), [*line, seg])  # totals: a few numbers per segment
        .withColumn(out, F.col("_seg_before") + F.coalesce(F.sum(amount).over(inner), F.lit(0).cast("long")))
        .drop("_seg_before")
    )
