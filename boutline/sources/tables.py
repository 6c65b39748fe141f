"""Contest tables as views over stored Parquet tables.

``bouts`` pairs consecutive events into one bout (even id red, odd id blue); ``master`` is the entity
table. Rows carry raw text the way scraped bouts do; ``clean_bouts`` types it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions import parse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_with_k(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def _clock_text(seconds: Column) -> Column:
    return F.concat(
        F.floor(seconds / 60).cast("int").cast("string"),
        F.lit(":"),
        F.lpad((seconds % 60).cast("int").cast("string"), 2, "0"),
    )


def _ratio_text(value: Column, k: Column) -> Column:
    landed = F.floor(value).cast("int")
    return F.concat(landed.cast("string"), F.lit(" of "), (landed + k).cast("string"))


def _odds_text(k: Column) -> Column:
    return (
        F.when(k == 13, F.lit("-"))
        .when(k < 50, F.concat(F.lit(parse.MINUS_SIGN), (104 + 4 * (49 - k)).cast("string")))
        .otherwise((100 + 6 * (k - 50)).cast("string"))
    )


def _ctrl_text(k: Column) -> Column:
    return F.when(k % 17 == 0, F.lit("--")).otherwise(_clock_text(3 * k))


def _corners(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    ev = events_with_k(events).withColumn("bout_id", F.shiftright("event_id", 1))
    r = ev.where(F.col("event_id") % 2 == 0).select(
        "bout_id", "ts", F.col("user_id").alias("red"), F.col("value").alias("rv"), F.col("event_type").alias("method"),
        F.col("k").alias("rk"),
    )
    b = ev.where(F.col("event_id") % 2 == 1).select(
        F.col("bout_id").alias("_id"), F.col("ts").alias("_ts"), F.col("user_id").alias("blue"),
        F.col("value").alias("bv"), F.col("k").alias("bk"),
    )
    return r, b


def _bout_columns(paired: DataFrame) -> DataFrame:
    rk, bk, rv, bv = F.col("rk"), F.col("bk"), F.col("rv"), F.col("bv")
    return paired.where(F.col("red") != F.col("blue")).select(
        "bout_id",
        "ts",
        F.col("ts").cast("date").alias("d"),
        "red",
        "blue",
        F.when(rv > bv, F.col("red")).when(bv > rv, F.col("blue")).alias("winner"),
        "method",
        (F.col("method") == "purchase").alias("is_title"),
        (1 + (rk + bk) % 5).alias("round"),
        _clock_text((3 * rk + bk) % 300).alias("clock"),
        _ratio_text(rv, rk).alias("red_sig"),
        _ratio_text(bv, bk).alias("blue_sig"),
        (rk % 4).alias("red_kd"),
        (bk % 4).alias("blue_kd"),
        _ctrl_text(rk).alias("red_ctrl"),
        _ctrl_text(bk).alias("blue_ctrl"),
        _odds_text(rk).alias("red_odds"),
        _odds_text(bk).alias("blue_odds"),
        ((rk + 1).cast("double") / (rk + bk + 2)).alias("p_ab"),
        ((bk + 5).cast("double") / (rk + bk + 10)).alias("p_ba"),
    )


def bouts_from_events(events: DataFrame) -> DataFrame:
    """Both corners of a bout meet in one pass over the events; a bout needs exactly one event of either corner."""
    ev = events_with_k(events).withColumn("bout_id", F.shiftright("event_id", 1))
    corner = lambda odd: F.col("event_id") % 2 == odd
    of = lambda c, odd: F.max(F.when(corner(odd), F.col(c)))
    # dealt out by bout first, one sort serves the whole aggregate
    paired = ev.repartition("bout_id").groupBy("bout_id").agg(
        F.count_if(corner(0)).alias("_reds"), F.count_if(corner(1)).alias("_blues"), of("ts", 0).alias("ts"),
        of("user_id", 0).alias("red"), of("value", 0).alias("rv"), of("event_type", 0).alias("method"), of("k", 0).alias("rk"),
        of("user_id", 1).alias("blue"), of("value", 1).alias("bv"), of("k", 1).alias("bk"),
    )
    return _bout_columns(paired.where("_reds = 1 AND _blues = 1"))


def unpaired_events(events: DataFrame) -> DataFrame:
    """Events that are in no bout (event_id, bout_id, reason), so that none is lost without a trace.

    Reasons, the first that holds: ``missing corner``, ``repeated event``, ``unknown entity``, ``same entity``.
    """
    ev = events.select("event_id", "user_id", F.shiftright("event_id", 1).alias("bout_id"))
    corner = lambda odd: F.pmod("event_id", F.lit(2)) == odd
    per = ev.groupBy("bout_id").agg(
        F.count_if(corner(0)).alias("reds"), F.count_if(corner(1)).alias("blues"),
        F.max(F.when(corner(0), F.col("user_id"))).alias("red"), F.max(F.when(corner(1), F.col("user_id"))).alias("blue"),
    )
    reason = (
        F.when((F.col("reds") == 0) | (F.col("blues") == 0), F.lit("missing corner"))
        .when((F.col("reds") > 1) | (F.col("blues") > 1), F.lit("repeated event"))
        .when(F.col("red").isNull() | F.col("blue").isNull(), F.lit("unknown entity"))
        .when(F.col("red") == F.col("blue"), F.lit("same entity"))
    )
    bad = per.select(F.col("bout_id").alias("_id"), reason.alias("reason")).where(F.col("reason").isNotNull())
    return ev.join(bad, F.col("bout_id").eqNullSafe(F.col("_id"))).select("event_id", "bout_id", "reason")


def paired_stream(events: DataFrame, hours: int = 24) -> DataFrame:
    """Cleaned bouts with ``ts`` and ``pool`` from a stream of events.

    The two corners meet in a stream-stream join. Watermark and time range bound its state, so both corners
    must arrive within ``hours`` of each other.
    """
    r, b = _corners(events)
    r, b = r.withWatermark("ts", f"{hours} hours"), b.withWatermark("_ts", f"{hours} hours")
    gap = F.expr(f"INTERVAL {hours} HOURS")
    near = F.col("_ts").between(F.col("ts") - gap, F.col("ts") + gap)
    raw = _bout_columns(r.join(b, (F.col("bout_id") == F.col("_id")) & near))
    return clean_bouts(raw, ["ts"]).withColumn("pool", F.col("method"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bouts_from_events(table(spark, sf_dir, "events"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("entity"),
        F.col("c_name").alias("name"),
        F.when(key % 29 != 0, F.date_add(F.lit("1970-01-01").cast("date"), ((key * 37) % 9000).cast("int"))).alias("dob"),
        F.when(key % 31 == 0, F.lit("--"))
        .otherwise(F.concat(text(5 + key % 2), F.lit("' "), text(key % 12), F.lit('"')))
        .alias("height_text"),
        F.concat(text(125 + 10 * (key % 14)), F.lit(" lbs.")).alias("weight_text"),
        F.concat(
            text(key % 30), F.lit("-"), text(key % 11), F.lit("-"), text(key % 2),
            F.when(key % 7 == 0, F.lit(" (1 NC)")).otherwise(F.lit("")),
        ).alias("record_text"),
        F.concat(text(key % 100), F.lit("%")).alias("acc_text"),
    )


def clean_bouts(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Typed stats next to the identifying columns; the text columns are gone."""
    return raw.select(
        *extra,
        "bout_id",
        "d",
        "red",
        "blue",
        "winner",
        "method",
        "is_title",
        parse.bout_minutes(F.col("round"), parse.clock_minutes(F.col("clock"))).alias("minutes"),
        *[
            c
            for side in ("red", "blue")
            for c in (
                F.col(f"{side}_kd").cast("double").alias(f"{side}_kd"),
                parse.ratio_landed(F.col(f"{side}_sig")).alias(f"{side}_sig"),
                parse.ratio_share(F.col(f"{side}_sig")).alias(f"{side}_sig_pct"),
                parse.clock_minutes(F.col(f"{side}_ctrl")).alias(f"{side}_ctrl"),
                parse.odds_int(F.col(f"{side}_odds")).alias(f"{side}_odds"),
            )
        ],
        "p_ab",
        "p_ba",
    )
