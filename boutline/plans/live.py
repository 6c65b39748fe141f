"""Streaming queries: bouts arrive as a stream and the result must equal the batch one."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators import features as fx
from boutline.plans import scoring  # noqa: F401  its SQL states the ratings
from boutline.plans.history import _CARD_COLS, TERM_NAMES, cleaned
from boutline.plans.registry import ORACLES, query, sql_round, views
from boutline.session import checkpoint_root
from boutline.sources import tables as t
from boutline.streaming import keyed

CLOSING_ID = 1 << 62  # two events of one entity: they move the watermark, but are no bout


def closing_events(spark: SparkSession, schema, rows: bool) -> DataFrame:
    """The events that end a season, or none of them yet."""
    when = F.lit("2200-01-01").cast("timestamp")
    given = {"event_id": F.lit(CLOSING_ID) + F.col("id"), "ts": when, "user_id": F.lit(-1)}
    both = spark.range(2 if rows else 0, numPartitions=1)
    return both.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def bout_stream(spark: SparkSession, sf: str, closing: str, before: Column | None = None) -> DataFrame:
    """Cleaned bouts from a stream of events; both halves of a bout are paired by id within a day.

    A second source reads the folder ``closing``; events stored there end the season.
    """
    schema = t.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    if before is not None:
        raw = raw.where(F.col("ts").cast("date") < before)
    raw = raw.unionByName(spark.readStream.schema(schema).parquet(closing))
    return t.paired_stream(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def run_stream(spark: SparkSession, sf: str, operator, before: Column | None = None) -> str:
    """Consume what is there; then end the season, which a restart from the checkpoint applies. Gives the folder."""
    folder = os.path.join(checkpoint_root(spark), "live-" + uuid.uuid4().hex)
    closing, schema = os.path.join(folder, "closing"), t.table(spark, sf, "events").schema
    for ended in (False, True):
        closing_events(spark, schema, ended).write.mode("append").parquet(closing)
        keyed.start(operator(bout_stream(spark, sf, closing, before)), folder, availableNow=True).awaitTermination()
    return folder


@query(
    "stream_state",
    views("feats", f"SELECT bout_id, entity, prior_bouts, wins, title_wins, win_streak, lose_streak, layoff_days, {sql_round(' '.join(TERM_NAMES))} FROM feats"),
)
def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    """Features of both sides of every streamed bout."""
    cols = ["prior_bouts", "wins", "title_wins", "win_streak", "lose_streak", "layoff_days", *TERM_NAMES]
    return keyed.applied(spark, run_stream(spark, sf, keyed.live_features)).select("bout_id", "entity", *cols)


@query("stream_ratings", ORACLES["elo_by_pool"], places=4)
def stream_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of both sides before every streamed bout, by pool."""
    return keyed.applied(spark, run_stream(spark, sf, keyed.live_ratings)).select("pool", "bout_id", "red_pre", "blue_pre")


@query("stream_card", ORACLES["card_features"])
def stream_card(spark: SparkSession, sf: str) -> DataFrame:
    """The last day's bouts as an announced card, scored from the state that a stream of all earlier bouts left."""
    c = cleaned(spark, sf)
    day = F.lit(c.agg(F.max("d")).first()[0])
    state = keyed.entity_state(spark, run_stream(spark, sf, keyed.live_features, day))
    card = c.where(F.col("d") == day).select("bout_id", "red", "blue")
    out = fx.card_features(card, state, t.master(spark, sf), day)
    return out.select("bout_id", "corner_order", "red", "blue", *[x for n in _CARD_COLS for x in (f"red_{n}", f"blue_{n}", f"{n}_oppdiff")])
