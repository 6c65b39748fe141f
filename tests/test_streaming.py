import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tests.helpers import frame, random_bouts, replay_features, replay_ratings

from boutline.operators import features as fx
from boutline.streaming import keyed

START = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def timed(spark, rows, undated=()):
    """Bouts ten minutes apart, with the columns a live stream carries."""
    ts = F.when(~F.col("bout_id").isin(*undated), F.timestamp_seconds(START + F.col("bout_id") * 600))
    return frame(spark, rows).withColumns({"ts": ts, "pool": F.col("method")})


def last_bouts(spark, rows):
    """Bouts far in the future that move the watermark past all others and wait themselves."""
    end = [(10**6 + i, *r[1:2], "end", "over", *r[4:]) for i, r in enumerate(rows[:2])]
    return frame(spark, end).withColumns({"ts": F.timestamp_seconds(F.lit(START + 10**8)), "pool": F.lit("none")})


class Live:
    """A folder of input files, each of them a micro-batch, and the folders of both operators."""

    def __init__(self, spark, path, delay):
        self.spark, self.path, self.delay, self.schema = spark, str(path), delay, None

    def add(self, df):
        self.schema = df.schema
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, operator):
        bouts = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        folder = f"{self.path}/{operator.__name__}"
        keyed.start(operator(bouts.withWatermark("ts", self.delay)), folder, availableNow=True).awaitTermination()
        return folder


def check(got, rows):
    want = replay_features(rows)
    got = got.collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        for name, v in want[r["bout_id"], r["side"]].items():
            assert r[name] == (pytest.approx(v) if v is not None else None), (name, r)


@pytest.fixture(scope="module")
def season(spark, tmp_path_factory):
    """Three batches in which bouts are overtaken, a stop, then the end of the season after a restart."""
    rows = random_bouts(60, hot="e0")
    df = timed(spark, rows)
    live = Live(spark, tmp_path_factory.mktemp("season"), "1 hour")
    order = [*range(0, 18), 20, 21, *range(18, 20), *range(22, 60)]
    for ids in (order[:20], order[20:40], order[40:]):
        live.add(df.where(F.col("bout_id").isin(*ids)))
    waiting = {op: keyed.applied(spark, live.run(op)).count() for op in (keyed.live_features, keyed.live_ratings)}
    live.add(last_bouts(spark, rows))
    return rows, waiting, {op: live.run(op) for op in waiting}


def test_stream_with_disorder_equals_batch(spark, season):
    rows, before, folders = season
    assert 0 < before[keyed.live_features] < 2 * len(rows)  # the last hour waits
    check(keyed.applied(spark, folders[keyed.live_features]), rows)
    assert keyed.applied(spark, folders[keyed.live_features], late=True).count() == 0


def test_ratings_of_a_stream_equal_batch(spark, season):
    rows, before, folders = season
    assert 0 < before[keyed.live_ratings] < len(rows)
    want = replay_ratings(rows)
    rated = keyed.applied(spark, folders[keyed.live_ratings]).collect()
    assert len(rated) == len(rows)
    for r in rated:
        assert (r["red_pre"], r["blue_pre"]) == pytest.approx(want[r["bout_id"]], abs=1e-6)


def test_stored_state_equals_batch_state(spark, season):
    rows, _, folders = season
    got = {r["entity"]: r.asDict() for r in keyed.entity_state(spark, folders[keyed.live_features]).collect()}
    want = {r["entity"]: r.asDict() for r in fx.entity_state(fx.entity_long(frame(spark, rows))).collect()}
    assert set(got) == set(want)
    for name, state in want.items():
        assert set(got[name]) == set(state)
        for c, v in state.items():
            assert got[name][c] == (pytest.approx(v) if isinstance(v, float) else v), (name, c)


def test_late_and_undated_bouts_are_set_aside(spark, tmp_path):
    rows = random_bouts(30)
    df = timed(spark, rows, undated=[5])
    live = Live(spark, tmp_path, "10 minutes")
    live.add(df.where("bout_id < 20 AND bout_id <> 3"))
    live.add(df.where("bout_id >= 20 OR bout_id = 3"))
    live.add(last_bouts(spark, rows))
    folder = live.run(keyed.live_features)
    late = keyed.applied(spark, folder, late=True).select("bout_id", "side", "prior_bouts").collect()
    assert sorted(tuple(r) for r in late) == [(i, side, None) for i in (3, 5) for side in ("blue", "red")]
    check(keyed.applied(spark, folder), [r for r in rows if r[0] not in (3, 5)])


class Stored(dict):
    """Keyed state in memory: a value, or a map."""

    def exists(self):
        return None in self

    def get(self, key=None):
        return dict.get(self, key)

    def update(self, value):
        self[None] = value

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__


class Handle:
    def __getattr__(self, name):
        return lambda *_: Stored()


FIELDS = "pool string, bout_id bigint, d date, at bigint, red bigint, blue bigint, red_score double"


def test_a_pool_is_stored_and_applied_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HELD", 10)
    monkeypatch.setattr(keyed, "SPAN", 1000)
    pool = keyed.PoolRatings(StructType.fromDDL(FIELDS), ["bout_id"], None)
    pool.init(Handle())
    rows = [(i, dt.date(2024, 1, 1), 37 * i % 100 * 100, i % 7, 7 + i % 5, 1.0) for i in range(100)]
    for i in range(0, 100, 5):
        pool.keep(rows[i : i + 5])
        assert len(pool.held) < 10
    pool.kept()
    pieces = list(pool.due(5050))
    assert len(pieces) > 3 and max(len(p) for p, _ in pieces) < 30 and pieces[-1][1] == 5100
    given = [r for p, _ in pieces for r in pool._sorted(p)]
    assert given == sorted((r for r in rows if r[2] <= 5050), key=lambda r: r[2])
    assert sorted(r for p, _ in pool.due(10**6) for r in p) == sorted(r for r in rows if r[2] > 5050)
    assert not pool.waiting


def test_history_of_an_entity_is_applied_from_plain_rows(spark):
    fields = "entity string, bout_id bigint, d date, at bigint, is_title boolean, minutes double, outcome string"
    history = keyed.EntityHistory(StructType.fromDDL(fields), ["bout_id", "prior_bouts", "wins", "layoff_days"], [])
    history.init(Handle())
    days = [dt.date(2024, 1, 1), None, dt.date(2024, 1, 5), dt.date(2024, 1, 9)]
    out = history.apply([(i, d, i, True, None, "win") for i, d in enumerate(days)])
    assert out["wins"].tolist() == [0, 1, 2, 3] and [None if x is pd.NA else x for x in out["layoff_days"]] == [None, None, None, 4]
