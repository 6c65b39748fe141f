"""Features and ratings of a stream of bouts on the engine's keyed state.

Bouts of a key wait in list state until the watermark has passed them; an event-time timer then applies all that are
due in the order of their time, gives every one the values before it, and moves the value or map state on. Checkpoints,
recovery, the watermark and the file sink's commit log are the engine's. A bout at or before the watermark when it
arrives comes too late to be applied in order: it is given out with ``late`` set and changes no state.

State of a key is one row of accumulators (or one rating per entity of a pool) and the bouts of one watermark delay;
input and output of a key pass as iterators of batches. What a key receives per trigger follows the source's rate limit.
The order within a key is the point of these operators, so a key is worked on by one task; cut a pool into
divisions to spread it. Batch jobs that read a long history at once use ``operators`` instead.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegralType, StructType

from boutline.functions.rating import START_RATING, score_of
from boutline.operators.longform import long_form, outcome_of
from boutline.operators.ratings import _group_replay
from boutline.operators.running import BASE_STATS, Stat

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch stores its changes, not all state
    "spark.sql.streaming.join.stateFormatVersion": "3",  # one store per partition of a join instead of four
}
SPAN = 600_000  # milliseconds of waiting bouts of a pool that are stored together
HELD = 100_000  # rows of a pool in memory before they are stored
MET = 1_000_000  # ratings of a pool in memory before they are stored
COUNTS = ("bouts", "wins", "losses", "draws", "title_wins", "win_streak", "lose_streak", "year_sum")


def _plain(rows: pd.DataFrame, schema: StructType) -> list[tuple]:
    """Rows as tuples of Python values, unknown ones None. Whole numbers next to a null come as floats and are whole again."""
    columns = []
    for f in schema.fields:
        values = [None if v is None or v != v else v for v in rows[f.name].tolist()]
        columns.append([None if v is None else int(v) for v in values] if isinstance(f.dataType, IntegralType) else values)
    return list(zip(*columns, strict=True))


class InOrder(StatefulProcessor):
    """Keeps rows with a time ``at`` (milliseconds) until the watermark passes them; subclasses apply them in order.

    A key may have few rows, so rows are plain tuples here: a data frame per key and step costs more than the step.
    """

    def __init__(self, rows: StructType, key: str, output: Sequence[str]) -> None:
        self.key, self.output = key, list(output)
        self.schema = StructType([f for f in rows.fields if f.name != key])
        self.names = [f.name for f in self.schema.fields]
        self.at, self.bout = self.names.index("at"), self.names.index("bout_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            late = (batch["at"].isna() | (batch["at"] <= passed)).to_numpy()
            if late.any():
                yield self._given(key, batch[late], True)
                batch = batch[~late]
            if len(batch):
                earliest = int(batch["at"].min())
                first = earliest if first is None else min(first, earliest)
                self.keep(_plain(batch, self.schema))
        self.kept()
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest = None
        for ready, rest in self.due(timerValues.getCurrentWatermarkInMs()):
            if ready:
                yield self._given(key, self.apply(self._sorted(ready)), False)
        self.applied()
        if rest is not None:
            self.handle.registerTimer(rest)

    def keep(self, rows: list[tuple]) -> None:
        """Stores rows until they are due."""
        self.waiting.appendList(rows)

    def kept(self) -> None:
        """After the last rows of a batch."""

    def due(self, passed: int) -> Iterator[tuple[list[tuple], int | None]]:
        """Rows up to ``passed``, earlier ones first, taken out of the store; with the earliest time that stays, if any."""
        if not self.waiting.exists():
            return
        rows = list(self.waiting.get())
        ready, rest = self._cut(rows, passed)
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield ready, min((r[self.at] for r in rest), default=None)

    def applied(self) -> None:
        """After the last rows that were due."""

    def _cut(self, rows: list[tuple], passed: int) -> tuple[list[tuple], list[tuple]]:
        return [r for r in rows if r[self.at] <= passed], [r for r in rows if r[self.at] > passed]

    def _sorted(self, rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: (r[self.at], r[self.bout] is None, r[self.bout] or 0))

    def _given(self, key, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        out = rows.assign(**{self.key: key[0], "late": late})
        return out.reindex(columns=self.output)

    def apply(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class EntityHistory(InOrder):
    """Running features of one entity; its accumulators are those of ``features.entity_state``."""

    def __init__(self, rows: StructType, output: Sequence[str], stats: Sequence[Stat]) -> None:
        super().__init__(rows, "entity", output)
        self.stats = list(stats)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        sums = [f"{name}_sum double" for name in term_names(self.stats)]
        counts = [f"{c} bigint" for c in COUNTS]
        self.state = handle.getValueState("history", ", ".join([*counts, "last_d date", *sums]))

    def _terms(self, rows: dict[str, list], n: np.ndarray) -> dict[str, np.ndarray]:
        num = lambda c: np.array([np.nan if v is None else v for v in rows[c]], float)
        minutes, out = num("minutes"), {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for s in self.stats:
                own, opp = num(f"own_{s.name}"), num(f"opp_{s.name}")
                usable = ~np.isnan(own) & ~np.isnan(opp) & (minutes > 0)
                values = {"rate": own * n * n / minutes, "diff": (own - opp) * n * n}
                if s.share:
                    values["def"] = (1 - opp) * n * n
                out |= {f"{s.name}_{k}": np.where(usable, v, 0.0) for k, v in values.items()}
        return out

    def apply(self, rows: list[tuple]) -> pd.DataFrame:
        terms = term_names(self.stats)
        old = self.state.get() if self.state.exists() else (*[0] * len(COUNTS), None, *[0.0] * len(terms))
        known = dict(zip([*COUNTS, "last_d", *terms], old, strict=True))
        size = len(rows)
        cols = dict(zip(self.names, zip(*rows, strict=True), strict=True))
        prior = known["bouts"] + np.arange(size)
        won, lost, drawn = (np.array([x == o for x in cols["outcome"]]) for o in ("win", "loss", "draw"))
        titles = won & np.array([x is True for x in cols["is_title"]])

        def grown(name: str, gains: np.ndarray) -> np.ndarray:
            """Totals before each row; the total after the last one goes into the state."""
            line = np.cumsum(np.concatenate([[known[name]], gains]))
            known[name] = line[-1].item()
            return line[:-1]

        out = {**cols, "prior_bouts": prior, "wins": grown("wins", won), "title_wins": grown("title_wins", titles)}
        grown("losses", lost), grown("draws", drawn)
        for name, mine, other in (("win_streak", won, lost), ("lose_streak", lost, won)):
            line, run = [], known[name]
            for up, down in zip(mine.tolist(), other.tolist(), strict=True):
                line.append(run)
                run = run + 1 if up else 0 if down else run
            out[name], known[name] = line, run
        days = [known["last_d"], *cols["d"]]
        out["layoff_days"] = pd.array([None if a is None or b is None else (b - a).days for a, b in zip(days, days[1:])], "Int64")
        weight = prior * (prior + 1) * (2 * prior + 1) / 6
        for name, gains in self._terms(cols, prior + 1).items():
            total = grown(name, gains)
            out[name] = np.divide(total, weight, out=np.full(size, np.nan), where=prior > 0)
        known["bouts"] += size
        known["year_sum"] += sum(d.year for d in cols["d"] if d is not None)
        known["last_d"] = max((d for d in days if d is not None), default=None)
        self.state.update(tuple(known.values()))
        return pd.DataFrame({c: out[c] for c in self.output if c in out})


class PoolRatings(InOrder):
    """Elo replay of one pool; the state has one rating and bout count per entity, and only those of due bouts are read.

    A pool may hold most bouts of a stream. Waiting rows are therefore stored by the ``SPAN`` their time lies in and
    applied span after span, and about ``HELD`` rows and ``MET`` ratings at most are in memory.
    """

    def __init__(self, rows: StructType, output: Sequence[str], fixed_k: float | None) -> None:
        super().__init__(rows, "pool", output)
        self.fixed_k = fixed_k
        self.entity = next(f.dataType.simpleString() for f in rows.fields if f.name == "red")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span bigint, piece bigint", "first bigint, rows binary")
        self.pieces = handle.getValueState("pieces", "stored bigint")
        self.ratings = handle.getMapState("ratings", f"entity {self.entity}", "rating double, bouts bigint")
        self.held, self.met = [], {}

    def keep(self, rows: list[tuple]) -> None:
        self.held += rows
        if len(self.held) >= HELD:
            self.kept()

    def kept(self) -> None:
        if not self.held:
            return
        spans, number = {}, self.pieces.get()[0] if self.pieces.exists() else 0
        for r in self.held:
            spans.setdefault(r[self.at] // SPAN, []).append(r)
        for span, rows in spans.items():
            self._store(span, number, rows)
        self.pieces.update((number + 1,))
        self.held = []

    def _store(self, span: int, piece: int, rows: list[tuple]) -> None:
        self.waiting.updateValue((span, piece), (min(r[self.at] for r in rows), pickle.dumps(rows)))

    def due(self, passed: int) -> Iterator[tuple[list[tuple], int | None]]:
        stored = sorted(tuple(k) for k in self.waiting.keys())
        later = [k for k in stored if k[0] * SPAN > passed]
        after = [self.waiting.getValue(k)[0] for k in later if k[0] == later[0][0]]
        ready = []
        for span, keys in groupby([k for k in stored if k[0] * SPAN <= passed], key=lambda k: k[0]):
            keys = list(keys)
            now, rest = self._cut([r for k in keys for r in pickle.loads(self.waiting.getValue(k)[1])], passed)
            for k in keys:
                self.waiting.removeKey(k)
            if rest:
                self._store(span, keys[0][1], rest)
                after = [min(r[self.at] for r in rest)]
            ready += now
            if len(ready) >= HELD:
                yield ready, min(after, default=None)
                ready = []
        yield ready, min(after, default=None)

    def applied(self) -> None:
        for e, (rating, bouts) in self.met.items():
            self.ratings.updateValue((e,), (float(rating), int(bouts)))
        self.met = {}

    def apply(self, rows: list[tuple]) -> pd.DataFrame:
        based = pd.DataFrame(rows, columns=self.names)
        based = based.assign(place=based["bout_id"], bout_id=np.arange(len(rows)))  # replayed by time, ties by bout_id
        if len(self.met) >= MET:
            self.applied()
        met = self.met
        for e in pd.unique(based[["red", "blue"]].to_numpy().ravel()):
            if e not in met:
                met[e] = self.ratings.getValue((e,)) or (START_RATING, 0)
        for side in ("red", "blue"):
            based[f"{side}_base"] = [met[e][0] for e in based[side]]
            based[f"{side}_seen"] = [met[e][1] for e in based[side]]
        rated = _group_replay(self.fixed_k, False)(based).drop(columns="bout_id").rename(columns={"place": "bout_id"})
        surprise = rated["red_score"] - 1 / (1 + 10.0 ** ((rated["blue_pre"] - rated["red_pre"]) / 400))
        for red, blue, a, b in zip(
            rated["red"], rated["blue"], rated["red_pre"] + rated["red_k"] * surprise, rated["blue_pre"] - rated["blue_k"] * surprise, strict=True
        ):
            met[red], met[blue] = (a, met[red][1] + 1), (b, met[blue][1] + 1)
        return rated


def term_names(stats: Sequence[Stat]) -> list[str]:
    return [f"{s.name}_{k}" for s in stats for k in ("rate", "diff", *(("def",) if s.share else ()))]


def _timed(bouts: DataFrame) -> DataFrame:
    """``at`` in place of ``ts``: rows behind the watermark are then given out as late, and not dropped on the way."""
    return bouts.withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).drop("ts")


def live_features(bouts: DataFrame, stats: Sequence[Stat] = BASE_STATS) -> DataFrame:
    """Both sides of every streamed bout with their features before it. ``bouts`` is cleaned and has a watermark on ``ts``."""
    sides = long_form(_timed(bouts), ["at", "is_title", "method", "minutes"], [s.name for s in stats])
    rows = sides.select(
        "entity", "bout_id", "d", "at", "is_title", "minutes", "side", "opponent", "outcome",
        *[f"{p}_{s.name}" for s in stats for p in ("own", "opp")],
    )
    kind = sides.schema["entity"].dataType.simpleString()
    schema = f"bout_id bigint, d date, side string, entity {kind}, opponent {kind}, outcome string, late boolean, " + ", ".join(
        f"{c} bigint" for c in ("prior_bouts", "wins", "title_wins", "win_streak", "lose_streak", "layoff_days")
    )
    schema += "".join(f", {name} double" for name in term_names(stats))
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy("entity").transformWithStateInPandas(EntityHistory(rows.schema, names, stats), schema, "Append", "EventTime")


def live_ratings(bouts: DataFrame, fixed_k: float | None = None) -> DataFrame:
    """Ratings of both sides before every streamed bout of a ``pool``, as ``ratings.replay`` gives them."""
    score = score_of(outcome_of(F.col("red"), F.col("winner"))).alias("red_score")
    rows = _timed(bouts).select("pool", "bout_id", "d", "at", "red", "blue", score)
    kind = rows.schema["red"].dataType.simpleString()
    schema = f"pool string, bout_id bigint, d date, red {kind}, blue {kind}, red_score double, late boolean"
    schema += "".join(f", {c} double" for c in ("red_k", "blue_k", "red_pre", "blue_pre"))
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy("pool").transformWithStateInPandas(PoolRatings(rows.schema, names, fixed_k), schema, "Append", "EventTime")


def start(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Append ``stream`` to Parquet files in ``folder``/rows; a restart with the same folder goes on where it stopped."""
    for name, value in SETTINGS.items():
        stream.sparkSession.conf.set(name, value)
    return (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def applied(spark: SparkSession, folder: str, late: bool = False) -> DataFrame:
    """Rows given out so far: those that were applied, or the late ones."""
    return spark.read.parquet(f"{folder}/rows").where(F.col("late") == F.lit(late)).drop("late")


def entity_state(spark: SparkSession, folder: str, operator: int = 0) -> DataFrame:
    """Accumulators of every entity after the last finished batch, read from the state store.

    ``operator`` counts the stateful operators of the query, the last one first. The columns are those that
    ``features.card_features`` takes.
    """
    store = (
        spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("operatorId", operator).option("stateVarName", "history")
    )
    return store.load().select("key.*", "value.*")
