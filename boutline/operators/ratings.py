"""Elo replay over bouts.

``replay`` gives every bout the ratings after all earlier bouts of its pool. Both sides of a bout
depend on each other's past, so no window can compute it directly. But a bout only waits for earlier
bouts that are linked to it through shared entities.

So the line of bouts of every pool is cut into slices, and a slice into groups that share no entity:
whole connected components of the graph of its bouts. Groups are replayed bout by bout in parallel, and
the ratings after a slice are a stored table that the next slice starts from. The result is exactly the
sequential one, whatever the cuts.

No group holds more than about ``GROUP_BOUTS`` bouts. A slice of a pool that is no longer than that is one
group, whatever its components. Longer slices are taken while entities are so many that components stay small;
a slice with a component above the bound is halved, and its halves are replayed one after the other.

``replay_by_period`` freezes ratings inside a day. Slices then end with a day, and a slice of a single
day needs no groups: all its bouts only wait for the days before.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.rating import K_REST, K_TIERS, START_RATING, k_factor, rating_change, score_of
from boutline.operators.asof import validity
from boutline.operators.components import connected_components
from boutline.operators.longform import outcome_of
from boutline.operators.scan import NO_SKEW, Run, Skew, find_skew, running
from boutline.session import checkpoint_root, stage

KEY = ["pool", "entity"]
GROUP_BOUTS = 500_000  # rows of a group pass in batches; ratings of at most twice as many entities are held
BOUTS_PER_ENTITY = 0.4  # in a slice of a large pool: below 0.5, components of random pairings stay small


def with_k(rows: DataFrame, fixed_k: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """K of both sides of ``rows`` (pool, bout_id, red, blue, ...); it follows the bout's ordinal within the pool.

    ``known`` (pool, entity, bouts) counts the bouts before the given ones.
    """
    if fixed_k is not None:
        return rows.withColumns({"red_k": F.lit(fixed_k), "blue_k": F.lit(fixed_k)})
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("entity"))
    sides = rows.select("*", F.inline(F.array(side("red"), side("blue"))))
    ranked = running(sides, KEY, "bout_id", [Run("_n", "count", F.lit(1), prior=False)], find_skew(sides, KEY))
    if known is not None:
        ranked = ranked.join(known.select(*KEY, "bouts").hint("merge"), KEY, "left").withColumn("_n", F.col("_n") + F.coalesce("bouts", F.lit(0)))
    k = k_factor(F.col("_n"))
    return ranked.groupBy(*rows.columns).agg(*[F.max(F.when(F.col("side") == s, k)).alias(f"{s}_k") for s in ("red", "blue")])


def _change(side: str) -> Column:
    other = "blue" if side == "red" else "red"
    score = F.col("red_score") if side == "red" else 1 - F.col("red_score")
    return rating_change(F.col(f"{side}_k"), score, F.col(f"{side}_pre"), F.col(f"{other}_pre"))


def changes(rated: DataFrame) -> DataFrame:
    """One row per side with its rating change."""
    return rated.select(
        "pool",
        "bout_id",
        F.inline(
            F.array(
                F.struct(F.col("red").alias("entity"), _change("red").alias("change")),
                F.struct(F.col("blue").alias("entity"), _change("blue").alias("change")),
            )
        ),
    )


def _with_base(part: DataFrame, known: DataFrame | None) -> DataFrame:
    """Ratings and bout counts of both sides at the start of the slice."""
    for side in ("red", "blue"):
        if known is None:
            part = part.withColumns({f"{side}_base": F.lit(START_RATING), f"{side}_seen": F.lit(0).cast("bigint")})
            continue
        # grows with the entities and is joined twice a slice: sorted, so that no copy of it passes the driver
        before = known.select("pool", F.col("entity").alias(side), F.col("gain").alias("_g"), F.col("bouts").alias("_b")).hint("merge")
        part = part.join(before, ["pool", side], "left").withColumns(
            {f"{side}_base": START_RATING + F.coalesce("_g", F.lit(0.0)), f"{side}_seen": F.coalesce("_b", F.lit(0).cast("bigint"))}
        )
        part = part.drop("_g", "_b")
    return part


def _after(known: DataFrame | None, rated: DataFrame) -> DataFrame:
    """Gain and bout count of every entity after the rated bouts."""
    new = changes(rated).select(*KEY, F.col("change").alias("gain"), F.lit(1).cast("bigint").alias("bouts"))
    both = new if known is None else known.select(*KEY, "gain", "bouts").unionByName(new)
    return both.groupBy(*KEY).agg(F.sum("gain").alias("gain"), F.sum("bouts").alias("bouts"))


def _replay_steps(fixed_k: float | None, frozen: bool) -> Callable[[], Callable[[Sequence[Iterable]], Iterator[tuple]]]:
    """Each call begins a bounded group, whose bouts come in order, in any number of parts. Only its ratings are held."""

    tiers = [next(k for bound, k in K_TIERS if n < bound) for n in range(max(bound for bound, _ in K_TIERS))]  # K by number of bouts

    def begin() -> Callable[[Sequence[Iterable]], Iterator[tuple]]:
        rating, seen, waiting, day = {}, {}, [], None

        def steps(cols: Sequence[Iterable]) -> Iterator[tuple[float, float, float, float]]:
            """K and ratings before each bout; ``cols`` are those of ``STEP``."""
            nonlocal waiting, day
            for d, red, blue, score, red_base, blue_base, red_seen, blue_seen in zip(*cols, strict=True):
                if frozen and d != day:
                    for entity, change in waiting:
                        rating[entity] += change
                    waiting, day = [], d
                own, other = rating.setdefault(red, red_base), rating.setdefault(blue, blue_base)
                if fixed_k is not None:
                    red_k = blue_k = fixed_k
                else:
                    seen[red] = n = seen.get(red, red_seen) + 1
                    seen[blue] = m = seen.get(blue, blue_seen) + 1
                    red_k = tiers[n] if n < len(tiers) else K_REST
                    blue_k = tiers[m] if m < len(tiers) else K_REST
                surprise = score - 1 / (1 + 10.0 ** ((other - own) / 400))
                if frozen:
                    waiting += ((red, red_k * surprise), (blue, -blue_k * surprise))
                else:
                    rating[red] += red_k * surprise
                    rating[blue] -= blue_k * surprise
                yield red_k, blue_k, own, other

        return steps

    return begin


STEP = ("d", "red", "blue", "red_score", "red_base", "blue_base", "red_seen", "blue_seen")
NEW = ["red_k", "blue_k", "red_pre", "blue_pre"]


def _group_replay(fixed_k: float | None, frozen: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Replay of one group that is there as a whole, in bout order."""
    begin = _replay_steps(fixed_k, frozen)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("bout_id", ignore_index=True)
        new = pd.DataFrame(begin()([rows[c] for c in STEP]), columns=NEW)
        return pd.concat([rows.drop(columns=["red_seen", "blue_seen"]), new], axis=1)

    return run


RATED = [
    "pool", "bout_id", "d", "red", "blue", "red_score", "red_k", "blue_k", "red_base", "blue_base", "red_pre", "blue_pre",
]


def _replay_groups(part: DataFrame, group: Column, fixed_k: float | None, frozen: bool, known: DataFrame | None) -> DataFrame:
    """Bouts of one value of (pool, ``group``) share no entity with those of another."""
    rows = _with_base(part.withColumn("group", group), known)
    names = ["pool", "bout_id", "d", "red", "blue", "red_score", "red_base", "blue_base"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    schema += ", " + ", ".join(f"{c} double" for c in NEW)
    kept = rows.select(*names, "red_seen", "blue_seen", "group")
    # sorted by the engine and read in batches: a task holds the ratings of a group, not its rows
    dealt = kept.repartition("pool", "group").sortWithinPartitions("pool", "group", "bout_id")

    begin = _replay_steps(fixed_k, frozen)

    def values(col: pa.Array) -> list:
        plain = not col.null_count and (pa.types.is_integer(col.type) or pa.types.is_floating(col.type))
        return col.to_numpy().tolist() if plain else col.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, steps = None, None
        for batch in batches:
            new = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in ("pool", "group"):  # null is a value
                new |= np.diff(pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                at = (part.column("pool")[0].as_py(), part.column("group")[0].as_py())
                if steps is None or at != now:
                    now, steps = at, begin()
                days = values(part.column("d")) if frozen else [None] * part.num_rows
                found = zip(*steps([days, *(values(part.column(c)) for c in STEP[1:])]), strict=True)
                cols = [*(part.column(c) for c in names), *(pa.array(x, pa.float64()) for x in found)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *NEW])

    return dealt.mapInArrow(run, schema).select(*RATED)


def _replay_day(part: DataFrame, fixed_k: float | None, known: DataFrame | None) -> DataFrame:
    """Bouts of a single day per pool with ratings frozen: every bout takes the ratings before the day."""
    rows = _with_base(with_k(part, fixed_k, known), known)
    return rows.withColumns({"red_pre": F.col("red_base"), "blue_pre": F.col("blue_base")}).select(*RATED)


def _sliced(rows: DataFrame, frozen: bool, bound: int) -> DataFrame:
    """``place`` of each bout in its pool (of the first bout of its day if frozen), and the number of its ``slice``."""
    lengths = rows.groupBy("pool").agg((F.approx_count_distinct("red") * BOUTS_PER_ENTITY).cast("bigint").alias("wide"))
    lengths = lengths.select("pool", F.greatest("wide", F.lit(bound)).alias("length"))
    if frozen:
        daily = rows.groupBy("pool", "d").agg(F.count("*").alias("n"))  # one row per pool and day
        before = Window.partitionBy("pool").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        daily = daily.select(F.col("pool").alias("p"), F.col("d").alias("day"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"))
        rows = rows.join(daily, F.col("pool").eqNullSafe(F.col("p")) & F.col("d").eqNullSafe(F.col("day"))).drop("p", "day")
    else:
        rows = running(rows, ["pool"], "bout_id", [Run("place", "count", F.lit(1))], find_skew(rows, ["pool"], bound))
    return rows.join(lengths, "pool").withColumn("slice", F.floor(F.col("place") / F.col("length")).cast("int")).drop("length")


def _halves(part: DataFrame) -> list[DataFrame]:
    """The earlier and the later half of each pool's places; both have rows of every pool with two places."""
    ends = part.groupBy("pool").agg(((F.min("place") + F.max("place")) / 2).alias("middle"))
    cut = part.join(ends, "pool")
    early = F.col("place") < F.col("middle")
    return [stage(cut.where(half).drop("middle")) for half in (early, ~early)]


def _parts(part: DataFrame, frozen: bool, bound: int) -> Iterator[tuple[DataFrame, Column | None]]:
    """Slices in order, each with a column that names the groups inside a pool (None: a single day of frozen ratings)."""
    places = F.count_distinct("place") if frozen else F.count("*")
    sizes = part.groupBy("pool").agg(F.count("*").alias("n"), places.alias("places"))
    most, places = sizes.agg(F.max("n"), F.max("places")).first()
    if (most or 0) <= bound:
        yield part, F.lit(0).cast("bigint")
        return
    if frozen and places == 1:
        yield part, None
        return
    roots = connected_components(part, ["pool"], "red", "blue")
    labelled = stage(part.join(roots.withColumnRenamed("vertex", "red").hint("merge"), ["pool", "red"]))
    if labelled.groupBy("pool", "root").count().agg(F.max("count")).first()[0] <= bound:
        groups = max(1, math.ceil(4 * most / bound))  # small components share a group of a quarter of the bound
        yield labelled, F.pmod(F.xxhash64("root"), F.lit(groups).cast("bigint"))
        return
    for half in _halves(part):
        yield from _parts(half, frozen, bound)


def replay(
    bouts: DataFrame,
    fixed_k: float | None = None,
    frozen: bool = False,
    known: DataFrame | None = None,
    group_bouts: int | None = None,
) -> DataFrame:
    """Pre-bout ratings ``red_pre`` and ``blue_pre`` of ``bouts`` (pool, bout_id, d, red, blue, winner).

    ``known`` (pool, entity, gain, bouts) is the state after earlier bouts. Slices are stored as they are done.
    """
    bound = GROUP_BOUTS if group_bouts is None else group_bouts
    spark = bouts.sparkSession
    score = score_of(outcome_of(F.col("red"), F.col("winner"))).alias("red_score")
    rows = stage(bouts.select("pool", "bout_id", "d", "red", "blue", score))
    most = rows.groupBy("pool").count().agg(F.max("count")).first()[0] or 0
    if most <= bound:
        return _replay_groups(rows, F.lit(0).cast("bigint"), fixed_k, frozen, known)
    sliced = stage(_sliced(rows, frozen, bound), "slice")
    last = sliced.agg(F.max("slice")).first()[0]
    folder = os.path.join(checkpoint_root(spark), "ratings-" + uuid.uuid4().hex)
    done, schema = 0, None
    for i in range(last + 1):
        for part, group in _parts(sliced.where(F.col("slice") == i).drop("slice"), frozen, bound):
            path = os.path.join(folder, f"step={done}")
            rated = _replay_day(part, fixed_k, known) if group is None else _replay_groups(part, group, fixed_k, frozen, known)
            rated.write.parquet(path)
            schema, done = rated.schema, done + 1
            known = stage(_after(known, spark.read.schema(schema).parquet(path)))
    return spark.read.schema(schema).parquet(*[os.path.join(folder, f"step={j}") for j in range(done)])


def replay_after(bouts: DataFrame, known: DataFrame | None, **options) -> tuple[DataFrame, DataFrame]:
    """Continue a stored replay: ratings of new bouts, and the gains and bout counts after them.

    ``known`` has pool, entity, gain and bouts; all new bouts come after those it covers.
    """
    rated = replay(bouts, known=known, **options)
    return rated, _after(known, rated)


def replay_by_period(bouts: DataFrame, fixed_k: float | None = None, **options) -> DataFrame:
    """As ``replay``, with ratings frozen inside a day: all bouts of a card see the ratings before it."""
    return replay(bouts, fixed_k, frozen=True, **options)


def final_ratings(rated: DataFrame) -> DataFrame:
    """Rating and bout count of every entity after its last bout."""
    return (
        changes(rated)
        .groupBy(*KEY)
        .agg((START_RATING + F.sum("change")).alias("rating"), F.count("*").alias("bouts"))
    )


def rating_sides(rated: DataFrame) -> DataFrame:
    """Long form with own and opponent rating before and after each bout."""

    def half(side: str, other: str) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.col(side).alias("entity"),
            F.col(f"{side}_pre").alias("own_pre"),
            (F.col(f"{side}_pre") + _change(side)).alias("own_post"),
            F.col(f"{other}_pre").alias("opp_pre"),
            (F.col(f"{other}_pre") + _change(other)).alias("opp_post"),
        )

    return rated.select("pool", "bout_id", "d", F.inline(F.array(half("red", "blue"), half("blue", "red"))))


def rating_state(rated: DataFrame) -> DataFrame:
    """One row per (pool, entity) after its last bout: ``elo``, ``opp_elo`` (mean of its opponents' ratings before its bouts)."""
    return rating_sides(rated).groupBy(*KEY).agg(
        F.max_by("own_post", "bout_id").alias("elo"), F.avg("opp_pre").alias("opp_elo"), F.count("*").alias("rated_bouts")
    )


def rating_history(rated: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    """The rating of every entity after each of its bouts, and the day (``valid_to``) of the bout that replaces it."""
    after = rating_sides(rated).select(*KEY, "bout_id", F.col("d").alias("valid_from"), F.col("own_post").alias("elo"))
    return validity(after, KEY, "valid_from", "bout_id", skew)


def mean_opponent_rating(sides: DataFrame, skew: Skew | None = None) -> DataFrame:
    """Mean rating of the opponents met so far: as they stood before those bouts, and after them."""
    skew = find_skew(sides, KEY) if skew is None else skew
    runs = [
        Run("_n", "count", F.lit(1)),
        Run("_pre", "sum", F.col("opp_pre")),
        Run("_post", "sum", F.col("opp_post")),
    ]
    out = running(sides, KEY, "bout_id", runs, skew)
    return out.select(
        *sides.columns,
        F.try_divide("_pre", "_n").alias("opponent_rating"),
        F.try_divide("_post", "_n").alias("opponent_rating_after"),
    )


def leaderboard(ratings: DataFrame, size: int = 30) -> DataFrame:
    """Top ratings; ties by entity. A top-k report, so the limit is the feature."""
    return ratings.orderBy(F.desc("rating"), *KEY).limit(size)

