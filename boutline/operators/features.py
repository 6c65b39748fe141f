"""Pre-bout feature rows, entity state, announced cards and mirrored training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators import running as run
from boutline.operators.longform import long_form, sides_to_wide
from boutline.operators.running import BASE_STATS, Stat
from boutline.operators.scan import NO_SKEW, Skew, find_skew

MIN_PRIOR_BOUTS = 2
CARRIED = ("born", "prior_bouts", "win_streak", "lose_streak", "title_wins", "win_rate", "age", "mean_age", "layoff_days")
RATINGS = ("elo", "opp_elo")


def stat_columns(stats: Sequence[Stat]) -> list[str]:
    return list(run.recency_terms(stats))


def feature_columns(stats: Sequence[Stat] = BASE_STATS) -> list[str]:
    return [*CARRIED, *stat_columns(stats)]


def entity_long(clean: DataFrame, master: DataFrame | None = None, stats: Sequence[Stat] = BASE_STATS) -> DataFrame:
    """Long form with the base stats, and the date of birth when ``master`` is given."""
    long = long_form(clean, ["is_title", "method", "minutes"], [s.name for s in stats])
    if master is None:
        return long
    return long.join(master.select("entity", "dob"), "entity", "left")


def entity_skew(clean: DataFrame) -> Skew:
    return find_skew(clean.select(F.explode(F.array("red", "blue")).alias("entity")), ["entity"])


def side_features(
    long: DataFrame, stats: Sequence[Stat] = BASE_STATS, skew: Skew = NO_SKEW, compat: bool = False
) -> DataFrame:
    """All running features of both sides; every step shares one partitioning and sort by entity."""
    out = run.experience(long, skew)
    out = run.recency_features(out, stats, skew, compat)
    out = run.streaks(out, skew)
    out = run.win_totals(out.drop("prior_bouts"), skew)
    out = run.layoff(out, skew)
    return run.ages(out, skew)


def bout_features(
    clean: DataFrame,
    master: DataFrame,
    stats: Sequence[Stat] = BASE_STATS,
    skew: Skew | None = None,
    min_prior: int = MIN_PRIOR_BOUTS,
    compat: bool = False,
    ratings: DataFrame | None = None,
) -> DataFrame:
    """One row per eligible bout: decided, both sides experienced, both dates of birth known.

    ``ratings`` (bout_id, entity, elo, opp_elo) adds the rating before the bout and the mean rating of
    past opponents.
    """
    skew = entity_skew(clean) if skew is None else skew
    sides = side_features(entity_long(clean, master, stats), stats, skew, compat)
    if ratings is not None:
        sides = sides.join(ratings.select("bout_id", "entity", *RATINGS), ["bout_id", "entity"], "left")
    is_red = F.col("side") == "red"
    sides = sides.withColumns(
        {
            "red": F.when(is_red, F.col("entity")).otherwise(F.col("opponent")),
            "blue": F.when(is_red, F.col("opponent")).otherwise(F.col("entity")),
            "won": F.when(F.col("outcome") != "draw", (F.col("outcome") == "win").cast("int")),
            "known": F.col("dob").isNotNull().cast("int"),
            "born": F.year("dob"),
        }
    )
    cols = [*feature_columns(stats), *(() if ratings is None else RATINGS)]
    wide = sides_to_wide(sides, [*cols, "won", "known"], ["bout_id", "d", "is_title", "red", "blue"])
    fit = (
        F.col("red_won").isNotNull()
        & (F.col("red_prior_bouts") >= min_prior)
        & (F.col("blue_prior_bouts") >= min_prior)
        & (F.col("red_known") == 1)
        & (F.col("blue_known") == 1)
    )
    result = F.when(F.col("red_won") == 1, F.lit("win")).otherwise(F.lit("loss")).alias("result")
    return wide.where(fit).select(
        "bout_id", "d", "is_title", "red", "blue", result,
        *[F.col(f"{s}_{c}") for c in cols for s in ("red", "blue")],
        *differences(cols),
    )


def differences(cols: Sequence[str]) -> list[Column]:
    return [(F.col(f"red_{c}") - F.col(f"blue_{c}")).alias(f"{c}_oppdiff") for c in cols]


def swap_name(name: str) -> str:
    if name.startswith("red"):
        return "blue" + name[3:]
    return "red" + name[4:] if name.startswith("blue") else name


def swapped(features: DataFrame, when: Column | None = None, label: str = "result") -> DataFrame:
    """Red and blue exchanged, differences negated, label flipped; only where ``when`` holds, if given."""
    flipped = []
    for c in features.columns:
        if c == label:
            new = F.when(F.col(c) == "win", F.lit("loss")).when(F.col(c) == "loss", F.lit("win")).otherwise(F.col(c))
        elif c.endswith("_oppdiff"):
            new = -F.col(c)
        elif swap_name(c) in features.columns:
            new = F.col(swap_name(c))
        else:
            new = F.col(c)
        flipped.append((new if when is None else F.when(when, new).otherwise(F.col(c))).alias(c))
    return features.select(*flipped)


def mirrored(features: DataFrame, label: str = "result") -> DataFrame:
    """Every row and its corner-swapped copy. A side's column without a partner becomes NULL in one half.

    Both halves come from one pass over the input, which a union would compute twice.
    """
    have = features.columns
    names = [*have, *[swap_name(c) for c in have if swap_name(c) not in have]]
    kinds = {f.name: f.dataType for f in features.schema.fields}

    def value(name: str, flip: bool) -> Column:
        source = swap_name(name) if flip else name
        if source not in kinds:
            return F.lit(None).cast(kinds[name] if name in kinds else kinds[swap_name(name)]).alias(name)
        c = F.col(source)
        if flip and name == label:
            c = F.when(c == "win", F.lit("loss")).when(c == "loss", F.lit("win"))
        elif flip and name.endswith("_oppdiff"):
            c = -c
        return c.alias(name)

    halves = [F.struct(*[value(n, flip) for n in names], F.lit(flip).alias("mirrored")) for flip in (False, True)]
    return features.select(F.inline(F.array(*halves)))


def corner_swap_flag(bout_id: Column, seed: int = 42) -> Column:
    """Reproducible coin per bout: plain arithmetic, so any engine draws the same side."""
    return F.pmod(F.floor(((bout_id % 1000003) * 40503 + seed * 7919) / 1024), F.lit(2)) == 1


def entity_state(
    long: DataFrame, stats: Sequence[Stat] = BASE_STATS, skew: Skew = NO_SKEW
) -> DataFrame:
    """Undivided accumulators of every entity after its last bout in ``long``."""
    ranked = run.streaks(run.experience(long, skew), skew, prior=False)
    terms = run.recency_terms(stats)
    title = F.col("is_title").cast("bigint")
    return ranked.groupBy("entity").agg(
        F.count("*").alias("bouts"),
        F.sum(run.is_outcome("win")).alias("wins"),
        F.sum(run.is_outcome("loss")).alias("losses"),
        F.sum(run.is_outcome("draw")).alias("draws"),
        F.sum(run.is_outcome("win") * title).alias("title_wins"),
        F.max_by("win_streak", "bout_id").alias("win_streak"),
        F.max_by("lose_streak", "bout_id").alias("lose_streak"),
        F.max("d").alias("last_d"),
        F.sum(F.year("d").cast("bigint")).alias("year_sum"),
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{k}_sum") for k, v in terms.items()],
    )


def card_features(
    card: DataFrame,
    state: DataFrame,
    master: DataFrame,
    as_of: Column,
    stats: Sequence[Stat] = BASE_STATS,
    min_bouts: int = MIN_PRIOR_BOUTS,
    compat: bool = False,
    ratings: DataFrame | None = None,
) -> DataFrame:
    """Feature rows for announced matchups (bout_id, red, blue) in both corner orders.

    Unknown entities, entities with too few bouts and those without a date of birth drop out. ``ratings``
    (entity, elo, opp_elo; one row per entity) adds the ratings as of the same state; unrated entities keep null.
    """
    n = F.col("bouts")
    terms = run.recency_terms(stats)
    born = F.year("dob")
    ready = (
        state.where(n >= min_bouts)
        .join(master.select("entity", "dob").where(F.col("dob").isNotNull()), "entity")
        .select(
            "entity",
            "last_d",
            born.alias("born"),
            n.alias("prior_bouts"),
            "win_streak",
            "lose_streak",
            "title_wins",
            (F.col("wins").cast("double") / n).alias("win_rate"),
            (F.col("year_sum").cast("double") / n - born).alias("mean_age"),
            *[
                (
                    run.pyramid(F.col(f"{k}_sum") / n)
                    if compat and k.endswith("_def")
                    else F.col(f"{k}_sum") / run.pyramid(n)
                ).alias(k)
                for k in terms
            ],
        )
    )
    if ratings is not None:
        ready = ready.join(ratings.select("entity", *RATINGS), "entity", "left")
    orders = card.select(
        "bout_id",
        F.inline(
            F.array(
                F.struct(F.lit("ab").alias("corner_order"), F.col("red").alias("red"), F.col("blue").alias("blue")),
                F.struct(F.lit("ba").alias("corner_order"), F.col("blue").alias("red"), F.col("red").alias("blue")),
            )
        ),
    )
    for side in ("red", "blue"):
        orders = orders.join(ready.select(*[F.col(c).alias(side if c == "entity" else f"{side}_{c}") for c in ready.columns]), side)
    dated = orders.withColumns(
        {
            f"{s}_{name}": value
            for s in ("red", "blue")
            for name, value in (
                ("age", F.year(as_of) - F.col(f"{s}_born")),
                ("layoff_days", F.datediff(as_of, F.col(f"{s}_last_d"))),
            )
        }
    )
    cols = [*feature_columns(stats), *(() if ratings is None else RATINGS)]
    return dated.select(
        "bout_id", "corner_order", "red", "blue",
        *[F.col(f"{s}_{c}") for c in cols for s in ("red", "blue")],
        *differences(cols),
    )


def with_master(bouts: DataFrame, master: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left join of both sides to the entity table. Its size decides the join, not a hint."""
    for side in ("red", "blue"):
        dim = master.select(F.col("entity").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols])
        bouts = bouts.join(dim, side, "left")
    return bouts


def history_aggregates(long: DataFrame, values: Sequence[str], places: int = 9) -> DataFrame:
    """Mean, sum and deviation of each value per entity.

    Sums are rounded to ``places`` first, so that the order of addition cannot decide how a mean is rounded later.
    """
    aggs = []
    for c in values:
        total = F.round(F.sum(c), places)
        aggs += [
            F.try_divide(total, F.count(c)).alias(f"{c}_avg"),
            total.alias(f"{c}_sum"),
            F.when(F.count(c) > 1, F.stddev(c)).alias(f"{c}_std"),
        ]
    return long.groupBy("entity").agg(*aggs)


def with_history_aggregates(bouts: DataFrame, aggs: DataFrame) -> DataFrame:
    names = [c for c in aggs.columns if c != "entity"]
    return with_master(bouts, aggs, names)


def compare_entities(state: DataFrame, a: Column, b: Column, cols: Sequence[str]) -> DataFrame:
    """One row with the chosen stats of two entities side by side; ``a`` and ``b`` are scalars."""
    pair = state.where((F.col("entity") == a) | (F.col("entity") == b))
    aggs = [
        F.max(F.when(F.col("entity") == who, F.col(c))).alias(f"{p}_{c}")
        for p, who in (("a", a), ("b", b))
        for c in ("entity", *cols)
    ]
    return pair.agg(*aggs)


def prefixed_pairs(
    matchups: DataFrame, state: DataFrame, sides: Sequence[str] = ("red", "blue"), prefixes: Sequence[str] = ("fighter", "opponent"), least: int = 2
) -> DataFrame:
    """Matchups with the whole state of both sides, its columns named ``<prefix>_<column>``; result and date are unknown.

    ``state`` has one row per entity. Matchups with an unknown entity, or one of fewer than ``least`` bouts, give no row.
    """
    known = state.where(F.col("bouts") >= least)
    rest = [c for c in matchups.columns if c not in sides]
    for side, prefix in zip(sides, prefixes, strict=True):
        named = known.select(*[F.col(c).alias(f"{prefix}_{c}") for c in known.columns])
        matchups = matchups.join(named, matchups[side] == named[f"{prefix}_entity"])
    named = [f"{prefix}_{c}" for prefix in prefixes for c in known.columns]
    return matchups.select(*rest, *named, F.lit("unknown").alias("result"), F.lit("unknown").alias("date"))


def distinct_entities(bouts: DataFrame) -> DataFrame:
    """Entities of either corner; duplicates are combined before the shuffle."""
    return bouts.select(F.explode(F.array("red", "blue")).alias("entity")).distinct()


def invalid_matchups(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests that cannot be scored, with the reason. ``known`` has one row per entity."""
    for side in ("red", "blue"):
        hit = known.select(F.col("entity").alias(side), F.lit(True).alias(f"_{side}_ok"))
        requests = requests.join(hit, side, "left")
    reason = (
        F.when(F.col("red").isNull() | F.col("blue").isNull(), F.lit("missing name"))
        .when(F.col("red") == F.col("blue"), F.lit("same entity"))
        .when(F.col("_red_ok").isNull() | F.col("_blue_ok").isNull(), F.lit("unknown entity"))
    )
    return requests.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_red_ok", "_blue_ok")
