"""Leak-free running features: every value uses earlier bouts of the entity only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.operators.scan import NO_SKEW, Run, Skew, running

KEY, ORDER = ["entity"], "bout_id"
# fixed values: weights of the career statistics in the hand-weighted power rating
POWER_WEIGHTS = {
    "SLpM": 3.0,
    "Str_Acc": 3.0,
    "SApM": -3.0,
    "Str_Def": 5.0,
    "TD_Avg": 2.0,
    "TD_Acc": 2.0,
    "TD_Def": 5.0,
    "Sub_Avg": 3.0,
}
PRIME_AGE_DAYS = 25 * 365
UNKNOWN_AGE_GAP_DAYS = 5 * 365


@dataclass(frozen=True)
class Stat:
    """A base statistic ``name`` held in own_<name> / opp_<name>; shares also get a defence value."""

    name: str
    share: bool = False


BASE_STATS = (Stat("kd"), Stat("sig"), Stat("sig_pct", share=True), Stat("ctrl"))


def is_outcome(value: str) -> Column:
    return (F.col("outcome") == value).cast("bigint")


def pyramid(n: Column) -> Column:
    """1 + 4 + 9 + ... + n*n."""
    return n * (n + 1) * (2 * n + 1) / 6


def experience(long: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    """Adds ``prior_bouts`` (N) and the bout's ordinal ``n``."""
    counted = running(long, KEY, ORDER, [Run("prior_bouts", "count", F.lit(1))], skew)
    return counted.withColumn("n", F.col("prior_bouts") + 1)


def recency_terms(stats: Sequence[Stat]) -> dict[str, Column]:
    """Per-bout contributions, weighted by the squared ordinal; NULL where the bout is skipped."""
    terms: dict[str, Column] = {}
    sq = F.col("n") * F.col("n")
    for s in stats:
        own, opp = F.col(f"own_{s.name}"), F.col(f"opp_{s.name}")
        usable = own.isNotNull() & opp.isNotNull() & (F.col("minutes") > 0)
        terms[f"{s.name}_rate"] = F.when(usable, own * sq / F.col("minutes"))
        terms[f"{s.name}_diff"] = F.when(usable, (own - opp) * sq)
        if s.share:
            terms[f"{s.name}_def"] = F.when(usable, (1 - opp) * sq)
    return terms


def recency_features(
    ranked: DataFrame, stats: Sequence[Stat] = BASE_STATS, skew: Skew = NO_SKEW, compat: bool = False
) -> DataFrame:
    """Rates, differentials and defences before each bout; ``ranked`` comes from ``experience``.

    ``compat`` evaluates the pyramid at the mean defence instead of dividing by it.
    """
    terms = recency_terms(stats)
    summed = running(ranked, KEY, ORDER, [Run(f"_s_{k}", "sum", v) for k, v in terms.items()], skew)
    n = F.col("prior_bouts")
    out = []
    for k in terms:
        total = F.when(n > 0, F.coalesce(F.col(f"_s_{k}"), F.lit(0.0)))
        value = pyramid(total / n) if compat and k.endswith("_def") else total / pyramid(n)
        out.append(value.alias(k))
    return summed.select(*ranked.columns, *out)


def streaks(long: DataFrame, skew: Skew = NO_SKEW, draws_reset: bool = False, prior: bool = True) -> DataFrame:
    """Current win and lose streak. A draw leaves both alone unless ``draws_reset`` (wins only).

    A streak is the running count minus its value at the latest reset, and counts never fall, so the
    latest reset value is a running maximum.
    """
    won, lost = is_outcome("win"), is_outcome("loss")
    w_reset = (F.col("outcome") != "win") if draws_reset else (F.col("outcome") == "loss")
    counted = running(
        long, KEY, ORDER,
        [Run("_w", "sum", won, prior=False), Run("_l", "sum", lost, prior=False)],
        skew,
    )
    marked = counted.select(
        "*",
        F.when(w_reset, F.col("_w")).alias("_w_mark"),
        F.when(F.col("outcome") == "win", F.col("_l")).alias("_l_mark"),
    )
    marks = running(
        marked, KEY, ORDER,
        [Run("_w_at", "max", F.col("_w_mark"), prior), Run("_l_at", "max", F.col("_l_mark"), prior)],
        skew,
    )
    w_now = F.col("_w") - won if prior else F.col("_w")
    l_now = F.col("_l") - lost if prior else F.col("_l")
    return marks.select(
        *long.columns,
        (w_now - F.coalesce("_w_at", F.lit(0))).alias("win_streak"),
        (l_now - F.coalesce("_l_at", F.lit(0))).alias("lose_streak"),
    )


def win_totals(long: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    """``prior_bouts``, ``wins``, ``title_wins``, ``title_bouts`` and ``win_rate`` before each bout."""
    title = F.col("is_title").cast("bigint")
    runs = [
        Run("prior_bouts", "count", F.lit(1)),
        Run("_wins", "sum", is_outcome("win")),
        Run("_title_wins", "sum", is_outcome("win") * title),
        Run("_title_bouts", "sum", title),
    ]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c[1:])
    out = running(long, KEY, ORDER, runs, skew)
    return out.select(
        *long.columns,
        "prior_bouts",
        zero("_wins"),
        zero("_title_wins"),
        zero("_title_bouts"),
        F.try_divide(F.col("_wins").cast("double"), F.col("prior_bouts")).alias("win_rate"),
    )


def layoff(long: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    """Days since the entity's previous bout."""
    out = running(long, KEY, ORDER, [Run("_last_d", "last", F.col("d"))], skew)
    return out.select(*long.columns, F.datediff("d", "_last_d").alias("layoff_days"))


def ages(long: DataFrame, skew: Skew = NO_SKEW) -> DataFrame:
    """Age in years, mean age so far and the previous bout's distance from prime age; needs ``dob``."""
    age = F.year("d") - F.year("dob")
    gap = F.coalesce(F.abs(F.datediff("d", "dob") - PRIME_AGE_DAYS), F.lit(UNKNOWN_AGE_GAP_DAYS))
    runs = [
        Run("_age_sum", "sum", age.cast("bigint")),
        Run("_age_n", "count", age),
        Run("prime_age_gap", "last", gap),
    ]
    out = running(long, KEY, ORDER, runs, skew)
    return out.select(
        *long.columns,
        age.alias("age"),
        F.try_divide(F.col("_age_sum").cast("double"), F.col("_age_n")).alias("mean_age"),
        "prime_age_gap",
    )


def plain_differentials(
    long: DataFrame, stats: Sequence[str], skew: Skew = NO_SKEW, skip_missing: bool = False
) -> DataFrame:
    """Unweighted mean of own minus opponent; a bout lacking any of the stats adds nothing.

    Such a bout still counts in the divisor unless ``skip_missing``.
    """
    known = F.lit(True)
    for s in stats:
        known = known & F.col(f"own_{s}").isNotNull() & F.col(f"opp_{s}").isNotNull()
    counted = F.when(known, 1) if skip_missing else F.lit(1)
    runs = [Run("_n", "count", counted)]
    runs += [Run(f"_s_{s}", "sum", F.when(known, F.col(f"own_{s}") - F.col(f"opp_{s}"))) for s in stats]
    out = running(long, KEY, ORDER, runs, skew)
    return out.select(
        *long.columns,
        *[F.try_divide(F.coalesce(F.col(f"_s_{s}"), F.lit(0.0)), F.col("_n")).alias(f"{s}_mean_diff") for s in stats],
    )


def method_counts(long: DataFrame, methods: Sequence[str], skew: Skew = NO_SKEW) -> DataFrame:
    """Wins and losses by method before each bout, one column per method and outcome."""
    names = [(m, o) for m in methods for o in ("win", "loss")]
    runs = [Run(f"_{m}_{o}", "sum", is_outcome(o) * (F.col("method") == m).cast("bigint")) for m, o in names]
    out = running(long, KEY, ORDER, runs, skew)
    return out.select(
        *long.columns, *[F.coalesce(F.col(f"_{m}_{o}"), F.lit(0)).alias(f"{m}_{o}") for m, o in names]
    )


def prior_mean(long: DataFrame, value: str, name: str, skew: Skew = NO_SKEW) -> DataFrame:
    """Mean of ``value`` over the entity's earlier bouts."""
    out = running(long, KEY, ORDER, [Run("_s", "sum", F.col(value)), Run("_c", "count", F.col(value))], skew)
    return out.select(*long.columns, F.try_divide("_s", "_c").alias(name))


def latest_bouts(long: DataFrame, count: int) -> DataFrame:
    """The newest bouts of each entity with their index from 0; ranked per partition before the shuffle."""
    w = Window.partitionBy("entity").orderBy(F.desc("bout_id"))
    ranked = long.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count)
    return ranked.withColumn("idx", F.col("_rn") - 1).drop("_rn")


def power_rating(
    long: DataFrame,
    records: DataFrame,
    stat_weights: Mapping[str, float] = POWER_WEIGHTS,
    last: int = 5,
    top: int = 25,
    step: int = 3,
) -> DataFrame:
    """Hand-weighted rating: recent results scaled by the opponent's win share, plus weighted stats.

    ``records`` has entity, wins, losses, draws and the numeric stats named by ``stat_weights``.
    """
    total = F.col("wins") + F.col("losses") + F.col("draws")
    share = records.select(F.col("entity").alias("opponent"), F.try_divide(F.col("wins").cast("double"), total).alias("bias"))
    recent = latest_bouts(long.select("entity", "opponent", "outcome", "bout_id"), last).join(share, "opponent")
    weight = F.lit(float(top)) - F.lit(float(step)) * F.col("idx")
    won = F.col("outcome") == "win"
    impact = F.when(won, weight * F.col("bias")).otherwise(-weight * (1 - F.col("bias")))
    history = recent.groupBy("entity").agg(F.sum(impact).alias("_history"))
    stats = F.lit(0.0)
    for c, w in stat_weights.items():
        stats = stats + F.lit(float(w)) * F.col(c)
    return records.join(history, "entity", "left").select(
        "entity", (stats + F.coalesce("_history", F.lit(0.0))).alias("power")
    )
