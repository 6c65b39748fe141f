"""Bets from predictions and odds, and bankroll paths over many strategies at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions import betting
from boutline.operators.scan import ALL_KEYS, NO_SKEW, SEGMENT_ROWS, Skew
from boutline.operators.summary import numbered

START_BANKROLL = 1000.0


@dataclass(frozen=True)
class Strategy:
    name: str
    fraction: float
    cap: float
    flat: float = 0.0


# fixed values: the presets (fraction, cap, flat share)
PRESETS = (
    Strategy("conservative", 0.025, 0.025),
    Strategy("normal", 0.05, 0.05),
    Strategy("risky", 0.1, 0.1),
    Strategy("conservative_flat", 0.025, 0.025, 0.01),
    Strategy("normal_flat", 0.05, 0.05, 0.015),
    Strategy("risky_flat", 0.1, 0.1, 0.02),
)
CARD_BET = Strategy("card", 0.05, 0.05, 0.005)


def prediction_table(rows: DataFrame, keep: str = "last") -> DataFrame:
    """One probability per ordered pair from rows (red, blue, p, row_no); rematches keep the last or first.

    The aggregate is combined map-side, so a pair with many rows sends few.
    """
    pick = F.max_by if keep == "last" else F.min_by
    return rows.groupBy("red", "blue").agg(pick("p", "row_no").alias("p"))


def match_predictions(bouts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Bouts that have both orders predicted and both odds, with p_ab and p_ba."""
    priced = bouts.where(F.col("red_odds").isNotNull() & F.col("blue_odds").isNotNull())
    ab = predictions.select("red", "blue", F.col("p").alias("p_ab"))
    ba = predictions.select(F.col("red").alias("blue"), F.col("blue").alias("red"), F.col("p").alias("p_ba"))
    return priced.join(ab, ["red", "blue"]).join(ba, ["red", "blue"])


def priced_bets(bouts: DataFrame, mode: str = "closer") -> DataFrame:
    """Adds a_win, b_win, both Kelly fractions, the picked side, its odds and Kelly, and if it was right."""
    usable = bouts.where(
        F.col("red_odds").isNotNull() & F.col("blue_odds").isNotNull() & F.col("p_ab").isNotNull() & F.col("p_ba").isNotNull()
    )
    a, b = betting.reconcile(mode, F.col("p_ab"), F.col("p_ba"), F.col("red_odds"), F.col("blue_odds"))
    first = F.col("a_win") > F.col("b_win")
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return (
        usable.withColumns({"a_win": a, "b_win": b})
        .withColumns(
            {
                "kelly_a": betting.kelly(F.col("red_odds"), F.col("a_win")),
                "kelly_b": betting.kelly(F.col("blue_odds"), F.col("b_win")),
                "pick": side("red", "blue"),
                "pick_odds": side("red_odds", "blue_odds"),
            }
        )
        .withColumn("pick_kelly", side("kelly_a", "kelly_b"))
        .withColumn("correct", F.coalesce(F.col("pick") == F.col("winner"), F.lit(False)))
    )


def for_strategies(bets: DataFrame, strategies: Sequence[Strategy] = PRESETS, rule: str = "kelly") -> DataFrame:
    """One row per bet and strategy with the staked share (NULL: no bet) and the settled return share."""
    options = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("strategy"),
                F.lit(s.fraction).alias("fraction"),
                F.lit(s.cap).alias("cap"),
                F.lit(s.flat).alias("flat"),
            )
            for s in strategies
        ]
    )
    wide = bets.select("*", F.inline(options))
    share = betting.stake_share(F.col("pick_kelly"), F.col("fraction"), F.col("cap"), F.col("flat"), rule)
    return (
        wide.withColumn("share", share)
        .withColumn("ret", betting.settle(F.col("share"), F.col("pick_odds"), F.col("pick"), F.col("winner")))
        .drop("fraction", "cap", "flat")
    )


def bankroll_path(
    settled: DataFrame,
    keys: Sequence[str] = ("strategy",),
    start: float = START_BANKROLL,
    skew: Skew = ALL_KEYS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Bankroll before and after each bet of every bankroll (``keys``), with the running extremes.

    Stakes are shares of the current bankroll, so the path is a running product. Unless ``skew`` says that
    no bankroll is large, it is taken inside segments of consecutive bouts; growth and extremes of whole
    segments are scanned on their own and joined back, so no task holds a whole bankroll. ``log_growth``
    (``log_before``: up to the bet) is the same path as a sum of logarithms, which cannot overflow on very long runs, ``log_high`` and ``log_low``
    are its extremes; a total loss makes it minus infinity from then on.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    growth = 1 + F.col("ret")
    log = F.when(growth > 0, F.log(growth)).when(growth.isNotNull(), F.lit(float("-inf")))  # ruin stays ruin
    segmented = skew != NO_SKEW
    part = ["_key", "_seg"] if segmented else list(keys)
    rows = settled
    if segmented:  # keys as one struct: null keys meet as well
        cut = F.coalesce(F.floor(F.col("bout_id") / segment_rows), F.lit(-1))
        rows = rows.withColumns({"_key": F.struct(*keys), "_seg": cut}).repartition(*part)
    w = Window.partitionBy(*part).orderBy("bout_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        F.product(growth).over(upto).alias("_g"),
        F.coalesce(F.product(growth).over(before), one).alias("_g_before"),
        F.sum(log).over(upto).alias("_log"),
        F.coalesce(F.sum(log).over(before), F.lit(0.0)).alias("_log_before"),
    )
    running = lambda f, c: f(c).over(upto)
    extremes = local.withColumns(
        {"_gmax": running(F.max, "_g"), "_gmin": running(F.min, "_g"), "_lmax": running(F.max, "_log"), "_lmin": running(F.min, "_log")}
    )
    if segmented:
        totals = local.groupBy(*part).agg(
            F.product(growth).alias("_total"), F.max("_g").alias("_high"), F.min("_g").alias("_low"), F.sum(log).alias("_logs"),
            F.max("_log").alias("_lhigh"), F.min("_log").alias("_llow"),
        )
        earlier = Window.partitionBy("_key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.withColumn("_c", F.coalesce(F.product("_total").over(earlier), one))
        carried = carried.withColumn("_clog", F.coalesce(F.sum("_logs").over(earlier), F.lit(0.0)))
        carried = carried.select(
            *part,
            "_c",
            "_clog",
            F.max(F.col("_clog") + F.col("_lhigh")).over(earlier).alias("_ltop"),
            F.min(F.col("_clog") + F.col("_llow")).over(earlier).alias("_lbottom"),
            F.max(F.col("_c") * F.col("_high")).over(earlier).alias("_top"),
            F.min(F.col("_c") * F.col("_low")).over(earlier).alias("_bottom"),
        )
        joined = extremes.join(carried, part)
    else:
        joined = extremes.withColumns({"_c": one, "_clog": zero, "_top": one, "_bottom": one, "_ltop": zero, "_lbottom": zero})
    return joined.select(
        *settled.columns,
        (start * F.col("_c") * F.col("_g_before")).alias("bankroll_before"),
        (start * F.col("_c") * F.col("_g")).alias("bankroll"),
        (start * F.greatest(one, "_top", F.col("_c") * F.col("_gmax"))).alias("max_bankroll"),
        (start * F.least(one, "_bottom", F.col("_c") * F.col("_gmin"))).alias("min_bankroll"),
        (F.col("_clog") + F.col("_log")).alias("log_growth"),
        (F.col("_clog") + F.col("_log_before")).alias("log_before"),
        F.greatest(zero, "_ltop", F.col("_clog") + F.col("_lmax")).alias("log_high"),
        F.least(zero, "_lbottom", F.col("_clog") + F.col("_lmin")).alias("log_low"),
    )


def strategy_summary(path: DataFrame, keys: Sequence[str] = ("strategy",), start: float = START_BANKROLL) -> DataFrame:
    """Each bankroll as a whole: logarithms of its end and extremes, ruin, bets; money where a double holds it."""
    money = lambda c: F.when(F.abs(c) < 700, start * F.exp(c))
    placed = F.col("share").isNotNull()
    out = path.groupBy(*keys).agg(
        F.max_by("log_growth", "bout_id").alias("log_growth"), F.max("log_high").alias("log_high"), F.min("log_low").alias("log_low"),
        F.count_if(placed & F.col("winner").isNotNull()).alias("bets"), F.count_if(placed & F.col("correct")).alias("correct_bets"),
    )
    ruined = F.col("log_growth") == F.lit(float("-inf"))
    return out.withColumns({"ruined": ruined, "final_bankroll": F.when(ruined, F.lit(0.0)).otherwise(money(F.col("log_growth")))})


def _log_total(path: DataFrame, keys: Sequence[str], terms: dict[str, Column]) -> DataFrame:
    """Logarithms of sums of exponentials of ``terms`` per key; null where nothing is summed.

    Terms are first added up beside others of their own size (steps of e^64), so neither huge nor tiny bankrolls leave
    the range of a double, and the few steps of a key are added relative to its largest.
    """
    size = 64.0
    named = F.array(*[F.struct(F.lit(n).alias("_name"), c.alias("_log")) for n, c in terms.items()])
    logs = path.select(*keys, F.inline(named)).where(F.col("_log") > float("-inf"))
    steps = logs.groupBy(*keys, "_name", F.floor(F.col("_log") / size).alias("_step")).agg(
        F.sum(F.exp(F.col("_log") - size * F.floor(F.col("_log") / size))).alias("_part")
    )
    top = F.max("_step").over(Window.partitionBy(*keys, "_name"))  # one row per step: a few per key
    total = steps.withColumn("_top", top).groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_name") == n, size * F.col("_top"))).alias(f"_at_{n}") for n in terms
        ],
        *[
            F.sum(F.when(F.col("_name") == n, F.col("_part") * F.exp(size * (F.col("_step") - F.col("_top"))))).alias(f"_sum_{n}")
            for n in terms
        ],
    )
    return total.select(*keys, *[(F.col(f"_at_{n}") + F.log(f"_sum_{n}")).alias(n) for n in terms])


def bankroll_report(path: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """The full bet summary of whole bankrolls of any length: counts, hit rates, gains and losses.

    Money is given as logarithms relative to the start (``log_*``), since a bankroll of many bets leaves the range of a
    double; null means no such bet. A bet after ruin stakes nothing and is counted only.
    """
    placed, draw, favourite = F.col("share").isNotNull(), F.col("winner").isNull(), F.col("pick_odds") < 0
    won, lost = placed & F.col("correct"), placed & ~F.col("correct") & ~draw
    before = F.col("log_before")
    gain, loss = before + F.log("ret"), before + F.log("share")
    out = path.groupBy(*keys).agg(
        F.max_by("log_growth", "bout_id").alias("log_growth"),
        F.max("log_high").alias("log_high"),
        F.min("log_low").alias("log_low"),
        F.count("*").alias("predictions"),
        F.count_if(F.col("correct")).alias("correct_predictions"),
        F.count_if(won | lost).alias("bets"),
        F.count_if(won).alias("correct_bets"),
        F.count_if(placed & favourite).alias("favourites"),
        F.count_if(won & favourite).alias("favourites_hit"),
        F.count_if(placed & ~favourite).alias("underdogs"),
        F.count_if(won & ~favourite).alias("underdogs_hit"),
    )
    money = _log_total(
        path, keys,
        {
            "log_favourite_gain": F.when(won & favourite, gain),
            "log_favourite_loss": F.when(lost & favourite, loss),
            "log_underdog_gain": F.when(won & ~favourite, gain),
            "log_underdog_loss": F.when(lost & ~favourite, loss),
        },
    )
    same = [out[k].eqNullSafe(money[k]) for k in keys]
    joined = out.join(money, same, "left").select(*[out[c] for c in out.columns], *[c for c in money.columns if c not in keys])
    return joined.withColumns(
        {
            "prediction_pct": percent(F.col("correct_predictions"), F.col("predictions")),
            "bet_pct": percent(F.col("correct_bets"), F.col("bets")),
            "favourite_pct": percent(F.col("favourites_hit"), F.col("favourites")),
            "underdog_pct": percent(F.col("underdogs_hit"), F.col("underdogs")),
        }
    )


def card_path(settled: DataFrame, keys: Sequence[str] = ("strategy",), start: float = START_BANKROLL) -> DataFrame:
    """Bankroll after each day's card when all its stakes use the bankroll at its start."""
    cards = settled.groupBy(*keys, "d").agg(
        F.sum("ret").alias("card_return"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("card_share")
    )
    w = Window.partitionBy(*keys).orderBy("d")  # one row per calendar day
    before = F.lit(start) * F.coalesce(
        F.product(1 + F.col("card_return")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)
    )
    return cards.withColumn("card_start", before).select(
        *keys,
        "d",
        "card_start",
        (F.col("card_start") * F.col("card_share")).alias("card_stake"),
        (F.col("card_start") * (1 + F.col("card_return"))).alias("bankroll"),
    )


def card_summary(cards: DataFrame, keys: Sequence[str] = ("strategy",), start: float = START_BANKROLL) -> DataFrame:
    return cards.groupBy(*keys).agg(
        F.max_by("bankroll", "d").alias("final_bankroll"),
        F.avg("bankroll").alias("mean_bankroll"),
        F.least(F.lit(start), F.min("bankroll")).alias("min_bankroll"),
        F.greatest(F.lit(start), F.max("bankroll")).alias("max_bankroll"),
        F.max("card_stake").alias("max_card_stake"),
    )


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole), F.lit(0.0))


def backtest_summary(path: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Counts, hit rates, gains and losses per bankroll in one pass over its path."""
    placed = F.col("share").isNotNull()
    draw = F.col("winner").isNull()
    favourite = F.col("pick_odds") < 0
    won = placed & F.col("correct")
    lost = placed & ~F.col("correct") & ~draw
    stake = F.col("bankroll_before") * F.col("share")
    profit = F.col("bankroll_before") * F.col("ret")
    count = lambda c: F.sum(c.cast("bigint"))
    money = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    out = path.groupBy(*keys).agg(
        F.max_by("bankroll", "bout_id").alias("final_bankroll"),
        F.max("max_bankroll").alias("max_bankroll"),
        F.min("min_bankroll").alias("min_bankroll"),
        F.count("*").alias("predictions"),
        count(F.col("correct")).alias("correct_predictions"),
        count(won | lost).alias("bets"),
        count(won).alias("correct_bets"),
        count(placed & favourite).alias("favourites"),
        count(won & favourite).alias("favourites_hit"),
        count(placed & ~favourite).alias("underdogs"),
        count(won & ~favourite).alias("underdogs_hit"),
        money(won & favourite, profit).alias("favourite_gain"),
        money(lost & favourite, stake).alias("favourite_loss"),
        money(won & ~favourite, profit).alias("underdog_gain"),
        money(lost & ~favourite, stake).alias("underdog_loss"),
    )
    return out.withColumns(
        {
            "prediction_pct": percent(F.col("correct_predictions"), F.col("predictions")),
            "bet_pct": percent(F.col("correct_bets"), F.col("bets")),
            "favourite_pct": percent(F.col("favourites_hit"), F.col("favourites")),
            "underdog_pct": percent(F.col("underdogs_hit"), F.col("underdogs")),
        }
    )


def expected_totals(path: DataFrame) -> DataFrame:
    """Expected value of all stakes under fixed hit rates: favourites 0.7, underdogs 0.34."""
    stake = F.col("bankroll_before") * F.col("share")
    back = stake * betting.net_return(F.col("pick_odds"))
    ev = F.when(F.col("pick_odds") < 0, 0.7 * back - 0.3 * stake).otherwise(0.34 * back - 0.66 * stake)
    return path.groupBy("strategy").agg(
        F.coalesce(F.sum(ev), F.lit(0.0)).alias("expected_value"), F.coalesce(F.sum(stake), F.lit(0.0)).alias("staked")
    )


def resolve_winner(
    bouts: DataFrame, results: DataFrame, outcome: str = "corner_outcome", draw: str = "draw/no contest"
) -> DataFrame:
    """Winner from the corner outcome; else the newest stored result of the pair in either orientation.

    ``results`` has red, blue, winner (NULL for a draw) and row_no. It is reduced to one row per
    unordered pair before the join.
    """
    lo, hi = F.least("red", "blue"), F.greatest("red", "blue")
    latest = results.groupBy(lo.alias("_lo"), hi.alias("_hi")).agg(
        F.max_by(F.coalesce(F.col("winner").cast("string"), F.lit(draw)), "row_no").alias("_found")
    )
    joined = bouts.withColumns({"_lo": lo, "_hi": hi}).join(latest, ["_lo", "_hi"], "left")
    o = F.col(outcome)
    name = (
        F.when(o == "loss", F.col("red").cast("string"))
        .when(o == "win", F.col("blue").cast("string"))
        .when(o == "draw", F.lit(draw))
        .otherwise(F.coalesce("_found", F.lit("")))
    )
    return joined.withColumn("winner_name", name).drop("_lo", "_hi", "_found")


def retrain_days(days: Sequence, start, every: int, end=None) -> list:
    """Training days: the start, then each first event day at least ``every`` days later, before ``end``."""
    out = [start]
    for day in sorted(days):
        if (day - out[-1]).days >= every and (end is None or day < end):
            out.append(day)
    return out


def event_days(bouts: DataFrame) -> list:
    """Distinct days, at most one per calendar day."""
    return [r["d"] for r in bouts.select("d").distinct().orderBy("d").collect()]


def with_epoch(bouts: DataFrame, training_days: Sequence, name: str = "model_epoch") -> DataFrame:
    """Newest training day at or before each bout; undated bouts are left out.

    The training days are a short list (at most one per calendar day) that is searched in place, so bouts are neither
    counted nor joined.
    """
    days = F.array(*[F.lit(day) for day in training_days]).cast("array<date>")
    newest = F.array_max(F.filter(days, lambda day: day <= F.col("d")))
    return bouts.where(F.col("d").isNotNull()).withColumn(name, newest)


def cards(bouts: DataFrame, day: str = "d") -> DataFrame:
    """(card, day): every day with bouts is a card; they are numbered from 1. Undated bouts are on no card."""
    days = bouts.where(F.col(day).isNotNull()).select(day).distinct()
    days = numbered(days.withColumn("_order", F.unix_date(day)), "_order", "_at")  # at most one row per calendar day
    return days.select((F.col("_at") + 1).cast("long").alias("card"), day)


def card_registry(cards: DataFrame, every: int, day: str = "d") -> DataFrame:
    """Versions of what is renewed after every ``every`` cards.

    ``version`` 0 is what existed before the first card. Version v knows all bouts through ``through``, the day of card
    v * every, and holds for cards ``valid_from`` to ``valid_to``, all later than what it knows.
    """
    made = cards.where(F.col("card") % every == 0).select((F.col("card") / every).cast("long").alias("version"), F.col(day).alias("through"))
    first = cards.sparkSession.range(1).select(F.col("id").alias("version"), F.lit(None).cast("date").alias("through"))
    start = F.col("version") * every
    return first.unionByName(made).withColumns({"valid_from": start + 1, "valid_to": start + every})


def with_card_epochs(bouts: DataFrame, state_every: int = 8, model_every: int = 10, day: str = "d") -> DataFrame:
    """Adds ``card``, ``model_through`` and ``state_through``: the last days that the model and the entity state know.

    A model is trained after every ``model_every`` cards; the state is refreshed after every ``state_every`` cards and
    with each model. Both are null until the first renewal. Undated bouts are left out.
    """
    known = cards(bouts, day)
    at = F.col("card") - 1
    lookup = known.withColumns({"_m": F.floor(at / model_every), "_s": F.floor(at / state_every)})
    for key, every, name in (("_m", model_every, "model_through"), ("_s", state_every, "_state")):
        versions = card_registry(known, every, day).select(F.col("version").alias(key), F.col("through").alias(name))
        lookup = lookup.join(versions, key, "left")
    lookup = lookup.select(day, "card", "model_through", F.greatest("_state", "model_through").alias("state_through"))
    return bouts.join(F.broadcast(lookup), day)  # one row per calendar day


def card_training_days(bouts: DataFrame, every: int = 10, day: str = "d") -> list:
    """First days on which each later version holds, as ``walk_forward`` takes them: it trains on all days before."""
    starts = cards(bouts, day).where((F.col("card") > 1) & ((F.col("card") - 1) % every == 0))
    return [r[0] for r in starts.select(day).orderBy(day).collect()]  # days of the calendar
