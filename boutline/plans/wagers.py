"""Queries on odds, stakes, bankrolls and the text logs made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions import betting
from boutline.operators import backtest as bt
from boutline.operators import summary as sm
from boutline.operators import textlog as tl
from boutline.operators.scan import find_skew
from boutline.plans.history import cleaned, entity_skew
from boutline.plans.registry import query, sql_big, sql_round, views
from boutline.sources import tables as t
from boutline.sources.files import prediction_documents


def _implied(o: str) -> str:
    return f"(CASE WHEN {o} >= 0 THEN 100.0::DOUBLE / ({o} + 100) ELSE -{o} / (-{o} + 100.0::DOUBLE) END)"


def _net(o: str) -> str:
    return f"(CASE WHEN {o} < 0 THEN 100.0::DOUBLE / -{o} ELSE {o} / 100.0::DOUBLE END)"


def _kelly(o: str, p: str) -> str:
    return f"(({_net(o)} * {p} - (1 - {p})) / nullif({_net(o)}, 0))"


# estimates of both sides, then closer / independent / b-decides / average
_MODES = f"""odds AS (SELECT *, {_implied('red_odds')} AS ia, {_implied('blue_odds')} AS ib, 1 - p_ab AS q_ab, 1 - p_ba AS q_ba
   FROM clean WHERE red_odds IS NOT NULL AND blue_odds IS NOT NULL),
flags AS (SELECT *, abs(p_ab - ia) > abs(q_ba - ia) AS fa, abs(p_ba - ib) > abs(q_ab - ib) AS fb, (p_ab + q_ba) / 2 AS mean_a FROM odds),
step1 AS (SELECT *, CASE WHEN fa THEN q_ba ELSE p_ab END AS a1, CASE WHEN fa THEN 1 - q_ba ELSE p_ba END AS b1,
   CASE WHEN fb THEN q_ab ELSE p_ba END AS b_ind FROM flags),
step2 AS (SELECT *, CASE WHEN fb THEN 1 - q_ab ELSE a1 END AS a2, CASE WHEN fb THEN q_ab ELSE b1 END AS b2 FROM step1),
modes AS (SELECT *, CASE WHEN abs(a2 + b2 - 1) > 1e-9 THEN mean_a ELSE a2 END AS closer_a,
   CASE WHEN abs(a2 + b2 - 1) > 1e-9 THEN 1 - mean_a ELSE b2 END AS closer_b,
   a1 AS independent_a, b_ind AS independent_b, 1 - b_ind AS b_decides_a, b_ind AS b_decides_b,
   mean_a AS average_a, 1 - mean_a AS average_b FROM step2)"""
_BETS = f"""{_MODES},
kel AS (SELECT *, {_kelly('red_odds', 'closer_a')} AS kelly_a, {_kelly('blue_odds', 'closer_b')} AS kelly_b FROM modes),
bets AS (SELECT *, CASE WHEN closer_a > closer_b THEN red ELSE blue END AS pick, CASE WHEN closer_a > closer_b THEN red_odds ELSE blue_odds END AS pick_odds,
   CASE WHEN closer_a > closer_b THEN kelly_a ELSE kelly_b END AS pick_kelly FROM kel)"""
_PRESETS = " UNION ALL ".join(
    f"SELECT '{s.name}' AS strategy, {s.fraction}::DOUBLE AS fraction, {s.cap}::DOUBLE AS cap, {s.flat}::DOUBLE AS flat" for s in bt.PRESETS
)
_SHARE = "CASE WHEN pick_kelly > 0 THEN greatest(least(fraction * pick_kelly, cap), flat) WHEN pick_kelly > -0.5 THEN flat END"
_RET = f"CASE WHEN share IS NULL OR winner IS NULL THEN 0.0 WHEN pick = winner THEN share * {_net('pick_odds')} ELSE -share END"
_SETTLED = f"""{_BETS}, presets AS ({_PRESETS}),
shares AS (SELECT *, {_SHARE} AS share FROM bets, presets),
settled AS (SELECT *, {_RET} AS ret, coalesce(pick = winner, FALSE) AS correct FROM shares)"""
_PATH = f"""{_SETTLED},
grown AS (SELECT *, 1000.0 * product(1 + ret) OVER (PARTITION BY strategy, red ORDER BY bout_id ROWS UNBOUNDED PRECEDING) AS bankroll,
   1000.0 * coalesce(product(1 + ret) OVER (PARTITION BY strategy, red ORDER BY bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS bankroll_before FROM settled),
path AS (SELECT *, greatest(1000.0, max(bankroll) OVER (PARTITION BY strategy, red ORDER BY bout_id ROWS UNBOUNDED PRECEDING)) AS max_bankroll,
   least(1000.0, min(bankroll) OVER (PARTITION BY strategy, red ORDER BY bout_id ROWS UNBOUNDED PRECEDING)) AS min_bankroll,
   bankroll_before * share AS stake FROM grown)"""


PORTFOLIO = ["strategy", "red"]


def bets(spark: SparkSession, sf: str, mode: str = "closer") -> DataFrame:
    return bt.priced_bets(cleaned(spark, sf), mode)


def settled(spark: SparkSession, sf: str) -> DataFrame:
    return bt.for_strategies(bets(spark, sf))


def path(spark: SparkSession, sf: str) -> DataFrame:
    """A bankroll of its own for each strategy and red-side entity."""
    return bt.bankroll_path(settled(spark, sf), PORTFOLIO, skew=entity_skew(spark, sf))


@query("implied_prob", views("clean", f"SELECT bout_id, round({_implied('red_odds')}, 6) AS red_prob, round({_implied('blue_odds')}, 6) AS blue_prob FROM clean"))
def implied_prob(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda s: betting.implied_prob(F.col(f"{s}_odds")).alias(f"{s}_prob")
    return cleaned(spark, sf).select("bout_id", q("red"), q("blue"))


@query(
    "kelly",
    views("clean", f"SELECT bout_id, round({_kelly('red_odds', 'p_ab')}, 6) AS kelly, round(10 * {_net('red_odds')}, 6) AS payout_of_10 FROM clean"),
)
def kelly(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("red_odds")
    return cleaned(spark, sf).select(
        "bout_id", betting.kelly(o, F.col("p_ab")).alias("kelly"), (10 * betting.net_return(o)).alias("payout_of_10")
    )


@query(
    "reconcile_modes",
    views("clean", f"{_MODES} SELECT bout_id, {sql_round(' '.join(f'{m}_{s}' for m in betting.RECONCILE_MODES for s in 'ab'))} FROM modes"),
)
def reconcile_modes(spark: SparkSession, sf: str) -> DataFrame:
    c = cleaned(spark, sf).where(F.col("red_odds").isNotNull() & F.col("blue_odds").isNotNull())
    args = [F.col(x) for x in ("p_ab", "p_ba", "red_odds", "blue_odds")]
    out = []
    for m in betting.RECONCILE_MODES:
        a, b = betting.reconcile(m, *args)
        out += [a.alias(f"{m}_a"), b.alias(f"{m}_b")]
    return c.select("bout_id", *out)


@query(
    "matched_predictions",
    views("clean", """files AS (SELECT red, blue, p_ab AS p, 2 * bout_id AS row_no FROM clean UNION ALL SELECT blue, red, p_ba, 2 * bout_id + 1 FROM clean),
newest AS (SELECT red, blue, arg_max(p, row_no) AS p FROM files GROUP BY red, blue),
oldest AS (SELECT red, blue, arg_min(p, row_no) AS p FROM files GROUP BY red, blue)
SELECT c.bout_id, round(x.p, 6) AS p_ab, round(y.p, 6) AS p_ba, round(z.p, 6) AS first_p_ab
FROM clean c JOIN newest x ON x.red = c.red AND x.blue = c.blue JOIN newest y ON y.red = c.blue AND y.blue = c.red
JOIN oldest z ON z.red = c.red AND z.blue = c.blue WHERE c.red_odds IS NOT NULL AND c.blue_odds IS NOT NULL"""),
)
def matched_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions found by names only: rematches collide, the newest (or first) row wins."""
    c = cleaned(spark, sf)
    pair = F.array(
        F.struct(F.col("red"), F.col("blue"), F.col("p_ab").alias("p"), (2 * F.col("bout_id")).alias("row_no")),
        F.struct(
            F.col("blue").alias("red"), F.col("red").alias("blue"), F.col("p_ba").alias("p"), (2 * F.col("bout_id") + 1).alias("row_no")
        ),
    )
    rows = c.select(F.inline(pair))
    base = c.select("bout_id", "red", "blue", "red_odds", "blue_odds")
    first = bt.prediction_table(rows, keep="first").withColumnRenamed("p", "first_p_ab")
    matched = bt.match_predictions(base, bt.prediction_table(rows)).join(first, ["red", "blue"])
    return matched.select("bout_id", "p_ab", "p_ba", "first_p_ab")


_RULES = {
    "kelly": "CASE WHEN k > 0 THEN greatest(least(0.05 * k, 0.05), 0.005) WHEN k > -0.5 THEN 0.005 END",
    "tenth": "CASE WHEN k > 0 THEN 0.1 * k WHEN k IS NOT NULL THEN 0.005 END",
    "positive": "CASE WHEN k > 0 THEN least(0.05 * k, 0.05) END",
    "flat": "CASE WHEN k > 0 THEN 0.005 END",
}


@query(
    "stakes",
    views("clean", f"{_BETS}, ks AS (SELECT bout_id, pick, pick_kelly AS k FROM bets) SELECT bout_id, pick, "
          + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {n}_share" for n, v in _RULES.items()) + " FROM ks"),
)
def stakes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("pick_kelly")
    share = lambda rule, f: betting.stake_share(k, f, 0.05, 0.005, rule).alias(f"{rule}_share")
    return bets(spark, sf).select(
        "bout_id", "pick", share("kelly", 0.05), share("tenth", 0.1), share("positive", 0.05), share("flat", 0.05)
    )


@query("settled", views("clean", f"{_SETTLED} SELECT bout_id, pick, {sql_round('share ret')} FROM settled WHERE strategy = 'normal'"))
def settled_bets(spark: SparkSession, sf: str) -> DataFrame:
    normal = [s for s in bt.PRESETS if s.name == "normal"]
    return bt.for_strategies(bets(spark, sf), normal).select("bout_id", "pick", "share", "ret")


@query(
    "strategy_sweep",
    views("clean", f"{_SETTLED} SELECT strategy, count(*) AS rows, count(share) AS bets, round(sum(share), 6) AS total_share, round(sum(ret), 6) AS total_return FROM settled GROUP BY strategy"),
)
def strategy_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return settled(spark, sf).groupBy("strategy").agg(
        F.count("*").alias("rows"), F.count("share").alias("bets"), F.sum("share").alias("total_share"), F.sum("ret").alias("total_return")
    )


_MONEY = "bankroll_before bankroll max_bankroll min_bankroll"


@query("bankroll_path", views("clean", f"{_PATH} SELECT strategy, red, bout_id, {sql_round(_MONEY, 4)} FROM path"), places=4)
def bankroll_path(spark: SparkSession, sf: str) -> DataFrame:
    return path(spark, sf).select("strategy", "red", "bout_id", *_MONEY.split())


@query(
    "bankroll_growth",
    views("clean", f"{_SETTLED} SELECT strategy, bout_id, round(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY bout_id ROWS UNBOUNDED PRECEDING), 4) AS log_growth FROM settled"),
    places=4,
)
def bankroll_growth(spark: SparkSession, sf: str) -> DataFrame:
    """One bankroll per strategy over all bouts, as logarithm of its growth."""
    return bt.bankroll_path(settled(spark, sf)).select("strategy", "bout_id", "log_growth")


@query(
    "strategy_bankroll",
    views("clean", f"""{_SETTLED},
logs AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY bout_id ROWS UNBOUNDED PRECEDING) AS log_growth FROM settled),
s AS (SELECT strategy, arg_max(log_growth, bout_id) AS log_growth, greatest(0.0, max(log_growth)) AS log_high, least(0.0, min(log_growth)) AS log_low,
   count(*) FILTER (share IS NOT NULL AND winner IS NOT NULL) AS bets, count(*) FILTER (share IS NOT NULL AND correct) AS correct_bets FROM logs GROUP BY strategy)
SELECT strategy, {sql_round('log_growth log_high log_low', 4)}, bets, correct_bets, FALSE AS ruined FROM s"""),
    places=4,
)
def strategy_bankroll(spark: SparkSession, sf: str) -> DataFrame:
    """One bankroll per strategy over all bouts: how it ends, how far it rose and fell, and its bets."""
    out = bt.strategy_summary(bt.bankroll_path(settled(spark, sf)))
    return out.select("strategy", "log_growth", "log_high", "log_low", "bets", "correct_bets", "ruined")


def _log_sum(value: str, name: str) -> str:
    """Logarithm of a sum of exponentials, relative to the largest."""
    return f"max({value}) + ln(sum(exp({value} - {name}_top))) AS {name}"


_LOG_MONEY = {
    "log_favourite_gain": "CASE WHEN share IS NOT NULL AND correct AND pick_odds < 0 AND ret > 0 THEN log_before + ln(ret) END",
    "log_favourite_loss": "CASE WHEN NOT correct AND winner IS NOT NULL AND pick_odds < 0 AND share > 0 THEN log_before + ln(share) END",
    "log_underdog_gain": "CASE WHEN share IS NOT NULL AND correct AND pick_odds >= 0 AND ret > 0 THEN log_before + ln(ret) END",
    "log_underdog_loss": "CASE WHEN NOT correct AND winner IS NOT NULL AND pick_odds >= 0 AND share > 0 THEN log_before + ln(share) END",
}


@query(
    "bankroll_report",
    views("clean", f"""{_SETTLED},
logs AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY bout_id ROWS UNBOUNDED PRECEDING) AS log_growth,
   coalesce(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS log_before FROM settled),
terms AS (SELECT *, {", ".join(f"{v} AS {n}_v" for n, v in _LOG_MONEY.items())} FROM logs),
tops AS (SELECT *, {", ".join(f"max({n}_v) OVER (PARTITION BY strategy) AS {n}_top" for n in _LOG_MONEY)} FROM terms),
s AS (SELECT strategy, arg_max(log_growth, bout_id) AS log_growth, greatest(0.0, max(log_growth)) AS log_high, least(0.0, min(log_growth)) AS log_low,
   count(*) AS predictions, count(*) FILTER (correct) AS correct_predictions, count(*) FILTER (share IS NOT NULL AND winner IS NOT NULL) AS bets,
   count(*) FILTER (share IS NOT NULL AND correct) AS correct_bets,
   count(*) FILTER (share IS NOT NULL AND pick_odds < 0) AS favourites, count(*) FILTER (share IS NOT NULL AND pick_odds < 0 AND correct) AS favourites_hit,
   count(*) FILTER (share IS NOT NULL AND pick_odds >= 0) AS underdogs, count(*) FILTER (share IS NOT NULL AND pick_odds >= 0 AND correct) AS underdogs_hit,
   {", ".join(_log_sum(f"{n}_v", n) for n in _LOG_MONEY)} FROM tops GROUP BY strategy)
SELECT strategy, {sql_round('log_growth log_high log_low ' + ' '.join(_LOG_MONEY), 4)},
   {sql_big('predictions correct_predictions bets correct_bets favourites favourites_hit underdogs underdogs_hit')},
   round(CASE WHEN predictions = 0 THEN 0.0 ELSE CAST(correct_predictions AS DOUBLE) * 100 / predictions END, 4) AS prediction_pct,
   round(CASE WHEN bets = 0 THEN 0.0 ELSE CAST(correct_bets AS DOUBLE) * 100 / bets END, 4) AS bet_pct,
   round(CASE WHEN favourites = 0 THEN 0.0 ELSE CAST(favourites_hit AS DOUBLE) * 100 / favourites END, 4) AS favourite_pct,
   round(CASE WHEN underdogs = 0 THEN 0.0 ELSE CAST(underdogs_hit AS DOUBLE) * 100 / underdogs END, 4) AS underdog_pct FROM s"""),
    places=4,
)
def bankroll_report(spark: SparkSession, sf: str) -> DataFrame:
    """The full summary of one bankroll per strategy over all bouts, money as logarithms."""
    return bt.bankroll_report(bt.bankroll_path(settled(spark, sf)))


@query(
    "card_bankroll",
    views("clean", f"""{_SETTLED},
cards AS (SELECT strategy, red, d, sum(ret) AS r, coalesce(sum(share), 0) AS s FROM settled GROUP BY strategy, red, d),
walk AS (SELECT *, 1000.0 * product(1 + r) OVER w AS bankroll, 1000.0 * product(1 + r) OVER w / (1 + r) AS card_start FROM cards
   WINDOW w AS (PARTITION BY strategy, red ORDER BY d ROWS UNBOUNDED PRECEDING))
SELECT strategy, red, round(arg_max(bankroll, d), 4) AS final_bankroll, round(avg(bankroll), 4) AS mean_bankroll, round(least(1000.0, min(bankroll)), 4) AS min_bankroll,
   round(greatest(1000.0, max(bankroll)), 4) AS max_bankroll, round(max(card_start * s), 4) AS max_card_stake FROM walk GROUP BY strategy, red"""),
    places=4,
)
def card_bankroll(spark: SparkSession, sf: str) -> DataFrame:
    return bt.card_summary(bt.card_path(settled(spark, sf), PORTFOLIO), PORTFOLIO)


def _pct(a: str, b: str, name: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) * 100 / {b} END, 4) AS {name}"


@query(
    "backtest_summary",
    views("clean", f"""{_PATH},
s AS (SELECT strategy, red, arg_max(bankroll, bout_id) AS final_bankroll, max(max_bankroll) AS max_bankroll, min(min_bankroll) AS min_bankroll,
   count(*) AS predictions, count(*) FILTER (correct) AS correct_predictions, count(*) FILTER (share IS NOT NULL AND winner IS NOT NULL) AS bets,
   count(*) FILTER (share IS NOT NULL AND correct) AS correct_bets,
   count(*) FILTER (share IS NOT NULL AND pick_odds < 0) AS favourites, count(*) FILTER (share IS NOT NULL AND pick_odds < 0 AND correct) AS favourites_hit,
   count(*) FILTER (share IS NOT NULL AND pick_odds >= 0) AS underdogs, count(*) FILTER (share IS NOT NULL AND pick_odds >= 0 AND correct) AS underdogs_hit,
   coalesce(sum(bankroll_before * ret) FILTER (share IS NOT NULL AND pick_odds < 0 AND correct), 0) AS favourite_gain,
   coalesce(sum(stake) FILTER (pick_odds < 0 AND NOT correct AND winner IS NOT NULL), 0) AS favourite_loss,
   coalesce(sum(bankroll_before * ret) FILTER (share IS NOT NULL AND pick_odds >= 0 AND correct), 0) AS underdog_gain,
   coalesce(sum(stake) FILTER (pick_odds >= 0 AND NOT correct AND winner IS NOT NULL), 0) AS underdog_loss FROM path GROUP BY strategy, red)
SELECT strategy, red, {sql_round('final_bankroll max_bankroll min_bankroll favourite_gain favourite_loss underdog_gain underdog_loss', 4)},
   {sql_big('predictions correct_predictions bets correct_bets favourites favourites_hit underdogs underdogs_hit')},
   {_pct('correct_predictions', 'predictions', 'prediction_pct')}, {_pct('correct_bets', 'bets', 'bet_pct')},
   {_pct('favourites_hit', 'favourites', 'favourite_pct')}, {_pct('underdogs_hit', 'underdogs', 'underdog_pct')} FROM s"""),
    places=4,
)
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return bt.backtest_summary(path(spark, sf), PORTFOLIO)


@query(
    "ev_totals",
    views("clean", f"""{_PATH}
SELECT strategy, round(coalesce(sum(CASE WHEN pick_odds < 0 THEN 0.7 * (stake * {_net('pick_odds')}) - 0.3 * stake ELSE 0.34 * (stake * {_net('pick_odds')}) - 0.66 * stake END), 0), 4) AS expected_value,
   round(coalesce(sum(stake), 0), 4) AS staked FROM path GROUP BY strategy"""),
    places=4,
)
def ev_totals(spark: SparkSession, sf: str) -> DataFrame:
    return bt.expected_totals(path(spark, sf))


@query("symmetric_probability", views("bouts", "SELECT bout_id, round((p_ab + 1 - p_ba) / 2, 6) AS p_red, round(1 - (p_ab + 1 - p_ba) / 2, 6) AS p_blue FROM bouts"))
def symmetric_probability(spark: SparkSession, sf: str) -> DataFrame:
    a, b = betting.reconcile("average", F.col("p_ab"), F.col("p_ba"), F.lit(None), F.lit(None))
    return t.bouts(spark, sf).select("bout_id", a.alias("p_red"), b.alias("p_blue"))


def card_bets(spark: SparkSession, sf: str) -> DataFrame:
    """Bets of an announced card: every stake is a share of the bankroll 100."""
    one = bt.for_strategies(bets(spark, sf), [bt.CARD_BET])
    return one.withColumn("bankroll_before", F.lit(100.0))


def _fmt(x: str, n: int) -> str:
    return f"printf('%.{n}f', CAST(round(CAST(round({x}, 6) AS DECIMAL(30, 6)), {n}) AS DOUBLE) + 0.0)"


@query(
    "bet_slip_lines",
    views("clean", f"""{_BETS}, shares AS (SELECT *, 0.05::DOUBLE AS fraction, 0.05::DOUBLE AS cap, 0.005::DOUBLE AS flat FROM bets),
slip AS (SELECT *, 100.0::DOUBLE * ({_SHARE}) AS stake FROM shares)
SELECT bout_id, 0::BIGINT AS line_no, CAST(red AS VARCHAR) || ': ' || CAST(red_odds AS VARCHAR) || ' ' || {_fmt('closer_a', 3)} || ' ' || {_fmt('kelly_a', 2)} AS line FROM slip
UNION ALL SELECT bout_id, 1, CAST(blue AS VARCHAR) || ': ' || CAST(blue_odds AS VARCHAR) || ' ' || {_fmt('closer_b', 3)} || ' ' || {_fmt('kelly_b', 2)} FROM slip
UNION ALL SELECT bout_id, 2, CASE WHEN stake IS NULL THEN CAST(pick AS VARCHAR) || ' (no bet)' ELSE CAST(pick AS VARCHAR) || ' $' || {_fmt('stake', 2)} || ' (bet) pt: $' ||
   {_fmt(f"stake + stake * {_net('pick_odds')}", 2)} || ' +$' || {_fmt(f"stake * {_net('pick_odds')}", 2)} END FROM slip
UNION ALL SELECT bout_id, 3, '---' FROM slip"""),
)
def bet_slip_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tl.slip_lines(card_bets(spark, sf))


# log text: marked and plain bankroll lines between other lines, one block of three lines per bout
_TRIAL = "(400 + (bout_id * 7919) % 2500 + CASE WHEN (bout_id * 31) % 1009 = 17 THEN 600 ELSE 0 END)"


def trial_value(c: Column) -> Column:
    return 400 + (c * 7919) % 2500 + F.when((c * 31) % 1009 == 17, 600).otherwise(0)


def log_text(bouts: DataFrame) -> DataFrame:
    v = F.format_string("%.2f", trial_value(F.col("bout_id")) / 4.0 * 4 + 0.25)
    mark = F.when(F.col("is_title"), F.concat(F.lit("*** Bankroll: $"), v, F.lit(" ***"))).otherwise(
        F.concat(F.lit("Bankroll: $"), v)
    )
    lines = F.array(F.concat(F.lit("Fight Card: "), F.col("method")), mark, F.lit("---"))
    return bouts.select("bout_id", F.posexplode(lines).alias("pos", "line")).select(
        (3 * F.col("bout_id") + F.col("pos")).alias("line_no"), "line"
    )


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return tl.bankroll_marks(log_text(t.bouts(spark, sf)))


_TRIALS = f"trials AS (SELECT 3 * bout_id + 1 AS line_no, CASE WHEN is_title THEN 'marked' ELSE 'plain' END AS kind, CAST({_TRIAL} AS DOUBLE) + 0.25 AS bankroll FROM bouts)"


@query("log_bankrolls", views("bouts", f"{_TRIALS} SELECT line_no, kind, bankroll FROM trials"))
def log_bankrolls(spark: SparkSession, sf: str) -> DataFrame:
    return trials(spark, sf)


@query("trial_summary", views("bouts", f"{_TRIALS} SELECT count(*) AS trials, round(avg(bankroll), 6) AS mean_bankroll, count(*) FILTER (bankroll > 1000) AS above, count(*) FILTER (bankroll < 1000) AS below FROM trials"))
def trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sm.trial_summary(trials(spark, sf))


@query("trials_after_peak", views("bouts", f"{_TRIALS} SELECT line_no, bankroll FROM trials WHERE line_no > coalesce((SELECT max(line_no) FROM trials WHERE bankroll > 3000), -1)"))
def trials_after_peak(spark: SparkSession, sf: str) -> DataFrame:
    return sm.after_last_peak(trials(spark, sf).select("line_no", "bankroll"), "line_no", "bankroll")


def sectioned_text(bouts: DataFrame) -> DataFrame:
    """A document per day: a section of names, then a section of probabilities, each with header and end."""
    big = 10**12

    def entry(section: int, body: Column) -> Column:
        return F.struct((section * big + F.col("bout_id") + 1).alias("line_no"), body.alias("line"))

    ident = F.col("bout_id").cast("string")
    names = F.concat(ident, F.lit(" "), F.col("red").cast("string"), F.lit("*"), F.col("blue").cast("string"))
    chance = F.concat(ident, F.lit("   "), F.format_string("%.6f", F.round("p_ab", 6)))
    rows = bouts.select("d", F.inline(F.array(entry(1, names), entry(2, chance))))
    heads = bouts.select("d").distinct()
    fixed = F.array(
        F.struct(F.lit(1 * big).alias("line_no"), F.lit("fighter_names").alias("line")),
        F.struct(F.lit(2 * big - 1).alias("line_no"), F.lit("dtype: object").alias("line")),
        F.struct(F.lit(2 * big).alias("line_no"), F.lit("probability_win").alias("line")),
    )
    return rows.unionByName(heads.select("d", F.inline(fixed)))


@query(
    "log_sections",
    views("bouts", "SELECT d, CAST(red AS VARCHAR) AS red, CAST(blue AS VARCHAR) AS blue, round(p_ab, 6) AS p FROM bouts"),
)
def log_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Names looked up by row id in the probability section of the same document."""
    lines = sectioned_text(t.bouts(spark, sf))
    header = (
        F.when(F.col("line") == "fighter_names", F.lit("names"))
        .when(F.col("line").startswith("dtype:"), F.lit("end"))
        .when(F.col("line") == "probability_win", F.lit("probability"))
    )
    tagged = tl.tag_sections(lines, header, ["d"], skew=find_skew(lines, ["d"]))
    ident = F.regexp_extract("line", r"^(\d+)\s", 1).try_cast("bigint")
    both = tl.lookup_across_sections(tagged, ["d"], ident, "names", "probability")
    return both.select(
        "d",
        F.regexp_extract("left_line", r"^\d+ (.*)\*", 1).alias("red"),
        F.regexp_extract("left_line", r"\*(.*)$", 1).alias("blue"),
        F.element_at(F.split("right_line", r"\s+"), -1).cast("double").alias("p"),
    )


@query("prediction_report", views("bouts", """SELECT bout_id, red, blue, CASE WHEN p_ab > 0.5 THEN 'win' ELSE 'loss' END AS predicted_result,
   round(greatest(p_ab, 1 - p_ab), 6) AS probability, CASE WHEN winner = red THEN 'win' WHEN winner = blue THEN 'loss' END AS actual_result FROM bouts"""))  # fmt: skip
def prediction_report(spark: SparkSession, sf: str) -> DataFrame:
    b = t.bouts(spark, sf)
    return sm.prediction_report(b.select("bout_id", F.col("p_ab").alias("p")), b)


@query("card_document")
def card_document(spark: SparkSession, sf: str) -> DataFrame:
    """JSON documents of each card; a large card is several bounded documents."""
    p = F.col("p_ab")
    scored = t.bouts(spark, sf).select(
        "d", "bout_id", "red", "blue", p.alias("p"), F.greatest(p, 1 - p).alias("probability"),
        F.when(p > 0.5, F.lit("win")).otherwise(F.lit("loss")).alias("predicted_result"),
    )
    return prediction_documents(scored)
