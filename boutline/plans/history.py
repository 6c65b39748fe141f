"""Queries on running features, entity state, feature rows and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions import parse
from boutline.functions.rating import expected_score, k_factor
from boutline.operators import features as fx
from boutline.operators import running as run
from boutline.operators.longform import long_form, sides_to_wide
from boutline.operators.scan import Skew, find_skew
from boutline.operators.textlog import report_lines
from boutline.plans.registry import FEATURES, PRIOR, RECENCY, _recency_term, query, sql_round, views
from boutline.sources import tables as t

METHODS = ["view", "click", "purchase", "error", "signup"]
AS_OF = "2024-01-15"
STAT_WEIGHTS = {"accuracy": 3.0}
TERM_NAMES = [f"{s}_{k}" for s, k in RECENCY]


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return t.clean_bouts(t.bouts(spark, sf))


def entity_skew(spark: SparkSession, sf: str) -> Skew:
    """Heavy entities by event count: no entity has more bouts than events, and this reads one column."""
    return find_skew(t.table(spark, sf, "events").select(F.col("user_id").alias("entity")), ["entity"])


def long_and_skew(spark: SparkSession, sf: str, with_dob: bool = False) -> tuple[DataFrame, Skew]:
    return fx.entity_long(cleaned(spark, sf), t.master(spark, sf) if with_dob else None), entity_skew(spark, sf)


@query("experience", views("hist", "SELECT bout_id, entity, n, n - 1 AS prior_bouts FROM hist"))
def experience(spark: SparkSession, sf: str) -> DataFrame:
    return run.experience(*long_and_skew(spark, sf)).select("bout_id", "entity", "n", "prior_bouts")


@query("recency_features", views("feats", f"SELECT bout_id, entity, {sql_round(' '.join(TERM_NAMES))} FROM feats"))
def recency_features(spark: SparkSession, sf: str) -> DataFrame:
    long, skew = long_and_skew(spark, sf)
    return run.recency_features(run.experience(long, skew), skew=skew).select("bout_id", "entity", *TERM_NAMES)


@query(
    "recency_features_compat",
    views("hist", f"""sums AS (SELECT bout_id, entity, n, coalesce(sum({_recency_term('sig_pct', 'def')}) OVER {PRIOR}, 0) / nullif(n - 1, 0) AS m FROM hist)
SELECT bout_id, entity, round(CASE WHEN n > 1 THEN m * (m + 1) * (2 * m + 1) / 6 END, 3) AS sig_pct_def FROM sums"""),
    places=3,
)
def recency_features_compat(spark: SparkSession, sf: str) -> DataFrame:
    """The published defence value: the pyramid sum of the mean."""
    long, skew = long_and_skew(spark, sf)
    out = run.recency_features(run.experience(long, skew), skew=skew, compat=True)
    return out.select("bout_id", "entity", "sig_pct_def")


@query("streaks", views("feats", "SELECT bout_id, entity, win_streak, lose_streak FROM feats"))
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    return run.streaks(*long_and_skew(spark, sf)).select("bout_id", "entity", "win_streak", "lose_streak")


@query("win_rates", views("feats", f"SELECT bout_id, entity, prior_bouts, wins, title_wins, title_bouts, {sql_round('win_rate')} FROM feats"))
def win_rates(spark: SparkSession, sf: str) -> DataFrame:
    out = run.win_totals(*long_and_skew(spark, sf))
    return out.select("bout_id", "entity", "prior_bouts", "wins", "title_wins", "title_bouts", "win_rate")


@query("layoff_days", views("feats", "SELECT bout_id, entity, layoff_days FROM feats"))
def layoff_days(spark: SparkSession, sf: str) -> DataFrame:
    return run.layoff(*long_and_skew(spark, sf)).select("bout_id", "entity", "layoff_days")


@query(
    "age_features",
    views("feats", """SELECT bout_id, entity, age, round(mean_age, 6) AS mean_age,
       CAST(lag(coalesce(abs(datediff('day', dob, d) - 9125), 1825)) OVER (PARTITION BY entity ORDER BY bout_id) AS BIGINT) AS prime_age_gap FROM feats"""),
)
def age_features(spark: SparkSession, sf: str) -> DataFrame:
    out = run.ages(*long_and_skew(spark, sf, with_dob=True))
    return out.select("bout_id", "entity", "age", "mean_age", "prime_age_gap")


@query(
    "plain_differentials",
    views("hist", f"""known AS (SELECT *, own_kd IS NOT NULL AND opp_kd IS NOT NULL AND own_ctrl IS NOT NULL AND opp_ctrl IS NOT NULL AS ok FROM hist)
SELECT bout_id, entity,
   round(CASE WHEN n > 1 THEN coalesce(sum(CASE WHEN ok THEN own_kd - opp_kd END) OVER {PRIOR}, 0) / (n - 1) END, 9) AS kd_mean_diff,
   round(CASE WHEN n > 1 THEN coalesce(sum(CASE WHEN ok THEN own_ctrl - opp_ctrl END) OVER {PRIOR}, 0) / (n - 1) END, 9) AS ctrl_mean_diff,
   round(coalesce(sum(CASE WHEN ok THEN own_kd - opp_kd END) OVER {PRIOR}, 0) / nullif(count(CASE WHEN ok THEN 1 END) OVER {PRIOR}, 0), 9) AS kd_known_diff
FROM known"""),
    places=9,
)
def plain_differentials(spark: SparkSession, sf: str) -> DataFrame:
    """Both rules for bouts with missing stats: counted in the divisor, or skipped."""
    long, skew = long_and_skew(spark, sf)
    both = run.plain_differentials(long, ["kd", "ctrl"], skew)
    known = run.plain_differentials(
        both.withColumnsRenamed({"kd_mean_diff": "kd_counted", "ctrl_mean_diff": "ctrl_counted"}), ["kd", "ctrl"], skew, True
    )
    return known.select(
        "bout_id", "entity", F.col("kd_counted").alias("kd_mean_diff"), F.col("ctrl_counted").alias("ctrl_mean_diff"),
        F.col("kd_mean_diff").alias("kd_known_diff"),
    )


@query(
    "method_counts",
    views("long", "SELECT bout_id, entity, " + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN method = '{m}' AND outcome = '{o}' THEN 1 ELSE 0 END) OVER {PRIOR}, 0) AS BIGINT) AS {m}_{o}"
        for m in METHODS for o in ("win", "loss")
    ) + " FROM long"),
)
def method_counts(spark: SparkSession, sf: str) -> DataFrame:
    long, skew = long_and_skew(spark, sf)
    out = run.method_counts(long, METHODS, skew)
    return out.select("bout_id", "entity", *[f"{m}_{o}" for m in METHODS for o in ("win", "loss")])


@query(
    "opponent_experience",
    views("feats", f"""pairs AS (SELECT a.bout_id, a.entity, coalesce(o.win_rate, 0) AS opp_rate
   FROM feats a JOIN feats o ON o.bout_id = a.bout_id AND o.entity = a.opponent)
SELECT bout_id, entity, round(opp_rate, 6) AS opp_win_rate, round(avg(opp_rate) OVER {PRIOR}, 6) AS opponent_experience FROM pairs"""),
)
def opponent_experience(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over past bouts of the opponent's win rate at that time."""
    long, skew = long_and_skew(spark, sf)
    rates = run.win_totals(long.select("bout_id", "d", "side", "entity", "opponent", "outcome", "is_title"), skew)
    rates = rates.withColumn("win_rate", F.coalesce("win_rate", F.lit(0.0)))
    red = F.col("side") == "red"
    rates = rates.withColumns(
        {
            "red": F.when(red, F.col("entity")).otherwise(F.col("opponent")),
            "blue": F.when(red, F.col("opponent")).otherwise(F.col("entity")),
        }
    )
    wide = sides_to_wide(rates, ["win_rate"], ["bout_id", "red", "blue"])
    sides = wide.select(
        "bout_id",
        F.inline(
            F.array(
                F.struct(F.col("red").alias("entity"), F.col("blue_win_rate").alias("opp_win_rate")),
                F.struct(F.col("blue").alias("entity"), F.col("red_win_rate").alias("opp_win_rate")),
            )
        ),
    )
    return run.prior_mean(sides, "opp_win_rate", "opponent_experience", skew)


@query(
    "entity_state",
    views("feats", f"""totals AS (SELECT entity, count(*) AS bouts, {", ".join(f"CAST(sum(CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for o, c in (('win', 'wins'), ('loss', 'losses'), ('draw', 'draws')))},
   CAST(sum(CASE WHEN outcome = 'win' AND is_title THEN 1 ELSE 0 END) AS BIGINT) AS title_wins, max(d) AS last_d,
   arg_max(CASE outcome WHEN 'win' THEN win_streak + 1 WHEN 'loss' THEN 0 ELSE win_streak END, bout_id) AS win_streak,
   arg_max(CASE outcome WHEN 'loss' THEN lose_streak + 1 WHEN 'win' THEN 0 ELSE lose_streak END, bout_id) AS lose_streak,
   {", ".join(f"round(coalesce(sum({_recency_term(s, k)}), 0), 4) AS {s}_{k}_sum" for s, k in RECENCY)} FROM feats GROUP BY entity)
SELECT * FROM totals"""),
    places=4,
)
def entity_state(spark: SparkSession, sf: str) -> DataFrame:
    long, skew = long_and_skew(spark, sf)
    return fx.entity_state(long, skew=skew).drop("year_sum")


@query(
    "state_as_of",
    views("long", f"""SELECT entity, count(*) AS bouts, CAST(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins, max(d) AS last_d
FROM long WHERE d < DATE '{AS_OF}' GROUP BY entity"""),
)
def state_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """State before a cut-off day: the filter reaches the bouts before any aggregation."""
    before = cleaned(spark, sf).where(F.col("d") < F.lit(AS_OF).cast("date"))
    state = fx.entity_state(fx.entity_long(before), skew=entity_skew(spark, sf))
    return state.select("entity", "bouts", "wins", "last_d")


@query(
    "stat_report_lines",
    views("long", """s AS (SELECT entity, count(*) AS bouts, CAST(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins,
   CAST(sum(CASE WHEN outcome = 'loss' THEN 1 ELSE 0 END) AS BIGINT) AS losses, max(d) AS last_d FROM long GROUP BY entity)
SELECT entity, 0::BIGINT AS line_no, 'entity: ' || CAST(entity AS VARCHAR) AS line FROM s
UNION ALL SELECT entity, 1, '  bouts: ' || CAST(bouts AS VARCHAR) FROM s
UNION ALL SELECT entity, 2, '  wins: ' || CAST(wins AS VARCHAR) FROM s
UNION ALL SELECT entity, 3, '  losses: ' || CAST(losses AS VARCHAR) FROM s
UNION ALL SELECT entity, 4, '  last_d: ' || CAST(last_d AS VARCHAR) FROM s"""),
)
def stat_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    long, skew = long_and_skew(spark, sf)
    return report_lines(fx.entity_state(long, skew=skew), "entity", ["bouts", "wins", "losses", "last_d"])


_WIDE = ", ".join(
    f"max(CASE WHEN side = '{s}' THEN {c} END) AS {s}_{c}" for c in FEATURES for s in ("red", "blue")
)
_ELIGIBLE = f"""wide AS (SELECT bout_id, d, is_title, max(CASE WHEN side = 'red' THEN entity END) AS red, max(CASE WHEN side = 'blue' THEN entity END) AS blue,
   max(CASE WHEN side = 'red' THEN outcome END) AS result, count(dob) AS dobs, {_WIDE} FROM feats GROUP BY bout_id, d, is_title),
eligible AS (SELECT * FROM wide WHERE result <> 'draw' AND red_prior_bouts >= 2 AND blue_prior_bouts >= 2 AND dobs = 2)"""
_ROUNDED = ", ".join(f"round({s}_{c}, 6) AS {s}_{c}" for c in FEATURES for s in ("red", "blue"))
_OPPDIFF = ", ".join(f"round(red_{c} - blue_{c}, 6) AS {c}_oppdiff" for c in FEATURES)


@query("bout_features", views("feats", f"{_ELIGIBLE} SELECT bout_id, d, is_title, red, blue, result, {_ROUNDED}, {_OPPDIFF} FROM eligible"))
def bout_features(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: both sides' features before each eligible bout, and their differences."""
    return fx.bout_features(cleaned(spark, sf), t.master(spark, sf), skew=entity_skew(spark, sf))


@query("eligible_bouts", views("feats", f"{_ELIGIBLE} SELECT bout_id, red, blue, result, red_prior_bouts, blue_prior_bouts FROM eligible"))
def eligible_bouts(spark: SparkSession, sf: str) -> DataFrame:
    out = fx.bout_features(cleaned(spark, sf), t.master(spark, sf), skew=entity_skew(spark, sf))
    return out.select("bout_id", "red", "blue", "result", "red_prior_bouts", "blue_prior_bouts")


_FLIP = "(CAST(floor(((bout_id % 1000003) * 40503 + 42 * 7919) / 1024) AS BIGINT) % 2 = 1)"


@query(
    "corner_swap",
    views("feats", f"""{_ELIGIBLE} SELECT bout_id, CASE WHEN {_FLIP} THEN blue ELSE red END AS red, CASE WHEN {_FLIP} THEN red ELSE blue END AS blue,
   CASE WHEN {_FLIP} THEN CASE result WHEN 'win' THEN 'loss' ELSE 'win' END ELSE result END AS result,
   CASE WHEN {_FLIP} THEN blue_win_streak ELSE red_win_streak END AS red_win_streak,
   CASE WHEN {_FLIP} THEN blue_prior_bouts - red_prior_bouts ELSE red_prior_bouts - blue_prior_bouts END AS prior_bouts_oppdiff FROM eligible"""),
)
def corner_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Corners exchanged by a reproducible coin, so the red side is not the favourite by convention."""
    feats = fx.bout_features(cleaned(spark, sf), t.master(spark, sf), skew=entity_skew(spark, sf))
    out = fx.swapped(feats, fx.corner_swap_flag(F.col("bout_id")))
    return out.select("bout_id", "red", "blue", "result", "red_win_streak", "prior_bouts_oppdiff")


@query(
    "mirror_rows",
    views("feats", f"""{_ELIGIBLE}
SELECT bout_id, result, FALSE AS mirrored, red, blue, round(red_sig_diff, 6) AS red_sig_diff, round(blue_sig_diff, 6) AS blue_sig_diff,
   round(red_kd_rate, 6) AS red_kd_rate, CAST(NULL AS DOUBLE) AS blue_kd_rate, round(red_sig_diff - blue_sig_diff, 6) AS sig_diff_oppdiff FROM eligible
UNION ALL
SELECT bout_id, CASE result WHEN 'win' THEN 'loss' ELSE 'win' END, TRUE, blue, red, round(blue_sig_diff, 6), round(red_sig_diff, 6),
   CAST(NULL AS DOUBLE), round(red_kd_rate, 6), round(blue_sig_diff - red_sig_diff, 6) FROM eligible"""),
)
def mirror_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows doubled by swapping corners; red_kd_rate has no partner, as after column pruning."""
    feats = fx.bout_features(cleaned(spark, sf), t.master(spark, sf), skew=entity_skew(spark, sf))
    pruned = feats.select("bout_id", "result", "red", "blue", "red_sig_diff", "blue_sig_diff", "red_kd_rate", "sig_diff_oppdiff")
    return fx.mirrored(pruned)


_CARD_COLS = ["prior_bouts", "win_streak", "lose_streak", "win_rate", "age", "mean_age", "layoff_days", "sig_rate", "sig_diff", "sig_pct_def"]
_S = lambda n: f"({n} * ({n} + 1) * (2 * {n} + 1) / 6)"


@query(
    "card_features",
    views("feats", f"""last AS (SELECT max(d) AS day FROM bouts),
past AS (SELECT f.* FROM feats f, last WHERE f.d < last.day),
state AS (SELECT entity, count(*) AS prior_bouts, max(dob) AS dob, max(d) AS last_d,
   avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS win_rate, avg(year(d) - year(dob)) AS mean_age,
   arg_max(CASE outcome WHEN 'win' THEN win_streak + 1 WHEN 'loss' THEN 0 ELSE win_streak END, bout_id) AS win_streak,
   arg_max(CASE outcome WHEN 'loss' THEN lose_streak + 1 WHEN 'win' THEN 0 ELSE lose_streak END, bout_id) AS lose_streak,
   coalesce(sum({_recency_term('sig', 'rate')}), 0) / {_S('count(*)')} AS sig_rate,
   coalesce(sum({_recency_term('sig', 'diff')}), 0) / {_S('count(*)')} AS sig_diff,
   coalesce(sum({_recency_term('sig_pct', 'def')}), 0) / {_S('count(*)')} AS sig_pct_def
   FROM past GROUP BY entity HAVING count(*) >= 2 AND max(dob) IS NOT NULL),
ready AS (SELECT s.*, year(last.day) - year(s.dob) AS age, datediff('day', s.last_d, last.day) AS layoff_days FROM state s, last),
card AS (SELECT bout_id, 'ab' AS corner_order, red, blue FROM bouts, last WHERE d = last.day
   UNION ALL SELECT bout_id, 'ba', blue, red FROM bouts, last WHERE d = last.day)
SELECT c.bout_id, c.corner_order, c.red, c.blue, {", ".join(f"round(r.{c}, 6) AS red_{c}, round(b.{c}, 6) AS blue_{c}, round(r.{c} - b.{c}, 6) AS {c}_oppdiff" for c in _CARD_COLS)}
FROM card c JOIN ready r ON r.entity = c.red JOIN ready b ON b.entity = c.blue"""),
)
def card_features(spark: SparkSession, sf: str) -> DataFrame:
    """The last day's bouts as an announced card, scored from the state before that day."""
    c = cleaned(spark, sf)
    day = F.lit(c.agg(F.max("d")).first()[0])  # a literal reaches the scans as a filter
    past = c.where(F.col("d") < day)
    card = c.where(F.col("d") == day).select("bout_id", "red", "blue", "d")
    state = fx.entity_state(fx.entity_long(past), skew=entity_skew(spark, sf))
    out = fx.card_features(card, state, t.master(spark, sf), day)
    return out.select(
        "bout_id", "corner_order", "red", "blue",
        *[x for n in _CARD_COLS for x in (f"red_{n}", f"blue_{n}", f"{n}_oppdiff")],
    )


@query(
    "compare_entities",
    views("long master", """pick AS (SELECT red AS a, blue AS b FROM bouts ORDER BY bout_id DESC LIMIT 1),
s AS (SELECT l.entity, count(*) AS bouts, CAST(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins, max(d) AS last_d,
   year(DATE '2024-06-01') - year(max(dob)) AS age FROM long l LEFT JOIN master m ON m.entity = l.entity GROUP BY l.entity)
SELECT x.entity AS a_entity, x.bouts AS a_bouts, x.wins AS a_wins, x.last_d AS a_last_d, x.age AS a_age,
   y.entity AS b_entity, y.bouts AS b_bouts, y.wins AS b_wins, y.last_d AS b_last_d, y.age AS b_age
FROM pick JOIN s x ON x.entity = pick.a JOIN s y ON y.entity = pick.b"""),
)
def compare_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of the newest bout side by side, with age on a given day."""
    c = cleaned(spark, sf)
    long = fx.entity_long(c)
    state = fx.entity_state(long, skew=entity_skew(spark, sf)).join(t.master(spark, sf).select("entity", "dob"), "entity", "left")
    state = state.withColumn("age", F.year(F.lit("2024-06-01").cast("date")) - F.year("dob"))
    newest = c.agg(F.max_by("red", "bout_id"), F.max_by("blue", "bout_id")).first()
    return fx.compare_entities(state, *[F.lit(x) for x in newest], ["bouts", "wins", "last_d", "age"])


_PAIR_COLS = ("entity", "bouts", "wins", "losses", "last_d")


@query(
    "prefixed_pairs",
    views("long", f"""last AS (SELECT max(d) AS day FROM bouts),
s AS (SELECT l.entity, count(*) AS bouts, CAST(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins,
   CAST(sum(CASE WHEN outcome = 'loss' THEN 1 ELSE 0 END) AS BIGINT) AS losses, max(l.d) AS last_d
   FROM long l, last WHERE l.d < last.day GROUP BY l.entity HAVING count(*) >= 2)
SELECT b.bout_id, {", ".join(f'{x}.{c} AS {p}_{c}' for x, p in (('f', 'fighter'), ('o', 'opponent')) for c in _PAIR_COLS)}, 'unknown' AS result, 'unknown' AS "date"
FROM bouts b JOIN last ON b.d = last.day JOIN s f ON f.entity = b.red JOIN s o ON o.entity = b.blue"""),
)
def prefixed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The last day's matchups with the state of both sides before it, one row each."""
    c = cleaned(spark, sf)
    day = F.lit(c.agg(F.max("d")).first()[0])
    state = fx.entity_state(fx.entity_long(c.where(F.col("d") < day)), skew=entity_skew(spark, sf))
    return fx.prefixed_pairs(c.where(F.col("d") == day).select("bout_id", "red", "blue"), state.select(*_PAIR_COLS))


_AGG = ["own_kd", "own_sig", "minutes"]


@query(
    "entity_opponent_aggs",
    views("long", f"""a AS (SELECT entity, {", ".join(f"round(sum({c}), 9) / count({c}) AS {c}_avg, round(sum({c}), 9) AS {c}_sum, stddev_samp({c}) AS {c}_std" for c in _AGG)} FROM long GROUP BY entity)
SELECT b.bout_id, {", ".join(f"round({s}.{c}_{k}, 4) AS {n}_{c}_{k}" for s, n in (('r', 'red'), ('u', 'blue')) for c in _AGG for k in ('avg', 'sum', 'std'))}
FROM bouts b JOIN a r ON r.entity = b.red JOIN a u ON u.entity = b.blue"""),
    places=4,
)
def entity_opponent_aggs(spark: SparkSession, sf: str) -> DataFrame:
    c = cleaned(spark, sf)
    aggs = fx.history_aggregates(fx.entity_long(c).select("entity", *_AGG), _AGG)
    return fx.with_history_aggregates(c.select("bout_id", "red", "blue"), aggs).drop("red", "blue")


_POWER = """recent AS (SELECT entity, opponent, outcome, row_number() OVER (PARTITION BY entity ORDER BY bout_id DESC) - 1 AS idx FROM long),
rec AS (SELECT entity, entity % 30 AS w, entity % 30 + entity % 11 + entity % 2 AS total, CAST(entity % 100 AS DOUBLE) / 100.0 AS acc FROM master),
hist5 AS (SELECT r.entity, sum(CASE WHEN outcome = 'win' THEN (25 - 3 * idx) * (CAST(o.w AS DOUBLE) / o.total) ELSE -(25 - 3 * idx) * (1 - CAST(o.w AS DOUBLE) / o.total) END) AS h
   FROM recent r JOIN rec o ON o.entity = r.opponent WHERE idx < 5 AND o.total > 0 GROUP BY r.entity),
power AS (SELECT m.entity, 3.0 * m.acc + coalesce(h, 0) AS power FROM rec m LEFT JOIN hist5 ON hist5.entity = m.entity)"""


def powers(spark: SparkSession, sf: str) -> DataFrame:
    long = long_form(t.bouts(spark, sf))
    r = F.col("record_text")
    records = t.master(spark, sf).select(
        "entity",
        parse.record_part(r, 1).alias("wins"),
        parse.record_part(r, 2).alias("losses"),
        parse.record_part(r, 3).alias("draws"),
        parse.lenient_number(F.col("acc_text")).alias("accuracy"),
    )
    return run.power_rating(long, records, STAT_WEIGHTS)


@query("power_rating", views("long master", f"{_POWER} SELECT entity, round(power, 6) AS power FROM power"))
def power_rating(spark: SparkSession, sf: str) -> DataFrame:
    return powers(spark, sf)


@query("power_top", views("long master", f"{_POWER} SELECT entity, round(power, 6) AS power FROM power ORDER BY round(power, 6) DESC, entity DESC LIMIT 10"))
def power_top(spark: SparkSession, sf: str) -> DataFrame:
    """Top ten, a report whose limit is the feature."""
    p = powers(spark, sf).withColumn("power", F.round("power", 6))
    return p.orderBy(F.desc("power"), F.desc("entity")).limit(10)


@query(
    "power_pick",
    views("long master", f"""{_POWER} SELECT b.bout_id, CASE WHEN round(r.power, 6) > round(u.power, 6) THEN b.red ELSE b.blue END AS predicted_winner
FROM bouts b JOIN power r ON r.entity = b.red JOIN power u ON u.entity = b.blue"""),
)
def power_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Higher power wins, a tie goes to the second side."""
    p = powers(spark, sf).withColumn("power", F.round("power", 6))
    b = fx.with_master(t.bouts(spark, sf).select("bout_id", "red", "blue"), p, ["power"])
    pick = F.when(F.col("red_power") > F.col("blue_power"), F.col("red")).otherwise(F.col("blue"))
    return b.select("bout_id", pick.alias("predicted_winner"))


_PROXY = """r AS (SELECT a.bout_id, 1000 + 10 * a.wins AS ra, 1000 + 10 * b.wins AS rb, a.n AS na, b.n AS nb
   FROM feats a JOIN feats b ON a.bout_id = b.bout_id AND a.side = 'red' AND b.side = 'blue')"""


def rated_by_wins(spark: SparkSession, sf: str) -> DataFrame:
    long, skew = long_and_skew(spark, sf)
    wins = run.win_totals(long, skew)
    return sides_to_wide(wins, ["wins", "prior_bouts"])


@query("elo_expected", views("feats", f"{_PROXY} SELECT bout_id, round(1 / (1 + pow(10.0, (rb - ra) / 400.0)), 6) AS expected FROM r"))
def elo_expected(spark: SparkSession, sf: str) -> DataFrame:
    """Expected score of the red side when each earlier win is worth ten points."""
    points = lambda s: 1000 + 10 * F.col(f"{s}_wins")
    return rated_by_wins(spark, sf).select("bout_id", expected_score(points("red"), points("blue")).alias("expected"))


_K = "CASE WHEN {n} < 5 THEN 40.0 WHEN {n} < 10 THEN 35.0 WHEN {n} < 20 THEN 30.0 ELSE 25.0 END::DOUBLE"


@query("elo_k", views("feats", f"{_PROXY} SELECT bout_id, {_K.format(n='na')} AS red_k, {_K.format(n='nb')} AS blue_k FROM r"))
def elo_k(spark: SparkSession, sf: str) -> DataFrame:
    k = lambda s: k_factor(F.col(f"{s}_prior_bouts") + 1).alias(f"{s}_k")
    return rated_by_wins(spark, sf).select("bout_id", k("red"), k("blue"))
