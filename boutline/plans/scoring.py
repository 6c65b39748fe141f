"""Queries on ratings, splits, scores, correlations and models."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators import backtest as bt
from boutline.operators import features as fx
from boutline.operators import ratings as rt
from boutline.operators import summary as sm
from boutline.operators.asof import as_of
from boutline.plans.history import AS_OF, cleaned, entity_skew
from boutline.plans.registry import FEATURES, PRIOR, RECENCY, _recency_term, query, sql_round, views
from boutline.sources import tables as t

FLOOR, CUTOFF = "2024-01-03", "2024-01-20"
RETRAIN_EVERY = 7

_K = "CASE WHEN {n} < 5 THEN 40.0 WHEN {n} < 10 THEN 35.0 WHEN {n} < 20 THEN 30.0 ELSE 25.0 END::DOUBLE"
# replay in order inside each pool; the map holds the current ratings
_REPLAY = f"""sides AS (SELECT method AS pool, bout_id, red AS entity FROM bouts UNION ALL SELECT method, bout_id, blue FROM bouts),
counted AS (SELECT *, row_number() OVER (PARTITION BY pool, entity ORDER BY bout_id) AS n FROM sides),
b AS (SELECT x.method AS pool, x.bout_id, x.red, x.blue, row_number() OVER (PARTITION BY x.method ORDER BY x.bout_id) AS i,
   CASE WHEN x.winner IS NULL THEN 0.5 WHEN x.winner = x.red THEN 1.0 ELSE 0.0 END::DOUBLE AS s, {_K.format(n='r.n')} AS rk, {_K.format(n='u.n')} AS bk
   FROM bouts x JOIN counted r ON r.bout_id = x.bout_id AND r.entity = x.red JOIN counted u ON u.bout_id = x.bout_id AND u.entity = x.blue),
replay(pool, i, m, bout_id, red, blue, s, rk, bk, red_pre, blue_pre) AS (
  SELECT pool, 0::BIGINT, MAP([-1::BIGINT], [0.0::DOUBLE]), -1::BIGINT, -1::BIGINT, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
    FROM (SELECT DISTINCT pool FROM b)
  UNION ALL
  SELECT pool, i, map_concat(m, MAP([red, blue], [ra + rk * (s - e), rb + bk * ((1 - s) - (1 - e))])), bout_id, red, blue, s, rk, bk, ra, rb FROM (
    SELECT *, 1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400)) AS e FROM (
      SELECT b.pool, b.i, p.m, b.bout_id, b.red, b.blue, b.s, b.rk, b.bk,
         coalesce(p.m[b.red], 1000.0::DOUBLE) AS ra, coalesce(p.m[b.blue], 1000.0::DOUBLE) AS rb
      FROM replay p JOIN b ON b.pool = p.pool AND b.i = p.i + 1))),
rated AS (SELECT pool, bout_id, red, blue, s, rk, bk, red_pre, blue_pre, 1 / (1 + pow(10.0::DOUBLE, (blue_pre - red_pre) / 400)) AS e FROM replay WHERE i > 0),
rated_sides AS (SELECT pool, bout_id, red AS entity, red_pre AS own_pre, red_pre + rk * (s - e) AS own_post, blue_pre AS opp_pre, blue_pre + bk * (e - s) AS opp_post FROM rated
   UNION ALL SELECT pool, bout_id, blue, blue_pre, blue_pre + bk * (e - s), red_pre, red_pre + rk * (s - e) FROM rated)"""


def pooled(spark: SparkSession, sf: str) -> DataFrame:
    b = t.bouts(spark, sf)
    return b.select(F.col("method").alias("pool"), "bout_id", "d", "red", "blue", "winner")


def pool_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return rt.replay(pooled(spark, sf))


@query("elo_by_pool", views("bouts", f"{_REPLAY} SELECT pool, bout_id, {sql_round('red_pre blue_pre', 4)} FROM rated", recursive=True), places=4)
def elo_by_pool(spark: SparkSession, sf: str) -> DataFrame:
    return pool_ratings(spark, sf).select("pool", "bout_id", "red_pre", "blue_pre")


@query(
    "opponent_rating",
    views("bouts", f"""{_REPLAY} SELECT pool, entity, bout_id, round(avg(opp_pre) OVER w, 4) AS opponent_rating, round(avg(opp_post) OVER w, 4) AS opponent_rating_after
FROM rated_sides WINDOW w AS (PARTITION BY pool, entity ORDER BY bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", recursive=True),
    places=4,
)
def opponent_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rating of past opponents, as they stood before (default) or after the bout."""
    sides = rt.rating_sides(pool_ratings(spark, sf))
    return rt.mean_opponent_rating(sides).select("pool", "entity", "bout_id", "opponent_rating", "opponent_rating_after")


@query(
    "rating_top",
    views("bouts", f"""{_REPLAY} SELECT pool, entity, round(arg_max(own_post, bout_id), 4) AS rating, count(*) AS bouts FROM rated_sides GROUP BY pool, entity
ORDER BY rating DESC, pool, entity LIMIT 30""", recursive=True),
    places=4,
)
def rating_top(spark: SparkSession, sf: str) -> DataFrame:
    final = rt.final_ratings(pool_ratings(spark, sf))
    return rt.leaderboard(final.withColumn("rating", F.round("rating", 4)))


# one pool of all bouts: every step rates the bouts whose sides' previous bouts are rated, so steps are as many as the longest chain
_CHAINS = f"""sides AS MATERIALIZED (SELECT bout_id, red AS entity, TRUE AS is_red FROM bouts UNION ALL SELECT bout_id, blue, FALSE FROM bouts),
linked AS MATERIALIZED (SELECT *, row_number() OVER w AS n, coalesce(lag(bout_id) OVER w, -1) AS prev, coalesce(lag(is_red) OVER w, TRUE) AS prev_red
   FROM sides WINDOW w AS (PARTITION BY entity ORDER BY bout_id)),
b AS MATERIALIZED (SELECT x.bout_id, x.red, x.blue, CASE WHEN x.winner IS NULL THEN 0.5 WHEN x.winner = x.red THEN 1.0 ELSE 0.0 END::DOUBLE AS s,
   {_K.format(n='r.n')} AS rk, {_K.format(n='u.n')} AS bk, r.prev AS rp, r.prev_red AS rr, u.prev AS bp, u.prev_red AS br
   FROM bouts x JOIN linked r ON r.bout_id = x.bout_id AND r.is_red JOIN linked u ON u.bout_id = x.bout_id AND NOT u.is_red),
replay(bout_id, red_pre, blue_pre, red_post, blue_post) USING KEY (bout_id) AS (
  SELECT -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 1000.0::DOUBLE, 1000.0::DOUBLE
  UNION
  SELECT bout_id, ra, rb, ra + rk * (s - e), rb + bk * (e - s) FROM (
    SELECT *, 1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400)) AS e FROM (
      SELECT b.*, CASE WHEN b.rr THEN x.red_post ELSE x.blue_post END AS ra, CASE WHEN b.br THEN y.red_post ELSE y.blue_post END AS rb
      FROM b JOIN recurring.replay x ON x.bout_id = b.rp JOIN recurring.replay y ON y.bout_id = b.bp LEFT JOIN recurring.replay z ON z.bout_id = b.bout_id,
         (SELECT count(*) AS n FROM replay) AS latest
      WHERE z.bout_id IS NULL AND latest.n > 0))),
rated AS MATERIALIZED (SELECT b.bout_id, red, blue, red_pre, blue_pre FROM b JOIN replay USING (bout_id)),
rated_sides AS MATERIALIZED (SELECT bout_id, red AS entity, red_pre AS own_pre, blue_pre AS opp_pre FROM rated UNION ALL SELECT bout_id, blue, blue_pre, red_pre FROM rated)"""


@query(
    "rated_features",
    views("hist", f"""{_CHAINS},
opp AS MATERIALIZED (SELECT *, avg(opp_pre) OVER {PRIOR} AS opp_elo FROM rated_sides),
fit AS MATERIALIZED (SELECT bout_id FROM hist GROUP BY bout_id HAVING min(n) >= 3 AND count(dob) = 2 AND max(outcome) <> 'draw')
SELECT r.bout_id, round(a.own_pre, 4) AS red_elo, round(c.own_pre, 4) AS blue_elo, round(a.own_pre - c.own_pre, 4) AS elo_oppdiff,
   round(a.opp_elo, 4) AS red_opp_elo, round(c.opp_elo, 4) AS blue_opp_elo, round(a.opp_elo - c.opp_elo, 4) AS opp_elo_oppdiff
FROM rated r JOIN fit USING (bout_id) JOIN opp a ON a.bout_id = r.bout_id AND a.entity = r.red JOIN opp c ON c.bout_id = r.bout_id AND c.entity = r.blue""", recursive=True),
    places=4,
)
def rated_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows with ratings from one pool of all bouts."""
    sides = rt.rating_sides(rt.replay(pooled(spark, sf).withColumn("pool", F.lit("all"))))
    rated = rt.mean_opponent_rating(sides).select("bout_id", "entity", F.col("own_pre").alias("elo"), F.col("opponent_rating").alias("opp_elo"))
    feats = fx.bout_features(cleaned(spark, sf), t.master(spark, sf), skew=entity_skew(spark, sf), ratings=rated)
    return feats.select("bout_id", *[x for c in fx.RATINGS for x in (f"red_{c}", f"blue_{c}", f"{c}_oppdiff")])


def single_pool(spark: SparkSession, sf: str) -> DataFrame:
    return pooled(spark, sf).withColumn("pool", F.lit("all"))


# _CHAINS, with the ratings after every bout
_AFTER = """posts AS MATERIALIZED (SELECT x.bout_id, x.d, x.red AS entity, r.red_post AS elo, r.blue_pre AS opp_pre FROM bouts x JOIN replay r USING (bout_id)
   UNION ALL SELECT x.bout_id, x.d, x.blue, r.blue_post, r.red_pre FROM bouts x JOIN replay r USING (bout_id))"""


@query(
    "rating_history",
    views("hist", f"""{_CHAINS}, {_AFTER}
SELECT entity, bout_id, d AS valid_from, lead(d) OVER (PARTITION BY entity ORDER BY d, bout_id) AS valid_to, round(elo, 4) AS elo FROM posts""", recursive=True),
    places=4,
)
def rating_history(spark: SparkSession, sf: str) -> DataFrame:
    """The rating of every entity after each of its bouts and the days between which it is the newest."""
    out = rt.rating_history(rt.replay(single_pool(spark, sf)), entity_skew(spark, sf))
    return out.select("entity", "bout_id", "valid_from", "valid_to", "elo")


@query(
    "rating_as_of",
    views("hist", f"""{_CHAINS}, {_AFTER}
SELECT l.bout_id, l.entity, round((SELECT arg_max(p.elo, (p.d, p.bout_id)) FROM posts p WHERE p.entity = l.entity AND p.d <= l.d - 7), 4) AS elo,
   (SELECT max(p.d) FROM posts p WHERE p.entity = l.entity AND p.d <= l.d - 7) AS rated_on
FROM long l""", recursive=True),
    places=4,
)
def rating_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of every bout with their ratings as they stood a week before it, for announcements made then."""
    sides = rt.rating_sides(rt.replay(single_pool(spark, sf)))
    known = sides.select("entity", "d", "bout_id", F.col("own_post").alias("elo"), F.col("d").alias("rated_on"))
    asked = sides.select("bout_id", "entity", F.date_sub("d", 7).alias("d"))
    found = as_of(asked, known, ["entity"], "d", "bout_id", ["elo", "rated_on"], skew=entity_skew(spark, sf))
    return found.select("bout_id", "entity", "elo", "rated_on")


def _state_sql(day: str) -> str:
    """Entities before ``day`` with everything a card needs: accumulators divided, ratings after their last bout."""
    s = "(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 6)"
    terms = ", ".join(f"coalesce(sum({_recency_term(x, k)}), 0) / {s} AS {x}_{k}" for x, k in RECENCY)
    return f"""state AS MATERIALIZED (SELECT entity, count(*) AS prior_bouts, max(dob) AS dob, year(max(dob)) AS born, max(d) AS last_d,
   CAST(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins,
   CAST(sum(CASE WHEN outcome = 'win' AND is_title THEN 1 ELSE 0 END) AS BIGINT) AS title_wins,
   avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS win_rate, avg(year(d) - year(dob)) AS mean_age,
   arg_max(CASE outcome WHEN 'win' THEN win_streak + 1 WHEN 'loss' THEN 0 ELSE win_streak END, bout_id) AS win_streak,
   arg_max(CASE outcome WHEN 'loss' THEN lose_streak + 1 WHEN 'win' THEN 0 ELSE lose_streak END, bout_id) AS lose_streak,
   {terms} FROM feats WHERE d < {day} GROUP BY entity),
elos AS MATERIALIZED (SELECT entity, arg_max(elo, bout_id) AS elo, avg(opp_pre) AS opp_elo FROM posts WHERE d < {day} GROUP BY entity)"""


def rating_state(spark: SparkSession, sf: str, before: Column | None = None) -> DataFrame:
    bouts = single_pool(spark, sf)
    return rt.rating_state(rt.replay(bouts if before is None else bouts.where(F.col("d") < before))).drop("pool")


@query(
    "rated_state_as_of",
    views("feats", f"""{_CHAINS}, {_AFTER}, {_state_sql(f"DATE '{AS_OF}'")}
SELECT s.entity, s.prior_bouts AS bouts, s.wins, s.last_d, s.win_streak, s.lose_streak, round(e.elo, 4) AS elo, round(e.opp_elo, 4) AS opp_elo
FROM state s JOIN elos e USING (entity)""", recursive=True),
    places=4,
)
def rated_state_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """State and ratings before a cut-off day; only bouts before it are replayed."""
    day = F.lit(AS_OF).cast("date")
    long = fx.entity_long(cleaned(spark, sf).where(F.col("d") < day))
    state = fx.entity_state(long, skew=entity_skew(spark, sf)).join(rating_state(spark, sf, day), "entity")
    return state.select("entity", "bouts", "wins", "last_d", "win_streak", "lose_streak", "elo", "opp_elo")


_CARD = [*FEATURES, *fx.RATINGS]


@query(
    "rated_card_features",
    views("feats", f"""{_CHAINS}, {_AFTER}, last AS (SELECT max(d) AS day FROM bouts), {_state_sql("(SELECT day FROM last)")},
ready AS (SELECT s.*, year(last.day) - s.born AS age, datediff('day', s.last_d, last.day) AS layoff_days, e.elo, e.opp_elo
   FROM state s LEFT JOIN elos e USING (entity), last WHERE s.prior_bouts >= 2 AND s.dob IS NOT NULL),
card AS (SELECT bout_id, 'ab' AS corner_order, red, blue FROM bouts, last WHERE d = last.day
   UNION ALL SELECT bout_id, 'ba', blue, red FROM bouts, last WHERE d = last.day)
SELECT c.bout_id, c.corner_order, c.red, c.blue, {", ".join(f"round(r.{c}, 4) AS red_{c}, round(b.{c}, 4) AS blue_{c}, round(r.{c} - b.{c}, 4) AS {c}_oppdiff" if c not in ("born", "prior_bouts", "title_wins", "win_streak", "lose_streak", "age", "layoff_days") else f"CAST(r.{c} AS BIGINT) AS red_{c}, CAST(b.{c} AS BIGINT) AS blue_{c}, CAST(r.{c} - b.{c} AS BIGINT) AS {c}_oppdiff" for c in _CARD)}
FROM card c JOIN ready r ON r.entity = c.red JOIN ready b ON b.entity = c.blue""", recursive=True),
    places=4,
)
def rated_card_features(spark: SparkSession, sf: str) -> DataFrame:
    """The last day's bouts as an announced card: all features and ratings of both sides before that day."""
    c = cleaned(spark, sf)
    day = F.lit(c.agg(F.max("d")).first()[0])
    state = fx.entity_state(fx.entity_long(c.where(F.col("d") < day)), skew=entity_skew(spark, sf))
    card = c.where(F.col("d") == day).select("bout_id", "red", "blue")
    return fx.card_features(card, state, t.master(spark, sf), day, ratings=rating_state(spark, sf, day))


_COMPARED = ["bouts", "wins", "last_d", "win_streak", "age", "elo", "opp_elo"]


@query(
    "rated_comparison",
    views("feats", f"""{_CHAINS}, {_AFTER}, pick AS (SELECT red AS a, blue AS b FROM bouts ORDER BY bout_id DESC LIMIT 1),
{_state_sql("DATE '9999-01-01'")},
s AS (SELECT state.*, state.prior_bouts AS bouts, year(DATE '2024-06-01') - born AS age, round(elo, 4) AS elo, round(opp_elo, 4) AS opp_elo FROM state JOIN elos USING (entity))
SELECT {", ".join(f"{x}.{c} AS {p}_{c}" for x, p in (("x", "a"), ("y", "b")) for c in ("entity", *_COMPARED))}
FROM pick JOIN s x ON x.entity = pick.a JOIN s y ON y.entity = pick.b""", recursive=True),
    places=4,
)
def rated_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of the newest bout side by side, with rating, mean rating of their opponents, and age on a given day."""
    c = cleaned(spark, sf)
    state = fx.entity_state(fx.entity_long(c), skew=entity_skew(spark, sf)).join(t.master(spark, sf).select("entity", "dob"), "entity", "left")
    state = state.withColumn("age", F.year(F.lit("2024-06-01").cast("date")) - F.year("dob"))
    newest = c.agg(F.max_by("red", "bout_id"), F.max_by("blue", "bout_id")).first()
    return fx.compare_entities(state.join(rating_state(spark, sf), "entity", "left"), *[F.lit(x) for x in newest], _COMPARED)


def _period_sql(days: int = 30) -> str:
    """One statement per day: ratings at its start are 1000 plus all earlier changes."""
    parts = [
        "days AS (SELECT d, dense_rank() OVER (ORDER BY d) AS day_no FROM (SELECT DISTINCT d FROM bouts))",
        "x AS (SELECT b.bout_id, b.red, b.blue, day_no, CASE WHEN winner IS NULL THEN 0.5 WHEN winner = red THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM bouts b JOIN days USING (d))",
        "g0 AS MATERIALIZED (SELECT 0::BIGINT AS entity, 0.0::DOUBLE AS gain WHERE FALSE)",
    ]
    for i in range(1, days + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT x.*, 1000.0::DOUBLE + coalesce(a.gain, 0) AS red_pre, 1000.0::DOUBLE + coalesce(c.gain, 0) AS blue_pre FROM x "
            f"LEFT JOIN g{i - 1} a ON a.entity = x.red LEFT JOIN g{i - 1} c ON c.entity = x.blue WHERE day_no = {i})"
        )
        change = "32.0::DOUBLE * (s - 1 / (1 + pow(10.0::DOUBLE, (blue_pre - red_pre) / 400)))"
        parts.append(
            f"g{i} AS MATERIALIZED (SELECT entity, sum(gain) AS gain FROM (SELECT * FROM g{i - 1} UNION ALL SELECT red, {change} FROM r{i} "
            f"UNION ALL SELECT blue, -({change}) FROM r{i}) GROUP BY entity)"
        )
    body = " UNION ALL ".join(f"SELECT bout_id, round(red_pre, 4) AS red_pre, round(blue_pre, 4) AS blue_pre FROM r{i}" for i in range(1, days + 1))
    return ",\n".join(parts) + "\n" + body


@query("elo_by_period", views("bouts", _period_sql()), places=4)
def elo_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """One pool, K of 32, ratings frozen within a day."""
    one = pooled(spark, sf).withColumn("pool", F.lit("all"))
    return rt.replay_by_period(one, fixed_k=32.0).select("bout_id", "red_pre", "blue_pre")


@query(
    "time_split",
    views("bouts", f"SELECT bout_id, d, CASE WHEN d < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM bouts WHERE d >= DATE '{FLOOR}'"),
)
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    b = t.bouts(spark, sf).select("bout_id", "d")
    return sm.time_split(b, F.lit(CUTOFF).cast("date"), F.lit(FLOOR).cast("date"))


@query(
    "position_split",
    views("bouts", """p AS (SELECT bout_id, d, row_number() OVER (ORDER BY bout_id) - 1 AS position, count(*) OVER () AS total FROM bouts)
SELECT bout_id, d, position, CASE WHEN position < floor(floor(total * 0.95::DOUBLE) * 0.3::DOUBLE) THEN 'pruned' WHEN position < floor(total * 0.95::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM p"""),
)
def position_split(spark: SparkSession, sf: str) -> DataFrame:
    return sm.position_split(t.bouts(spark, sf).select("bout_id", "d"))


@query(
    "cv_folds",
    views("bouts", """p AS (SELECT bout_id, row_number() OVER (ORDER BY bout_id) - 1 AS position, count(*) OVER () AS total FROM bouts)
SELECT bout_id, position, CASE WHEN position >= total - (total // 6) * 5 THEN CAST((position - (total - (total // 6) * 5)) // (total // 6) AS BIGINT) END AS fold FROM p"""),
)
def cv_folds(spark: SparkSession, sf: str) -> DataFrame:
    return sm.cv_folds(t.bouts(spark, sf).select("bout_id"))


_EPOCHS = f"""days AS (SELECT DISTINCT d FROM bouts),
epochs(day) AS (SELECT min(d) FROM days UNION ALL
   SELECT (SELECT min(d) FROM days WHERE d >= epochs.day + {RETRAIN_EVERY} AND d < (SELECT max(d) FROM days)) FROM epochs WHERE epochs.day IS NOT NULL)"""


def epochs(bouts: DataFrame) -> list[date]:
    days = bt.event_days(bouts)
    return bt.retrain_days(days, days[0], RETRAIN_EVERY, days[-1])


@query("retrain_epochs", views("bouts", f"{_EPOCHS} SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS epoch, day FROM epochs WHERE day IS NOT NULL", recursive=True))
def retrain_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which a walk-forward backtest trains again."""
    found = epochs(t.bouts(spark, sf))
    return spark.createDataFrame(list(enumerate(found)), "epoch bigint, day date")


@query(
    "model_epoch",
    views("bouts", f"{_EPOCHS} SELECT b.bout_id, b.d, (SELECT max(day) FROM epochs WHERE day <= b.d) AS model_epoch FROM bouts b", recursive=True),
)
def model_epoch(spark: SparkSession, sf: str) -> DataFrame:
    b = t.bouts(spark, sf).select("bout_id", "d")
    return bt.with_epoch(b, epochs(b))


STATE_CARDS, MODEL_CARDS = 8, 10


@query(
    "card_epochs",
    views("bouts", f"""cards AS (SELECT d, row_number() OVER (ORDER BY d) AS card FROM (SELECT DISTINCT d FROM bouts WHERE d IS NOT NULL)),
known AS (SELECT d, card, (card - 1) // {MODEL_CARDS} * {MODEL_CARDS} AS m, greatest((card - 1) // {STATE_CARDS} * {STATE_CARDS}, (card - 1) // {MODEL_CARDS} * {MODEL_CARDS}) AS s FROM cards)
SELECT b.bout_id, b.d, k.card, m.d AS model_through, s.d AS state_through
FROM bouts b JOIN known k ON k.d = b.d LEFT JOIN cards m ON m.card = k.m LEFT JOIN cards s ON s.card = k.s"""),
)
def card_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Card of every bout, and how far the model and the state that score it reach when both are renewed by cards."""
    b = t.bouts(spark, sf).select("bout_id", "d")
    return bt.with_card_epochs(b, STATE_CARDS, MODEL_CARDS)


_LABELLED = "lab AS (SELECT bout_id, p_ab AS p, CASE WHEN winner = red THEN 1 ELSE 0 END AS y FROM bouts WHERE winner IS NOT NULL)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    b = t.bouts(spark, sf).where(F.col("winner").isNotNull())
    return b.select("bout_id", F.col("p_ab").alias("p"), (F.col("winner") == F.col("red")).cast("int").alias("label"))


@query(
    "score_metrics",
    views("bouts", f"""{_LABELLED} SELECT count(*) AS bouts, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
   round(avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE))), 6) AS log_loss FROM lab"""),
)
def score_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return sm.score_metrics(labelled(spark, sf))


@query(
    "ensemble_mean",
    views("bouts", """m AS (SELECT bout_id, least(greatest(p_ab + (i - 2) * 0.01::DOUBLE, 0.0), 1.0) AS p FROM bouts, (SELECT unnest(range(5)) AS i)),
e AS (SELECT bout_id, round(avg(p), 9) AS p, count(*) AS models FROM m GROUP BY bout_id)
SELECT bout_id, p, models, CASE WHEN p > 0.5 THEN 'win' ELSE 'loss' END AS predicted FROM e"""),
    places=9,
)
def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Five scores per bout around p_ab, averaged."""
    shifts = F.explode(F.array(*[F.lit(i) for i in range(5)]))
    scores = t.bouts(spark, sf).select("bout_id", "p_ab", shifts.alias("model"))
    p = F.least(F.greatest(F.col("p_ab") + (F.col("model") - 2) * 0.01, F.lit(0.0)), F.lit(1.0))
    mean = sm.ensemble_mean(scores.select("bout_id", p.alias("p")))
    p9 = F.round("p", 9)
    return mean.select("bout_id", "p", "models", F.when(p9 > 0.5, F.lit("win")).otherwise(F.lit("loss")).alias("predicted"))


_COLS = ["red_kd", "blue_kd", "red_sig", "red_sig_pct", "red_tried", "blue_sig", "p_ab"]
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


def numeric_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Training columns; red_tried nearly repeats red_sig."""
    c = cleaned(spark, sf)
    return c.withColumn("red_tried", F.col("red_sig") + 0.01 * F.col("red_kd")).select("bout_id", "winner", "red", *_COLS)


_NUMERIC = "num AS (SELECT *, red_sig + 0.01 * red_kd AS red_tried FROM clean)"
_PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_COLS.index(b)}::BIGINT AS pos_b, abs(corr({a}, {b})) AS r FROM num" for a, b in _PAIRS
)


@query("corr_matrix", views("clean", f"{_NUMERIC}, pairs AS ({_PAIR_SQL}) SELECT col_a, col_b, round(r, 6) AS r FROM pairs"))
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return sm.correlation_pairs(numeric_columns(spark, sf), _COLS).select("col_a", "col_b", "r")


@query("corr_prune", views("clean", f"{_NUMERIC}, pairs AS ({_PAIR_SQL}) SELECT col_b AS column, pos_b AS position, round(max(r), 6) AS max_r, max(r) > 0.95 AS dropped FROM pairs GROUP BY 1, 2"))
def corr_prune(spark: SparkSession, sf: str) -> DataFrame:
    return sm.prune_correlated(sm.correlation_pairs(numeric_columns(spark, sf), _COLS))


@query(
    "low_importance",
    views("clean", f"""{_NUMERIC}, imp AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, CASE WHEN winner = red THEN 1.0 ELSE 0.0 END)) AS importance FROM num WHERE winner IS NOT NULL" for c in _COLS)})
SELECT feature, round(importance, 6) AS importance FROM imp WHERE importance < (SELECT quantile_cont(importance, 0.15) FROM imp)"""),
)
def low_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Features whose strength (correlation with the result) is below the 15th percentile."""
    num = numeric_columns(spark, sf).where(F.col("winner").isNotNull())
    label = (F.col("winner") == F.col("red")).cast("double")
    imp = sm.label_correlation(num, _COLS, label)
    return sm.low_importance(imp)
