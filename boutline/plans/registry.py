"""Registered queries with the SQL that states the same result over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PLACES = 6


def tidy(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Whole numbers as bigint and fractions rounded, so that two engines print the same values."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), places)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, places: int = PLACES) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), places)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_MINUTES = "(CAST(split_part({c}, ':', 1) AS DOUBLE) * 60 + CAST(split_part({c}, ':', 2) AS DOUBLE)) / 60"


def _side_clean(s: str) -> str:
    landed = f"CAST(split_part({s}_sig, ' of ', 1) AS DOUBLE)"
    tried = f"CAST(split_part({s}_sig, ' of ', 2) AS DOUBLE)"
    return f"""
       CAST({s}_kd AS DOUBLE) AS {s}_kd,
       {landed} AS {s}_sig,
       CASE WHEN {tried} = 0 THEN 0.0 ELSE {landed} / {tried} END AS {s}_sig_pct,
       CASE WHEN {s}_ctrl <> '--' THEN {_MINUTES.format(c=f"{s}_ctrl")} END AS {s}_ctrl,
       CASE WHEN {s}_odds <> '-' THEN CAST(replace({s}_odds, '−', '-') AS INT) END AS {s}_odds"""


def _clock(sec: str) -> str:
    return f"CAST(CAST(floor(({sec}) / 60) AS INT) AS VARCHAR) || ':' || lpad(CAST(({sec}) % 60 AS VARCHAR), 2, '0')"


def _odds(k: str) -> str:
    return (
        f"CASE WHEN {k} = 13 THEN '-' WHEN {k} < 50 THEN '−' || CAST(104 + 4 * (49 - {k}) AS VARCHAR) "
        f"ELSE CAST(100 + 6 * ({k} - 50) AS VARCHAR) END"
    )


def _sig(r: str) -> str:
    landed = f"CAST(floor({r}.value) AS INT)"
    return f"CAST({landed} AS VARCHAR) || ' of ' || CAST({landed} + {r}.k AS VARCHAR)"


def _half(s: str, o: str) -> str:
    stats = ", ".join(f"{s}_{c} AS own_{c}, {o}_{c} AS opp_{c}" for c in ("kd", "sig", "sig_pct", "ctrl"))
    return f"""SELECT bout_id, d, is_title, method, minutes, '{s}' AS side, {s} AS entity, {o} AS opponent,
       CASE WHEN winner IS NULL THEN 'draw' WHEN winner = {s} THEN 'win' ELSE 'loss' END AS outcome, {stats}
FROM clean"""


PRIOR = "(PARTITION BY entity ORDER BY bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UPTO = "(PARTITION BY entity ORDER BY bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _recency_term(stat: str, kind: str) -> str:
    own, opp = f"own_{stat}", f"opp_{stat}"
    body = {"rate": f"{own} * n * n / minutes", "diff": f"({own} - {opp}) * n * n", "def": f"(1 - {opp}) * n * n"}[kind]
    return f"CASE WHEN {own} IS NOT NULL AND {opp} IS NOT NULL AND minutes > 0 THEN {body} END"


RECENCY = [(s, k) for s in ("kd", "sig", "sig_pct", "ctrl") for k in ("rate", "diff", "def") if k != "def" or s == "sig_pct"]
FEATURES = [
    "born", "prior_bouts", "win_streak", "lose_streak", "title_wins", "win_rate", "age", "mean_age", "layoff_days",
    *[f"{s}_{k}" for s, k in RECENCY],
]


def _recency_value(s: str, k: str) -> str:
    return (
        f"CASE WHEN n > 1 THEN coalesce(sum({_recency_term(s, k)}) OVER {PRIOR}, 0) "
        f"/ ((n - 1) * n * (2 * (n - 1) + 1) / 6) END AS {s}_{k}"
    )


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"),
    "bouts": (
        ("ev",),
        f"""SELECT CAST(floor(r.event_id / 2) AS BIGINT) AS bout_id, r.ts AS ts, CAST(r.ts AS DATE) AS d,
       r.user_id AS red, b.user_id AS blue,
       CASE WHEN r.value > b.value THEN r.user_id WHEN b.value > r.value THEN b.user_id END AS winner,
       r.event_type AS method, r.event_type = 'purchase' AS is_title, 1 + (r.k + b.k) % 5 AS round,
       {_clock("(3 * r.k + b.k) % 300")} AS clock,
       {_sig("r")} AS red_sig, {_sig("b")} AS blue_sig, r.k % 4 AS red_kd, b.k % 4 AS blue_kd,
       CASE WHEN r.k % 17 = 0 THEN '--' ELSE {_clock("3 * r.k")} END AS red_ctrl,
       CASE WHEN b.k % 17 = 0 THEN '--' ELSE {_clock("3 * b.k")} END AS blue_ctrl,
       {_odds("r.k")} AS red_odds, {_odds("b.k")} AS blue_odds,
       CAST(r.k + 1 AS DOUBLE) / (r.k + b.k + 2) AS p_ab, CAST(b.k + 5 AS DOUBLE) / (r.k + b.k + 10) AS p_ba
FROM ev r JOIN ev b
  ON floor(r.event_id / 2) = floor(b.event_id / 2) AND r.event_id % 2 = 0 AND b.event_id % 2 = 1
WHERE r.user_id <> b.user_id""",
    ),
    "master": (
        (),
        """SELECT c_custkey AS entity, c_name AS name,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE DATE '1970-01-01' + CAST((c_custkey * 37) % 9000 AS INT) END AS dob,
       CASE WHEN c_custkey % 31 = 0 THEN '--' ELSE CAST(5 + c_custkey % 2 AS VARCHAR) || ''' ' || CAST(c_custkey % 12 AS VARCHAR) || '"' END AS height_text,
       CAST(125 + 10 * (c_custkey % 14) AS VARCHAR) || ' lbs.' AS weight_text,
       CAST(c_custkey % 30 AS VARCHAR) || '-' || CAST(c_custkey % 11 AS VARCHAR) || '-' || CAST(c_custkey % 2 AS VARCHAR) ||
         CASE WHEN c_custkey % 7 = 0 THEN ' (1 NC)' ELSE '' END AS record_text,
       CAST(c_custkey % 100 AS VARCHAR) || '%' AS acc_text
FROM customer""",
    ),
    "clean": (
        ("bouts",),
        f"""SELECT bout_id, d, red, blue, winner, method, is_title,
       (round - 1) * 5 + {_MINUTES.format(c="clock")} AS minutes,{_side_clean("red")},{_side_clean("blue")}, p_ab, p_ba
FROM bouts""",
    ),
    "long": (("clean",), _half("red", "blue") + "\nUNION ALL\n" + _half("blue", "red")),
    "hist": (
        ("long", "master"),
        f"""SELECT l.*, m.dob, row_number() OVER (PARTITION BY l.entity ORDER BY bout_id) AS n,
       max(CASE WHEN outcome = 'loss' THEN bout_id END) OVER {PRIOR} AS last_loss,
       max(CASE WHEN outcome = 'win' THEN bout_id END) OVER {PRIOR} AS last_win,
       lag(d) OVER (PARTITION BY l.entity ORDER BY bout_id) AS last_d
FROM long l LEFT JOIN master m ON m.entity = l.entity""".replace("(PARTITION BY entity", "(PARTITION BY l.entity"),
    ),
    "feats": (
        ("hist",),
        f"""SELECT h.*, n - 1 AS prior_bouts,
       CAST(coalesce(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) OVER {PRIOR}, 0) AS BIGINT) AS wins,
       CAST(coalesce(sum(CASE WHEN outcome = 'win' AND is_title THEN 1 ELSE 0 END) OVER {PRIOR}, 0) AS BIGINT) AS title_wins,
       CAST(coalesce(sum(CASE WHEN is_title THEN 1 ELSE 0 END) OVER {PRIOR}, 0) AS BIGINT) AS title_bouts,
       avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) OVER {PRIOR} AS win_rate,
       year(dob) AS born, year(d) - year(dob) AS age, avg(year(d) - year(dob)) OVER {PRIOR} AS mean_age,
       datediff('day', last_d, d) AS layoff_days,
       (SELECT count(*) FROM long p WHERE p.entity = h.entity AND p.outcome = 'win' AND p.bout_id < h.bout_id
          AND p.bout_id > coalesce(h.last_loss, -1)) AS win_streak,
       (SELECT count(*) FROM long p WHERE p.entity = h.entity AND p.outcome = 'loss' AND p.bout_id < h.bout_id
          AND p.bout_id > coalesce(h.last_win, -1)) AS lose_streak,
       {", ".join(_recency_value(s, k) for s, k in RECENCY)}
FROM hist h""",
    ),
}


def views(names: str, body: str, recursive: bool = False) -> str:
    """SQL text with the named views (and what they need) in front of ``body``.

    ``body`` is a SELECT, or further WITH entries followed by a SELECT.
    """
    order: list[str] = []

    def need(v: str) -> None:
        for dep in _VIEWS[v][0]:
            need(dep)
        if v not in order:
            order.append(v)

    for v in names.split():
        need(v)
    ctes = ",\n".join(f"{v} AS (\n{_VIEWS[v][1]}\n)" for v in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if not ctes:
        return body if body.upper().startswith("SELECT") else head + body
    return head + ctes + ("\n" if body.upper().startswith("SELECT") else ",\n") + body


def sql_round(cols: str, places: int = PLACES) -> str:
    """``round(c, places) AS c`` for each name."""
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols.split())


def sql_big(cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols.split())
