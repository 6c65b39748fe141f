"""Queries over raw text: parsing, filters, lookups and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.functions import parse
from boutline.operators import clean, features
from boutline.operators.backtest import resolve_winner
from boutline.operators.longform import first_perspective, long_form, sides_to_wide
from boutline.operators.summary import numbered
from boutline.plans.registry import query, sql_round, views
from boutline.session import stage
from boutline.sources import pages as pg
from boutline.sources import tables as t


@query(
    "bouts_chronological",
    views("bouts", "SELECT bout_id, d, red, blue, winner, method, row_number() OVER (ORDER BY bout_id) AS seq FROM bouts"),
)
def bouts_chronological(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts with a dense chronological number, counted in segments instead of one sorted task."""
    b = t.bouts(spark, sf).select("bout_id", "d", "red", "blue", "winner", "method")
    out = numbered(b).withColumn("seq", F.col("position") + 1).drop("position")
    return out.orderBy("bout_id")


@query(
    "unpaired_events",
    """WITH e AS (SELECT event_id, user_id, CAST(floor(event_id / 2) AS BIGINT) AS bout_id FROM events),
p AS (SELECT bout_id, count(*) FILTER (event_id % 2 = 0) AS reds, count(*) FILTER (event_id % 2 = 1) AS blues,
   max(user_id) FILTER (event_id % 2 = 0) AS red, max(user_id) FILTER (event_id % 2 = 1) AS blue FROM e GROUP BY bout_id),
r AS (SELECT bout_id, CASE WHEN reds = 0 OR blues = 0 THEN 'missing corner' WHEN reds > 1 OR blues > 1 THEN 'repeated event'
   WHEN red IS NULL OR blue IS NULL THEN 'unknown entity' WHEN red = blue THEN 'same entity' END AS reason FROM p)
SELECT event_id, bout_id, reason FROM e JOIN r USING (bout_id) WHERE reason IS NOT NULL""",
)
def unpaired_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events that make no bout, with the reason."""
    return t.unpaired_events(t.table(spark, sf, "events"))


@query("json_props_scan", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_scan(spark: SparkSession, sf: str) -> DataFrame:
    ev = t.table(spark, sf, "events")
    return ev.select("event_id", "event_type", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query(
    "clean_ratio",
    views("bouts", """SELECT bout_id, CAST(split_part(red_sig, ' of ', 1) AS DOUBLE) AS landed,
       round(CASE WHEN CAST(split_part(red_sig, ' of ', 2) AS DOUBLE) = 0 THEN 0.0
         ELSE CAST(split_part(red_sig, ' of ', 1) AS DOUBLE) / CAST(split_part(red_sig, ' of ', 2) AS DOUBLE) END, 6) AS share
FROM bouts"""),
)
def clean_ratio(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("red_sig")
    return t.bouts(spark, sf).select(
        "bout_id", parse.ratio_landed(c).alias("landed"), parse.ratio_share(c).alias("share")
    )


@query(
    "clean_clock",
    views("bouts", """SELECT bout_id, clock,
       round((CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT)) / 60, 6) AS minutes,
       round((round - 1) * 5 + (CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT)) / 60, 6) AS bout_minutes
FROM bouts"""),
)
def clean_clock(spark: SparkSession, sf: str) -> DataFrame:
    m = parse.clock_minutes(F.col("clock"))
    return t.bouts(spark, sf).select(
        "bout_id", "clock", m.alias("minutes"), parse.bout_minutes(F.col("round"), m).alias("bout_minutes")
    )


@query("decided_bouts", views("bouts", "SELECT bout_id, red, blue, winner FROM bouts WHERE winner IS NOT NULL"))
def decided_bouts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.decided(t.bouts(spark, sf)).select("bout_id", "red", "blue", "winner")


@query(
    "exclude_title",
    views("bouts", """titled AS (SELECT bout_id, CASE method WHEN 'view' THEN 'Women''s Flyweight Bout' WHEN 'click' THEN 'Open Weight Bout'
         WHEN 'purchase' THEN 'Title Bout' WHEN 'signup' THEN 'Lightweight Bout' END AS title FROM bouts)
SELECT bout_id, title FROM titled WHERE title IS NULL OR (title NOT LIKE '%Women%' AND title NOT LIKE '%Open%')"""),
)
def exclude_title(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("method")
    title = (
        F.when(m == "view", "Women's Flyweight Bout")
        .when(m == "click", "Open Weight Bout")
        .when(m == "purchase", "Title Bout")
        .when(m == "signup", "Lightweight Bout")
    )
    named = t.bouts(spark, sf).select("bout_id", title.alias("title"))
    return clean.without_titles(named, "title", ["Women", "Open"])


@query("sentinel_null", views("bouts", "SELECT bout_id, nullif(red_ctrl, '--') AS red_ctrl, nullif(blue_ctrl, '--') AS blue_ctrl FROM bouts"))
def sentinel_null(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda c: parse.sentinel_null(F.col(c)).alias(c)
    return t.bouts(spark, sf).select("bout_id", q("red_ctrl"), q("blue_ctrl"))


@query(
    "complete_rows",
    views("clean", f"SELECT bout_id, {sql_round('red_ctrl blue_ctrl')}, CAST(red_odds AS BIGINT) AS red_odds FROM clean WHERE red_ctrl IS NOT NULL AND blue_ctrl IS NOT NULL AND red_odds IS NOT NULL"),
)
def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["red_ctrl", "blue_ctrl", "red_odds"]
    return clean.complete_rows(t.clean_bouts(t.bouts(spark, sf)), cols).select("bout_id", *cols)


@query(
    "backtest_range",
    views("bouts", "SELECT bout_id, d, red, blue FROM bouts WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
)
def backtest_range(spark: SparkSession, sf: str) -> DataFrame:
    """Closed date range, given as text dates of the odds file."""
    lo, hi = (F.lit(parse_text).alias("x") for parse_text in ("Jan 5 2024", "Jan 20 2024"))
    b = t.bouts(spark, sf).where(F.col("d").between(parse.any_date(lo), parse.any_date(hi)))
    return b.select("bout_id", "d", "red", "blue")


@query(
    "parse_dates",
    views("bouts", """SELECT bout_id,
       CASE bout_id % 6 WHEN 0 THEN strftime(d, '%B %d, %Y') WHEN 1 THEN strftime(d, '%b %d, %Y') WHEN 2 THEN strftime(d, '%b. %d, %Y')
         WHEN 3 THEN strftime(d, '%b %d %Y') WHEN 4 THEN strftime(d, '%A, %B %d, %Y') ELSE '--' END AS date_text,
       CASE WHEN bout_id % 6 = 5 THEN NULL ELSE d END AS parsed
FROM bouts"""),
)
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    form = F.col("bout_id") % 6
    d = F.col("d")
    text = (
        F.when(form == 0, F.date_format(d, "MMMM dd, yyyy"))
        .when(form == 1, F.date_format(d, "MMM dd, yyyy"))
        .when(form == 2, F.date_format(d, "MMM. dd, yyyy"))
        .when(form == 3, F.date_format(d, "MMM dd yyyy"))
        .when(form == 4, F.date_format(d, "EEEE, MMMM dd, yyyy"))
        .otherwise(F.lit("--"))
    )
    dated = t.bouts(spark, sf).select("bout_id", text.alias("date_text"))
    return dated.withColumn("parsed", parse.any_date(F.col("date_text")))


@query(
    "parse_physique",
    views("master", """SELECT entity,
       CASE WHEN entity % 31 = 0 THEN NULL ELSE CAST((5 + entity % 2) * 12 + entity % 12 AS BIGINT) END AS height_in,
       CAST(125 + 10 * (entity % 14) AS BIGINT) AS weight_lbs FROM master"""),
)
def parse_physique(spark: SparkSession, sf: str) -> DataFrame:
    return t.master(spark, sf).select(
        "entity",
        parse.height_inches(F.col("height_text")).alias("height_in"),
        parse.first_int(F.col("weight_text")).alias("weight_lbs"),
    )


@query(
    "lenient_number",
    views("master", """SELECT entity, round(CAST(entity % 100 AS DOUBLE) / 100.0, 6) AS accuracy,
       CAST(125 + 10 * (entity % 14) AS DOUBLE) AS weight, 0.0::DOUBLE AS bad FROM master"""),
)
def lenient_number(spark: SparkSession, sf: str) -> DataFrame:
    n = parse.lenient_number
    return t.master(spark, sf).select(
        "entity", n(F.col("acc_text")).alias("accuracy"), n(F.col("weight_text")).alias("weight"), n(F.col("name")).alias("bad")
    )


@query(
    "parse_record",
    views("master", """SELECT entity, CAST(entity % 30 AS BIGINT) AS wins, CAST(entity % 11 AS BIGINT) AS losses,
       CAST(entity % 2 AS BIGINT) AS draws FROM master"""),
)
def parse_record(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("record_text")
    return t.master(spark, sf).select(
        "entity",
        parse.record_part(r, 1).alias("wins"),
        parse.record_part(r, 2).alias("losses"),
        parse.record_part(r, 3).alias("draws"),
    )


@query(
    "normalise_names",
    """SELECT c_custkey AS entity, CASE WHEN c_custkey % 40 = 0 THEN c_mktsegment || ' ' || c_name ELSE replace(c_name, 'C', 'c') END AS normal_name
FROM customer""",
)
def normalise_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with accents and stray blanks; every fortieth customer has an alias."""
    cust = t.table(spark, sf, "customer")
    written = F.concat(F.lit("  "), F.translate(F.regexp_replace("c_name", "C", "c"), "e", "é"), F.lit(" "))
    names = cust.select(F.col("c_custkey").alias("entity"), written.alias("name"))
    aliases = cust.where(F.col("c_custkey") % 40 == 0).select(
        F.regexp_replace("c_name", "C", "c").alias("alias"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("canonical")
    )
    return clean.normalise_names(names, aliases).select("entity", "normal_name")


@query(
    "odds_parse",
    views("bouts", """SELECT bout_id, CAST(nullif(replace(red_odds, '−', '-'), '-') AS BIGINT) AS red_odds,
       CAST(nullif(replace(blue_odds, '−', '-'), '-') AS BIGINT) AS blue_odds FROM bouts"""),
)
def odds_parse(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda c: parse.odds_int(F.col(c)).alias(c)
    return t.bouts(spark, sf).select("bout_id", q("red_odds"), q("blue_odds"))


@query(
    "label_encode",
    views("long", """SELECT bout_id, side, outcome, CAST(CASE outcome WHEN 'loss' THEN 0 WHEN 'win' THEN 1 END AS BIGINT) AS code,
       CASE WHEN outcome IN ('win', 'loss') THEN outcome END AS decoded FROM long"""),
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    long = long_form(t.bouts(spark, sf)).select("bout_id", "side", "outcome")
    coded = long.withColumn("code", parse.label_code(F.col("outcome")))
    return coded.withColumn("decoded", parse.label_name(F.col("code")))


@query("name_search", views("master", "SELECT entity, name FROM master WHERE contains(lower(name), lower('OMER#00000001'))"))
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    return clean.name_search(t.master(spark, sf), "name", "OMER#00000001").select("entity", "name")


@query(
    "invalid_matchups",
    views("ev master", """req AS (SELECT CAST(floor(r.event_id / 2) AS BIGINT) AS request_id, r.user_id AS red, b.user_id AS blue
  FROM ev r JOIN ev b ON floor(r.event_id / 2) = floor(b.event_id / 2) AND r.event_id % 2 = 0 AND b.event_id % 2 = 1)
SELECT request_id, red, blue, CASE WHEN red = blue THEN 'same entity' ELSE 'unknown entity' END AS reason FROM req
WHERE red = blue OR red NOT IN (SELECT entity FROM master WHERE dob IS NOT NULL) OR blue NOT IN (SELECT entity FROM master WHERE dob IS NOT NULL)"""),
)
def invalid_matchups(spark: SparkSession, sf: str) -> DataFrame:
    """Requested pairs (also of an entity with itself); an entity without date of birth counts as unknown."""
    ev = t.table(spark, sf, "events").select(
        F.shiftright("event_id", 1).alias("request_id"), "event_id", "user_id"
    )
    red = ev.where(F.col("event_id") % 2 == 0).select("request_id", F.col("user_id").alias("red"))
    blue = ev.where(F.col("event_id") % 2 == 1).select("request_id", F.col("user_id").alias("blue"))
    known = t.master(spark, sf).where(F.col("dob").isNotNull()).select("entity")
    return features.invalid_matchups(red.join(blue, "request_id"), known)


@query(
    "bout_with_master",
    views("bouts master", """SELECT b.bout_id, b.red, b.blue, r.name AS red_name, r.dob AS red_dob, u.name AS blue_name, u.dob AS blue_dob
FROM bouts b LEFT JOIN master r ON r.entity = b.red LEFT JOIN master u ON u.entity = b.blue"""),
)
def bout_with_master(spark: SparkSession, sf: str) -> DataFrame:
    b = t.bouts(spark, sf).select("bout_id", "red", "blue")
    return features.with_master(b, t.master(spark, sf), ["name", "dob"])


@query(
    "dedup_mirrored",
    views("long", """ranked AS (SELECT *, row_number() OVER (PARTITION BY least(entity, opponent), greatest(entity, opponent), d ORDER BY bout_id, side) AS rn FROM long)
SELECT bout_id, d, entity, opponent, outcome FROM ranked WHERE rn = 1"""),
)
def dedup_mirrored(spark: SparkSession, sf: str) -> DataFrame:
    """Both perspectives of each bout reduced to one row per pair and event (the day)."""
    long = long_form(t.bouts(spark, sf))
    kept = first_perspective(long, "d", ["bout_id", "side"])
    return kept.select("bout_id", "d", "entity", "opponent", "outcome")


@query("entities", views("bouts", "SELECT red AS entity FROM bouts UNION SELECT blue FROM bouts"))
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return features.distinct_entities(t.bouts(spark, sf))


@query(
    "winner_resolved",
    views("bouts", """latest AS (SELECT least(red, blue) AS lo, greatest(red, blue) AS hi,
    arg_max(coalesce(CAST(winner AS VARCHAR), 'draw/no contest'), bout_id) AS found FROM bouts GROUP BY 1, 2)
SELECT bout_id, CASE WHEN method = 'error' THEN found WHEN winner IS NULL THEN 'draw/no contest' ELSE CAST(winner AS VARCHAR) END AS winner_name
FROM bouts JOIN latest ON lo = least(red, blue) AND hi = greatest(red, blue)"""),
)
def winner_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Corner outcomes are missing for one method; those bouts look up the pair's newest result."""
    b = t.bouts(spark, sf).select("bout_id", "red", "blue", "winner", "method")
    outcome = (
        F.when(F.col("method") == "error", F.lit("not found"))
        .when(F.col("winner").isNull(), F.lit("draw"))
        .when(F.col("winner") == F.col("red"), F.lit("loss"))
        .otherwise(F.lit("win"))
    )
    results = b.select("red", "blue", "winner", F.col("bout_id").alias("row_no"))
    return resolve_winner(b.withColumn("corner_outcome", outcome), results).select("bout_id", "winner_name")


@query(
    "carry_forward",
    views("bouts", """slugs AS (SELECT bout_id, CASE WHEN is_title THEN 'night-' || CAST(round AS VARCHAR) || '-' || CAST(2000 + red_kd + 4 * blue_kd AS VARCHAR)
   ELSE 'numbered-' || CAST(bout_id AS VARCHAR) END AS slug FROM bouts)
SELECT bout_id, slug, last_value(CASE WHEN slug LIKE 'night-%' THEN CAST(split_part(slug, '-', 3) AS BIGINT) END IGNORE NULLS)
   OVER (ORDER BY bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_year FROM slugs"""),
)
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Year of the latest card whose name holds one."""
    s = lambda c: F.col(c).cast("string")
    slug = F.when(
        F.col("is_title"),
        F.concat(F.lit("night-"), s("round"), F.lit("-"), (2000 + F.col("red_kd") + 4 * F.col("blue_kd")).cast("string")),
    ).otherwise(F.concat(F.lit("numbered-"), s("bout_id")))
    named = t.bouts(spark, sf).select("bout_id", slug.alias("slug"))
    year = F.when(F.col("slug").startswith("night-"), F.element_at(F.split("slug", "-"), -1).try_cast("bigint"))
    return clean.carry_forward(named, "bout_id", year, "event_year")


@query(
    "bad_row_quarantine",
    views("bouts", """SELECT bout_id, red_ctrl, blue_ctrl, red_odds,
       CASE WHEN red_ctrl = '--' THEN 'bad red control: --' WHEN blue_ctrl = '--' THEN 'bad blue control: --'
            WHEN red_odds = '-' THEN 'bad red odds: -' END AS error FROM bouts"""),
)
def bad_row_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    checks = {
        "red control": (F.col("red_ctrl"), parse.clock_minutes(F.col("red_ctrl"))),
        "blue control": (F.col("blue_ctrl"), parse.clock_minutes(F.col("blue_ctrl"))),
        "red odds": (F.col("red_odds"), parse.odds_int(F.col("red_odds"))),
    }
    return clean.quarantine(t.bouts(spark, sf).select("bout_id", "red_ctrl", "blue_ctrl", "red_odds"), checks)


@query(
    "page_links",
    """WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)
SELECT page_id, link, count(*) AS times FROM links WHERE contains(link, 'th') GROUP BY 1, 2""",
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    links = pg.page_links(t.table(spark, sf, "pages"), "th")
    return links.groupBy("page_id", "link").agg(F.count("*").alias("times"))


@query(
    "link_in_degree",
    """WITH links AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM pages),
full_links AS (SELECT page_id, CASE WHEN raw LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || raw ELSE raw END AS link FROM links)
SELECT link, count(DISTINCT page_id) AS pages, count(*) AS links, link IN (SELECT url FROM pages) AS stored FROM full_links GROUP BY link""",
)
def link_in_degree(spark: SparkSession, sf: str) -> DataFrame:
    return pg.link_in_degree(t.table(spark, sf, "pages"))


LEVELS = 6


def chain_pages(bouts: DataFrame) -> DataFrame:
    """One page per bout with links to the next bouts of both sides, and an absolute one to a page that is not stored."""
    w = Window.partitionBy("entity").orderBy("bout_id")
    sides = long_form(bouts).select("bout_id", "side", F.lead("bout_id").over(w).alias("next"))
    after = sides_to_wide(sides, ["next"])
    link = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit('<a href="/bout/'), F.col(c).cast("string"), F.lit('">next</a>'))).otherwise("")
    html = F.concat(F.lit("<html><body>"), link("red_next"), link("blue_next"), F.lit('<a href="http://elsewhere/bout/1">other</a></body></html>'))
    url = F.concat(F.lit("http://contests/bout/"), F.col("bout_id").cast("string"))
    return after.select(F.col("bout_id").alias("page_id"), url.alias("url"), html.alias("html"))


@query(
    "link_expansion",
    views("bouts", f"""s AS (SELECT bout_id, red AS entity FROM bouts UNION ALL SELECT bout_id, blue FROM bouts),
e AS (SELECT DISTINCT bout_id, lead(bout_id) OVER (PARTITION BY entity ORDER BY bout_id) AS target FROM s),
reach(page_id, level) AS (SELECT bout_id, 0::BIGINT FROM bouts WHERE d = (SELECT min(d) FROM bouts)
  UNION SELECT target, level + 1 FROM reach JOIN e ON bout_id = page_id WHERE target IS NOT NULL AND level < {LEVELS})
SELECT page_id, min(level) AS level FROM reach GROUP BY page_id""", recursive=True),
)
def link_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Bout pages reached from those of the first day in at most six links, breadth first."""
    b = t.bouts(spark, sf)
    first = b.where(F.col("d") == b.agg(F.min("d")).scalar()).select(F.col("bout_id").alias("page_id"))
    return pg.reached_pages(stage(chain_pages(b)), first, levels=LEVELS)


def bout_pages(bouts: DataFrame) -> DataFrame:
    """Bouts rendered as stored detail pages, the input of the page extraction queries."""
    s = lambda c: F.col(c).cast("string")

    def status(side: str) -> F.Column:
        return F.when(F.col("winner").isNull(), "D").when(F.col("winner") == F.col(side), "W").otherwise("L")

    def person(side: str) -> list:
        return [
            F.lit('<div class="x-person"><i class="x-person-status">\n '), status(side), F.lit('\n</i><h3 class="x-person-name">'),
            s(side), F.lit("</h3></div>"),
        ]

    def label(name: str, col: str) -> list:
        return [F.lit(f'<p><i class="x-label">{name}:</i> '), s(col), F.lit("</p>")]

    def table(head: list[str], cells: list[tuple[str, str]]) -> list:
        parts = [F.lit("<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr></thead>\n<tbody><tr>")]
        for r, b in cells:
            parts += [F.lit("<td><p> "), s(r), F.lit(" </p><p>"), s(b), F.lit("</p></td>")]
        return [*parts, F.lit("</tr></tbody></table>")]

    html = F.concat(
        F.lit("<html><body>"), *person("red"), *person("blue"),
        *label("Method", "method"), *label("Round", "round"), *label("Time", "clock"),
        *table(["Fighter", "KD", "Sig. str."], [("red", "blue"), ("red_kd", "blue_kd"), ("red_sig", "blue_sig")]),
        *table(["KD", "Ctrl"], [("blue_kd", "red_kd"), ("red_ctrl", "blue_ctrl")]),
        F.lit("</body></html>"),
    )
    return bouts.select(
        F.col("bout_id").alias("page_id"), F.concat(F.lit("/bout/"), s("bout_id")).alias("url"), html.alias("html")
    )


@query(
    "page_details",
    views("bouts", "SELECT bout_id AS page_id, method, CAST(round AS VARCHAR) AS round, clock AS time FROM bouts"),
)
def page_details(spark: SparkSession, sf: str) -> DataFrame:
    pages = bout_pages(t.bouts(spark, sf))
    return pg.labelled_values(pages, {"Method": "method", "Round": "round", "Time": "time"})


@query(
    "page_outcomes",
    views("bouts", """SELECT bout_id AS page_id, CAST(winner AS VARCHAR) AS winner,
       CASE WHEN winner IS NOT NULL THEN CAST(CASE WHEN winner = red THEN blue ELSE red END AS VARCHAR) END AS loser,
       winner IS NULL AS draw FROM bouts"""),
)
def page_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return pg.outcomes(bout_pages(t.bouts(spark, sf)))


@query(
    "page_stat_tables",
    views("bouts", " UNION ALL ".join(
        f"SELECT bout_id AS page_id, '{s}' AS side, '{h}' AS header, CAST({s}{c} AS VARCHAR) AS value FROM bouts"
        for s in ("red", "blue") for h, c in (("Fighter", ""), ("KD", "_kd"), ("Sig. str.", "_sig"), ("Ctrl", "_ctrl"))
    )),
)
def page_stat_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables per page share a header; the first table's value stays."""
    return pg.stat_tables(bout_pages(t.bouts(spark, sf)))


@query(
    "page_history",
    views("bouts", """SELECT bout_id AS page_id, CAST(red AS VARCHAR) AS entity, CAST(blue AS VARCHAR) AS opponent,
       CAST(red_kd AS VARCHAR) AS kd, CAST(blue_kd AS VARCHAR) AS kd_opp, method FROM bouts"""),
)
def page_history(spark: SparkSession, sf: str) -> DataFrame:
    """History rows of entity pages: one page per bout here, rows without cells are headers."""
    s = lambda c: F.col(c).cast("string")
    html = F.concat(
        F.lit("<table><tr><th>head</th></tr><tr><td><a>"), s("red"), F.lit("</a></td><td>"), s("blue"),
        F.lit("</td><td><p>"), s("red_kd"), F.lit("</p><p>"), s("blue_kd"), F.lit("</p></td><td><p>"), s("method"),
        F.lit("</p></td></tr></table>"),
    )
    pages = t.bouts(spark, sf).select(F.col("bout_id").alias("page_id"), html.alias("html"))
    rows = pg.history_rows(pages, ["entity", "opponent", "kd", "method"])
    return rows.select("page_id", "entity", "opponent", "kd", "kd_opp", "method")


@query(
    "paired_lists",
    views("ev", """lists AS (SELECT CAST(floor(event_id / 10) AS BIGINT) AS list_id, list(user_id ORDER BY event_id) AS names,
   list(k ORDER BY event_id) FILTER (WHERE event_id % 10 < 4) AS blocks FROM ev GROUP BY 1),
idx AS (SELECT *, unnest(range(least(len(names) // 2, len(blocks)))) AS i FROM lists)
SELECT list_id, CAST(i AS BIGINT) AS pair_no, names[2 * i + 1] AS first, names[2 * i + 2] AS second, CAST(blocks[i + 1] AS BIGINT) AS block FROM idx"""),
)
def paired_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Flat name lists (ten names) with fewer odds blocks (four): pairs stop with the shorter list."""
    ev = t.events_with_k(t.table(spark, sf, "events"))
    item = F.struct("event_id", "user_id", "k")
    lists = ev.groupBy(F.floor(F.col("event_id") / 10).alias("list_id")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    names = F.transform("x", lambda e: e["user_id"])
    blocks = F.transform(F.filter("x", lambda e: e["event_id"] % 10 < 4), lambda e: e["k"])
    return lists.select("list_id", F.posexplode(pg.pair_up(names, blocks)).alias("pair_no", "p")).select(
        "list_id", "pair_no", "p.first", "p.second", "p.block"
    )
