"""Extraction jobs over stored HTML pages; nothing is fetched.

All steps are regular expressions and generators on the page text, so a page is the unit of work and
only the extracted rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.session import stage

HREF = r'href="([^"]*)"'
LABEL = r'(?s)<i class="[^"]*(?:label|title)[^"]*">(.*?)</i>'
LABELLED = (
    r'(?s)<i class="[^"]*(?:label|title)[^"]*">.*?</i>(.*?)'
    r'(?=<i class="[^"]*(?:label|title)|</?(?:p|li|ul|div|section|table|body|h[1-6])[\s>]|$)'
)
PERSON = r'(?s)<div class="[^"]*person[^"]*">.*?</div>'
STATUS = r'(?s)<i class="[^"]*status[^"]*">(.*?)</i>'
PERSON_NAME = r'(?s)<h3 class="[^"]*name[^"]*">(.*?)</h3>'
TABLE = r"(?s)<table(?:\s[^>]*)?>(.*?)</table>"
HEAD_CELL = r"(?s)<th(?:\s[^>]*)?>(.*?)</th>"
BODY_CELL = r"(?s)<td(?:\s[^>]*)?>(.*?)</td>"
ROW = r"(?s)<tr(?:\s[^>]*)?>(.*?)</tr>"
PARAGRAPH = r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"

# fixed values: labels on entity and bout pages and the columns they fill
ENTITY_LABELS = {
    "SLpM": "SLpM",
    "Str. Acc.": "Str_Acc",
    "SApM": "SApM",
    "Str. Def": "Str_Def",
    "TD Avg.": "TD_Avg",
    "TD Acc.": "TD_Acc",
    "TD Def.": "TD_Def",
    "Sub. Avg.": "Sub_Avg",
    "Height": "Height",
    "Weight": "Weight",
    "Reach": "Reach",
    "STANCE": "Stance",
    "DOB": "DOB",
}
BOUT_LABELS = {
    "Method": "Method",
    "Round": "Round",
    "Time": "Time",
    "Time format": "Time Format",
    "Referee": "Referee",
    "Details": "Details",
}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def inner_text(html: Column) -> Column:
    """The text of an element with that of its children, trimmed."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"^\s+|\s+$", "")


def _texts(html: Column, pattern: str) -> Column:
    return F.transform(_all(html, pattern), inner_text)


def page_links(pages: DataFrame, token: str | None = None) -> DataFrame:
    """One row per link of a page, in page order; only links holding ``token`` when it is given."""
    links = pages.select("page_id", "url", F.posexplode(_all(F.col("html"), HREF)).alias("pos", "link"))
    return links if token is None else links.where(F.col("link").contains(token))


def absolute_link(url: Column, link: Column) -> Column:
    """Site-relative links get the page's scheme and host."""
    host = F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)
    return F.when(link.startswith("/"), F.concat(host, link)).otherwise(link)


def link_in_degree(pages: DataFrame) -> DataFrame:
    """Pages and links pointing at each address, and whether it is stored; counted before the join."""
    links = page_links(pages).select("page_id", absolute_link(F.col("url"), F.col("link")).alias("link"))
    per_page = links.groupBy("link", "page_id").agg(F.count("*").alias("n"))
    degree = per_page.groupBy("link").agg(F.count("*").alias("pages"), F.sum("n").alias("links"))
    stored = pages.select(F.col("url").alias("link")).distinct().withColumn("_known", F.lit(True))
    return degree.join(stored, "link", "left").select(
        "link", "pages", "links", F.coalesce("_known", F.lit(False)).alias("stored")
    )


def expand_links(pages: DataFrame, start: DataFrame, tokens: list[str]) -> DataFrame:
    """Follow links level by level from ``start`` pages: ``tokens[i]`` selects the links of level i.

    Addresses are distinct at every level, so a page that many link to is read once.
    """
    known = pages.select("page_id", "url")
    level = start.select("page_id", "url", "html")
    for token in tokens:
        links = page_links(level, token).select(absolute_link(F.col("url"), F.col("link")).alias("url")).distinct()
        found = known.join(links, "url", "left_semi").select("page_id")  # texts follow by number, only where needed
        level = pages.select("page_id", "url", "html").join(found, "page_id", "left_semi")
    return level


def reached_pages(pages: DataFrame, start: DataFrame, token: str | None = None, levels: int | None = None) -> DataFrame:
    """page_id and level of every stored page reached by links from ``start`` (level 0), breadth first.

    All pages are scanned for links once. A page is visited at its first level only, so circles end; ``levels`` stops
    earlier. Every level is one join and one anti-join, and is stored. Links to pages that are not stored lead nowhere.
    """
    links = page_links(pages, token).select("page_id", absolute_link(F.col("url"), F.col("link")).alias("url")).distinct()
    known = pages.select(F.col("page_id").alias("target"), "url")
    edges = stage(links.join(known, "url").select("page_id", "target").distinct())
    front = stage(start.select("page_id", F.lit(0).alias("level")).distinct())
    visited, level = front, 0
    while levels is None or level < levels:
        level += 1
        found = front.join(edges, "page_id").select(F.col("target").alias("page_id")).distinct()
        front = stage(found.join(visited, "page_id", "left_anti").select("page_id", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited


def labelled_values(pages: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``label: value`` pairs of a page as columns; ``names`` maps labels to column names."""
    pairs = pages.select(
        "page_id",
        F.inline(
            F.arrays_zip(_all(F.col("html"), LABEL).alias("label"), _all(F.col("html"), LABELLED).alias("value"))
        ).alias("label", "value"),
    )
    label = F.regexp_replace(inner_text(F.col("label")), r"\s*:$", "")
    trimmed = pairs.select("page_id", label.alias("label"), inner_text(F.col("value")).alias("value"))
    aggs = [F.max(F.when(F.col("label") == label, F.col("value"))).alias(name) for label, name in names.items()]
    return trimmed.groupBy("page_id").agg(*aggs)


def outcomes(pages: DataFrame) -> DataFrame:
    """Winner, loser and draw flag from the status of both persons of a page."""
    person = pages.select("page_id", F.explode(_all(F.col("html"), PERSON, 0)).alias("p"))
    person = person.select(
        "page_id", inner_text(F.regexp_extract("p", STATUS, 1)).alias("status"), inner_text(F.regexp_extract("p", PERSON_NAME, 1)).alias("name")
    )
    return person.groupBy("page_id").agg(
        F.max(F.when(F.col("status") == "W", F.col("name"))).alias("winner"),
        F.max(F.when(F.col("status") == "L", F.col("name"))).alias("loser"),
        F.max(F.col("status") == "D").alias("draw"),
    )


def stat_tables(pages: DataFrame) -> DataFrame:
    """(page_id, side, header, value) of two-line stat tables; of repeated headers the first table wins.

    Each cell holds one paragraph for the red side and one for the blue side; a missing one is ''.
    """
    tables = pages.select("page_id", F.posexplode(_all(F.col("html"), TABLE)).alias("table_no", "t"))
    cells = tables.select(
        "page_id",
        "table_no",
        F.posexplode(
            F.arrays_zip(_texts(F.col("t"), HEAD_CELL).alias("header"), _all(F.col("t"), BODY_CELL).alias("cell"))
        ).alias("pos", "hc"),
    ).where(F.col("hc.header").isNotNull() & F.col("hc.cell").isNotNull())
    texts = cells.select("page_id", "table_no", "pos", F.col("hc.header").alias("header"), _texts(F.col("hc.cell"), PARAGRAPH).alias("ps"))
    sides = texts.select(
        "page_id",
        "table_no",
        "pos",
        "header",
        F.inline(
            F.array(
                F.struct(F.lit("red").alias("side"), F.coalesce(F.get("ps", F.lit(0)), F.lit("")).alias("value")),
                F.struct(F.lit("blue").alias("side"), F.coalesce(F.get("ps", F.lit(1)), F.lit("")).alias("value")),
            )
        ),
    )
    first = F.struct("table_no", -F.col("pos"))
    return sides.groupBy("page_id", "side", "header").agg(F.min_by("value", first).alias("value"))


def history_rows(pages: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the history table of an entity page; cell i becomes ``columns[i]``.

    A cell with two paragraphs fills ``<column>`` and ``<column>_opp``.
    """
    rows = pages.select("page_id", F.posexplode(_all(F.col("html"), ROW)).alias("row_no", "r"))
    cells = rows.select("page_id", "row_no", _all(F.col("r"), BODY_CELL).alias("c")).where(F.size("c") > 1)
    out = []
    for i, name in enumerate(columns):
        cell = F.get("c", F.lit(i))
        ps = _texts(cell, PARAGRAPH)
        out.append(F.coalesce(F.get(ps, F.lit(0)), inner_text(cell)).alias(name))
        out.append(F.get(ps, F.lit(1)).alias(f"{name}_opp"))
    return cells.select("page_id", "row_no", *out)


def pair_up(names: Column, blocks: Column) -> Column:
    """Array of (first, second, block): names 2i and 2i+1 with block i; the shorter list ends it."""
    n = F.least(F.floor(F.size(names) / 2), F.size(blocks)).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        idx,
        lambda i: F.struct(
            F.get(names, 2 * i).alias("first"), F.get(names, 2 * i + 1).alias("second"), F.get(blocks, i).alias("block")
        ),
    )
