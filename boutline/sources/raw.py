"""From scraped CSV bouts to the typed table the operators use, and back to report column names.

Raw files are all text with a header and hold the newest bout first. Statistics are the columns behind
the two corner prefixes, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions import parse
from boutline.operators.features import RATINGS
from boutline.operators.running import Stat
from boutline.session import stage
from boutline.sources.files import read_csv, split_prefix

CORNERS = ("Red", "Blue")
NAME_COLUMN = "Fighter"
SHARE_MARK = "%"
# fixed values: report names of the columns that are not base statistics
REPORT_NAMES = {
    "born": "dob",
    "prior_bouts": "totalfights",
    "elo": "elo",
    "lose_streak": "losestreak",
    "win_streak": "winstreak",
    "title_wins": "titlewins",
    "opp_elo": "oppelo",
    "win_rate": "wins",
    "mean_age": "avg age",
    "age": "age",
    "layoff_days": "last_fight",
}
REPORT_SUFFIX = {"rate": "", "diff": " differential", "def": " defense"}


def read_newest_first(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV rows with their place in the file; a larger ``line_in_block`` in a later block is an older bout."""
    raw = read_csv(spark, path, columns)
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_in_block"),
    )


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``bout_id``, increasing in the given order, by a range-partitioned sort.

    The numbers depend on how the sort was partitioned, so the result is stored before anyone uses them.
    """
    return stage(df.orderBy(*order).withColumn("bout_id", F.monotonically_increasing_id()))


def snake(name: str) -> str:
    """``Sig. str.%`` becomes sig_str_pct."""
    text = name.replace(SHARE_MARK, " pct").lower()
    return re.sub(r"[^a-z0-9]+", "_", text).strip("_")


def stats_of(columns: Sequence[str]) -> list[tuple[str, Stat]]:
    """(raw name, Stat) of every statistic in a header; shares are marked by ``%``."""
    return [(s, Stat(snake(s), share=SHARE_MARK in s)) for s in split_prefix(columns, CORNERS[0], skip=[NAME_COLUMN])]


def typed_bouts(clean: DataFrame) -> tuple[DataFrame, list[Stat]]:
    """Bouts for the feature operators from a cleaned raw table that has been read newest first.

    Order is by date, then from the end of the file to its start. Bouts without a readable date come last, so that
    they shift no streak or rating of the dated ones.
    """
    q = lambda c: F.col(f"`{c}`")
    named = stats_of(clean.columns)
    typed = clean.select(
        parse.any_date(F.col("Date")).alias("d"),
        q(f"Red {NAME_COLUMN}").alias("red"),
        q(f"Blue {NAME_COLUMN}").alias("blue"),
        F.nullif(F.trim("Winner"), F.lit("")).alias("winner"),
        F.col("Method").alias("method") if "Method" in clean.columns else F.lit("").alias("method"),
        F.coalesce(F.col("Title").contains("Title"), F.lit(False)).alias("is_title"),
        parse.bout_minutes(F.col("Round").try_cast("double"), parse.clock_minutes(F.col("Time").cast("string"))).alias("minutes"),
        *[q(f"{c} {raw}").try_cast("double").alias(f"{c.lower()}_{s.name}") for raw, s in named for c in CORNERS],
        "file", "block_start", "line_in_block",
    )
    order = [F.col("d").asc_nulls_last(), *[F.col(c).desc() for c in ("file", "block_start", "line_in_block")]]
    return numbered(typed, *order).drop("file", "block_start", "line_in_block"), [s for _, s in named]


def first_master(entities: DataFrame) -> DataFrame:
    """One row per name (the lowest id) with the date of birth, from id, name, DOB."""
    first = entities.groupBy(F.col("name").alias("entity")).agg(F.min_by("DOB", "id").alias("_dob"))
    return first.select("entity", parse.any_date(F.col("_dob")).alias("dob"))


def report_name(column: str, raw_names: dict[str, str]) -> str:
    """Report heading of a feature column; ``raw_names`` maps stat names to their raw spelling."""
    fixed = {"result": "Result", "red": "Red Fighter", "blue": "Blue Fighter", "is_title": "Title", "d": "Date"}
    if column in fixed:
        return fixed[column]
    body, side, tail = column, "", ""
    for prefix in ("red", "blue"):
        if column.startswith(prefix + "_"):
            side, body = prefix.title() + " ", column[len(prefix) + 1 :]
    if body.endswith("_oppdiff"):
        body, tail = body.removesuffix("_oppdiff"), " oppdiff"
    if body in REPORT_NAMES:
        return side + REPORT_NAMES[body] + tail
    stat, _, kind = body.rpartition("_")
    if stat in raw_names and kind in REPORT_SUFFIX:
        return side + raw_names[stat] + REPORT_SUFFIX[kind] + tail
    return column


def report_frame(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature rows under report headings; ``columns`` is the raw header the stats came from."""
    raw_names = {s.name: raw for raw, s in stats_of(columns)}
    return features.drop("bout_id").select(
        *[F.col(c).alias(report_name(c, raw_names)) for c in features.columns if c != "bout_id"]
    )


__all__ = [
    "RATINGS", "first_master", "numbered", "read_newest_first", "report_frame", "report_name", "snake", "stats_of", "typed_bouts",
]
