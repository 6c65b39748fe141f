"""Cleaning steps over raw all-text bouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions import parse
from boutline.operators.scan import ALL_KEYS, Run, running

# fixed values: columns without use after the ratios have been split
REDUNDANT_COLUMNS = (
    "Red Sig. str. %",
    "Red Td %",
    "Blue Sig. str. %",
    "Blue Td %",
    "Red Sig. str",
    "Blue Sig. str",
    "Red Sig. str%",
    "Blue Sig. str%",
)


def text_layout(df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that hold a ratio or a clock in any row, found in one pass over the data."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not names:
        return [], []
    q = lambda c: F.col(f"`{c}`")
    aggs = [F.max(parse.looks_like_ratio(q(c))).alias(f"r{i}") for i, c in enumerate(names)]
    aggs += [F.max(parse.looks_like_clock(q(c))).alias(f"c{i}") for i, c in enumerate(names)]
    row = df.agg(*aggs).first()
    return (
        [c for i, c in enumerate(names) if row[f"r{i}"]],
        [c for i, c in enumerate(names) if row[f"c{i}"] and not row[f"r{i}"]],
    )


def convert_text_stats(df: DataFrame, ratios: Sequence[str], clocks: Sequence[str], share_suffix: str = "_pct") -> DataFrame:
    """Ratios become the landed count plus a share column, clocks become minutes."""
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in ratios:
            out += [parse.ratio_landed(col).alias(c), parse.ratio_share(col).alias(c + share_suffix)]
        elif c in clocks:
            out.append(parse.clock_minutes(col).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def decided(df: DataFrame, winner: str = "winner") -> DataFrame:
    text = F.trim(F.col(winner).cast("string"))
    return df.where(text != "")


def without_titles(df: DataFrame, title: str, words: Sequence[str]) -> DataFrame:
    """Drop rows whose title contains any of the words; rows without a title stay."""
    keep = F.lit(True)
    for w in words:
        keep = keep & F.coalesce(~F.col(title).contains(w), F.lit(True))
    return df.where(keep)


def clean_raw(
    raw: DataFrame,
    drop: Sequence[str] = REDUNDANT_COLUMNS,
    exclude: Sequence[str] = ("Women", "Open"),
    winner: str = "Winner",
    title: str = "Title",
) -> DataFrame:
    """The whole cleaning pass: typed stats, no undecided bouts, no excluded titles, no unused columns."""
    ratios, clocks = text_layout(raw)
    typed = convert_text_stats(decided(raw, winner), ratios, clocks, "%")
    return without_titles(typed.drop(*drop), title, exclude)


def complete_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def normalise_names(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Trim, plain letters, then the alias table (alias, canonical; one row per alias)."""
    bare = names.withColumn("_plain", parse.plain_name(F.col(name)))
    hit = bare.join(aliases.withColumnRenamed("alias", "_plain"), "_plain", "left")
    return hit.withColumn("normal_name", F.coalesce("canonical", "_plain")).drop("_plain", "canonical")


def carry_forward(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Latest known value at or before each row of the whole table."""
    return running(df, [], order, [Run(name, "last", value, prior=False)], ALL_KEYS)


def quarantine(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds ``error``: the first check whose text is present but whose parsed value is NULL.

    Write the two halves apart with ``where(error is null)`` and ``where(error is not null)``.
    """
    err = F.lit(None).cast("string")
    for label, (text, parsed) in reversed(list(checks.items())):
        err = F.when(text.isNotNull() & parsed.isNull(), F.concat(F.lit(f"bad {label}: "), text)).otherwise(err)
    return df.withColumn("error", err)


def name_search(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.where(F.lower(F.col(name)).contains(text.lower()))
