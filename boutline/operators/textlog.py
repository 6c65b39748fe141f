"""Bet slips as text lines, and figures read back from such logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators.scan import NO_SKEW, Run, Skew, running

MARKED_BANKROLL = r"\*\*\* Bankroll: \$([\d.]+) \*\*\*"
PLAIN_BANKROLL = r"^Bankroll: \$?([\d.]+)"


def fixed(c: Column, places: int) -> Column:
    """Decimal text; rounding to 6 places first removes float noise around ties."""
    return F.format_string(f"%.{places}f", F.round(F.round(c, 6), places))


def money(c: Column) -> Column:
    return fixed(c, 2)


def slip_lines(bets: DataFrame) -> DataFrame:
    """Lines of each priced bet: both sides with odds, probability and Kelly, then the stake.

    Needs bankroll_before and share; ``line_no`` orders the lines of one bout.
    """

    def side(name: str, odds: str, p: str, k: str) -> Column:
        return F.concat(
            F.col(name).cast("string"), F.lit(": "), F.col(odds).cast("string"), F.lit(" "),
            fixed(F.col(p), 3), F.lit(" "), money(F.col(k)),
        )

    stake = F.col("bankroll_before") * F.col("share")
    gain = stake * F.when(F.col("pick_odds") < 0, F.lit(100.0) / -F.col("pick_odds")).otherwise(F.col("pick_odds") / 100)
    name = F.col("pick").cast("string")
    bet = F.when(F.col("share").isNull(), F.concat(name, F.lit(" (no bet)"))).otherwise(
        F.concat(name, F.lit(" $"), money(stake), F.lit(" (bet) pt: $"), money(stake + gain), F.lit(" +$"), money(gain))
    )
    lines = F.array(
        side("red", "red_odds", "a_win", "kelly_a"), side("blue", "blue_odds", "b_win", "kelly_b"), bet, F.lit("---")
    )
    return bets.select("bout_id", F.posexplode(lines).alias("line_no", "line"))


def bankroll_marks(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """Bankroll figures of a log in line order, with the kind of mark."""
    marked = F.regexp_extract(text, MARKED_BANKROLL, 1).try_cast("double")
    plain = F.regexp_extract(text, PLAIN_BANKROLL, 1).try_cast("double")
    kind = F.when(marked.isNotNull(), F.lit("marked")).when(plain.isNotNull(), F.lit("plain"))
    found = lines.select(order, kind.alias("kind"), F.coalesce(marked, plain).alias("bankroll"))
    return found.where(F.col("kind").isNotNull())


def tag_sections(
    lines: DataFrame, header: Column, keys: list[str], order: str = "line_no", skew: Skew = NO_SKEW
) -> DataFrame:
    """Adds ``section``: the latest header at or above each line; ``header`` is NULL on other lines."""
    return running(lines, keys, order, [Run("section", "last", header, prior=False)], skew)


def lookup_across_sections(
    tagged: DataFrame, keys: list[str], ident: Column, first: str, second: str, text: str = "line"
) -> DataFrame:
    """Lines of section ``first`` next to the line of ``second`` that carries the same id."""
    body = tagged.withColumn("_id", ident).where(F.col("_id").isNotNull())
    a = body.where(F.col("section") == first).select(*keys, "_id", F.col(text).alias("left_line"))
    b = body.where(F.col("section") == second).select(*keys, "_id", F.col(text).alias("right_line"))
    return a.join(b, [*keys, "_id"])


def report_lines(df: DataFrame, key: str, stats: list[str]) -> DataFrame:
    """Readable ``name: value`` lines of each row, ordered by ``line_no`` within the key."""
    lines = F.array(
        F.concat(F.lit(f"{key}: "), F.col(key).cast("string")),
        *[F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in stats],
    )
    return df.select(key, F.posexplode(lines).alias("line_no", "line"))
