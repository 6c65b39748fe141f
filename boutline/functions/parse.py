"""Column expressions that turn scraped text into typed values; bad input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: date formats seen in the sources
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "MMM. d, yyyy", "MMM d yyyy", "MMMM d yyyy", "yyyy-MM-dd")
# fixed values: accented letters and their plain forms
ACCENTED = "éáęîří"
PLAIN = "eaeiri"

MINUS_SIGN = "−"
RATIO_MARK, CLOCK_MARK = " of ", ":"


def _group(c: Column, pattern: str, idx: int, kind: str) -> Column:
    return F.regexp_extract(c, pattern, idx).try_cast(kind)


def is_ratio(c: Column) -> Column:
    return c.contains(RATIO_MARK)


def looks_like_ratio(c: Column) -> Column:
    return c.rlike(r"^\s*\d+ of \d+\s*$")


def looks_like_clock(c: Column) -> Column:
    return c.rlike(r"^\s*\d+:\d+\s*$")


def is_clock(c: Column) -> Column:
    return c.contains(CLOCK_MARK)


def _before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1).try_cast("double")


def _after(c: Column, mark: str) -> Column:
    """Number behind the first mark; NULL when there is no mark or more than one."""
    rest = F.substr(c, F.instr(c, mark) + F.lit(len(mark)))
    return F.when(F.instr(c, mark) > 0, rest.try_cast("double"))


def ratio_landed(c: Column) -> Column:
    """x of ``x of y``; a plain number stays as it is."""
    return _before(c, RATIO_MARK)


def ratio_share(c: Column) -> Column:
    tried = _after(c, RATIO_MARK)
    share = F.when(tried == 0, F.lit(0.0)).otherwise(_before(c, RATIO_MARK) / tried)
    return F.when(is_ratio(c), share).otherwise(c.try_cast("double"))


def clock_minutes(c: Column) -> Column:
    """Minutes of ``m:ss``; a plain number stays as it is."""
    whole = (_before(c, CLOCK_MARK) * 60 + _after(c, CLOCK_MARK)) / 60
    return F.when(is_clock(c), whole).otherwise(c.try_cast("double"))


def bout_minutes(round_no: Column, minutes: Column, round_length: int = 5) -> Column:
    return (round_no.cast("double") - 1) * round_length + minutes


def any_date(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"^(Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,? ", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def height_inches(c: Column) -> Column:
    pat = r"(\d+)' *(\d+)\""
    return _group(c, pat, 1, "int") * 12 + _group(c, pat, 2, "int")


def first_int(c: Column) -> Column:
    return _group(c, r"(\d+)", 1, "int")


def lenient_number(c: Column) -> Column:
    head = F.split(c, " ", 2).getItem(0)
    plain = F.regexp_replace(head, "%", "").try_cast("double")
    return F.coalesce(F.when(head.contains("%"), plain / 100.0).otherwise(plain), F.lit(0.0))


def record_part(c: Column, idx: int) -> Column:
    """1 = wins, 2 = losses, 3 = draws of ``W-L-D (n NC)``."""
    return _group(c, r"^\s*(\d+)-(\d+)-(\d+)", idx, "int")


def plain_name(c: Column) -> Column:
    return F.trim(F.translate(c, ACCENTED, PLAIN))


def odds_int(c: Column) -> Column:
    return F.nullif(F.replace(F.trim(c), F.lit(MINUS_SIGN), F.lit("-")), F.lit("-")).try_cast("int")


def sentinel_null(c: Column, *marks: str) -> Column:
    return F.when(c.isin(*(marks or ("--", "---", ""))), F.lit(None)).otherwise(c)


def label_code(c: Column) -> Column:
    """Class codes in alphabetical order: loss 0, win 1."""
    return F.when(c == "loss", F.lit(0)).when(c == "win", F.lit(1))


def label_name(c: Column) -> Column:
    return F.when(c == 0, F.lit("loss")).when(c == 1, F.lit("win"))
