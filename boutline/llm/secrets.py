"""Secret scans: patterns of single secrets, and weak parts that count only when complementary parts stand nearby.

Key identifiers, key-like strings and endpoints are weak by themselves. An interval join within a document links an
identifier with a secret when their scopes overlap, and an endpoint with a secret linked so; what is linked is added to
the spans of the patterns. Everything is expressed with DataFrame functions; positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.shared import fresh, let, stage, text_of

_VALUE = "([A-Za-z0-9+/_.=-]+)"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?""" + _VALUE
ACCESS = r"AKIA[A-Z0-9]{16,}"  # whole runs of 20 and more, as a run is matched from its start
HEX = r"[0-9a-f]{24,}"
WEAK_ID = r"""((?i:access_?key_?id|client_?id|key_?id|account_?id|app_?id|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})"""
WEAK_KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40,}+={0,2}+(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?i:https?|wss?|amqps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|s3|ftp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}"
BASE = ["assign", "access", "hex"]
ADDED = ["key_id", "key_string", "endpoint"]
SCOPE = 200  # code points around a part in which its complement must lie
SPAN = "struct<start:int,end:int,kind:int>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Leftmost matches that do not overlap: what the pattern finds, placed by what it leaves between them."""
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column, between: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(between, i))
            end = start + F.length(F.get(found, i))
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
            more = F.concat(acc["spans"], F.array(span))
            return F.struct(end.alias("at"), (more if keep is None else F.when(keep(F.get(found, i)), more).otherwise(acc["spans"])).alias("spans"))

        begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda acc: acc["spans"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda g: placed(m, g))))


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def _sorted(spans: Column) -> Column:
    """By start, then kind as listed."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def spelled(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, BASE + ADDED))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, th (hash of the text), ``base`` spans and ``spans`` (with linked parts).

    Null texts are empty. Repeated rows are scanned as one and listed as often as they come; an empty table gives none.
    """
    text = F.col("_text")
    base = F.concat(_spans(text, ASSIGN, 0, _long_value), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    weak = F.concat(_spans(text, WEAK_ID, 3), _spans(text, WEAK_KEY, 4), _spans(text, ENDPOINT, 5))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), text_of().alias("_text"))
    rows = stage(rows.select("doc_id", "th", base.alias("base"), weak.alias("weak")))
    key = [F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("th").alias("k3")]
    rows = rows.select("*", *key)
    keys = ["k1", "k2", "k3"]
    inside = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] <= w["start"]) & (w["end"] <= b["end"])))
    some = rows.where("size(weak) > 0").select(*keys, F.explode(F.concat("base", inside)).alias("s")).select(*keys, "s.*").distinct()
    width = 2 * SCOPE

    def part(kinds: list[int], reach: int, name: str) -> DataFrame:
        cells = F.sequence(F.expr(f"(start - {reach}) div {width}"), F.expr(f"(end + {reach}) div {width}"))
        return some.where(F.col("kind").isin(kinds)).select(*keys, F.explode(cells).alias("cell"), F.struct("start", "end", "kind").alias(name))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        """Parts whose scopes overlap; cells as wide as a scope keep the join from pairing distant parts."""
        near = (F.col("x.start") < F.col("y.end") + SCOPE) & (F.col("y.start") < F.col("x.end") + SCOPE) & (F.col("x") != F.col("y"))
        return a.join(b, [*keys, "cell"]).where(near).select(*keys, "x", "y").distinct()

    pairs = meet(part([1, 3], 0, "x"), part([0, 2, 4], SCOPE, "y"))
    linked = pairs.select(*keys, F.col("x").alias("s")).unionByName(pairs.select(*keys, F.col("y").alias("s"))).distinct()
    near = linked.where("s.kind IN (0, 2, 4)").select(*keys, F.explode(F.sequence(F.expr(f"(s.start - {SCOPE}) div {width}"), F.expr(f"(s.end + {SCOPE}) div {width}"))).alias("cell"), F.col("s").alias("y"))
    ends = meet(part([5], 0, "x"), near).select(*keys, F.col("x").alias("s")).distinct()
    added = linked.where("s.kind > 2").unionByName(ends).groupBy(*keys).agg(F.collect_list("s").alias("added"))
    none = F.array().cast(f"array<{SPAN}>")
    out = rows.join(added, keys, "left")
    return out.select("doc_id", "th", _sorted(F.col("base")).alias("base"), _sorted(F.concat("base", F.coalesce("added", none))).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, and ``n_chars`` counted anew where there is one.

    Overlapping spans get one mark. Texts without a span, null and empty ones among them, stay as they are; long texts
    are scanned whole; repeated rows stay; an empty table gives no rows. Columns of any name keep their values.
    """
    found = scan(docs).where("size(spans) > 0").select("doc_id", "th", "spans").distinct()
    found = found.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("th").alias("k3"), "spans")
    named = {"k1": F.coalesce(docs["doc_id"], F.lit(0)), "k2": docs["doc_id"].isNull(), "k3": F.xxhash64(docs["text"])}
    (text,) = fresh(docs, "clean_text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in named.items()]).join(found, ["k1", "k2", "k3"], "left")

    def step(acc: Column, s: Column) -> Column:
        """Overlapping spans merge: one that begins inside what is gone adds no mark."""
        whole = F.col("row.text")
        gap = F.substring(whole, acc["at"] + 1, s["start"] - acc["at"])
        said = F.when(s["start"] >= acc["at"], F.concat(acc["said"], gap, F.lit(mark))).otherwise(acc["said"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), said.alias("said"))

    rest = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("said")), step, lambda acc: F.concat(acc["said"], F.substring(F.col("row.text"), acc["at"] + 1, F.length("row.text"))))
    rows = rows.withColumn(text, F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(rest))
    at = {c.lower(): c for c in docs.columns}
    cols = []
    for c in docs.columns:
        if c == at["text"]:
            cols.append(F.col(text).alias(c))
        elif c == at.get("n_chars"):
            cols.append(F.when(F.col("spans").isNull(), F.col("row")[c]).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return rows.select(*cols)
