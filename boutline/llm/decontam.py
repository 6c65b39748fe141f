"""Benchmark decontamination by winnowing.

A shared span counts if it holds ``WINDOW`` = 10 consecutive words of an item (all words of a shorter item). Texts are cut
into grams of ``GRAM`` = 5 words; of every 6 consecutive grams, which 10 words hold, those with the smallest hash are kept
as fingerprints. Equal windows keep equal grams at equal places, so every shared window shows up in a join of
fingerprints, and extending a hit over the words on both sides decides by the words themselves whether it is one. All
grams of a shorter item's length are fingerprints for that item.

Everything runs as DataFrame functions. Fingerprints of documents are rows of their own and meet the items' by hash;
Spark chooses the join by the stored sizes and splits skewed ones. Only documents with a hit have their words looked at
again, around the hit, and a document is one row in every later shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.shared import let, stage

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM  # words that a hit needs beside its gram; also how many further grams a window holds
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in lower case (A-Z only); none of a null text."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def _upto(n: Column) -> Column:
    """0 to n - 1; empty if n is below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive words from the hashes of words."""
    return F.transform(_upto(F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]))


def _winnowed(grams: Column) -> Column:
    """(hash, place, gram size) of each gram that is the smallest of some ``SPAN`` + 1 consecutive ones."""
    least = F.transform(_upto(F.size(grams) - SPAN), lambda i: F.least(*[F.get(grams, i + k) for k in range(SPAN + 1)]))

    def chosen(m: Column) -> Column:
        # the largest minimum of the windows around a place equals its gram only if the gram is the smallest of one
        keep = lambda j: F.get(grams, j) == F.greatest(*[F.get(m, j - k) for k in range(SPAN + 1)])
        return F.transform(F.filter(_upto(F.size(grams)), keep), lambda j: _place(F.get(grams, j), j, GRAM))

    return let(least, chosen)


def _place(gram: Column, place: Column, size: int) -> Column:
    return F.struct(gram.alias("h"), place.cast("int").alias("at"), F.lit(size).alias("size"))


def _all_places(words: Column, sizes: list[int]) -> Column:
    """Fingerprints of a text: winnowed grams, and every gram of the ``sizes`` of short items."""

    def every(hashes: Column, size: int) -> Column:
        return F.transform(_grams(hashes, size), lambda g, i: _place(g, i, size))

    def of(hashes: Column) -> Column:
        kinds = [let(_grams(hashes, GRAM), _winnowed)]
        return F.concat(*kinds, *[every(hashes, n) for n in sizes])

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _around(words: Column, places: Column) -> Column:
    """Each place with its gram's words and up to ``SPAN`` words before (nearest first) and behind it; none for a short item's."""

    def one(p: Column) -> Column:
        at, size = p["at"], p["size"]
        beside = F.when(p["short"], F.lit(0)).otherwise(F.lit(SPAN))
        before = F.least(at, beside)
        return F.struct(
            p["h"].alias("h"), at.alias("at"), size.alias("size"), p["short"].alias("short"), F.slice(words, at + 1, size).alias("gram"),
            F.reverse(F.slice(words, at - before + 1, before)).alias("left"), F.slice(words, at + size + 1, beside).alias("right"),
        )

    return F.transform(places, one)


def _equal_from_start(a: Column, b: Column) -> Column:
    """How many elements two short lists share from their start."""
    same = lambda i: F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
    total = F.lit(0)
    for i in reversed(range(SPAN)):
        total = F.when(same(i), total + 1).otherwise(F.lit(0))
    return total


class Benchmark:
    """Fingerprints of the items, stored; the driver only learns the lengths of items shorter than a window."""

    def __init__(self, items: DataFrame):
        own = items.select("item_id", F.explode(F.array(words_of(F.col("text")))).alias("words"))
        listed = stage(own.where(F.size("words") > 0))
        short = listed.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct()
        self.sizes = sorted(r["n"] for r in short.collect())  # at most WINDOW - 1 numbers
        n = F.size("words")
        mine = F.when(n >= WINDOW, F.transform(_all_places(F.col("words"), []), lambda p: _with_short(p, False)))
        for size in self.sizes:
            whole = F.xxhash64(F.lit(size), *[F.xxhash64(F.get("words", F.lit(k))) for k in range(size)])
            mine = mine.when(n == size, F.array(_with_short(_place(whole, F.lit(0), size), True)))
        spots = listed.select("item_id", F.explode(_around(F.col("words"), mine)).alias("p")).select("item_id", "p.*").drop("at")
        kind = ["h", "size", "short", "gram", "left", "right"]
        # items that share a passage share its spots: each is matched once, by its number
        told = stage(spots.distinct())
        self.spots = stage(told.select(*kind).distinct().withColumn("spot", F.monotonically_increasing_id()))
        self.items = stage(told.join(self.spots, kind).select("spot", "item_id"))
        self.hashes = stage(self.spots.select("h", "size", "short").distinct())


def _with_short(place: Column, short: bool) -> Column:
    return F.struct(place["h"].alias("h"), place["at"].alias("at"), place["size"].alias("size"), F.lit(short).alias("short"))


def hits(rows: DataFrame, benchmark: Benchmark) -> DataFrame:
    """Where windows of items occur: row, first word, end, spot. ``rows`` has row, text and places, see ``contamination``."""
    places = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    met = places.join(benchmark.hashes, ["h", "size"])
    found = met.groupBy("row").agg(F.collect_list(F.struct("h", "at", "size", "short")).alias("met"))  # at most the places of a text
    near = found.join(rows.select("row", "text"), "row").select(
        "row", F.explode(let(words_of(F.col("text")), lambda w: _around(w, F.col("met")))).alias("p")
    )
    near = near.select("row", "p.*").withColumnsRenamed({"left": "own_left", "right": "own_right"})
    both = near.join(benchmark.spots, ["h", "size", "short", "gram"])
    both = both.withColumns({"before": _equal_from_start(F.col("own_left"), F.col("left")), "behind": _equal_from_start(F.col("own_right"), F.col("right"))})
    true = both.where(F.col("short") | (F.col("before") + F.col("behind") >= SPAN))
    return true.select("row", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("size") + F.col("behind")).alias("end"), "spot")


def _covered(spans: Column) -> Column:
    """Words inside at least one of the spans (start, end), which come by start."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda s, x: F.struct(
        F.greatest(s["last"], x["end"]).alias("last"), (s["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["last"], x["start"]))).alias("total")
    )
    return F.aggregate(spans, start, step, lambda s: s["total"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): n_words, n_hit, spans (start, end of hits, as words), n_items and item_ids.

    Null texts and texts without words have no hits; items without words are none. Repeated rows of documents are rows of
    their own, rows of one item_id count as one item with the windows of all, and an item without an id hits words but
    is not listed. ``item_ids`` are strings in order. Other columns of both tables are not looked at, so their names may
    be any; very long texts are one row each and are looked at whole. Empty tables give no rows, or documents without hits.
    """
    benchmark = Benchmark(items)
    own = docs.select("doc_id", "text", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    rows = stage(
        own.select(
            F.monotonically_increasing_id().alias("row"),  # fixed once it is stored
            "doc_id", "text", F.size("words").cast("long").alias("n_words"), _all_places(F.col("words"), benchmark.sizes).alias("places"),
        )
    )
    found = stage(hits(rows, benchmark))
    spans = found.select("row", "start", "end").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = found.select("row", "spot").distinct().join(benchmark.items, "spot").where("item_id IS NOT NULL").select("row", F.col("item_id").cast("string").alias("item"))
    listed = named.distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = rows.select("row", "doc_id", "n_words").join(spans, "row", "left").join(listed, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])).alias(c)
    out = out.select("doc_id", "n_words", none("spans"), none("item_ids"))
    return out.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", F.size("item_ids").cast("long").alias("n_items"), "item_ids")

