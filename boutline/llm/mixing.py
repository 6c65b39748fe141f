"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The golden-ratio sequence, in whole numbers modulo 2**31, gives every slot a point (with more slots than points, each
point is cut into as many as needed, see ``points_of``); the point's place among the
cumulative weights names the slot's source; the slot's rank among the slots of its source names a block of that
source. Blocks are equal runs of words on a line that holds the documents of a source in hashed order. Everything is
expressed with DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.shared import WORD, prefix_sums, same, segment_count, stage

POINTS = 2**31
GOLDEN = 1327217885  # the odd whole number next to 2**31 / 1.618...
CELL_BITS = 19  # points are looked up by their upper 12 bits
MARGIN = 16  # slots beyond the need of each source; covers the sequence's discrepancy


@dataclass
class Mix:
    """``sources``: one row per source; ``pieces``: documents cut at block bounds; ``slots``: the schedule."""

    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame
    empty: DataFrame

    def rows(self) -> DataFrame:
        """The mix itself: slot, source, document, first word and number of words taken from it, in slot order if sorted."""
        return self._joined("inner").where("words > 0").select("slot", "source", "doc_id", "first_word", "words")

    def taken(self) -> DataFrame:
        """Per document: its words in the mix, repeats counted."""
        per = (
            self._joined("left")
            .groupBy("sid", "start", "doc_id", "key", "size", "source_size", "target")
            .agg(F.sum(F.coalesce("words", F.lit(0))).cast("long").alias("taken"))
            .select("doc_id", "key", "size", "source_size", "target", "taken", "sid")
        )
        return per.unionByName(self.empty.withColumn("taken", F.lit(0).cast("long")).select(*per.columns))

    def _joined(self, how: str) -> DataFrame:
        p, s = self.pieces, self.slots
        end = F.least(F.col("offset") + F.col("length"), F.coalesce("slot_words", F.lit(0)))  # no slot: nothing taken
        return p.join(s, ["sid", "block"], how).withColumn("words", F.greatest(F.lit(0), end - F.col("offset")))


def source_targets(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Per source: number, size, weight and target; a target stops at ``cap`` times the size and its excess is shared anew.

    Sources in order of size limit per weight: the first ones hit their limit, and what is left is shared by weight.
    The table has one row per source, so its windows have no key.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w_id, w_all = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("_ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = (
        per.withColumn("sid", F.row_number().over(w_id))
        .withColumn("weight", F.element_at(kinds, F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
        .withColumn("_limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_limit") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(w_all) * F.lit(float(share)))
        .withColumn("_level", (F.col("_total") - before("_limit")) / (F.sum("weight").over(w_all) - before("weight")))
        .withColumn("_full", F.col("_ratio") <= F.col("_level"))
        .withColumn("_rest", F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0.0)).over(w_all))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(w_all))
    )
    shared = F.when(F.col("_open") > 0, F.col("weight") * F.col("_rest") / F.col("_open"))
    return per.withColumn("target", F.when(F.col("_full"), F.col("_limit")).otherwise(F.least(F.col("_limit"), shared))).select(
        "source", "sid", "source_size", "weight", "target"
    )


def finer_bits(n_slots: int) -> int:
    """Bits that each of ``POINTS`` points is cut by, so that no two slots share a point (at most 2**62 slots)."""
    return max(0, (max(1, n_slots) - 1).bit_length() - (POINTS - 1).bit_length())


def points_of(slot: str, bits: int) -> Column:
    """Distinct points below ``POINTS`` * 2**bits: rounds of the golden-ratio sequence, each at its own fine place."""
    coarse, cuts = (F.col(slot) % POINTS) * GOLDEN % POINTS, 1 << bits
    return coarse * F.lit(cuts) + F.expr(f"{slot} div {POINTS}") * F.lit(GOLDEN % cuts | 1) % F.lit(cuts)


def mix(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), block: int = 256, seed: int = 7
) -> Mix:
    """Schedules ``docs`` (doc_id, text, source) so that sources meet their targets.

    Null texts have size 0, null sources form the last source, documents without words are in no block, repeated rows
    are separate documents, an empty table gives an empty mix. The last block of a source's quota is cut to the word, so
    a source takes the whole-number part of its target exactly and no document more than ``cap`` (at most 2) times its
    size.
    """
    spark = docs.sparkSession
    sized = stage(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("text").alias("key"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"),
        )
    )
    rows = sized.count()
    e = F.lit(block)
    quota = F.floor("target")
    spare = F.when(F.col("source_size") > 0, F.expr("(quota div source_size) * pass_blocks") + F.ceil((F.expr("quota % source_size")) / e)).otherwise(0)
    sources = (
        source_targets(sized, share, cap, weights)
        .withColumn("quota", quota)
        .withColumn("pass_blocks", F.ceil(F.col("source_size") / e))
        .withColumn("need", spare.cast("long"))
    )
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.withColumn("_want", F.when(F.col("need") > 0, F.col("need") + MARGIN).otherwise(0)).withColumn("_cum", F.sum("_want").over(upto))
    sources = stage(sources)
    n_slots = sources.agg(F.max("_cum")).first()[0] or 0
    bits = finer_bits(n_slots)
    point = lambda c: F.expr(f"CAST((CAST({c} AS DECIMAL(19, 0)) * {POINTS << bits}) div {max(1, n_slots)} AS BIGINT)")
    cells = (
        sources.where("need > 0")
        .withColumn("lo", point("_cum - _want"))
        .withColumn("hi", point("_cum"))
        .withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS + bits), F.shiftright(F.col("hi") - 1, CELL_BITS + bits))))
        .select("cell", "lo", "hi", "sid", "quota", "pass_blocks", "need", F.col("source_size").alias("_size"))
    )
    chunk = max(1024, n_slots // 65536)
    have = F.when(F.col("have") < F.col("need"), F.raise_error(F.lit("too few slots for a source"))).otherwise(F.col("have"))
    slots = (
        spark.range(n_slots)
        .withColumnRenamed("id", "slot")
        .withColumn("u", points_of("slot", bits))
        .withColumn("cell", F.shiftright("u", CELL_BITS + bits))
        .join(cells, "cell")
        .where("u >= lo AND u < hi")
        .withColumn("chunk", F.expr(f"slot div {chunk}"))
        .withColumn("one", F.lit(1).cast("long"))
    )
    # a source has some slots more than it needs: they are left out evenly over the schedule
    counted = slots.groupBy("sid", "need").agg(F.sum("one").alias("have")).select("sid", have.alias("have"))
    ranked = prefix_sums(slots, ["sid"], "chunk", ["slot"], "one", "_rank").join(counted, "sid")
    nth = lambda r: F.expr(f"CAST((CAST({r} AS DECIMAL(19, 0)) * CAST(need AS DECIMAL(19, 0))) div have AS BIGINT)")
    slots = ranked.withColumn("rank", nth("_rank")).where(F.col("rank") < nth("(_rank + 1)"))
    slots = (
        slots.withColumn("block", F.expr("rank % pass_blocks"))
        .withColumn("_before", F.expr("rank div pass_blocks") * F.col("_size") + F.col("block") * block)
        .withColumn("slot_words", F.least(e, F.col("quota") - F.col("_before")))
        .select("slot", "sid", "rank", "block", "slot_words")
    )
    known = sized.join(sources, same(sized, sources, ["source"], ["source"])).select(
        sized["doc_id"], sized["key"], sized["size"], sized["_h"], sources["source"], "sid", "source_size", "target"
    )
    lines = known.where("size > 0").withColumn("seg", F.pmod("_h", F.lit(segment_count(rows))))
    lines = prefix_sums(lines, ["sid"], "seg", ["_h", "doc_id", "size"], "size", "start")
    pieces = (
        lines.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        .withColumn("_from", F.greatest(F.col("start"), F.col("block") * block))
        .withColumn("offset", F.col("_from") - F.col("block") * block)
        .withColumn("length", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("_from"))
        .withColumn("first_word", F.col("_from") - F.col("start"))
        .select("sid", "source", "block", "offset", "length", "first_word", "start", "doc_id", "key", "size", "source_size", "target")
    )
    return Mix(sources, pieces, slots, known.where("size = 0").select("doc_id", "key", "size", "source_size", "target", "sid"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Whole documents of the mix: a document comes as often as its words were taken, to the nearest whole number.

    Rows that equal each other in id and text share what they take. Documents without words are in no mix.
    """
    per = (
        mix(docs)
        .taken()
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "sid")
        .agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
        .groupBy("_id", "_key")
        .agg(F.expr("sum(2 * _taken + _size) div greatest(1, 2 * sum(_size))").alias("_copies"))
        .where("_copies > 0")
    )
    cond = docs["doc_id"].eqNullSafe(per["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(per["_key"])
    out = docs.join(per, cond).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*[docs[c] for c in docs.columns])
