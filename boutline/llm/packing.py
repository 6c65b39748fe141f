"""Best-two-fit packing of token documents into sequences.

Packing depends on lengths only, so it is solved on a histogram with one entry per length: a bin is filled greedily with
the longest documents that fit, then its smallest is exchanged for two unpacked ones that fill the gap more tightly. A
pattern found this way is used as often as the counts allow, hence the solver's work is bounded by the sequence length
and not by the number of documents. Documents find their place by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.shared import prefix_sums, segment_count, stage
from boutline.llm.tokens import encode_documents, encoder, slices

PART_BYTES = 4 << 20  # text encoded at once: its pieces and ids take some 25 times as much


def cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents: all of ``most`` ids but the first, which has the rest."""
    n = -(-lengths // most)
    doc = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    head = lengths - (n - 1) * most
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * most)
    return doc, piece, start, np.where(piece == 0, head[doc], most)


def cut_documents(docs: DataFrame, most: int = 1024, vocabulary: str = "byte_bpe_50k.json", leading: bool = True, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids (32-bit, little-endian).

    A null text is empty and consists of its end id. Repeated rows are documents of their own.
    """
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "key": pa.int64()}
    form = pa.schema([*kinds.items(), *([("ids", pa.binary())] if with_ids else [])])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, leading)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                ids, counts = encode_documents(part, coder)
                doc, piece, start, length = cut(counts, most)
                at = np.cumsum(length) - length
                data = memoryview(ids.astype("<u4").tobytes())
                runs = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                take = pa.array(doc)
                cols = [part.column("doc_id").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(r) for r in runs], pa.int64()), part.column("key").take(take)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([bytes(r) for r in runs], pa.binary())] if with_ids else []), schema=form)

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, key long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(encode, schema)


def best_two_fit(counts: dict[int, int], most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ((length, times), ... longest first) and how many sequences use each, for ``counts`` documents per length."""
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    plan = []
    while sizes:
        used: dict[int, int] = {}
        gap = most
        free = lambda n: left[n] - used.get(n, 0)
        while gap:
            i = bisect_right(sizes, gap) - 1
            while i >= 0 and not free(sizes[i]):
                i -= 1
            if i < 0:
                break
            n = sizes[i]
            times = min(free(n), gap // n)
            used[n] = used.get(n, 0) + times
            gap -= times * n
        if gap and sum(used.values()) > 1:
            small = min(used)
            room = gap + small
            best, pair = small, None
            lo, hi = 0, bisect_right(sizes, room) - 1
            open_ = [n for n in sizes[: hi + 1] if free(n) > 0]
            lo, hi = 0, len(open_) - 1
            while lo <= hi:
                a, b = open_[lo], open_[hi]
                if a + b > room or (lo == hi and free(a) < 2):
                    hi -= 1
                    continue
                if a + b > best:
                    best, pair = a + b, (a, b)
                lo += 1
            if pair:
                used[small] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
        pattern = sorted(((n, k) for n, k in used.items() if k), reverse=True)
        times = min(left[n] // k for n, k in pattern)
        plan.append((pattern, times))
        for n, k in pattern:
            left[n] -= times * k
        sizes = [n for n in sizes if left[n]]
    return plan


def pack(pieces: DataFrame, most: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length, key, ...) with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Pieces have 1 to ``most`` tokens. Equal lengths take their places by doc_id (null ids too), piece and key; repeated
    rows take a place each; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``most`` rows
    ranges, taken, first = [], dict.fromkeys(counted, 0), 0
    for pattern, times in best_two_fit(counted, most):
        at = 0
        for n, k in pattern:
            ranges.append((n, taken[n], taken[n] + k * times, k, first, at))
            taken[n] += k * times
            at += k * n
        first += times
    places = spark.createDataFrame(ranges, "length long, lo long, hi long, per int, first long, at long")
    lines = pieces.withColumn("seg", F.pmod(F.xxhash64("key", "piece"), F.lit(segment_count(sum(counted.values())))))
    lines = lines.withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(lines, ["length"], "seg", ["doc_id", "piece", "key"], "one", "rank").drop("seg", "one")
    # the ranges depend on the sequence length only: some thousand rows
    placed = ranked.join(F.broadcast(places), "length").where("rank >= lo AND rank < hi")
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(rank - lo) div per"))
    placed = placed.withColumn("offset", F.col("at") + F.expr("(rank - lo) % per") * F.col("length"))
    return placed.drop("rank", "lo", "hi", "per", "first", "at")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from packed pieces with ids: sequence_id, length and ids (32-bit, little-endian)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))  # at most as many as a sequence has ids
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    join = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"]).alias("length"), join.alias("ids"))


def packed_documents(docs: DataFrame, most: int = 1024) -> DataFrame:
    """One row per piece of ``docs`` with its place; the pieces (numbers only) are stored once in between.

    Null and empty texts are one piece, their end id; long ones are cut as ``cut_documents`` says; repeated rows are
    packed each for itself; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    out = pack(stage(cut_documents(docs, most)), most)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
