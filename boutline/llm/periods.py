"""Periodic runs of words inside a text, by seed-and-extend on diagonals.

A run is a maximal stretch of words with smallest period q (words q apart are equal) and at least max(24, 3 * q) words.
Words q apart agree at max(24 - q, 2 * q) places or more, so a run holds two equal k-grams q apart for every k up to
that: k = 16 serves all periods to 16, and k = 32, 64, ... serve the periods in (k / 2, k]. As k is no smaller than the
period, the nearest later occurrence of such a gram lies exactly one smallest period away (a nearer one would give the
run a shorter period). So only neighbouring occurrences are looked at, never all pairs of a repeated gram.

Texts are independent rows; Spark deals them to tasks, and a task works on a few megabytes of words at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutline.llm.shared import SPACE, fresh, let, text_of
from boutline.llm.tokens import slices

LEAST_WORDS = 24
LEAST_TURNS = 3
SEED = 16  # the fewest agreeing places of any run: 24 - 8 = 2 * 8
STEP = 64  # words compared at once when a seed is extended; doubled as long as all agree

FOUND = T.StructType(
    [
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
        T.StructField("collapsed", T.StringType()),
    ]
)


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each value among the distinct ones, and whether it occurs again."""
    _, rank, times = np.unique(codes, return_inverse=True, return_counts=True)
    return rank, times[rank] > 1


def _seeds(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, starts, lags) of neighbouring equal k-grams whose lag is one that k serves.

    A 2k-gram occurs again only if both its halves do, so every doubling looks at fewer places.
    """
    n = len(words)
    rank, again = _ranks(words)
    at, rank = np.flatnonzero(again), rank[again]
    k = 1
    while len(at):
        if k >= SEED:
            order = np.argsort(rank, kind="stable")  # places stay in order within a gram
            here, gram = at[order], rank[order]
            lag = np.diff(here)
            good = (np.diff(gram) == 0) & (lag <= k)
            if k > SEED:
                good &= lag > k // 2
            yield k, here[:-1][good], lag[good]
        known = np.full(n, -1, np.int64)
        known[at] = rank
        at = at[at + k < n]
        first, second = known[at], known[at + k]
        both = second >= 0
        at = at[both]
        rank, again = _ranks(first[both] * n + second[both])
        at, rank = at[again], rank[again]
        k *= 2


def _agree(words: np.ndarray, start: int, lag: int, step: int) -> int:
    """How many places from ``start`` on (backwards if ``step`` is -1) equal the place ``lag`` later."""
    n, size, total = len(words), STEP, 0
    while True:
        if step > 0:
            a, b = start + total, min(start + total + size, n - lag)
        else:
            a, b = max(start - total - size + 1, 0), start - total + 1
        if a >= b:
            return total
        same = words[a:b] == words[a + lag : b + lag]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return total + int(np.argmin(same))
        total += b - a
        size *= 2


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period. ``words`` are numbers; equal ones are equal words."""
    found = []
    for k, starts, lags in _seeds(words):
        order = np.lexsort((starts, lags))
        starts, lags = starts[order], lags[order]
        head = np.ones(len(starts), bool)  # seeds one word apart with one lag belong to one stretch
        head[1:] = (np.diff(starts) != 1) | (np.diff(lags) != 0)
        covered: dict[int, int] = {}  # per lag, the end of the furthest stretch seen
        for i, lag in zip(starts[head].tolist(), lags[head].tolist(), strict=True):
            if i < covered.get(lag, 0):
                continue
            end = i + k + _agree(words, i + k, lag, 1)
            start = i - _agree(words, i - 1, lag, -1)
            covered[lag] = end
            length = end + lag - start
            if length >= max(LEAST_WORDS, LEAST_TURNS * lag):
                found.append((start, length, lag))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _found(texts: pa.Array) -> pa.Array:
    """One struct of ``FOUND`` per text."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [t.split() for t in pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()]  # bytes: ASCII white space only
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    plain = np.fromiter((number[w] for words in split for w in words), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(split)), sizes)
    runs = runs_of(plain + text * max(1, len(number)))  # words of different texts never agree
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    edge = np.zeros(len(plain) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    repeated = set(owner.tolist())
    collapsed = [
        b" ".join(compress(words, kept[end - len(words) : end].tolist()) if i in repeated else words)
        for i, (words, end) in enumerate(zip(split, ends.tolist(), strict=True))
    ]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(split)))]).astype(np.int32)
    fields = [runs[:, 0] - (ends - sizes)[owner], runs[:, 1], runs[:, 2]]
    rows = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(bounds), rows)
    return pa.StructArray.from_arrays([lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["runs", "collapsed"])


def with_runs(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with one more column at the end: a struct of all ``runs`` and the ``collapsed`` text.

    Words are what ASCII white space parts. ``runs`` has start (word number), length and period, by start, then period;
    ``collapsed`` is the text without the words that a run holds after its first period, joined by one space. A null,
    empty or blank text has no runs and collapses to the empty text. Rows are handled one by one: repeated rows, null
    ids and extra columns of any name come back as they are, an empty table gives an empty table, and a very long text
    is worked on alone.
    """
    (name,) = fresh(docs, "periodic")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, _found(part.column(column))], [*part.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, FOUND)]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` whose every tenth text (by the CRC of its id) is made periodic from some word on.

    With h the CRC-32 of the decimal doc_id and g = h div 10, a text of n > 0 words with h % 10 = 0 keeps its first
    a = g % n words; from there on, its next p = 1 + (n - a) div (3 + g % 8) words repeat to the end. Texts without an
    id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_of(), SPACE), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(
            let(
                F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")),
                lambda s: F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, s["a"] + (i - s["a"]) % s["p"]))),
            ),
            " ",
        )

    changed = let(words, lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period (compared exactly), then smallest start, then period; null without runs."""

    def better(best: Column, r: Column) -> Column:
        mine, theirs = r["length"] * best["period"], best["length"] * r["period"]
        return best.isNull() | (mine > theirs)  # runs come by start, then period, so ties leave the first

    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def spelled(runs: Column) -> Column:
    """``start,length,period`` and a line end for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
