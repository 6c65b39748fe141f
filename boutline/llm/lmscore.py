"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Counts follow the corpus and are never gathered in one place. Documents are read in packs; a pack asks for the counts of
its distinct words and bigrams, each question going to the task that its hash names. Such a task adds up what all packs
report of its n-grams and answers every pack in the order of its questions, so answers carry no keys. With its answers a
pack has all counts of its own tokens; weights of the three estimates, one set per bucket of context frequency, come
from expectation-maximisation over held-out training documents, whose counts are left out for that.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.shared import discard, shared_folder, stage
from boutline.llm.tokens import slices

FOLDS, SCORED_FOLD, WEIGHT_FOLD = 7, 2, 3  # documents by crc32 of their id: not learned from; left out for the weights
END, BEGIN = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b" ")  # no word holds white space
TARGET_BYTES = 16 << 20  # text per counting task
PACK_BYTES = 4 << 20  # text per pack; what a pack holds in memory is about thirty times that
GRID = 4  # steps per doubling of the probabilities from which weights are learned
STREAM, WORDS, PAIRS, SOLVED, GRID_ROW, SUMS = range(6)
ROW = "pack long, kind int, target int, data binary, extra binary, x long, y long"
FORM = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("target", pa.int32()), ("data", pa.binary()), ("extra", pa.binary()), ("x", pa.int64()), ("y", pa.int64())])


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return struct.pack("<BQ", values.itemsize, len(values)) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _open(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Pack:
    """Tokens of some documents by place among the pack's distinct words and bigrams; words are sorted by hash."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
        """``codes``: places of all tokens in ``hashes``, each document closed by the end; ``sizes``: tokens per document."""
        self.codes, self.sizes, self.hashes = codes, sizes, hashes
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[np.cumsum(sizes) - sizes] = np.searchsorted(hashes, np.uint64(BEGIN))
        self.before = before
        both = before.astype(np.int64) * len(hashes) + codes
        self.pairs, self.pair_of = np.unique(both, return_inverse=True)

    def questions(self, targets: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Keys and tasks of words (64 bits) and bigrams (48 bits within a task)."""
        pair = _mix(self.hashes[self.pairs // len(self.hashes)], self.hashes[self.pairs % len(self.hashes)])
        of = lambda h: (h % np.uint64(targets)).astype(np.int64)
        return (self.hashes, of(self.hashes)), (pair >> np.uint64(16), of(pair))


def _pack_of(texts: pa.Array) -> Pack:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    counted = np.concatenate([[0], np.cumsum(full)])
    sizes = np.diff(counted[bounds])
    coded = words.filter(pa.array(full)).dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    hashes = np.concatenate([hashes, np.array([END, BEGIN], np.uint64)])
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    codes = place[np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(sizes), len(names))]
    return Pack(codes, sizes + 1, hashes[order])


def _order(keys: np.ndarray, tasks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of task and key; the tasks and where their runs begin."""
    order = np.lexsort((keys, tasks))
    found, begin = np.unique(tasks[order], return_index=True)
    return order, found, np.append(begin, len(order))


def _ask(batches: Iterator[pa.RecordBatch], targets: int) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        for part in slices(batch, "text", PACK_BYTES):
            pack = _pack_of(pa.concat_arrays([pc.fill_null(part.column("text"), "")]))
            name = (TaskContext.get().partitionId() << 32) + n
            n += 1
            fold = part.column("fold").to_numpy().astype(np.uint32)
            ids = part.column("doc_id")
            flag = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint32)
            docs = np.concatenate([pc.fill_null(ids, 0).to_numpy().view(np.uint32), pack.sizes.astype(np.uint32), fold + FOLDS * flag])
            rows = [(name, STREAM, 0, _squeeze(docs), _squeeze(pack.codes.view(np.uint32)), len(fold), 0)]
            by_token = np.repeat(fold, pack.sizes)
            learned, left_out = by_token != SCORED_FOLD, by_token == WEIGHT_FOLD
            first = np.searchsorted(pack.hashes, np.uint64(BEGIN))
            words, pairs = pack.questions(targets)
            for kind, (keys, tasks), of, size in ((WORDS, words, pack.codes, len(pack.hashes)), (PAIRS, pairs, pack.pair_of, len(pack.pairs))):
                counts = [np.bincount(of[m], minlength=size).astype(np.uint32) for m in (learned, left_out)]
                if kind == WORDS:  # a context, but no token
                    counts[0][first], counts[1][first] = (fold != SCORED_FOLD).sum(), (fold == WEIGHT_FOLD).sum()
                order, found, begin = _order(keys, tasks)
                for t, a, b in zip(found.tolist(), begin, begin[1:], strict=False):
                    at = order[a:b]
                    steps = np.diff(keys[at], prepend=np.uint64(0))
                    rows.append((name, kind, t, _squeeze(steps), _squeeze(np.concatenate([counts[0][at], counts[1][at]])), 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FORM, strict=True)], schema=FORM)


def _answer(table: pa.Table) -> pa.Table:
    """Total counts for every pack's questions to this task, and the task's sums of tokens and distinct words."""
    rows, out = table.to_pylist(), []
    for kind in (WORDS, PAIRS):
        asked = [r for r in rows if r["kind"] == kind]
        if not asked:
            continue
        keys = [np.cumsum(_open(r["data"])) for r in asked]
        counts = [_open(r["extra"]).reshape(2, -1) for r in asked]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(at, np.concatenate([c[i] for c in counts]), len(known)).astype(np.uint64) for i in (0, 1)]
        begin = 0
        for r, k in zip(asked, keys, strict=True):
            mine = at[begin : begin + len(k)]
            begin += len(k)
            out.append((r["pack"], kind, r["target"], _squeeze(np.concatenate([totals[0][mine], totals[1][mine]])), None, 0, 0))
        if kind == WORDS:
            tokens = known != np.uint64(BEGIN)
            for i in (0, 1):
                out.append((-1, SUMS, i, None, None, int(totals[i][tokens].sum()), int((totals[i][tokens] > 0).sum())))
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 7, FORM, strict=True)], schema=FORM)


def bucket(context: np.ndarray) -> np.ndarray:
    """Of a context's count: 0 for none, else 1 more than the whole part of its binary logarithm."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-GRID * np.log2(np.where(p > 0, p, 1.0))), 253) + 1, 0).astype(np.int64)


def _solve(targets: int, all_tokens: int, fold_tokens: int):
    """A pack with its answers: counts of its words and bigrams, and its share of the grid for the weights."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        stream = [r for r in rows if r["kind"] == STREAM]
        keys = {r["target"]: np.cumsum(_open(r["data"])) for r in rows if r["kind"] == WORDS and r["extra"] is not None}
        answers = {(r["kind"], r["target"]): _open(r["data"]) for r in rows if r["extra"] is None}
        if not stream:
            return FORM.empty_table()
        stream = stream[0]
        docs = _open(stream["data"])
        n = len(docs) // 4
        sizes, fold = docs[2 * n : 3 * n].astype(np.int64), docs[3 * n :] % FOLDS
        hashes = np.sort(np.concatenate(list(keys.values())))
        pack = Pack(_open(stream["extra"]).view(np.int32), sizes, hashes)
        words, pairs = pack.questions(targets)
        got = {}
        for kind, (key, tasks) in ((WORDS, words), (PAIRS, pairs)):
            order, found, begin = _order(key, tasks)
            both = np.empty((2, len(key)), np.uint64)
            for t, a, b in zip(found.tolist(), begin, begin[1:], strict=False):
                both[:, order[a:b]] = answers[kind, t].reshape(2, -1)
            got[kind] = both
        held = np.flatnonzero(np.repeat(fold, sizes) == WEIGHT_FOLD)
        one, two = [(g[0] - g[1]).astype(np.float64) for g in (got[WORDS], got[PAIRS])]
        context = one[pack.before[held]]
        p2 = two[pack.pair_of[held]] / np.maximum(context, 1)
        p1 = one[pack.codes[held]] / max(1, all_tokens - fold_tokens)
        cells, times = np.unique((bucket(context) << 16) + (_cell(p2) << 8) + _cell(p1), return_counts=True)
        small = lambda a: _squeeze(a.astype(np.uint32) if a.max(initial=0) < 1 << 32 else a)
        counts = struct.pack("<Q", len(w := small(got[WORDS][0]))) + w + small(got[PAIRS][0])
        first = struct.pack("<I", int(np.searchsorted(hashes, np.uint64(BEGIN)))) + struct.pack("<Q", len(stream["data"])) + stream["data"] + stream["extra"]
        out = [(stream["pack"], SOLVED, 0, first, counts, n, 0)]
        out += [(stream["pack"], GRID_ROW, 0, None, None, c, t) for c, t in zip(cells.tolist(), times.tolist(), strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FORM, strict=True)], schema=FORM)

    return run


def mixture_weights(grid: list[tuple[int, int, int, int]], uniform: float, rounds: int = 50, least: float = 1e-4) -> dict[int, tuple[float, float, float]]:
    """Weights (bigram, unigram, uniform) per bucket from (bucket, bigram cell, unigram cell, tokens), by expectation-maximisation.

    Bucket -1 is over all buckets, for those that the held-out documents do not have.
    """
    back = np.concatenate([[0.0], 2.0 ** (-np.arange(255) / GRID)])
    g = np.array(grid, np.int64).reshape(-1, 4)
    out = {}
    for b in [-1, *np.unique(g[:, 0]).tolist()]:
        mine = g if b < 0 else g[g[:, 0] == b]
        p = np.stack([back[mine[:, 1]], back[mine[:, 2]], np.full(len(mine), uniform)])
        w, n = np.array([0.4, 0.4, 0.2]), mine[:, 3].astype(float)
        for _ in range(rounds if n.sum() else 0):
            share = w[:, None] * p
            w = (share / share.sum(axis=0) * n).sum(axis=1) / n.sum()
            w = np.maximum(w, least)
            w /= w.sum()
        out[b] = tuple(w.tolist())
    return out


def scores(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Documents whose crc32(doc_id) leaves 2 modulo 7 are scored only. Null texts are empty and have one token, their end;
    a null id counts as an empty one; repeated rows are documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold.cast("int").alias("fold"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    targets = max(1, -(-volume // TARGET_BYTES))
    folder = shared_folder(spark, "ngrams")
    rows.mapInArrow(lambda b: _ask(b, targets), ROW).write.partitionBy("kind").parquet(folder)
    schema = "pack long, target int, data binary, extra binary, x long, y long, kind int"
    asked = spark.read.schema(schema).parquet(folder).select(*FORM.names)
    parts = max(targets, int(spark.conf.get("spark.sql.shuffle.partitions")))  # what a task reads does not grow with the corpus
    answers = stage(asked.where(F.col("kind").isin(WORDS, PAIRS)).repartition(parts, "target").groupBy("target").applyInArrow(_answer, ROW))
    discard(spark, f"{folder}/kind={PAIRS}")  # answered
    sums = {r["target"]: (r["n"], r["v"]) for r in answers.where(F.col("kind") == SUMS).groupBy("target").agg(F.sum("x").alias("n"), F.sum("y").alias("v")).collect()}
    (n_all, v_all), (n_fold, _) = sums.get(0, (0, 0)), sums.get(1, (0, 0))
    back = answers.where("kind <> " + str(SUMS)).unionByName(asked.where(F.col("kind").isin(STREAM, WORDS)))
    solved = stage(back.repartition(parts, "pack").groupBy("pack").applyInArrow(_solve(targets, n_all, n_fold), ROW), "kind").select(*FORM.names)
    discard(spark, folder)
    cells = solved.where(F.col("kind") == GRID_ROW).groupBy("x").agg(F.sum("y").alias("n")).collect()  # buckets x 255 x 255 at most
    grid = [(r["x"] >> 16, (r["x"] >> 8) & 255, r["x"] & 255, r["n"]) for r in cells]
    found = mixture_weights(grid, 1.0 / (v_all + 1))
    table = np.array([found.get(b, found[-1]) for b in range(70)])
    form = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first, size = struct.unpack_from("<IQ", r["data"])
                docs, codes = _open(r["data"][12 : 12 + size]), _open(r["data"][12 + size :]).view(np.int32)
                (size,) = struct.unpack_from("<Q", r["extra"])
                one, two = [_open(x).astype(np.float64) for x in (r["extra"][8 : 8 + size], r["extra"][8 + size :])]
                n = len(docs) // 4
                ids, sizes, marks = docs[: 2 * n].view(np.int64), docs[2 * n : 3 * n].astype(np.int64), docs[3 * n :]
                begin = np.cumsum(sizes) - sizes
                before = np.empty_like(codes)
                before[1:] = codes[:-1]
                before[begin] = first
                _, pair_of = np.unique(before.astype(np.int64) * len(one) + codes, return_inverse=True)
                count, context = one[codes], one[before]
                weight = table[bucket(context)]
                p = weight[:, 0] * two[pair_of] / np.maximum(context, 1) + weight[:, 1] * count / max(1, n_all) + weight[:, 2] / (v_all + 1)
                base = np.log10(count + 1) - np.log10(n_all + v_all + 1)
                sums = [np.add.reduceat(x, begin) for x in ((count > 0).astype(np.int64), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=marks >= FOLDS), pa.array(marks % FOLDS == SCORED_FOLD), pa.array(sizes), pa.array(sums[0]),
                     pa.array(np.full(n, n_all, np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=form)

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return solved.where(F.col("kind") == SOLVED).mapInArrow(run, kinds)
