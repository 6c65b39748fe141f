"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over blocks.

Every dimension is a term and every non-zero component a posting. A task gets one block of candidates and one block of
queries; it scatters the postings of each query term, weighted, into dense score arrays, selects the best by partition,
and a window merges the blocks' lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.shared import stage

SCALE = 1024
QUERY_BATCH = 64


def whole_numbers(vector: str) -> Column:
    """floor(1024 * x) of every component; NULL if the vector is null or holds a null or a number that is not finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths and all values of a list column."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
    return np.diff(a.offsets.to_numpy()).astype(np.int64), a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _sparse(lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    return row[some], term[some], values[some]


def search_block(ids: np.ndarray, docs: tuple[np.ndarray, np.ndarray], query_ids: np.ndarray, queries: tuple[np.ndarray, np.ndarray], k: int):
    """(query row, candidate id, score) of the best k candidates for every query; equal scores prefer smaller ids."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))  # candidates by id, so that ties resolve by position
    ids, n = ids[order], len(ids)
    row, term, weight = _sparse(*docs)
    row = place[row]
    by_term = np.lexsort((row, term))
    row, term, weight = row[by_term], term[by_term], weight[by_term]
    terms, first = np.unique(term, return_index=True)
    postings = {t: slice(a, b) for t, a, b in zip(terms.tolist(), first, [*first[1:], len(term)], strict=True)}
    q_row, q_term, q_weight = _sparse(*queries)
    width = int(max(docs[0].max(initial=0), queries[0].max(initial=0)))
    most = int(abs(weight).max(initial=0)) if len(weight) else 0
    bound = max(1, most * (int(abs(q_weight).max(initial=0)) if len(q_weight) else 0) * max(1, width))
    exact = bound * n < 2**62  # else Python's whole numbers, which do not overflow
    kind = np.int64 if exact else object
    found = []
    for begin in range(0, len(query_ids), QUERY_BATCH):
        size = min(QUERY_BATCH, len(query_ids) - begin)
        scores = np.zeros((size, n), kind)
        mine = (q_row >= begin) & (q_row < begin + size)
        dense = np.zeros((width, size), kind)
        dense[q_term[mine], q_row[mine] - begin] = q_weight[mine]
        for t in np.unique(q_term[mine]).tolist():
            at = postings.get(t)
            if at is None:
                continue
            add = dense[t][:, None] * weight[at].astype(kind)[None, :]
            if at.stop - at.start == n:
                scores += add
            else:
                scores[:, row[at]] += add
        ranked = scores * n + np.arange(n - 1, -1, -1).astype(kind)[None, :]
        own = ids[None, :] == query_ids[begin : begin + size, None]
        if exact:
            ranked[own] = np.iinfo(np.int64).min + 1  # its negative is a number, too
            best = np.argpartition(-ranked, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (size, 1))
        else:
            best = np.array([sorted(range(n), key=lambda j, r=r: (own[r, j], -ranked[r, j]))[:k] for r in range(size)], np.int64).reshape(size, -1)
        q = np.repeat(np.arange(size), best.shape[1])
        c = best.ravel()
        keep = ~own[q, c]
        q, c = q[keep], c[keep]
        score = scores[q, c]
        if not exact:
            score = np.array([max(-(2**63), min(2**63 - 1, s)) for s in score], np.int64)
        found.append((q + begin, ids[c], score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, docs_per_block: int = 32_768, queries_per_block: int = 16_384) -> DataFrame:
    """The best ``k`` of ``vectors`` (vec_id, terms: array of whole numbers) for each of its rows where ``queries`` holds.

    Missing terms count as 0. Rows with null id or null terms take no part; rows that equal each other count once; a
    query's own id is no candidate. Blocks are dealt by hash and have a bounded size; every pair of a query block and a
    candidate block is one group. Scores beyond the range of a long stop at its ends.
    """
    rows = stage(vectors.where("vec_id IS NOT NULL AND terms IS NOT NULL").select("vec_id", "terms", queries.alias("_asks")).distinct())
    n, q = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("_asks").cast("int")), F.lit(0))).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(-(-n // docs_per_block), min(parts, -(-n // 512)), 1)
    q_blocks = max(-(-q // queries_per_block), 1)
    key = F.xxhash64("vec_id", "terms")
    rows = rows.withColumn("_key", key)
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    docs = rows.select("vec_id", "terms", F.pmod("_key", F.lit(n_blocks)).cast("int").alias("d"), all_of(q_blocks).alias("q"))
    asks = rows.where("_asks").select(F.col("vec_id").alias("query_id"), "_key", "terms", F.pmod("_key", F.lit(q_blocks)).cast("int").alias("q"), all_of(n_blocks).alias("d"))

    def search(docs: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["query_id", "_key", "vec_id", "score"]
        if not docs.num_rows or not asks.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        ids = asks["query_id"].to_numpy()
        row, vec, score = search_block(docs["vec_id"].to_numpy(), _lists(docs["terms"]), ids, _lists(asks["terms"]), k)
        return pa.table({"query_id": ids[row], "_key": asks["_key"].to_numpy()[row], "vec_id": vec, "score": score})

    found = docs.groupBy("d", "q").cogroup(asks.groupBy("d", "q")).applyInArrow(search, "query_id long, _key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
