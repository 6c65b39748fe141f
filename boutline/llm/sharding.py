"""Resharding by minimum-cost flow: fewest bytes moved from old shards to new capacities.

The driver sees one number per shard. Large documents are placed first, in proportion to the flow; a second flow then
fills what is left of every new shard with small documents, so that sizes come out equal to within a small document.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from boutline.llm.shared import segment_count, shared_folder

OVERHEAD = 8  # bytes a row takes besides its text
SMALL_SHARE = 0.2  # share of all bytes in the documents that level out the shards


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Bytes to send from every old shard to every new one at the least total cost; staying costs 0, moving 1 by default.

    Successive shortest paths with potentials on the complete bipartite graph; capacities must cover the supply.
    """
    n, m = len(supply), len(capacity)
    cost = cost or [[int(i != j) for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    if sum(left) > sum(room):
        raise ValueError("capacities are smaller than what they must hold")
    for i in range(n):  # free moves first: they are on shortest paths of length 0
        for j in range(m):
            if cost[i][j] == 0 and (x := min(left[i], room[j])):
                flow[i][j] += x
                left[i] -= x
                room[j] -= x
    potential = [0] * (n + m)
    while any(left):
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        prev: list[int | None] = [None] * (n + m)
        heap, done = [(0, i) for i in range(n) if left[i]], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = [(n + j, cost[u][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                w = d + c + potential[u] - potential[v]
                if dist[v] is None or w < dist[v]:
                    dist[v], prev[v] = w, u
                    heapq.heappush(heap, (w, v))
        end = min((n + j for j in range(m) if room[j] and dist[n + j] is not None), key=lambda v: (dist[v] + potential[v], v))
        far = max(x for x in dist if x is not None)
        potential = [p + (far if d is None else d) for p, d in zip(potential, dist, strict=True)]
        path, v = [], end
        while prev[v] is not None:
            path.append((prev[v], v))
            v = prev[v]
        x = min([left[v], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += x
            else:
                flow[b][a - n] -= x
        left[v] -= x
        room[end - n] -= x
    return flow


@dataclass
class Plan:
    """``rows``: the documents with shard and slot; ``moved``: bytes that change shards; ``affected``: shards to rewrite."""

    rows: DataFrame
    moved: int
    affected: list[int]


def _cuts(flows: list[list[int]]) -> Column:
    """The new shard of a row, from its old shard and its place on the old shard's line of bytes."""
    case = F.when(F.lit(False), F.lit(0))
    for old, flow in enumerate(flows):
        begin, runs = 0, []
        for j, x in enumerate(flow):
            if x:
                runs.append((begin, j))
                begin += x
        if not runs:
            continue
        inner = F.when(F.lit(False), F.lit(0))
        for at, j in reversed(runs[1:]):
            inner = inner.when(F.col("__at") >= F.lit(at), F.lit(j))
        case = case.when(F.col("__old") == old, inner.otherwise(F.lit(runs[0][1])))
    return case.otherwise(F.col("__old"))


def _in_proportion(parts: list[int], total: int) -> list[int]:
    """``total`` split like ``parts``, in whole numbers."""
    whole, at, ends = sum(parts), 0, []
    for x in parts:
        at += x
        ends.append(total * at // whole if whole else 0)
    return [b - a for a, b in zip([0, *ends], ends, strict=False)]


def reshard(docs: DataFrame, old_shard: Column, n_old: int, capacities: list[int] | int) -> Plan:
    """Moves ``docs`` (doc_id, text and any other columns, which are kept) from ``n_old`` shards to shards of the given sizes (a number: equal ones).

    Sizes are UTF-8 bytes plus 8 a row; null texts have none. Capacities are shares: they are scaled to the corpus.
    Rows that equal each other may land in different shards; null ids come first on their line; an empty table gives an
    empty plan. Columns whose names begin with two underscores are reserved. The rows get ``size``, ``shard`` and ``slot``, gapless from 0 in the shard.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]  # replaced by the results
    docs = docs.select(*kept, F.coalesce(old_shard, F.lit(0)).cast("int").alias("__old"), (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("__bytes"))
    level = F.floor(F.log2("__bytes") * 4).cast("int")
    per = docs.groupBy("__old", level.alias("__level")).agg(F.sum("__bytes").alias("s"), F.count("*").alias("n")).collect()  # shards x some 200 levels
    shares = [1] * capacities if isinstance(capacities, int) else list(capacities)
    supply = [sum(r["s"] for r in per if r["__old"] == i) for i in range(n_old)]
    total = sum(supply)
    capacity = _in_proportion(shares, total)
    flow = min_cost_flow(supply, capacity)

    bytes_by_level: dict[int, int] = {}
    for r in per:
        bytes_by_level[r["__level"]] = bytes_by_level.get(r["__level"], 0) + r["s"]
    bound, below = 0, 0
    for lv in sorted(bytes_by_level):
        bound, below = lv + 1, below + bytes_by_level[lv]
        if below >= SMALL_SHARE * total:
            break
    rows = sum(r["n"] for r in per)
    pieces = segment_count(rows)
    lines = docs.withColumn("__class", (level < bound).cast("int")).withColumn("__seg", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))
    keys, order = ["__old", "__class", "__seg"], ["doc_id", "__bytes", "__mark"]
    lines = lines.withColumn("__mark", F.xxhash64("text"))
    narrow = lines.select(*keys, *order)
    upto = W.partitionBy("__old", "__class").orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    starts = narrow.groupBy(*keys).agg(F.sum("__bytes").alias("__sum"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__sum").over(upto), F.lit(0).cast("long"))).drop("__sum")

    def placed(df: DataFrame, known: DataFrame, shard: Column) -> DataFrame:
        """A row's middle byte on its line says where it goes; ``_rank`` numbers the rows of a segment."""
        inside = W.partitionBy(*keys).orderBy(*order)
        before = F.coalesce(F.sum("__bytes").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
        df = df.join(known.hint("shuffle_hash"), keys)
        df = df.withColumns({"__at": F.col("__start") + before + F.expr("__bytes div 2"), "__rank": F.row_number().over(inside)})
        return df.withColumn("shard", shard.cast("int"))

    big_supply = [sum(r["s"] for r in per if r["__old"] == i and r["__level"] >= bound) for i in range(n_old)]
    big_flow = [_in_proportion(f, s) for f, s in zip(flow, big_supply, strict=True)]
    big = placed(narrow.where("__class = 0"), starts, _cuts(big_flow))
    there = {r["shard"]: r["s"] for r in big.groupBy("shard").agg(F.sum("__bytes").alias("s")).collect()}
    room = [max(0, c - there.get(j, 0)) for j, c in enumerate(capacity)]
    small_supply = [s - b for s, b in zip(supply, big_supply, strict=True)]
    # large documents may overfill a shard or leave more room than there is to fill
    small_flow = min_cost_flow(small_supply, _in_proportion(room if sum(room) else shares, sum(small_supply)))

    shard = F.when(F.col("__class") == 0, _cuts(big_flow)).otherwise(_cuts(small_flow))
    groups = placed(narrow, starts, shard).groupBy(*keys, "shard").agg(F.count("*").alias("__n"), F.min("__rank").alias("__first"))
    earlier = W.partitionBy("shard").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long")) - F.col("__first"))
    bases = groups.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("shard", "__base"))).alias("__bases"))
    rows_out = placed(lines, starts.join(bases, keys), shard)
    rows_out = rows_out.withColumn("slot", (F.element_at("__bases", F.col("shard")) + F.col("__rank")).cast("long"))
    moved = [(i, j, f[j]) for fl in (big_flow, small_flow) for i, f in enumerate(fl) for j in range(len(f)) if i != j and f[j]]
    touched = sorted({k for i, j, _ in moved for k in (i, j) if k < len(capacity)})
    keep = [c for c in rows_out.columns if c not in {*keys, "__mark", "__start", "__bases", "__at", "__rank"}]
    return Plan(rows_out.select(*keep).withColumnRenamed("__bytes", "size"), sum(x for *_, x in moved), touched)


def rewrite(plan: Plan, folder: str | None = None, only: list[int] | None = None) -> DataFrame:
    """Writes the affected shards (or the shards ``only``) as Parquet, one folder each, and reads them back.

    Untouched shards keep their files.
    """
    rows = plan.rows
    kept = plan.affected if only is None else only
    path = folder or shared_folder(rows.sparkSession, "shards")
    rows.where(F.col("shard").isin(kept)).write.partitionBy("shard").parquet(path)
    schema = rows.drop("shard").schema.add("shard", IntegerType())
    return rows.sparkSession.read.schema(schema).parquet(path)
