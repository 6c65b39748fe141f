"""Per-feature attributions of tree models: path-dependent Shapley values of every row.

A leaf is reached if the row meets the conditions of each input on its path. With an input left out, both branches of
its splits count by their shares of training rows. The Shapley values of a leaf then depend only on which inputs' conditions
the row meets, so they are tabulated once per leaf over those few bits, and a batch of rows needs one comparison and one
look-up per condition. Values of all leaves and trees add up to the model's margin less its mean.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from boutline.session import checkpoint_root


@dataclass(frozen=True)
class Leaf:
    """``inputs`` on the path with open lower and closed upper bounds, and the values per pattern of met conditions."""

    inputs: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray  # pattern x input


def leaf_values(value: float, shares: Sequence[float]) -> np.ndarray:
    """Shapley values of one leaf for every pattern of met conditions; bit j of a pattern is input j of the path."""
    n = len(shares)
    patterns = np.arange(1 << n)
    met = (patterns[:, None] >> np.arange(n) & 1).astype(float)
    out = np.zeros((1 << n, n))
    for j in range(n):
        by_size = np.zeros((1 << n, n))  # sum over sets of the other inputs, by size
        by_size[:, 0] = 1.0
        for k in range(n):
            if k != j:
                by_size[:, 1:] = by_size[:, 1:] * shares[k] + by_size[:, :-1] * met[:, k : k + 1]
                by_size[:, 0] *= shares[k]
        weight = [factorial(s) * factorial(n - s - 1) / factorial(n) for s in range(n)]
        out[:, j] = value * (by_size @ np.array(weight)) * (met[:, j] - shares[j])
    return out


def leaves_of(nodes: Sequence[Row], weight: float) -> tuple[list[Leaf], float]:
    """Leaves of one stored tree, and its mean over training rows; both times ``weight``."""
    by_id = {n["id"]: n for n in nodes}
    out, mean = [], 0.0
    todo = [(0, {}, 1.0)]
    while todo:
        at, path, share = todo.pop()
        node = by_id[at]
        if node["leftChild"] < 0:
            mean += weight * share * node["prediction"]
            if path:
                low, high, shares = (np.array([p[i] for p in path.values()]) for i in range(3))
                out.append(Leaf(np.array(list(path)), low, high, leaf_values(weight * node["prediction"], shares)))
            continue
        split = node["split"]
        if split["numCategories"] >= 0:
            raise ValueError("attributions need numeric splits")
        i, bound = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            part = by_id[child]["rawCount"] / node["rawCount"]
            low, high, before = path.get(i, (-np.inf, np.inf, 1.0))
            edge = (low, min(high, bound), before * part) if left else (max(low, bound), high, before * part)
            todo.append((child, {**path, i: edge}, share * part))
    return out, mean


@dataclass(frozen=True)
class Explainer:
    leaves: list[Leaf]
    mean: float
    width: int

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of each row of ``x``; they add up to the row's margin less ``mean``."""
        out = np.zeros((self.width, len(x)))
        columns = np.ascontiguousarray(x.T)
        for leaf in self.leaves:
            pattern = np.zeros(len(x), np.int64)
            for j, (i, low, high) in enumerate(zip(leaf.inputs, leaf.low, leaf.high, strict=True)):
                pattern |= ((columns[i] > low) & (columns[i] <= high)).astype(np.int64) << j
            for j, i in enumerate(leaf.inputs):
                out[i] += leaf.values[pattern, j]
        return out.T


def explainer(model: PipelineModel) -> Explainer:
    """From the stored form of a boosted classifier; its nodes are bounded by trees times two to the depth."""
    trees = model.stages[-1]
    spark = SparkSession.active()
    path = os.path.join(checkpoint_root(spark), "trees-" + uuid.uuid4().hex)
    trees.write().overwrite().save(path)
    stored = spark.read.parquet(os.path.join(path, "data"))
    rows = stored.select("treeID", "nodeData.*").collect()
    leaves, mean = [], 0.0
    for number, weight in enumerate(trees.treeWeights):
        mine, part = leaves_of([r for r in rows if r["treeID"] == number], weight)
        leaves += mine
        mean += part
    return Explainer(leaves, mean, trees.numFeatures)


def _batches(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in rows:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def attributions(model: PipelineModel, rows: DataFrame, inputs: Sequence[str], keep: str = "bout_id") -> DataFrame:
    """``keep``, ``margin_mean`` and an array ``values`` in the order of ``inputs`` for every row."""
    tool, width = explainer(model), len(inputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, width):
            found = tool.values(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), tool.mean)), lists], ["id", "margin_mean", "values"])

    given = rows.select(F.col(keep).alias("id"), F.array(*inputs).alias("x"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(work, f"id {kind}, margin_mean double, values array<double>").withColumnRenamed("id", keep)


def mean_attribution(models: Sequence[PipelineModel], rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """feature and importance: the mean absolute attribution over all rows and models.

    A task sends one row per batch and input, not one per row of the table.
    """
    tools, width, names = [explainer(m) for m in models], len(inputs), list(inputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _batches(batches, width):
            total = sum(np.abs(t.values(x)).sum(axis=0) for t in tools)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array([len(x) * len(tools)] * width)], ["feature", "total", "n"])

    parts = rows.select(F.array(*inputs).alias("x")).mapInArrow(work, "feature string, total double, n bigint")
    return parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))
