"""Connected components of a graph held in a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.session import stage


def connected_components(edges: DataFrame, keys: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """``keys``, vertex and root (the smallest vertex reachable) of every vertex; each value of ``keys`` is a graph of its own.

    In every step a vertex and its present root take the smallest root next to them, and then the root of their root.
    Steps are stored, so a lost executor costs one step; their number grows with the logarithm of the longest path.
    Tables of vertices are joined by sorting: they grow with the graph, and a broadcast would send them through the driver.
    Vertices must not be null.
    """
    keys = list(keys)
    pairs = F.inline(F.array(F.struct(F.col(a).alias("vertex"), F.col(b).alias("other")), F.struct(F.col(b).alias("vertex"), F.col(a).alias("other"))))
    near = stage(edges.select(*keys, pairs).distinct())
    roots = stage(near.select(*keys, "vertex", F.col("vertex").alias("root")).distinct())
    while True:
        theirs = roots.select(*keys, F.col("vertex").alias("other"), F.col("root").alias("seen"))
        met = near.join(theirs.hint("merge"), [*keys, "other"]).groupBy(*keys, "vertex").agg(F.min("seen").alias("seen"))
        met = met.join(roots.hint("merge"), [*keys, "vertex"])
        offers = met.select(*keys, F.inline(F.array(F.struct("vertex", F.least("seen", "root").alias("root")), F.struct(F.col("root").alias("vertex"), F.least("seen", "root").alias("root")))))
        hooked = stage(offers.groupBy(*keys, "vertex").agg(F.min("root").alias("root")))
        further = hooked.select(*keys, F.col("vertex").alias("root"), F.col("root").alias("next"))
        jumped = stage(hooked.join(further.hint("merge"), [*keys, "root"]).select(*keys, "vertex", F.col("next").alias("root")))
        moved = jumped.join(roots.withColumnRenamed("root", "was").hint("merge"), [*keys, "vertex"]).where("root <> was")
        if moved.isEmpty():
            return jumped
        roots = jumped
