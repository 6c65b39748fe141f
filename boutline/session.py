"""Session set-up and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def build_session(app: str = "boutline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` adds or overrides (dots as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call-site capture per column
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder: executors on other machines could
    not read one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    ctx = spark.sparkContext
    if not ctx.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="boutline-"))
    return _LOCAL_ROOT[0]


def stage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Survives lost executors, cuts the lineage of loops, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), "stage-" + uuid.uuid4().hex)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
