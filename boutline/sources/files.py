"""File sources and sinks: CSV, JSON and text logs, wide tables, append with a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | T.StructType) -> DataFrame:
    """Headered CSV with a given schema (plain names mean text); nothing is inferred."""
    schema = columns if isinstance(columns, T.StructType) else text_schema(columns)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with (file, block_start, line_in_block), which order the lines of a file.

    A file split is bounded by the reader's split size, so block_start can serve as scan segment.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_in_block"),
    )


def split_prefix(columns: Sequence[str], prefix: str, skip: Sequence[str] = ()) -> list[str]:
    """Stat names behind a corner prefix: the part after the first space."""
    out = []
    for c in columns:
        head, _, rest = c.partition(" ")
        if head == prefix and rest not in skip:
            out.append(rest)
    return out


def columns_without(columns: Sequence[str], words: Sequence[str] = (), names: Sequence[str] = ()) -> list[str]:
    """Column list minus given names and minus names that hold any of the words."""
    return [c for c in columns if c not in names and not any(w in c for w in words)]


def write_table(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet") -> None:
    """Rebuild a derived table."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.format(fmt).save(path)


def append_fixed(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "csv") -> None:
    """Append rows in a fixed column order; a column the rows lack is written as ''."""
    q = lambda c: F.col(f"`{c}`")
    out = [
        F.coalesce(q(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns
    ]
    w = df.select(*out).write.mode("append")
    if fmt == "csv":
        w = w.option("header", True).option("emptyValue", "")
    w.format(fmt).save(path)


def write_lines(lines: DataFrame, path: str, order: Sequence[str], text: str = "line") -> None:
    """Text lines in order: files are ranges of the order, so reading them by name gives the report."""
    lines.orderBy(*order).select(text).write.mode("overwrite").text(path)


def prediction_documents(predictions: DataFrame, bouts_per_document: int = 256) -> DataFrame:
    """JSON documents of a card: records plus the probabilities per class.

    A document covers at most ``bouts_per_document`` consecutive bout ids of a card, so its arrays stay
    bounded however large the card is; every prediction is in exactly one document.
    """
    part = F.floor(F.col("bout_id") / bouts_per_document).alias("part")
    rec = F.struct("bout_id", "red", "blue", "predicted_result", "probability")
    ordered = F.sort_array(F.collect_list(F.struct("bout_id", rec.alias("rec"), F.col("p").alias("p"))))
    docs = predictions.groupBy("d", part).agg(ordered.alias("xs"))
    body = F.struct(
        F.transform("xs", lambda x: x["rec"]).alias("predict_data"),
        F.struct(
            F.transform("xs", lambda x: x["p"]).alias("Win"), F.transform("xs", lambda x: 1 - x["p"]).alias("Lose")
        ).alias("class_probabilities"),
    )
    return docs.select("d", "part", F.size("xs").alias("bouts"), F.to_json(body).alias("document"))
