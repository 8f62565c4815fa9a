"""Where results go: appended or overwritten CSV with headers, edge lists and pattern dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.words import null_text


def append_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Adds rows under ``path``; every part file has the header."""
    df.write.mode("append").partitionBy(*partition_by).csv(path, header=True)


def overwrite_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).csv(path, header=True)


def overwrite_batches(df: DataFrame, path: str, by: tuple[str, ...] = ("letters", "batch")) -> None:
    """Writes rows so that each combination of ``by`` in them replaces what was there of it, and others stay: a batch that is run again counts once."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def truncate(df: DataFrame, path: str) -> None:
    """Leaves only the header of the frame's columns."""
    overwrite_csv(df.limit(0), path)


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges as text in the router file's columns; the root's missing inputs are the string null."""
    return edges.select(
        null_text(F.col("parent_node_id")).alias("parentNodeIdIn"), null_text(F.col("node_index")).alias("nodeIndexIn"),
        F.col("node_id").cast("string").alias("nodeIdOut"), F.col("is_end").cast("string").alias("isEndOfWordOut"),
    )


def export_edges(edges: DataFrame, path: str) -> None:
    edge_rows(edges).write.mode("overwrite").csv(path, header=True)


def export_patterns(patterns: DataFrame, path: str) -> None:
    patterns.select("word", F.col("length").cast("string").alias("length"), F.col("pattern_id").cast("string").alias("patternId")).write.mode("overwrite").csv(path, header=True)
