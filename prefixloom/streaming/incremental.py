"""Incremental insertion: each micro-batch adds the nodes and ends that the stored trie lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefixloom.operators.trie import build

_NODES = "prefix string, parent string, letter_index int, depth int, is_end boolean, batch long"


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The trie so far, or before a batch: one row per node, an end if any batch made it one."""
    rows = spark.read.schema(_NODES).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("prefix", "parent", "letter_index", "depth").agg(F.max("is_end").alias("is_end"))


def insert_batch(path: str):
    """A foreachBatch function; a batch that is run again writes its own folder again, so it counts once."""

    def run(words: DataFrame, batch: int) -> None:
        fresh = build(words)
        if batch > 0:
            old = stored(words.sparkSession, path, batch).select("prefix", F.col("is_end").alias("was_end"))
            fresh = fresh.join(old, "prefix", "left").where("was_end is null or (is_end and not was_end)").drop("was_end")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return run


def insert_stream(words: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Inserts a stream of ``word`` rows into the trie at ``path``."""
    return words.writeStream.foreachBatch(insert_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
