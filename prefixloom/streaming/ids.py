"""Insertion of a stream of words with lasting node ids.

The store has a folder for each micro-batch with the nodes that it created and
those that it made ends.  Ids go on where the batches before left off, in the
order of first creation, so a stream in the order of its ordinals gives the ids
of the batch build.  A batch that is run again writes its folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefixloom.operators.trie import get_or_create, spread
from prefixloom.shared import drop_dir

_ROWS = "prefix string, data_id long, is_end boolean, batch long"


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """prefix, data_id and is_end of the nodes so far, or before a batch; a node is an end if any batch made it one."""
    rows = spark.read.schema(_ROWS).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("prefix").agg(F.min("data_id").alias("data_id"), F.max("is_end").alias("is_end"))


def insert_batch(path: str):
    """A foreachBatch function for (word, ord) rows."""

    def run(words: DataFrame, batch: int) -> None:
        spark = words.sparkSession
        old = stored(spark, path, batch) if batch > 0 else spark.createDataFrame([], "prefix string, data_id long, is_end boolean")
        fresh = get_or_create(old, words).select("prefix", "data_id", "is_end")
        ends = spread(words.select("word").distinct()).where("whole").select("prefix").distinct()
        changed = old.where("not is_end").join(ends, "prefix").select("prefix", "data_id", F.lit(True).alias("is_end"))
        fresh.unionByName(changed).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return run


def insert_stream(words: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Inserts what a stream of (word, ord) has now; started again with the same folders it goes on where it ended."""
    return words.writeStream.foreachBatch(insert_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str, last: int) -> None:
    """Puts the folders of all batches before ``last``, the last one written, into that of the one before it.

    Rows may stand twice meanwhile, which a reader does not see; ``last`` itself
    may still be run again and is left alone.
    """
    if last < 2:
        return
    rows = spark.read.schema(_ROWS).parquet(path).where(F.col("batch") < last)
    batches = sorted(r["batch"] for r in rows.select("batch").distinct().collect())
    stored(spark, path, last).write.mode("append").parquet(f"{path}/batch={last - 1}")
    for batch in batches:
        if batch < last - 1:
            drop_dir(spark, f"{path}/batch={batch}")
