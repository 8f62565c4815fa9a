"""Search by sorted neighbours: no prefixes are made.

In one sorted list of known words and queries the known word that shares most
letters with a query is its nearest known one on the left or on the right, and
every prefix of that word is a node, so the longer of the two common prefixes is
the walk's height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.functions.words import common_prefix_length
from prefixloom.shared import cut


def search(queries: DataFrame, words: DataFrame) -> DataFrame:
    """found and height of each query word, from its neighbours among ``words``.

    One range-partitioned sort of both; the nearest known words come from
    windows inside a partition, and where it has none, from the last or first
    known word of the partitions beside it, of which there is one row each.
    Repeated queries give one row; the empty word is not found at height 0.
    """
    known = words.select("word").where("word <> ''")
    both = known.select("word", F.lit(True).alias("known")).unionByName(queries.select("word", F.lit(False).alias("known")))
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(both.repartitionByRange(parts, "word").sortWithinPartitions("word").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    own = F.when(F.col("known"), F.col("word"))
    before = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a frame that begins at each row would be quadratic
    seen = ordered.select("part", "word", "known", F.last(own, ignorenulls=True).over(before).alias("left"), F.last(own, ignorenulls=True).over(after).alias("right"))
    # equal words are side by side: a query's copies, known or not, meet here without another exchange
    asked = seen.groupBy("part", "word").agg(F.bool_or(~F.col("known")).alias("asked"), F.max("left").alias("left"), F.min("right").alias("right")).where("asked")
    edges = ordered.groupBy("part").agg(F.min(own).alias("first"), F.max(own).alias("last"))  # a row for each partition
    to_left = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    to_right = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    beside = edges.select(F.col("part").alias("its"), F.max("last").over(to_left).alias("from_left"), F.min("first").over(to_right).alias("from_right"))
    met = asked.join(F.broadcast(beside), F.col("part") == F.col("its"))
    shared = lambda other: F.coalesce(common_prefix_length(F.col("word"), other), F.lit(0))
    left, right = F.coalesce("left", "from_left"), F.coalesce("right", "from_right")
    return met.select("word", F.coalesce(left == F.col("word"), F.lit(False)).alias("found"), F.greatest(shared(left), shared(right)).alias("height"))
