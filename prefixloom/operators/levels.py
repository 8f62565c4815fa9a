"""Level-wise construction: at each depth a word peels off one letter and its rest moves into the child's bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.words import parent


def buckets(words: DataFrame) -> DataFrame:
    """Every level's buckets at once: prefix, depth, is_word, rests (words that go on below).

    A level depends on the words only, not on the level before, so all levels
    share one shuffle instead of a barrier each.
    """
    rows = words.where(F.length("word") > 0).select("word").distinct()
    peeled = rows.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth")).withColumn("rest", F.length("word") - F.col("depth"))
    keyed = peeled.select(F.substring("word", F.lit(1), F.col("depth")).alias("prefix"), "depth", "rest")
    return keyed.groupBy("prefix", "depth").agg(F.max(F.col("rest") == 0).alias("is_word"), F.sum((F.col("rest") > 0).cast("long")).alias("rests"))


def step(level: DataFrame) -> DataFrame:
    """The level below one of (prefix, rest): the same rows with one letter moved; empty rests end."""
    on = level.where(F.length("rest") > 0)
    return on.select(F.concat("prefix", F.substring("rest", 1, 1)).alias("prefix"), F.expr("substring(rest, 2)").alias("rest"))


def by_barriers(words: DataFrame, longest: int = 15) -> DataFrame:
    """Nodes built level by level, one grouping per depth; for comparison with ``buckets``."""
    level = words.where(F.length("word") > 0).select(F.lit("").alias("prefix"), F.col("word").alias("rest")).distinct()
    out = None
    for depth in range(1, longest + 1):
        level = step(level)
        nodes = level.groupBy("prefix").agg(F.max(F.length("rest") == 0).alias("is_word"), F.sum((F.length("rest") > 0).cast("long")).alias("rests")).withColumn("depth", F.lit(depth))
        out = nodes if out is None else out.unionByName(nodes)
    return out.select("prefix", "depth", "is_word", "rests")


def first_letters(words: DataFrame) -> DataFrame:
    """Buckets by first letter: words, and whether the letter itself is one."""
    rows = words.where(F.length("word") > 0).select("word").distinct()
    return rows.groupBy(F.substring("word", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("words"), F.max(F.length("word") == 1).alias("is_word"))


def largest_buckets(levels: DataFrame) -> DataFrame:
    """Largest bucket of each level; it sizes the next level's work."""
    return levels.groupBy("depth").agg(F.max("rests").alias("largest"), F.count(F.lit(1)).alias("nodes"))


def sibling_largest(levels: DataFrame) -> DataFrame:
    """The largest bucket among each node's children."""
    return levels.groupBy(parent(F.col("prefix")).alias("prefix")).agg(F.max("rests").alias("largest"))


def init_stats(levels: DataFrame) -> DataFrame:
    """Words of two letters or more with the level that completed them, in place of a wall-clock time."""
    return levels.where(F.col("is_word") & (F.col("depth") >= 2)).select(F.col("prefix").alias("word"), F.col("depth").alias("level"))
