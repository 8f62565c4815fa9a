"""Connected components of a large graph by alternating star contractions.

Each round points every node's larger neighbours, then its smaller ones, at the
smallest node in reach; the number of rounds grows with the logarithm of the
largest component.  Nothing is gathered: a node of very many links is a group
only in a combined minimum, and the joins are plain equi-joins that the
engine may split.  Rounds end in a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of a link its component's smallest node.  ``edges`` has long columns a and b."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, before = _state(now), None
    while state[0] and state != before:
        now = cut(_small_star(_large_star(now)))
        state, before = _state(now), state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return moved.union(least).distinct()
