"""Tries whose nodes carry the patterns of the words through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.ranks import numbered
from prefixloom.operators.trie import spread


def build(words: DataFrame) -> DataFrame:
    """(prefix, pattern, is_end): a row per node and pattern of a word through it; the root is the empty prefix.

    ``words`` has ``word`` and ``pattern``; a node is an end if any word ends there.
    """
    rows = spread(words, "pattern").select("prefix", "pattern", "whole")
    ends = rows.groupBy("prefix").agg(F.max("whole").alias("is_end"))
    pairs = rows.select("prefix", "pattern").distinct().join(ends, "prefix")
    root = words.where(F.length("word") > 0).select(F.lit("").alias("prefix"), "pattern", F.lit(False).alias("is_end")).distinct()
    return pairs.unionByName(root)


def node_patterns(pairs: DataFrame) -> DataFrame:
    """Each node's patterns as a sorted array; patterns are few per node."""
    return pairs.groupBy("prefix").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"), F.max("is_end").alias("is_end"))


def search(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """found and height of (word, pattern) queries: the walk ends at the first node that is missing or lacks the pattern.

    Found needs an end at the last node, of whichever word, and the pattern
    all the way; the root's patterns do not matter.
    """
    asked = queries.select("word", "pattern").distinct()
    hits = spread(asked, "pattern").join(pairs, ["prefix", "pattern"]).groupBy(F.col("word").alias("w"), F.col("pattern").alias("p"))
    hits = hits.agg(F.max(F.length("prefix")).alias("h"), F.max(F.col("whole") & F.col("is_end")).alias("f"))
    out = asked.join(hits, (F.col("word") == F.col("w")) & F.col("pattern").eqNullSafe(F.col("p")), "left")
    return out.select("word", "pattern", F.coalesce("f", F.lit(False)).alias("found"), F.coalesce("h", F.lit(0)).alias("height"))


def dense_ids(words: DataFrame, vector: str = "vector") -> DataFrame:
    """(vector, pattern_id): ids from 0 in the order in which vectors are first seen; ``words`` has ``ord``."""
    first = words.groupBy(vector).agg(F.min("ord").alias("first_ord"))
    return numbered(first, ["first_ord"], "pattern_id").select(vector, "pattern_id")


def with_ids(words: DataFrame, vector: str = "vector") -> DataFrame:
    return words.join(dense_ids(words, vector), vector)
