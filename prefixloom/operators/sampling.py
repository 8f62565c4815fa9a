"""Reproducible sampling: the random order is that of hashes, so every engine and run draws alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.ranks import by_hash


def shuffled(words: DataFrame, batch=None, by: list[str] | None = None) -> DataFrame:
    """Adds ``place``, the row's place in the random order of its group."""
    return by_hash(words, "place", batch, by=by)


def _sizes(words: DataFrame, by: list[str]) -> DataFrame:
    return words.groupBy(*by).agg(F.count(F.lit(1)).alias("__size")) if by else words.agg(F.count(F.lit(1)).alias("__size"))


def with_size(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    sizes = _sizes(words, by or [])
    return words.join(sizes, by) if by else words.join(F.broadcast(sizes))


def fraction(words: DataFrame, k: int, batch=None, by: list[str] | None = None) -> DataFrame:
    """One k-th of each group, rounded down; a group of fewer than k rows stays whole."""
    rows = with_size(shuffled(words, batch, by), by)
    share = F.floor(F.col("__size") / k)
    return rows.where((share == 0) | (F.col("place") < share)).drop("__size", "place")


def halves(words: DataFrame) -> DataFrame:
    """The random order's first and last half as test and train; the middle row of an odd number goes."""
    rows = with_size(shuffled(words))
    half = F.floor(F.col("__size") / 2)
    part = F.when(F.col("place") < half, "test").when(F.col("place") >= F.col("__size") - half, "train")
    return rows.withColumn("part", part).where("part is not null").drop("__size", "place")


def at_most(words: DataFrame, counts: DataFrame) -> DataFrame:
    """As many rows of the random order as the one-row frame ``counts`` says in ``n``."""
    return shuffled(words).join(F.broadcast(counts)).where(F.col("place") < F.col("n")).drop("n", "place")


def balanced(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """All known words and as many unknown ones, or all if there are fewer, with ``is_known``."""
    picked = at_most(unknown.select("word"), known.agg(F.count(F.lit(1)).alias("n")))
    return known.select("word", F.lit(True).alias("is_known")).unionByName(picked.select("word", F.lit(False).alias("is_known")))


def trials(words: DataFrame, count: int) -> DataFrame:
    """The words once for each of ``count`` batches."""
    return words.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def sweep(words: DataFrame, low: int, high: int) -> DataFrame:
    """The words once for each limit ``letters`` from low to high that they fit."""
    return words.withColumn("letters", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(F.length("word") <= F.col("letters"))


def chunks(words: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk``: rows in the order of their ordinal, ``size`` at a time."""
    return words.withColumn("chunk", F.floor(F.col("ord") / size))


def difference(words: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose word the other frame lacks; repeated rows stay."""
    return words.join(other.select("word").distinct(), "word", "left_anti")
