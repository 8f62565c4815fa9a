"""Global ordinals without a single-task window: places in the partitions of a range sort, and the sizes of the partitions before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.shared import cut


def numbered(df: DataFrame, order: list[Column | str], name: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the row's 0-based place by ``order``, separately for each value of ``by``; nulls come first.

    Rows are range-partitioned and sorted by group and order, so partitions
    are even whatever the data, and kept in the shared folder with their
    ascending ids, which tell the place in the partition; only the counts of
    groups by partition meet.  Rows that ``order`` does not tell apart get
    places in no certain order.
    """
    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order]
    rows = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__its"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    same = F.col("__part") == F.col("__its")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(offsets, same).select(*df.columns, (F.col("__at") + F.col("__offset")).cast("long").alias(name))


def by_word(df: DataFrame, name: str = "ord", word: str = "word", by: list[str] | None = None) -> DataFrame:
    """Ordinals in the order of the words."""
    return numbered(df, [word], name, by)


def by_hash(df: DataFrame, name: str, seed: Column | None = None, word: str = "word", by: list[str] | None = None) -> DataFrame:
    """Ordinals in a reproducible random order: that of the words' hashes."""
    key = F.md5(F.concat(F.col(word), seed.cast("string")) if seed is not None else F.col(word))
    return numbered(df.withColumn("__hash", key), ["__hash", word], name, by).drop("__hash")
