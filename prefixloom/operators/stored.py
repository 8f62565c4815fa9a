"""A trie kept as a table that is bucketed and sorted by prefix, so that repeated searches do not move it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefixloom.operators import trie


def store(nodes: DataFrame, name: str, buckets: int) -> None:
    """Writes nodes as a table in ``buckets`` buckets, sorted inside; an old table of that name is replaced."""
    nodes.write.bucketBy(buckets, "prefix").sortBy("prefix").mode("overwrite").format("parquet").saveAsTable(name)


def search(spark: SparkSession, queries: DataFrame, name: str) -> DataFrame:
    """As ``trie.search``, over a stored table: the queries' prefixes are exchanged, the nodes are read bucket by bucket."""
    return trie.search(queries, spark.table(name).hint("merge"))
