"""The trie as a relation: building nodes, ids, edges and lookup relations, searching, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.ranks import numbered
from prefixloom.functions.words import last_letter, letter_index, parent, prefixes, upper_flag


def spread(words: DataFrame, *keep: str) -> DataFrame:
    """One row per word and non-empty prefix: prefix, whether it is the whole word, and the ``keep`` columns."""
    rows = words.where(F.length("word") > 0)
    return rows.select(*keep, "word", F.explode(prefixes(F.col("word"))).alias("prefix")).withColumn("whole", F.col("prefix") == F.col("word"))


def build(words: DataFrame) -> DataFrame:
    """Nodes without the root: prefix, parent, letter_index, depth, is_end. Repeated words change nothing."""
    nodes = spread(words).groupBy("prefix").agg(F.max("whole").alias("is_end"))
    return nodes.select("prefix", parent(F.col("prefix")).alias("parent"), letter_index(last_letter(F.col("prefix"))).alias("letter_index"), F.length("prefix").alias("depth"), "is_end")


def build_with_ids(words: DataFrame) -> DataFrame:
    """Nodes with ``first_ord`` and both id schemes, in the order of first creation; the root (id 0) is left out.

    ``words`` has ``ord``.  Creation order is (least ordinal of a word with the
    prefix, depth); the ordinals come from a range sort, so no task ranks all.
    """
    nodes = spread(words, "ord").groupBy("prefix").agg(F.max("whole").alias("is_end"), F.min("ord").alias("first_ord"))
    ranked = numbered(nodes, ["first_ord", F.length("prefix")], "rank")
    ids = ranked.select("prefix", parent(F.col("prefix")).alias("parent"), letter_index(last_letter(F.col("prefix"))).alias("letter_index"), F.length("prefix").alias("depth"), "is_end", "first_ord", (F.col("rank") + 1).alias("data_id"))
    return ids.withColumn("node_id", F.col("data_id") * 2)


def edges(nodes: DataFrame) -> DataFrame:
    """parent_node_id, node_index, node_id, is_end of every node and of the root, whose first two are null."""
    above = nodes.select(F.col("prefix").alias("above"), F.col("node_id").alias("above_id"))
    inner = nodes.join(above, F.col("parent") == F.col("above"), "left")
    rows = inner.select(F.coalesce("above_id", F.lit(0)).cast("long").alias("parent_node_id"), F.col("letter_index").alias("node_index"), "node_id", "is_end")
    root = nodes.sparkSession.range(1).select(F.lit(None).cast("long").alias("parent_node_id"), F.lit(None).cast("int").alias("node_index"), F.lit(0).cast("long").alias("node_id"), F.lit(False).alias("is_end"))
    return rows.unionByName(root)


def relations(nodes: DataFrame) -> DataFrame:
    """The three lookup relations in long form (model, key, out), with the seed rows of the root."""
    above = nodes.select(F.col("prefix").alias("above"), F.col("data_id").alias("above_id"))
    inner = nodes.join(above, F.col("parent") == F.col("above"), "left").withColumn("up", F.coalesce("above_id", F.lit(0)))
    row = F.array(
        F.struct(F.lit("TrieModel").alias("model"), F.concat_ws(",", F.col("up").cast("string"), F.col("letter_index").cast("string")).alias("key"), F.col("data_id").cast("string").alias("out")),
        F.struct(F.lit("TrieEnd").alias("model"), F.col("data_id").cast("string").alias("key"), upper_flag(F.col("is_end")).alias("out")),
        F.struct(F.lit("TrieCheck").alias("model"), F.col("data_id").cast("string").alias("key"), F.col("letter_index").cast("string").alias("out")),
    )
    seeds = nodes.sparkSession.createDataFrame(
        [("TrieModel", "null,null", "0"), ("TrieCheck", "null", "null"), ("TrieCheck", "0", "null"), ("TrieEnd", "null", "FALSE"), ("TrieEnd", "0", "FALSE")], "model string, key string, out string"
    )
    return inner.select(F.explode(row).alias("r")).select("r.*").union(seeds)


def search(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """found and height of each query word: one equi-join of the queries' prefixes with the nodes.

    Prefixes are closed downwards, so the deepest match is the walk's height.
    Repeated queries give one row; the empty word is not found at height 0.
    """
    asked = queries.select("word").distinct()
    hits = spread(asked).join(nodes.select("prefix", "is_end", "depth"), "prefix").groupBy("word").agg(F.max("depth").alias("h"), F.max(F.col("whole") & F.col("is_end")).alias("f"))
    hits = hits.withColumnRenamed("word", "its")
    out = asked.join(hits, F.col("word") == F.col("its"), "left")
    return out.select("word", F.coalesce("f", F.lit(False)).alias("found"), F.coalesce("h", F.lit(0)).alias("height"))


def search_list(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Search in a plain list: height is the 0-based place of the first match, or the list's length."""
    first = words.groupBy(F.col("word").alias("its")).agg(F.min("ord").alias("at"))
    total = words.agg(F.count(F.lit(1)).alias("n"))
    out = queries.select("word").distinct().join(first, F.col("word") == F.col("its"), "left").join(F.broadcast(total))
    return out.select("word", F.col("at").isNotNull().alias("found"), F.coalesce("at", "n").alias("height"))


def insert(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Nodes after inserting further words: missing prefixes are created, and end flags are set."""
    return nodes.unionByName(build(words)).groupBy("prefix", "parent", "letter_index", "depth").agg(F.max("is_end").alias("is_end"))


def get_or_create(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Only the nodes that inserting the words would create, with data ids after the largest one there is.

    ``nodes`` has ``data_id``; ``words`` has ``ord``.
    """
    fresh = spread(words, "ord").groupBy("prefix").agg(F.max("whole").alias("is_end"), F.min("ord").alias("first_ord"))
    fresh = fresh.join(nodes.select("prefix"), "prefix", "left_anti")
    top = nodes.agg(F.coalesce(F.max("data_id"), F.lit(0)).alias("top"))
    ranked = numbered(fresh, ["first_ord", F.length("prefix")], "rank").join(F.broadcast(top))
    return ranked.select("prefix", F.length("prefix").alias("depth"), "is_end", (F.col("top") + F.col("rank") + 1).alias("data_id"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """Each node with the path of its ancestors from the root's child down."""
    return nodes.select("prefix", F.slice(prefixes(F.col("prefix")), F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))).alias("path"))


def depth_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_end").cast("long")).alias("ends"))


def children_counts(nodes: DataFrame) -> DataFrame:
    """Number and least and greatest letter of every inner node's children; the root is the empty prefix."""
    return nodes.groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("children"), F.min("letter_index").alias("first_letter"), F.max("letter_index").alias("last_letter"))


def letter_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth", "letter_index").agg(F.count(F.lit(1)).alias("nodes"))
