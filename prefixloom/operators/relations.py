"""The trie as id relations alone: walks from node to node, and words rebuilt from edges.

Nothing here reads a prefix: a walk knows the node it is at and the letter that
comes next, and the relations say where that leads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.words import letter_index
from prefixloom.shared import cut

#: Steps that walks take between two cuts.
ROUNDS = 3


def child_rules(relations: DataFrame) -> DataFrame:
    """(parent, letter, child, checked): the child rules of (model, key, out) rows, each with the letter that the check has for the child."""
    rules = relations.where((F.col("model") == "TrieModel") & ~F.col("key").startswith("null,"))
    key = F.split("key", ",")
    children = rules.select(key[0].cast("long").alias("parent"), key[1].cast("int").alias("letter"), F.col("out").cast("long").alias("child"))
    checks = relations.where("model = 'TrieCheck'").select(F.col("key").try_cast("long").alias("its"), F.col("out").try_cast("int").alias("checked")).where("its is not null")
    return children.join(checks, F.col("child") == F.col("its"), "left").drop("its")


def search(queries: DataFrame, relations: DataFrame, stop_at_space: bool = True) -> DataFrame:
    """found and height of each query word, walked level by level over the relations TrieModel, TrieCheck and TrieEnd.

    All walks start at the node of the root's seed rule and take one step a
    round, by one join on (node, letter).  A walk ends without a child, at a
    child whose checked letter is not its own, or after its last letter.  Every
    ROUNDS rounds those that go on are kept and the others set aside, so the
    frame shrinks; rounds are as many as the deepest walk is long.  Height
    counts the children entered.  Repeated queries give one row; the empty word
    is not found at height 0.
    """
    relations = cut(relations)
    seed = relations.where("model = 'TrieModel' and key = 'null,null'").first()
    if seed is None:
        raise ValueError("no rule for the root")
    parts = int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = child_rules(relations).repartition(parts, "parent", "letter").persist()
    text = F.split_part("word", F.lit(" "), F.lit(1)) if stop_at_space else F.col("word")
    root = F.lit(int(seed["out"])).cast("long")
    going = queries.select("word").distinct().select("word", text.alias("text"), root.alias("node"), F.lit(0).alias("height"), (text == "").alias("over"))
    ended = []
    while True:
        for _ in range(ROUNDS):
            going = _stepped(going, steps)
        going = cut(going)
        ended.append(going.where("over").select("word", F.when(F.col("height") == F.length("text"), F.col("node")).alias("node"), "height"))
        going = going.where("not over")
        if going.isEmpty():
            break
    steps.unpersist()
    rows = ended[0]
    for more in ended[1:]:
        rows = rows.unionByName(more)
    ends = relations.where("model = 'TrieEnd' and out = 'TRUE'").select(F.col("key").try_cast("long").alias("end")).where("end is not null")
    out = rows.join(ends, F.col("node") == F.col("end"), "left")
    return out.select("word", (F.col("end").isNotNull() & (F.col("word") != "")).alias("found"), "height")


def _stepped(walks: DataFrame, steps: DataFrame) -> DataFrame:
    """One round: walks that are not over take a step; those that are meet no rule, and are dealt by their words, not as nulls to one task."""
    here = F.when(F.col("over"), -1 - F.pmod(F.xxhash64("word"), F.lit(1 << 40))).otherwise(F.col("node"))
    asked = walks.withColumns({"here": here, "next": letter_index(F.substring("text", F.col("height") + 1, F.lit(1)))})
    met = asked.join(steps, (F.col("here") == F.col("parent")) & (F.col("next") == F.col("letter")), "left")
    met = met.withColumn("height", F.when(F.col("child").isNotNull(), F.col("height") + 1).otherwise(F.col("height")))
    alive = F.coalesce(F.col("checked") == F.col("next"), F.lit(False))
    met = met.withColumn("node", F.when(F.col("over"), F.col("node")).when(alive, F.col("child")))
    return met.select("word", "text", "node", "height", (F.col("over") | F.col("node").isNull() | (F.col("height") == F.length("text"))).alias("over"))


def words_of_edges(edges: DataFrame) -> DataFrame:
    """node_id, prefix and is_end of every node of an edge list (parent_node_id, node_index, node_id, is_end), by pointer doubling.

    A node starts with its letter and its parent.  Every round it takes over
    the letters and the ancestor of its ancestor, so reaches double and rounds
    are the logarithm of the depth.  The root is the node without a parent; a
    node whose ancestors do not lead there is an error.
    """
    root = edges.where("parent_node_id is null").select("node_id").first()
    if root is None:
        return edges.select("node_id", F.lit("").alias("prefix"), "is_end").limit(0)
    letter = F.chr(F.col("node_index") + 97)
    above = F.nullif(F.col("parent_node_id"), F.lit(root["node_id"]))
    now = cut(edges.where("parent_node_id is not null").select("node_id", above.alias("above"), letter.alias("prefix"), "is_end"))
    while not now.where("above is not null").isEmpty():
        up = now.select(F.col("node_id").alias("its"), F.col("above").alias("further"), F.col("prefix").alias("before"))
        met = now.join(up, F.col("above") == F.col("its"), "left")
        lost = F.col("above").isNotNull() & F.col("its").isNull()
        text = F.when(lost, F.raise_error(F.lit("a node without a way to the root"))).otherwise(F.concat(F.coalesce("before", F.lit("")), "prefix"))
        now = cut(met.select("node_id", F.col("further").alias("above"), text.alias("prefix"), "is_end"))
    return now.select("node_id", "prefix", "is_end")
