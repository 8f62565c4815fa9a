"""Learned stand-ins for the exact tables: shard routing, class priors, and Spark ML classifiers for ends and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.ranks import numbered

# The id ranges of the three shards, and the thresholds that the learned switch uses instead.
SHARD_ENDS = (994, 1994)
SWITCH_THRESHOLDS = (996.5, 1995.5)
#: The same for the switch by parent that stands before the child tables.
MODEL_SWITCH_THRESHOLDS = (614.0, 1191.5)


def shard(node_id: Column) -> Column:
    """Shard by exact id ranges."""
    return F.when(node_id <= SHARD_ENDS[0], 0).when(node_id <= SHARD_ENDS[1], 1).otherwise(2)


def switch_shard(node_id: Column, thresholds: tuple[float, float] = SWITCH_THRESHOLDS) -> Column:
    """Shard as a learned switch decides; it differs from the exact one at the borders. A missing id goes to the first."""
    return F.when(node_id.isNull() | (node_id < thresholds[0]), 0).when(node_id < thresholds[1], 1).otherwise(2)


def shard_ranges(nodes: DataFrame, most: int) -> DataFrame:
    """(shard, low, high): ranges of node ids so that no shard has more than ``most`` nodes, from the ids' own quantiles; high is the next shard's low, null for the last."""
    placed = numbered(nodes.select("node_id"), ["node_id"], "place").withColumn("shard", F.floor(F.col("place") / most))
    lows = placed.groupBy("shard").agg(F.min("node_id").alias("low"))
    after = lows.select((F.col("shard") - 1).alias("its"), F.col("low").alias("high"))
    return lows.join(after, F.col("shard") == F.col("its"), "left").select("shard", "low", "high")


def routed(rows: DataFrame, ranges: DataFrame, node_id: str) -> DataFrame:
    """The rows with the shard of their id; ids below all ranges and missing ones go to the first shard, those above to the last.

    A range join by buckets: ids are cut in buckets of the ranges' mean width,
    a range is listed in each bucket that it touches, and an id meets the few
    ranges of its own bucket, for any number of shards.
    """
    ends = ranges.agg(F.min("low").alias("least"), F.max("low").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return rows.withColumn("shard", F.lit(None).cast("long"))
    width = max(1, (ends["most"] - ends["least"]) // ends["n"])
    bucket = lambda c: F.floor((c - ends["least"]) / width)
    last = F.coalesce(F.col("high") - 1, F.col("low"))
    listed = ranges.select("shard", "low", "high", F.explode(F.sequence(bucket(F.col("low")), bucket(last))).alias("bucket"))
    own = F.least(F.greatest(F.coalesce(F.col(node_id), F.lit(ends["least"])), F.lit(ends["least"])), F.lit(ends["most"]))
    met = rows.withColumn("__id", own).join(listed, bucket(F.col("__id")) == F.col("bucket"))
    return met.where((F.col("__id") >= F.col("low")) & (F.col("high").isNull() | (F.col("__id") < F.col("high")))).select(*rows.columns, "shard")


def priors(rows: DataFrame, label: str) -> DataFrame:
    """Each label's count and share."""
    counts = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def previous_letter_table(nodes: DataFrame) -> DataFrame:
    """(node_id, letter_index): the letter by which a node was reached, which the exhaustive check compares."""
    return nodes.select("node_id", "letter_index")


def features(nodes: DataFrame) -> DataFrame:
    """What the classifiers see of a node: depth, its letter and the two before, and how many children it has."""
    children = nodes.groupBy(F.col("parent").alias("its")).agg(F.count(F.lit(1)).alias("children"))
    at = lambda k: F.coalesce(F.nullif(F.ascii(F.substring(F.reverse("prefix"), k, 1)), F.lit(0)) - 97, F.lit(-1)).cast("double")
    joined = nodes.join(children, F.col("prefix") == F.col("its"), "left")
    return joined.select("prefix", F.col("depth").cast("double").alias("depth"), at(1).alias("l1"), at(2).alias("l2"), at(3).alias("l3"), F.coalesce("children", F.lit(0)).cast("double").alias("children"), F.col("is_end").cast("double").alias("label"), "letter_index")


_INPUTS = ["depth", "l1", "l2", "l3", "children"]


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` training rows, the lowest by a hash of the prefix; a documented bound."""
    return rows.orderBy(F.xxhash64("prefix"), "prefix").limit(most)


def fit_end_model(nodes: DataFrame, rounds: int = 10, most: int = 20_000):
    """Boosted trees for the end flag, fitted on at most ``most`` nodes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=_INPUTS, outputCol="inputs"), GBTClassifier(featuresCol="inputs", labelCol="label", maxIter=rounds, maxDepth=4, seed=1)]
    return Pipeline(stages=steps).fit(_sample(features(nodes), most))


def fit_letter_model(nodes: DataFrame, depth: int = 8, most: int = 20_000):
    """A decision tree for a node's own letter from its features; many classes, so not boosted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=_INPUTS, outputCol="inputs"), DecisionTreeClassifier(featuresCol="inputs", labelCol="letter", maxDepth=depth, maxBins=64, seed=1)]
    rows = features(nodes).where("letter_index between 0 and 25").withColumn("letter", F.col("letter_index").cast("double"))
    return Pipeline(stages=steps).fit(_sample(rows, most))


def predict(model, nodes: DataFrame, name: str) -> DataFrame:
    """(prefix, name): the model's label for every node."""
    return model.transform(features(nodes)).select("prefix", F.col("prediction").cast("int").alias(name))


def search(queries: DataFrame, nodes: DataFrame, end_model, letter_model=None) -> DataFrame:
    """Search where the end flag, and with ``letter_model`` the exhaustive check, come from models.

    A walk stops above the first node whose predicted letter differs from the
    query's; found needs a predicted end at the last node.
    """
    from prefixloom.operators.trie import spread

    known = nodes.select("prefix", "depth", "letter_index").join(predict(end_model, nodes, "end"), "prefix")
    known = known.join(predict(letter_model, nodes, "letter"), "prefix") if letter_model else known.withColumn("letter", F.col("letter_index"))
    asked = queries.select("word").distinct()
    hits = spread(asked).join(known, "prefix").groupBy(F.col("word").alias("its"))
    hits = hits.agg(
        F.max("depth").alias("deepest"), F.min(F.when(F.col("letter") != F.col("letter_index"), F.col("depth"))).alias("wrong"), F.max(F.col("whole") & (F.col("end") == 1)).alias("end"),
    )
    height = F.least(F.col("deepest"), F.coalesce(F.col("wrong") - 1, F.col("deepest")))
    out = asked.join(hits, F.col("word") == F.col("its"), "left")
    return out.select("word", F.coalesce(F.col("end") & F.col("wrong").isNull(), F.lit(False)).alias("found"), F.coalesce(height, F.lit(0)).alias("height"))
