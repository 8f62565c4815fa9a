"""Models called by name: learned copies of rule tables, end models for each shard with thresholds of their own, and walks in which child, check and end are all predicted.

All training samples are bounded by parameters; scoring covers every row given.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.functions.words import LETTERS, last_letter, letter_index
from prefixloom.operators import models
from prefixloom.operators.rules import MOST_RULES
from prefixloom.operators.trie import spread

#: What the models see of a prefix; the number of children only where the node is known.
_PATH = ["depth", "l1", "l2", "l3"]
_NODE = [*_PATH, "children"]


def call(named: dict[str, PipelineModel], name: str, rows: DataFrame) -> DataFrame:
    """Rows scored by the model of that name; a name without a model is an error."""
    if name not in named:
        raise ValueError(f"no model {name}")
    return named[name].transform(rows)


def call_each(named: dict[str, PipelineModel], rows: DataFrame, by: str) -> DataFrame:
    """Rows scored by the model that their column ``by`` names; rows whose name has no model (null too) are an error.

    Reads ``rows`` once for each model, of which there are few.
    """
    known = F.coalesce(F.col(by).isin(*named), F.lit(False))
    checked = rows.withColumn(by, F.when(known, F.col(by)).otherwise(F.raise_error(F.concat(F.lit("no model "), F.coalesce(by, F.lit("null"))))))
    out = None
    for name in sorted(named):
        one = named[name].transform(checked.where(F.col(by) == name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def rule_inputs(rules: DataFrame) -> DataFrame:
    """Rule rows with their keys as numbers: the state, and 1 where the key says that an error happened."""
    parts = F.split("key", ",")
    return rules.select("model", "key", F.get(parts, F.lit(0)).cast("double").alias("state"), F.when(F.get(parts, F.lit(1)) == "TRUE", 1.0).otherwise(0.0).alias("failed"), "out")


def fit_rule_models(rules: DataFrame, depth: int = 12) -> dict[str, PipelineModel]:
    """One decision tree for each table of rules, by its name; deep enough, it says what the table says.

    The tables are at most ``MOST_RULES`` rows, which is checked.
    """
    rows = rules.select("model", "key", "out").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    small = rule_inputs(rules.sparkSession.createDataFrame(rows, "model string, key string, out string").coalesce(1)).cache()
    out = {}
    for name in sorted({r.model for r in rows}):
        values = {r.out for r in rows if r.model == name}
        own = small.where(F.col("model") == name)
        indexer = StringIndexer(inputCol="out", outputCol="label").fit(own)
        if len(values) == 1:
            steps = [SQLTransformer(statement="SELECT *, CAST(0 AS DOUBLE) AS prediction FROM __THIS__")]
        else:
            tree = DecisionTreeClassifier(featuresCol="inputs", labelCol="label", maxDepth=depth, maxBins=max(32, len(rows)), seed=1)
            inputs = VectorAssembler(inputCols=["state", "failed"], outputCol="inputs")
            steps = [inputs, tree.fit(inputs.transform(indexer.transform(own)))]
        out[name] = PipelineModel([*steps, IndexToString(inputCol="prediction", outputCol="predicted", labels=list(indexer.labels))])
    small.unpersist()
    return out


def learned_rules(rules: DataFrame, named: dict[str, PipelineModel]) -> DataFrame:
    """(model, key, out) for the keys of ``rules``, every value predicted by the model of its table.

    Rule tables are small, so each model reads them in one task.
    """
    return call_each(named, rule_inputs(rules).drop("out").coalesce(1), "model").select("model", "key", F.col("predicted").alias("out"))


def best_threshold(scored: DataFrame, most: int) -> float:
    """The border of ``score`` above which calling ``label`` 1 has the best F1, halfway to the next lower score; of equal ones the highest.

    ``scored`` is a training sample of at most ``most`` rows, which is checked, so that one window may order its scores.
    """
    counts = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    down = Window.orderBy(F.desc("score"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.select("score", F.sum("n").over(upto).alias("called"), F.sum("hits").over(upto).alias("right"), F.lead("score").over(down).alias("below"))
    total = scored.agg(F.sum("label").alias("ends"), F.count(F.lit(1)).alias("rows"))
    f1 = rows.join(F.broadcast(total)).select("rows", ((F.col("score") + F.coalesce("below", F.lit(0.0))) / 2).alias("border"), (2 * F.col("right") / (F.col("called") + F.col("ends"))).alias("f1"))
    best = f1.orderBy(F.desc("f1"), F.desc("border")).first()
    if best is None:
        raise ValueError("no rows to fit on")
    if best.rows > most:
        raise ValueError(f"over {most} rows to fit on")
    return float(best.border)


def _at_best_threshold(model: PipelineModel, sample: DataFrame, most: int) -> PipelineModel:
    """The model, its last stage set to the border of its best F1 on the rows it was fitted on."""
    border = best_threshold(model.transform(sample).select(vector_to_array("probability")[1].alias("score"), "label"), most)
    model.stages[-1].setThresholds([1 - border, border])
    return model


def shard_name(shard: int) -> str:
    return f"TrieEnd4{shard}"


def fit_shard_end_models(nodes: DataFrame, rounds: int = 10, most: int = 20_000) -> dict[str, PipelineModel]:
    """Boosted trees for the end flag, one model for each shard that has nodes, each with the threshold of its best F1.

    ``nodes`` has ``node_id``. A model is fitted on at most ``most`` nodes of its
    shard, those of the lowest hashes; the threshold is its own, as scores of
    different shards are not alike.
    """
    rows = _shards(nodes)
    out = {}
    for shard in range(3):
        sample = rows.where(F.col("name") == shard_name(shard)).orderBy(F.xxhash64("prefix"), "prefix").limit(most).cache()
        if sample.take(1):
            steps = [VectorAssembler(inputCols=_NODE, outputCol="inputs"), GBTClassifier(featuresCol="inputs", labelCol="label", maxIter=rounds, maxDepth=4, seed=1)]
            out[shard_name(shard)] = _at_best_threshold(Pipeline(stages=steps).fit(sample), sample, most)
        sample.unpersist()
    return out


def _shards(nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("prefix").alias("its"), F.concat(F.lit("TrieEnd4"), models.switch_shard(F.col("node_id")).cast("string")).alias("name"))
    return models.features(nodes).join(ids, F.col("prefix") == F.col("its")).drop("its")


def shard_ends(nodes: DataFrame, named: dict[str, PipelineModel]) -> DataFrame:
    """(prefix, name, end): every node's end flag by the model of its shard, as the learned switch deals ids to shards."""
    return call_each(named, _shards(nodes), "name").select("prefix", "name", (F.col("prediction") == 1).alias("end"))


def paths(prefixes: DataFrame) -> DataFrame:
    """What the models see of different prefixes: depth, and the last three letters as kinds (0 none, 1 to 26, 27 any other character)."""

    def at(k: int):
        letter = letter_index(F.substring(F.reverse("prefix"), k, 1))
        kind = F.when(F.length("prefix") < k, 0).when(letter.between(0, LETTERS - 1), letter + 1).otherwise(LETTERS + 1)
        return kind.cast("double").alias(f"l{k}", metadata={"ml_attr": {"type": "nominal", "num_vals": LETTERS + 2}})

    return prefixes.select("prefix", F.length("prefix").cast("double").alias("depth"), at(1), at(2), at(3))


def fit_child_model(nodes: DataFrame, rounds: int = 10, most: int = 1_000) -> PipelineModel:
    """Boosted trees for whether a node has a child by a letter, fitted on every letter below at most ``most`` nodes.

    Few of the tried letters exist, so the border is that of the best F1.
    """
    parents = nodes.orderBy(F.xxhash64("prefix"), "prefix").limit(most).select("prefix")
    letter = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LETTERS - 1)), lambda k: F.chr(k + 97)))
    tried = parents.select("prefix", letter.alias("letter")).select(F.concat("prefix", "letter").alias("prefix"))
    known = nodes.select(F.col("prefix").alias("its"))
    rows = paths(tried).join(known, F.col("prefix") == F.col("its"), "left").withColumn("label", F.col("its").isNotNull().cast("double"))
    steps = [VectorAssembler(inputCols=_PATH, outputCol="inputs"), GBTClassifier(featuresCol="inputs", labelCol="label", maxIter=rounds, maxDepth=5, seed=1)]
    rows = rows.cache()
    model = _at_best_threshold(Pipeline(stages=steps).fit(rows), rows, most * LETTERS)
    rows.unpersist()
    return model


def fit_boosted_letter_model(nodes: DataFrame, rounds: int = 3, most: int = 5_000) -> PipelineModel:
    """Boosted trees for a node's own letter, one set for each letter and the highest score wins; fitted on at most ``most`` nodes."""
    own = nodes.where(f"letter_index between 0 and {LETTERS - 1}").orderBy(F.xxhash64("prefix"), "prefix").limit(most)
    sample = paths(own).withColumn("letter", F.col("l1") - 1)
    trees = GBTClassifier(maxIter=rounds, maxDepth=3, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=_PATH, outputCol="inputs"), OneVsRest(classifier=trees, featuresCol="inputs", labelCol="letter", parallelism=4)]).fit(sample)


def predicted_nodes(prefixes: DataFrame, nodes: DataFrame, child, end, letter) -> DataFrame:
    """(prefix, child, end, letter) as the three models say for different prefixes; a prefix that is no node has no children.

    ``end`` is a model of ``models.fit_end_model``, which sees letters as numbers and how many children there are.
    """
    children = nodes.groupBy(F.col("parent").alias("its")).agg(F.count(F.lit(1)).cast("double").alias("children"))
    rows = paths(prefixes).join(children, F.col("prefix") == F.col("its"), "left").drop("its").withColumn("children", F.coalesce("children", F.lit(0.0)))
    for name, model in (("child", child), ("letter", letter)):
        rows = model.transform(rows).select(*rows.columns, F.col("prediction").cast("int").alias(name))
    seen = [F.when(F.col(c).between(1, LETTERS), F.col(c) - 1).otherwise(F.lit(-1.0)).alias(c) for c in ("l1", "l2", "l3")]
    ends = end.transform(rows.select("prefix", "depth", *seen, "children", "child", "letter"))
    return ends.select("prefix", "child", F.col("prediction").cast("int").alias("end"), "letter")


def search(queries: DataFrame, nodes: DataFrame, child, end, letter) -> DataFrame:
    """Search in which every step is predicted: a walk goes on while the child model sees a child and the letter model says the query's letter; found needs a predicted end there.

    Height counts the letters that pass. The empty word is not found at height 0; repeated queries give one row.
    """
    asked = queries.select("word").distinct()
    steps = spread(asked)
    said = predicted_nodes(steps.select("prefix").distinct(), nodes, child, end, letter)
    rows = steps.join(said, "prefix").withColumn("depth", F.length("prefix"))
    passed = (F.col("child") == 1) & F.col("letter").eqNullSafe(letter_index(last_letter(F.col("prefix"))))
    walks = rows.groupBy(F.col("word").alias("its")).agg(F.min(F.when(~passed, F.col("depth"))).alias("wrong"), F.max("depth").alias("deepest"), F.max(F.col("whole") & (F.col("end") == 1)).alias("end"))
    out = asked.join(walks, F.col("word") == F.col("its"), "left")
    height = F.coalesce(F.col("wrong") - 1, F.col("deepest"), F.lit(0))
    return out.select("word", F.coalesce(F.col("end") & F.col("wrong").isNull(), F.lit(False)).alias("found"), height.alias("height"))
