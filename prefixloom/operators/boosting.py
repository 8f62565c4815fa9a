"""Boosted trees over node ids as categories, for several classes at once.

Every tree is one split of the ids in two sets, for one class.  The order of the
ids that a split cuts is that of their mean gradients, as is right for
categories, and cuts are tried at BINS places of it: Spark adds up gradients and
curvatures by class and bin, and the driver, which gets these few sums alone,
takes the best.  As all trees see the same category, a whole ensemble is a
relation (category, margins), so scoring is one join and needs no tree.

``softmax`` has one class a row; ``logistic`` has any number of labels, each a
model of its own over the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.words import LETTERS
from prefixloom.operators.relations import child_rules
from prefixloom.shared import cut

#: Places of the order of ids at which a split may cut.
BINS = 64


def one_hot(value: Column, size: int) -> Column:
    """1.0 at place ``value``, 0.0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == value).cast("double"))


def _shares(margins: Column, loss: str) -> Column:
    if loss == "logistic":
        return F.transform(margins, lambda m: 1 / (1 + F.exp(-m)))
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp(m - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def fit(rows: DataFrame, classes: int, loss: str = "softmax", rounds: int = 4, rate: float = 0.7, keep: float = 1e-3) -> DataFrame:
    """(category, margins) of an ensemble of ``rounds`` splits for each class, fitted on rows (category, label as an array of ``classes`` doubles).

    Rows of a category count together from the start.  ``keep`` is the weight
    that holds leaves back.  A class that no split improves gets none.
    """
    sums = rows.groupBy("category").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.col("label")[k]).alias(f"y{k}") for k in range(classes)])
    now = sums.select("category", "n", F.array(*[f"y{k}" for k in range(classes)]).alias("y"), F.array_repeat(F.lit(0.0), classes).alias("margins"))
    for _ in range(rounds):
        share = now.withColumn("p", _shares(F.col("margins"), loss))
        pull = F.zip_with("y", "p", lambda y, p: F.struct((y - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h")))
        # a mean gradient lies between -1 and 1, whatever the data
        # cut, as else a round's expressions would stand inside those of the next
        binned = share.select("category", "n", "y", "margins", F.transform(pull, lambda x: F.struct(x["g"].alias("g"), x["h"].alias("h"), F.least(F.lit(BINS - 1), F.floor((x["g"] / F.col("n") + 1) * BINS / 2)).cast("int").alias("bin"))).alias("pulls"))
        binned = cut(binned)
        totals = binned.select(F.posexplode("pulls").alias("class", "x")).groupBy("class", "x.bin").agg(F.sum("x.g").alias("g"), F.sum("x.h").alias("h")).collect()
        best = [_cut([(r["bin"], r["g"], r["h"]) for r in totals if r["class"] == k], keep) for k in range(classes)]
        if not any(b for b in best):
            break
        leaf = F.array(*[F.struct(F.lit(b[0] if b else BINS).alias("at"), F.lit(b[1] * rate if b else 0.0).alias("low"), F.lit(b[2] * rate if b else 0.0).alias("high")) for b in best])
        added = F.zip_with(F.col("pulls"), leaf, lambda x, b: F.when(x["bin"] < b["at"], b["low"]).otherwise(b["high"]))
        now = binned.select("category", "n", "y", F.zip_with("margins", added, lambda m, a: m + a).alias("margins"))
    return cut(now.select("category", "margins"))


def _cut(bins: list[tuple[int, float, float]], keep: float) -> tuple[int, float, float] | None:
    """The first bin of the upper side, and both sides' values, of the cut that gains most; None if none gains."""
    bins = sorted(bins)
    g, h = sum(b[1] for b in bins), sum(b[2] for b in bins)
    worth = lambda g, h: g * g / (h + keep)
    best, low_g, low_h = None, 0.0, 0.0
    for (_, a, b), (above, _, _) in zip(bins, bins[1:], strict=False):
        low_g, low_h = low_g + a, low_h + b
        gain = worth(low_g, low_h) + worth(g - low_g, h - low_h) - worth(g, h)
        if gain > 1e-9 and (best is None or gain > best[0]):
            best = (gain, above, low_g / (low_h + keep), (g - low_g) / (h - low_h + keep))
    return best[1:] if best else None


def argmax(margins: Column) -> Column:
    """The place of the largest margin, the first of equals."""
    return F.array_position(margins, F.array_max(margins)).cast("int") - 1


def fit_relations(relations: DataFrame, rounds: int = 4) -> dict[str, DataFrame]:
    """Ensembles for the three tables of a trie: which letters follow a node, by which letter it was reached, and whether a word ends there."""
    steps = child_rules(relations)
    slot = lambda k: F.max((F.col("letter") == k).cast("double"))
    follow = steps.groupBy(F.col("parent").alias("category")).agg(F.array(*[slot(k) for k in range(LETTERS)]).alias("label"))
    leaves = steps.select(F.col("child").alias("category")).join(follow.select("category"), "category", "left_anti").select("category", F.array_repeat(F.lit(0.0), LETTERS).alias("label"))
    number = F.col("key").try_cast("long").alias("category")
    checks = relations.where("model = 'TrieCheck'").select(number, one_hot(F.col("out").try_cast("int"), LETTERS).alias("label")).where("category > 0")
    ends = relations.where("model = 'TrieEnd'").select(number, one_hot((F.col("out") == "TRUE").cast("int"), 2).alias("label")).where("category is not null")
    return {"TrieModel": fit(follow.unionByName(leaves), LETTERS, "logistic", rounds), "TrieCheck": fit(checks, LETTERS, "softmax", rounds), "TrieEnd": fit(ends, 2, "softmax", rounds)}


def predicted(relations: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """The relations as the ensembles say: child rules that they expect, and every node's letter and end by its largest margin.

    A child that is expected and is not there has no id to go to, so it has no rule.
    """
    steps = child_rules(relations).join(models["TrieModel"], F.col("parent") == F.col("category")).where(F.get("margins", F.col("letter")) > 0)
    rules = steps.select(F.lit("TrieModel").alias("model"), F.concat_ws(",", F.col("parent").cast("string"), F.col("letter").cast("string")).alias("key"), F.col("child").cast("string").alias("out"))
    said = lambda name, out: models[name].select(F.lit(name).alias("model"), F.col("category").cast("string").alias("key"), out.alias("out"))
    letters = said("TrieCheck", argmax(F.col("margins")).cast("string"))
    ends = said("TrieEnd", F.when(argmax(F.col("margins")) == 1, "TRUE").otherwise("FALSE"))
    seeds = relations.where("key like 'null%' or (key = '0' and model = 'TrieCheck')").select("model", "key", "out")
    return seeds.unionByName(rules).unionByName(letters).unionByName(ends)


def confusion(relations: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """(model, actual, predicted, n): child slots of every node, letters of the nodes and ends, against the relations."""
    steps = child_rules(relations).select("parent", "letter", F.lit(True).alias("there"))
    slots = models["TrieModel"].select(F.col("category").alias("parent"), F.posexplode("margins").alias("letter", "margin"))
    child = slots.join(steps, ["parent", "letter"], "left").select(F.lit("TrieModel").alias("model"), F.coalesce("there", F.lit(False)).cast("string").alias("actual"), (F.col("margin") > 0).cast("string").alias("predicted"))
    rest = []
    for name in ("TrieCheck", "TrieEnd"):
        real = relations.where(F.col("model") == name).select(F.col("key").try_cast("long").alias("category"), F.col("out").alias("actual"))
        said = argmax(F.col("margins"))
        label = said.cast("string") if name == "TrieCheck" else F.when(said == 1, "TRUE").otherwise("FALSE")
        rest.append(models[name].join(real, "category").select(F.lit(name).alias("model"), "actual", label.alias("predicted")))
    return child.unionByName(rest[0]).unionByName(rest[1]).groupBy("model", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
