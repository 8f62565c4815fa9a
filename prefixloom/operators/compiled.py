"""Fitted trees as plain expressions: Spark ML trees become CASE columns, or the same as SQL text, from one saved form.

Scoring then needs no ML transform: it is part of the plan and of its generated
code, and any engine that reads SQL gives the same answer.  The saved form is
JSON: inputs, trees, weights and the threshold on the probability.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import Column
from pyspark.sql import functions as F

SAVED = Path(__file__).parent.parent / "models"


def _node(node) -> dict:
    """A JVM tree node: its prediction if it is a leaf, else the input, what goes left (up to a threshold, or a list of categories) and both children."""
    if node.getClass().getSimpleName() == "LeafNode":
        return {"value": node.prediction()}
    split = node.split()
    out = {"input": split.featureIndex()}
    if split.getClass().getSimpleName() == "ContinuousSplit":
        out["upto"] = split.threshold()
    else:
        out["among"] = sorted(split.leftCategories())
    return out | {"left": _node(node.leftChild()), "right": _node(node.rightChild())}


def saved(model: PipelineModel) -> dict:
    """The saved form of a pipeline of an assembler and a boosted, or single, tree model."""
    assembler, last = model.stages[-2], model.stages[-1]
    single = not hasattr(last, "treeWeights")
    trees = [last._java_obj] if single else list(last._java_obj.trees())
    border = last.getThresholds()[1] if not single and last.isSet("thresholds") else 0.5
    return {"inputs": assembler.getInputCols(), "boosted": not single, "weights": [1.0] if single else list(last.treeWeights), "border": border, "trees": [_node(t.rootNode()) for t in trees]}


def save(model: PipelineModel, name: str) -> None:
    (SAVED / f"{name}.json").write_text(json.dumps(saved(model), indent=1) + "\n")


@cache
def load(name: str) -> dict:
    return json.loads((SAVED / f"{name}.json").read_text())


def _sql(node: dict, inputs: list[str]) -> str:
    if "value" in node:
        return repr(float(node["value"])) + "::DOUBLE"
    name = inputs[node["input"]]
    left = f"{name} <= {node['upto']!r}::DOUBLE" if "upto" in node else f"{name} IN ({', '.join(map(repr, node['among']))})"
    return f"CASE WHEN {left} THEN {_sql(node['left'], inputs)} ELSE {_sql(node['right'], inputs)} END"


def sql(form: dict) -> str:
    """The label as SQL over the inputs' names: of boosted trees whether twice the margin's logistic is above the border."""
    values = [_sql(t, form["inputs"]) for t in form["trees"]]
    if not form["boosted"]:
        return values[0]
    margin = " + ".join(f"{w!r}::DOUBLE * ({v})" for w, v in zip(form["weights"], values, strict=True))
    return f"CASE WHEN 1 / (1 + exp(-2 * ({margin}))) > {form['border']!r}::DOUBLE THEN 1 ELSE 0 END"


def _column(node: dict, inputs: list[str]) -> Column:
    if "value" in node:
        return F.lit(float(node["value"]))
    name = F.col(inputs[node["input"]])
    left = name <= node["upto"] if "upto" in node else name.isin(*node["among"])
    return F.when(left, _column(node["left"], inputs)).otherwise(_column(node["right"], inputs))


def column(form: dict) -> Column:
    """The same as a column over the inputs."""
    values = [_column(t, form["inputs"]) for t in form["trees"]]
    if not form["boosted"]:
        return values[0]
    margin = F.lit(form["weights"][0]) * values[0]
    for w, v in zip(form["weights"][1:], values[1:], strict=True):
        margin = margin + F.lit(w) * v
    return F.when(1 / (1 + F.exp(-2 * margin)) > form["border"], 1).otherwise(0)
