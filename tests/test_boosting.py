"""Boosted trees over ids, and fitted trees compiled to columns and SQL."""

import pytest
from pyspark.sql import functions as F

from prefixloom.operators import boosting, compiled, models, relations, trie
from prefixloom.sources import lexicons

WORDS = ["a", "an", "and", "ant", "bee", "bent", "bet", "cat", "cats", "dog", "zoo"]


@pytest.fixture(scope="module")
def table(spark):
    return trie.relations(trie.build_with_ids(lexicons.from_words(spark, WORDS))).cache()


def test_tables_are_learned_exactly_by_id(spark, table):
    learned = boosting.fit_relations(table)
    wrong = boosting.confusion(table, learned).where("actual <> predicted")
    assert wrong.count() == 0
    asked = lexicons.from_words(spark, [*WORDS, "ca", "be", "xyz", "ants", ""])
    got = sorted((r["word"], r["found"], r["height"]) for r in relations.search(asked, boosting.predicted(table, learned)).collect())
    assert got == sorted((r["word"], r["found"], r["height"]) for r in relations.search(asked, table).collect())


def test_softmax_finds_the_likelier_class_of_noisy_categories(spark):
    rows = [(c, k) for c in range(30) for k in [c % 3] * 7 + [(c + 1) % 3] * 2]
    frame = spark.createDataFrame(rows, "category long, k int").select("category", boosting.one_hot(F.col("k"), 3).alias("label"))
    got = boosting.fit(frame, 3, rounds=6).select("category", boosting.argmax(F.col("margins")).alias("k"), boosting._shares(F.col("margins"), "softmax").alias("p")).collect()
    assert all(r["k"] == r["category"] % 3 and r["p"][r["k"]] > 0.6 and sum(r["p"]) == pytest.approx(1) for r in got)


def test_nothing_to_learn_gives_flat_margins(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "category long, label array<double>")
    assert {tuple(r["margins"]) for r in boosting.fit(frame, 2).collect()} == {(0.0, 0.0)}
    assert boosting.fit(frame.limit(0), 2).collect() == []


def test_a_cut_gains_most_where_gradients_part():
    assert boosting._cut([(0, -4.0, 2.0), (1, -4.0, 2.0), (9, 8.0, 2.0)], 0.0)[0] == 9
    assert boosting._cut([(3, 1.0, 1.0)], 0.0) is None


def test_compiled_trees_say_what_the_models_say(spark):
    duckdb = pytest.importorskip("duckdb")
    words = [a + b + c for a in "abcdeghiklmno" for b in ("", "a", "e", "nt", "st") for c in ("", "s", "ed", "er")]
    nodes = trie.build(lexicons.from_words(spark, words))
    rows = models.features(nodes).cache()
    c = duckdb.connect()
    c.register("rows", rows.toPandas())
    for model in (models.fit_end_model(nodes, rounds=4), models.fit_letter_model(nodes, depth=5)):
        form = compiled.saved(model)
        both = model.transform(rows).select("prefix", "prediction", compiled.column(form).cast("double").alias("said"))
        assert both.where("prediction <> said").count() == 0
        want = {(r["prefix"], r["said"]) for r in both.collect()}
        assert set(c.execute(f"SELECT prefix, CAST({compiled.sql(form)} AS DOUBLE) FROM rows").fetchall()) == want
