"""Models by name: learned rule tables against the tables, thresholds and predicted walks against plain recomputation."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prefixloom.operators import learned, models, rules, trie
from prefixloom.sources import lexicons

WORDS = sorted({a + b + c for a in ("", "be", "ca", "str") for b in ("a", "an", "ed", "o") for c in ("", "t", "ts", "ing")})


@pytest.fixture(scope="module")
def own(spark):
    return trie.build_with_ids(lexicons.from_words(spark, WORDS)).cache()


def test_learned_rules_say_what_the_tables_say(spark):
    tables = rules.builtin_rules(spark)
    named = learned.fit_rule_models(tables)
    assert len(named) == 18
    got = {tuple(r) for r in learned.learned_rules(tables, named).collect()}
    assert got == {tuple(r) for r in tables.select("model", "key", "out").collect()}
    asked = learned.rule_inputs(tables).where("model = 'SearchMethod' and key = '4'")
    assert [r.predicted for r in learned.call(named, "SearchMethod", asked).collect()] == ["getNodeEndCheck"]


def test_search_by_learned_rules_equals_the_exact_one(spark, own):
    tables = rules.builtin_rules(spark).where(F.col("model").startswith("Search"))
    asked = lexicons.from_words(spark, [*WORDS[::2], "cat", "cax", "zz", ""])
    got = rules.search(asked, own, rules=learned.learned_rules(tables, learned.fit_rule_models(tables)))
    assert sorted(got.collect()) == sorted(trie.search(asked, own).collect())


def test_one_value_tables_and_unknown_names(spark):
    tables = spark.createDataFrame([("Same", "0", "x"), ("Same", "1", "x")], "model string, key string, out string")
    named = learned.fit_rule_models(tables)
    assert sorted(r.out for r in learned.learned_rules(tables, named).collect()) == ["x", "x"]
    with pytest.raises(ValueError, match="no model Other"):
        learned.call(named, "Other", tables)
    for other in ("Other", None):
        with pytest.raises(Exception, match="no model"):
            learned.learned_rules(tables.union(spark.createDataFrame([(other, "0", "x")], tables.schema)), named).collect()


def test_threshold_has_the_best_f1(spark):
    rows = [(0.9, 1.0), (0.8, 0.0), (0.7, 1.0), (0.7, 1.0), (0.4, 0.0), (0.3, 1.0), (0.1, 0.0)]
    f1 = lambda t: 2 * sum(y for s, y in rows if s > t) / (sum(s > t for s, _ in rows) + sum(y for _, y in rows))
    got = learned.best_threshold(spark.createDataFrame(rows, "score double, label double"), 10)
    assert got == pytest.approx(0.2) and f1(got) == max(f1(t / 100) for t in range(100))
    with pytest.raises(ValueError, match="over 3 rows"):
        learned.best_threshold(spark.createDataFrame(rows, "score double, label double"), 3)


def test_shard_models_use_their_thresholds(spark, own):
    wide = own.withColumn("node_id", F.col("node_id") * 40)
    shards = {f"TrieEnd4{r.s}" for r in wide.select(models.switch_shard(F.col("node_id")).alias("s")).distinct().collect()}
    named = learned.fit_shard_end_models(wide, rounds=3)
    assert set(named) == shards and len(shards) == 3
    rows = learned.call_each(named, learned._shards(wide), "name").select("name", "prediction", vector_to_array("probability")[1].alias("p"), "label").collect()
    assert len(rows) == own.count()
    borders = {n: m.stages[-1].getThresholds()[1] for n, m in named.items()}
    assert all((r.p > borders[r.name]) == (r.prediction == 1) for r in rows)
    for name in named:
        mine = [(r.p, r.label) for r in rows if r.name == name]
        f1 = lambda t: 2 * sum(y for p, y in mine if p > t) / max(1, sum(p > t for p, _ in mine) + sum(y for _, y in mine))  # noqa: B023, E731
        assert f1(borders[name]) == pytest.approx(max(f1(p - 1e-9) for p, _ in mine))
    assert learned.shard_ends(wide, named).count() == own.count()


def test_predicted_walk(spark, own):
    child, end, letter = learned.fit_child_model(own), models.fit_end_model(own, rounds=3), learned.fit_boosted_letter_model(own, rounds=1)
    asked = lexicons.from_words(spark, [*WORDS, "xyz", "beq", "straw", "", "be"])
    every = asked.where("word <> ''").select("word")
    said = {r.prefix: r for r in learned.predicted_nodes(trie.spread(every).select("prefix").distinct(), own, child, end, letter).collect()}
    want = set()
    for word in {r.word for r in asked.collect()}:
        height = 0
        while height < len(word) and said[word[: height + 1]].child == 1 and said[word[: height + 1]].letter == ord(word[height]) - 97:
            height += 1
        want.add((word, 0 < height == len(word) and said[word].end == 1, height))
    assert {tuple(r) for r in learned.search(asked, own, child, end, letter).collect()} == want
    known = {r.prefix for r in own.collect()}
    right = sum((said[p].child == 1) == (p in known) for p in said)
    assert right >= 0.8 * len(said) and sum(said[p].letter == ord(p[-1]) - 97 for p in said if p in known) >= 0.9 * len(known)
