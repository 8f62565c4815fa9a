"""Walks over relations and sorted neighbours against the prefix join, words from edges, bounded shards, stored tries, streams with ids, and sources."""

import os

import pytest

from prefixloom.functions import catalog, ranks
from prefixloom.operators import models, neighbours, quality, relations, rules, stored, trie
from prefixloom.sources import lexicons, sinks
from prefixloom.streaming import ids as streamed

KNOWN = ["a", "an", "and", "ant", "bee", "been", "bent", "zoo", "c-d", "two words"]
ASKED = [*KNOWN, "", "ants", "b", "zzz", "aa", "anda", "beenz", "c", "two", "ant", "A", "zo"]


def words(spark, values):
    return spark.createDataFrame([(w, k) for k, w in enumerate(values)], "word string, ord long")


def rows(df):
    return sorted((r["word"], r["found"], r["height"]) for r in df.collect())


@pytest.mark.parametrize("known", [KNOWN, [], ["a"]])
def test_other_searches_equal_the_prefix_join(spark, known):
    own, asked = words(spark, known), words(spark, ASKED)
    want = rows(trie.search(asked, trie.build(own)))
    assert rows(relations.search(asked, trie.relations(trie.build_with_ids(own)), stop_at_space=False)) == want
    assert rows(neighbours.search(asked, own)) == want


def test_neighbours_carry_over_partition_borders(spark):
    """One known word among many queries: most partitions have none."""
    asked = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    own = words(spark, ["fox", "fpx"])
    assert rows(neighbours.search(words(spark, asked), own)) == rows(trie.search(words(spark, asked), trie.build(own)))


def test_a_walk_stops_at_the_first_space_and_reads_only_relations(spark):
    table = spark.createDataFrame(
        [("TrieModel", "null,null", "7"), ("TrieModel", "7,0", "3"), ("TrieModel", "3,1", "9"), ("TrieCheck", "3", "0"), ("TrieCheck", "9", "5"), ("TrieEnd", "3", "TRUE"), ("TrieEnd", "9", "TRUE"), ("TrieEnd", "null", "FALSE")],
        "model string, key string, out string",
    )
    got = rows(relations.search(words(spark, ["a", "a b", "ab", "b", " "]), table))
    assert got == [(" ", False, 0), ("a", True, 1), ("a b", True, 1), ("ab", False, 2), ("b", False, 0)]
    with pytest.raises(ValueError):
        relations.search(words(spark, ["a"]), table.where("key <> 'null,null'"))


def test_words_of_edges_by_doubling(spark):
    long = "abcdefghij" * 7
    nodes = trie.build_with_ids(words(spark, ["ant", "and", long]))
    got = {r["prefix"]: (r["node_id"], r["is_end"]) for r in relations.words_of_edges(trie.edges(nodes)).collect()}
    assert got == {r["prefix"]: (r["node_id"], r["is_end"]) for r in nodes.collect()}
    lost = trie.edges(nodes).where("node_id <> 2")
    with pytest.raises(Exception, match="way to the root"):
        relations.words_of_edges(lost).collect()


def test_the_loop_program_drives_the_walk(spark):
    tables = rules.builtin_rules(spark)
    own, asked = trie.build(words(spark, ["an", "b"])), words(spark, ["an", "b", "ba"])
    altered = lambda key, out: tables.selectExpr("model", "key", f"if(model = 'LoopSequence' and key = '{key}', '{out}', out) out")
    assert rows(rules.search(asked, own)) == [("an", True, 2), ("b", True, 1), ("ba", False, 1)]
    assert rows(rules.search(asked, own, rules=altered("2,FALSE", "-1"))) == [("an", False, 1), ("b", True, 1), ("ba", True, 1)]
    assert rows(rules.search(asked, own, rules=altered("1,FALSE", "-1"))) == [("an", False, 0), ("b", False, 0), ("ba", False, 0)]


def test_shards_are_bounded_and_route_every_id(spark):
    ids = spark.createDataFrame([(k * k,) for k in range(1000)], "node_id long")
    ranges = models.shard_ranges(ids, 64)
    got = models.routed(ids, ranges, "node_id").groupBy("shard").count().collect()
    assert len(got) == 16 and max(r["count"] for r in got) == 64 and sum(r["count"] for r in got) == 1000
    asked = spark.createDataFrame([(None,), (-5,), (1,), (64 * 64 - 1,), (64 * 64,), (10**9,)], "node_id long")
    assert sorted((str(r["node_id"]), r["shard"]) for r in models.routed(asked, ranges, "node_id").collect()) == sorted([("None", 0), ("-5", 0), ("1", 0), ("4095", 0), ("4096", 1), (str(10**9), 15)])
    assert models.routed(asked, ranges.limit(0), "node_id").where("shard is null").count() == 6


def test_ordinals_of_a_hot_value_and_of_groups(spark):
    hot = spark.range(3000).selectExpr("'con' || lpad(cast(id as string), 5, '0') word", "cast(if(id % 10 = 0, null, 'g') as string) g")
    got = ranks.by_word(hot, "n", by=["g"]).collect()
    for g in (None, "g"):
        own = sorted((r["word"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(len(own)))
    assert ranks.by_word(hot.limit(0)).collect() == []


def test_stored_trie_does_not_move(spark):
    stored.store(trie.build(words(spark, KNOWN)), "trie_in_test", 4)
    try:
        found = stored.search(spark, words(spark, ASKED), "trie_in_test")
        assert rows(found) == rows(trie.search(words(spark, ASKED), trie.build(words(spark, KNOWN))))
        plan = found._jdf.queryExecution().executedPlan().toString()
        node_side = plan[plan.rindex("FileScan parquet") - 400 :]
        assert "Bucketed: true" in plan and "Exchange" not in node_side
    finally:
        spark.sql("DROP TABLE trie_in_test")


def test_stream_ids_survive_restarts_reruns_and_compaction(spark, tmp_path):
    values = sorted({f"{a}{b}" * n for a in "abc" for b in "xyz" for n in (1, 2, 3)})
    whole = words(spark, values)
    path, source = str(tmp_path / "trie"), str(tmp_path / "words")
    for k in range(4):
        whole.where(f"ord div 7 = {k}").write.mode("append").parquet(source)
        streamed.insert_stream(spark.readStream.schema("word string, ord long").parquet(source), path, str(tmp_path / "progress")).awaitTermination()
    want = sorted((r["prefix"], r["data_id"], r["is_end"]) for r in trie.build_with_ids(whole).collect())
    now = lambda: sorted(tuple(r) for r in streamed.stored(spark, path).collect())
    assert now() == want
    streamed.insert_batch(path)(whole.where("ord div 7 = 3"), 3)  # the last batch again
    assert now() == want
    streamed.compact(spark, path, 3)
    assert now() == want and sorted(x for x in os.listdir(path) if x.startswith("batch")) == ["batch=2", "batch=3"]
    streamed.insert_batch(path)(whole.where("ord div 7 = 3"), 3)
    assert now() == want


def test_lines_keep_their_numbers_when_files_are_split(spark, tmp_path):
    for name, n in (("a.csv", 500), ("b.csv", 3)):
        (tmp_path / name).write_text("".join(f"{name[0]}{k},x\n" for k in range(n)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", held):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((os.path.basename(r["file"]), r["ord"], r["word"]) for r in lexicons.read_lines(spark, str(tmp_path)).collect())
            assert got == sorted((f, k, f"{f[0]}{k}") for f, n in (("a.csv", 500), ("b.csv", 3)) for k in range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_batches_count_once(spark, tmp_path):
    facts = spark.createDataFrame([(3, 0, "a"), (3, 1, "b"), (4, 0, "c")], "letters int, batch int, word string")
    path = str(tmp_path / "facts")
    sinks.overwrite_batches(facts, path)
    sinks.overwrite_batches(facts, path)
    sinks.overwrite_batches(facts.where("letters = 3 and batch = 1").selectExpr("letters", "batch", "'new' word"), path)
    assert sorted((r["letters"], r["batch"], r["word"]) for r in spark.read.parquet(path).collect()) == [(3, 0, "a"), (3, 1, "new"), (4, 0, "c")]


def test_quarantine_splits_and_counts(spark, tmp_path):
    given = spark.createDataFrame([("ok",), ("ok",), (None,), ("",), ("No",), ("n0",)], "word string")
    seen = quality.quarantine(given, str(tmp_path / "q"))
    assert seen == {"read": 6, "kept": 2, "rejected": 4}
    got = spark.read.parquet(str(tmp_path / "q"))
    assert sorted(str((r["word"], r["reason"])) for r in got.where("not kept").collect()) == sorted(map(str, [(None, "missing"), ("", "empty"), ("No", "upper case"), ("n0", "other characters")]))


def test_search_as_sql(spark):
    catalog.register(spark, trie.build(words(spark, KNOWN)), words(spark, ASKED), "trie_search_test")
    assert rows(spark.sql("SELECT * FROM trie_search_test()")) == rows(trie.search(words(spark, ASKED), trie.build(words(spark, KNOWN))))
    plan = spark.sql("SELECT * FROM trie_search_test() WHERE found")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.sql("SELECT word_prefixes('abc') p, word_prefixes('') e, letter_index('c') i, in_alphabet('aB') o").first() == (["a", "ab", "abc"], [], 2, False)
