"""Goldens, cross-backend equivalence and invariants of the lexicon operators."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import words as W
from prefixloom.functions.ranks import by_hash, by_word
from prefixloom.operators import growth, levels, models, patterns, rules, sampling, trie
from prefixloom.plans import experiments
from prefixloom.sources import lexicons, sinks
from prefixloom.streaming import incremental

WORDS = ["car", "cart", "care", "a", "ad", "add", "ring", "ring", "cat", "dog", "do"]


def lexicon(spark, words=None):
    return lexicons.from_words(spark, WORDS if words is None else words)


def walk(words, query):
    """An independent pointer walk: found and height."""
    root = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        if w:
            node[""] = True
    node, height = root, 0
    for c in query:
        if c not in node:
            return False, height
        node, height = node[c], height + 1
    return bool(query) and "" in node, height


def test_build_and_ids(spark):
    nodes = {r.prefix: r for r in trie.build_with_ids(lexicon(spark)).collect()}
    assert set(nodes) == {w[:k] for w in WORDS for k in range(1, len(w) + 1)}
    assert {p for p, r in nodes.items() if r.is_end} == set(WORDS)
    order = list(dict.fromkeys(w[:k] for w in WORDS for k in range(1, len(w) + 1)))
    assert [nodes[p].data_id for p in order] == list(range(1, len(order) + 1))
    assert all(r.node_id == 2 * r.data_id for r in nodes.values())


def test_golden_ids(spark):
    words = ["a", "ad", "add", "ag", "age", "ago", "ai"]
    assert {r.prefix: r.node_id for r in trie.build_with_ids(lexicon(spark, words)).collect()} == {"a": 2, "ad": 4, "add": 6, "ag": 8, "age": 10, "ago": 12, "ai": 14}


def test_edges_and_relations(spark):
    nodes = trie.build_with_ids(lexicon(spark))
    edges = sinks.edge_rows(trie.edges(nodes)).collect()
    assert ("null", "null", "0", "false") in {tuple(r) for r in edges} and len(edges) == nodes.count() + 1
    model = {(r.model, r.key): r.out for r in trie.relations(nodes).collect()}
    at = "0"
    for c in "cart":
        at = model["TrieModel", f"{at},{ord(c) - 97}"]
        assert model["TrieCheck", at] == str(ord(c) - 97)
    assert model["TrieEnd", at] == "TRUE" and model["TrieEnd", "0"] == "FALSE"


def test_searches_agree(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    asked = sorted({*known[:20], *("".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(120)), ""})
    nodes, queries = trie.build(lexicon(spark, known)), lexicon(spark, asked)
    want = {q: walk(known, q) for q in asked}
    level = levels.buckets(lexicon(spark, known)).withColumnRenamed("is_word", "is_end")
    for got in (trie.search(queries, nodes), rules.search(queries, nodes), trie.search(queries, level)):
        assert {r.word: (r.found, r.height) for r in got.collect()} == want
    listed = {r.word: (r.found, r.height) for r in trie.search_list(queries, lexicon(spark, known)).collect()}
    assert listed == {q: (q in known, known.index(q) if q in known else len(known)) for q in asked}


def test_stop_at_space_and_odd_words(spark):
    nodes = trie.build(lexicon(spark, ["car", "c d", "é1"]))
    got = {r.word: (r.found, r.height) for r in rules.search(lexicon(spark, ["car x", "car", "é1"]), nodes).collect()}
    assert got == {"car x": (True, 3), "car": (True, 3), "é1": (True, 2)}
    assert trie.search(lexicon(spark, ["c d"]), nodes).first().found
    assert rules.search(lexicon(spark, ["car x"]), nodes, stop_at_space=False).first().found is False


def test_insert_is_idempotent(spark):
    words = lexicon(spark)
    once = trie.build(words)
    key = lambda df: sorted((r.prefix, r.is_end) for r in df.select("prefix", "is_end").collect())
    assert key(trie.insert(once, words)) == key(once) == key(rules.insert(words))
    assert key(levels.buckets(words).withColumnRenamed("is_word", "is_end")) == key(once) == key(levels.by_barriers(words, 5).withColumnRenamed("is_word", "is_end"))
    more = trie.get_or_create(trie.build_with_ids(words), lexicon(spark, ["cars", "car"])).collect()
    assert [(r.prefix, r.data_id) for r in more] == [("cars", once.count() + 1)]


def test_patterns(spark):
    pairs = patterns.build(spark.createDataFrame([("car", "1"), ("cart", "2")], "word string, pattern string"))
    asked = spark.createDataFrame([("car", "1"), ("car", "2"), ("cart", "1"), ("cart", "2"), ("x", "1")], "word string, pattern string")
    got = {(r.word, r.pattern): (r.found, r.height) for r in patterns.search(asked, pairs).collect()}
    assert got == {("car", "1"): (True, 3), ("car", "2"): (True, 3), ("cart", "1"): (False, 3), ("cart", "2"): (True, 4), ("x", "1"): (False, 0)}
    ids = patterns.dense_ids(spark.createDataFrame([([1, -1], 0), ([-1, 1], 1), ([1, -1], 2)], "vector array<int>, ord long")).collect()
    assert {tuple(r.vector): r.pattern_id for r in ids} == {(1, -1): 0, (-1, 1): 1}
    assert {r.prefix: r.patterns for r in patterns.node_patterns(pairs).collect()}["car"] == ["1", "2"]


def test_growth_adds_up(spark):
    words = lexicon(spark).select("word").distinct().withColumn("letters", F.lit(9))
    for facts in (growth.in_word_order(words, ["letters"]),):
        rows = sorted(facts.collect(), key=lambda r: r.num_words)
        assert [r.word for r in rows] == sorted(set(WORDS))
        assert sum(r.new_letters for r in rows) == trie.build(lexicon(spark)).count()
    level = sorted(growth.in_level_order(words, ["letters"]).collect(), key=lambda r: r.num_words)
    assert [r.word for r in level] == sorted((w for w in set(WORDS) if len(w) > 1), key=lambda w: (len(w), w))


def test_sampling_rules(spark):
    words = lexicon(spark, [f"w{k}" for k in range(11)])
    assert sampling.fraction(words, 2).count() == 5 and sampling.fraction(words, 6).count() == 1 and sampling.fraction(words, 20).count() == 11
    parts = {r.part: r.n for r in sampling.halves(words).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"test": 5, "train": 5}
    balanced = sampling.balanced(lexicon(spark, ["a", "b"]), lexicon(spark, ["x", "y", "z"])).groupBy("is_known").count().collect()
    assert {r["is_known"]: r["count"] for r in balanced} == {True: 2, False: 2}
    assert sampling.difference(lexicon(spark, ["a", "a", "b"]), lexicon(spark, ["b"])).count() == 2
    assert [r.ord for r in by_word(words.select("word")).orderBy("word").collect()] == list(range(11))
    assert sorted(r.place for r in by_hash(words, "place").collect()) == list(range(11))


def test_access_has_no_errors(spark):
    own = lexicon(spark, ["abc", "abd", "xyz", "ab", "b", "cab"]).select("word")
    other = lexicon(spark, ["zzz", "abz", "q", "by"]).select("word")
    facts = experiments.access(own, other, 2, 4, 3).collect()
    assert facts and all(r.word_known == r.result for r in facts)
    for r in facts:
        assert (r.result, r.height) == walk([w.word for w in own.collect() if len(w.word) <= r.letters], r.word)


def test_rules(spark, tmp_path):
    table = rules.builtin_rules(spark)
    states = [r.state for r in rules.trace(table, ["SearchLoop"]).orderBy("step").collect()]
    assert states == [0, 1, 2, 3, 4, 5, 6, 7, 8, -1]
    (tmp_path / "Demo.csv").write_text("aIn,bIn,out,more\n1,2,x,9\n3,4,y,9\n")
    got = {(r.model, r.key): r.out for r in rules.read_rules(spark, str(tmp_path), ["Demo"]).collect()}
    assert got == {("Demo", "1,2"): "x", ("Demo", "3,4"): "y"}
    asked = spark.createDataFrame([("Demo", "0,0")], "model string, key string")
    assert rules.lookup(asked, table).first().out is None
    with pytest.raises(Exception, match="no rule"):
        rules.lookup_all(asked, table).collect()
    changes = spark.createDataFrame([("Demo", "k", "1", 1), ("Demo", "k", "2", 2)], "model string, key string, out string, seq long")
    assert [r.out for r in rules.upsert(table.limit(0), changes).collect()] == ["2"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d.csv").write_text("b\na\nb")
    assert [r.word for r in lexicons.read_words(spark, str(tmp_path / "d.csv")).orderBy("ord").collect()] == ["b", "a", "b"]
    (tmp_path / "s.csv").write_text("word,length,f0,f1\nab,2,x,\n")
    rows = lexicons.read_syllables(spark, str(tmp_path / "s.csv"), 2).collect()
    assert [list(r.vector) for r in rows] == [[1, 1], [1, -1]]
    assert lexicons.read_columns(spark, str(tmp_path / "s.csv"), ["w", "n", "a", "b"], skip_header=True).count() == 1
    out = str(tmp_path / "out")
    frame = lexicon(spark, ["a"])
    sinks.overwrite_csv(frame, out)
    sinks.append_csv(frame, out)
    assert spark.read.csv(out, header=True).count() == 2
    sinks.truncate(frame, out)
    assert spark.read.schema("word string, ord long").csv(out, header=True).count() == 0
    sinks.export_edges(trie.edges(trie.build_with_ids(frame)), out)
    assert spark.read.csv(out, header=True).columns == ["parentNodeIdIn", "nodeIndexIn", "nodeIdOut", "isEndOfWordOut"]
    assert lexicons.non_words(spark, lexicon(spark, ["aa", "ab"]), 2, "ab").count() == 2


def test_word_functions(spark):
    row = spark.createDataFrame([("car", "cart", None, b"ab\x00c")], "a string, b string, n int, d binary").select(
        W.common_prefix_length(F.col("a"), F.col("b")).alias("lcp"), W.null_text(F.col("n")).alias("null"), W.cut_at_nul(F.col("d")).alias("cut"), W.falsy(F.col("n").cast("boolean")).alias("falsy"), W.quantised(F.lit(0.37), 0.25).alias("q"), W.upper_flag(F.lit(True)).alias("up"),
    ).first()
    assert (row.lcp, row["null"], row.cut, row.falsy, row.q, row.up) == (3, "null", "ab", True, 0.25, "TRUE")


def test_models(spark):
    rng = random.Random(5)
    words = lexicon(spark, sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(200)}))
    nodes = trie.build(words)
    model = models.fit_end_model(nodes, rounds=3)
    got = models.search(words, nodes, model)
    assert got.count() == words.count() and got.where("height <> length(word)").count() == 0
    border = spark.createDataFrame([(994,), (996,), (1994,), (1996,)], "id long").select(models.shard(F.col("id")).alias("a"), models.switch_shard(F.col("id")).alias("b")).collect()
    assert [(r.a, r.b) for r in border] == [(0, 0), (1, 0), (1, 1), (2, 2)]
    assert abs(sum(r.share for r in models.priors(nodes, "is_end").collect()) - 1) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    os.makedirs(source)
    path = str(tmp_path / "trie")
    for k, part in enumerate((WORDS[:4], WORDS[4:])):
        (source / f"{k}.csv").write_text("\n".join(part))
        stream = spark.readStream.schema("word string").csv(str(source))
        incremental.insert_stream(stream, path, str(tmp_path / "ck")).awaitTermination()
    key = lambda df: sorted((r.prefix, r.is_end) for r in df.collect())
    assert key(incremental.stored(spark, path)) == key(trie.build(lexicon(spark)))


def test_heights_of_all_limits_from_one_trie(spark):
    words = ["a", "ab", "abc", "abcde", "abcdef", "b", "bcd", "zzzz", "zz", "zz", ""]
    asked = ["abcdeg", "abcd", "a", "zzz", "q", "bcd", "abcdef", ""]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = {r.word: (r.found, r.heights) for r in experiments.heights(frame(asked), frame(words), 1, 5).collect()}
    for q in asked:
        want = [max([k for k in range(1, len(q) + 1) if any(w[:k] == q[:k] and len(w) >= k and len(w) <= x for w in words)], default=0) for x in range(1, 6)]
        assert got.get(q, (False, [0] * 5)) == (bool(q) and q in words and len(q) <= 5, want)
    rows = {r.letters: (r["rows"], r.num_words) for r in experiments.limits(frame(words), 1, 4).collect()}
    assert rows == {1: (3, 3), 2: (6, 5), 3: (8, 7), 4: (9, 8)}
    assert experiments.limits(frame(["abc"]), 1, 2).count() == 0 and experiments.heights(frame([]), frame(words), 1, 5).count() == 0


def test_stimuli_against_brute_force(spark):
    own, other = ["a", "b", "ab", "abc", "cab", "dab"], ["ba", "cba", "bac", "bad", "x"]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = sorted((r.letters, r.batch, r.is_known, r.word) for r in experiments.stimuli(frame(own), frame(other), 1, 3, 3).collect())
    want = []
    for letters in range(1, 4):
        for batch in range(3):
            order = lambda x: sorted((w for w in x if len(w) <= letters), key=lambda w: (hashlib.md5(f"{w}{batch}".encode()).hexdigest(), w))  # noqa: E731, B023
            known = order(own)
            known = known[: len(known) // 2 or len(known)]
            want += [(letters, batch, True, w) for w in known] + [(letters, batch, False, w) for w in order(other)[: len(known)]]
    assert got == sorted(want)
    assert experiments.access(frame([]), frame(other), 1, 3, 2).count() == 0
