"""Queries that run the whole experiment, or over all words, against brute force on a small table."""

import hashlib

import pytest

from prefixloom.plans import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Words of 1 to 20 letters, in two languages."""
    where = str(tmp_path_factory.mktemp("tables"))
    rows = [(1, "a an and ant bee been bent abcdefghij", "en"), (2, "ant abend abcdefghijk pneumonoultramicrosc", "de"), (3, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{where}/documents.parquet")
    return where


WORDS = sorted("a an and ant bee been bent abend abcdefghij abcdefghijk pneumonoultramicrosc".split())


def test_access_runs_all_trials(spark, folder):
    own = [w for w in WORDS if len(w) <= 9]
    others = {w[::-1] for w in own} - set(own)
    want = set()
    for letters in range(3, 10):
        fit = [w for w in own if len(w) <= letters]
        prefixes = {w[:k] for w in fit for k in range(len(w) + 1)}
        for batch in range(10):
            drawn = lambda ws: sorted(ws, key=lambda w: (hashlib.md5(f"{w}{batch}".encode()).hexdigest(), w))  # noqa: B023, E731
            known = drawn(fit)[: len(fit) // 2 or None]
            for w in known + drawn([w for w in others if len(w) <= letters])[: len(known)]:
                want.add((letters, batch, w, w in own, len(w), len(fit), w in own, max(k for k in range(len(w) + 1) if w[:k] in prefixes)))
    facts = [tuple(r) for r in queries.access_facts(spark, folder).collect()]
    assert len(facts) == len(want) and set(facts) == want
    assert sum(r.n for r in queries.access_confusion(spark, folder).collect()) == len(want)
    assert {(r.letters, r.batch) for r in queries.mean_of_repeats(spark, folder).collect()} == {(n, b) for n in range(3, 10) for b in range(10)}


def test_all_words_are_built(spark, folder):
    prefixes = {w[:k] for w in WORDS for k in range(1, len(w) + 1)}
    for name in ("trie_nodes", "trie_node_ids", "ancestor_walk", "level_buckets", "insert_rules"):
        rows = queries.QUERIES[name](spark, folder).collect()
        assert len(rows) == len(prefixes) and {r.prefix for r in rows} == prefixes
    for name in ("trie_edges", "edge_export"):
        assert queries.QUERIES[name](spark, folder).count() == len(prefixes) + 1
    assert {r.word for r in queries.QUERIES["trie_end_words"](spark, folder).collect()} == set(WORDS)
    assert {r.word for r in queries.QUERIES["lexicon_words"](spark, folder).collect()} == set(WORDS)
    patterns = {r.prefix: r.patterns for r in queries.QUERIES["pattern_nodes"](spark, folder).collect()}
    assert set(patterns) == prefixes | {""} and patterns[WORDS[-1]] == ["de"] and patterns["ant"] == ["de", "en"]


def test_growth_sweeps_all_limits(spark, folder):
    got = {(r.letters, r.word, r.num_words) for r in queries.growth_list(spark, folder).collect()}
    assert got == {(n, w, k) for n in range(3, 12) for k, w in enumerate(w for w in WORDS if len(w) <= n)}
    want = set()
    for n in range(3, 12):
        before = ""
        for k, w in enumerate(sorted((w for w in WORDS if 2 <= len(w) <= n), key=lambda w: (len(w), w))):
            want.add((n, w, len(w), k, len(w), next(len(w) - j for j in range(len(w), -1, -1) if before[:j] == w[:j])))
            before = w
    assert {tuple(r) for r in queries.growth_bfs(spark, folder).collect()} == want
