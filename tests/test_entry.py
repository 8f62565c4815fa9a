"""The registered library queries against their SQL on the smallest tables, where those are there."""

import os

import pytest

import __spark_entry__
from prefixloom.plans import queries

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", [
    "trie_node_ids", "search_symbolic", "growth_bfs", "pattern_nodes", "shard_routing", "search_rules", "search_rules_checked", "search_rules_altered", "search_rules_once", "search_relations",
    "search_relations_edited", "search_neighbours", "search_stored", "search_function", "words_of_edges", "shard_sizes", "shard_of_parents", "json_operands", "rule_lookup", "previous_letter_check", "model_switch",
    "zipped_words", "text_forms", "csv_round_trip", "csv_truncate", "batches_once", "quarantine", "dictionary_lines", "stream_node_ids", "syllable_scan", "rule_files",
])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    want = c.execute(queries.ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    at = {d[0]: k for k, d in enumerate(want.description)}
    rows = sorted(tuple(str(r[at[x]]) for x in columns) for r in want.fetchall())
    got = sorted(tuple(str(r[x]) for x in columns) for r in queries.QUERIES[name](spark, FOLDER).collect())
    assert got == rows


def test_plans_push_columns_down(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    plan = queries.trie_nodes(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
