"""The library as SQL functions of a session: letters and prefixes as scalar functions, search as a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCALARS = {
    "letter_index": "(letter STRING) RETURNS INT RETURN ascii(letter) - 97",
    "word_prefixes": "(word STRING) RETURNS ARRAY<STRING> RETURN IF(length(word) > 0, transform(sequence(1, length(word)), i -> substring(word, 1, i)), CAST(array() AS ARRAY<STRING>))",
    "in_alphabet": "(word STRING) RETURNS BOOLEAN RETURN word RLIKE '^[a-z]+$'",
}

_SEARCH = """() RETURNS TABLE (word STRING, found BOOLEAN, height INT) RETURN
SELECT q.word, coalesce(h.found, false), coalesce(h.height, 0)
FROM (SELECT DISTINCT word FROM {asked}) q LEFT JOIN (
  SELECT s.word, max(n.depth) AS height, max(n.is_end AND n.depth = length(s.word)) AS found
  FROM (SELECT word, explode(prefixes) AS prefix FROM (SELECT DISTINCT word, word_prefixes(word) AS prefixes FROM {asked})) s JOIN {nodes} n ON n.prefix = s.prefix
  GROUP BY s.word) h ON h.word = q.word"""


def register(spark: SparkSession, nodes: DataFrame | None = None, asked: DataFrame | None = None, name: str = "trie_search") -> None:
    """Registers the scalar functions and, with nodes and query words, the table function ``name`` over them.

    The frames stand behind temporary views named after the function; all are
    expanded by the planner, nothing of them runs outside the JVM.
    """
    for function, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}{body}")
    if nodes is not None and asked is not None:
        nodes.createOrReplaceTempView(f"{name}_nodes")
        asked.createOrReplaceTempView(f"{name}_asked")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{_SEARCH.format(nodes=f'{name}_nodes', asked=f'{name}_asked')}")
