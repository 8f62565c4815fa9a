"""The library's registered queries over the driver's tables, and the same in DuckDB SQL.

The dictionary is made of the texts: all runs of a to z, whatever their length.
Queries that build take every word.  Those that need unknown words too (searches,
non-words, access) know the words of up to nine letters and are asked for all.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.functions import catalog
from prefixloom.functions import words as W
from prefixloom.functions.ranks import by_word
from prefixloom.operators import boosting, compiled, growth, learned, levels, models, neighbours, patterns, quality, relations, rules, sampling, stored, trie
from prefixloom.plans import experiments
from prefixloom.shared import cut, drop_dir, scratch
from prefixloom.sources import lexicons, sinks
from prefixloom.streaming import ids as streamed

#: Letters of the longest word that searches know.
KNOWN = 9

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _trie_tables(words: str, mark: str = "") -> dict[str, str]:
    """The nodes of a table of words, and their ids; ``mark`` begins the names."""
    return {
        f"{mark}pre": f"SELECT word, ord, depth, substr(word, 1, depth) AS prefix FROM (SELECT word, ord, unnest(range(1, length(word) + 1)) AS depth FROM {words})",
        f"{mark}nodes": f"SELECT prefix, substr(prefix, 1, length(prefix) - 1) AS parent, ascii(right(prefix, 1)) - 97 AS letter_index, length(prefix) AS depth, bool_or(prefix = word) AS is_end, min(ord) AS first_ord FROM {mark}pre GROUP BY prefix",
        f"{mark}ids": f"SELECT *, row_number() OVER (ORDER BY first_ord, depth) AS data_id FROM {mark}nodes",
    }


#: Tables that the SQL of several queries shares; ``lex`` has all words, ``dict`` those that searches know, and k stands for known.
_TABLES = {
    "runs": "SELECT lang, unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents",
    "lex": "SELECT word, row_number() OVER (ORDER BY word) - 1 AS ord FROM (SELECT DISTINCT word FROM runs)",
    "dict": f"SELECT word, row_number() OVER (ORDER BY word) - 1 AS ord FROM lex WHERE length(word) <= {KNOWN}",
    **_trie_tables("lex"),
    **_trie_tables("dict", "k"),
    "qpre": "SELECT word, unnest(range(1, length(word) + 1)) AS depth FROM lex",
    "hits": "SELECT q.word, max(q.depth) AS h, bool_or(n.is_end AND n.depth = length(q.word)) AS f FROM qpre q JOIN knodes n ON n.prefix = substr(q.word, 1, q.depth) GROUP BY q.word",
    "found": "SELECT lex.word, coalesce(f, false) AS found, coalesce(h, 0) AS height FROM lex LEFT JOIN hits USING (word)",
}


def _with(sql: str, recursive: bool = False) -> str:
    """The SQL after those of the shared tables that it reads."""
    used: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        fresh = {n for n in _TABLES if n not in used and re.search(rf"(?:FROM|JOIN|,) {n}\b", text)}
        used |= fresh
        texts += [_TABLES[n] for n in fresh]
    shared = ",\n".join(f"{n} AS MATERIALIZED ({_TABLES[n]})" for n in _TABLES if n in used)
    start = "WITH RECURSIVE " if recursive else "WITH "
    rest = sql.strip()
    if not shared:
        return start + rest[1:] if rest.startswith(",") else rest
    return start + shared + "\n" + rest


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function under its name, with its SQL after the shared tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = _with(sql, recursive)
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.words_of_texts(documents(spark, sf_dir))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, ord: all words in order."""
    return by_word(all_words(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(all_words(spark, sf_dir))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build_with_ids(lexicon(spark, sf_dir))


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that searches know."""
    return lexicons.words_of_texts(documents(spark, sf_dir), longest=KNOWN)


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, ord of the words that searches know."""
    return by_word(known_words(spark, sf_dir))


def known_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(known_words(spark, sf_dir))


@query(" SELECT word, ord, length(word) AS word_length FROM lex")
def lexicon_words(spark, sf_dir):
    return lexicon(spark, sf_dir).select("word", "ord", F.length("word").cast("long").alias("word_length"))


@query(" SELECT prefix, parent, letter_index, depth, is_end FROM nodes")
def trie_nodes(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(" SELECT prefix, is_end, first_ord, data_id, 2 * data_id AS node_id FROM ids")
def trie_node_ids(spark, sf_dir):
    return ids(spark, sf_dir).select("prefix", "is_end", "first_ord", "data_id", "node_id")


@query(" SELECT coalesce(2 * p.data_id, 0) AS parent_node_id, n.letter_index AS node_index, 2 * n.data_id AS node_id, n.is_end FROM ids n LEFT JOIN ids p ON n.parent = p.prefix UNION ALL SELECT NULL, NULL, 0, false")
def trie_edges(spark, sf_dir):
    return trie.edges(ids(spark, sf_dir))


@query("""
SELECT CAST(coalesce(2 * p.data_id, 0) AS VARCHAR) AS "parentNodeIdIn", CAST(n.letter_index AS VARCHAR) AS "nodeIndexIn", CAST(2 * n.data_id AS VARCHAR) AS "nodeIdOut", CAST(n.is_end AS VARCHAR) AS "isEndOfWordOut"
FROM ids n LEFT JOIN ids p ON n.parent = p.prefix UNION ALL SELECT 'null', 'null', '0', 'false'""")
def edge_export(spark, sf_dir):
    return sinks.edge_rows(trie.edges(ids(spark, sf_dir)))


@query("""
SELECT 'TrieModel' AS model, coalesce(p.data_id, 0) || ',' || n.letter_index AS key, CAST(n.data_id AS VARCHAR) AS out FROM ids n LEFT JOIN ids p ON n.parent = p.prefix
UNION ALL SELECT 'TrieEnd', CAST(data_id AS VARCHAR), upper(CAST(is_end AS VARCHAR)) FROM ids
UNION ALL SELECT 'TrieCheck', CAST(data_id AS VARCHAR), CAST(letter_index AS VARCHAR) FROM ids
UNION ALL VALUES ('TrieModel', 'null,null', '0'), ('TrieCheck', 'null', 'null'), ('TrieCheck', '0', 'null'), ('TrieEnd', 'null', 'FALSE'), ('TrieEnd', '0', 'FALSE')""")
def trie_relations(spark, sf_dir):
    return trie.relations(ids(spark, sf_dir))


@query(" SELECT prefix AS word, depth FROM nodes WHERE is_end")
def trie_end_words(spark, sf_dir):
    return nodes(spark, sf_dir).where("is_end").select(F.col("prefix").alias("word"), "depth")


@query(" SELECT depth, count(*) AS nodes, count(*) FILTER (is_end) AS ends FROM nodes GROUP BY depth")
def nodes_per_depth(spark, sf_dir):
    return trie.depth_counts(nodes(spark, sf_dir))


@query(" SELECT parent AS prefix, count(*) AS children, min(letter_index) AS first_letter, max(letter_index) AS last_letter FROM nodes GROUP BY parent")
def children_per_node(spark, sf_dir):
    return trie.children_counts(nodes(spark, sf_dir))


@query(" SELECT depth, letter_index, count(*) AS nodes FROM nodes GROUP BY depth, letter_index")
def letter_distribution(spark, sf_dir):
    return trie.letter_counts(nodes(spark, sf_dir))


@query(" SELECT prefix, list_transform(range(1, depth), lambda k: substr(prefix, 1, k)) AS path FROM nodes")
def ancestor_walk(spark, sf_dir):
    return trie.ancestors(nodes(spark, sf_dir))


@query(" SELECT substr(word, 1, 1) AS letter, count(*) AS words, bool_or(length(word) = 1) AS is_word FROM lex GROUP BY 1")
def first_letter_buckets(spark, sf_dir):
    return levels.first_letters(all_words(spark, sf_dir))


_LEVELS = " SELECT prefix, depth, bool_or(prefix = word) AS is_word, count(*) FILTER (length(word) > depth) AS rests FROM pre GROUP BY prefix, depth"


@query(_LEVELS)
def level_buckets(spark, sf_dir):
    return levels.buckets(all_words(spark, sf_dir))


@query(f" SELECT depth, max(rests) AS largest, count(*) AS nodes FROM ({_LEVELS}) GROUP BY depth")
def max_bucket_per_level(spark, sf_dir):
    return levels.largest_buckets(levels.buckets(all_words(spark, sf_dir)))


@query(f" SELECT substr(prefix, 1, depth - 1) AS prefix, max(rests) AS largest FROM ({_LEVELS}) GROUP BY 1")
def sibling_max_bucket(spark, sf_dir):
    return levels.sibling_largest(levels.buckets(all_words(spark, sf_dir)))


@query(" SELECT word, length(word) AS level FROM lex WHERE length(word) >= 2")
def init_stats(spark, sf_dir):
    return levels.init_stats(levels.buckets(all_words(spark, sf_dir)))


@query(" SELECT * FROM found")
def search_symbolic(spark, sf_dir):
    return trie.search(all_words(spark, sf_dir), known_nodes(spark, sf_dir))


@query(" SELECT lex.word, d.ord IS NOT NULL AS found, coalesce(d.ord, (SELECT count(*) FROM dict)) AS height FROM lex LEFT JOIN dict d USING (word)")
def search_list(spark, sf_dir):
    return trie.search_list(all_words(spark, sf_dir), known(spark, sf_dir))


@query(" SELECT * FROM found")
def search_local(spark, sf_dir):
    level = levels.buckets(known_words(spark, sf_dir)).withColumnRenamed("is_word", "is_end")
    return trie.search(all_words(spark, sf_dir), level)


@query(" SELECT * FROM found")
def search_rules(spark, sf_dir):
    return rules.search(all_words(spark, sf_dir), known_nodes(spark, sf_dir))


@query(" SELECT prefix, is_end FROM nodes")
def insert_rules(spark, sf_dir):
    return rules.insert(all_words(spark, sf_dir))


@query(" SELECT word, found AS found_trie, found AS found_list, height AS height_trie, height AS height_rules FROM found")
def backend_compare(spark, sf_dir):
    asked = cut(all_words(spark, sf_dir))  # three searches read them; the texts are read once
    known_ones = asked.where(F.length("word") <= KNOWN).select("word")
    own = cut(trie.build(known_ones))
    a = trie.search(asked, own).select("word", F.col("found").alias("found_trie"), F.col("height").alias("height_trie"))
    b = trie.search_list(asked, by_word(known_ones)).select("word", F.col("found").alias("found_list"))
    c = rules.search(asked, own).select("word", F.col("height").alias("height_rules"))
    return a.join(b, "word").join(c, "word")


def _patterned(spark, sf_dir, longest=None):
    return lexicons.words_of_texts(documents(spark, sf_dir), "text", longest, "lang").withColumnRenamed("lang", "pattern")


_PAIRS = """
, wp AS (SELECT DISTINCT word, lang AS pattern FROM runs{limit}),
pp AS (SELECT DISTINCT substr(word, 1, depth) AS prefix, pattern FROM (SELECT word, pattern, unnest(range(1, length(word) + 1)) AS depth FROM wp)),
"""


@query(f"{_PAIRS.format(limit='')} al AS (SELECT prefix, pattern, is_end FROM pp JOIN nodes USING (prefix) UNION ALL SELECT DISTINCT '', pattern, false FROM wp) SELECT prefix, list_sort(list(pattern)) AS patterns, bool_or(is_end) AS is_end FROM al GROUP BY prefix")
def pattern_nodes(spark, sf_dir):
    return patterns.node_patterns(patterns.build(_patterned(spark, sf_dir)))


_ASKED = f"""{_PAIRS.format(limit=f" WHERE length(word) <= {KNOWN}")}
aq AS (SELECT DISTINCT word, lang AS pattern FROM runs),
ah AS (SELECT q.word, q.pattern, max(q.depth) AS h, bool_or(n.is_end AND n.depth = length(q.word)) AS f FROM (SELECT word, pattern, unnest(range(1, length(word) + 1)) AS depth FROM aq) q
       JOIN pp ON pp.prefix = substr(q.word, 1, q.depth) AND pp.pattern = q.pattern JOIN knodes n ON n.prefix = pp.prefix GROUP BY ALL)
"""


@query(f"{_ASKED} SELECT aq.word, aq.pattern, coalesce(f, false) AS found, coalesce(h, 0) AS height FROM aq LEFT JOIN ah USING (word, pattern)")
def search_pattern(spark, sf_dir):
    return patterns.search(_patterned(spark, sf_dir), patterns.build(_patterned(spark, sf_dir, KNOWN)))


@query(f"{_ASKED} SELECT aq.pattern, count(*) AS queries, count(*) FILTER (coalesce(ah.f, false)) AS found_with, count(*) FILTER (found.found) AS found_plain, sum(found.height - coalesce(ah.h, 0))::BIGINT AS lost_height FROM aq LEFT JOIN ah USING (word, pattern) JOIN found USING (word) GROUP BY aq.pattern")
def pattern_compare(spark, sf_dir):
    a = patterns.search(_patterned(spark, sf_dir), patterns.build(_patterned(spark, sf_dir, KNOWN)))
    b = trie.search(all_words(spark, sf_dir), known_nodes(spark, sf_dir)).select("word", F.col("found").alias("plain"), F.col("height").alias("plain_height"))
    count = lambda c: F.sum(F.col(c).cast("long"))
    return a.join(b, "word").groupBy("pattern").agg(F.count(F.lit(1)).alias("queries"), count("found").alias("found_with"), count("plain").alias("found_plain"), F.sum(F.col("plain_height") - F.col("height")).alias("lost_height"))


LANGS = ("de", "en", "es", "fr")


def _vectors(spark, sf_dir):
    pairs = _patterned(spark, sf_dir)
    flags = pairs.groupBy("word").agg(*[F.max(F.when(F.col("pattern") == x, F.lit("1"))).alias(x) for x in LANGS])
    return by_word(flags).select("word", "ord", F.array(*[W.presence(F.col(x)) for x in LANGS]).alias("vector"))


_VECTORS = f", v AS (SELECT word, [{', '.join(f'CASE WHEN bool_or(lang = {x!r}) THEN 1 ELSE -1 END' for x in LANGS)}] AS vector FROM runs GROUP BY word), vi AS (SELECT vector, row_number() OVER (ORDER BY min(ord)) - 1 AS pattern_id FROM v JOIN lex USING (word) GROUP BY vector)"


@query(f"{_VECTORS} SELECT vector, pattern_id FROM vi")
def pattern_dense_ids(spark, sf_dir):
    return patterns.dense_ids(_vectors(spark, sf_dir))


@query(f"{_VECTORS} SELECT word, CAST(length(word) AS VARCHAR) AS word_length, CAST(pattern_id AS VARCHAR) AS pattern_id FROM v JOIN vi USING (vector)")
def pattern_dictionary(spark, sf_dir):
    return patterns.with_ids(_vectors(spark, sf_dir)).select("word", F.length("word").cast("string").alias("word_length"), F.col("pattern_id").cast("string").alias("pattern_id"))


@query(" SELECT word FROM lex ANTI JOIN dict USING (word)")
def nonwords_anti(spark, sf_dir):
    return sampling.difference(all_words(spark, sf_dir), known_words(spark, sf_dir))


_ORDERED = ", o AS (SELECT word, row_number() OVER (ORDER BY md5(word), word) - 1 AS place, count(*) OVER () AS n FROM lex)"


@query(f"{_ORDERED} SELECT word FROM o WHERE n // 2 = 0 OR place < n // 2")
def sample_half(spark, sf_dir):
    return sampling.fraction(all_words(spark, sf_dir), 2)


@query(f"{_ORDERED} SELECT word FROM o WHERE n // 6 = 0 OR place < n // 6")
def sample_sixth(spark, sf_dir):
    return sampling.fraction(all_words(spark, sf_dir), 6)


@query(f"{_ORDERED} SELECT word, place FROM o")
def shuffled_words(spark, sf_dir):
    return sampling.shuffled(all_words(spark, sf_dir))


@query(f"{_ORDERED} SELECT word, CASE WHEN place < n // 2 THEN 'test' ELSE 'train' END AS part FROM o WHERE place < n // 2 OR place >= n - n // 2")
def half_split(spark, sf_dir):
    return sampling.halves(all_words(spark, sf_dir))


@query(""", u AS (SELECT word, row_number() OVER (ORDER BY md5(word), word) - 1 AS place FROM lex ANTI JOIN dict USING (word))
SELECT word, true AS is_known FROM dict UNION ALL SELECT word, false FROM u WHERE place < (SELECT count(*) FROM dict)""")
def balanced_stimuli(spark, sf_dir):
    own = known_words(spark, sf_dir)
    return sampling.balanced(own, sampling.difference(all_words(spark, sf_dir), own))


@query(" SELECT letters, count(*) AS words FROM lex, (SELECT unnest(range(3, 12)) AS letters) WHERE length(word) <= letters GROUP BY letters")
def length_sweep_counts(spark, sf_dir):
    return sampling.sweep(all_words(spark, sf_dir), 3, 11).groupBy("letters").agg(F.count(F.lit(1)).alias("words"))


@query(" SELECT ord // 1000 AS chunk, count(*) AS words, min(word) AS first_word FROM lex GROUP BY 1")
def chunk_sizes(spark, sf_dir):
    return sampling.chunks(lexicon(spark, sf_dir), 1000).groupBy("chunk").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("first_word"))


_LCP = "list_max(list_transform(range(0, least(length(previous), length(word)) + 1), lambda k: CASE WHEN substr(previous, 1, k) = substr(word, 1, k) THEN k ELSE 0 END))"


@query(f""", g AS (SELECT letters, word, row_number() OVER w - 1 AS num_words, lag(word, 1, '') OVER w AS previous FROM lex, (SELECT unnest(range(3, 12)) AS letters) WHERE length(word) <= letters WINDOW w AS (PARTITION BY letters ORDER BY word))
SELECT letters, word, length(word) AS word_length, num_words, length(word) AS read_letters, length(word) - {_LCP} AS new_letters FROM g""")
def growth_sorted(spark, sf_dir):
    return experiments.growth_sweep(all_words(spark, sf_dir))


_SWEEP = ", g AS (SELECT letters, word, row_number() OVER w - 1 AS num_words, lag(word, 1, '') OVER w AS previous FROM lex, (SELECT unnest(range(3, 12)) AS letters) WHERE length(word) BETWEEN {least} AND letters WINDOW w AS (PARTITION BY letters ORDER BY {order}))"


@query(f"{_SWEEP.format(least=2, order='length(word), word')} SELECT letters, word, length(word) AS word_length, num_words, length(word) AS read_letters, length(word) - {_LCP} AS new_letters FROM g")
def growth_bfs(spark, sf_dir):
    return growth.in_level_order(sampling.sweep(all_words(spark, sf_dir), 3, 11), ["letters"])


@query(f"{_SWEEP.format(least=1, order='word')} SELECT letters, word, length(word) AS word_length, num_words FROM g")
def growth_list(spark, sf_dir):
    return growth.of_list(by_word(sampling.sweep(all_words(spark, sf_dir), 3, 11), "num_words", by=["letters"]), ["letters"])


#: Trials of the experiment.
TRIALS = 10
_ACCESS = f"""
, sw AS (SELECT letters, batch, word, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY letters, batch) AS n FROM dict, (SELECT unnest(range(3, 10)) AS letters), (SELECT unnest(range({TRIALS})) AS batch) WHERE length(word) <= letters WINDOW w AS (PARTITION BY letters, batch ORDER BY md5(word || batch), word)),
kn AS (SELECT letters, batch, word FROM sw WHERE n // 2 = 0 OR place < n // 2),
kc AS (SELECT letters, batch, count(*) AS n FROM kn GROUP BY ALL),
inv AS (SELECT DISTINCT reverse(d.word) AS word FROM dict d WHERE NOT EXISTS (SELECT 1 FROM dict e WHERE e.word = reverse(d.word))),
un AS (SELECT letters, batch, word FROM (SELECT letters, batch, word, row_number() OVER (PARTITION BY letters, batch ORDER BY md5(word || batch), word) - 1 AS place FROM inv, (SELECT unnest(range(3, 10)) AS letters), (SELECT unnest(range({TRIALS})) AS batch) WHERE length(word) <= letters) JOIN kc USING (letters, batch) WHERE place < n),
st AS (SELECT letters, batch, word, true AS word_known FROM kn UNION ALL SELECT letters, batch, word, false FROM un),
ln AS (SELECT DISTINCT letters, prefix FROM kpre, (SELECT unnest(range(3, 10)) AS letters) WHERE length(word) <= letters),
nw AS (SELECT letters, count(*) AS num_words FROM dict, (SELECT unnest(range(3, 10)) AS letters) WHERE length(word) <= letters GROUP BY letters),
sp AS (SELECT letters, word, unnest(range(1, length(word) + 1)) AS k FROM (SELECT DISTINCT letters, word FROM st)),
dh AS (SELECT sp.letters, sp.word, max(k) AS h FROM sp JOIN ln ON ln.letters = sp.letters AND ln.prefix = substr(sp.word, 1, k) GROUP BY ALL),
fa AS (SELECT letters, batch, word, word_known, length(word) AS word_length, num_words, word_known AS result, coalesce(h, 0) AS height FROM st LEFT JOIN dh USING (letters, word) JOIN nw USING (letters))
"""


def _access(spark, sf_dir):
    own = cut(known_words(spark, sf_dir))  # read several times; the texts are read once
    reversed_words = cut(sampling.difference(own.select(F.reverse("word").alias("word")).distinct(), own))
    return experiments.access(own, reversed_words, 3, KNOWN, TRIALS)


@query(f"{_ACCESS} SELECT * FROM fa")
def access_facts(spark, sf_dir):
    return _access(spark, sf_dir)


@query(f"{_ACCESS} SELECT letters, word_known, result, count(*) AS n, sum(height)::BIGINT AS heights FROM fa GROUP BY ALL")
def access_confusion(spark, sf_dir):
    return experiments.confusion(_access(spark, sf_dir))


@query(f"{_ACCESS} SELECT letters, batch, (sum(height) / 10)::DOUBLE AS mean FROM fa GROUP BY ALL")
def mean_of_repeats(spark, sf_dir):
    return experiments.mean_of_repeats(_access(spark, sf_dir), ["letters", "batch"], "height", 10)


@query(" SELECT 'TrieEnd' AS model, prefix AS key, CASE WHEN depth > 1 THEN 'TRUE' ELSE 'FALSE' END AS out FROM nodes")
def rule_upsert(spark, sf_dir):
    own = nodes(spark, sf_dir)
    old = own.select(F.lit("TrieEnd").alias("model"), F.col("prefix").alias("key"), F.lit("FALSE").alias("out"))
    changed = own.where("depth > 1").select(F.lit("TrieEnd").alias("model"), F.col("prefix").alias("key"), F.lit("TRUE").alias("out"), F.col("depth").cast("long").alias("seq"))
    return rules.upsert(old, changed)


_NEW = "od AS (SELECT substr(word, 1, k) AS prefix, min(ord) AS first_ord, bool_or(k = length(word)) AS is_end FROM (SELECT word, ord, unnest(range(1, length(word) + 1)) AS k FROM lex) GROUP BY 1)"


@query(f""", {_NEW}, top AS (SELECT max(data_id) AS n FROM kids)
SELECT prefix, length(prefix) AS depth, is_end, n + row_number() OVER (ORDER BY first_ord, length(prefix)) AS data_id FROM od ANTI JOIN knodes USING (prefix), top""")
def get_or_create(spark, sf_dir):
    return trie.get_or_create(trie.build_with_ids(known(spark, sf_dir)), lexicon(spark, sf_dir))


@query(" SELECT prefix, parent, letter_index, depth, is_end FROM nodes")
def incremental_insert(spark, sf_dir):
    return trie.insert(known_nodes(spark, sf_dir), sampling.difference(all_words(spark, sf_dir), known_words(spark, sf_dir)))


_SHARD = "CASE WHEN 2 * data_id <= 994 THEN 0 WHEN 2 * data_id <= 1994 THEN 1 ELSE 2 END"
_SWITCH = "CASE WHEN 2 * data_id < 996.5 THEN 0 WHEN 2 * data_id < 1995.5 THEN 1 ELSE 2 END"


@query(f" SELECT {_SHARD} AS shard, {_SWITCH} AS switch_shard, count(*) AS nodes, count(*) FILTER (is_end) AS ends, min(2 * data_id) AS low, max(2 * data_id) AS high FROM ids GROUP BY 1, 2")
def shard_routing(spark, sf_dir):
    own = ids(spark, sf_dir)
    rows = own.withColumns({"shard": models.shard(F.col("node_id")), "switch_shard": models.switch_shard(F.col("node_id"))})
    return rows.groupBy("shard", "switch_shard").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_end").cast("long")).alias("ends"), F.min("node_id").alias("low"), F.max("node_id").alias("high"))


@query(" SELECT CAST(is_end AS VARCHAR) AS label, count(*) AS n, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS share FROM nodes GROUP BY 1")
def class_priors(spark, sf_dir):
    return models.priors(nodes(spark, sf_dir), "is_end")


_ABC = "SELECT chr(CAST(97 + k AS INT)) AS c FROM (SELECT unnest(range(26)) AS k)"


@query(f" SELECT word FROM (SELECT a.c || b.c || d.c AS word FROM ({_ABC}) a, ({_ABC}) b, ({_ABC}) d) ANTI JOIN dict USING (word)")
def inverse_dictionary_n3(spark, sf_dir):
    return lexicons.non_words(spark, known_words(spark, sf_dir), 3)


@query(r""" , tk AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, regexp_full_match(word, '[a-z]+') AS in_alphabet, length(word) AS word_length, reverse(word) AS reversed, ascii(word) - 97 AS first_index, upper(CAST(word LIKE '%e' AS VARCHAR)) AS ends_with_e, CASE WHEN contains(word, 'an') THEN 1 ELSE -1 END AS has_an FROM tk WHERE word <> ''""")
def word_functions(spark, sf_dir):
    tokens = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''").distinct()
    w = F.col("word")
    return tokens.select("word", W.in_alphabet(w).alias("in_alphabet"), F.length(w).alias("word_length"), F.reverse(w).alias("reversed"), W.letter_index(w).alias("first_index"), W.upper_flag(F.endswith(w, F.lit("e"))).alias("ends_with_e"), W.presence(F.when(F.instr(w, "an") > 0, w)).alias("has_an"))


@query()
def search_hybrid(spark, sf_dir):
    """Learned ends and letters; no SQL, as the models are fitted here."""
    own = known_nodes(spark, sf_dir)
    return models.search(all_words(spark, sf_dir), own, models.fit_end_model(own), models.fit_letter_model(own))


@query()
def model_confusion(spark, sf_dir):
    own = nodes(spark, sf_dir)
    rows = own.join(models.predict(models.fit_end_model(own), own, "end"), "prefix")
    return rows.groupBy("is_end", "end").agg(F.count(F.lit(1)).alias("nodes"))


_CHECKED = ", wrong AS (SELECT prefix FROM knodes WHERE depth = 3 AND letter_index = 4), cutoff AS (SELECT q.word, min(q.depth) AS w FROM qpre q JOIN wrong ON wrong.prefix = substr(q.word, 1, q.depth) GROUP BY q.word)"


@query(f"{_CHECKED} SELECT word, found AND w IS NULL AS found, least(height, coalesce(w, height)) AS height FROM found LEFT JOIN cutoff USING (word)")
def search_rules_checked(spark, sf_dir):
    """The exhaustive check stops a walk at nodes whose checked letter is not the word's: here an e in third place is taken for an f."""
    own = known_nodes(spark, sf_dir)
    letter = F.when((F.col("depth") == 3) & (F.col("letter_index") == 4), 5).otherwise(F.col("letter_index"))
    return rules.search(all_words(spark, sf_dir), own.withColumn("letter_index", letter))


@query(" SELECT word, height = length(word) AS found, height FROM found")
def search_rules_altered(spark, sf_dir):
    """Rule tables without the end check: a prefix of a word is then found."""
    tables = rules.builtin_rules(spark)
    out = F.when((F.col("model") == "SearchMethod") & (F.col("key") == "4"), "getTrue").otherwise(F.col("out"))
    return rules.search(all_words(spark, sf_dir), known_nodes(spark, sf_dir), rules=tables.withColumn("out", out))


@query(" SELECT 'TrieEnd' AS model, CAST(k AS VARCHAR) AS key, upper(CAST(is_end AS VARCHAR)) AS out FROM (SELECT unnest(range((SELECT 2 * max(data_id) + 3 FROM ids))) AS k) LEFT JOIN ids ON 2 * data_id = k")
def rule_lookup(spark, sf_dir):
    """Every number up to beyond the last id is asked for; odd ones, the root and the last have no rule."""
    own = ids(spark, sf_dir)
    table = own.select(F.lit("TrieEnd").alias("model"), F.col("node_id").cast("string").alias("key"), W.upper_flag(F.col("is_end")).alias("out"))
    most = own.agg(F.max("node_id").alias("most"))
    asked = most.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") + 2)).alias("k")).select(F.lit("TrieEnd").alias("model"), F.col("k").cast("string").alias("key"))
    return rules.lookup(asked, table)


@query(" SELECT 2 * data_id AS node_id, letter_index, data_id % 10 = 0 AS differs FROM ids")
def previous_letter_check(spark, sf_dir):
    """Every tenth node's letter is altered in the previous-letter table; the check tells just these."""
    own = ids(spark, sf_dir)
    altered = own.withColumn("letter_index", F.when(F.col("data_id") % 10 == 0, (F.col("letter_index") + 1) % 26).otherwise(F.col("letter_index")))
    table = models.previous_letter_table(altered).select(F.col("node_id").alias("its"), F.col("letter_index").alias("predicted"))
    rows = own.join(table, F.col("node_id") == F.col("its"))
    return rows.select("node_id", "letter_index", W.mismatch(F.col("predicted"), F.col("letter_index")).alias("differs"))


@query(" SELECT CASE WHEN p.data_id IS NULL OR 2 * p.data_id < 614 THEN 0 WHEN 2 * p.data_id < 1191.5 THEN 1 ELSE 2 END AS switch_shard, count(*) AS nodes, min(2 * p.data_id) AS low, max(2 * p.data_id) AS high FROM ids n LEFT JOIN ids p ON n.parent = p.prefix GROUP BY 1")
def model_switch(spark, sf_dir):
    """Child rules by the shard of their parent, as the learned switch deals them; the root's children have no parent id here."""
    edges = trie.edges(ids(spark, sf_dir)).where("node_id > 0")
    parent = F.nullif(F.col("parent_node_id"), F.lit(0))
    rows = edges.select(parent.alias("parent"), models.switch_shard(parent, models.MODEL_SWITCH_THRESHOLDS).alias("switch_shard"))
    return rows.groupBy("switch_shard").agg(F.count(F.lit(1)).alias("nodes"), F.min("parent").alias("low"), F.max("parent").alias("high"))


@query(" SELECT prefix, NOT is_end AS inner_node FROM nodes")
def falsy_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).select("prefix", W.falsy(F.col("is_end")).alias("inner_node"))


@query(f"{_ORDERED} SELECT ord, d.word, o.word AS other FROM lex d JOIN o ON o.place = d.ord")
def zipped_words(spark, sf_dir):
    """Words in order beside the same words in random order, by place."""
    own = lexicon(spark, sf_dir)
    other = sampling.shuffled(own.select("word")).select(F.col("place").alias("ord"), F.col("word").alias("other"))
    return growth.zipped(own, other).select("ord", "word", "other")


@query(" SELECT p_partkey, p_name AS cut, p_name AS trimmed, floor(p_retailprice / 0.125 + 0.5) * 0.125 AS quantised, coalesce(CAST(nullif(p_size % 3, 0) AS VARCHAR), 'null') AS size_text FROM part")
def text_forms(spark, sf_dir):
    """Text up to a NUL, without outer white space, numbers rounded to a step, missing values as null."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.col("p_name")
    return part.select(
        "p_partkey", W.cut_at_nul(F.encode(F.concat(name, F.lit("\0rest")), "UTF-8")).alias("cut"), W.trimmed(F.concat(F.lit(" \t"), name, F.lit(" \n"))).alias("trimmed"),
        W.quantised(F.col("p_retailprice"), 0.125).alias("quantised"), W.null_text(F.nullif(F.col("p_size") % 3, F.lit(0))).alias("size_text"),
    )


@query(" SELECT word, CAST(length(word) AS VARCHAR) AS word_length, 'known' AS kind FROM dict UNION ALL SELECT word, CAST(length(word) AS VARCHAR), 'new' FROM lex ANTI JOIN dict USING (word)")
def csv_round_trip(spark, sf_dir):
    """Rows written to CSV over what was there, then appended to, and read back by column."""
    own, every = known_words(spark, sf_dir), all_words(spark, sf_dir)
    rows = lambda df, kind: df.select("word", F.length("word").cast("string").alias("word_length"), F.lit(kind).alias("kind"))
    with scratch(spark) as path:
        sinks.overwrite_csv(rows(every, "old"), path)
        sinks.overwrite_csv(rows(own, "known"), path)
        sinks.append_csv(rows(sampling.difference(every, own), "new"), path)
        return cut(lexicons.read_columns(spark, path, ["word", "word_length", "kind"], skip_header=True))


@query(" SELECT word, CAST(length(word) AS VARCHAR) AS word_length FROM dict")
def csv_truncate(spark, sf_dir):
    """What was written before a truncation is gone, what is appended after it stays."""
    rows = lambda df: df.select("word", F.length("word").cast("string").alias("word_length"))
    with scratch(spark) as path:
        sinks.overwrite_csv(rows(all_words(spark, sf_dir)), path)
        sinks.truncate(rows(all_words(spark, sf_dir)), path)
        sinks.append_csv(rows(known_words(spark, sf_dir)), path)
        return cut(lexicons.read_columns(spark, path, ["word", "word_length"], skip_header=True))


@query(f"{_VECTORS} SELECT word, CAST(length(word) AS VARCHAR) AS length, vector FROM v")
def syllable_scan(spark, sf_dir):
    """Presence columns of a dictionary file as vectors of 1 and -1."""
    pairs = _patterned(spark, sf_dir)
    flags = pairs.groupBy("word").agg(*[F.max(F.when(F.col("pattern") == x, F.lit("1"))).alias(x) for x in LANGS])
    with scratch(spark) as path:
        flags.select("word", F.length("word").alias("length"), *LANGS).write.csv(path, header=False)
        return cut(lexicons.read_syllables(spark, path, len(LANGS)))


_FILES = " SELECT 'TrieModel' AS model, coalesce(p.data_id, 0) || ',' || n.letter_index AS key, CAST(n.data_id AS VARCHAR) AS out FROM ids n LEFT JOIN ids p ON n.parent = p.prefix UNION ALL SELECT 'TrieEnd', CAST(data_id AS VARCHAR), upper(CAST(is_end AS VARCHAR)) FROM ids"


@query(_FILES)
def rule_files(spark, sf_dir):
    """The trie's tables written as rule files, found in their folder and read back: columns named ...In are the key, the next is the value."""
    table = trie.relations(ids(spark, sf_dir))
    key = F.split("key", ",")
    with scratch(spark) as path:
        for name, columns in (("TrieModel", ["parentIdIn", "letterIn", "childOut"]), ("TrieEnd", ["nodeIdIn", "endOut"])):
            own = table.where((F.col("model") == name) & ~F.col("key").startswith("null") & ~((F.col("key") == "0") & (F.lit(name) == "TrieEnd")))
            own.select(*[key[k].alias(c) for k, c in enumerate(columns[:-1])], F.col("out").alias(columns[-1]), F.lit("not read").alias("note")).write.csv(f"{path}/{name}.csv", header=True)
        return cut(rules.read_rules(spark, path))


@query(f"{_VECTORS} SELECT word AS key, vector AS slots FROM v")
def json_operands(spark, sf_dir):
    """Every word's pattern vector as the JSON text of an operand rule, read as an array."""
    rows = _vectors(spark, sf_dir).select(F.lit("PatternArg").alias("model"), F.col("word").alias("key"), F.to_json("vector").alias("out"))
    return rules.operands(rows).select("key", "slots")


@query(" SELECT word, found, height FROM found")
def search_learned_rules(spark, sf_dir):
    """The search program run by rule tables that models predict."""
    tables = rules.builtin_rules(spark)
    search = tables.where(F.col("model").startswith("Search") | F.col("model").startswith("Loop"))
    return rules.search(all_words(spark, sf_dir), known_nodes(spark, sf_dir), rules=learned.learned_rules(search, learned.fit_rule_models(search)))


@query()
def shard_end_confusion(spark, sf_dir):
    """End flags by the models of the shards, each with its threshold; no SQL, as the models are fitted here."""
    own = ids(spark, sf_dir)
    said = learned.shard_ends(own, learned.fit_shard_end_models(own))
    return own.select("prefix", "is_end").join(said, "prefix").groupBy("name", "is_end", "end").agg(F.count(F.lit(1)).alias("nodes"))


@query()
def search_predicted(spark, sf_dir):
    """Child, check and end of every step are predicted; no SQL, as the models are fitted here."""
    own = known_nodes(spark, sf_dir)
    return learned.search(all_words(spark, sf_dir), own, learned.fit_child_model(own), models.fit_end_model(own), learned.fit_boosted_letter_model(own))


@query(" SELECT * FROM found")
def search_relations(spark, sf_dir):
    """Walks by node ids over the relations alone."""
    return relations.search(all_words(spark, sf_dir), trie.relations(trie.build_with_ids(known(spark, sf_dir))))


_CUT = """, gone AS (SELECT prefix FROM kids WHERE data_id % 7 = 0), flipped AS (SELECT prefix, NOT is_end AS is_end FROM kids WHERE data_id % 5 = 0),
broken AS (SELECT q.word, min(q.depth) - 1 AS w FROM qpre q JOIN gone ON gone.prefix = substr(q.word, 1, q.depth) GROUP BY q.word)"""


@query(f"""{_CUT} SELECT word, coalesce(w, height) >= length(word) AND height = length(word) AND coalesce(f.is_end, found) AS found, least(height, coalesce(w, height)) AS height
FROM found LEFT JOIN broken USING (word) LEFT JOIN flipped f ON f.prefix = word""")
def search_relations_edited(spark, sf_dir):
    """Relations in which every seventh node lost its child rule and every fifth has the opposite end rule."""
    rows = trie.relations(trie.build_with_ids(known(spark, sf_dir)))
    number = F.when(F.col("model") == "TrieModel", F.col("out")).otherwise(F.col("key")).try_cast("long")
    left = rows.where(~((F.col("model") == "TrieModel") & (F.col("key") != "null,null") & F.coalesce(number % 7 == 0, F.lit(False))))
    flip = (F.col("model") == "TrieEnd") & F.coalesce((number % 5 == 0) & (number > 0), F.lit(False))
    return relations.search(all_words(spark, sf_dir), left.withColumn("out", F.when(flip, F.when(F.col("out") == "TRUE", "FALSE").otherwise("TRUE")).otherwise(F.col("out"))))


@query(" SELECT * FROM found")
def search_neighbours(spark, sf_dir):
    """The longer of the common prefixes with the nearest known words, in one sorted list."""
    return neighbours.search(all_words(spark, sf_dir), known_words(spark, sf_dir))


@query(""", e AS (SELECT 2 * n.data_id AS node_id, coalesce(2 * p.data_id, 0) AS up, n.letter_index AS letter, n.is_end FROM ids n LEFT JOIN ids p ON n.parent = p.prefix),
w AS (SELECT node_id, chr(CAST(97 + letter AS INT)) AS prefix, is_end FROM e WHERE up = 0 UNION ALL SELECT e.node_id, w.prefix || chr(CAST(97 + e.letter AS INT)), e.is_end FROM w JOIN e ON e.up = w.node_id)
SELECT node_id, prefix, is_end FROM w""", recursive=True)
def words_of_edges(spark, sf_dir):
    """Every node's letters, rebuilt from the exported edges by pointer doubling."""
    return relations.words_of_edges(trie.edges(ids(spark, sf_dir)))


@query(""", one AS (SELECT prefix FROM knodes WHERE depth = 1 AND is_end) SELECT word, one.prefix IS NOT NULL AS found, least(height, 1) AS height FROM found LEFT JOIN one ON one.prefix = substr(word, 1, 1)""")
def search_rules_once(spark, sf_dir):
    """A Loop program that ends after its first round: every walk takes one letter."""
    tables = rules.builtin_rules(spark)
    out = F.when((F.col("model") == "LoopSequence") & (F.col("key") == "2,FALSE"), "-1").otherwise(F.col("out"))
    return rules.search(all_words(spark, sf_dir), known_nodes(spark, sf_dir), rules=tables.withColumn("out", out))


#: Nodes of a shard at most.
SHARD = 2000


@query(f" SELECT (data_id - 1) // {SHARD} AS shard, count(*) AS nodes, count(*) FILTER (is_end) AS ends, min(2 * data_id) AS low, max(2 * data_id) AS high FROM ids GROUP BY 1")
def shard_sizes(spark, sf_dir):
    """Nodes routed to shards of bounded size by their ids."""
    own = ids(spark, sf_dir)
    rows = models.routed(own, models.shard_ranges(own, SHARD), "node_id")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_end").cast("long")).alias("ends"), F.min("node_id").alias("low"), F.max("node_id").alias("high"))


@query(f" SELECT n.letter_index AS node_index, greatest(coalesce(p.data_id, 1) - 1, 0) // {SHARD} AS shard, count(*) AS nodes FROM ids n LEFT JOIN ids p ON n.parent = p.prefix GROUP BY ALL")
def shard_of_parents(spark, sf_dir):
    """Child rules routed by their parents' ids to the same shards; the root, which is in no range, goes to the first."""
    own = ids(spark, sf_dir)
    rows = models.routed(trie.edges(own).where("node_id > 0"), models.shard_ranges(own, SHARD), "parent_node_id")
    return rows.groupBy("node_index", "shard").agg(F.count(F.lit(1)).alias("nodes"))


@query(" SELECT * FROM found")
def search_stored(spark, sf_dir):
    """The trie kept as a table bucketed by prefix, searched and dropped."""
    name = f"trie_{uuid.uuid4().hex}"
    stored.store(known_nodes(spark, sf_dir), name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        return cut(stored.search(spark, all_words(spark, sf_dir), name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(" SELECT * FROM found")
def search_function(spark, sf_dir):
    """Search as a table function of the session."""
    name = f"trie_search_{uuid.uuid4().hex[:8]}"
    catalog.register(spark, known_nodes(spark, sf_dir), all_words(spark, sf_dir), name)
    return spark.sql(f"SELECT * FROM {name}()")


@query(" SELECT prefix, is_end, data_id FROM ids")
def stream_node_ids(spark, sf_dir):
    """All words streamed in three batches of their order, the stream started anew for each: ids as those of one build."""
    words = cut(lexicon(spark, sf_dir))
    third = F.floor(F.col("ord") * 3 / F.lit(max(1, words.count())))
    with scratch(spark) as path:
        for k in range(3):
            words.where(third == k).write.mode("append").parquet(f"{path}/words")
            stream = spark.readStream.schema("word string, ord long").parquet(f"{path}/words")
            streamed.insert_stream(stream, f"{path}/trie", f"{path}/progress").awaitTermination()
        streamed.compact(spark, f"{path}/trie", 2)
        return cut(streamed.stored(spark, f"{path}/trie"))


@query(" SELECT word, ord FROM lex")
def dictionary_lines(spark, sf_dir):
    """Dictionary files written in order and read back with each line's number, over all files in the order of their names."""
    with scratch(spark) as path:
        all_words(spark, sf_dir).repartitionByRange("word").sortWithinPartitions("word").write.text(path)
        lines = cut(lexicons.read_lines(spark, path))
        sizes = lines.groupBy(F.col("file").alias("its")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each file
        before, offsets = 0, []
        for r in sorted(sizes, key=lambda r: r["its"]):
            offsets.append((r["its"], before))
            before += r["n"]
        files = spark.createDataFrame(offsets, "its string, offset long")
        return lines.join(F.broadcast(files), F.col("file") == F.col("its")).select("word", (F.col("ord") + F.col("offset")).alias("ord"))


@query(r""", t AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents),
r AS (SELECT word, CASE WHEN word = '' THEN 'empty' WHEN regexp_full_match(word, '[a-z]+') THEN NULL WHEN regexp_full_match(lower(word), '[a-z]+') THEN 'upper case' ELSE 'other characters' END AS reason FROM t)
SELECT reason, count(*) AS n, count(DISTINCT word) AS words, (SELECT count(*) FROM r) AS read, (SELECT count(*) FROM r WHERE reason IS NULL) AS kept, (SELECT count(*) FROM r WHERE reason IS NOT NULL) AS rejected FROM r GROUP BY reason""")
def quarantine(spark, sf_dir):
    """Tokens of the texts, those beyond the alphabet set apart by reason, beside the counts observed while they were written."""
    tokens = documents(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word"))
    with scratch(spark) as path:
        seen = quality.quarantine(tokens, path)
        rows = spark.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("words"))
        return cut(rows.select("*", *[F.lit(seen[k]).cast("long").alias(k) for k in ("read", "kept", "rejected")]))


@query(" SELECT letters, word, length(word) AS word_length, length(word) % 2 AS batch FROM lex, (SELECT unnest(range(3, 6)) AS letters) WHERE length(word) <= letters AND NOT (letters = 4 AND length(word) % 2 = 1) UNION ALL SELECT 4, upper(word), length(word), 1 FROM lex WHERE length(word) <= 4 AND length(word) % 2 = 1")
def batches_once(spark, sf_dir):
    """Facts by length limit and batch; all are written twice and one batch a third time with other words, and count once."""
    facts = sampling.sweep(all_words(spark, sf_dir), 3, 5).select("letters", "word", F.length("word").alias("word_length"), (F.length("word") % 2).alias("batch"))
    with scratch(spark) as path:
        sinks.overwrite_batches(facts, path)
        sinks.overwrite_batches(facts, path)
        sinks.overwrite_batches(facts.where("letters = 4 and batch = 1").withColumn("word", F.upper("word")), path)
        return cut(spark.read.parquet(path).select("letters", "word", "word_length", "batch"))


#: Letters of the longest word of the trie whose tables are learned by id.
LEARNED = 4


def _short_relations(spark, sf_dir):
    words = lexicons.words_of_texts(documents(spark, sf_dir), longest=LEARNED)
    return cut(trie.relations(trie.build_with_ids(by_word(words))))


_SHORT = f"""
, sdict AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS ord FROM lex WHERE length(word) <= {LEARNED}),
snodes AS (SELECT substr(word, 1, k) AS prefix, bool_or(k = length(word)) AS is_end FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM sdict) GROUP BY 1)"""


@query(f"""{_SHORT}, sh AS (SELECT q.word, max(q.depth) AS h, bool_or(n.is_end AND q.depth = length(q.word)) AS f FROM qpre q JOIN snodes n ON n.prefix = substr(q.word, 1, q.depth) GROUP BY q.word)
SELECT lex.word, coalesce(f, false) AS found, coalesce(h, 0) AS height FROM lex LEFT JOIN sh USING (word)""")
def search_boosted(spark, sf_dir):
    """Walks over tables that boosted trees predict from node ids, of a trie of words of up to four letters; they say what the exact tables say."""
    rows = _short_relations(spark, sf_dir)
    return relations.search(all_words(spark, sf_dir), boosting.predicted(rows, boosting.fit_relations(rows)))


@query(f"""{_SHORT}
SELECT 'TrieModel' AS model, 'true' AS actual, 'true' AS predicted, count(*) AS n FROM snodes
UNION ALL SELECT 'TrieModel', 'false', 'false', 26 * (count(*) + 1) - count(*) FROM snodes
UNION ALL SELECT 'TrieCheck', CAST(ascii(right(prefix, 1)) - 97 AS VARCHAR), CAST(ascii(right(prefix, 1)) - 97 AS VARCHAR), count(*) FROM snodes GROUP BY ascii(right(prefix, 1))
UNION ALL SELECT 'TrieEnd', upper(CAST(e AS VARCHAR)), upper(CAST(e AS VARCHAR)), count(*) FROM (SELECT is_end AS e FROM snodes UNION ALL SELECT false) GROUP BY e""")
def boosted_confusion(spark, sf_dir):
    """What the boosted trees say of every child slot, letter and end against what is there; every row is right."""
    rows = _short_relations(spark, sf_dir)
    return boosting.confusion(rows, boosting.fit_relations(rows))


def _seen(k: int) -> str:
    return f"CASE WHEN length(prefix) >= {k} THEN ascii(substr(prefix, length(prefix) - {k - 1}, 1)) - 97 ELSE -1 END AS l{k}"


_SEEN = f", ch AS (SELECT parent AS its, count(*) AS children FROM nodes GROUP BY parent), seen AS (SELECT n.prefix, n.is_end, n.letter_index, n.depth, {_seen(1)}, {_seen(2)}, {_seen(3)}, coalesce(ch.children, 0) AS children FROM nodes n LEFT JOIN ch ON ch.its = n.prefix)"


@query(f"{_SEEN} SELECT is_end, {compiled.sql(compiled.load('end'))} AS said, count(*) AS nodes FROM seen GROUP BY ALL")
def end_confusion(spark, sf_dir):
    """End flags by the saved boosted model, as CASE columns."""
    own = models.features(nodes(spark, sf_dir))
    return own.select((F.col("label") == 1).alias("is_end"), compiled.column(compiled.load("end")).alias("said")).groupBy("is_end", "said").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"{_SEEN} SELECT letter_index, CAST({compiled.sql(compiled.load('letter'))} AS INTEGER) AS said, count(*) AS nodes FROM seen GROUP BY ALL")
def letter_confusion(spark, sf_dir):
    """Letters by the saved tree, as CASE columns."""
    own = models.features(nodes(spark, sf_dir))
    return own.select("letter_index", compiled.column(compiled.load("letter")).cast("int").alias("said")).groupBy("letter_index", "said").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"{_SEEN} SELECT prefix, {compiled.sql(compiled.load('end'))} = 1 AS said FROM seen WHERE {compiled.sql(compiled.load('end'))} = 1 AND NOT is_end")
def false_ends(spark, sf_dir):
    """Nodes that the saved model takes for ends and are none."""
    own = models.features(nodes(spark, sf_dir)).withColumn("said", compiled.column(compiled.load("end")) == 1)
    return own.where("said and label = 0").select("prefix", "said")
