"""Merkle manifest of a table: a digest for every row, trees of runs of eight, and a proof for every row.

Rows become leaves in one pass over the texts.  Leaves are numbered inside their
group (the language) by a range partitioning on (lang, doc_id, leaf, row), so a
group that holds most rows, or most rows being copies of one, is still spread
evenly: offsets are counts for each partition and group, no window sees a group.
Levels are built bottom-up: each is persisted as runs of at most eight nodes, and
the next level has one node for each run.  The groups' roots are the leaves of
one more tree of the same kind.  Proofs are pushed top-down: the runs of a level
join the proofs of their parents, and every child prepends its own siblings to
the proof that it inherits.  A proof is a list of (left, right) texts, one for
each level, so folding a leaf over it gives the root again.

All is DataFrame work on the executors; a root is the one value that the driver sees.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, table

FAN = 8
#: Groups up to which their roots are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000
#: What a leaf digests, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field as a leaf sees it: ``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf(text: Column | str = "text") -> Column:
    """The digest of a row, with ``text`` in place of its text."""
    text = F.col(text) if isinstance(text, str) else text
    return digest(*[field(F.col(x)) for x in FIELDS[:-1]], field(text))


def lowered(text: str = "text") -> Column:
    """The tampering of the contract: A-Z become a-z where 3 divides crc32 of the decimal id; other rows are as they were."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(F.col(text), _UPPER, _LOWER)).otherwise(F.col(text))


def numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their ordinal from 0 inside ``group``, and ``size``, the group's count.

    Nulls come first; a group of nulls is a group.  Rows equal in all of
    ``order`` are told apart by ``tie``, which is made if absent, so that no
    partition of the sort holds all copies of a row.  The row's place in its
    sorted partition comes from its ascending id; groups add the counts of
    the partitions before.
    """
    if "tie" not in nodes.columns:
        nodes = cut(nodes.withColumn("tie", F.monotonically_increasing_id()))
    keys = [F.asc_nulls_first(x) for x in (group, *order, "tie")]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("g")
    counts = counts.withColumn("before", F.sum("n").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).withColumn("size", F.sum("n").over(own))
    met = placed.join(counts, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return met.withColumn("pos", F.col("at") - F.col("first") + F.coalesce("before", F.lit(0))).drop("tie", "at", "part", "g", "p", "first", "n", "before")


def runs(nodes: DataFrame) -> DataFrame:
    """(lang, pos, size, members): the runs of FAN consecutive nodes of each group, ``pos`` being the run's own number and ``size`` the number of runs."""
    rest = [x for x in nodes.columns if x not in ("lang", "pos", "size")]
    member = F.struct(F.col("pos").alias("at"), *rest)
    grouped = nodes.groupBy("lang", F.floor(F.col("pos") / FAN).cast("long").alias("pos")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.ceil(F.max("size") / FAN).cast("long").alias("size"))
    return grouped.select("lang", "pos", "size", "members")


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The persisted levels (runs, from the leaves up) and (lang, digest) of each group's root.

    ``leaves`` has lang, pos, size and digest; other columns stay with the first
    level's members.  A group of one leaf has no run, its leaf is its root.
    """
    levels: list[DataFrame] = []
    roots = leaves.where("size = 1").select("lang", "digest")
    nodes = leaves.where("size > 1")
    while True:
        level = cut(runs(nodes))
        if level.isEmpty():
            return levels, roots
        levels.append(level)
        above = level.select("lang", "pos", "size", digest(_joined(F.col("members.digest"))).alias("digest"))
        roots = roots.unionByName(above.where("size = 1").select("lang", "digest"))
        nodes = above.where("size > 1")


def pushed(level: DataFrame, proofs: DataFrame) -> DataFrame:
    """The members of a level's runs with their proofs: the siblings in the run, then what the run's node inherits.

    ``proofs`` has lang, pos and proof of the nodes above.
    """
    above = proofs.select(F.col("lang").alias("g"), F.col("pos").alias("p"), F.col("proof").alias("suffix"))
    met = level.join(above, F.col("lang").eqNullSafe(F.col("g")) & (F.col("pos") == F.col("p")))
    own = met.select("lang", F.col("members.digest").alias("all"), "suffix", F.posexplode("members").alias("k", "member"))
    # lists of at most FAN digests
    left, right = F.slice("all", F.lit(1), F.col("k")), F.slice("all", F.col("k") + 2, F.lit(FAN))
    step = F.struct(_joined(left).alias("left"), _joined(right).alias("right"))
    return own.select("lang", F.col("member.at").alias("pos"), "member", F.concat(F.array(step), F.col("suffix")).cast(_STEP).alias("proof"))


def proofs(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Pushes the proofs of the groups' roots (lang, proof) down all levels; gives lang, pos, member and proof of the leaves.

    A group joins at the level of its root, where it has one run.
    """
    now = None
    for level in reversed(levels):
        tops = level.where("size = 1").select(F.col("lang").alias("own"), "pos")
        entering = tops.join(roots, F.col("own").eqNullSafe(F.col("lang"))).select("lang", "pos", "proof")
        now = pushed(level, entering if now is None else cut(now).select("lang", "pos", "proof").unionByName(entering))
    return now


def siblings(proof: str = "proof") -> Column:
    """All siblings of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column | str, proof: str = "proof") -> Column:
    """The root that a leaf digest gives with the siblings of a proof."""
    start = F.col(start) if isinstance(start, str) else start
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root of every row of ``docs``.

    ``tampered`` is the text that is folded in place of the row's own (by
    default its own).  Leaves ascend by doc_id in each lang, null ids first;
    rows of one id ascend by their digest, and copies of a row are leaves of
    their own.  Null langs form a group, and any field may be null.  Columns
    beyond FIELDS play no part.  An empty table gives no rows.
    """
    other = leaf(F.col("text") if tampered is None else tampered)
    found = docs.select(*FIELDS).select("doc_id", "lang", leaf().alias("digest"), other.alias("other"))
    found = found.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))
    leaves = numbered(found, "lang", ["doc_id", "digest"])
    levels, subroots = build(leaves.select("lang", "pos", "size", "digest", "doc_id", "other"))
    subroots = cut(subroots)
    ordered = numbered(subroots.withColumn("all", F.lit(0)), "all", ["lang"])
    tops, roots = build(ordered.select(F.lit(None).cast("string").alias("lang"), "pos", "size", "digest", F.col("lang").alias("of")))
    root = roots.first()
    root = F.lit(root["digest"] if root else None).cast("string")
    none = F.array().cast(_STEP)
    if tops:
        start = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("lang"), none.alias("proof"))
        given = cut(proofs(tops, start)).select(F.col("member.of").alias("lang"), F.col("member.digest").alias("subroot"), "proof")
    else:
        given = subroots.select("lang", F.col("digest").alias("subroot"), none.alias("proof"))
    alone = leaves.where("size = 1").select("lang", "digest", "doc_id", "other")
    parts = alone.join(given.select(F.col("lang").alias("g"), "proof"), F.col("lang").eqNullSafe(F.col("g"))).drop("g")
    if levels:
        rest = proofs(levels, given.select("lang", "proof"))
        parts = parts.unionByName(rest.select("lang", F.col("member.digest").alias("digest"), F.col("member.doc_id").alias("doc_id"), F.col("member.other").alias("other"), "proof"))
    names = given.select(F.col("lang").alias("g"), "subroot")
    named = parts.join(F.broadcast(names) if subroots.count() <= BROADCAST_ROWS else names, F.col("lang").eqNullSafe(F.col("g")))
    return named.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof", folded(F.coalesce("other", "digest")).alias("folded_root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents"), lowered())
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings()).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Each lang's levels as lists of digests, made one from the other; CRC-32 bit by bit; one row a document and level while folding.
ORACLE = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, text, concat(F(CAST(doc_id AS VARCHAR)), F(source), F(lang), F(CAST(n_chars AS VARCHAR))) AS head,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS c
  FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, lang, sha256(concat(head, F(text))) AS leaf,
    sha256(concat(head, F(CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END))) AS other FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (
  SELECT lang, 0 AS lv, list(leaf ORDER BY pos) AS h FROM p GROUP BY lang
  UNION ALL
  SELECT lang, lv + 1, list_transform(range(0, len(h), 8), lambda i: sha256(array_to_string(h[i + 1 : i + 8], ''))) FROM up WHERE len(h) > 1),
lang_levels AS MATERIALIZED (SELECT * FROM up),
sub AS MATERIALIZED (SELECT lang, h[1] AS subroot, lv AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM lang_levels WHERE len(h) = 1),
over_all AS (
  SELECT 0 AS lv, list(subroot ORDER BY spot) AS h FROM sub
  UNION ALL
  SELECT lv + 1, list_transform(range(0, len(h), 8), lambda i: sha256(array_to_string(h[i + 1 : i + 8], ''))) FROM over_all WHERE len(h) > 1),
top_levels AS MATERIALIZED (SELECT * FROM over_all),
steps AS MATERIALIZED (
  SELECT lang AS g, lv, h FROM lang_levels WHERE len(h) > 1
  UNION ALL
  SELECT sub.lang, sub.top + t.lv, t.h FROM sub, top_levels t WHERE len(t.h) > 1),
walk AS (
  SELECT p.doc_id, p.lang, p.leaf, p.pos AS row_no, 0 AS lv, p.pos AS pos, p.other AS acc, '' AS proof FROM p
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.row_no, w.lv + 1, w.at // 8,
    sha256(concat(array_to_string(w.h[w.at // 8 * 8 + 1 : w.at], ''), w.acc, array_to_string(w.h[w.at + 2 : w.at // 8 * 8 + 8], ''))),
    concat(w.proof, array_to_string(w.h[w.at // 8 * 8 + 1 : w.at], ''), array_to_string(w.h[w.at + 2 : w.at // 8 * 8 + 8], ''))
  FROM (SELECT walk.*, s.h, CASE WHEN walk.lv = sub.top THEN sub.spot ELSE walk.pos END AS at
        FROM walk JOIN sub ON walk.lang IS NOT DISTINCT FROM sub.lang JOIN steps s ON s.g IS NOT DISTINCT FROM walk.lang AND s.lv = walk.lv) w),
ends AS (SELECT lang, row_no, max(lv) AS lv FROM walk GROUP BY lang, row_no),
r AS (SELECT h[1] AS root FROM top_levels WHERE len(h) = 1)
SELECT w.doc_id, w.leaf, sub.subroot, r.root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = r.root AS verified
FROM walk w JOIN ends e ON w.lang IS NOT DISTINCT FROM e.lang AND w.row_no = e.row_no AND w.lv = e.lv JOIN sub ON w.lang IS NOT DISTINCT FROM sub.lang, r
"""


def oracle() -> str:
    """The SQL with F(x), a field as a leaf sees it, written out."""
    return re.sub(r"\bF\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"coalesce(concat(strlen(\1), ':', \1), '-')", ORACLE)
