"""Secret scans in DataFrame operations only: a trigram inverted index proposes documents, regular expressions verify them.

Each rule's pattern is parsed into a Boolean query over lower-case trigrams that
every match must contain.  The index holds postings (trigram, doc) for just the
trigrams that some rule asks for, at most one per document and trigram, so a
posting is never collected; one pass over a text finds them all, and
intersecting them is a count per (document, rule).  Only candidates are shuffled
or sent: their keys are few, so they meet the texts in a second pass.  A rule
without mandatory trigrams scans every text.
"""

from __future__ import annotations

import itertools
import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, table

#: More alternatives than this are not tracked; the query then asks for less, which loses no match.
MOST_STRINGS = 48
#: Candidates (16 bytes each) up to which they are broadcast; more are joined by a shuffle, with the same result.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


# The base rules. Character classes in either case are spelled out so that every engine reads them alike.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# What the method adds.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE + EXTRA


def mandatory(pattern: str) -> list[frozenset[str]]:
    """A conjunction of clauses; each clause is a set of trigrams of which a match holds one at least.

    The pattern is read as a sequence of finite string sets and gaps.  A run
    without gaps is kept as a set of strings; every string of three letters or
    more gives trigrams, and the clause for position k of the run is the union
    of the k-th trigrams.  An empty list means: no mandatory trigram.
    """
    clauses: list[frozenset[str]] = []
    run: set[str] = {""}

    def close():
        nonlocal run
        if all(len(s) >= 3 for s in run):
            shortest = min(map(len, run))
            for k in range(shortest - 2):
                clauses.append(frozenset(s[k : k + 3] for s in run))
        run = {""}

    for part in _parts(sre_parser.parse(pattern)):
        if part is None:
            close()
            continue
        joined = {a + b for a in run for b in part}
        if len(joined) > MOST_STRINGS:
            close()
            joined = part if len(part) <= MOST_STRINGS else {""}
        run = joined
    close()
    return sorted(set(clauses), key=sorted)


def _parts(tree) -> list[set[str] | None]:
    """The pattern's parts in order: a finite set of lower-case strings, or None for anything else."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN:
            chars = _chars(arg)
            out.append(chars if chars and len(chars) <= 6 else None)
        elif op is sre.SUBPATTERN:
            out += _parts(arg[3])
        elif op is sre.BRANCH:
            sets = [_whole(x) for x in arg[1]]
            out.append(None if None in sets else set().union(*sets))
        elif op is sre.MAX_REPEAT:
            least, most, inner = arg
            strings = _whole(inner)
            if strings is None or most > 2:
                out.append(None)
            else:
                out.append({"".join(x) for n in range(least, most + 1) for x in itertools.product(strings, repeat=n)})
        else:
            out.append(None)
    return out


def _whole(tree) -> set[str] | None:
    """All strings of a pattern, or None if they are not few."""
    parts = _parts(tree)
    if None in parts:
        return None
    strings = {"".join(x) for x in itertools.product(*parts)}
    return strings if len(strings) <= MOST_STRINGS else None


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 6:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rank, kind, end) of the rule's matches, positions in code points.

    A split by the same pattern gives the gaps between matches, so the summed
    lengths give the positions.
    """
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("body"))
    kind = "struct<at:int,out:array<struct<start:int,rank:int,kind:string,end:int>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind.split("out:")[1][:-1]).alias("out")).cast(kind)

    def step(state, part):
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(part["body"]) >= rule.least, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out")).cast(kind)

    return F.aggregate(parts, empty, step, lambda s: s["out"])


def _needs(rule: Rule) -> list[frozenset[str]]:
    return mandatory(rule.pattern)


def _present(low: Column, grams: list[str]) -> Column:
    """Which of the trigrams a lower-case text has, by one pass: where three classes of characters match, the alternatives are tried in groups of one first letter."""
    some = lambda cs: "[" + "".join(map(re.escape, sorted(set(cs)))) + "]"
    heads: dict[str, dict[str, list[str]]] = {}
    for g in grams:
        heads.setdefault(g[0], {}).setdefault(g[1], []).append(g[2])
    each = "|".join(re.escape(a) + "(?:" + "|".join(re.escape(b) + some(cs) for b, cs in sorted(d.items())) + ")" for a, d in sorted(heads.items()))
    pattern = f"(?={''.join(some(g[k] for g in grams) for k in range(3))})(?=({each}))"
    return F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): as bits, the ranks of the rules whose Boolean query the document's trigrams satisfy.

    ``docs`` has ``key`` and ``text``.  The postings of the rules' trigrams are
    built per document and intersected by clause: a rule holds if each of its
    clauses has a posting.
    """
    clauses = [(r, clause) for r, rule in enumerate(rules) for clause in _needs(rule)]
    grams = sorted({t for _, clause in clauses for t in clause})
    if not grams:
        return docs.select("key", F.lit(0).cast("long").alias("rules")).limit(0)
    posted = docs.select("key", F.explode(_present(F.lower("text"), grams)).alias("gram"))
    query = F.create_map(*itertools.chain.from_iterable((F.lit(t), F.array(*[F.lit(c) for c, (_, clause) in enumerate(clauses) if t in clause])) for t in grams))
    met = posted.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set(query[F.col("gram")]))).alias("met"))
    rule_bits = F.lit(0).cast("long")
    for r in sorted({r for r, _ in clauses}):
        needed = F.array(*[F.lit(c) for c, (own, _) in enumerate(clauses) if own == r])
        rule_bits = rule_bits.bitwiseOR(F.when(F.size(F.array_intersect("met", needed)) == F.size(needed), F.lit(1 << r)).otherwise(F.lit(0)).cast("long"))
    return met.select("key", rule_bits.alias("rules")).where("rules <> 0")


def _proposed(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (with __key and __text) and the candidates' bits in __rules, null for others."""
    found = cut(candidates(rows.select(F.col("__key").alias("key"), F.col("__text").alias("text")), rules))  # cut, so that a join by shuffle may split a hot text's rows
    found = found.select(F.col("key").alias("__its"), F.col("rules").alias("__rules"))
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, F.col("__key") == F.col("__its"), "left")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found``: array of (start, rank, kind, end) of every rule's matches, in that order.

    Null texts are empty.  Whether a text is a candidate depends on the text
    alone, so the index is keyed by its hash: copies share one entry, a null or
    repeated id does no harm, and a collision can only propose too much.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text")).withColumn("__key", F.xxhash64("__text"))
    return _proposed(rows, rules).select("doc_id", verified(F.col("__text"), F.col("__rules"), rules).alias("found"))


def verified(text: Column, proposed: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The sorted spans of a text; only proposed rules, and those without mandatory trigrams, are run."""
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    asked = [proposed.bitwiseAND(F.lit(1 << r).cast("long")) != 0 if _needs(rule) else _long_run(text, rule) for r, rule in enumerate(rules)]
    return F.array_sort(F.concat(*[F.when(F.coalesce(a, F.lit(False)), spans(text, rule, r)).otherwise(nothing) for r, (a, rule) in enumerate(zip(asked, rules, strict=True))]))


def _long_run(text: Column, rule: Rule) -> Column:
    """A rule without mandatory trigrams scans the text; one long run is looked for before all runs are listed."""
    whole = sre_parser.parse(rule.pattern)
    if len(whole) == 1 and whole[0][0] is sre.MAX_REPEAT and rule.pattern.endswith("]+") and rule.group == 0:
        return text.rlike(f"{rule.pattern[:-1]}{{{rule.least}}}")
    return text.rlike(rule.pattern)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans."""
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    show = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("found", lambda x: x["rank"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(show(base), 256).alias("base_sha256"), show(F.col("found")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every found secret replaced by ``[SECRET]``, all columns kept; overlapping spans are merged.

    ``n_chars``, where the table has it, is the new text's length.
    """
    rows = docs.withColumns({"__text": F.coalesce(F.col("text"), F.lit("")), "__key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    found = _proposed(rows, RULES).withColumn("__found", verified(F.col("__text"), F.col("__rules")))
    kind = "struct<at:int,out:string>"

    def step(state, x):
        fresh = F.substring(F.col("__text"), state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        mark = F.when(x["start"] >= state["at"], F.concat(fresh, F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(x["end"], state["at"]).alias("at"), F.concat(state["out"], mark).alias("out")).cast(kind)

    clean = F.aggregate("__found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind), step, lambda s: F.concat(s["out"], F.substring(F.col("__text"), s["at"] + 1, F.length("__text"))))
    new = F.when(F.size("__found") > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("__new", new)
    changed = {"text": F.col("__new"), "n_chars": F.when(F.size("__found") > 0, F.length("__new").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": F.col("__new")}
    return out.select([changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def oracle() -> str:
    """The same rows in DuckDB SQL: gaps and matches in turn give the positions."""
    parts = []
    for r, rule in enumerate(RULES):
        pattern = (f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.kind == "hex" else rule.pattern).replace("'", "''")
        parts.append(
            f"SELECT rid, {r} AS rank, '{rule.kind}' AS kind, gaps, hits, unnest(range(1, len(hits) + 1)) AS i, bodies FROM "
            f"(SELECT rid, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS bodies FROM d)"
        )
    lengths = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    least = " ".join(f"WHEN {r} THEN {rule.least}" for r, rule in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
h AS ({" UNION ALL ".join(parts)}),
s AS (SELECT rid, rank, kind, CAST({lengths("gaps[1:i]")} + {lengths("hits[1:i-1]")} AS BIGINT) AS start, length(hits[i]) AS n
      FROM h WHERE length(bodies[i]) >= CASE rank {least} END),
a AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      coalesce(string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '') AS base,
      string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""
