"""Benchmark decontamination: test items in a BM25 index, queried by every training passage.

Scores are divided by each item's threshold, so one limit (1) holds for all.
The threshold is exact: an item can lose at most a fifth of its shingle
positions, hence at most that many words, so what is left after its heaviest
words are gone bounds the score of every passage that overlaps enough.

Each passage runs a block-max WAND over the postings with their stored maxima
and retrieves all items above the limit.  Then shingles are verified: an item is
found where a passage has OVERLAP of its shingles, or OVERLAP of its question's
and OVERLAP of its answer's, which may stand apart.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, map_arrow, table, texts

SHINGLE = 5
OVERLAP = 0.8
BLOCK = 8
K1, B = 1.2, 0.75
#: Text bytes of test items in one index; more items are dealt to several indexes, made and read one after another, with the same result.
INDEX_BYTES = 32_000_000
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    """All windows of SHINGLE words; fewer words make one window."""
    if not words:
        return []
    return list(zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else [tuple(words)]


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; one of a single sentence is both."""
    parts = SENTENCE_END.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Item:
    item_id: int
    text: str

    @cached_property
    def parts(self) -> list[list[tuple[str, ...]]]:
        """Shingles of the whole, the question and the answer; made when an item is first retrieved."""
        return [shingles(words_of(x)) for x in (self.text, *question_and_answer(self.text))]


@dataclass
class Statistics:
    """What BM25 and the passages need of all items, also of those in other indexes."""

    items: int
    mean: float
    longest: int
    having: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Statistics:
        bags = [words_of(t) for _, t in rows]
        having: dict[str, int] = {}
        for b in bags:
            for w in set(b):
                having[w] = having.get(w, 0) + 1
        return cls(len(bags), sum(map(len, bags)) / max(1, len(bags)), max(map(len, bags), default=1), having)


class Index:
    """Postings (item, score share) by term, sorted by item, in flat arrays, with the maximum of each list and of each block of items in it."""

    def __init__(self, rows: list[tuple[int, str]], statistics: Statistics | None = None, overlap: float = OVERLAP):
        rows = sorted((i, t) for i, t in rows if i is not None and words_of(t))
        known = statistics or Statistics.of(rows)
        self.overlap, self.longest = overlap, known.longest
        self.items = [Item(i, t) for i, t in rows]
        self.term: dict[str, int] = {}
        terms, of, share = array("q"), array("q"), array("d")
        self.scale = array("d")
        for n, (_, t) in enumerate(rows):
            bag = words_of(t)
            counts: dict[str, int] = {}
            for w in bag:
                counts[w] = counts.get(w, 0) + 1
            weight = {}
            for w, tf in counts.items():
                idf = np.log1p((known.items - known.having[w] + 0.5) / (known.having[w] + 0.5))
                weight[w] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(bag) / known.mean)))
            windows = len(bag) - SHINGLE + 1 if len(bag) >= SHINGLE else 1
            lost = int((1 - overlap) * windows + 1e-9)
            needed = sum(sorted(weight.values())[: len(weight) - lost]) * (1 - 1e-9)
            self.scale.append(needed)
            for w, x in weight.items():
                terms.append(self.term.setdefault(w, len(self.term)))
                of.append(n)
                share.append(x / max(needed, 1e-12))
        terms, of, share = np.array(terms, np.int64), np.array(of, np.int64), np.array(share)
        order = np.lexsort((of, terms))
        terms, self.of, self.share = terms[order], of[order], share[order]
        self.at = np.searchsorted(terms, np.arange(len(self.term) + 1))
        first = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(self.of // BLOCK) != 0)]) if len(terms) else np.zeros(0, np.int64)
        self.block_of = self.of[first] // BLOCK
        self.block_most = np.maximum.reduceat(self.share, first) if len(first) else np.zeros(0)
        self.block_at = np.searchsorted(terms[first], np.arange(len(self.term) + 1))
        # the same as arrays that are quick to look into one by one; the parts of lists by block follow one another
        self.first, self.maxima = array("q", [*first.tolist(), len(terms)]), array("d", self.block_most.tolist())
        self.item_list, self.share_list = array("q", self.of.tolist()), array("d", self.share.tolist())

    def wand(self, terms: np.ndarray | list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score for these terms is at least 1, with its BM25 score.

        The stored maxima of all blocks are added up at once, and blocks that
        cannot reach 1 are passed over.  In each of the others lists stand in
        the order of their next item, and the pivot is the first item that the
        lists up to it could lift to 1 by their maxima in the block; only pivots
        that these lists have reached are scored.
        """
        pick = _ranges(self.block_at, np.asarray(terms, np.int64))
        bound = np.bincount(self.block_of[pick], self.block_most[pick], len(self.items) // BLOCK + 1)
        out: list[tuple[int, float]] = []
        for block in np.flatnonzero(bound >= 1).tolist():
            out += self._pivots(pick[self.block_of[pick] == block].tolist(), (block + 1) * BLOCK)
        return out

    def _pivots(self, parts: list[int], end: int) -> list[tuple[int, float]]:
        """WAND inside one block, over the parts of lists that lie in it; ``end`` is the first item beyond."""
        items, shares, starts, maxima = self.item_list, self.share_list, self.first, self.maxima
        live = sorted((items[starts[p]], starts[p], p) for p in parts)
        out = []
        while live:
            bound, pivot = 0.0, None
            for n, _, p in live:
                bound += maxima[p]
                if bound >= 1:
                    pivot = n
                    break
            if pivot is None:
                return out
            if live[0][0] == pivot:
                score = sum(shares[h] for n, h, _ in live if n == pivot)
                if score >= 1:
                    out.append((pivot, score * self.scale[pivot]))
                to = pivot + 1
            else:
                to = pivot
            moved = []
            for n, h, p in live:
                if n < to:
                    stop = starts[p + 1]
                    while h < stop and items[h] < to:
                        h += 1
                    if h == stop:
                        continue
                    n = items[h]
                moved.append((n, h, p))
            live = sorted(moved)
        return out

    def passages(self, count: int) -> list[tuple[int, int]]:
        """Word ranges; each stretch of twice the longest item lies in one of them."""
        return [(a, a + 3 * self.longest) for a in range(0, max(1, count - 2 * self.longest), self.longest)]

    def terms_of(self, words: list[str]) -> list[int]:
        return sorted({k for w in set(words) if (k := self.term.get(w)) is not None})

    def hits(self, text: str | None) -> list[tuple[int, float, float, float, float, int]]:
        """(item, overlap, question's, answer's, BM25, first word of the passage): an item's best passage, the first of equals; every passage runs WAND."""
        words = words_of(text)
        known = np.array([self.term.get(w, -1) for w in words], np.int64)
        best: dict[int, tuple] = {}
        for a, b in self.passages(len(words)):
            terms = np.unique(known[a:b])
            got = self.wand(terms[terms >= 0])
            if not got:
                continue
            own = words[a:b]
            sizes = {len(part[0]) for n, _ in got for part in self.items[n].parts if part}
            have = {tuple(own[k : k + n]) for n in sizes for k in range(len(own) - n + 1)}
            for n, score in got:
                item = self.items[n]
                whole, question, answer = (sum(w in have for w in part) / max(1, len(part)) for part in item.parts)
                if (whole >= self.overlap or min(question, answer) >= self.overlap) and (n not in best or whole > best[n][1]):
                    best[n] = (item.item_id, whole, question, answer, score, a)
        return [best[n] for n in sorted(best)]


def _ranges(at: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The positions of all entries of the terms' lists."""
    if not len(terms):
        return terms
    starts, sizes = at[terms], at[terms + 1] - at[terms]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)


def indexes(benchmark: DataFrame, most: int | None = None) -> Iterator[Index]:
    """Indexes of at most about ``most`` text bytes each, one after another, all with the statistics of all items; items of a null id or without words are left out.

    Only one index is on the driver at a time.
    """
    most = most or INDEX_BYTES
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    if size <= most:
        index = Index([tuple(r) for r in rows.collect()])
        if index.items:
            yield index
        return
    parts = -(-size // most)

    def count(columns):
        bags = [words_of(t) for t in columns[1]]
        return [*columns, [len(b) for b in bags], [sorted(set(b)) for b in bags]]

    counted = cut(map_arrow(rows, "item_id: long, text: string, n: long, words: array<string>", count).where("n > 0").withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))))
    items, mean, longest = counted.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    having = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("having"))
    for k in range(parts):
        own = counted.where(F.col("part") == k)
        words = own.select(F.explode("words").alias("word")).distinct()
        known = Statistics(items or 0, mean or 1.0, longest or 1, {r.word: r.having for r in having.join(words, "word").collect()})
        index = Index([tuple(r) for r in own.select("item_id", "text").collect()], known)
        if index.items:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item that is found in a passage of it.

    Null and empty texts and empty tables give no rows; repeated documents give
    rows of their own, and an item id with several texts counts each text.
    """
    schema = "doc_id: long, item_id: long, overlap: double, question_overlap: double, answer_overlap: double, bm25: double, first_word: long"
    out = None
    for index in indexes(benchmark):
        if out is not None:
            out = cut(out)  # the index before is no longer needed

        def run(columns, index=index):
            rows = [(i, *h) for i, x in zip(*columns, strict=True) for h in index.hits(x)]
            return [list(c) for c in zip(*rows)] if rows else [[]] * 7

        one = map_arrow(texts(docs), schema, run)
        out = one if out is None else out.union(one)
    return out if out is not None else map_arrow(texts(docs), schema, lambda columns: [[]] * 7)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no test item is found, with all their columns; one pass over the texts for each index."""
    where = docs.columns.index("text")
    first = True
    for index in indexes(benchmark):
        if not first:
            docs = cut(docs)
        first = False

        def keep(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([not index.hits(x.as_py()) for x in batch.column(where)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("bm25")


ORACLE = f"""
WITH dw AS (SELECT rid, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)),
ds AS (SELECT rid, k, array_to_string(w[k+1:k+{SHINGLE}], ' ') AS s FROM (SELECT rid, w, unnest(range(len(w) - {SHINGLE - 1})) AS k FROM dw)),
it AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w, string_split_regex(regexp_replace(trim(text, chr(9) || chr(10) || chr(13) || ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM benchmark),
qa AS (SELECT item_id, w, regexp_extract_all(lower(CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts)-1], ' ') ELSE parts[1] END), '[\\p{{L}}\\p{{N}}_]+') AS q, regexp_extract_all(lower(parts[len(parts)]), '[\\p{{L}}\\p{{N}}_]+') AS a FROM it),
pt AS (SELECT item_id, 0 AS part, w FROM qa UNION ALL SELECT item_id, 1, q FROM qa UNION ALL SELECT item_id, 2, a FROM qa),
sh AS (SELECT item_id, part, least(len(w), {SHINGLE}) AS n, k, array_to_string(w[k+1:k+least(len(w), {SHINGLE})], ' ') AS s FROM (SELECT item_id, part, w, unnest(range(greatest(1, len(w) - {SHINGLE - 1}))) AS k FROM pt WHERE len(w) > 0)),
sz AS (SELECT item_id, part, count(*) AS total FROM sh GROUP BY ALL),
lg AS (SELECT max(len(w)) AS longest FROM qa),
pa AS (SELECT rid, w, unnest(range(0, greatest(1, len(w) - 2 * longest), longest)) AS a, longest FROM dw, lg),
can AS (SELECT DISTINCT rid, item_id FROM ds JOIN sh ON ds.s = sh.s AND part = 0),
ch AS (SELECT can.rid, can.item_id, a, w[a+1:a+3*longest] AS own FROM can JOIN pa USING (rid)),
own AS (SELECT rid, item_id, a, n, unnest(range(len(own) - n + 1)) AS k, own FROM ch, (SELECT DISTINCT n FROM sh)),
have AS (SELECT DISTINCT rid, item_id, a, n, array_to_string(own[k+1:k+n], ' ') AS s FROM own),
cnt AS (SELECT rid, h.item_id, a, part, count(*) AS got FROM have h JOIN sh ON h.item_id = sh.item_id AND h.n = sh.n AND h.s = sh.s GROUP BY ALL),
rt AS (SELECT rid, item_id, a, part, got * 1.0::DOUBLE / total AS r FROM cnt JOIN sz USING (item_id, part)),
best AS (SELECT rid, item_id, a, coalesce(max(r) FILTER (part = 0), 0) AS overlap, coalesce(max(r) FILTER (part = 1), 0) AS question_overlap, coalesce(max(r) FILTER (part = 2), 0) AS answer_overlap FROM rt GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY rid, item_id ORDER BY overlap DESC, a) AS k FROM best WHERE overlap >= {OVERLAP} OR least(question_overlap, answer_overlap) >= {OVERLAP})
SELECT doc_id, item_id, overlap, question_overlap, answer_overlap, a AS first_word FROM top JOIN dw USING (rid) WHERE k = 1"""
