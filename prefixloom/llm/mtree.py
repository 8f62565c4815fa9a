"""Exact top-k by inner product: M-trees of bounded size, searched best-first.

An inner product is no metric, so a row o becomes the point (o, sqrt(M - o.o)), M
being the largest o.o of its tree, and a query q the point (q, 0): then the
squared distance is q.q + M - 2 q.o, and the nearest points have the highest
scores.  A tree's pages hold routing objects with covering radii and distances to
the page's own routing object (the parent), leaves hold rows with that distance.
A search takes the page with the best bound next.  What the triangle inequality
says from the parent's known distance and the stored ones alone is not computed;
what is left gets its distance, and a page whose ball cannot reach the k-th best
score so far is not read.  Queries of a block share the walk, so that distances
are matrix products; every query keeps its own bounds.

Rows of equal vectors are one entry, which needs only its k + 1 smallest ids, so a
vector that a third of all rows have is cut before the shuffle.  Entries are dealt
by their nearest pivot, parts of a pivot by a hash, and each part is a tree stored
in the shared folder.  Blocks of queries first search a tree of their own pivot,
which gives each query a score to beat, then every tree whose ball reaches that:
a join of blocks and the trees' balls on a page number, and of what is left and
the trees on the tree's number.  No task holds more than a tree and a block.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, table

SCALE = 64
K = 20
EVERY = 20
#: Entries of a page, and routing objects of an inner one.
PAGE, FAN = 256, 16
#: Numbers in a tree and in a block of queries; divided by the length of vectors they give rows.
TREE_VALUES, BLOCK_VALUES = 1 << 20, 1 << 15
#: Pivots at most; a pivot that gets more than a tree of entries has several trees.
MOST_PIVOTS = 512
#: Balls of one page of the directory of trees, and blocks that share one copy of a page.
BALLS, BLOCKS = 1024, 16


@dataclass
class Tree:
    """Pages of an M-tree in flat arrays: page p has the entries start[p]:start[p + 1].

    An entry is a row (child -1, then ``row``) or a routing object with the
    covering radius of its child page; ``up`` is the distance to the routing
    object of its own page.  ``vectors`` are the integers, ``root`` is the routing
    object of the first page.
    """

    vectors: np.ndarray
    radius: np.ndarray
    up: np.ndarray
    child: np.ndarray
    row: np.ndarray
    start: np.ndarray
    ids: np.ndarray
    none: np.ndarray
    ends: np.ndarray
    root: np.ndarray
    largest: float

    def packed(self) -> bytes:
        out = io.BytesIO()
        small = self.vectors.astype(np.int32) if np.abs(self.vectors).max(initial=0) < 2**31 else self.vectors
        np.savez(out, **(vars(self) | {"vectors": small, "largest": np.float64(self.largest)}))
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as f:
            got = {k: f[k] for k in f.files}
        return Tree(**(got | {"largest": float(got["largest"])}))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def grow(values: np.ndarray, ids: list[list[int | None]]) -> Tree:
    """Bulk load: a set over a page's size is dealt to FAN of its members as routing objects, each with those nearest to it.

    A child that gets over half of a set is cut in equal parts by the distance
    to its routing object, so depth is logarithmic for any data.
    """
    norms = _norms(values)
    largest = float(norms.max(initial=0))
    full = np.column_stack([values, np.sqrt(np.maximum(largest - norms, 0))])
    squares = _norms(full)

    def far(who, routing):
        return np.sqrt(np.maximum(squares[who] + squares[routing] - 2 * (full[who] @ full[routing]), 0))

    pages: list[list[tuple]] = []

    def page(who: np.ndarray, routing: int) -> int:
        """Makes the page of a set below a routing object; returns its number."""
        own = len(pages)
        pages.append([])
        up = far(who, routing)
        if len(who) <= PAGE:
            pages[own] = [(int(w), 0.0, float(u), -1) for w, u in zip(who, up, strict=True)]
            return own
        heads = who[:: max(1, len(who) // FAN)][:FAN]
        near = np.argmin(squares[heads][None, :] - 2 * (full[who] @ full[heads].T), axis=1)
        sets = []
        for h, head in enumerate(heads):
            some = who[near == h]
            if 2 * len(some) > len(who):
                some = some[np.argsort(far(some, head), kind="stable")]
                sets += [(int(part[0]), part) for part in np.array_split(some, FAN) if len(part)]
            elif len(some):
                sets.append((int(head), some))
        for head, some in sets:
            pages[own].append((head, float(far(some, head).max()), float(far(np.array([head]), routing)[0]), page(some, head)))
        return own

    page(np.arange(len(values)), 0)
    flat = [e for p in pages for e in p]
    index = np.array([e[0] for e in flat], np.int64)
    child = np.array([e[3] for e in flat], np.int64)
    lengths = np.array([len(x) for x in ids], np.int64)
    every = [i for x in ids for i in x]
    return Tree(
        values[index], np.array([e[1] for e in flat]), np.array([e[2] for e in flat]), child, np.where(child < 0, index, -1), np.cumsum([0, *map(len, pages)]),
        np.array([0 if i is None else i for i in every], np.int64), np.array([i is None for i in every], bool), np.cumsum(lengths), values[0], largest,
    )


def reach(tree: Tree) -> float:
    """The covering radius of a tree around its root's routing object."""
    first = slice(int(tree.start[0]), int(tree.start[1]))
    return float((tree.up[first] + tree.radius[first]).max())


def bounds(dots: np.ndarray, nearest: np.ndarray, further: np.ndarray, q2: np.ndarray, largest: float) -> np.ndarray:
    """The highest score of a point no nearer to the query than ``nearest``, and no further than ``further`` from one of the inner product ``dots``.

    By the triangle inequality and by Cauchy's, with room for rounding; infinite where floats overflow.
    """
    point = q2 + largest
    with np.errstate(all="ignore"):
        best = np.minimum((point - nearest**2) / 2, dots + np.sqrt(q2) * further) + 1e-9 * (point + 1) + 1e-13 * point**1.5
    return np.where(np.isnan(best), np.inf, best)


def distances(dots: np.ndarray, q2: np.ndarray, largest: float) -> np.ndarray:
    """Of queries and points, from their inner products."""
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum(q2 + largest - 2 * dots, 0))


class Search:
    """One block of queries; ``least`` is each query's score to reach, raised to its k-th best as rows are found.

    ``computed`` counts the inner products that were needed.
    """

    def __init__(self, queries: np.ndarray, least: np.ndarray, k: int):
        self.q, self.q2, self.k = queries, _norms(queries), k
        self.least = least.copy()
        self.best = np.full((len(queries), k), -np.inf)
        self.computed = 0

    def _dots(self, who: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Exact inner products: in floats that hold every partial sum, else in Python's integers."""
        self.computed += len(who) * len(vectors)
        top = np.sqrt(self.q2.max(initial=0)) * np.sqrt(_norms(vectors.astype(np.float64)).max(initial=0))
        if top < 2**23:
            return (self.q[who].astype(np.float32) @ vectors.T.astype(np.float32)).astype(np.float64)
        if top < 2**52:
            return self.q[who] @ vectors.T.astype(np.float64)
        return _integers(self.q[who]) @ _integers(vectors).T

    def over(self, tree: Tree) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, rows, scores) that may be among the best, exact."""
        found: list[tuple] = []
        everyone = np.arange(len(self.q))
        dots = self._dots(everyone, tree.root[None, :]).astype(np.float64)[:, 0]
        queue, order = [(-np.inf, 0, 0, everyone, dots, np.full(len(everyone), np.inf))], 0
        while queue:
            _, _, page, who, parent, bound = heapq.heappop(queue)
            live = bound >= self.least[who]
            who, parent = who[live], parent[live]
            at = np.arange(tree.start[page], tree.start[page + 1])
            up, radius, q2 = tree.up[at][None, :], tree.radius[at][None, :], self.q2[who][:, None]
            # the distance of query and parent is known, that of parent and entry is stored
            nearest = np.maximum(np.abs(distances(parent, self.q2[who], tree.largest)[:, None] - up) - radius, 0)
            asked = bounds(parent[:, None], nearest, up + radius, q2, tree.largest) >= self.least[who][:, None]
            rows, entries = asked.any(axis=1), asked.any(axis=0)
            if not rows.any():
                continue
            who, at, asked, q2 = who[rows], at[entries], asked[rows][:, entries], q2[rows]
            dots = self._dots(who, tree.vectors[at])
            if tree.child[at[0]] < 0:
                self._leaf(who, tree.row[at], dots, found)
                continue
            dots, radius = dots.astype(np.float64), tree.radius[at][None, :]
            nearest = np.maximum(distances(dots, q2, tree.largest) - radius, 0)
            high = bounds(dots, nearest, radius, q2, tree.largest)
            good = asked & (high >= self.least[who][:, None])
            for j in np.flatnonzero(good.any(axis=0)):
                some, order = good[:, j], order + 1
                heapq.heappush(queue, (-float(high[some, j].max()), order, int(tree.child[at[j]]), who[some], dots[some, j], high[some, j]))
        return found

    def _leaf(self, who: np.ndarray, rows: np.ndarray, dots: np.ndarray, found: list) -> None:
        scores = dots.astype(np.float64)
        hit = scores >= self.least[who][:, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        found.append((who[i], rows[j], dots[i, j]))
        some = np.flatnonzero(hit.any(axis=1))
        merged = np.concatenate([self.best[who[some]], np.where(hit[some], scores[some], -np.inf)], axis=1)
        self.best[who[some]] = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k :]
        kth = self.best[who[some]].min(axis=1)
        self.least[who[some]] = np.maximum(self.least[who[some]], below(kth))


def below(scores: np.ndarray) -> np.ndarray:
    """A float that no integer it was rounded from is below."""
    return np.where(np.isfinite(scores) & (np.abs(scores) >= 2**53), scores - np.abs(scores) * 1e-12, scores)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def hits(search: Search, tree: Tree) -> tuple[np.ndarray, list[int], list[int | None], list[bool]]:
    """(query, score, id, whether the vector is the query's) of at most k rows of a tree for each query of the block, best first, ties to smaller ids, null ids last."""
    found = search.over(tree)
    if not found:
        return np.zeros(0, np.int64), [], [], []
    q, e, s = (np.concatenate([f[x] for f in found]) for x in range(3))
    keep = s.astype(np.float64) >= search.least[q]
    q, e, s = q[keep], e[keep], s[keep]
    counts = np.diff(tree.ends, prepend=0)[e]
    each = np.repeat(np.arange(len(q)), counts)
    spot = (tree.ends[e] - counts)[each] + np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids, none = tree.ids[spot], tree.none[spot]
    order = np.lexsort((ids, none, -_ranks(s)[each], q[each]))
    sorted_q = q[each][order]
    order = order[np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q, side="left") < search.k]
    chosen = each[order]
    leaf = np.empty(len(tree.ends), np.int64)
    leaf[tree.row[tree.row >= 0]] = np.flatnonzero(tree.row >= 0)
    same = (tree.vectors[leaf[e[chosen]]] == search.q[q[chosen]]).all(axis=1)
    return q[chosen], [int(x) for x in s[chosen]], [None if n else int(i) for i, n in zip(ids[order], none[order], strict=True)], same.tolist()


def _ranks(scores: np.ndarray) -> np.ndarray:
    """Integers of any size as ones that order alike."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    rank = {v: k for k, v in enumerate(sorted(set(scores.tolist())))}
    return np.array([rank[v] for v in scores.tolist()], np.int64)


def quantised(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): usable rows with floor(scale * x) of every component, as doubles, which hold those integers exactly."""
    x = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    down = lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale)
    good = F.col(vector).isNotNull() & F.coalesce(F.forall(x, finite), F.lit(False))
    return rows.where(good).select(F.col(key).cast("long").alias("id"), F.transform(x, down).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def dealt(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (n, v, ids, asked) with ``pivot`` and ``part``; and (n, pivot, parts).

    Pivots are the entries of smallest hash, as many as there are trees to
    fill, MOST_PIVOTS at most.  A length of which none is a pivot has pivot -1.
    """
    total = entries.agg(F.sum(F.col("n").cast("long") + 1)).first()[0] or 0
    most = int(min(MOST_PIVOTS, max(1, total // TREE_VALUES)))
    chosen = [(r["n"], np.array(r["v"], float)) for r in entries.select("n", "v", F.xxhash64("v", F.lit(11)).alias("h")).orderBy("h", "n").limit(most).collect()]
    pivots = {size: np.array([v for n, v in chosen if n == size]) for size in {n for n, _ in chosen}}

    def run(batches):
        for batch in batches:
            sizes = batch.column(0).to_numpy(zero_copy_only=False)
            near = np.full(len(sizes), -1, np.int32)
            for size in np.unique(sizes):
                if size in pivots and size:
                    rows = np.flatnonzero(sizes == size)
                    p = pivots[size]
                    with np.errstate(all="ignore"):
                        x = _matrix(batch.column(1).take(pa.array(rows)), size)
                        near[rows] = np.argmin(np.nan_to_num((p * p).sum(axis=1)[None, :] - 2 * x @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*batch.schema.names, "pivot"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema) + ", pivot int"
    placed = cut(entries.mapInArrow(run, schema))
    counts = placed.groupBy("n", "pivot").agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.col("n"), F.lit(1)) / TREE_VALUES).cast("int").alias("parts"))
    counts = cut(counts)
    keyed = placed.join(counts.select(F.col("n").alias("n_"), F.col("pivot").alias("pivot_"), "parts"), (F.col("n") == F.col("n_")) & (F.col("pivot") == F.col("pivot_")))
    return keyed.withColumn("part", F.pmod(F.xxhash64("v", F.lit(5)), F.col("parts")).cast("int")).drop("n_", "pivot_", "parts"), counts


def trees(keyed: DataFrame) -> DataFrame:
    """(n, pivot, part, tree, point, radius, largest): a packed tree for each part, with its ball."""

    def run(key, rows):
        n, pivot, part = (x.as_py() for x in key)
        tree = grow(_matrix(rows.column("v"), n), rows.column("ids").to_pylist())
        types = {"n": pa.int32(), "pivot": pa.int32(), "part": pa.int32(), "tree": pa.binary(), "point": pa.list_(pa.float64()), "radius": pa.float64(), "largest": pa.float64()}
        return pa.table({name: pa.array([v], types[name]) for name, v in zip(types, (n, pivot, part, tree.packed(), tree.root.tolist(), reach(tree), tree.largest), strict=True)})

    return keyed.select("n", "pivot", "part", "v", "ids").groupBy("n", "pivot", "part").applyInArrow(run, "n int, pivot int, part int, tree binary, point array<double>, radius double, largest double")


def _block(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the queries, their vectors and their scores to reach, of a row with n, qids, q and least."""
    n, qids, q, least = (batch.column(c)[r] for c in ("n", "qids", "q", "least"))
    flat = lambda x: x.values.to_numpy(zero_copy_only=False)
    return flat(qids), flat(q).astype(np.float64).reshape(-1, n.as_py()), flat(least).astype(np.float64)


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, score, id, same): the best k rows of a tree for each query of a block, for rows (n, qids, q, least, tree)."""

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                qids, q, least = _block(batch, r)
                who, scores, ids, same = hits(Search(q, least, k), Tree.unpacked(batch.column("tree")[r].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(qids[who], pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64()), pa.array(same, pa.bool_())], names=["qid", "score", "id", "same"])

    return pairs.select("n", "qids", "q", "least", "tree").mapInArrow(run, "qid long, score long, id long, same boolean")


def reached(pairs: DataFrame) -> DataFrame:
    """For rows (n, qids, q, least, balls) the queries of a block that may have a row in a tree, by tree."""
    types = {"n": pa.int32(), "pivot": pa.int32(), "part": pa.int32(), "qids": pa.list_(pa.int64()), "q": pa.list_(pa.float64()), "least": pa.list_(pa.float64())}

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                qids, q, least = _block(batch, r)
                q2 = _norms(q)
                for b in batch.column("balls")[r].as_py():
                    dots = q @ np.array(b["point"], float)
                    nearest = np.maximum(distances(dots, q2, b["largest"]) - b["radius"], 0)
                    some = np.flatnonzero(bounds(dots, nearest, b["radius"], q2, b["largest"]) >= least)
                    if len(some):
                        row = (q.shape[1], b["pivot"], b["part"], qids[some].tolist(), q[some].ravel(), least[some])
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types.values(), strict=True)], names=list(types))

    return pairs.select("n", "qids", "q", "least", "balls").mapInArrow(run, "n int, pivot int, part int, qids array<long>, q array<double>, least array<double>")


def blocked(keyed: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries (n, pivot, v, qid), and their blocks (n, qids, q, block), each with the pivot and part of the tree that it searches first."""
    queries = cut(keyed.where("asked and n > 0").select("n", "pivot", "v").withColumn("qid", F.monotonically_increasing_id()))
    size = F.greatest(F.floor(F.lit(BLOCK_VALUES) / F.col("n")), F.lit(1))
    held = queries.groupBy("n", "pivot").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("slots")).join(counts, ["n", "pivot"])
    dealt_out = queries.join(held, ["n", "pivot"]).withColumn("slot", F.pmod(F.xxhash64("qid"), F.col("slots")).cast("int"))
    blocks = dealt_out.groupBy("n", "pivot", "slot").agg(F.collect_list(F.struct("qid", "v")).alias("all"), F.first("parts").alias("parts"))
    blocks = blocks.select("n", "pivot", F.pmod("slot", "parts").cast("int").alias("part"), F.monotonically_increasing_id().alias("block"), F.col("all.qid").alias("qids"), F.flatten("all.v").alias("q"))
    return queries, cut(blocks)


def raised(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks with each query's score to reach: the last of its k rows found so far."""
    scores = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("m"))
    # a long that becomes a double may be rounded up
    least = F.coalesce(F.when(F.abs("m") < 2.0**53, F.col("m")).otherwise(F.col("m") - F.abs("m") * 1e-12), F.lit(float("-inf")))
    each = blocks.select("block", F.posexplode("qids").alias("i", "qid")).join(scores, "qid", "left")
    lists = each.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", least.alias("least")))), lambda x: x["least"]).alias("least"))
    return blocks.join(lists, "block")


def directed(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks with the balls of all trees but the one that they have searched, page by page of the directory.

    A page is copied for every BLOCKS blocks, so no task sees all blocks.
    """
    copies = max(1, -(-blocks.count() // BLOCKS))
    pages = max(1, -(-stored.count() // BALLS))
    page = F.pmod(F.xxhash64("pivot", "part"), F.lit(pages)).cast("int").alias("page")
    balls = stored.groupBy("n", page).agg(F.collect_list(F.struct("pivot", "part", "point", "radius", "largest")).alias("balls"))
    balls = balls.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asking = blocks.withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int")).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    met = asking.join(balls, ["n", "page", "copy"])
    return met.withColumn("balls", F.filter("balls", lambda b: (b["pivot"] != F.col("pivot")) | (b["part"] != F.col("part"))))


def top_k(rows: DataFrame, asked: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, the key and score: for every row for which ``asked``, a condition on its id as column ``id``, holds, its k rows of highest score among all others.

    Components become floor(scale * x); the score is their inner product, exact.
    Ties go to the smaller id.  A row whose vector is null or holds null or
    non-finite components takes no part, neither as query nor as candidate.
    Repeated rows are rows: a query leaves out itself alone, not its copies, and
    each copy is asked for.  Rows of a null id are candidates, after others of
    their score.  Vectors of different lengths have no inner product and do not
    meet; empty vectors meet each other with score 0.  A best score that a long
    cannot hold is an error.  An empty table gives no rows, and a query without
    others has none.  Columns beyond key and vector play no part.
    """
    own = cut(quantised(rows, key, vector, scale).withColumn("asked", F.coalesce(asked, F.lit(False))))
    # a vector's rows beyond the k + 1 smallest ids are among nobody's best k
    by = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    few = own.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("ids"))
    wanted = own.where("asked").select("v").distinct().withColumn("asked", F.lit(True))
    entries = cut(few.join(wanted, "v", "left").select(F.size("v").alias("n"), "v", F.col("ids.id").alias("ids"), F.coalesce("asked", F.lit(False)).alias("asked")))
    keyed, counts = dealt(entries)
    stored = cut(trees(keyed.where("n > 0")))
    queries, blocks = blocked(keyed, counts)
    where = ["n", "pivot", "part"]
    contents = stored.select(*where, "tree")
    home = cut(searched(blocks.withColumn("least", F.transform("qids", lambda _: F.lit(float("-inf")))).join(contents, where), k + 1))
    rest = searched(reached(directed(raised(blocks, home, k + 1), stored)).join(contents, where), k + 1)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    lists = home.unionByName(rest).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = lists.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score", "same"))).alias("list")).join(queries, "qid").select("v", "list")
    zero = F.transform("ids", lambda x, i: F.struct((i + 1).alias("r"), x.alias("id"), F.lit(0).cast("long").alias("score"), F.lit(True).alias("same")))
    lists = lists.unionByName(entries.where("asked and n = 0").select("v", zero.alias("list")))
    itself = F.array_min(F.transform(F.filter("list", lambda x: x["same"] & x["id"].eqNullSafe(F.col("id"))), lambda x: x["r"]))
    others = F.slice(F.filter("list", lambda x: x["r"] != F.coalesce(itself, F.lit(0))), 1, k)
    out = own.where("asked").join(lists, "v").select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "row"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias(key), F.col("row.score").alias("score"))


def op11_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q, row_number() OVER () AS rid FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
