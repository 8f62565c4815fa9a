"""SimHash near-duplicates: exact linking of fingerprints at a small Hamming distance.

Fingerprints are made once per text, equal ones collapse, and different ones
meet in tables keyed by block combinations: with 6 blocks and at most 4
differing bits two blocks agree, so one of 15 tables, keyed by 21 bits, brings
every linked pair together.  More fingerprints get wider keys, so that buckets
of unrelated members stay small: 7 blocks have 35 tables of 27 bits, 8 blocks
70 tables of 32 bits.  The links are the same with each.
Inside such a bucket a pivot table decides: the distances of each member to
many reference fingerprints are computed once, a pair whose coordinates differ
by more than the limit anywhere cannot be linked (triangle inequality) and is
discarded, and survivors are verified.  A bucket gives a spanning forest of its
links, never all pairs; large buckets are dealt out as pairs of bounded parts.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, map_arrow, table, texts
from prefixloom.llm.components import components

SEED = 42
SHINGLE = 4
MOST_BITS = 4
#: Different fingerprints up to which so many blocks are made; what is more gets the last.
BLOCKS = ((1 << 23, 6), (1 << 29, 7), (1 << 63, 8))
PIVOTS = 16
#: Members of one part of a bucket; a task sees two parts at once.
PART = 4096

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as an unsigned number: a bit is set if it is set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(bytes.maketrans(_UPPER, _LOWER)).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    n = len(words) - SHINGLE + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    ends = (starts + lengths - 1)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)])
    votes = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):
        votes += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; null and empty texts have 0."""

    def run(columns):
        ids, bodies = columns
        return [ids, np.array([fingerprint(x) for x in bodies], np.uint64).view(np.int64).tolist()]

    return map_arrow(texts(docs), "doc_id: long, fp: long", run)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, by hashing their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot%d" % k, SEED) for k in range(count)], np.uint64)


def forest(fps: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a spanning forest of the links among different fingerprints.

    A member is compared with those not reached so far: sorted by the first
    coordinate only a window can be within the limit, the other coordinates of
    the pivot table discard most of that, and the rest is verified.
    """
    n = len(fps)
    refs = pivots()
    coords = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.argsort(coords[:, 0], kind="stable")
    fps, coords = fps[order], coords[order]
    first = coords[:, 0].astype(np.int64)
    left = np.ones(n, bool)
    out_a, out_b = [], []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            x = stack.pop()
            low, high = np.searchsorted(first, [first[x] - most, first[x] + most + 1])
            near = np.flatnonzero(left[low:high]) + low
            if not len(near):
                continue
            for step in range(1, coords.shape[1], 5):
                near = near[(np.abs(coords[near, step : step + 5] - coords[x, step : step + 5]) <= most).all(axis=1)]
                if not len(near):
                    break
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= most]
            left[near] = False
            stack += near.tolist()
            out_a += [x] * len(near)
            out_b += near.tolist()
    return order[np.array(out_a, np.int64)], order[np.array(out_b, np.int64)]


def keys(column, blocks: int) -> list:
    """For each choice of blocks that must agree a number of table and block bits, from the signed fingerprint."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    block = [(F.shiftrightunsigned(column, a).bitwiseAND((1 << (b - a)) - 1), b - a) for a, b in itertools.pairwise(edges)]
    out = []
    for k, chosen in enumerate(itertools.combinations(block, blocks - MOST_BITS)):
        key = F.lit(k).cast("long")
        for bits, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(bits)
        out.append(key)
    return out


def links(distinct: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the representatives of different fingerprints that connect all that is within the limit.

    ``distinct`` has ``fp`` and ``rep``.  Buckets of one fingerprint end early;
    a bucket of more than PART members is cut in parts by a hash, and every
    pair of parts becomes a group of its own, so none grows with the bucket.
    """
    if blocks is None:
        count = distinct.count()
        blocks = next(b for most, b in BLOCKS if count <= most)
    keyed = distinct.select("fp", "rep", F.explode(F.array(*keys(F.col("fp"), blocks))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("its"), F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    member = keyed.join(sizes, F.col("key") == F.col("its"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")).otherwise(F.lit(0))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    dealt = member.withColumn("part", part).withColumn("pair", F.explode(others))
    groups = dealt.groupBy("key", "pair").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).where(F.size("members") > 1)
    groups = groups.select(F.col("members.fp").alias("fps"), F.col("members.rep").alias("reps"))
    return groups.mapInArrow(_links, "a long, b long").where("a <> b").distinct()


def _links(batches):
    import pyarrow as pa

    for batch in batches:
        fps, reps = batch.column(0), batch.column(1)
        flat = fps.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        who = reps.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.asarray(fps.value_lengths().to_numpy(zero_copy_only=False)))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        sizes = ends - starts
        two = starts[sizes == 2]
        refs = pivots()
        apart = np.zeros(len(two), np.uint8)
        for p in refs:  # the pivot table of all buckets of two at once
            d = np.bitwise_count(flat[two] ^ p).astype(np.int16) - np.bitwise_count(flat[two + 1] ^ p).astype(np.int16)
            apart = np.maximum(apart, np.abs(d).astype(np.uint8))
        two = two[apart <= MOST_BITS]
        two = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= MOST_BITS]
        a, b = [who[two]], [who[two + 1]]
        for k in np.flatnonzero(sizes > 2):
            own = slice(starts[k], ends[k])
            i, j = forest(flat[own])
            a.append(who[own][i])
            b.append(who[own][j])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document row.

    A document of a null id joins the component of its fingerprint, or has none
    if no document with an id shares that fingerprint; it links no others.
    Repeated rows are kept; texts without words share fingerprint 0.
    """
    prints = cut(fingerprints(docs))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = cut(reps.where("least is not null").select("fp", F.col("least").alias("rep")))
    labels = components(links(distinct))
    named = distinct.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("its"), F.coalesce("component", "rep").alias("root"))
    out = prints.join(named, F.col("fp") == F.col("its"), "left")
    return out.select("doc_id", "fp", F.col("root").alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """One document row of each group, all columns kept: of the smallest id, then fingerprint, then text hash.

    Groups join different fingerprints, not ids: texts that share an id are
    documents of their own, and a null id, which sorts last, is one as well.
    """
    own = lambda: F.coalesce(F.unhex(F.md5("text")), F.lit(b""))

    def run(columns):
        ids, bodies, hashes = columns
        return [ids, hashes, np.array([fingerprint(x) for x in bodies], np.uint64).view(np.int64).tolist()]

    prints = map_arrow(docs.select("doc_id", "text", own().alias("hash")), "doc_id: long, hash: binary, fp: long", run)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "hash")).alias("first")
    distinct = cut(prints.groupBy("fp").agg(first))
    labels = components(links(distinct.select("fp", F.col("fp").alias("rep"))))
    rooted = distinct.join(labels, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = rooted.select(F.col("first.doc_id").alias("__id"), F.col("first.hash").alias("__kept"))
    rows = docs.withColumn("__hash", own())
    once = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__kept")), "left_semi")
    return once.dropDuplicates(["doc_id", "__hash"]).drop("__hash")
