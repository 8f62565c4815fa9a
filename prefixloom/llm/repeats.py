"""Exact removal of long repeated byte strings, decided by suffix arrays.

Every byte that lies in a string of WINDOW bytes which also starts elsewhere is
removed.  Python cannot sort all the text's bytes, so the text is made short
without loss first: each window owns the least hash among its k-grams (its
anchor), equal windows own equal anchors at equal places, and runs of windows
that own one anchor form a segment.  An anchor that occurs once cannot lie in a
repeat.  An anchor that occurs several times with one kind of segment only (equal
bytes by its hash) repeats as a whole, and there is nothing to sort: this exit
decides two fifths of what goes on the given tables (README).  The segments of
all other anchors become strings of symbols, cut where any two segments of an
anchor part, and a suffix array over these strings (``suffix_array``) with the
prefixes that neighbours share tells which windows repeat.  Equal segments are
one kind, sent to the suffix array once, or twice if it has several occurrences.

An anchor of more kinds than one task should sort is split by longer anchors:
its segments' windows are dealt by their least hash among longer grams, up to
whole windows, and each part is decided in the same way.

Two kinds are told apart by 64 bits of a polynomial hash beside the anchor's,
so two different segments count as one with a chance of 2^-64 for each pair of
an anchor's kinds; the known bad strings for such hashes have over 1,000 bytes,
a segment has at most 360.  Documents of one id are told apart by xxhash64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, table
from prefixloom.llm.suffix_array import neighbours, suffix_array

WINDOW = 200
#: Bytes of an anchor, and of the longer ones that split an anchor of many kinds.
GRAMS = (40, 100, 160, WINDOW)
GRAM = GRAMS[0]
#: Window starts that are hashed at once; longer texts are taken in slabs of so many.
SLAB = 1 << 20
#: Kinds of one anchor that are sorted together; an anchor with more is split.
PART = 512
#: Segments that one suffix array takes, if no anchor has more.
SORTED = 4096
#: Hot anchors, or repeated rows, up to which their keys are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of substrings by prefix sums of a polynomial modulo 2^64; equal strings have equal hashes."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.room = window, gram, 0
        self._grow(1 << 16)

    def _grow(self, room: int) -> None:
        self.room = room
        powers = np.full(room + 1, np.uint64(_BASE))
        powers[0] = _ONE
        self.up = np.multiply.accumulate(powers)
        powers[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        self.down = np.multiply.accumulate(powers)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.room:
            self._grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _ONE) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[start])

    def segments(self, data: bytes) -> tuple[np.ndarray, ...]:
        """(anchor hash, segment hash, first window start, windows, anchor's place in the segment) of a text's segments."""
        parts = []
        for at in range(0, max(0, len(data) - self.window + 1), SLAB):
            parts.append((at, *self._slab(np.frombuffer(data, np.uint8)[at : at + SLAB + self.window - 1])))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        keys, segs, firsts, counts, places = (np.concatenate([p[k] + p[0] if k == 3 else p[k] for p in parts]) for k in range(1, 6))
        return keys.view(np.int64), segs.view(np.int64), firsts, counts, places

    def _slab(self, data: np.ndarray):
        sums = self.sums(data)
        n = len(data)
        grams = np.arange(n - self.gram + 1)
        keys = self.of(sums, grams, grams + self.gram)
        # the place breaks ties between equal hashes towards the left; it also tells where the least one is
        tagged = (keys & np.uint64(0xFFFFFFFFFF000000)) | grams.astype(np.uint64)
        width, starts = self.window - self.gram + 1, n - self.window + 1
        blocks = -(-len(tagged) // width)
        full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        full[: len(tagged)] = tagged
        rows = full.reshape(blocks, width)
        forward = np.minimum.accumulate(rows, axis=1).ravel()
        backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(backward[:starts], forward[width - 1 : width - 1 + starts])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [starts])) - 1
        anchor = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        whole = self.of(sums, first, last + self.window)
        segs = _mix(whole ^ ((last - first) * 1024 + (anchor - first)).astype(np.uint64))
        return keys[anchor], segs, first, last - first + 1, anchor - first


Segment = tuple[int, bytes, int, int, bool]


def repeated_windows(segments: list[Segment], window: int = WINDOW, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For each (group, bytes, window starts, anchor's place, several): ranges [a, b) of window starts that occur again.

    The segments of a group share an anchor; one with ``several`` occurrences
    stands twice.  They are cut where two of them part on either side of it,
    equal parts get equal symbols, and the suffix array of all the symbol
    strings tells how far each agrees with any other.
    """
    groups: dict[tuple[int, bytes], list[int]] = {}
    for k, (group, body, _, place, _) in enumerate(segments):
        groups.setdefault((group, body[place : place + gram]), []).append(k)
    text: list[int] = []
    where: list[tuple[int, list[int], int]] = []  # where a segment's symbols start
    symbols: dict[tuple, int] = {}
    stops = 0
    for key, members in groups.items():
        edges = _edges([segments[k][1:4] for k in members], gram)
        for k in members:
            _, body, _, place, several = segments[k]
            own = [c for c in edges if -place <= c <= len(body) - place]
            where.append((k, own, len(text)))
            string = [symbols.setdefault((key, a, body[place + a : place + b]), len(symbols)) for a, b in zip(own, own[1:])]
            for _ in range(2 if several else 1):
                stops += 1
                text += [*string, -stops]
    shared = _shared(text, stops)
    found: list[list[tuple[int, int]]] = [[] for _ in segments]
    for k, own, first in where:
        _, _, starts, place, _ = segments[k]
        for n in range(len(own) - 1):
            end = min(own[n + 1], own[n + shared[first + n]] - window + 1, starts - place)
            if end > own[n]:
                found[k].append((own[n] + place, end + place))
    return found


def _shared(text: list[int], stops: int) -> list[int]:
    """How many symbols each place shares with any other; the stops, from -stops to -1, end every string and are all different."""
    text = [x + stops for x in text]
    return neighbours(text, suffix_array(text))


def _edges(members: list[tuple[bytes, int, int]], gram: int = GRAM) -> list[int]:
    """Columns, counted from the anchor, where some segment ends or two of them part."""
    out = set()
    for side in (-1, 1):
        bodies = sorted(body[place + gram :] if side > 0 else body[:place][::-1] for body, _, place in members)
        depths = {len(b) for b in bodies} | {_common(a, b) for a, b in zip(bodies, bodies[1:])}
        out |= {gram + d if side > 0 else -d for d in depths}
    return sorted(out)


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the ranges [a, b) cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: ``at`` holds a segment's first window start, its number of windows and its anchor's place, 8 bits for each of the last two.
_PACKED = "doc_id long, body_key long, anchor long, seg long, at long"


def _segments_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids, keys, cols = [], [], []
                for i, k, x in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    if len(x) < WINDOW:
                        continue
                    got = hasher.segments(x)
                    cols.append(got)
                    ids += [i] * len(got[0])
                    keys += [k] * len(got[0])
                if cols:
                    a, s, f, n, p = (np.concatenate(c) for c in zip(*cols))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(a), pa.array(s), pa.array(f << 16 | n << 8 | p)], names=["doc_id", "body_key", "anchor", "seg", "at"])

    return rows.select("doc_id", "body_key", F.encode("text", "UTF-8").alias("data")).mapInArrow(run, _PACKED)


def _decide(gram: int):
    """Groups of an anchor's kinds to (anchor, seg, a, b): the kinds' window starts that occur again."""

    def some(groups: list[list[dict]]) -> pa.RecordBatch:
        members = [(g, m) for g, group in enumerate(groups) for _, m in sorted({m["seg"]: m for m in group}.items())]  # a repeated row fetches its text twice
        ranges = repeated_windows([(g, m["body"], m["windows"], m["place"], m["several"]) for g, m in members], gram=gram)
        rows = [(m["anchor"], m["seg"], a, b) for (_, m), found in zip(members, ranges, strict=True) for a, b in found]
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["anchor", "seg", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: list[list[dict]] = []
            size = 0
            for members in batch.column(0):
                groups.append(members.as_py())
                size += len(groups[-1])
                if size >= SORTED:
                    yield some(groups)
                    groups, size = [], 0
            if groups:
                yield some(groups)

    return run


def _longer(gram: int):
    """Kinds of anchors that are to be split as segments of longer anchors, each with its place in its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(gram=gram)
        for batch in batches:
            rows = []
            for anchor, seg, several, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for a, s, first, windows, place in zip(*[x.tolist() for x in hasher.segments(body)]):
                    rows.append((anchor, seg, first, a, s, several, windows, place, body[first : first + windows + WINDOW - 1]))
            columns = list(zip(*rows)) if rows else [()] * 9
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["its_anchor", "its_seg", "offset", "anchor", "seg", "several", "windows", "place", "body"])

    return run


def decisions(kinds: DataFrame, level: int = 0) -> DataFrame:
    """(anchor, seg, a, b): ranges of window starts that occur again, of kinds (anchor, seg, several, windows, place, body)."""
    gram = GRAMS[level]
    member = F.struct("anchor", "seg", "several", "windows", "place", "body")
    groups = lambda some: some.groupBy("anchor").agg(F.collect_list(member).alias("members")).select("members").mapInArrow(_decide(gram), "anchor long, seg long, a int, b int")
    if level + 1 == len(GRAMS):  # the anchor is the whole window, so it has one kind
        return groups(kinds)
    hot = cut(kinds.groupBy(F.col("anchor").alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).select("hot"))
    count = hot.count()
    if not count:
        return groups(kinds)
    hot = F.broadcast(hot) if count <= BROADCAST_ROWS else hot  # then a hot anchor's rows need not meet to be picked out
    few = groups(kinds.join(hot, F.col("anchor") == F.col("hot"), "left_anti"))
    split = kinds.join(hot, F.col("anchor") == F.col("hot")).select("anchor", "seg", "several", "body").dropDuplicates(["anchor", "seg"])
    split = cut(split.mapInArrow(_longer(GRAMS[level + 1]), "its_anchor long, its_seg long, offset int, anchor long, seg long, several boolean, windows int, place int, body binary"))
    again = split.groupBy("anchor", "seg").agg(((F.count(F.lit(1)) > 1) | F.max("several")).alias("several"), F.min(F.struct("windows", "place", "body")).alias("one")).select("anchor", "seg", "several", "one.*")
    found = cut(decisions(cut(again), level + 1)).select(F.col("anchor").alias("ka"), F.col("seg").alias("ks"), "a", "b")
    back = split.select("its_anchor", "its_seg", "offset", "anchor", "seg").join(found, (F.col("anchor") == F.col("ka")) & (F.col("seg") == F.col("ks")))
    return few.unionByName(back.select(F.col("its_anchor").alias("anchor"), F.col("its_seg").alias("seg"), (F.col("offset") + F.col("a")).alias("a"), (F.col("offset") + F.col("b")).alias("b")))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Documents of an id and a text that occur several times, once; the texts of others do not move."""
    many = cut(rows.groupBy(F.col("doc_id").alias("many_id"), F.col("body_key").alias("many_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("many_id", "many_key"))
    count = many.count()
    if not count:
        return rows
    many = F.broadcast(many) if count <= BROADCAST_ROWS else many
    same = F.col("doc_id").eqNullSafe(F.col("many_id")) & (F.col("body_key") == F.col("many_key"))
    once = rows.join(many, same, "left_semi").groupBy("doc_id", "body_key").agg(F.max("text").alias("text"))
    return rows.join(many, same, "left_anti").unionByName(once.select(rows.columns))


def covered(rows: DataFrame) -> DataFrame:
    """(doc_id, body_key, a, b): byte ranges that repeat, of documents with ``doc_id``, ``text`` and its hash ``body_key``."""
    segs = _segments_of(rows)
    anchors = segs.groupBy(F.col("anchor").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("s1"), F.max("seg").alias("s2"))
    # cut here: both sides of the join are then plain exchanges, so the rows of a hot anchor can be split
    anchors = cut(anchors.where("n > 1").select("key", (F.col("s1") != F.col("s2")).alias("differ")))
    found = segs.join(anchors, F.col("anchor") == F.col("key")).drop("key")
    found = cut(found.withColumns({"first": F.shiftright("at", 16).cast("int"), "windows": F.shiftright("at", 8).bitwiseAND(255).cast("int"), "place": F.col("at").bitwiseAND(255).cast("int")}).drop("at"))
    end = lambda last: (last + WINDOW - 1).cast("int").alias("b")
    alike = found.where("not differ").select("doc_id", "body_key", F.col("first").alias("a"), end(F.col("first") + F.col("windows")))
    apart = found.where("differ")
    kinds = apart.groupBy("anchor", "seg").agg((F.count(F.lit(1)) > 1).alias("several"), F.min(F.struct("doc_id", "body_key", "first", "windows", "place")).alias("one"))
    asked = kinds.select("anchor", "seg", "several", "one.*").groupBy(F.col("doc_id").alias("its_id"), F.col("body_key").alias("its_key")).agg(F.collect_list(F.struct("anchor", "seg", "several", "first", "windows", "place")).alias("asked"))
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("body_key") == F.col("its_key"))
    fetched = _one_of_each(rows).join(asked, same).select(F.encode("text", "UTF-8").alias("data"), F.explode("asked").alias("q"))
    fetched = fetched.select("q.*", F.expr(f"substring(data, q.first + 1, q.windows + {WINDOW - 1})").alias("body")).drop("first")
    found_again = decisions(cut(fetched)).select(F.col("anchor").alias("ka"), F.col("seg").alias("ks"), "a", "b")
    sorted_out = apart.join(found_again, (F.col("anchor") == F.col("ka")) & (F.col("seg") == F.col("ks"))).select("doc_id", "body_key", (F.col("first") + F.col("a")).alias("a"), end(F.col("first") + F.col("b")))
    return alike.unionByName(sorted_out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    Null texts are empty; texts of under WINDOW bytes lose nothing.  Repeated
    rows count as further occurrences of each other, null ids are kept apart
    by their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("body_key", F.xxhash64("text"))
    ranges = covered(rows).select(F.col("doc_id").alias("its_id"), F.col("body_key").alias("its_key"), F.shiftleft(F.col("a").cast("long"), 16).bitwiseOR(F.col("b") - F.col("a")).alias("r"))
    lists = ranges.groupBy("its_id", "its_key").agg(F.collect_set("r").alias("ranges"))  # a range is no longer than a segment
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("body_key") == F.col("its_key"))
    joined = rows.join(lists, same, "left").select("doc_id", F.encode("text", "UTF-8").alias("data"), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for i, data, ranges in zip(*batch.columns, strict=True):
                data = data.as_py()
                spans = merged([(r >> 16, (r >> 16) + (r & 0xFFFF)) for r in ranges.as_py()]) if ranges.is_valid else []
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((i.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
