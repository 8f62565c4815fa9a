"""Token-ID output: texts become token ids, and ids become rows of a fixed width.

Documents are cut without loss into pieces of at most the row's width.  The
pieces are dealt to shards by a hash of their document, each shard is packed
best-fit-decreasing with a segment tree over the rows' free space, and each row
carries its id matrix line, the cumulative segment lengths and the positions,
which start again at zero with each segment.  A piece is known by its document's
id, the digest of the whole text and its number, so texts that share an id, or
have none, come back apart.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, table, texts

WIDTH = 2048
#: Characters that one shard should hold; the number of shards grows with the input, a shard does not.
SHARD_CHARS = 4_000_000
#: Copies of one row that are dealt out together.
COPIES = 256
#: Repeated rows up to which their keys are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of ids in one batch that leaves a task.
BATCH_BYTES = 8_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: End of document; also the filler of a row's tail, where the segment lengths end before the width.
END = 50256


# Fixed value: what the pattern takes for white space; Python's own \s also has U+001C to U+001F.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RUN, LAST = re.compile(f"{SPACE}{SPACE}+"), re.compile(f"{SPACE}(?!{SPACE})")
#: Characters of a text whose ids are Python's integers at one time, where it has white space to be cut at.
LONG = 1_000_000


def load(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a vocabulary file, read on the driver; what is sent to executors is bounded by the file's size."""
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Byte-level BPE of texts that are cut where the pattern cuts them anyhow.

    The pattern's look-ahead leaves the last blank of a run to what follows, so
    cut before it a text needs no look-ahead, which takes time with every word
    and fails on runs of about a million blanks.  Words are not remembered:
    where most of them are rare, that takes twice the time.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.whole = tiktoken.Encoding("own", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Ids as little-endian 16-bit numbers."""
        cuts = [m.end() - 1 for m in RUN.finditer(text) if m.end() < len(text)]
        if len(text) > LONG:
            cuts = sorted({*cuts, *_long(text)})
        if not cuts:
            return self._encode(text)
        return b"".join(self._encode(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True))

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode_ordinary(text), "<u2").tobytes()

    def text(self, ids: list[int]) -> str:
        return self.whole.decode_bytes([i for i in ids if i != END]).decode("utf-8")


def _long(text: str) -> Iterator[int]:
    """A place before the last blank of a run, every LONG characters or later."""
    at = LONG
    while (m := LAST.search(text, at)) and m.end() < len(text):
        yield m.start()
        at = m.start() + LONG


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows as lists of piece numbers: longest piece first, each into the fullest row that still holds it.

    The tree's leaves are the amounts of free space; a node tells how many open
    rows its leaves have, so the smallest sufficient space is found, and moved,
    in log(width) steps.
    """
    size = 1 << width.bit_length()
    count = [0] * (2 * size)
    open_rows: list[list[int]] = [[] for _ in range(size)]
    rows: list[list[int]] = []

    def add(space: int, row: int, by: int) -> None:
        if by > 0:
            open_rows[space].append(row)
        at = size + space
        while at:
            count[at] += by
            at >>= 1

    def least(space: int) -> int | None:
        """The smallest free space of at least ``space`` that some open row has."""
        at = size + space
        if count[at]:
            return space
        while at > 1:
            if at % 2 == 0 and count[at + 1]:
                at += 1
                while at < size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - size
            at >>= 1
        return None

    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        space = least(need)
        if space is None:
            rows.append([])
            row, space = len(rows) - 1, width
        else:
            row = open_rows[space].pop()
            add(space, row, -1)
        rows[row].append(piece)
        if space > need:
            add(space - need, row, 1)
    return rows


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text, first, until): the documents, a repeated row standing for its copies number ``first`` to below ``until``.

    Rows of an id and a text that occur once pass as they are.  Of the others
    only counts and one text meet, combined before the shuffle; their copies
    are dealt out again COPIES at a time, so that no task has all copies of a
    row.
    """
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    many = cut(rows.groupBy(F.col("doc_id").alias("its"), F.col("hash").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    digest = F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest")
    once = [F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("until")]
    count = many.count()
    if not count:
        return rows.select("doc_id", digest, "text", *once)
    keys = F.broadcast(many) if count <= BROADCAST_ROWS else many
    same = F.col("doc_id").eqNullSafe(F.col("its")) & (F.col("hash") == F.col("key"))
    single = rows.join(keys, same, "left_anti").select("doc_id", digest, "text", *once)
    repeated = rows.join(keys, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    parts = repeated.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("doc_id", "text", "first")
    return single.unionByName(parts.select("doc_id", digest, "text", "first", F.least(F.col("first") + COPIES, "n").alias("until")))


def pieces(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, digest, piece, copy, ids): the ids of every document and an end mark, cut in pieces of at most ``width``.

    A null or empty text is the end mark alone, so no document is lost; copies
    of a row are told apart by their number.
    """
    ranks = load(vocabulary)
    names = ["doc_id", "digest", "piece", "copy", "ids"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks)
        mark = np.array([END], "<u2").tobytes()
        for batch in batches:
            out, size = [], 0
            for i, k, x, first, until in zip(*batch.columns, strict=True):
                i, k, first, until = i.as_py(), k.as_py(), first.as_py(), until.as_py()
                whole = encoder.ids(x.as_py()) + mark
                for n, start in enumerate(range(0, len(whole), 2 * width)):
                    part = whole[start : start + 2 * width]
                    for copy in range(first, until):
                        out.append((i, k, n, copy, part))
                        size += len(part)
                        if size >= BATCH_BYTES:
                            yield _rows(out, types, names)
                            out, size = [], 0
            if out:
                yield _rows(out, types, names)

    return counted(docs).mapInArrow(encoded, "doc_id long, digest binary, piece int, copy long, ids binary")


def _rows(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


def pack(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Packed rows: shard, row, input_ids, cu_seqlens, position_ids, doc_ids, digests, piece_numbers.

    ``input_ids`` and ``position_ids`` are lines of 16-bit little-endian
    matrices, ``width`` numbers each (``decode_line`` reads them); cu_seqlens
    starts with 0 and ends where the filler begins.  Equal lengths keep the
    order of (doc_id, digest, piece), so equal inputs give equal rows; repeated
    rows are packed as often as they occur, and texts of one id or of null ids
    are told apart by their digests.
    """
    total = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    shards = max(1, -(-total // shard_chars))
    dealt = pieces(docs, width, vocabulary).withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", "piece", "copy"), F.lit(shards)).cast("long"))
    return _packed(dealt, width)


def _packed(dealt: DataFrame, width: int) -> DataFrame:
    return dealt.groupBy("shard").applyInArrow(_packer(width), "shard long, row long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, digests array<binary>, piece_numbers array<int>")


def _packer(width: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        items = sorted(zip(*[group.column(c).to_pylist() for c in ("doc_id", "digest", "piece", "ids")], strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
        lengths = np.array([len(x[3]) // 2 for x in items], np.int64)
        rows = best_fit_decreasing(lengths, width)
        filler = np.full(width, END, "<u2").tobytes()
        ids, sums, positions, owners, keys, numbers = [], [], [], [], [], []
        for row in rows:
            own = lengths[row]
            line = b"".join(items[k][3] for k in row)
            ids.append(line + filler[len(line) :])
            edges = np.concatenate(([0], np.cumsum(own)))
            sums.append(edges.tolist())
            place = np.zeros(width, np.int64)
            place[: edges[-1]] = np.arange(edges[-1]) - np.repeat(edges[:-1], own)
            positions.append(place.astype("<u2").tobytes())
            owners.append([items[k][0] for k in row])
            keys.append([items[k][1] for k in row])
            numbers.append([items[k][2] for k in row])
        columns = [
            pa.array([shard] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(ids, pa.binary()), pa.array(sums, pa.list_(pa.int32())),
            pa.array(positions, pa.binary()), pa.array(owners, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.int32())),
        ]
        return pa.Table.from_arrays(columns, names=["shard", "row", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "digests", "piece_numbers"])

    return run


def decode_line(line: bytes) -> np.ndarray:
    return np.frombuffer(line, "<u2")


def unpack(rows: list, vocabulary: str = VOCABULARY) -> Counter:
    """(doc_id, text) of every document, counted, from collected packed rows; the round trip of ``pack`` for tests and spot checks."""
    encoder = Encoder(load(vocabulary))
    found: dict[tuple[int | None, bytes], dict[int, list[int]]] = {}
    copies: Counter = Counter()
    for r in rows:
        line = decode_line(r["input_ids"]).tolist()
        for k, (i, d, n) in enumerate(zip(r["doc_ids"], r["digests"], r["piece_numbers"], strict=True)):
            found.setdefault((i, bytes(d)), {})[n] = line[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
            copies[i, bytes(d)] += n == 0
    return Counter({(key[0], encoder.text([x for n in sorted(p) for x in p[n]])): copies[key] for key, p in found.items()})


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
