"""Whitening of embeddings from an exact integer scatter.

Components become integers.  Tasks subtract a shift, so that numbers are small,
and add sums and cross-products of any size: by float or 64-bit products where a
bound proves them exact, else in Python's integers.  A task's totals are cut in
digits of DIGIT bits, which Spark adds up natively, one row for a pair of
dimensions and a digit.  The driver puts the digits together (their number
depends on the dimensions alone), forms n X'X - S S' exactly, and only then goes
over to floats: every entry is divided by n squared with one rounding, and eigh
decomposes the matrix.  Cancellation of a large common offset costs nothing so.

Rows of different lengths have no common covariance: each length is a fit list
of its own, with its own n, components and error.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Bits of a digit; sums of digits of two billion tasks fit in a long.
DIGIT = 31
#: Values of a batch that are multiplied at once.
VALUES = 1 << 19


@dataclass
class Whitening:
    """What is fitted for vectors of one length: exact sums, the first eigenvectors as columns, eigenvalues (in squares of ``unit``) and their shares, largest first.

    ``rank`` is the number of components that have variance: eigenvalues above the rounding of the decomposition.
    """

    n: int
    sums: list[int]
    unit: int
    vectors: np.ndarray
    values: np.ndarray
    shares: list[float | None]
    rank: int


def usable(vector: str = "embedding"):
    """Whether a row takes part: a vector without nulls and non-finite entries."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers, or Python's where those are too small."""
    down = np.floor(values * scale)  # a power of two: exact, unless it overflows
    if np.isfinite(down).all():
        if np.abs(down).max(initial=0) < 2**62:
            return down.astype(np.int64)
        return np.array([int(x) for x in down.ravel()], object).reshape(values.shape)
    return np.array([int(x) * scale if x == int(x) else int(np.floor(x * scale)) for x in map(float, values.ravel())], object).reshape(values.shape)


def cross(x: np.ndarray) -> np.ndarray:
    """The exact X'X of integers."""
    if x.dtype != object:
        most = int(np.abs(x).max(initial=0)) ** 2 * len(x)
        if most < 2**53:
            y = x.astype(np.float64)
            return (y.T @ y).astype(np.int64)
        if most < 2**63:
            return x.T @ x
        x = x.astype(object)
    return x.T @ x


def _blocks(batches):
    """(rows' ids, matrix) of vectors of one length each, of bounded size."""
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(sizes)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            step = max(1, VALUES // max(1, int(size)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                yield batch.column(0).take(pa.array(some)), flat[(ends[some] - size)[:, None] + np.arange(size)]


def _digits(value: int):
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << DIGIT) - 1))
        value >>= DIGIT
        k += 1


def scatter(rows: DataFrame, vector: str, shift: int = OFFSET) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By length: n, the exact sums and cross-products of x - shift, x being floor(64 c) + OFFSET."""

    def run(batches):
        counts, sums, products = defaultdict(int), {}, {}
        for _, values in _blocks(batches):
            size = values.shape[1]
            x = whole(values)
            x = x + (OFFSET - shift) if x.dtype == object or abs(OFFSET - shift) < 2**62 else x.astype(object) + (OFFSET - shift)
            counts[size] += len(x)
            sums[size] = sums.get(size, 0) + _wide(x)
            products[size] = products.get(size, 0) + cross(x).astype(object)
        out = []
        for size, n in counts.items():
            out.append((size, -2, -2, 0, n))
            out += [(size, -1, j, k, v) for j in range(size) for k, v in _digits(int(sums[size][j]))]
            out += [(size, i, j, k, v) for i in range(size) for j in range(i, size) for k, v in _digits(int(products[size][i, j]))]
        names = ["size", "i", "j", "k", "v"]
        for at in range(0, len(out), 100_000):
            columns = list(zip(*out[at : at + 100_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], names=names)

    parts = rows.select(F.lit(0).alias("id"), vector).mapInArrow(run, "size int, i int, j int, k int, v long")
    found: dict = {}
    for r in parts.groupBy("size", "i", "j", "k").agg(F.sum("v").alias("v")).collect():
        n, sums, products = found.setdefault(r["size"], ([0], [0] * r["size"], [[0] * r["size"] for _ in range(r["size"])]))
        value = r["v"] << (DIGIT * r["k"])
        if r["i"] == -2:
            n[0] += value
        elif r["i"] == -1:
            sums[r["j"]] += value
        else:
            products[r["i"]][r["j"]] += value
            if r["i"] != r["j"]:
                products[r["j"]][r["i"]] += value
    return {size: (n[0], sums, products) for size, (n, sums, products) in found.items()}


def _wide(x: np.ndarray) -> np.ndarray:
    """Exact column sums."""
    if x.dtype != object and int(np.abs(x).max(initial=0)) * len(x) < 2**63:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def decompose(n: int, sums: list[int], products: list[list[int]], shift: int = OFFSET, count: int = COMPONENTS) -> Whitening:
    """n X'X - S S' is formed exactly and then divided by n squared, with one rounding for an entry.

    A power of two as unit keeps all floats near one, whatever the entries' size.
    """
    size = len(sums)
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    unit = 1 << (max(exact[i][i] for i in range(size)) // (n * n)).bit_length() // 2
    below = n * n * unit * unit
    values, vectors = np.linalg.eigh(np.array([[x / below for x in row] for row in exact]))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = sum(exact[i][i] for i in range(size)) / below
    shares = [float(e) / trace if trace > 0 else None for e in np.maximum(values, 0)]
    rank = int((values > 8 * size * np.finfo(float).eps * max(values[0], 0)).sum())
    return Whitening(n, [s + n * shift for s in sums], unit, vectors[:, :count].copy(), values[:count].copy(), shares[:count], rank)


def fit(rows: DataFrame, vector: str, count: int = COMPONENTS) -> dict[int, Whitening]:
    """A Whitening for each length of vectors."""
    return {size: decompose(*got, count=count) for size, got in scatter(rows, vector).items()}


def centred(values: np.ndarray, model: Whitening) -> np.ndarray:
    """n x - S, exact integers."""
    x = whole(values)
    off = [OFFSET * model.n - s for s in model.sums]
    most = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, off), default=0)
    if x.dtype != object and most < 2**62:
        return x * model.n + np.array(off, np.int64)
    return x.astype(object) * model.n + np.array(off, object)


def whitened(exact: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows n x - S projected on the components, over the roots of their eigenvalues; NaN where a component has no variance."""
    if exact.dtype != object and model.n < 2**53 and np.abs(exact).max(initial=0) < 2**53:
        x = exact / float(model.n) / float(model.unit)
    else:
        x = np.array([int(a) / (model.n * model.unit) for a in exact.ravel()], float).reshape(exact.shape)
    out = np.full((len(x), len(model.values)), np.nan)
    r = min(model.rank, out.shape[1])
    out[:, :r] = x @ (model.vectors[:, :r] / np.sqrt(model.values[:r]))
    return out


def identity_errors(rows: DataFrame, vector: str, models: dict[int, Whitening]) -> dict[int, float | None]:
    """By length: the largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves.

    First their means, then the products of what is left without them; only components with variance.
    """

    def added(means):
        def run(batches):
            totals: dict = {}
            for _, values in _blocks(batches):
                size = values.shape[1]
                w = whitened(centred(values, models[size]), models[size])[:, : models[size].rank]
                if means is not None:
                    w = w - means[size]
                totals[size] = totals.get(size, 0) + (w.sum(axis=0)[None, :] if means is None else w.T @ w)
            for size, t in totals.items():
                i, j = np.indices(t.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, size), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(t.ravel())], names=["size", "i", "j", "v"])

        parts = rows.select(F.lit(0).alias("id"), vector).mapInArrow(run, "size int, i int, j int, v double")
        found: dict = defaultdict(dict)
        for r in parts.groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect():
            found[r["size"]][r["i"], r["j"]] = r["v"] / models[r["size"]].n
        return found

    first = added(None)
    means = {size: np.array([first[size][0, j] for j in range(len(first[size]))]) for size in models}
    second = added(means)
    return {size: max((abs(v - (i == j)) for (i, j), v in second[size].items()), default=None) for size in models}


def whiten(table_: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error and deviation_text for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are left out;
    null keys and repeated rows take part like others; empty vectors give no
    rows.  A component without variance (also: of a single row) has a null
    whitened; explained is null if nothing varies, and identity_error if there
    is no component with variance.  A deviation that a long cannot hold is null
    there; deviation_text has it at any size.  Other columns play no part.
    """
    rows = table_.where(usable(vector)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("size(vector) > 0")
    models = fit(rows, "vector", count)
    errors = identity_errors(rows, "vector", models)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"]

    def run(batches):
        for ids, values in _blocks(batches):
            model = models[values.shape[1]]
            exact = centred(values, model)
            wide = exact.dtype == object or int(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] >= 2**63
            deviation = [sum(int(a) ** 2 for a in row) for row in exact] if wide else (exact * exact).sum(axis=1).tolist()
            w = whitened(exact, model)
            m = w.shape[1]
            each = np.repeat(np.arange(len(w)), m)
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(w))), pa.array(np.full(len(flat), model.n)),
                    pa.array([d if d < 2**63 else None for d in deviation], pa.int64()).take(pa.array(each)), pa.array(flat, mask=np.isnan(flat)),
                    pa.array(model.shares * len(w), pa.float64()), pa.array([errors[values.shape[1]]] * len(flat), pa.float64()), pa.array(list(map(str, deviation))).take(pa.array(each)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
