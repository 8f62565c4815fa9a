"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted here, in numpy, on a bounded sample of labelled rows and
flattened into node arrays, so that scoring a batch is a handful of vectorised
look-ups per tree level.  Chosen statistics carry a monotonic constraint: a
document cannot gain by having more symbols, repeated lines or repeated words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import SAMPLE_ROWS, map_arrow, table, texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: The statistics that the trees see, and the sign their effect on the score must have (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": 0, "bang_share": -1, "distinct_share": 0, "mean_line": 0, "stop_share": 0, "top_word_share": -1,
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base counts (words, word characters, symbols, repeated lines, repeated words) and the features of a text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = sum(text.count(c) for c in SYMBOLS)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    repeats = repeated_words(words)
    dup_lines = len(lines) - len(set(lines))
    upper = _upper(data)
    kinds = len(set(words))
    short = sum(map(_SHORT.__contains__, map(len, words)))
    per = 1 / max(1, n)
    features = [
        math.log1p(n), chars * per, symbols * per, dup_lines / max(1, len(lines)), repeats * per,
        upper / max(1, chars), sum(data.count(b"%d" % d) for d in range(10)) / max(1, chars), data.count(b"!") * per, kinds * per, n / max(1, len(lines)), short * per, _top(words) * per,
    ]
    return (n, chars, symbols, dup_lines, repeats), features


_SHORT = frozenset((1, 2, 3))


def _upper(data: bytes) -> int:
    codes = np.frombuffer(data, np.uint8)
    return int(((codes >= 65) & (codes <= 90)).sum())


def _top(words: list[bytes]) -> int:
    """Occurrences of the most frequent word of over three bytes."""
    counts: dict[bytes, int] = {}
    for w in words:
        if len(w) > 3:
            counts[w] = counts.get(w, 0) + 1
    return max(counts.values(), default=0)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


@dataclass
class Forest:
    """Trees as flat arrays: node k of a tree tests ``x[feature[k]] <= threshold[k]`` and goes to ``child[k]`` or the one after it; a leaf points to itself."""

    start: float
    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, child, value in zip(self.feature, self.threshold, self.child, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = x[rows, feature[at]] > threshold[at]
                at = np.where(child[at] == at, at, child[at] + right)
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 4.0) -> Forest | None:
    """Boosted trees for the logistic loss; None if there are not two classes to tell apart.

    A split on a feature with a sign is taken only if the leaf weights follow the
    sign; the middle of the two weights then bounds both subtrees, so the
    constraint holds for whole trees and for their sum.
    """
    if len(y) < 20 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    nodes = 2 ** (depth + 1) - 1
    out = Forest(start, np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), np.tile(np.arange(nodes), (trees, 1)), np.zeros((trees, nodes)), depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        used = 1
        level = [(0, np.arange(len(y)), -np.inf, np.inf)]
        for d in range(depth + 1):
            following = []
            for node, rows, low, high in level:
                weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
                out.value[t, node] = rate * weight
                best = _split(binned[rows], g[rows], h[rows], edges, signs, low, high, ridge, least) if d < depth else None
                if best is None:
                    margin[rows] += rate * weight
                    continue
                j, cut, left, right = best
                middle = (left + right) / 2
                out.feature[t, node], out.threshold[t, node], out.child[t, node] = j, edges[j][cut], used
                goes = binned[rows, j] <= cut
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
                following += [(used, rows[goes], *bounds[0]), (used + 1, rows[~goes], *bounds[1])]
                used += 2
            level = following
    return out


def _split(binned, g, h, edges, signs, low, high, ridge, least):
    """The best allowed split: feature, last bin to the left, and the weights of both sides."""
    total_g, total_h = g.sum(), h.sum()
    best, found = 1e-3, None
    for j, e in enumerate(edges):
        if not len(e):
            continue
        lg = np.cumsum(np.bincount(binned[:, j], g, len(e) + 1))[:-1]
        lh = np.cumsum(np.bincount(binned[:, j], h, len(e) + 1))[:-1]
        rg, rh = total_g - lg, total_h - lh
        lw, rw = np.clip(-lg / (lh + ridge), low, high), np.clip(-rg / (rh + ridge), low, high)
        gain = -(lg * lw + (lh + ridge) * lw**2 / 2) - (rg * rw + (rh + ridge) * rw**2 / 2)
        whole = np.clip(-total_g / (total_h + ridge), low, high)
        gain += total_g * whole + (total_h + ridge) * whole**2 / 2
        allowed = (lh >= least) & (rh >= least) & (signs[j] * (rw - lw) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k, float(lw[k]), float(rw[k]))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, where=None) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, the lowest by a hash of the id.

    The ids are bounded by ``rows``, so they may be broadcast.
    """
    ids = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts(docs).join(F.broadcast(ids), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest | None:
    """The trees fitted on at most ``rows`` labelled documents; their statistics are taken on the executors."""

    def measure(columns):
        _, bodies, y = columns
        return [[statistics(x)[1] for x in bodies], y]

    got = map_arrow(labelled_sample(docs, labels, "quality", rows), "x: array<double>, y: double", measure).toPandas()
    if not len(got):
        return None
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order], list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts, rule verdict, tree score and final verdict of every document.

    Null and empty texts have no words and fail the base rules; repeated rows
    and null ids are kept, each with its own result; without two classes of
    labelled rows the base rules alone decide and the score is null.
    """
    forest = fit_quality(docs, labels, rows)

    def judge(columns):
        ids, bodies = columns
        both = [statistics(x) for x in bodies]
        base = [b for b, _ in both]
        failed = [base_failed(b[0], b[4]) for b in base]
        scores = forest.score(np.array([f for _, f in both])).tolist() if forest and both else [None] * len(ids)
        kept = [not f and (s is None or s >= threshold) for f, s in zip(failed, scores, strict=True)]
        return [ids, *(map(list, zip(*base)) if base else [[]] * 5), failed, kept, scores]

    return map_arrow(texts(docs), "doc_id: long, n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, base_failed: boolean, kept: boolean, score: double", judge)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
