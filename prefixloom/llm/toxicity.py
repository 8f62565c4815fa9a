"""Toxicity: a linear classifier with a counterfactual penalty.

Every labelled sentence that names a group is copied with the group's term
swapped for others, and every labelled sentence is copied with each term put in
and then swapped for each other one of its row and for none.  The fit penalises
the squared change of the score, so that a neutral mention of a group says
nothing about toxicity, also in a corpus that names no group: the words'
beginnings get weights all the same.  Features are words and their beginnings,
because inflected languages share the beginning only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import SAMPLE_ROWS, cut, map_arrow, table, texts
from prefixloom.llm.quality import labelled_sample

# Terms for groups in English, German, Spanish and French; each row lists terms that may stand for one another. A term may be in several rows.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"), ("deaf", "blind", "disabled"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("schwarze", "weiße", "asiaten", "latinos", "araber"),
    ("schwul", "lesbisch", "hetero", "bisexuell", "transgeschlechtlich"), ("schwule", "lesben", "heteros", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "einheimische"), ("gehörlose", "blinde", "behinderte"), ("alte", "junge"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "nativos"), ("sordos", "ciegos", "discapacitados"), ("viejos", "jóvenes"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "autochtones"), ("sourds", "aveugles", "handicapés"), ("vieux", "jeunes"),
)
SWAPS = {w: sorted({o for row in IDENTITY if w in row for o in row} - {w}) for w in {x for row in IDENTITY for x in row}}
#: What is put into a sentence and swapped: the terms of a row by twos, and each term for none.
INSERTED = [*sorted({tuple(sorted((a, b))) for row in IDENTITY for a in row for b in row if a != b}), *((a, "") for a in sorted(SWAPS))]
STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_~`«»¿¡"
BEGINNINGS = (3, 4, 5)
SENTENCE = re.compile(r"[^.!?\n]+")
THRESHOLD = 0.3
#: Features that the classifier may have; a bound of the model like SAMPLE_ROWS, the same at every size.
ROOM = 4000
#: Weight of the penalty against the mean loss.
PULL = 10.0


def held_out(column):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(column.cast("string").cast("binary")) % 4 == 2


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings if it is longer than they are."""
    w = word.strip(STRIP)
    if not w:
        return []
    return [w, *(f"{w[:k]}~" for k in BEGINNINGS if len(w) > k)]


def bag(text: str) -> dict[str, int]:
    """How many different words of the text have each feature."""
    out: dict[str, int] = {}
    for w in {x.strip(STRIP) for x in text.lower().split()}:
        for f in features(w):
            out[f] = out.get(f, 0) + 1
    return out


def counterfactuals(text: str) -> list[tuple[dict[str, int], int]]:
    """What swapping a group's term for another one takes from and adds to a sentence's bag, and how often.

    Every mention in every sentence counts.  A bag has different words, so the
    mentions of a term in a sentence change it alike, and so do sentences that
    have the two terms in the same way: a long text has few different changes.
    """
    times: dict[tuple[str, str, bool, bool], int] = {}
    for sentence in SENTENCE.findall(text.lower()):
        words: dict[str, int] = {}
        for x in sentence.split():
            w = x.strip(STRIP)
            words[w] = words.get(w, 0) + 1
        for w in words.keys() & SWAPS.keys():
            for other in SWAPS[w]:
                key = w, other, words[w] == 1, other not in words
                times[key] = times.get(key, 0) + words[w]
    out = []
    for (w, other, goes, comes), n in sorted(times.items()):
        change: dict[str, int] = {}
        for word, by, counts in ((w, 1, goes), (other, -1, comes)):
            for f in features(word) if counts else ():
                change[f] = change.get(f, 0) + by
        out.append((change, n))
    return out


def insertions(text: str) -> dict[int, float]:
    """For each pair of INSERTED the share of the text's sentences that it cannot be put into, as they have one of its terms already; pairs without such sentences are left out."""
    sentences = [{x.strip(STRIP) for x in s.split()} for s in SENTENCE.findall(text.lower()) if s.strip()]
    named = [s & SWAPS.keys() for s in sentences]
    if not any(named):
        return {}
    lost = {k: sum(a in s or b in s for s in named) / len(sentences) for k, (a, b) in enumerate(INSERTED)}
    return {k: v for k, v in lost.items() if v}


def inserted_change(pair: tuple[str, str]) -> dict[str, int]:
    """What a bag loses when the first term of a pair, put into a sentence, is swapped for the second."""
    change: dict[str, int] = {}
    for word, by in zip(pair, (1, -1)):
        for f in features(word):
            change[f] = change.get(f, 0) + by
    return change


@dataclass
class Model:
    """Weights by feature; ``bias`` alone scores a text without known features."""

    bias: float = -3.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))

    def scorer(self, room: int = 400_000):
        """Scores texts, remembering at most ``room`` words."""
        known: dict[str, float] = {}

        def score(text: str | None) -> float:
            if len(known) > room:
                known.clear()
            z = self.bias
            for w in {x.strip(STRIP) for x in set((text or "").lower().split())}:
                v = known.get(w)
                if v is None:
                    v = known[w] = self.word(w)
                z += v
            return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

        return score


def choose(counts: list[tuple[str, float, float]], base: float, room: int = ROOM) -> list[str]:
    """The ``room`` most telling features of (feature, texts, toxic texts) rows, by the z-score of their toxic share; ties by name. Group terms always count."""
    z = {f: (np.inf if f.split("~")[0] in SWAPS else abs(k - base * n) / np.sqrt(n * base * (1 - base))) for f, n, k in counts}
    return sorted(sorted(z, key=lambda f: (-z[f], f))[:room])


def vector(b: dict[str, int], column: dict[str, int]) -> tuple[list[int], list[float]]:
    """A bag, or a change of one, over the chosen columns."""
    picked = sorted((column[f], float(n)) for f, n in b.items() if n and f in column)
    return [c for c, _ in picked], [n for _, n in picked]


def pair_vectors(text: str, column: dict[str, int]) -> list[tuple[list[int], list[float], float]]:
    """The changes that swapping group terms makes, each with its share of the text's swaps."""
    changes = counterfactuals(text)
    swaps = sum(n for _, n in changes)
    return [(*vector(c, column), n / swaps) for c, n in changes]


def train(rows: list[tuple[list[int], list[float]]], y: np.ndarray, pairs: list[tuple[list[int], list[float], float]], names: list[str], pull: float = PULL, ridge: float = 2e-4, rounds: int = 400) -> Model:
    """Logistic regression with weight ``pull`` on the mean squared change of the score over the pairs, each of its own weight."""
    base = y.mean()
    at, cols, vals = _sparse(rows)
    p_at, p_cols, p_vals = _sparse(pairs)
    shares = np.array([p[2] for p in pairs])
    weight = np.where(y == 1, 0.5 / base, 0.5 / (1 - base)) * 0.5 + 0.5
    w, bias = np.zeros(len(names)), float(np.log(base / (1 - base)))
    m, v, m0, v0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        score = bias + np.bincount(at, vals * w[cols], len(y))
        err = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) * weight / len(y)
        g = np.bincount(cols, vals * err[at], len(w)) + ridge * w
        if pairs:
            change = np.bincount(p_at, p_vals * w[p_cols], len(pairs))
            g += pull * np.bincount(p_cols, p_vals * (shares * change)[p_at], len(w)) / shares.sum()
        g0 = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        m0, v0 = 0.9 * m0 + 0.1 * g0, 0.99 * v0 + 0.01 * g0 * g0
        step = 0.05 / (1 + k / 200)
        w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        bias -= step * (m0 / (1 - 0.9**k)) / (np.sqrt(v0 / (1 - 0.99**k)) + 1e-6)
    return Model(float(bias), {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3})


def _sparse(rows: list[tuple]):
    sizes = [len(r[0]) for r in rows]
    flat = lambda k, kind: np.fromiter((x for r in rows for x in r[k]), kind, sum(sizes))
    return np.repeat(np.arange(len(rows)), sizes), flat(0, np.int64), flat(1, float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, pull: float = PULL, room: int = ROOM) -> Model:
    """Fitted on at most ``rows`` labelled documents that are not held out, with at most ``room`` features.

    Bags are made and counted on the executors; the driver gets the chosen
    features and the sample's vectors over them.  Identical texts count once,
    so a group of copies teaches no more than one text; where labels of one id
    or one text conflict, the label 1 counts.  Without two classes the model is
    its bias.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, ~held_out(F.col("doc_id"))).groupBy("text").agg(F.max("y").alias("y"))
    sample = cut(sample)
    n, base = sample.agg(F.count(F.lit(1)), F.avg("y")).first()
    if n < 10 or not 0 < base < 1:
        share = base if n else 0.05
        return Model(bias=float(np.log((share + 0.01) / (1.01 - share))))

    def spell(columns):
        out = [(f, v) for x, v in zip(*columns, strict=True) for f in bag(x)]
        return [list(c) for c in zip(*out)] if out else [[], []]

    counts = map_arrow(sample.select("text", "y"), "feature: string, y: double", spell).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).where(F.col("n") >= 4)
    z = F.abs(F.col("k") - base * F.col("n")) / F.sqrt(F.col("n") * base * (1 - base))
    named = counts.where(F.split_part("feature", F.lit("~"), F.lit(1)).isin(list(SWAPS)))
    best = counts.orderBy(z.desc(), "feature").limit(room).unionByName(named).distinct()
    names = choose([(r.feature, r.n, r.k) for r in best.collect()], base, room)
    column = {f: j for j, f in enumerate(names)}

    def measure(columns):
        bodies, y = columns
        own = [vector(bag(x), column) for x in bodies]
        pairs = [pair_vectors(x, column) for x in bodies]
        swapped = [[c for p in own_pairs for c in (*p[0], -1)] for own_pairs in pairs]
        changes = [[v for p in own_pairs for v in (*p[1], p[2])] for own_pairs in pairs]
        lost = [insertions(x) for x in bodies]
        return [[c for c, _ in own], [v for _, v in own], swapped, changes, [list(x) for x in lost], [list(x.values()) for x in lost], [bool(SENTENCE.search(x)) for x in bodies], y]

    got = map_arrow(
        sample.select("text", "y"), "cols: array<int>, vals: array<double>, pair_cols: array<int>, pair_vals: array<double>, lost: array<int>, lost_shares: array<double>, says: boolean, y: double", measure
    ).collect()
    got.sort(key=lambda r: (r.cols, r.vals, r.y))
    pairs: list[tuple[list[int], list[float], float]] = []
    put_in = np.full(len(INSERTED), float(sum(r.says for r in got)))
    for r in got:
        first = 0
        for k, c in enumerate(r.pair_cols):
            if c < 0:
                pairs.append((r.pair_cols[first:k], r.pair_vals[first:k], r.pair_vals[k]))
                first = k + 1
        put_in[r.lost] -= r.lost_shares
    pairs += [(*vector(inserted_change(p), column), float(n) / len(INSERTED)) for p, n in zip(INSERTED, put_in, strict=True) if n > 0]
    return train([(r.cols, r.vals) for r in got], np.array([r.y for r in got]), pairs, names, pull)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score and verdict of every document from its text alone.

    Null and empty texts get the score of the bias; repeated rows each get a
    row; a null id is never held out (its remainder is unknown).
    """
    model = fit_toxicity(docs, labels, rows)

    def judge(columns):
        ids, held, bodies = columns
        score = model.scorer()
        scores = [score(x) for x in bodies]
        return [ids, held, scores, [int(s >= threshold) for s in scores]]

    rows_in = texts(docs).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows_in, "doc_id: long, held_out: boolean, score: double, predicted: int", judge)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not call toxic, with all their columns; one pass over the texts."""
    model = fit_toxicity(docs, labels)
    names = docs.columns
    where = names.index("text")

    def keep(batches):
        import pyarrow as pa

        score = model.scorer()
        for batch in batches:
            good = [score(x.as_py()) < threshold for x in batch.column(where)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
