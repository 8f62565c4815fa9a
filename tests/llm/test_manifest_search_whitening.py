"""Merkle manifest, exact top-k and whitening against brute force, and on odd rows."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.llm import merkle, mtree, whitening

VECTORS = "vec_id long, embedding array<float>, score double, list string"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(leaves):
        """Root, and for each leaf its (left, right) siblings by level."""
        at, level, proofs = list(range(len(leaves))), leaves, [[] for _ in leaves]
        while len(level) > 1:
            runs = [level[k : k + 8] for k in range(0, len(level), 8)]
            for i, p in enumerate(at):
                run = runs[p // 8]
                proofs[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at, level = [p // 8 for p in at], [sha(*r) for r in runs]
        return level[0], proofs

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha(*map(field, r)), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: (sorted(groups[g], key=lambda x: x[:3]), *tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in order}
    root, above = tree([built[g][1] for g in order])
    out = []
    for g, top in zip(order, above, strict=True):
        leaves, subroot, proofs = built[g]
        for (_, _, leaf, r), proof in zip(leaves, proofs, strict=True):
            proof = proof + top
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            acc = sha(*map(field, (*r[:4], text)))
            for left, right in proof:
                acc = sha(left, acc, right)
            out.append((r[0], leaf, subroot, root, sha(*[x for s in proof for x in s]), acc, acc == root))
    return out


def op12(spark, rows):
    docs = spark.createDataFrame([(r[4], r[0], r[2], 1.5, "x", r[1], r[3]) for r in rows], "text string, doc_id long, lang string, leaf double, pos string, source string, n_chars long")
    found = merkle.manifest(docs, merkle.lowered())
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings()), "folded_root", F.col("folded_root") == F.col("root")).collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_manifest_is_the_brute_force_one(spark):
    rows = [(k, f"s{k % 3}", ("en", "de", None, "é")[min(k % 7, 3)], k, f"Text {k} É" * (k % 4)) for k in range(150)]
    rows += [(None, None, None, None, None), (None, "s", "en", None, None), (5, None, "en", 0, "Same"), (5, None, "en", 0, "Same"), (5, None, "en", 0, "Other"), (-1, "", "lone", 3, ""), (-3, "", "", 3, "Big " * 30_000)]
    rows += [(9, "copy", "en", 1, "Copies of ONE row")] * 90
    got = op12(spark, rows)
    assert key(got) == key(brute_manifest(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("count", [1, 7, 8, 9, 64, 65])
def test_manifest_of_one_group_of_any_size(spark, count):
    rows = [(k, "s", "en", k, "A") for k in range(count)]
    assert key(op12(spark, rows)) == key(brute_manifest(rows))


def test_manifest_of_many_groups_and_of_nothing(spark):
    rows = [(k, "s", f"l{k % 70}", k, "A") for k in range(100)]
    assert key(op12(spark, rows)) == key(brute_manifest(rows))
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).collect() == []


def test_copies_of_a_row_are_spread_over_the_partitions(spark):
    docs = spark.range(20_000).selectExpr("1L doc_id", "'s' source", "'en' lang", "1L n_chars", "'same' text")
    leaves = merkle.numbered(docs.select("doc_id", "lang", merkle.leaf().alias("digest")), "lang", ["doc_id", "digest"])
    assert sorted(r["pos"] for r in leaves.select("pos").collect()) == list(range(20_000))
    tied = docs.selectExpr("doc_id", "lang", "monotonically_increasing_id() tie").repartitionByRange(4, "lang", "doc_id", "tie")
    assert max(tied.rdd.glom().map(len).collect()) < 8_000


def brute_top(rows, k=20, every=20):
    good = [(n, i, [math.floor(64 * float(np.float32(x))) for x in v]) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is None or i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, j, v in good if m != n and len(v) == len(q))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(others[:k])]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], VECTORS)


def op11(spark, rows, k=20):
    found = mtree.top_k(vectors(spark, rows), F.col("id") % 20 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return [tuple(r) for r in found.collect()]


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)]
    rows += [(k, [1.0, 0.5, -0.25, 0.0, 0.0, 2.0]) for k in range(300, 420)]  # ties beyond the best 21 of a vector
    rows += [(300, [1.0, 0.5, -0.25, 0.0, 0.0, 2.0])] * 3 + [(20, rows[20][1]), (20, rows[21][1])]
    rows += [(None, [3.0, 0.5, -0.25, 0.0, 0.0, 2.0]), (None, rows[40][1]), (500, None), (520, []), (540, []), (521, []), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (580, [float("nan")] * 6), (600, [float("inf")] * 6)]
    rows += [(620, [0.0] * 6), (640, [1.0, 2.0]), (660, [3.0, 2.0]), (680, [1.0, 2.0, 3.0]), (700, [-0.0] * 6), (720, [1e-9, -1e-9, 0.0, 0.0, 0.0, 0.0])]
    return rows


def test_top_k_is_the_brute_force_one(spark):
    rows = odd_vectors()
    assert key(op11(spark, rows)) == key(brute_top(rows))
    assert key(op11(spark, rows, 3)) == key(brute_top(rows, 3))


def test_top_k_over_many_trees_blocks_and_directory_pages(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 8))
    rows = [(k, (centres[k % 8] * (k % 3) + rng.normal(size=8) * 0.1).tolist()) for k in range(900)]
    for name, value in (("TREE_VALUES", 400), ("BLOCK_VALUES", 32), ("MOST_PIVOTS", 5), ("BALLS", 3), ("BLOCKS", 2), ("PAGE", 8), ("FAN", 3)):
        monkeypatch.setattr(mtree, name, value)
    assert key(op11(spark, rows)) == key(brute_top(rows))


def test_top_k_of_huge_components_and_of_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=3) * 1e6).tolist()) for k in range(60)] + [(80, [1e7, -1e7, 3e6]), (81, [-1e7, -1e7, -3e6])]
    assert key(op11(spark, rows)) == key(brute_top(rows))
    assert op11(spark, []) == []
    assert op11(spark, [(0, [1.0])]) == []


def test_trees_leave_out_what_bounds_rule_out():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    values = np.unique(np.floor(64 * (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.03)), axis=0)
    rng.shuffle(values)
    tree = mtree.Tree.unpacked(mtree.grow(values, [[k] for k in range(len(values))]).packed())
    queries = values[:64]
    search = mtree.Search(queries, np.full(64, -np.inf), 21)
    who, scores, ids, same = mtree.hits(search, tree)
    for q in range(64):
        want = sorted((-int(s), k) for k, s in enumerate(values @ queries[q]))[:21]
        assert [(-s, i) for w, s, i in zip(who, scores, ids, strict=True) if w == q] == want
    assert search.computed < 0.5 * 64 * len(values)
    # every child lies in its ball, every stored distance is the one to the page's routing object
    extra = lambda v: np.sqrt(np.maximum(tree.largest - (v * v).sum(axis=-1), 0))
    full = np.column_stack([tree.vectors, extra(tree.vectors.astype(float))])
    for e in np.flatnonzero(tree.child >= 0):
        at = slice(tree.start[tree.child[e]], tree.start[tree.child[e] + 1])
        apart = np.linalg.norm(full[at] - full[e], axis=1)
        assert np.allclose(apart, tree.up[at], atol=1e-4)
        leaves = tree.child[at] < 0
        assert (apart[leaves] <= tree.radius[e] + 1e-4).all()


def exact_model(rows):
    """n, S and V of integer rows, in fractions."""
    n, d = len(rows), len(rows[0])
    s = [sum(r[j] for r in rows) for j in range(d)]
    v = [[Fraction(n * sum(r[i] * r[j] for r in rows) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return n, s, v


def op13(spark, rows):
    return whitening.whiten(vectors(spark, rows)).collect()


def check_whitening(rows, got):
    """One length: exact counts and deviations, unit covariance, explained shares and eigenvectors."""
    good = [(i, [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v]) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    n, s, v = exact_model([x for _, x in good])
    d = len(s)
    want = sorted((repr(i), sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for i, x in good)
    ours = sorted((repr(r["vec_id"]), int(r["deviation_text"])) for r in got if r["component"] == 1)
    assert ours == want and {r["n"] for r in got} == {n}
    assert all(r["deviation"] == (int(r["deviation_text"]) if int(r["deviation_text"]) < 2**63 else None) for r in got)
    assert len(got) == n * min(d, 32) and {r["component"] for r in got} == set(range(1, min(d, 32) + 1))
    values = np.linalg.eigvalsh(np.array([[float(x) for x in row] for row in v]))[::-1]
    for c in range(1, min(d, 32) + 1):
        (share,) = {r["explained"] for r in got if r["component"] == c}
        assert share == pytest.approx(values[c - 1] / values.sum(), rel=1e-6, abs=1e-12)
    return n, s, v


def test_whitening_is_exact_and_white(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(5, 5))
    rows = [(k, (rng.normal(size=5) @ mix * 0.3 + 7).tolist()) for k in range(400)]
    rows += [(None, [1.0] * 5), (3, rows[3][1]), (3, rows[3][1]), (401, None), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 5), (404, [float("-inf")] * 5), (405, [])]
    got = op13(spark, rows)
    n, s, v = check_whitening(rows, got)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}
    # projecting back gives the rows: whitened is a rotation of the scaled vectors
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation_text"]), {})[r["component"]] = r["whitened"]
    lam = np.linalg.eigvalsh(np.array([[float(x) for x in row] for row in v]))[::-1]
    for (i, text), w in by.items():
        length = sum(lam[c - 1] * w[c] ** 2 for c in w)
        assert length == pytest.approx(float(Fraction(int(text), n * n)), rel=1e-9)


def test_whitening_keeps_small_variance_on_a_large_offset(spark):
    rng = np.random.default_rng(9)
    rows = [(k, (rng.integers(-3, 4, size=3) / 64 + 2.0**17).tolist()) for k in range(200)]
    got = op13(spark, rows)
    check_whitening(rows, got)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_whitening_of_huge_constant_single_and_no_rows(spark):
    huge = [(k, [float(np.float32(x)) for x in np.random.default_rng(k).normal(size=3) * 1e30]) for k in range(50)]
    got = op13(spark, huge)
    check_whitening(huge, got)
    assert {r["identity_error"] < 1e-6 for r in got} == {True} and {r["deviation"] for r in got} == {None}
    flat = op13(spark, [(k, [1.0, float(k), 2.0]) for k in range(10)])
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and {r["identity_error"] < 1e-12 for r in flat} == {True}
    one = op13(spark, [(1, [1.0, 2.0])])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, c, 1, 0, None, None, None) for c in (1, 2)]
    assert op13(spark, []) == [] and op13(spark, [(1, None), (2, [])]) == []


def test_whitening_of_two_lengths_are_two_fits(spark):
    rng = np.random.default_rng(10)
    rows = [(k, rng.normal(size=2 + k % 2).tolist()) for k in range(100)]
    got = op13(spark, rows)
    for parity in (0, 1):
        check_whitening([r for r in rows if r[0] % 2 == parity], [r for r in got if r["vec_id"] % 2 == parity])


def test_scatter_does_not_depend_on_the_shift(spark):
    rng = np.random.default_rng(11)
    rows = vectors(spark, [(k, rng.normal(size=4).tolist()) for k in range(60)]).selectExpr("cast(embedding as array<double>) v")
    near = {size: whitening.decompose(*got, shift=whitening.OFFSET) for size, got in whitening.scatter(rows, "v", whitening.OFFSET).items()}
    far = {size: whitening.decompose(*got, shift=0) for size, got in whitening.scatter(rows, "v", 0).items()}
    assert near[4].sums == far[4].sums and np.array_equal(near[4].values, far[4].values)
