"""Whitening, centroid clustering and nearest neighbours against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import laesa, posting_lists, whitening
from ledgerlens.llm.laesa import cluster_vectors
from ledgerlens.llm.posting_lists import Index, nearest_neighbours
from ledgerlens.llm.whitening import whiten

from .data import clashing

VECS = "vec_id bigint, embedding array<double>, label int"


def clustered(n=400, dim=64, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    return centre[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))


def table(spark, vectors, extra=()):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], VECS)


BAD = [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] + [0.0] * 63, 1), (1003, [None] + [1.0] * 63, 1), (1004, [float("inf")] + [1.0] * 63, 1)]


# --- whitening -------------------------------------------------------------

def test_factor_and_rotations_give_the_eigensystem():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (7, 7), (24, 9), (40, 40)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -6, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, atol=1e-13 * v.trace())
        e, u = whitening.principal(v)
        want = np.linalg.eigvalsh(v)[::-1][:len(e)]
        assert np.allclose(e, want, rtol=1e-9, atol=1e-13 * want[0])
        assert np.abs(u.T @ u - np.eye(len(e)))[:6, :6].max() < 1e-10
        assert np.abs(v @ u[:, :4] - u[:, :4] * e[:4]).max() < 1e-12 * e[0]
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_every_pair_of_columns_meets_once():
    for n in (0, 1, 2, 5, 8):
        met = sorted((int(a), int(b)) for p, q in whitening.rounds(n) for a, b in zip(p, q))
        assert met == [(a, b) for a in range(n) for b in range(a + 1, n)]


def brute_whitening(vectors):
    x = np.floor(1024 * vectors).astype(int).astype(object) + 100000
    n, s = len(x), x.sum(axis=0)
    deviation = [int(((n * r - s) ** 2).sum()) for r in x]
    d = np.array([[float(n * int(c) - int(t)) / n for c, t in zip(r, s)] for r in x])
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1], u[:, ::-1]
    return deviation, d @ u / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_whitening_matches_brute_force(spark):
    vectors = clustered()
    vectors[7] = vectors[8]
    got = whiten(spark, clashing(table(spark, vectors, BAD + [(None, [float(c) for c in vectors[0]], 2)]))).toPandas()
    deviation, white, explained = brute_whitening(np.r_[vectors, vectors[:1]])
    assert len(got) == 8 * 401 and (got.n == 401).all() and got.identity_error.max() < 1e-9
    for k in range(1, 9):
        part = got[got.component == k].sort_values("vec_id", na_position="last")
        sign = np.sign(part.whitened.iloc[0] * white[0, k - 1])
        assert np.allclose(part.whitened * sign, white[:, k - 1], atol=1e-8)
        assert np.allclose(part.explained, explained[k - 1], rtol=1e-9)
        assert [int(v) for v in part.deviation] == deviation


def test_whitening_edge_cases(spark):
    assert whiten(spark, table(spark, [])).count() == 0
    assert whiten(spark, table(spark, [[1.0, 2.0]])).count() == 0  # no variance
    assert whiten(spark, table(spark, [[1.0, 2.0]] * 3)).count() == 0
    line = whiten(spark, table(spark, [[float(i), 2.0 * i, 3.0] for i in range(6)] + [[5.0], [7.0]])).toPandas()
    assert sorted(line.groupby("n").size().items()) == [(2, 2), (6, 6)]  # one direction; lengths are fits of their own
    assert np.allclose(line.explained, 1.0) and line.identity_error.max() < 1e-12
    huge = whiten(spark, table(spark, [[1e300, 0.0], [0.0, 1.0], [-1e300, 2.0], [3e9, 0.5]])).toPandas()
    assert len(huge) and huge.deviation.isna().any() and huge.deviation_wide.dtype == object


def test_whitening_wide_deviation(spark):
    rows = [[c * 2.0 ** 30, 1.0] for c in (-1.0, 0.0, 1.0, 2.0)]
    got = whiten(spark, table(spark, rows)).where("component = 1").orderBy("vec_id").toPandas()
    want, _, _ = brute_whitening(np.array(rows))
    assert [int(a) if b is None else int(b) for a, b in zip(got.deviation.fillna(0), got.deviation_wide)] == want


# --- clustering ------------------------------------------------------------

def brute_clusters(rows, centroids=16, rounds=3):
    kept = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [list(x) for _, x in order[:centroids]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(at)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(at)):
            mine = [x for (_, x), (_, k) in zip(kept, own) if k == j]
            if mine:
                at[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    total = sum(d for d, _ in own)
    per = {j: sum(d for d, k in own if k == j) for j in range(len(at))}
    return sorted(((i, j, d, per[j], total, hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own)), key=str)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 300])
def test_clusters_match_brute_force(spark, n):
    vectors = clustered(max(n, 1))[:n]
    extra = BAD + ([(3, [float(c) for c in vectors[0]], 0), (None, [float(c) for c in vectors[-1]], 0)] if n == 300 else [])
    df = clashing(table(spark, vectors, extra))
    got = sorted((tuple(r) for r in cluster_vectors(spark, df).collect()), key=str)
    want = brute_clusters([(i, list(v)) for i, v in enumerate(vectors)] + [(i, v) for i, v, _ in extra])
    assert got == want


def test_clusters_ties_copies_and_few_ids(spark):
    rows = [(i % 3, [float(i % 2)] * 64, 0) for i in range(60)]  # two vectors, three ids
    got = sorted((tuple(r) for r in cluster_vectors(spark, spark.createDataFrame(rows, VECS)).collect()), key=str)
    assert got == brute_clusters([(i, v) for i, v, _ in rows])
    nameless = spark.createDataFrame([(None, [float(i)] * 64, 0) for i in range(4)], VECS)
    assert cluster_vectors(spark, nameless).select("cluster").distinct().count() == 4


def test_pivots_save_measurements_and_keep_exact_results():
    rng = np.random.default_rng(3)
    centre = rng.integers(-4000, 4000, (16, 64))
    x = centre[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 64))
    pivots = laesa.far_apart(x[:200].astype(float), laesa.PIVOTS)
    cluster, best, measured = laesa.nearest(x, laesa.distances(x.astype(float), pivots), centre, laesa.distances(centre.astype(float), pivots))
    d = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert measured < 1.2 * len(x)
    far = x * (1 << 40)
    cluster, best, _ = laesa.nearest(far, laesa.distances(far.astype(float), pivots), centre, laesa.distances(centre.astype(float), pivots))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)), j) for j, c in enumerate(centre)) for r in far[:20]]
    assert [(int(b), int(c)) for b, c in zip(best[:20], cluster[:20])] == want


# --- nearest neighbours ----------------------------------------------------

def brute_neighbours(rows, top=20):
    use = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(use):
        if i % 20 == 0:
            s = sorted((-float((v * w).sum()), j) for m, (j, w) in enumerate(use) if m != n and len(w) == len(v))
            out.setdefault(i, []).append([(j, -d) for d, j in s[:top]])
    return out


def recall(got, want):
    found = total = 0
    for q, lists_ in want.items():
        for one in lists_:
            mine = {v for _, v, _ in got.get(q, [])}
            found += len(mine & {j for j, _ in one})
            total += len({j for j, _ in one})
    return found / max(1, total)


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours_recall_and_order(spark, scaled, monkeypatch):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 60)
    vectors = clustered(3000, seed=9)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if scaled:
        vectors *= np.random.default_rng(2).uniform(0.2, 3.0, (3000, 1))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)] + [(r[0] + 9000, *r[1:]) for r in BAD] + [(20000, [0.0] * 64, 0), (None, [1.0] * 64, 0)]
    got = by_query(nearest_neighbours(spark, clashing(spark.createDataFrame(rows, VECS))))
    want = brute_neighbours([(i, v) for i, v, _ in rows])
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q, hits in got.items():
        assert [r for r, _, _ in hits] == list(range(1, 21)) and q not in [v for _, v, _ in hits]
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(hits, hits[1:]))
        assert all(abs(s - float(vectors[q] @ vectors[v])) < 1e-12 for _, v, s in hits)


def test_neighbours_copies_ties_and_small_tables(spark):
    def run(rows):
        return by_query(nearest_neighbours(spark, spark.createDataFrame(rows, VECS)))

    def want(rows):
        return {q: [(k + 1, j) for k, (j, _) in enumerate(v[0])] for q, v in brute_neighbours([(i, x) for i, x, _ in rows]).items() if v[0]}
    assert run([]) == {} and run([(20, [1.0, 0.0], 0)]) == {}
    copies = [(i, [1.0, 0.0, 0.0], 0) for i in range(130)] + [(i, [0.0, 1.0, 0.0], 0) for i in range(130, 150)] \
        + [(i, [1.0, float(i % 2), 0.0], 0) for i in range(150, 170)] + [(200, [1.0, 2.0], 0), (201, [2.0, 1.0], 0), (220, [-1.0, 0.0, 0.0], 0)]
    got = run(copies)
    assert {q: [(r, v) for r, v, _ in hits] for q, hits in got.items()} == want(copies)
    twice = [(20, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (3, [2.0, 1.0], 0)]
    assert [(r, v) for r, v, _ in run(twice)[20]] == [(1, 20), (1, 20), (2, 3), (2, 3)]


def test_walk_finds_the_nearest_centroids():
    x = clustered(4000, 16, seed=4)
    index = Index(x, 200, float(np.linalg.norm(x, axis=1).max()))
    q = index.aim(clustered(200, 16, seed=4))
    ids, d = index.walk(q, 10)
    exact = np.argsort(index._apart(q, index.centroids), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, exact)]) > 0.95
    assert (np.diff(d, axis=1) >= -1e-12).all()
    sizes = np.bincount(posting_lists.halves(x, 37))
    assert len(sizes) == 37 and sizes.max() - sizes.min() <= 8


def test_hot_groups_are_cut_before_the_shuffle(spark):
    """Copies of one vector leave a bounded number of rows per task."""
    df = spark.range(0, 5000, 1, 8).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(2.0)))
                                           .otherwise(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("embedding"))
    got = by_query(nearest_neighbours(spark, df))
    want = brute_neighbours([(r["vec_id"], list(r["embedding"])) for r in df.collect()])
    assert recall(got, want) >= 0.9 and len(got) == 250
