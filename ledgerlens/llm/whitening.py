"""Embedding whitening from exact sums, a pivoted Cholesky factor and one-sided Jacobi rotations.

Each component c becomes the whole number x = floor(1024 c) + 100000. A first
pass adds up n and the sums S per dimension in whole numbers; a second one the
scatter of the centred vectors. Both leave one row per task and dimension (or
pair of dimensions), merged by Spark; the driver only sees the d x d scatter.
There the covariance V is factored as L L' with diagonal pivoting, and Jacobi
rotations of the columns of L make them orthogonal: L J = U D. Then V = U D^2 U',
so the squared column norms are the eigenvalues and the normalised columns the
components. The rotations themselves are never formed or multiplied.

Centring is exact: with m the rounded mean and r = S - n m, x - S/n is
(x - m) - r/n, where x - m is a small whole number and r/n at most a half.

Defined results: a vector that is null or holds a null, NaN or infinite
component is left out. Vectors of each length are a fit of their own (empty
ones have no component, so no rows). Directions without variance (beyond
rounding) are no components; equal vectors only, or a single one, thus give no
rows. Repeated rows count as often as they occur, a null id stays null, extra
columns are ignored, an empty table gives an empty result. Whole numbers x are
held between -2^62 and 2^62. ``deviation`` is null where it does not fit a long;
``deviation_wide`` then has it (up to 38 digits).
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stage_table
from .vectors import column_sums, finite, lists, matrices

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_LIMIT = 1 << 62
_WIDE = pa.decimal128(38, 0)
_SUMS = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("total", _WIDE)])
_SCATTER = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])
_WHITE = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("deviation", pa.int64()), ("deviation_wide", _WIDE),
                    ("white", pa.list_(pa.float64()))])


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as 64-bit numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -float(_LIMIT), float(_LIMIT)).astype(np.int64) + SHIFT


def _add_sums(batches):
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, rows, x in matrices(b):
            if dim:
                n[dim] = n.get(dim, 0) + len(rows)
                sums[dim] = sums.get(dim, 0) + column_sums(whole(x))
    for dim, s in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n[dim]] * dim, pa.int64()),
             pa.array([Decimal(int(v)) for v in s], _WIDE)], schema=_SUMS)


class Centre:
    """n, the rounded mean m and the remainder r = S - n m of each dimension."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.m = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
        self.r = np.array([s - n * int(m) for s, m in zip(sums, self.m)], dtype=object)
        self.rest = np.array([float(v) / n for v in self.r])

    def near(self, x: np.ndarray) -> np.ndarray:
        """x - m, in Python integers where 64 bits are too few."""
        if len(x) and int(np.abs(x).max()) < _LIMIT // 2 and int(np.abs(self.m).max()) < _LIMIT // 2:
            return x - self.m
        return x.astype(object) - self.m.astype(object)

    def centred(self, near: np.ndarray) -> np.ndarray:
        return near.astype(np.float64) - self.rest

    def deviations(self, near: np.ndarray) -> list[int]:
        """sum over dimensions of (n x - S)^2 = n^2 sum y^2 - 2 n sum r y + sum r^2, with y = x - m."""
        bound = _LIMIT // near.shape[1]
        big = near.dtype == object or int(np.abs(near).max(initial=0)) ** 2 >= bound \
            or int(np.abs(near).max(initial=0)) * max(abs(int(v)) for v in self.r) >= bound
        y, r = (near.astype(object), self.r) if big else (near, self.r.astype(np.int64))
        n, const = self.n, sum(int(v) ** 2 for v in self.r)
        return [n * n * int(a) - 2 * n * int(b) + const for a, b in zip((y * y).sum(axis=1), (y * r).sum(axis=1))]


def _add_scatter(centres_var):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in matrices(b):
                if dim in centres_var.value:
                    c = centres_var.value[dim]
                    d = c.centred(c.near(whole(x)))
                    total[dim] = total.get(dim, 0.0) + d.T @ d
        for dim, s in total.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)),
                                              pa.array(j.astype(np.int32)), pa.array(s[i, j])], schema=_SCATTER)
    return run


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L': the columns of a triangular factor, rows in the order of v. Pivots down to rounding."""
    d = len(v)
    order, left, factor = np.arange(d), v.diagonal().astype(np.float64).copy(), np.zeros((d, d))
    least = d * np.finfo(np.float64).eps * left.max(initial=0.0)
    for k in range(d):
        at = k + int(left[order[k:]].argmax())
        order[[k, at]] = order[[at, k]]
        p, rest = order[k], order[k + 1:]
        if left[p] <= least:
            return factor[:, :k]
        factor[p, k] = np.sqrt(left[p])
        factor[rest, k] = (v[rest, p] - factor[rest, :k] @ factor[p, :k]) / factor[p, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns of a sweep in rounds of disjoint pairs: every two columns meet once."""
    m = n + n % 2
    ring, out = list(range(m)), []
    for _ in range(max(0, m - 1)):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:m // 2], ring[:m // 2 - 1:-1]) if max(a, b) < n]
        if pairs:
            out.append((np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: the columns rotated in pairs until all are orthogonal to working precision."""
    a = factor.copy()
    plan = rounds(a.shape[1])
    for _ in range(sweeps):
        rotated = False
        for p, q in plan:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            rotated = True
            p, q, x, y, alpha, beta, gamma = p[turn], q[turn], x[:, turn], y[:, turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2.0 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1.0 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not rotated:
            break
    return a


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of a covariance, by falling eigenvalue; the largest entry of each is positive."""
    a = orthogonal_columns(pivoted_cholesky(v))
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    a, norms = a[:, order], norms[order]
    u = a / norms
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]) if u.size else np.ones(u.shape[1])
    return norms ** 2, u * sign


def _whiten(model_var):
    def run(batches):
        for b in batches:
            for dim, rows, x in matrices(b):
                if dim not in model_var.value:
                    continue
                centre, axes = model_var.value[dim]
                near = centre.near(whole(x))
                dev = centre.deviations(near)
                fits = [v < 1 << 63 for v in dev]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)),
                     pa.array([v if ok else None for v, ok in zip(dev, fits)], pa.int64()),
                     pa.array([Decimal(v) if not ok and v < 10 ** 38 else None for v, ok in zip(dev, fits)], _WIDE),
                     lists(centre.centred(near) @ axes)], schema=_WHITE)
    return run


def whiten(spark: SparkSession, embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide): one row per vector and component."""
    prepare(spark)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(finite(F.col("vec")))
    vecs = rows.select("vec")
    wide = "decimal(38,0)"
    sums = vecs.mapInArrow(_add_sums, f"dim int, i int, n bigint, total {wide}").groupBy("dim", "i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by_dim: dict[int, list] = {}
    for r in sorted(sums, key=lambda r: (r["dim"], r["i"])):
        by_dim.setdefault(r["dim"], []).append(r)
    centres = {dim: Centre(rs[0]["n"], [int(r["total"]) for r in rs]) for dim, rs in by_dim.items()}

    pairs = vecs.mapInArrow(_add_scatter(spark.sparkContext.broadcast(centres)), "dim int, i int, j int, total double").groupBy(
        "dim", "i", "j").agg(F.sum("total").alias("total")).collect()
    scatter = {dim: np.zeros((dim, dim)) for dim in centres}
    for r in pairs:
        scatter[r["dim"]][r["i"], r["j"]] = scatter[r["dim"]][r["j"], r["i"]] = r["total"]
    model, about = {}, []
    for dim, s in scatter.items():
        v = s / centres[dim].n
        e, u = principal(v)
        k = min(components, len(e))
        if k:
            model[dim] = (centres[dim], u[:, :k] / np.sqrt(e[:k]))
            about += [(dim, i + 1, centres[dim].n, float(e[i] / v.trace())) for i in range(k)]

    white = stage_table(spark, rows.mapInArrow(_whiten(spark.sparkContext.broadcast(model)), f"vec_id bigint, dim int, deviation bigint, deviation_wide {wide}, white array<double>"), "white")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    covariance = white.groupBy("dim").agg(*(F.covar_pop(F.get("white", F.lit(i)), F.get("white", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).collect()
    error = {r["dim"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=0.0) for r in covariance}
    # At most ``components`` rows per vector length.
    known = spark.createDataFrame([(*a, float(error.get(a[0], 0.0))) for a in about],
                                  "dim int, component int, n bigint, explained double, identity_error double")
    return (white.select("vec_id", "dim", "deviation", "deviation_wide", F.posexplode("white").alias("at", "whitened"))
            .withColumn("component", F.col("at") + 1).join(F.broadcast(known), ["dim", "component"])
            .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"))
