"""Centroid clustering in whole numbers, with a table of pivot distances.

Each component x of a vector becomes floor(64 x). A few fixed pivots are chosen
once, far apart from each other, and every vector's distances to them are
staged next to it. In each round the pivots' distances to the centroids give,
by the triangle inequality, |d(v, p) - d(c, p)| <= d(v, c) for every pair: the
centroid with the least bound is measured first, and only centroids whose bound
does not exceed that distance are measured too, in exact whole numbers. Each
task adds up its clusters (one row per cluster and dimension), Spark merges the
tasks, and the driver sees clusters x dimensions.

Defined results: a vector that is null, has another number of components than
``dim`` or holds a null, NaN or infinite one is left out. Repeated rows count as
often as they occur, as first centroids too; ties between first centroids of
one id fall to the smaller vector. A vector without id takes part, but starts a
centroid only where there are fewer other ones than centroids. Fewer vectors than
centroids give fewer centroids; none give an empty result. Extra columns are
ignored. Whole numbers are held to 64 bits; a distance that does not fit a long
is null and left out of the sums, though the assignment is still exact.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, prepare, stage_table
from .vectors import column_sums, finite, lists, matrices, smallest

DIM, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
PIVOTS = 8
PIVOT_SAMPLE = 256  # vectors among which the pivots are chosen; results do not depend on them
_SAFE = 1 << 27  # below, squared distances of up to 64 components fit 64 bits
_TABLE = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("apart", pa.list_(pa.float64()))])
_PART = pa.schema([("cluster", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])
_FOUND = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def far_apart(x: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of x, each as far as possible from those before."""
    chosen, near = [0], np.full(len(x), np.inf)
    while len(chosen) < min(wanted, len(x)):
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return x[chosen]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, in Python integers where 64 bits are too few."""
    if x.size and max(int(np.abs(x).max()), int(np.abs(y).max())) >= _SAFE:
        x, y = x.astype(object), np.asarray(y, dtype=object)
    d = x - y
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, apart: np.ndarray, centroids: np.ndarray, centroids_apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, ties to the smaller number, and how many distances were measured."""
    bound = np.abs(apart[:, None, :] - centroids_apart[None, :, :]).max(axis=2)
    cluster = bound.argmin(axis=1)
    best = squared(x, centroids[cluster])
    first, measured = cluster.copy(), len(x)
    slack = 1e-9 * (1.0 + max(apart.max(initial=0.0), centroids_apart.max(initial=0.0)))
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= np.sqrt(best.astype(np.float64)) + slack) & (first != j))
        if not len(rows):
            continue
        d = squared(x[rows], centroids[j])
        measured += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        best = best.astype(object) if d.dtype == object else best
        best[rows[better]], cluster[rows[better]] = d[better], j
    return cluster, best, measured


def _tabulate(pivots_var):
    def run(batches):
        for b in batches:
            for _, rows, x in matrices(b, "x"):
                apart = distances(x.astype(np.float64), pivots_var.value)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), b.column("x").take(pa.array(rows)), lists(apart)],
                                                 schema=_TABLE)
    return run


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return next(matrices(b, "x"))[2], next(matrices(b, "apart"))[2]


def _add_clusters(state_var):
    def run(batches):
        centroids, centroids_apart = state_var.value
        total, n = np.zeros(centroids.shape, dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x, apart = _read(b)
                cluster, _, _ = nearest(x, apart, centroids, centroids_apart)
                for j in np.unique(cluster):
                    own = x[cluster == j]
                    n[j] += len(own)
                    total[j] += column_sums(own)
        for j in np.flatnonzero(n):
            size = centroids.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([j] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n[j]] * size, pa.int64()),
                                              pa.array([Decimal(int(v)) for v in total[j]], pa.decimal128(38, 0))], schema=_PART)
    return run


def _assign(state_var):
    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, best, _ = nearest(*_read(b), *state_var.value)
                fits = [int(v) if v < 1 << 63 else None for v in best] if best.dtype == object else best
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(fits, pa.int64())], schema=_FOUND)
    return run


def cluster_vectors(spark: SparkSession, embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector kept."""
    prepare(spark)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    kept = rows.where((F.size("vec") == dim) & finite(F.col("vec"))).select("vec_id", F.transform("vec", lambda v: F.floor(v * SCALE)).alias("x"))

    def digest(tag: str):
        return F.sha2(F.concat(F.lit(tag), F.col("vec_id").cast("string")), 256)
    total = kept.count()
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not total:
        return spark.createDataFrame([], schema)
    start = smallest(kept.select(digest("1:").alias("digest"), "x"), "digest", ["x"], total, centroids)
    at = np.array([r["x"] for r in start], dtype=np.int64)
    sample = smallest(kept.select(digest("pivot:").alias("digest"), "x"), "digest", ["x"], total, PIVOT_SAMPLE)
    pivots = far_apart(np.array([r["x"] for r in sample], dtype=np.float64), PIVOTS)
    table = stage_table(spark, kept.mapInArrow(_tabulate(spark.sparkContext.broadcast(pivots)), "vec_id bigint, x array<bigint>, apart array<double>"), "pivot-table")

    def state():
        return spark.sparkContext.broadcast((at, distances(at.astype(np.float64), pivots)))
    for _ in range(rounds):
        parts = table.mapInArrow(_add_clusters(state()), "cluster int, i int, n bigint, total decimal(38,0)")
        for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            at[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    found = stage_table(spark, table.mapInArrow(_assign(state()), "vec_id bigint, cluster int, distance bigint"), "clusters")
    drop_staged(spark, table)
    sums = {r["cluster"]: int(r["s"] or 0) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def long(v: int) -> int | None:
        return v if v < 1 << 63 else None
    # One row per centroid.
    about = spark.createDataFrame(
        [(j, long(s), long(sum(sums.values())), hashlib.sha256(",".join(str(int(v)) for v in at[j]).encode()).hexdigest()) for j, s in sums.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """DuckDB SQL: every distance measured, rounds written out."""
    def assign(r: int) -> str:
        return f"""
    a{r} AS (
      SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, c := c)) AS best
      FROM (SELECT k.row, k.vec_id, k.x, m.c, list_sum(list_transform(list_zip(k.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM kept k, m{r} m) GROUP BY row, vec_id)"""

    def move(r: int) -> str:
        return f"""
    s{r} AS (
      SELECT c, i, sum(v) AS s, count(*) AS n
      FROM (SELECT best.c AS c, unnest(x) AS v, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY c, i),
    m{r + 1} AS (
      SELECT m.c, coalesce(u.x, m.x) AS x FROM m{r} m LEFT JOIN
        (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c) u USING (c))"""
    steps = ",".join(assign(r) + "," + move(r) for r in range(rounds))
    return f"""
    WITH kept AS (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x
      FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    m0 AS (
      SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x
      FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), x) <= {centroids}),
    {steps.strip()},
    {assign(rounds).strip()}
    SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
           sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
    FROM a{rounds} JOIN m{rounds} m ON m.c = best.c"""
