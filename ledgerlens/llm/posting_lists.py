"""Approximate nearest neighbours by inner product: balanced posting lists under an in-memory graph of centroids.

Inner products become distances: with M the largest norm, a vector v stands at
(v, sqrt(M^2 - |v|^2)) / M on the unit sphere, a query at (q / |q|, 0); the
nearest one has the largest inner product. A bounded sample of the vectors is
halved again and again along its widest spread, so that all cells are equally
full; a few rounds that add a price for over-full lists move the centroids.
Centroids and their neighbour graph are small and go to every task.

Every vector goes into the list of its nearest centroid, and a vector near a
boundary also into further ones: those within ``REPLICA_RATIO`` of the nearest
distance that no list already chosen lies closer to (so copies go to different
sides). A query walks the graph for its nearest centroids and takes the lists
within a distance ratio of the first. That ratio is not guessed: exact
neighbours of a bounded sample of queries, found among all vectors, tell how
far lists must be read to hold ``TARGET`` of them.

Lists and queries meet by list; a list longer than ``BLOCK`` is split into a
grid of blocks, so no task holds a whole list. The scores of the fitted vectors
bound a query's results from below, so a block returns few pairs. Equal vectors are one entry with
their k + 1 smallest ids, which no result can exceed. Scores are inner products
in double precision, summed in one fixed order.

Defined results: a vector that is null, empty, zero or holds a null, NaN or
infinite component, or has no id, takes no part. Vectors of different lengths
do not meet. Repeated rows are rows of their own: one of them may be the
neighbour of the other. A query without candidates gives no rows. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import drop_staged, prepare, stage_table
from .vectors import HASH_SPACE, finite, lists, matrices

TOP = 20
EVERY = 20  # rows whose id this divides are queries
FIT_ROWS = 16_384  # vectors that the centroids are fitted on
LIST_ROWS = 512  # vectors a list is meant for
MAX_LISTS = 4_096  # bounds the index in memory; longer lists are read in blocks
REPLICAS = 4
REPLICA_RATIO = 1.1
TARGET = 0.97
TEST_QUERIES = 64
DEGREE = 16
BLOCK = 4_096
_REFINE = 4


def halves(x: np.ndarray, parts: int) -> np.ndarray:
    """Cell of each row: cells of equal size, cut at the median of the direction in which a set spreads most."""
    cell = np.zeros(len(x), dtype=np.int64)
    todo, given = [(np.arange(len(x)), parts)], 0
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2:
            cell[rows] = given
            given += 1
            continue
        d = x[rows] - x[rows].mean(axis=0)
        axis = d[np.abs(d).sum(axis=1).argmax()]
        for _ in range(8):  # power iteration
            axis = d.T @ (d @ axis)
            axis /= max(np.linalg.norm(axis), 1e-300)
        order = np.argsort(d @ axis, kind="stable")
        left = n // 2
        cut = len(rows) * left // n
        todo += [(rows[order[cut:]], n - left), (rows[order[:cut]], left)]
    return cell


class Index:
    """Centroids, their graph, and the two walks over it."""

    def __init__(self, points: np.ndarray, parts: int, norm: float):
        self.norm, self.points = norm, points
        x = self.place(points)
        cell = halves(x, max(1, min(parts, len(x))))
        n = cell.max() + 1
        c = np.stack([x[cell == j].mean(axis=0) for j in range(n)])
        size = np.bincount(cell, minlength=n)
        for _ in range(_REFINE if n > 1 else 0):
            d = self._apart(x, c)
            price = d.min(axis=1).mean() * np.maximum(0.0, size * n / len(x) - 1.0)
            cell = (d + price).argmin(axis=1)
            size = np.bincount(cell, minlength=n)
            sums = np.zeros_like(c)
            np.add.at(sums, cell, x)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        self.centroids = c
        d = self._apart(c, c)
        np.fill_diagonal(d, np.inf)
        ring = (np.arange(n)[:, None] + np.array([-1, 1])) % n  # neighbouring cells of the halving: no centroid is cut off
        self.graph = np.concatenate([np.argsort(d, axis=1)[:, :min(DEGREE, n - 1)], ring], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        row, at, first = self.homes(points)
        self.home = at[first]
        self.ratio, self.width = 1.0, 1
        self.sizes = np.zeros(n, dtype=np.int64)  # entries whose nearest centroid each one is

    @staticmethod
    def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))

    def place(self, vec: np.ndarray) -> np.ndarray:
        v = vec.astype(np.float64) / self.norm
        return np.concatenate([v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1, keepdims=True)))], axis=1)

    @staticmethod
    def aim(vec: np.ndarray) -> np.ndarray:
        v = vec.astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], axis=1)

    def walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the ``width`` nearest found from each row, nearest first."""
        parts = [self._walk(x[a:a + 512], width) for a in range(0, max(1, len(x)), 512)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search, four nodes a step."""
        c = self.centroids
        rows, n = len(x), len(c)
        width = min(width, n)
        keep = max(width, min(n, 24))
        norms = (c * c).sum(axis=1)
        xx = (x * x).sum(axis=1)

        def apart(at, ids):
            return np.maximum(0.0, xx[at][:, None] - 2 * np.einsum("ad,agd->ag", x[at], c[ids]) + norms[ids])
        seen = np.zeros((rows, n), dtype=bool)
        ids = np.full((rows, keep), -1)
        dist = np.full((rows, keep), np.inf)
        done = np.ones((rows, keep), dtype=bool)
        k = min(len(self.entries), keep)
        ids[:, :k], done[:, :k] = self.entries[:k], False
        dist[:, :k] = apart(np.arange(rows), ids[:, :k])
        seen[:, self.entries[:k]] = True
        while True:
            open_ = np.where(done, np.inf, dist)
            at = np.flatnonzero(np.isfinite(open_).any(axis=1))
            if not len(at):
                break
            pick = np.argsort(open_[at], axis=1)[:, :4]
            valid = np.isfinite(np.take_along_axis(open_[at], pick, 1))
            done[at[:, None], pick] = True
            new = np.where(valid[:, :, None], self.graph[np.where(valid, ids[at[:, None], pick], 0)], -1).reshape(len(at), -1)
            new = np.sort(new, axis=1)
            fresh = (new >= 0) & ~seen[at[:, None], new] & np.c_[np.ones(len(at), bool), new[:, 1:] != new[:, :-1]]
            d = np.where(fresh, apart(at, new), np.inf)
            r, q = np.nonzero(fresh)
            seen[at[r], new[r, q]] = True
            all_ids, all_dist = np.c_[ids[at], new], np.c_[dist[at], d]
            all_done = np.c_[done[at], ~fresh]
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :keep]
            ids[at], dist[at], done[at] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_dist, all_done))
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))

    def homes(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, whether it is the nearest one) of every posting."""
        ids, d = self.walk(self.place(vec), 4 * REPLICAS)
        chosen = np.zeros(ids.shape, dtype=bool)
        chosen[:, 0] = True
        for j in range(1, ids.shape[1]):
            here = np.isfinite(d[:, j]) & (d[:, j] <= REPLICA_RATIO * d[:, 0]) & (chosen.sum(axis=1) < REPLICAS)
            between = np.linalg.norm(self.centroids[ids[:, :j]] - self.centroids[ids[:, j]][:, None, :], axis=2)
            chosen[:, j] = here & ~(chosen[:, :j] & (between < d[:, j][:, None])).any(axis=1)
        row, at = np.nonzero(chosen)
        return row, ids[row, at], at == 0

    def floor(self, vec: np.ndarray, row: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
        """A bound that the ``least`` best scores found for each query reach: the ``least``-th score among the
        fitted vectors that are at home in the lists it reads (``row``, ``at``)."""
        out = np.full(len(vec), -np.inf)
        read = np.zeros((len(vec), len(self.centroids)), dtype=bool)
        read[row, at] = True
        for a in range(0, len(vec) if len(self.points) >= least else 0, 256):
            s = np.where(read[a:a + 256][:, self.home], vec[a:a + 256].astype(np.float64) @ self.points.T, -np.inf)
            out[a:a + 256] = np.partition(s, s.shape[1] - least, axis=1)[:, s.shape[1] - least]
        return out

    def probes(self, vec: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list a query reads: those within the ratio, and where these are home to
        fewer than ``least`` entries, the next nearest ones up to that number."""
        x = self.aim(vec)
        ids, d = self.walk(x, self.width)
        chosen = (d <= self.ratio * d[:, :1] + 1e-12) & np.isfinite(d)
        short = (self.sizes[ids] * chosen).sum(axis=1) < least
        row, at = np.nonzero(chosen & ~short[:, None])
        row, ids = [row], [ids[row, at]]
        for r in np.flatnonzero(short):
            apart = np.sqrt(self._apart(x[r:r + 1], self.centroids)[0])
            order = np.argsort(apart, kind="stable")
            n = max(int(np.searchsorted(np.cumsum(self.sizes[order]), least)) + 1, int((apart <= self.ratio * apart.min() + 1e-12).sum()))
            row.append(np.full(len(order[:n]), r))
            ids.append(order[:n])
        return np.concatenate(row), np.concatenate(ids)

    def calibrate(self, queries: np.ndarray, neighbours: list[np.ndarray]) -> None:
        """Set the ratio so that the lists read hold TARGET of the exact ``neighbours`` of ``queries``."""
        d = np.sqrt(self._apart(self.aim(queries), self.centroids))
        need = []
        for row, near in enumerate(neighbours):
            if len(near):
                at, home, _ = self.homes(near)
                least = np.full(len(near), np.inf)
                np.minimum.at(least, at, d[row, home])
                need.append(least / max(d[row].min(), 1e-12))
        if need:
            self.ratio = max(1.0, float(np.quantile(np.concatenate(need), TARGET, method="higher")))
        self.width = int(min(len(self.centroids), 8 + 2 * (d <= self.ratio * d.min(axis=1, keepdims=True) + 1e-12).sum(axis=1).max()))


def scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order whatever the block."""
    return (q.astype(np.float64) * m.astype(np.float64)).sum(axis=-1)


def best_pairs(q: np.ndarray, m: np.ndarray, top: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score): for each query its ``top`` largest scores, ties included, of those that reach its ``floor``."""
    q, m = q.astype(np.float64), m.astype(np.float64)
    found = []
    for a in range(0, len(q), 256):
        rough = q[a:a + 256] @ m.T
        edge = np.partition(rough, len(m) - top, axis=1)[:, len(m) - top] if len(m) > top else np.full(len(rough), -np.inf)
        if floor is not None:
            edge = np.maximum(edge, floor[a:a + 256])
        slack = 1e-12 * np.linalg.norm(q[a:a + 256], axis=1) * np.linalg.norm(m, axis=1).max()
        r, c = np.nonzero(rough >= (edge - slack)[:, None])
        found.append((r + a, c, scores(q[r + a], m[c])))
    return tuple(np.concatenate(v) for v in zip(*found))


def _post(index_var, schema):
    """Entries, once per list."""
    def run(batches):
        for b in batches:
            for dim, rows, x in matrices(b):
                r, at, first = index_var.value[dim].homes(x)
                take = pa.array(rows[r])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), dim, np.int32)), pa.array(at.astype(np.int32)),
                                                  *(b.column(c).take(take) for c in ("k1", "k2", "vec", "ids")), pa.array(first)], schema=schema)
    return run


def _ask(index_var, schema, least):
    """Queries, once per list they read."""
    def run(batches):
        for b in batches:
            for dim, rows, x in matrices(b):
                index = index_var.value[dim]
                r, at = index.probes(x, least)
                take = pa.array(rows[r])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), dim, np.int32)), pa.array(at.astype(np.int32)),
                                                  *(b.column(c).take(take) for c in ("k1", "k2", "vec")), pa.array(index.floor(x, r, at, least)[r])], schema=schema)
    return run


def _search(schema, top):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy().astype(bool)
        x = next(matrices(table.to_batches()[0]))[2]
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(q) or not len(m):
            return schema.empty_table()
        r, c, s = best_pairs(x[q], x[m], top, table.column("floor").to_numpy()[q])
        return pa.Table.from_arrays([*(table.column(k).take(pa.array(q[r])) for k in ("k1", "k2")), table.column("k1").take(pa.array(m[c])),
                                     table.column("ids").take(pa.array(m[c])), pa.array(s)], schema=schema)
    return run


def _exact(queries_var, schema, top):
    """The best rows of each task for a few given queries, by inner product with every row."""
    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            for dim, rows, x in matrices(b):
                qs = queries_var.value.get(dim)
                if qs is None:
                    continue
                r, c, s = best_pairs(qs, x, top)
                if dim in held:
                    r, s, x = np.r_[held[dim][0], r], np.r_[held[dim][1], s], np.r_[held[dim][2], x[c]]
                else:
                    x = x[c]
                order = np.lexsort((-s, r))
                place = np.arange(len(r)) - np.searchsorted(r[order], r[order])
                keep = order[place < top]
                held[dim] = (r[keep], s[keep], x[keep])
        for dim, (r, s, x) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), dim, np.int32)), pa.array(r.astype(np.int32)), pa.array(s), lists(x)], schema=schema)
    return run


def build_index(spark: SparkSession, entries: DataFrame, queries: DataFrame, top: int = TOP) -> dict[int, Index]:
    """An index per vector length, fitted on about FIT_ROWS entries and calibrated on about TEST_QUERIES queries."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    # k1 is a hash, so a share of its range is a sample; what is collected depends on the two bounds alone.
    def part(df, n, wanted):
        return df.where(F.col("k1") < F.lit(int(-(HASH_SPACE >> 1) + min(1.0, wanted / max(1, n)) * (HASH_SPACE - 1)))) if n > wanted else df
    sizes = entries.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).collect()
    out = {}
    sample: dict[int, list] = {}
    for b in part(entries, sum(r["n"] for r in sizes), FIT_ROWS).select("vec").toArrow().to_batches():
        for dim, _, x in matrices(b):
            sample.setdefault(dim, []).append(x)
    for r in sizes:
        own = np.concatenate(sample.get(r["dim"], [np.eye(1, r["dim"]) * r["norm"]])).astype(np.float64)
        parts = min(MAX_LISTS, max(1, r["n"] // LIST_ROWS), max(1, len(own) // 4))
        out[r["dim"]] = Index(own, parts, float(r["norm"]))
    asked: dict[int, list] = {}
    for r in part(queries, queries.count(), TEST_QUERIES).select("vec").collect():
        asked.setdefault(len(r["vec"]), []).append(r["vec"])
    asked = {d: np.array(v, dtype=np.float64) for d, v in asked.items()}
    kind = pa.float64()
    found_schema = pa.schema([("dim", pa.int32()), ("q", pa.int32()), ("score", pa.float64()), ("vec", pa.list_(kind))])
    # The query's own vector may be among its best, so one more is asked for.
    best = entries.select(F.col("vec").cast("array<double>").alias("vec")).mapInArrow(
        _exact(spark.sparkContext.broadcast(asked), found_schema, top + 1), "dim int, q int, score double, vec array<double>")
    near = best.withColumn("at", F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score"), "vec"))).where(F.col("at") <= top + 1)
    neighbours: dict[tuple, list] = {}
    for r in near.select("dim", "q", "vec").collect():
        neighbours.setdefault((r["dim"], r["q"]), []).append(r["vec"])
    for dim, q in asked.items():
        others = [np.array([v for v in neighbours.get((dim, i), []) if v != q[i].tolist()][:top]).reshape(-1, dim) for i in range(len(q))]
        out[dim].calibrate(q, others)
    return out


def nearest_neighbours(spark: SparkSession, embeddings: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the ``top`` rows of largest inner product found."""
    prepare(spark)
    field = embeddings.schema["embedding"].dataType
    single = isinstance(field, ArrayType) and isinstance(field.elementType, FloatType)
    kind, arrow = ("float", pa.float32()) if single else ("double", pa.float64())
    vec = F.col("embedding").cast(f"array<{kind}>")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda v: v != 0))
    # -0.0 and 0.0 are one value; two hashes name a vector.
    rows = rows.withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0).cast(kind)))
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    key = ["k1", "k2"]
    # Spark keeps the first rows of each group before it shuffles them.
    numbered = rows.withColumn("nr", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("nr") <= top + 1)
    entries = stage_table(spark, numbered.groupBy(*key).agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asking = rows.where(F.col("vec_id") % every == 0)
    once = asking.withColumn("nr", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("nr") == 1)
    queries = stage_table(spark, once.select(*key, "vec"), "queries")

    index = build_index(spark, entries, queries, top)
    base = [("dim", pa.int32()), ("list", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("vec", pa.list_(arrow))]
    ddl = f"dim int, list int, k1 bigint, k2 bigint, vec array<{kind}>"
    postings = entries.mapInArrow(_post(spark.sparkContext.broadcast(index), pa.schema([*base, ("ids", pa.list_(pa.int64())), ("first", pa.bool_())])),
                                  f"{ddl}, ids array<bigint>, first boolean")
    postings = stage_table(spark, postings, "postings")
    for r in postings.where("first").groupBy("dim", "list").count().collect():
        index[r["dim"]].sizes[r["list"]] = r["count"]
    probes = stage_table(spark, queries.mapInArrow(_ask(spark.sparkContext.broadcast(index), pa.schema([*base, ("floor", pa.float64())]), top + 1),
                                                    f"{ddl}, floor double"), "probes")

    at = ["dim", "list"]
    # One row per list, at most MAX_LISTS per vector length.
    blocks = (postings.groupBy(*at).agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("nm"))
              .join(probes.groupBy(*at).agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("nq")), at))
    out = [*at, "i", "j", *key, "vec"]
    asked = (probes.join(F.broadcast(blocks), at).withColumn("i", F.pmod(F.xxhash64("k2"), "nq").cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nm") - 1))).select(*out, F.lit(None).cast("array<bigint>").alias("ids"), "floor", F.lit(True).alias("query")))
    members = (postings.join(F.broadcast(blocks), at).withColumn("j", F.pmod(F.xxhash64("k2"), "nm").cast("int"))
               .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select(*out, "ids", F.lit(0.0).alias("floor"), F.lit(False).alias("query")))
    found_schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("entry", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    found = asked.unionByName(members).groupBy(*at, "i", "j").applyInArrow(_search(found_schema, top + 1), "k1 bigint, k2 bigint, entry bigint, ids array<bigint>, score double")

    by_query = Window.partitionBy(*key)
    # An entry is found in REPLICAS lists at most; the first top + 1 entries hold the first top + 1 rows.
    hits = (found.withColumn("nr", F.row_number().over(by_query.orderBy(F.desc("score"), F.col("ids")[0], "entry")))
            .where(F.col("nr") <= REPLICAS * (top + 1)).dropDuplicates([*key, "entry", "ids"])
            .select(*key, "score", F.explode("ids").alias("vec_id"))
            .withColumn("nr", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("nr") <= top + 1)
            .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nr", "vec_id", "score"))).alias("hits")))
    hits = stage_table(spark, hits, "hits")
    drop_staged(spark, entries, queries, postings, probes)
    own = F.array_position(F.transform("hits", lambda h: h["vec_id"]), F.col("query_id"))
    others = F.slice(F.filter("hits", lambda h, i: i != F.col("own") - 1), 1, top)
    return (asking.select(F.col("vec_id").alias("query_id"), *key).join(hits, key).withColumn("own", own)
            .select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))
