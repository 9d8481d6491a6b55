"""Embedding near-duplicates: an exact metric range join on the unit sphere.

cos(u, v) >= t is |u - v| <= r with r = sqrt(2 - 2t) for unit vectors. Pivots
(for a large label a hash sample of its own vectors, about one for every ``CELL_ROWS``
and ``MAX_PIVOTS`` in all) cut each label's vectors into cells, a vector's
home being its nearest pivot. By the triangle inequality a vector u within r
of a vector at home at pivot j has d(u, j) - d(u, home) <= 2r, so u is copied
to exactly those cells (in Euclidean space the distance to the bisecting plane
tightens this further) and cells join independently. A cell larger than
``BLOCK`` is split into a grid of blocks, so no task holds a whole cell, and
inside a block the rings around the pivot skip rows that cannot be in range.

Equal vectors are one row with a count. A block gives the number of links per
home vector and a spanning forest of its links, never the pairs themselves; the
forests' connected components are the components of all links.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component, and one without label or id, links with nothing and is
kept. Labels of any simple type are compared as they are. Vectors of different lengths do not link. Repeated rows are vectors of
their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashed, prepare, stage_table
from .components import connected_components

THRESHOLD = 0.98
CELL_ROWS = 2000  # vectors of one label that a pivot is meant for
MAX_PIVOTS = 1024  # of all labels: bounds the broadcast; larger cells are split into more blocks
_CHUNK = 1024
BLOCK = 2048
_SLACK = 1e-9

_CELLS = "rep bigint, label string, dim int, cell int, home boolean, copies bigint, ring double, vec array<double>"
_CELLS_ARROW = pa.schema([("rep", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()),
                          ("home", pa.bool_()), ("copies", pa.int64()), ("ring", pa.float64()), ("vec", pa.list_(pa.float64()))])
_FOUND = "rep bigint, other bigint, links bigint"
_FOUND_ARROW = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _with_gaps(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and the distances between them."""
    return p, np.stack([np.linalg.norm(p - row, axis=1) for row in p])


def _assign(pivots_var, radius: float):
    def run(batches):
        pivots = pivots_var.value
        for b in batches:
            labels = b.column("label").to_pylist()
            groups: dict[tuple, list] = {}
            for i, (label, dim) in enumerate(zip(labels, b.column("dim").to_pylist())):
                # labels without pivots share one: the first axis
                groups.setdefault((label if (label, dim) in pivots else None, dim), []).append(i)
            flat, off = b.column("vec").flatten().to_numpy(zero_copy_only=False), b.column("vec").offsets.to_numpy()
            off = off - off[0]
            for (key, rows) in ((k, np.array(g[a:a + _CHUNK])) for k, g in groups.items() for a in range(0, len(g), _CHUNK)):
                dim = key[1]
                x = _unit(np.stack([flat[off[i]:off[i + 1]] for i in rows]).astype(np.float64))
                p, between = pivots[key] if key in pivots else (np.eye(1, dim), np.zeros((1, 1)))
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ p.T))
                home = d.argmin(axis=1)
                near = d[np.arange(len(x)), home]
                reach = (d - near[:, None] <= 2 * radius + _SLACK) & (d ** 2 - near[:, None] ** 2 <= 2 * radius * between[home] + _SLACK)
                reach[np.arange(len(x)), home] = True
                r, c = np.nonzero(reach)
                take = pa.array(rows[r])
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep").take(take), b.column("label").take(take), b.column("dim").take(take),
                     pa.array(c.astype(np.int32)), pa.array(home[r] == c), b.column("copies").take(take), pa.array(d[r, c]),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, (len(r) + 1) * dim, dim, dtype=np.int32)), pa.array(x[r].ravel()))],
                    schema=_CELLS_ARROW)
    return run


def spanning_forest(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) of a spanning forest of a boolean biadjacency matrix."""
    rows, cols = [], []
    new_row, new_col = a.any(axis=1), np.ones(a.shape[1], dtype=bool)
    for start in np.flatnonzero(new_row):
        if not new_row[start]:
            continue
        new_row[start] = False
        todo = [start]
        while todo:
            r = todo.pop()
            found = np.flatnonzero(a[r] & new_col)
            if not len(found):
                continue
            new_col[found] = False
            rows.append(np.full(len(found), r))
            cols.append(found)
            left = np.flatnonzero(new_row)
            hit = a[np.ix_(left, found)]
            near = hit.any(axis=1)
            rows.append(left[near])
            cols.append(found[hit[near].argmax(axis=1)])
            new_row[left[near]] = False
            todo.extend(left[near])
    empty = np.zeros(0, dtype=int)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (empty, empty)


def _join_block(threshold: float, radius: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy().astype(bool)
        rep, copies, ring = (table.column(c).to_numpy() for c in ("rep", "copies", "ring"))
        dim = table.column("dim")[0].as_py()
        x = pa.concat_arrays(table.column("vec").chunks).flatten().to_numpy().reshape(-1, dim)
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(q) or not len(m):
            return _FOUND_ARROW.empty_table()
        q, m = q[np.argsort(ring[q])], m[np.argsort(ring[m])]
        linked = np.zeros((len(q), len(m)), dtype=bool)
        for a in range(0, len(q), 256):
            part = q[a:a + 256]
            lo, hi = np.searchsorted(ring[m], [ring[part[0]] - radius - _SLACK, ring[part[-1]] + radius + _SLACK])
            linked[a:a + 256, lo:hi] = x[part] @ x[m[lo:hi]].T >= threshold
        linked &= rep[q][:, None] != rep[m][None, :]
        links = linked @ copies[m]
        some = links > 0
        r, c = spanning_forest(linked)
        return pa.Table.from_arrays(
            [pa.array(np.r_[rep[q[some]], rep[q[r]]]),
             pa.array(np.r_[np.zeros(some.sum(), np.int64), rep[m[c]]], mask=np.r_[np.ones(some.sum(), bool), np.zeros(len(r), bool)]),
             pa.array(np.r_[links[some], np.zeros(len(r), np.int64)])], schema=_FOUND_ARROW)
    return run


def near_duplicate_vectors(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``."""
    prepare(spark)
    radius = float(np.sqrt(2.0 - 2.0 * threshold))
    kind = embeddings.schema["label"].dataType.simpleString()
    label = F.col("label") + F.lit(0.0).cast(kind) if kind in ("float", "double") else F.col("label")  # one zero
    label = label.cast("string")  # different values of a simple type have different strings
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"),
                             F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are one value, as keys and as components.
    usable = rows.where(valid).withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0)))
    reps = stage_table(spark, usable.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                       .withColumn("dim", F.size("vec")), "vectors")
    total = reps.count()
    step = max(CELL_ROWS, total // MAX_PIVOTS)
    by_label = reps.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= 2 * step)
    large = reps.join(by_label.select("label"), "label", "left_semi")
    found_rows = by_label.agg(F.sum("rows")).first()[0] or 0
    pivots: dict[tuple, list] = {}
    for r in least_hashed(large, ["rep", "label"], int(found_rows // step), found_rows).select("label", "dim", "vec").collect():  # MAX_PIVOTS at most
        pivots.setdefault((r["label"], r["dim"]), []).append(r["vec"])
    pivot_var = spark.sparkContext.broadcast({k: _with_gaps(_unit(np.array(v, dtype=np.float64))) for k, v in pivots.items()})
    cells = stage_table(spark, reps.select("rep", "label", "dim", "copies", "vec").mapInArrow(_assign(pivot_var, radius), _CELLS), "cells")

    key = ["label", "dim", "cell"]
    blocks = cells.groupBy(*key).agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("nm"),
                                     (F.floor(F.count_if("home") / BLOCK) + 1).cast("int").alias("nh"))
    dealt = (cells.join(blocks, key)
             .withColumn("i", F.pmod(F.xxhash64("rep", F.lit(1)), "nh").cast("int"))
             .withColumn("j", F.pmod(F.xxhash64("rep", F.lit(2)), "nm").cast("int")))
    out = [*key, "rep", "copies", "ring", "vec"]
    queries = dealt.where("home").select(*out, "i", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"), F.lit(True).alias("query"))
    members = dealt.select(*out, F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("i"), "j", F.lit(False).alias("query"))
    found = queries.unionByName(members).groupBy(*key, "i", "j").applyInArrow(_join_block(threshold, radius), _FOUND)
    found = stage_table(spark, found, "found")

    comp = connected_components(spark, found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = (reps.join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
               .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    linked = usable.join(per_rep, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
