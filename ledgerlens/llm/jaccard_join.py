"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a threshold; the result is each document's connected component.

1. One pass over all texts counts shingles in a fixed-size sketch and gives
   each document the size and the key of its set. Documents with equal sets
   are one vertex from here on (copies are never expanded into pairs).
2. Shingles are ordered rare first by the sketch (any total order keeps the
   prefix filter exact). A set of n shingles enters the join with its first
   n - ceil(t n) + 1 shingles: two sets that reach t share one of those. Rows
   that no other row of their shingle can link with by size go at once.
3. Prefix rows that meet on a shingle are paired under the length and the
   positional filter and made distinct. The suffix filter then compares, per
   pair, how many shingles of each set fall into ``SLOTS`` slots of the key
   space: the differences add up to a lower bound of the elements in one set
   only. Only what passes is verified, once per pair, on the whole sets.
4. Pairs are not made in one go, which would be quadratic in a group of near
   copies. First every row is paired with one central row of its shingle
   (the one with the largest share of shared prefix shingles); the links found
   give components, and the second, complete pass makes only pairs whose ends
   are still in different components. A pair that is skipped could only link
   what is linked already, so components stay exact.

Set and shingle keys are 64-bit hashes.

Defined results: null or empty text, or text without words: no shingles, a
component of its own. A null doc_id stays a row of its own with a null
component unless its set links it to one with an id. Rows that repeat a doc_id
with another text are documents of their own (``jaccard_groups`` tells them
apart by a hash of the text). A very long text is one row of shingle keys in a
task, never cut. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap_bit, drop_staged, id_bitmap, prepare, stage_table
from .components import connected_components
from .shingles import Shingler, mix64

SKETCH_BITS = 18
SHINGLE_WORDS = 5
THRESHOLD = (75, 100)  # as a fraction: the comparison stays in whole numbers
CENTRAL_ROUNDS = 1
SLOTS = 256

_INFO = "doc_id bigint, text_key bigint, n int, node bigint, slots binary, sketch array<int>"
_INFO_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("slots", pa.binary()),
                         ("sketch", pa.list_(pa.int32()))])
# A prefix row is packed before it travels: 47 bits of the shingle key, one that marks a frequent shingle, 16 of the position.
# Shingles that share these bits are only compared in vain, and a position held at its largest value filters less.
PLACES = 16
_PREFIX = "key bigint, node bigint, n int"
_PREFIX_ARROW = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])

def set_key(s: np.ndarray) -> int:
    """64-bit key of a sorted set of shingle keys."""
    with np.errstate(over="ignore"):
        x = mix64(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) + mix64(s * np.uint64(31) + np.uint64(len(s))).sum(dtype=np.uint64)
        return int(mix64(np.array([x], dtype=np.uint64)).view(np.int64)[0])


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def slot_counts(s: np.ndarray) -> bytes:
    """Shingles per slot, at most 255 (a smaller difference is a weaker bound, never a wrong one)."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=SLOTS), 255).astype(np.uint8).tobytes()


def _describe(k: int):
    def run(batches):
        shingler, sketch = Shingler(k), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            n, node, slots = [], [], []
            for text in b.column("text").to_pylist():
                s = shingler.shingles(text)
                n.append(len(s))
                node.append(set_key(s) if len(s) else None)
                slots.append(slot_counts(s) if len(s) else None)
                np.add.at(sketch, _buckets(s), 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(slots, pa.binary()),
                 pa.nulls(len(n), pa.list_(pa.int32()))], schema=_INFO_ARROW)
        if sketch.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([np.minimum(sketch, 2**31 - 1).astype(np.int32)], pa.list_(pa.int32()))], schema=_INFO_ARROW)
    return run


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefixes(k: int, num: int, den: int, sketch_var):
    def run(batches):
        shingler, sketch, seen = Shingler(k), sketch_var.value, set()
        mean = sketch.mean()
        hot = mean + 10 * mean ** 0.5 + 100_000
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                s = shingler.shingles(text)
                if not len(s):
                    continue
                node = set_key(s)
                if node in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(node)
                f = sketch[_buckets(s)]
                order = np.lexsort((s, f))[:prefix_length(len(s), num, den)]
                p = len(order)
                places = (1 << PLACES) - 1
                key = (s[order] & ~np.uint64(2 * places + 1)) | ((f[order] > hot).astype(np.uint64) << np.uint64(PLACES)) \
                    | np.minimum(np.arange(p), places).astype(np.uint64)
                out.append((key.view(np.int64), np.full(p, node, np.int64), np.full(p, len(s), np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_PREFIX_ARROW)
    return run


def _sets(k: int, bitmap_var):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        shingler = Shingler(k)
        bits = np.frombuffer(bitmap_var.value, dtype=np.uint8)
        for b in batches:
            at = b.column("bit").to_numpy(zero_copy_only=False)
            keep = (at < 0) | ((bits[np.maximum(at, 0) >> 3] >> (at & 7)) & 1 == 1)
            texts = b.column("text").filter(pa.array(keep.astype(bool))).to_pylist()
            sets = [s for s in map(shingler.shingles, texts) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)
    return run


def suffix_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower bounds of the number of elements in one of two sets only, from rows of slot counts."""
    return np.abs(x.astype(np.int64) - y.astype(np.int64)).sum(axis=-1)


def _suffix_filter(num: int, den: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SLOTS) for c in ("xs", "ys"))
            n = b.column("xn").to_numpy().astype(np.int64) + b.column("yn").to_numpy()
            need = -(-num * n // (num + den))
            pairs = pa.RecordBatch.from_arrays([b.column("src"), b.column("dst")], schema=schema)
            yield pairs.filter(pa.array(suffix_bound(x, y) <= n - 2 * need))
    return run


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x & y| >= num * |x | y| for sorted sets without repeats."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    inter = int((y[at] == x).sum())
    return den * inter >= num * (len(x) + len(y) - inter)


def _verify(num: int, den: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):
        for b in batches:
            x, y = b.column("x"), b.column("y")
            ok = [similar(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), num, den) for i in range(len(b))]
            t = pa.RecordBatch.from_arrays([b.column("src"), b.column("dst")], schema=schema)
            yield t.filter(pa.array(ok, pa.bool_()))
    return run


class JaccardJoin:
    """The join over one table of documents (doc_id, text)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, k: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD):
        self.spark, self.k, (self.num, self.den) = prepare(spark), k, threshold
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def _describe(self) -> None:
        info = stage_table(self.spark, self.docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe(self.k), _INFO), "info")
        counts = (info.where("n < 0").select(F.posexplode("sketch").alias("bucket", "c"))
                  .where("c > 0").groupBy("bucket").agg(F.sum("c").alias("c")).collect())  # 2^SKETCH_BITS rows at most
        self.sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for r in counts:
            self.sketch[r["bucket"]] = r["c"]
        self.info = info.where("n >= 0").select("doc_id", "text_key", "n", "node", "slots")
        reps = self.info.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("slots").alias("slots"))
        self.reps = stage_table(self.spark, reps, "reps")

    def _shared_prefixes(self) -> DataFrame:
        """Prefix rows whose shingle another set's prefix holds too, with the
        share of the row's prefix that is shared (``central``)."""
        sketch = self.spark.sparkContext.broadcast(self.sketch)
        rows = self.docs.select("text").mapInArrow(_prefixes(self.k, self.num, self.den, sketch), _PREFIX)
        # Frequent shingles are kept whatever their rows and go by set; the others meet by shingle.
        frequent = F.col("key").bitwiseAND(1 << PLACES) != 0
        token = F.shiftrightunsigned("key", PLACES + 1)
        rows = rows.repartition(F.when(frequent, F.xxhash64("node")).otherwise(token)).select(
            F.when(frequent, F.xxhash64("node")).otherwise(token).alias("place"), token.alias("token"), "node", "n",
            F.col("key").bitwiseAND((1 << PLACES) - 1).cast("int").alias("pos"), frequent.alias("frequent"))
        w = W.partitionBy("place")
        by_size = w.orderBy("n", "node")
        rows = rows.withColumns({
            "lo": F.min("node").over(w), "hi": F.max("node").over(w), "rows": F.count(F.lit(1)).over(w),
            "n_before": F.lag("n").over(by_size), "n_after": F.lead("n").over(by_size),
            "left": F.coalesce(F.lag(F.col("n") - F.col("pos")).over(by_size), F.lead(F.col("n") - F.col("pos")).over(by_size))})
        # The rows next to a row in order of size are the first to pass the length filter;
        # of two rows alone, both filters are known here.
        near = ((self.den * F.col("n_before") >= self.num * F.col("n")) | (self.den * F.col("n") >= self.num * F.col("n_after")))
        need = F.ceil(F.lit(self.num) * (F.col("n") + F.coalesce("n_before", "n_after")) / F.lit(self.num + self.den))
        pair = (F.col("rows") > 2) | (F.least(F.col("n") - F.col("pos"), "left") >= need)
        shared = (rows.where(F.col("frequent") | ((F.col("lo") != F.col("hi")) & near & pair))
                  .select("token", "node", "n", "pos").dropDuplicates(["token", "node"]))
        shared = stage_table(self.spark, shared, "shared")
        length = F.col("n") - F.ceil(F.col("n") * self.num / F.lit(self.den)) + 1
        central = shared.groupBy("node").agg((F.count(F.lit(1)) / F.max(length)).alias("central"))
        rows = stage_table(self.spark, shared.join(central, "node"), "central")
        drop_staged(self.spark, shared)
        return rows

    def _may_link(self, a: str, b: str):
        """Length and positional filter for two prefix rows of one shingle."""
        an, bn = F.col(f"{a}.n"), F.col(f"{b}.n")
        need = F.ceil(F.lit(self.num) * (an + bn) / F.lit(self.num + self.den))
        return ((self.den * F.least(an, bn) >= self.num * F.greatest(an, bn))
                & (F.least(an - F.col(f"{a}.pos"), bn - F.col(f"{b}.pos")) >= need))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes (src, dst) that reach the threshold."""
        side = [self.reps.select(F.col("node").alias(e), F.col("n").alias(f"{v}n"), F.col("slots").alias(f"{v}s"))
                for e, v in (("src", "x"), ("dst", "y"))]
        near = pairs.join(side[0], "src").join(side[1], "dst").select("src", "dst", "xn", "xs", "yn", "ys")
        pairs = stage_table(self.spark, near.mapInArrow(_suffix_filter(self.num, self.den), "src bigint, dst bigint"), "near")
        nodes = pairs.select(F.col("src").alias("node")).unionAll(pairs.select("dst")).distinct()
        ids = self.reps.join(nodes, "node", "left_semi")
        bitmap = self.spark.sparkContext.broadcast(id_bitmap(ids, "rep"))
        # rows without an id are always looked at
        bit = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bitmap_bit("doc_id"))
        sets = (self.docs.select("text", bit.alias("bit"))
                .mapInArrow(_sets(self.k, bitmap), "node bigint, shingles binary")
                .groupBy("node").agg(F.first("shingles").alias("shingles")))
        sets = stage_table(self.spark, sets, "sets")
        both = (pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("x")), "src")
                .join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("y")), "dst")
                .select("src", "dst", "x", "y"))
        links = stage_table(self.spark, both.mapInArrow(_verify(self.num, self.den), "src bigint, dst bigint"), "links")
        drop_staged(self.spark, sets, pairs)
        return links

    def run(self) -> DataFrame:
        """The rows of ``jaccard_groups``."""
        self._describe()
        rows = self._shared_prefixes()
        links, done, comp = None, None, None
        for step in range(CENTRAL_ROUNDS + 1):
            # Only what a step reads travels: before the first links a row is a component of its own.
            if comp is None:
                labelled = rows.select("token", "node", "n", "pos")
                apart = F.col("a.node") != F.col("b.node")
            else:
                labels = (self.reps.select("node").join(comp.withColumnRenamed("id", "node"), "node", "left")
                          .select("node", F.coalesce("component", "node").alias("comp")))
                labelled = rows.select("token", "node", "n", "pos").join(labels, "node")
                apart = F.col("a.comp") < F.col("b.comp") if step == CENTRAL_ROUNDS else F.col("a.comp") != F.col("b.comp")
            if step < CENTRAL_ROUNDS:  # each row with one central row of its shingle, another one each round
                ranked = rows if step == 0 else labelled
                rank = F.struct(F.col("central") if step == 0 else F.xxhash64("node", F.lit(step)), "node")
                pivot = ranked.groupBy("token").agg(F.max_by(F.struct(*(c for c in labelled.columns if c != "token")), rank).alias("p"))
                met = labelled.alias("a").join(pivot.select("token", "p.*").alias("b"), "token")
            else:
                open_ = (labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                         .where("lo != hi").select("token"))
                left = stage_table(self.spark, labelled.join(open_, "token", "left_semi"), "open")
                met = left.alias("a").join(left.alias("b"), "token")
            pairs = (met.where(apart & self._may_link("a", "b"))
                     .select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct())
            if done is not None:
                pairs = pairs.join(done, ["src", "dst"], "left_anti")
            pairs = stage_table(self.spark, pairs, "pairs")
            if step == CENTRAL_ROUNDS:
                drop_staged(self.spark, rows, left)
            found = self._verified(pairs)
            done = pairs if done is None else done.unionAll(pairs)
            links = found if links is None else links.unionAll(found)
            comp = connected_components(self.spark, links)
        # A component is known by one of its sets; its least id is looked up once per component.
        comp = comp.withColumnRenamed("id", "node")
        least = comp.join(self.reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
        joined = stage_table(self.spark, comp.join(least, "component"), "components")
        out = self.info.join(self.reps.select("node", "rep"), "node", "left").join(joined, "node", "left")
        return out.select("doc_id", "text_key", F.col("n").cast("bigint").alias("n_shingles"),
                          F.coalesce("least", "rep", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("group"))


def jaccard_groups(spark: SparkSession, docs: DataFrame, k: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, group) per row: ``text_key`` is xxhash64 of the text, ``group`` names
    the component also where it has no id, and is null for texts without words."""
    return JaccardJoin(spark, docs, k, threshold).run()


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = SHINGLE_WORDS,
                       threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document row."""
    return jaccard_groups(spark, docs, k, threshold).select("doc_id", "n_shingles", "component_id")
