"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78: each phrase is the longest one
seen before plus one more symbol; symbols are runs of up to eight characters
without white space, so that words count and unspaced text is cut as well).
The set of phrases is
hashed, and a minimum-hash signature of ``HASHES`` 16-bit values stands for it
(16 bits of each minimum, mixed first: a minimum itself is small, the more so
the longer the text, and its own leading bits would tell little);
the likeness of two texts is the share of equal values, an estimate of the
Jaccard similarity of their phrase sets, as two texts compress well together
when they share phrases.

The neighbour query compares each document with an edited copy (second half
replaced by the next document's beginning) and with the next document, in
ascending doc_id. The order is made by ranges of ids that no task holds whole:
range bounds come from a pass over the ids alone, and the first document of
each range is also sent to the range before it, so every neighbour pair meets
in one task after a single shuffle of the texts. A range is read as a stream
that holds two documents at a time.

Defined results: null text counts as empty; the empty phrase set has a
fingerprint of its own. Rows with equal ids are neighbours in the order of
their texts; rows without an id come first. A single row is its own next
document. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .shingles import mix64

HASHES = 64
RANGE_ROWS = 4000
MAX_RANGES = 4096
_OUT_ROWS = 256

_SYMBOL = re.compile(r"\S{1,8}")
_MAX_CACHE = 300_000
_keys: dict[str, int] = {}

_rng = np.random.default_rng(11)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)

_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def symbols(text: str) -> list[int]:
    """64-bit keys of the symbols of a text, in order."""
    found = _SYMBOL.findall(text)
    if len(_keys) > _MAX_CACHE:
        _keys.clear()
    try:
        return [_keys[s] for s in found]
    except KeyError:
        for s in found:
            if s not in _keys:
                _keys[s] = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
        return [_keys[s] for s in found]


def phrases(text: str) -> set[int]:
    """Keys of the LZ78 phrases of a text; a phrase's key is made from the key of
    the phrase before it and its last symbol."""
    found: set[int] = set()
    add, node = found.add, 0
    for symbol in symbols(text):
        key = (node * 0x9E3779B97F4A7C15 + symbol) & 0xFFFFFFFFFFFFFFFF
        if key in found:
            node = key
        else:
            add(key)
            node = 0
    return found


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum-hash signature, 16 bits per value; of the empty set, all ones."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), 4096):
            x = hashes[a:a + 4096, None] * _A + _B
            x ^= x >> np.uint64(31)
            np.minimum(low, x.min(axis=0), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(">u2") if len(hashes) else np.full(HASHES, 0xFFFF, dtype=">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def sketch(text: str | None) -> np.ndarray:
    found = phrases(text or "")
    return signature(mix64(np.fromiter(found, dtype=np.uint64, count=len(found))))


def fingerprint(text: str | None) -> str:
    return sketch(text).tobytes().hex()


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


class _Doc:
    __slots__ = ("doc_id", "text", "sig")

    def __init__(self, doc_id, text):
        self.doc_id, self.text, self.sig = doc_id, text, sketch(text)

    def row(self, following: "_Doc") -> tuple:
        edited = edited_text(self.text, following.text)
        sig = sketch(edited)
        return (self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                self.sig.tobytes().hex(), sig.tobytes().hex(), likeness(self.sig, sig), likeness(self.sig, following.sig))


def _neighbours(batches):
    """Rows sorted by (range, ahead, doc_id, text): a range's own documents, then the one ahead of it."""
    last, last_range, rows = None, None, []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        rows.clear()
        return batch
    for b in batches:
        for rng, ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))):
            doc = _Doc(doc_id, text)
            if last is not None and rng == last_range:
                rows.append(last.row(doc))
            last, last_range = (None, None) if ahead else (doc, rng)
            if len(rows) >= _OUT_ROWS:
                yield out()
    if rows:
        yield out()


def compare_neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, the edited text's, and both likenesses."""
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.count()
    if not rows:
        return spark.createDataFrame([], _SCHEMA)
    ranges = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] if ranges > 1 else []
    cuts = sorted(set(cuts))  # range r holds the keys in (cuts[r-1], cuts[r]]
    place = F.lit(0) if not cuts else _search(key, cuts)
    placed = docs.withColumn("range", place)
    firsts = (placed.select("range", key.alias("k")).groupBy("range").agg(F.min("k").alias("k")).orderBy("range").collect())  # one row per range
    before = {r["k"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}  # the first range's first goes to the last range
    ahead_key = F.create_map(*[x for k, r in before.items() for x in (F.lit(k), F.lit(r))])
    is_first = key.isin(list(before))
    # Of several rows with a first id, only the first in text order is ahead of the range before.
    ahead = (placed.where(is_first).groupBy(key.alias("k")).agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
             .select("doc_id", "text", ahead_key[F.col("k")].alias("range"), F.lit(1).alias("ahead")))
    both = placed.withColumn("ahead", F.lit(0)).unionByName(ahead)
    width = max(len(firsts), 1)
    return (both.repartition(width, "range").sortWithinPartitions("range", "ahead", "doc_id", "text")
            .select("range", "ahead", "doc_id", "text").mapInArrow(_neighbours, _SCHEMA))


def _search(key, cuts: list[int]):
    """Number of cuts below ``key``, as a balanced tree of comparisons."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(cuts))
