"""Quality classifier: random-indexing word vectors, pooled, in a two-layer network.

Every token bucket has a sparse random ternary index vector. A bucket's word
vector is the normalised sum of the index vectors seen around it in the
training texts, plus its own. A document is the mean of its tokens' vectors and
that mean's length (large where few words repeat). A network with one hidden
layer, in numpy, scores it; a temperature fitted on a part of the sample it was
not trained on calibrates the probability, and the classes' shares over all
labels set the prior.

Tokens are words (lower-cased, an extra mark for words in capitals), digit runs
and runs of other marks. The model is fitted on at most ``TRAIN_DOCS`` labelled
documents, half per class where there are enough, chosen by a hash of the id.

Defined results: null text counts as empty, and an empty text has a score (of
the zero vector). Labels that are null or whose id is null do not count; rows
of one id with several labels all do. With one class only the score is that
class's share, without labels 0.5. Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, give_back, least_hashed, prepare

TRAIN_DOCS = 5000  # the documented bound of the labelled sample
BUCKETS = 1 << 15
DIM = 64
NONZERO = 8
NEAR = 2  # tokens to either side
HIDDEN = 32
EPOCHS = 400
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
SEED = 7

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MAX_CACHE = 200_000
_buckets: dict[str, bytes] = {}


@dataclass
class QualityModel:
    words: np.ndarray | None  # buckets x DIM
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0
    offset: float = 0.0
    constant: float = 0.5


def token_buckets(text: str | None) -> np.ndarray:
    """Buckets of the tokens of a text, in order."""
    tokens = _TOKEN.findall(text or "")
    if len(_buckets) > _MAX_CACHE:
        _buckets.clear()
    try:
        packed = b"".join([_buckets[t] for t in tokens])
    except KeyError:
        for t in tokens:
            if t not in _buckets:
                names = [t.lower()] + (["\x00capitals"] if len(t) > 1 and t.isupper() else [])
                _buckets[t] = b"".join((zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS).to_bytes(4, "little") for x in names)
        packed = b"".join([_buckets[t] for t in tokens])
    return np.frombuffer(packed, dtype=np.int32)


def index_vectors() -> np.ndarray:
    """The sparse random ternary vectors, the same on every run."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    at = rng.integers(0, DIM, size=(BUCKETS, NONZERO))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.float32), size=at.shape), axis=1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_vectors(docs: list[np.ndarray]) -> np.ndarray:
    index = index_vectors()
    context = np.zeros((BUCKETS, DIM), dtype=np.float64)
    for ids in docs:
        if len(ids) < 2:
            continue
        x = index[ids]
        near = np.zeros_like(x)
        for d in range(1, NEAR + 1):
            near[d:] += x[:-d]
            near[:-d] += x[d:]
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        context[ids[order][first]] += np.add.reduceat(near[order], first, axis=0)
    return (_unit(context) + _unit(index)).astype(np.float32)


def pooled(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(DIM + 1)
    if len(ids):
        total = np.zeros(DIM, dtype=np.float64)
        for a in range(0, len(ids), 20_000):
            total += words[ids[a:a + 20_000]].sum(axis=0, dtype=np.float64)
        out[:DIM] = total / len(ids)
        out[DIM] = np.linalg.norm(out[:DIM])
    return out


def _logits(m: QualityModel, x: np.ndarray) -> np.ndarray:
    h = np.tanh((x - m.mean) / m.scale @ m.w1 + m.b1)
    return h @ m.w2 + m.b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, model: QualityModel) -> QualityModel:
    """Full-batch Adam on four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(SEED)
    cal = np.arange(len(y)) % 5 == 4
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moment, spread = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    xs, ys = ((x - model.mean) / model.scale)[~cal], y[~cal]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(xs @ w[0] + w[1])
        g = (_sigmoid(h @ w[2] + w[3][0]) - ys) / len(ys)
        dh = np.outer(g, w[2]) * (1 - h * h)
        grads = [xs.T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * d
            spread[i] = 0.999 * spread[i] + 0.001 * d * d
            w[i] = w[i] - 0.01 * (moment[i] / (1 - 0.9 ** t)) / (np.sqrt(spread[i] / (1 - 0.999 ** t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = w[0], w[1], w[2], float(w[3][0])
    z, yc = _logits(model, x[cal]), y[cal]
    if len(yc):
        grid = np.geomspace(0.25, 8.0, 61)
        loss = [-(yc * np.log(_sigmoid(z / t) + 1e-12) + (1 - yc) * np.log(1 - _sigmoid(z / t) + 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _tokens(batches):
    schema = pa.schema([("quality", pa.int32()), ("o", pa.int64()), ("tokens", pa.binary())])
    for b in batches:
        tokens = [token_buckets(t).astype(np.uint16).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("o"), pa.array(tokens, pa.binary())], schema=schema)
    _buckets.clear()
    give_back()


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> QualityModel:
    """``labels`` (doc_id, quality) without the held-out fold. Shares are counted
    over all labels; ``n_docs`` ids at most, then their texts, are collected."""
    labels = labels.where("doc_id is not null and quality in (0, 1)")
    shares = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return QualityModel(None, constant=float(next(iter(shares))) if total else 0.5)
    sample = None
    for q in (0, 1):
        some = least_hashed(labels.where(F.col("quality") == q).select("doc_id", "quality"), ["doc_id"], n_docs // 2, shares[q])
        sample = some if sample is None else sample.unionAll(some)
    # At most n_docs rows of two numbers: the bound of this broadcast.
    texts = docs.join(F.broadcast(sample), "doc_id").select(F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("o"), "text")
    # Tokens are cut in the tasks; two bytes a token reach the driver, all in one job.
    rows = texts.mapInArrow(_tokens, "quality int, o bigint, tokens binary").toArrow().sort_by([("o", "ascending"), ("quality", "ascending"), ("tokens", "ascending")])
    ids = [np.frombuffer(t, dtype=np.uint16).astype(np.int32) for t in rows["tokens"].to_pylist()]
    y = rows["quality"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return QualityModel(None, constant=shares[1] / total)
    model = QualityModel(word_vectors(ids))
    model = fit_network(np.stack([pooled(model.words, i) for i in ids]), y, model)
    in_sample = y.mean()
    model.offset = float(np.log(shares[1] / shares[0]) - np.log(in_sample / (1 - in_sample)))
    return model


def _score(model_var, name: str):
    def run(batches):
        m = model_var.value
        for b in batches:
            if m.words is None:
                s = np.full(len(b), m.constant)
            else:
                x = np.stack([pooled(m.words, token_buckets(t)) for t in b.column("text").to_pylist()]) if len(b) else np.zeros((0, DIM + 1))
                s = _sigmoid(_logits(m, x) / m.temperature + m.offset)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])
        _buckets.clear()  # a worker goes on to other stages; what it remembers is for one task
        give_back()
    return run


def score_documents(spark: SparkSession, docs: DataFrame, labelled: DataFrame, labels: DataFrame,
                    folds: int = FOLDS, held_out: int = HELD_OUT, name: str = "score") -> DataFrame:
    """``docs`` with their score in the new column ``name``. The classifier learns from the texts of
    ``labelled`` (doc_id, text) joined to ``labels``, held-out fold excluded."""
    prepare(spark)
    keys = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    texts = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(spark, texts, keys.where(fold_of(F.col("doc_id"), folds) != held_out)))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score(model, name), schema)


def quality_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_documents(spark, base, docs, labels).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
