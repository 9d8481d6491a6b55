"""Language ID by multilingual mixture inference.

A language is a distribution over hashed letter trigrams. A document is a
mixture of languages: expectation-maximisation estimates the proportions from
the likelihoods of its trigrams, and the set of languages is grown one at a
time while the log-likelihood rises by more than a penalty (a multiple of the
BIC's half log n per added proportion). The log-likelihood is concave in the
proportions, so the slope towards a language bounds what adding it can gain;
expectation-maximisation runs only for documents where that bound passes the
penalty.

Training reads a bounded sample: the texts of at most ``TRAIN_DOCS`` documents
per language, chosen by a hash of the id, with the languages' sizes counted
over all training rows. Language, source and id are never inputs of a prediction.

Defined results: null text, or text without a letter, is ``und`` with score 0.
Without any training row everything is ``und``. Ties go to the language first
in alphabetical order. Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, prepare

BUCKETS = 1 << 15
TRAIN_DOCS = 1500  # per language: the documented bound of the training sample
FOLDS, HELD_OUT = 4, 2
EM_ROUNDS = 15
PENALTY = 4.0  # times half log n
SLICE_CHARS = 400_000

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, langs string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                    ("score", pa.float64()), ("langs", pa.string())])


@dataclass
class LanguageModel:
    langs: list[str]
    p: np.ndarray  # buckets x languages


def trigram_buckets(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text; runs of other characters are one space."""
    s = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int64)


def _count(batches):
    """Trigram counts of a task's texts by language."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("c", pa.int64())])
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            np.add.at(sums[lang], trigram_buckets(text), 1)
    for lang, c in sums.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some])], schema=schema)


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> LanguageModel:
    """Fit from ``docs`` (doc_id, text, lang); one row per language is
    collected, then the sample's trigram counts (languages x BUCKETS at most), summed in Spark."""
    rows = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    # A hash threshold per language: no shuffle, and about per_language rows each.
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / sizes[lang]))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    counts = np.zeros((BUCKETS, len(langs)))
    at = {lang: i for i, lang in enumerate(langs)}
    sums = (rows.where(draw < share).select("lang", "text").mapInArrow(_count, "lang string, bucket int, c bigint")
            .groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow())
    lang = np.array([at[v] for v in sums["lang"].to_pylist()], dtype=np.int64)
    counts[sums["bucket"].to_numpy(), lang] = sums["c"].to_numpy()
    counts += 0.5 * counts.sum(axis=1, keepdims=True) / max(1.0, counts.sum()) + 1e-2
    return LanguageModel(langs, counts / counts.sum(axis=0))


def _em(p: np.ndarray, c: np.ndarray, start: np.ndarray, size: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document and their log-likelihood. ``p``: likelihood of
    each distinct trigram (rows, by document) under each language."""
    doc = np.repeat(np.arange(len(size)), size)
    n = np.add.reduceat(c, start)
    for _ in range(EM_ROUNDS):
        part = p * pi[doc]
        part *= (c / part.sum(axis=1))[:, None]
        pi = np.add.reduceat(part, start, axis=0) / n[:, None]
    ll = np.add.reduceat(c * np.log((p * pi[doc]).sum(axis=1)), start)
    return pi, ll


def mixtures(model: LanguageModel, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, posterior of the best single language) for documents given as trigram buckets."""
    n_docs, n_langs = len(grams), len(model.langs)
    key, count = np.unique(np.repeat(np.arange(n_docs), [len(g) for g in grams]) * BUCKETS + np.concatenate(grams), return_counts=True)
    doc, c = key // BUCKETS, count.astype(np.float64)
    p = model.p[key % BUCKETS]
    size = np.bincount(doc, minlength=n_docs)
    start = np.r_[0, np.cumsum(size)[:-1]]
    n = np.add.reduceat(c, start)
    single = np.add.reduceat(c[:, None] * np.log(p), start, axis=0)
    best = single.argmax(axis=1)
    ll = single[np.arange(n_docs), best]
    sure = 1.0 / np.exp(np.minimum(0.0, single - ll[:, None])).sum(axis=1)
    pi = np.zeros((n_docs, n_langs))
    pi[np.arange(n_docs), best] = 1.0
    penalty = PENALTY * 0.5 * np.log(np.maximum(n, 2.0))
    todo = np.arange(n_docs)
    for _ in range(n_langs - 1):
        rows = np.concatenate([np.arange(start[d], start[d] + size[d]) for d in todo])
        s = size[todo]
        at = np.r_[0, np.cumsum(s)[:-1]]
        pp, cc = p[rows], c[rows]
        own = np.repeat(np.arange(len(todo)), s)
        slope = np.add.reduceat(pp * (cc / (pp * pi[todo][own]).sum(axis=1))[:, None], at, axis=0) - n[todo][:, None]
        slope[pi[todo] > 0] = -np.inf
        add = slope.argmax(axis=1)
        open_ = slope[np.arange(len(todo)), add] > penalty[todo]
        if not open_.any():
            break
        todo, add = todo[open_], add[open_]
        keep = open_[own]
        pp, cc, s = pp[keep], cc[keep], size[todo]
        at = np.r_[0, np.cumsum(s)[:-1]]
        trial = pi[todo] * 0.8
        trial[np.arange(len(todo)), add] = 0.2
        got, value = _em(pp, cc, at, s, trial)
        won = value - ll[todo] > penalty[todo]
        pi[todo[won]], ll[todo[won]] = got[won], value[won]
        todo = todo[won]
        if not len(todo):
            break
    return pi, sure


def _predict(model_var):
    def judge(texts: list[str | None]) -> list[tuple[str, float, str]]:
        model = model_var.value
        out: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(texts)
        if not model.langs:
            return out
        grams, rows, chars = [], [], 0

        def flush():
            pi, sure = mixtures(model, grams)
            top = pi.argmax(axis=1)
            for r, q, t, s in zip(rows, pi, top, sure):
                named = ",".join(f"{model.langs[j]}:{q[j]:.3f}" for j in np.argsort(-q, kind="stable") if q[j] > 0)
                out[r] = (model.langs[t], float(min(1.0, q[t] * s)), named)
            grams.clear()
            rows.clear()
        for i, text in enumerate(texts):
            g = trigram_buckets(text) if text else np.zeros(0, dtype=np.int64)
            if not len(g) or not any(ch.isalpha() for ch in text):
                continue
            grams.append(g)
            rows.append(i)
            chars += len(g)
            if chars > SLICE_CHARS:
                flush()
                chars = 0
        if grams:
            flush()
        return out

    def run(batches):
        for b in batches:
            lang, score, named = zip(*judge(b.column("text").to_pylist())) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(named, pa.string())], schema=_ARROW)
    return run


def identify(spark: SparkSession, docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs) for every row; learns from the folds that are not held out."""
    prepare(spark)
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    model = spark.sparkContext.broadcast(train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull())))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), _SCHEMA)
