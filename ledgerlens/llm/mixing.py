"""Mixing sources to target weights, in DataFrame operations only.

Documents fall into cells (source, language, topic); a cell's weight is its
share of all tokens. Iterative proportional fitting rakes the cell weights in
turn to the target marginals of source, language and topic until every marginal
meets its target but for a relative ``TOLERANCE``. Targets that contradict each
other on the cells present cannot all be met: raking then ends when eight rounds
no longer lower the largest error by 0.2 %, and :func:`marginals` of the fit
reports target and reached weight of every value.

A document is kept with the probability of its cell: fitted weight over present
share, times a common factor. By default that factor is the largest that keeps all
probabilities at 1 or below, which gives the largest sample whose expected token
mixture is the fitted one without repeating any document; its size then depends on
the scarcest cell. ``share`` sets the size instead, as a part of all tokens: cells
that would need a probability above 1 are kept whole (``short`` is true there), and
all others have exactly their fitted weights. The draw compares the probability
with a hash of the id, so it is the same on every run.

Targets are a rule, not a list, so that new sources need no new parameter: the
marginal share to the power ``alpha`` (below 1 flattens), made to sum to 1.
Explicit targets can be given per dimension instead.

The fit runs on the table of cells (sources x languages x topics rows, already
summed before any shuffle), never on documents. Up to ``ONE_TASK`` cells it runs in
one task without a shuffle, beyond that in windows over the cluster; both give the
same weights.

Defined results: null source or language is a value of its own (``none``);
null text has no tokens and topic ``prose``. Documents without tokens take the
probability of their cell (0 if the whole cell has no tokens). Rows with one id
are drawn together. Extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_staged, stage_table

DIMS = ("source", "lang", "topic")
#: First pattern that occurs names the topic.
TOPICS = (("license", "(?i)licen[sc]ed? under|copyright"), ("contact", "@[a-z0-9]+[.]"), ("table", " [|] "))
ALPHA = 0.9
ROUNDS = 8  # between two looks at the errors
TOLERANCE = 1e-9
STALLED = 0.998
ONE_TASK = 100_000
DIGITS = 6  # of the probabilities in a report; draws use them unrounded
WORD = r"[^\x20\x09-\x0D]+"


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` with tokens, and source, lang and topic as cell keys (``c_`` columns)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    topic: Column = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        topic = F.when(text.rlike(pattern), F.lit(name)).otherwise(topic)
    return docs.withColumns({
        "tokens": F.regexp_count(text, F.lit(WORD)).cast("bigint"),
        "c_source": F.coalesce(F.col("source").cast("string"), F.lit("none")),
        "c_lang": F.coalesce(F.col("lang").cast("string"), F.lit("none")),
        "c_topic": topic,
    })


def with_targets(cells: DataFrame, alpha: float = ALPHA, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells with tokens, their ``share``, the targets ``t_<dim>`` of their values and ``weight``, at first the share.

    ``targets`` may give, per dimension, a table (value, target) in place of the rule.
    """
    df = cells.where("tokens > 0")
    total = df.agg(F.sum("tokens").alias("_total"))  # one row
    df = df.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("_total")).drop("_total")
    out = df
    for d in DIMS:
        if targets and d in targets:
            goal = targets[d].select(F.col("value").alias(f"c_{d}"), F.col("target").cast("double").alias(f"t_{d}"))
        else:
            powers = df.groupBy(f"c_{d}").agg(F.pow(F.sum("share"), F.lit(alpha)).alias("_m"))
            whole = powers.agg(F.sum("_m").alias("_all"))  # one row
            goal = powers.crossJoin(F.broadcast(whole)).select(f"c_{d}", (F.col("_m") / F.col("_all")).alias(f"t_{d}"))
        out = out.join(goal, f"c_{d}")
    return out.withColumn("weight", F.col("share"))


def rake(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``rounds`` times: weights scaled to the targets of each dimension in turn."""
    for _ in range(rounds):
        for d in DIMS:
            df = df.withColumn("weight", F.col("weight") * F.col(f"t_{d}") / F.sum("weight").over(W.partitionBy(f"c_{d}")))
    return df


def marginals(fitted: DataFrame) -> DataFrame:
    """(dim, value, target, reached) for every value of every dimension."""
    out = None
    for d in DIMS:
        part = fitted.groupBy(F.lit(d).alias("dim"), F.col(f"c_{d}").alias("value")).agg(
            F.first(f"t_{d}").alias("target"), F.sum("weight").alias("reached"))
        out = part if out is None else out.unionByName(part)
    return out


def fit(cells: DataFrame, alpha: float = ALPHA, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Raked weights of ``cells`` (c_source, c_lang, c_topic, tokens): adds ``share``, targets and ``weight``."""
    spark = cells.sparkSession
    df = stage_table(spark, with_targets(cells, alpha, targets), "targets")
    small = df.count() <= ONE_TASK
    before = float("inf")
    while True:
        raked = stage_table(spark, rake(df.coalesce(1) if small else df), "raked")
        drop_staged(spark, df)
        df = raked
        error = marginals(df).agg(F.max(F.abs(F.try_divide(F.col("reached") - F.col("target"), F.col("target"))))).first()[0]
        if error is None or error <= tolerance or error > STALLED * before:
            return df
        before = error


def probabilities(fitted: DataFrame, share: float | None = None) -> DataFrame:
    """The cells' probabilities ``p`` for a sample of ``share`` of all tokens (default: the largest without a short cell)."""
    ratio = F.col("weight") / F.col("share")
    if share is None:
        most = fitted.agg(F.max(ratio).alias("_most"))  # one row
        scaled = fitted.crossJoin(F.broadcast(most)).withColumn("p", ratio / F.col("_most")).drop("_most")
    else:
        scaled = fitted.withColumn("p", ratio * F.lit(float(share)))
    return scaled.withColumn("short", F.col("p") > 1.0 + 1e-9).withColumn("p", F.least(F.col("p"), F.lit(1.0)))


def mix(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA, share: float | None = None) -> DataFrame:
    """``docs`` with tokens, topic, probability and kept."""
    keyed = with_cells(docs)
    keys = [f"c_{d}" for d in DIMS]
    cells = stage_table(spark, keyed.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = stage_table(spark, probabilities(fit(cells, alpha), share).select(*keys, "p"), "fitted")
    # One row per cell; Spark chooses how to join by its measured size.
    joined = keyed.join(fitted, keys, "left")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    p = F.coalesce("p", F.lit(0.0))
    return (joined.withColumn("probability", p).withColumn("kept", draw < p).withColumn("topic", F.col("c_topic"))
            .drop(*keys, "p"))


def mix_report(spark: SparkSession, docs: DataFrame, share: float | None = None) -> DataFrame:
    return mix(spark, docs.select("doc_id", "text", "source", "lang"), share=share).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", DIGITS).alias("probability"), "kept")


def oracle_sql(rounds: int = 200) -> str:
    """DuckDB SQL of :func:`mix_report` over ``documents``; ``rounds`` is many more than the tables need."""
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    target = ", ".join(
        f"{d}_t AS (SELECT c_{d}, pow(sum(share), {ALPHA}) / sum(pow(sum(share), {ALPHA})) OVER () AS t_{d} FROM shares GROUP BY c_{d})" for d in DIMS)
    return f"""
    WITH RECURSIVE keyed AS (
      SELECT doc_id, source, lang, coalesce(source, 'none') AS c_source, coalesce(lang, 'none') AS c_lang,
             CASE {topic} ELSE 'prose' END AS c_topic,
             len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens
      FROM documents),
    cells AS (SELECT c_source, c_lang, c_topic, sum(tokens) AS tokens FROM keyed GROUP BY ALL HAVING sum(tokens) > 0),
    shares AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM cells),
    {target},
    w0 AS (SELECT s.*, share AS weight, t_source, t_lang, t_topic FROM shares s
           JOIN source_t USING (c_source) JOIN lang_t USING (c_lang) JOIN topic_t USING (c_topic)),
    raked AS (
      SELECT 0 AS r, c_source, c_lang, c_topic, share, t_source, t_lang, t_topic, weight FROM w0
      UNION ALL
      SELECT r + 1, c_source, c_lang, c_topic, share, t_source, t_lang, t_topic, weight * t_topic / sum(weight) OVER (PARTITION BY c_topic)
      FROM (SELECT * REPLACE (weight * t_lang / sum(weight) OVER (PARTITION BY c_lang) AS weight)
            FROM (SELECT * REPLACE (weight * t_source / sum(weight) OVER (PARTITION BY c_source) AS weight) FROM raked WHERE r < {rounds}))),
    fitted AS (SELECT c_source, c_lang, c_topic, (weight / share) / max(weight / share) OVER () AS p FROM raked WHERE r = {rounds})
    SELECT doc_id, source, lang, c_topic AS topic, tokens, round(coalesce(p, 0.0), {DIGITS}) AS probability,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 0.0) AS kept
    FROM keyed LEFT JOIN fitted USING (c_source, c_lang, c_topic)"""
