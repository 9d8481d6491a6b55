"""Incremental reputation refresh on Structured Streaming, by additive parts.

The stream decodes all four event kinds (registrations, URI updates, feedback,
revocations). A micro-batch appends to two tables and rewrites nothing:

* ``events`` (by kind, month and batch): the decoded events that no earlier batch
  had, keyed by (transaction_hash, log_index);
* ``parts`` (by batch): what the batch adds to the sums of each (agent, client,
  time of feedback). Feedback that some revocation names adds nothing;
  a revocation of feedback that earlier batches counted subtracts it again.

A log that arrives twice, late or in a replayed batch counts once, in whatever
order files come, and nothing is dropped by age. A log keeps its time, so a batch
looks for its own logs in the stored keys of its months only; stored feedback is
read only for new revocations. Each batch overwrites its own partitions and reads
only those of others, so a batch that failed half-way and runs again ends the same.

The decay weight factorises over whole days:
    0.5^((T - d)/H) = 0.5^((T - A)/H) * 0.5^((A - d)/H)
for any fixed anchor day A, so the score at any snapshot T follows from the
anchored sums by one scalar factor.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from ..config import DEFAULT_CONFIG, SUMMARY_COLUMNS, ScoreConfig
from ..functions.scoring import clamp01, is_negative, is_neutral, is_positive
from ..operators import decode as D
from ..operators.latest import earliest_per_key, latest_per_key
from ..operators.rank import rank_agents
from ..operators.score import as_of_col, score_agents
from ..sources.logs import LOG_SCHEMA
from ..sources.snapshot import file_system

ANCHOR = "2024-01-01"

EVENT_KEY = ["transaction_hash", "log_index"]
VOTE_KEY = ["agent_id", "client_address", "feedback_index"]
EVENT_COLUMNS = [*VOTE_KEY, "score", "owner_address", "uri", "at", *EVENT_KEY]
EVENTS = ("agent_id bigint, client_address string, feedback_index bigint, score double, owner_address string, uri string, "
          "at timestamp, transaction_hash string, log_index bigint, kind string, month string, batch string")
PARTS = ("agent_id bigint, client_address string, at timestamp, n bigint, sw0 double, swq0 double, sq100 decimal(38,9), "
         "nq bigint, pos bigint, neu bigint, neg bigint, batch string")
ADDITIVE = ["n", "sw0", "swq0", "sq100", "nq", "pos", "neu", "neg"]



def bronze_schema() -> StructType:
    return StructType(list(LOG_SCHEMA.fields) + [
        StructField("topic0", StringType(), True),
        StructField("topic_count", IntegerType(), True),
        StructField("block_date", DateType(), True),
    ])


def decode_events(logs: DataFrame, since: str | None = None) -> DataFrame:
    """All decoded events in one layout (columns that a kind lacks are null)."""
    parts = {
        "registered": D.registrations(logs, since).selectExpr(
            "agent_id", "owner_address", "reg_uri AS uri", "registered_at AS at", "registered_tx AS transaction_hash", "log_index"),
        "uri": D.uri_updates(logs, since).selectExpr(
            "agent_id", "new_uri AS uri", "block_timestamp AS at", *EVENT_KEY),
        "feedback": D.decode_feedback(logs, since, log_index=True).selectExpr(
            "agent_id", "client_address", "feedback_index", "score", "created_at AS at", "feedback_tx AS transaction_hash", "log_index"),
        "revoked": D.decode_revocations(logs, since).selectExpr(
            "agent_id", "client_address", "feedback_index", "revoked_at AS at", *EVENT_KEY),
    }
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.where("agent_id IS NOT NULL").select(*EVENT_COLUMNS, "kind", F.date_format("at", "yyyy-MM").alias("month"))


def feedback_parts(feedback: DataFrame, cfg: ScoreConfig, sign: int = 1, anchor: str = ANCHOR) -> DataFrame:
    """Additive sums by (agent, client, time of feedback), weights anchored at ``anchor``; all negative for ``sign`` -1."""
    q = clamp01(F.col("score") / F.lit(100.0))
    w0 = F.pow(F.lit(0.5), F.datediff(F.to_date(F.lit(anchor)), F.to_date("at")) / F.lit(cfg.half_life_days))
    scored = feedback.select("agent_id", "client_address", "at", q.alias("q"), w0.alias("w0"))
    sums = scored.groupBy("agent_id", "client_address", "at").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w0").alias("sw0"),
        F.sum(F.col("w0") * F.col("q")).alias("swq0"),
        F.sum((F.col("q") * 100.0).cast("decimal(20,9)")).alias("sq100"),
        F.count("q").alias("nq"),
        F.count_if(is_positive("q")).alias("pos"),
        F.count_if(is_neutral("q")).alias("neu"),
        F.count_if(is_negative("q")).alias("neg"),
    )
    return sums.select("agent_id", "client_address", "at",
                       *[(F.col(c) * F.lit(sign)).cast("decimal(38,9)" if c == "sq100" else sums.schema[c].dataType).alias(c) for c in ADDITIVE])


# ---------------------------------------------------------------------------
# State folders: <root>/events/kind=/month=/batch=, <root>/parts/batch=
# ---------------------------------------------------------------------------

def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored rows under ``path``; none if nothing was written yet."""
    fs, folder = file_system(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(folder) else spark.createDataFrame([], schema)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/events", EVENTS)


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/parts", PARTS)


def _write(df: DataFrame, path: str, batch: str, *by: str) -> None:
    """Replace the partitions of ``batch`` that ``df`` has rows for."""
    (df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by, "batch").parquet(path))


def merge_batch(logs: DataFrame, root: str, cfg: ScoreConfig, batch: str) -> None:
    """Add one micro-batch of logs, named ``batch``, to the state under ``root``."""
    spark = logs.sparkSession
    decoded = decode_events(logs, cfg.since)
    months = [r[0] for r in decoded.select("month").distinct().collect()]  # one row a calendar month
    if not months:
        return
    known = read_events(spark, root).where(F.col("batch") != batch)
    new = (decoded.dropDuplicates(EVENT_KEY)
           .join(known.where(F.col("month").isin(months)).select(*EVENT_KEY), EVENT_KEY, "left_anti")
           .select(*decoded.columns))
    _write(new.hint("rebalance", "kind", "month"), f"{root}/events", batch, "kind", "month")

    stored = read_events(spark, root)

    def of(kind, mine):
        return stored.where((F.col("kind") == kind) & ((F.col("batch") == batch) if mine else (F.col("batch") != batch)))
    parts = feedback_parts(D.drop_revoked(of("feedback", True), stored.where("kind = 'revoked'")), cfg)
    revoked = of("revoked", True).select(*VOTE_KEY).distinct()
    if not revoked.isEmpty():
        counted = D.drop_revoked(of("feedback", False).join(revoked, VOTE_KEY, "left_semi"), of("revoked", False))
        parts = parts.unionByName(feedback_parts(counted, cfg, -1))
    _write(parts, f"{root}/parts", batch)


def start_refresh(spark: SparkSession, bronze_path: str, state_root: str, checkpoint: str,
                  cfg: ScoreConfig = DEFAULT_CONFIG, files_per_batch: int | None = None):
    """Run the stream over every bronze file not yet processed (availableNow)."""
    root = state_root.rstrip("/")
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]  # batch numbers are those of a checkpoint
    reader = spark.readStream.schema(bronze_schema())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.parquet(bronze_path).writeStream
            .foreachBatch(lambda batch, batch_id: merge_batch(batch, root, cfg, f"{stream}-{batch_id}"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def latest_agents(spark: SparkSession, state_root: str) -> DataFrame:
    """One row per agent: identity (null if unregistered) and anchored sums (null without feedback)."""
    root = state_root.rstrip("/")
    events = read_events(spark, root)
    reg = earliest_per_key(
        events.where("kind = 'registered'").withColumnsRenamed({"uri": "reg_uri", "at": "registered_at", "transaction_hash": "registered_tx"}),
        "agent_id", ["registered_at", "log_index"], ["owner_address", "reg_uri", "registered_at", "registered_tx"])
    upd = latest_per_key(events.where("kind = 'uri'").withColumnRenamed("uri", "new_uri").withColumnRenamed("at", "block_timestamp"),
                         "agent_id", ["block_timestamp", "log_index"], ["new_uri"])
    # Sums per time first: what was revoked whole leaves no rest and no time behind.
    times = (read_parts(spark, root).groupBy("agent_id", "client_address", "at").agg(*[F.sum(c).alias(c) for c in ADDITIVE])
             .where("n > 0"))
    clients = times.groupBy("agent_id", "client_address").agg(*[F.sum(c).alias(c) for c in ADDITIVE], F.max("at").alias("last_at"))
    sums = clients.groupBy("agent_id").agg(
        F.count("client_address").alias("clients"), *[F.sum(c).alias(c) for c in ADDITIVE], F.max("last_at").alias("last_at"))
    return D.resolve_identity(reg, upd).join(sums, "agent_id", "full")


def summary_from_state(agents: DataFrame, cfg: ScoreConfig = DEFAULT_CONFIG, anchor: str = ANCHOR) -> DataFrame:
    """Re-base the anchored sums to ``cfg.as_of`` and build the ranked summary."""
    factor = F.pow(F.lit(0.5), F.datediff(F.to_date(as_of_col(cfg)), F.to_date(F.lit(anchor))) / F.lit(cfg.half_life_days))
    agg = agents.where("n IS NOT NULL").select(
        "agent_id",
        F.col("n").cast("bigint").alias("feedback_count"),
        F.col("clients").cast("bigint").alias("unique_clients"),
        (F.col("sw0") * factor).alias("eff_n"),
        F.try_divide("swq0", F.nullif("sw0", F.lit(0.0))).alias("wq"),
        F.col("last_at").alias("last_feedback_at"),
        F.col("pos").cast("bigint").alias("positive_count"),
        F.col("neu").cast("bigint").alias("neutral_count"),
        F.col("neg").cast("bigint").alias("negative_count"),
        F.try_divide("sq100", "nq").alias("avg_raw_score"),
    )
    identity = agents.where("registered_at IS NOT NULL").select("agent_id", "owner_address", "token_uri", "registered_at", "registered_tx")
    ranked = rank_agents(score_agents(identity, agg, cfg))
    return ranked.select(
        *[c for c in SUMMARY_COLUMNS if c not in ("rank", "x402", "computed_at")], "rank",
        F.lit(False).alias("x402"), as_of_col(cfg).alias("computed_at")).select(*SUMMARY_COLUMNS)


__all__ = ["start_refresh", "merge_batch", "latest_agents", "summary_from_state", "decode_events", "feedback_parts"]
