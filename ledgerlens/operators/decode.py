"""Decode raw logs into typed registrations and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVENT_TOPICS, IDENTITY_REGISTRY, REPUTATION_REGISTRY, TOPIC
from ..functions import hexabi as H
from ..functions.hexabi import hex_to_long, topic_to_address
from ..sources.logs import scan_logs
from .latest import earliest_per_key, latest_per_key

ZERO_TOPIC = "0x" + "0" * 64


def event_topics(spark: SparkSession) -> DataFrame:
    """The (contract, event, topic0) catalogue, ordered."""
    return (spark.createDataFrame(EVENT_TOPICS, "contract string, event string, topic0 string")
            .orderBy("contract", "event"))


def _topic(i: int):
    return F.get(F.col("topics"), i)


def registrations(logs: DataFrame, since: str | None = None) -> DataFrame:
    """Registered events -> (agent_id, owner_address, reg_uri, registered_at, registered_tx, log_index)."""
    scan = scan_logs(logs, IDENTITY_REGISTRY, since, min_topics=3, topic0=TOPIC["Registered"])
    words = scan.selectExpr(
        f"{H.sql_hex_body('get(topics, 1)')} AS _agent",
        "get(topics, 2) AS _owner",
        f"{H.sql_data_word('data', 1)} AS _len",
        "data", "block_timestamp", "transaction_hash", "log_index",
    )
    return words.selectExpr(
        f"{H.sql_hex_digits_to_long('_agent')} AS agent_id",
        f"{H.sql_topic_to_address('_owner')} AS owner_address",
        f"{H.sql_abi_string('data', H.sql_hex_digits_to_long('_len'))} AS reg_uri",
        "block_timestamp AS registered_at",
        "transaction_hash AS registered_tx",
        "log_index",
    )


def uri_updates(logs: DataFrame, since: str | None = None) -> DataFrame:
    """URIUpdated events -> (agent_id, new_uri, block_timestamp, log_index)."""
    scan = scan_logs(logs, IDENTITY_REGISTRY, since, min_topics=2, topic0=TOPIC["URIUpdated"])
    words = scan.selectExpr(
        f"{H.sql_hex_body('get(topics, 1)')} AS _agent",
        f"{H.sql_data_word('data', 1)} AS _len",
        "data", "block_timestamp", "transaction_hash", "log_index",
    )
    return words.selectExpr(
        f"{H.sql_hex_digits_to_long('_agent')} AS agent_id",
        f"{H.sql_abi_string('data', H.sql_hex_digits_to_long('_len'))} AS new_uri",
        "block_timestamp", "transaction_hash", "log_index",
    )


def first_registrations(logs: DataFrame, since: str | None = None) -> DataFrame:
    """The earliest registration of each agent (ties -> lowest log_index)."""
    return earliest_per_key(registrations(logs, since), "agent_id", ["registered_at", "log_index"],
                            ["owner_address", "reg_uri", "registered_at", "registered_tx"])


def latest_uris(logs: DataFrame, since: str | None = None) -> DataFrame:
    """The newest URIUpdated per agent (ties -> highest log_index)."""
    return latest_per_key(uri_updates(logs, since), "agent_id", ["block_timestamp", "log_index"], ["new_uri"])


def decode_identity(logs: DataFrame, since: str | None = None, ordered: bool = False) -> DataFrame:
    """One row per registered agent; the latest URI update beats the
    registration URI and an explicit '' clears it (C1, B8). ``ordered`` adds
    the reference's presentation order (S2: by agent_id, a range-partitioned
    sort); consumers that join or aggregate should leave it off."""
    out = resolve_identity(first_registrations(logs, since), latest_uris(logs, since))
    return out.orderBy("agent_id") if ordered else out


def resolve_identity(reg: DataFrame, upd: DataFrame) -> DataFrame:
    """First registrations and newest URIs, one row per agent each -> agents."""
    return reg.join(upd, "agent_id", "left").selectExpr(
        "agent_id",
        "owner_address",
        "nullif(coalesce(new_uri, reg_uri), '') AS token_uri",
        "registered_at",
        "registered_tx",
    )


def decode_feedback(logs: DataFrame, since: str | None = None, ordered: bool = False,
                    log_index: bool = False) -> DataFrame:
    """NewFeedback -> (agent_id, client_address, feedback_index, raw_value,
    value_decimals, score, created_at, feedback_tx). int128 values are decoded
    with their sign; zero words decode to 0. ``ordered`` sorts by created_at
    (S2, the reference's presentation order)."""
    fb = scan_logs(logs, REPUTATION_REGISTRY, since, min_topics=3, topic0=TOPIC["NewFeedback"])
    # Slice the hex once; the decoders then work on short, named columns.
    words = fb.selectExpr(
        f"{H.sql_hex_body('get(topics, 1)')} AS _agent",
        "get(topics, 2) AS _client",
        f"{H.sql_data_word('data', 0)} AS _w0",
        f"{H.sql_data_word('data', 1)} AS _w1",
        f"{H.sql_data_word('data', 2)} AS _w2",
        "block_timestamp", "transaction_hash", "log_index",
    )
    decoded = words.selectExpr(
        f"{H.sql_hex_digits_to_long('_agent')} AS agent_id",
        f"{H.sql_topic_to_address('_client')} AS client_address",
        f"{H.sql_hex_digits_to_long('_w0')} AS feedback_index",
        f"{H.sql_int128_low_word('_w1')} AS raw_value",
        f"coalesce({H.sql_hex_digits_to_long('_w2')}, CAST(0 AS BIGINT)) AS value_decimals",
        "block_timestamp AS created_at",
        "transaction_hash AS feedback_tx",
        "log_index",
    )
    out = decoded.selectExpr(
        "agent_id", "client_address", "feedback_index", "raw_value", "value_decimals",
        "try_divide(raw_value, pow(10.0, coalesce(value_decimals, 0))) AS score",
        "created_at", "feedback_tx", *(["log_index"] if log_index else []),
    )
    return out.orderBy("created_at") if ordered else out


#: The strings of a NewFeedback log and the head word that holds each one's offset.
FEEDBACK_TEXTS = {"tag1": 3, "tag2": 4, "endpoint": 5, "feedback_uri": 6}
FEEDBACK_HEAD = 8


def decode_feedback_texts(logs: DataFrame, since: str | None = None) -> DataFrame:
    """NewFeedback -> (agent_id, client_address, feedback_index, tag1, tag2, endpoint, feedback_uri,
    created_at, feedback_tx), each string read where its offset word says, in any order of the tails.

    A string is NULL where its offset does not point to a whole word behind the head, where its length goes
    beyond the data, or where its tail shares bytes with another one; the others are decoded all the same."""
    fb = scan_logs(logs, REPUTATION_REGISTRY, since, min_topics=3, topic0=TOPIC["NewFeedback"])
    names = list(FEEDBACK_TEXTS)
    keep = ["_agent", "_client", "_w0", "data", "block_timestamp", "transaction_hash"]
    words = fb.selectExpr(f"{H.sql_hex_body('get(topics, 1)')} AS _agent", "get(topics, 2) AS _client", f"{H.sql_data_word('data', 0)} AS _w0",
                          "data", "block_timestamp", "transaction_hash", *(f"{H.sql_data_word('data', i)} AS _o_{n}" for n, i in FEEDBACK_TEXTS.items()))
    offsets = words.selectExpr(*keep, *(f"{H.sql_tail_offset('data', f'_o_{n}', FEEDBACK_HEAD)} AS _at_{n}" for n in names))
    lengths = offsets.selectExpr(*keep, *(f"_at_{n}" for n in names), *(f"{H.sql_tail_length_word('data', f'_at_{n}')} AS _len_{n}" for n in names))
    ends = lengths.selectExpr(*keep, *(f"_{x}_{n}" for n in names for x in ("at", "len")),
                              *(f"{H.sql_tail_end('data', f'_at_{n}', f'_len_{n}')} AS _end_{n}" for n in names))

    def alone(n: str) -> str:
        return " AND ".join(f"NOT coalesce(_at_{n} < _end_{m} AND _at_{m} < _end_{n}, false)" for m in names if m != n)
    texts = [f"CASE WHEN _end_{n} IS NOT NULL AND {alone(n)} THEN {H.sql_tail_text('data', f'_at_{n}', f'_len_{n}')} END AS {n}" for n in names]
    return ends.selectExpr(f"{H.sql_hex_digits_to_long('_agent')} AS agent_id", f"{H.sql_topic_to_address('_client')} AS client_address",
                           f"{H.sql_hex_digits_to_long('_w0')} AS feedback_index", *texts,
                           "block_timestamp AS created_at", "transaction_hash AS feedback_tx")


def decode_revocations(logs: DataFrame, since: str | None = None) -> DataFrame:
    """FeedbackRevoked -> (agent_id, client_address, feedback_index, revoked_at)."""
    rv = scan_logs(logs, REPUTATION_REGISTRY, since, min_topics=4, topic0=TOPIC["FeedbackRevoked"])
    return rv.select(
        hex_to_long(_topic(1)).alias("agent_id"),
        topic_to_address(_topic(2)).alias("client_address"),
        hex_to_long(_topic(3)).alias("feedback_index"),
        F.col("block_timestamp").alias("revoked_at"),
        "transaction_hash", "log_index",
    )


REVOCATION_KEY = ["agent_id", "client_address", "feedback_index"]


def drop_revoked(feedback: DataFrame, revocations: DataFrame) -> DataFrame:
    """Remove revoked feedback (left anti join on the full feedback key).

    Revocations are a tiny stream next to feedback; the anti join shuffles
    both sides on the 3-column key, which spreads a hot agent over its
    clients and indexes."""
    return feedback.join(revocations.select(*REVOCATION_KEY).distinct(), REVOCATION_KEY, "left_anti")


def event_census(spark: SparkSession, logs: DataFrame, since: str | None = None) -> DataFrame:
    """Number of logs per (contract, event) of the catalogue.

    Aggregates by (address, topic0) first, then labels the few groups with the
    10-row catalogue, so the join never sees raw logs."""
    catalogue = [(IDENTITY_REGISTRY if c == "IdentityRegistry" else REPUTATION_REGISTRY, c, e, t) for c, e, t in EVENT_TOPICS]
    # Only the catalogue's contracts and events leave the scan.
    per_topic = logs.where(F.col("address").isin(sorted({a for a, *_ in catalogue}))
                           & F.col("topic0").isin(sorted({t for *_, t in catalogue})))
    if since is not None:
        per_topic = per_topic.where(F.col("block_timestamp") >= F.lit(since).cast("timestamp"))
    arity = F.col("topic_count") if "topic_count" in logs.columns else F.size("topics")
    per_topic = (per_topic.where(arity >= 1)
                 .groupBy("address", "topic0").agg(F.count(F.lit(1)).alias("n")))
    cat = spark.createDataFrame(catalogue, "address string, contract string, event string, topic0 string")
    return (per_topic.join(F.broadcast(cat), ["address", "topic0"])
            .select("contract", "event", F.col("n").cast("bigint").alias("n")))


def mint_crosscheck(logs: DataFrame, since: str | None = None) -> DataFrame:
    """Registrations vs ERC-721 mints (Transfer from 0x0), per agent id.

    Returns one row per id present on either side with flags, so counts and
    missing ids in both directions come from one full outer join."""
    reg = registrations(logs, since).select("agent_id").distinct().withColumn("registered", F.lit(True))
    mint = (scan_logs(logs, IDENTITY_REGISTRY, since, min_topics=4, topic0=TOPIC["Transfer"])
            .where(F.get(F.col("topics"), 1) == F.lit(ZERO_TOPIC))
            .select(hex_to_long(_topic(3)).alias("agent_id")).distinct().withColumn("minted", F.lit(True)))
    return (reg.join(mint, "agent_id", "full")
            .select("agent_id",
                    F.coalesce("registered", F.lit(False)).alias("registered"),
                    F.coalesce("minted", F.lit(False)).alias("minted")))


def crosscheck_counts(check: DataFrame) -> DataFrame:
    """G18 summary: registered, minted and missing counts in one row."""
    return check.agg(
        F.count_if("registered").alias("registered"),
        F.count_if("minted").alias("minted"),
        F.count_if(F.col("registered") & ~F.col("minted")).alias("registered_not_minted"),
        F.count_if(F.col("minted") & ~F.col("registered")).alias("minted_not_registered"),
    )
