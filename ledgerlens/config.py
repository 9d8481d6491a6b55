"""Constants, parameters and schemas shared by every layer."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for right results)
# ---------------------------------------------------------------------------
# Registry contract addresses (stored lowercase, as the log table stores them).
IDENTITY_REGISTRY = "0x8004a169fb4a3325136eb29fa0ceb6d2e539a432"
REPUTATION_REGISTRY = "0x8004baa17c55a88189ae136b182e5fda19de9b63"
# First on-chain activity; every scan is floored here.
DEPLOY_DATE = "2026-01-29"

# Event catalogue: (contract, event, topic0)
EVENT_TOPICS = [
    ("IdentityRegistry", "Transfer", "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"),
    ("IdentityRegistry", "Registered", "0xca52e62c367d81bb2e328eb795f7c7ba24afb478408a26c0e201d155c449bc4a"),
    ("IdentityRegistry", "URIUpdated", "0x3a2c7fffc2cba7582c690e3b82c453ea02a308326a98a3ad7576c606336409fb"),
    ("IdentityRegistry", "MetadataSet", "0x2c149ed548c6d2993cd73efe187df6eccabe4538091b33adbd25fafdb8a1468b"),
    ("IdentityRegistry", "MetadataUpdate", "0xf8e1a15aba9398e019f0b49df1a4fde98ee17ae345cb5f6b5e2c27f5033e8ce7"),
    ("IdentityRegistry", "ApprovalForAll", "0x17307eab39ab6107e8899845ad3d59bd9653f200f220920489ca2b5937696c31"),
    ("IdentityRegistry", "Approval", "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"),
    ("ReputationRegistry", "NewFeedback", "0x6a4a61743519c9d648a14e6493f47dbe3ff1aa29e7785c96c8326a205e58febc"),
    ("ReputationRegistry", "FeedbackRevoked", "0x25156fd3288212246d8b008d5921fde376c71ed14ac2e072a506eb06fde6d09d"),
    ("ReputationRegistry", "ResponseAppended", "0xb1c6be0b5b8aef6539e2fac0fd131a2faa7b49edf8e505b5eb0ad487d56051d4"),
]
TOPIC = {event: topic0 for _, event, topic0 in EVENT_TOPICS}

# Score parameters: half-life 30 days, pseudo-count 5, neutral prior quality 0.5.
# Quality buckets: positive q >= 0.66, neutral 0.33 <= q < 0.66, negative q < 0.33.
POSITIVE_MIN = 0.66
NEUTRAL_MIN = 0.33
UNRATED_SCORE = 50.0

# Score tiers: high >= 70, medium >= 40, else low.
TIER_HIGH = ("high (>=70)", 70.0)
TIER_MEDIUM = ("medium (40-70)", 40.0)
TIER_LOW = "low (<40)"

# Serving: list limit default 50, clamp [1, 200]; viz sample 500; export sample 50.
LIST_DEFAULT_LIMIT = 50
LIST_MAX_LIMIT = 200
VIZ_SAMPLE = 500
EXPORT_SAMPLE = 50
NAME_SAMPLE = 15
STATS_SERIES_DAYS = 90

# Metadata
IPFS_GATEWAY = "https://ipfs.io/ipfs/"
X402_BOOLEAN_KEYS = ["x402", "x402support", "paymentrequired", "payable"]
X402_PRESENCE_KEYS = [
    "payment", "accepts", "paymentchannels", "paymentschemes", "paymentmethods",
    "paymentendpoint", "payto", "lightning", "invoice", "monetization",
]
X402_MAX_DEPTH = 4
NAME_KEYS = ["name", "agentName", "agent_name", "title"]
DESCRIPTION_KEYS = ["description", "summary", "about"]
DATA_URI_ERROR = "Failed to parse data: URI"
NO_URI_ERROR = "no tokenURI"
# Cache freshness (seconds): ok metadata 1 h, failed metadata 5 min, names 24 h.
TTL_METADATA = 3600
TTL_METADATA_ERROR = 300
TTL_NAMES = 86400

# Name records
ADDRESS_PATTERN = "^0x[0-9a-fA-F]{40}$"
PROFILE_KEYS = [
    "agent-context", "agent-endpoint[mcp]", "agent-endpoint[a2a]", "agent-endpoint[web]",
    "avatar", "url", "description",
]
LOOKUP_KEYS = ["avatar", "description", "url", "com.twitter", "agent-context", "agent-endpoint[web]"]
ATTESTATION_PREFIX = "0x000100000101"


@dataclass(frozen=True)
class ScoreConfig:
    """Parameters of the reputation score (all tunable)."""

    half_life_days: float = 30.0
    k_prior: float = 5.0
    prior_q: float = 0.5
    as_of: _dt.datetime = field(default_factory=lambda: _dt.datetime(2024, 2, 1))
    # scans are floored at this timestamp; None = no floor
    since: str | None = None


DEFAULT_CONFIG = ScoreConfig()
# Snapshot instant used by every registered query (UTC).
AS_OF = "2024-02-01 00:00:00"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
AGENT_SUMMARY_SCHEMA = StructType([
    StructField("agent_id", LongType(), True),
    StructField("owner_address", StringType(), False),
    StructField("token_uri", StringType(), True),
    StructField("registered_at", TimestampType(), False),
    StructField("registered_tx", StringType(), False),
    StructField("feedback_count", LongType(), False),
    StructField("unique_clients", LongType(), False),
    StructField("positive_count", LongType(), False),
    StructField("neutral_count", LongType(), False),
    StructField("negative_count", LongType(), False),
    StructField("avg_raw_score", DoubleType(), True),
    StructField("reputation_score", DoubleType(), False),
    StructField("effective_feedback", DoubleType(), False),
    StructField("last_feedback_at", TimestampType(), True),
    StructField("last_activity_at", TimestampType(), False),
    StructField("rank", LongType(), False),
    StructField("x402", BooleanType(), False),
    StructField("computed_at", TimestampType(), False),
])
SUMMARY_COLUMNS = [f.name for f in AGENT_SUMMARY_SCHEMA.fields]
