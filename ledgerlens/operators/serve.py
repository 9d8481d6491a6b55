"""Serving queries over the agent summary.

All of them are plans over the (cached or stored) summary: filters and
projections, one top-k, or a single-pass aggregate. Paging uses
TakeOrderedAndProject (per-task top-k then merge) for shallow pages and the
scaled global row number for deep pages, so no page ever funnels the whole
table through one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    LIST_DEFAULT_LIMIT,
    LIST_MAX_LIMIT,
    STATS_SERIES_DAYS,
    VIZ_SAMPLE,
)
from ..functions.scoring import (
    address_url,
    bucket_percent,
    gateway_url,
    relative_age,
    round_half_up,
    score_tier,
    shorten,
    tx_url,
    viz_hue,
    viz_size,
)
_INT_PREFIX = re.compile(r"^\s*([+-]?\d+)")


def parse_int_js(value) -> int | None:
    """JavaScript parseInt(value, 10): leading integer or None (NaN)."""
    if value is None:
        return None
    m = _INT_PREFIX.match(str(value))
    return int(m.group(1)) if m else None


def parse_limit(value) -> int:
    """Q16: parseInt || 50, clamped to [1, 200] (0 and junk -> 50)."""
    n = parse_int_js(value) or LIST_DEFAULT_LIMIT
    return min(LIST_MAX_LIMIT, max(1, n))


def parse_offset(value) -> int:
    return max(0, parse_int_js(value) or 0)


SORT_MODES = ("rank", "reputation", "feedback", "recent")


def sort_columns(mode: str | None) -> list[Column]:
    """S3: every mode ends in rank (unique) so pages are stable. 'recency'
    (what the UI sends) is accepted as 'recent'; unknown modes fall back to rank."""
    mode = "recent" if mode == "recency" else mode
    if mode == "reputation":
        return [F.col("reputation_score").desc(), F.col("feedback_count").desc(), F.col("rank").asc()]
    if mode == "feedback":
        return [F.col("feedback_count").desc(), F.col("reputation_score").desc(), F.col("rank").asc()]
    if mode == "recent":
        return [F.col("last_activity_at").desc(), F.col("rank").asc()]
    return [F.col("rank").asc()]


def search_predicate(q: str) -> Column:
    """Trimmed, lowercased substring over agent id, owner and token URI."""
    q = q.strip().lower()
    return (F.col("agent_id").cast("string").contains(q)
            | F.lower(F.col("owner_address")).contains(q)
            | F.coalesce(F.lower(F.col("token_uri")).contains(q), F.lit(False)))


def filter_agents(summary: DataFrame, q: str | None = None, x402: bool = False, rated: bool = False) -> DataFrame:
    """B3 / B4 / B5."""
    df = summary
    if x402:
        df = df.where(F.col("x402"))
    if rated:
        df = df.where(F.col("feedback_count") > 0)
    if q and q.strip():
        df = df.where(search_predicate(q))
    return df


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """Rows [offset, offset + limit) in ``order``: a top-k per task, merged."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


@dataclass
class ListRequest:
    q: str | None = None
    x402: bool = False
    rated: bool = False
    sort: str = "rank"
    limit: int | str | None = LIST_DEFAULT_LIMIT
    offset: int | str | None = 0


def list_agents(summary: DataFrame, req: ListRequest) -> DataFrame:
    """Filters -> sort mode -> page."""
    filtered = filter_agents(summary, req.q, req.x402, req.rated)
    return page(filtered, sort_columns(req.sort), parse_limit(req.limit), parse_offset(req.offset))


def list_envelope(summary: DataFrame, req: ListRequest, source: str = "live") -> DataFrame:
    """{source, computed_at, total, count, has_more} as one row.

    ``total`` is the filtered count before paging; ``count`` the page size."""
    limit, offset = parse_limit(req.limit), parse_offset(req.offset)
    # One pass: the filter becomes a conditional count next to max(computed_at).
    matches = F.lit(True)
    if req.x402:
        matches = matches & F.col("x402")
    if req.rated:
        matches = matches & (F.col("feedback_count") > 0)
    if req.q and req.q.strip():
        matches = matches & search_predicate(req.q)
    stats = summary.agg(F.count_if(matches).alias("total"), F.max("computed_at").alias("computed_at"))
    count = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - F.lit(offset)))
    return stats.select(F.lit(source).alias("source"), "computed_at", F.col("total").cast("bigint").alias("total"),
                        count.cast("bigint").alias("count"),
                        (F.lit(offset) + count < F.col("total")).alias("has_more"))


def agent_by_id(summary: DataFrame, agent_id) -> DataFrame:
    """Point lookup. Raises ValueError for a non-integer or negative id;
    an empty frame means not found."""
    n = parse_int_js(agent_id)
    if n is None or n < 0:
        raise ValueError(f"agent ids are whole numbers from 0 on, got {agent_id!r}")
    if n >= 1 << 63:
        return summary.limit(0)  # no agent can have it
    return summary.where(F.col("agent_id") == F.lit(n))


def _requested(ids: list) -> list[tuple]:
    """(requested, id, valid); an id beyond 64 bits is valid, but no agent can have it."""
    return [(str(i), n if n is not None and 0 <= n < 1 << 63 else None, n is not None and n >= 0)
            for i, n in ((i, parse_int_js(i)) for i in ids)]


def requested_ids(ids: list) -> list[int]:
    """The ids that a lookup of ``ids`` has to look for."""
    return sorted({n for _, n, _ in _requested(ids) if n is not None})


def lookup_agents(summary: DataFrame, ids: list) -> DataFrame:
    """B7 for a list of requested ids: (requested, status, agent columns);
    status is found, missing or invalid, as the point lookup tells them apart."""
    parsed = _requested(ids)
    asked = summary.sparkSession.createDataFrame(parsed, "requested string, agent_id bigint, valid boolean")
    status = (F.when(~F.col("valid"), F.lit("invalid")).when(F.col("rank").isNull(), F.lit("missing")).otherwise(F.lit("found")))
    known = F.when(F.col("rank").isNotNull(), F.col("agent_id"))
    return (asked.join(summary, "agent_id", "left").withColumn("status", status).withColumn("agent_id", known)
            .select("requested", "status", *summary.columns))


# ---------------------------------------------------------------------------
# Stats (P8)
# ---------------------------------------------------------------------------

def network_kpis(summary: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One single-pass aggregate (partial per task, one tiny merge)."""
    return summary.agg(*(extra or []),
        F.count(F.lit(1)).cast("bigint").alias("total_agents"),
        F.count_if(F.col("feedback_count") > 0).cast("bigint").alias("rated_agents"),
        F.count_if(F.col("token_uri").isNotNull()).cast("bigint").alias("with_token_uri"),
        F.count_if(F.col("x402")).cast("bigint").alias("x402_count"),
        F.coalesce(F.sum("feedback_count"), F.lit(0)).cast("bigint").alias("total_feedback"),
        F.coalesce(F.greatest(F.max("reputation_score"), F.lit(0.0)), F.lit(0.0)).alias("top_score"),
        F.coalesce(round_half_up(F.avg("reputation_score"), 2), F.lit(0.0)).alias("avg_score"),
    )


def _bucket(score: Column) -> Column:
    """10-wide buckets over [0, 100], 100 folded into the last; other
    values (outside [0, 100]) belong to no bucket."""
    return F.when((score >= 0) & (score <= 100), F.least(F.floor(score / 10), F.lit(9)))


def bucket_labels(spark) -> DataFrame:
    labels = [(i, f"{i * 10}-{i * 10 + 10}") for i in range(10)]
    return spark.createDataFrame(labels, "bucket bigint, label string")


def score_histogram(summary: DataFrame) -> DataFrame:
    """(bucket, label, agents) with all ten buckets present.

    One grouped count (partial per task) right-joined to the 10 labels."""
    counts = (summary.select(_bucket(F.col("reputation_score")).cast("bigint").alias("bucket"))
              .where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    labels = bucket_labels(summary.sparkSession)
    return (labels.join(counts, "bucket", "left")
            .select("bucket", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("agents")))


def as_of_ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def activity_series(summary: DataFrame, as_of: str, days: int = STATS_SERIES_DAYS) -> DataFrame:
    """Registrations per UTC day (ISO 'YYYY-MM-DD' key, F12) since
    as_of - days; sparse and ascending."""
    cutoff = as_of_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return (summary.where(F.col("registered_at") >= cutoff)
            .groupBy(F.date_format("registered_at", "yyyy-MM-dd").alias("date"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
            .orderBy("date"))


def stats_document(summary: DataFrame, as_of: str, source: str = "live") -> DataFrame:
    """KPIs + histogram (map) + series (array of structs) in one row.

    Each part is aggregated to one row first, so the final cross join is
    1 x 1 x 1."""
    bucket = _bucket(F.col("reputation_score"))
    labels = [f"{i * 10}-{i * 10 + 10}" for i in range(10)]
    hist = F.create_map(*[x for i, lab in enumerate(labels)
                          for x in (F.lit(lab), F.count_if(bucket == i).cast("bigint"))])
    kpis = network_kpis(summary, extra=[hist.alias("score_distribution"),
                                        F.max("computed_at").alias("computed_at")])
    # The series has one row per day (bounded by the calendar, not the data).
    series = activity_series(summary, as_of).agg(
        F.coalesce(F.array_sort(F.collect_list(F.struct("date", "count"))),
                   F.array().cast("array<struct<date:string,count:bigint>>")).alias("activity_series"))
    one = F.lit(1).alias("_one")
    return (kpis.select("*", one).join(series.select("*", one), "_one")
            .select(F.lit(source).alias("source"), *[c for c in kpis.columns if c != "computed_at"],
                    "computed_at", "activity_series"))


# Statistics from additive parts (G10-G13): one grouped table that merges.

_PARTS = ["kind", "day", "score", "agents", "rated", "with_uri", "x402", "feedback"]


def stats_parts(summary: DataFrame, sign: int = 1) -> DataFrame:
    """(kind, day, score, counts): one pass over the agents, grouped by registration day, by score and not at all.

    With ``sign=-1`` the parts of agents that leave; ``merge_parts`` adds tables up."""
    one = F.lit(int(sign)).cast("bigint")
    def total(cond):
        return F.sum(F.when(cond, one).otherwise(F.lit(0).cast("bigint")))
    grouped = (summary.select("*", F.to_date("registered_at").alias("day"), F.col("reputation_score").alias("score"))
               .groupingSets([["day"], ["score"], []], "day", "score"))
    kind = F.when(F.grouping("day") == 0, "day").when(F.grouping("score") == 0, "score").otherwise("all")
    return grouped.agg(kind.alias("kind"), F.sum(one).alias("agents"), total(F.col("feedback_count") > 0).alias("rated"),
                       total(F.col("token_uri").isNotNull()).alias("with_uri"), total(F.col("x402")).alias("x402"),
                       F.sum(F.col("feedback_count") * one).alias("feedback")).select(*_PARTS)


def merge_parts(*tables: DataFrame) -> DataFrame:
    """The sum of parts; groups that no agent is left in go."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("kind", "day", "score").agg(*(F.sum(c).alias(c) for c in _PARTS[3:])).where(F.col("agents") != 0).select(*_PARTS)


def stats_from_parts(parts: DataFrame, as_of: str, computed_at: Column, source: str = "live", days: int = STATS_SERIES_DAYS) -> DataFrame:
    """The stats document (histogram and series as JSON text) from ``stats_parts`` alone."""
    def count(c):
        return F.coalesce(F.sum(F.when(F.col("kind") == "all", F.col(c))), F.lit(0)).cast("bigint")
    scored = F.when(F.col("kind") == "score", F.col("score"))
    bucket = _bucket(scored)
    hist = F.create_map(*[x for i in range(10) for x in (F.lit(f"{i * 10}-{i * 10 + 10}"),
                                                         F.coalesce(F.sum(F.when(bucket == i, F.col("agents"))), F.lit(0)).cast("bigint"))])
    cutoff = as_of_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    # The first day of the window counts from its hour on in ``activity_series``; whole days only here.
    recent = (F.col("kind") == "day") & (F.col("day").cast("timestamp") >= cutoff)
    series = F.array_sort(F.collect_list(F.when(recent, F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), F.col("agents").alias("count")))))
    # Scores have four decimals, so their sum is exact.
    mean = F.sum(scored.cast("decimal(20,4)") * F.when(F.col("kind") == "score", F.col("agents"))).cast("double") / count("agents")
    return parts.agg(
        F.lit(source).alias("source"), count("agents").alias("total_agents"), count("rated").alias("rated_agents"),
        count("with_uri").alias("with_token_uri"), count("x402").alias("x402_count"), count("feedback").alias("total_feedback"),
        F.coalesce(F.greatest(F.max(scored), F.lit(0.0)), F.lit(0.0)).alias("top_score"),
        F.when(count("agents") > 0, round_half_up(mean, 2)).otherwise(F.lit(0.0)).alias("avg_score"),
        F.when(count("agents") > 0, computed_at).alias("computed_at"),
        F.to_json(hist).alias("score_distribution"), F.to_json(series).alias("activity_series"))


def tier_summary(summary: DataFrame) -> DataFrame:
    """Agents and mean feedback count per score tier."""
    return (summary.groupBy(score_tier("reputation_score").alias("tier"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("agents"),
                 round_half_up(F.avg("feedback_count"), 1).alias("avg_feedbacks"))
            .orderBy("tier"))


# ---------------------------------------------------------------------------
# Display features (B11-B15) and the viz sample
# ---------------------------------------------------------------------------

def agent_cards(summary: DataFrame, as_of: str) -> DataFrame:
    """What a list row and the detail page display."""
    total = F.col("positive_count") + F.col("neutral_count") + F.col("negative_count")
    now = as_of_ts(as_of)
    return summary.select(
        "agent_id", "rank",
        score_tier("reputation_score").alias("tier"),
        shorten("owner_address", 6, 4).alias("owner_short"),
        shorten("registered_tx", 10, 8).alias("tx_short"),
        bucket_percent("positive_count", total).alias("positive_pct"),
        bucket_percent("neutral_count", total).alias("neutral_pct"),
        bucket_percent("negative_count", total).alias("negative_pct"),
        relative_age("last_activity_at", now).alias("last_active"),
        gateway_url("token_uri").alias("token_link"),
        tx_url("registered_tx").alias("tx_link"),
        address_url("owner_address").alias("owner_link"),
    )


def viz_sample(summary: DataFrame, as_of: str, n: int = VIZ_SAMPLE) -> DataFrame:
    """S7 + B14: rated agents first (rank order inside each class), at most
    n rows, slim projection plus node features. One top-k, no full sort."""
    rated = F.col("feedback_count") > 0
    now = as_of_ts(as_of)
    days = (F.unix_micros(now) - F.unix_micros(F.col("last_activity_at"))) / F.lit(86_400_000_000.0)
    top = summary.orderBy(rated.desc(), F.col("rank").asc()).limit(n)
    return top.select(
        "agent_id", "rank", "reputation_score", "feedback_count", "last_activity_at",
        F.round(days, 6).alias("age_days"),
        (rated & (days < 7)).alias("recent"),
        F.round(viz_size("feedback_count"), 6).alias("size"),
        F.round(viz_hue("reputation_score"), 6).alias("hue"),
        F.when(rated, 90).otherwise(45).alias("saturation"),
        F.when(rated, 95).otherwise(60).alias("brightness"),
    )


def stats_document_json(summary: DataFrame, as_of: str, source: str = "live") -> DataFrame:
    """P8 as it is served: the histogram and series as JSON text."""
    doc = stats_document(summary, as_of, source)
    return doc.select(
        *[c for c in doc.columns if c not in ("score_distribution", "activity_series")],
        F.to_json("score_distribution").alias("score_distribution"),
        F.to_json("activity_series").alias("activity_series"),
    )


def snapshot_rows(summary: DataFrame) -> DataFrame:
    """Flat snake_case -> camelCase API rows with defaults (null counts
    -> 0, score -> 50, rank -> 0, x402 -> false, owner lowercased); the three
    bucket counts fold into ``scoreBreakdown``."""
    zero = F.lit(0).cast("bigint")
    return summary.select(
        F.coalesce(F.col("agent_id"), zero).alias("agentId"),
        F.lower(F.coalesce(F.col("owner_address"), F.lit(""))).alias("ownerAddress"),
        F.col("token_uri").alias("tokenURI"),
        F.col("registered_at").alias("registeredAt"),
        F.coalesce(F.col("registered_tx"), F.lit("")).alias("registeredTx"),
        F.coalesce(F.col("feedback_count"), zero).alias("feedbackCount"),
        F.coalesce(F.col("unique_clients"), zero).alias("uniqueClients"),
        F.struct(F.coalesce(F.col("positive_count"), zero).alias("positive"),
                 F.coalesce(F.col("neutral_count"), zero).alias("neutral"),
                 F.coalesce(F.col("negative_count"), zero).alias("negative")).alias("scoreBreakdown"),
        F.col("avg_raw_score").alias("avgRawScore"),
        F.coalesce(F.col("reputation_score"), F.lit(50.0)).alias("reputationScore"),
        F.coalesce(F.col("effective_feedback"), F.lit(0.0)).alias("effectiveFeedback"),
        F.col("last_feedback_at").alias("lastFeedbackAt"),
        F.col("last_activity_at").alias("lastActivityAt"),
        F.coalesce(F.col("rank"), zero).alias("rank"),
        F.coalesce(F.col("x402"), F.lit(False)).alias("x402"),
        F.col("computed_at").alias("computedAt"),
    )
