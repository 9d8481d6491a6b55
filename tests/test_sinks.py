"""Sinks: versioned writes, pointer switch, fallback reads, cache upsert, table swap."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.plans.summary import build_agent_summary
from ledgerlens.sources import snapshot as SN
from ledgerlens.sources.fixtures import fixture_logs
from ledgerlens.sources.logs import read_bronze, write_bronze

from .conftest import SF_SMALL


def test_snapshot_export_and_load(spark):
    root = tempfile.mkdtemp(prefix="snap-", dir="/tmp")
    s = build_agent_summary(fixture_logs(spark, SF_SMALL))
    live, fixtures = os.path.join(root, "live"), os.path.join(root, "fixtures")
    df, computed = SN.load_agents(spark, live, fixtures)
    assert df is None
    SN.export_snapshot(s, fixtures, run_id="a")
    df, computed = SN.load_agents(spark, live, fixtures)
    assert df.select("source").first()[0] == "fixtures"
    v = SN.export_snapshot(s, live, sample_root=os.path.join(root, "sample"), run_id="b")
    df, computed = SN.load_agents(spark, live, fixtures)
    assert df.select("source").first()[0] == "live" and df.count() == s.count()
    assert computed is not None
    assert set(["agentId", "scoreBreakdown", "reputationScore"]) <= set(df.columns)
    assert SN.read_current(spark, os.path.join(root, "sample"), fmt="json").count() == min(50, s.count())
    # a failed writer leaves the pointer on the last good version
    assert SN.current_version(spark, live) == v


def test_pointer_missing_falls_back_to_newest_complete(spark):
    root = tempfile.mkdtemp(prefix="ver-", dir="/tmp")
    df = spark.range(5)
    SN.write_version(df, root, run_id="1")
    SN.write_version(spark.range(7), root, run_id="2")
    os.makedirs(os.path.join(root, "v=3"))  # incomplete: no _SUCCESS
    os.remove(os.path.join(root, SN.POINTER))
    assert SN.current_version(spark, root) == "v=2"
    assert SN.read_current(spark, root).count() == 7


def test_cache_upsert(spark):
    root = tempfile.mkdtemp(prefix="cache-", dir="/tmp")
    a = spark.createDataFrame([("u1", "x"), ("u2", "y")], "token_uri string, v string")
    SN.upsert_cache(spark, root, a, "token_uri")
    b = spark.createDataFrame([("u2", "z"), ("u3", "w")], "token_uri string, v string")
    SN.upsert_cache(spark, root, b, "token_uri")
    got = {r["token_uri"]: r["v"] for r in SN.read_current(spark, root).collect()}
    assert got == {"u1": "x", "u2": "z", "u3": "w"}


def test_materialize_table_swaps_location(spark):
    root = tempfile.mkdtemp(prefix="tbl-", dir="/tmp")
    s = build_agent_summary(fixture_logs(spark, SF_SMALL))
    SN.materialize_table(s, "ll_test.agent_summary", root, comment="agents ranked by reputation")
    SN.materialize_table(s.where(F.col("rank") <= 10), "ll_test.agent_summary", root, comment="it's refreshed")
    assert SN.read_ranked(spark, "ll_test.agent_summary").count() == 10
    assert [r["rank"] for r in SN.read_ranked(spark, "ll_test.agent_summary").collect()] == list(range(1, 11))


def test_bronze_roundtrip_prunes(spark):
    root = tempfile.mkdtemp(prefix="bronze-", dir="/tmp")
    write_bronze(fixture_logs(spark, SF_SMALL), os.path.join(root, "logs"))
    logs = read_bronze(spark, os.path.join(root, "logs"))
    from ledgerlens.config import DEFAULT_CONFIG
    a = build_agent_summary(logs, DEFAULT_CONFIG).drop("computed_at").collect()
    b = build_agent_summary(fixture_logs(spark, SF_SMALL), DEFAULT_CONFIG).drop("computed_at").collect()
    assert sorted(a) == sorted(b)
    from ledgerlens.operators.decode import decode_feedback
    plan = decode_feedback(logs, "2024-01-15")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "topic0" in plan


def test_to_bronze_lowercases_and_derives(spark):
    from ledgerlens.sources.logs import BRONZE_COLUMNS, to_bronze
    raw = spark.createDataFrame(
        [("0xABCdef", ["0xAA", "0xBb"], "0xFF", "2024-01-02 03:04:05", "0xTX", 3)],
        "address string, topics array<string>, data string, block_timestamp string, transaction_hash string, log_index int")
    r = to_bronze(raw).select(*BRONZE_COLUMNS).first()
    assert r["address"] == "0xabcdef" and r["topics"] == ["0xaa", "0xbb"] and r["data"] == "0xff"
    assert r["topic0"] == "0xaa" and r["topic_count"] == 2 and str(r["block_date"]) == "2024-01-02"


def test_bronze_files_do_not_grow_with_the_days(spark):
    from pyspark.sql.types import DateType

    from ledgerlens.config import REPUTATION_REGISTRY, TOPIC
    from ledgerlens.operators.decode import decode_feedback
    from ledgerlens.sources.logs import BRONZE_COLUMNS, to_bronze
    raw = spark.range(900).select(
        F.lit(REPUTATION_REGISTRY).alias("address"),
        F.array(F.lit(TOPIC["NewFeedback"]), F.lit("0x" + "0" * 63 + "1"), F.lit("0x" + "0" * 64)).alias("topics"),
        F.lit("0x" + "0" * 192).alias("data"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 86_400).alias("block_timestamp"),
        F.concat(F.lit("0x"), F.col("id").cast("string")).alias("transaction_hash"), F.lit(0).alias("log_index"))
    logs = to_bronze(raw).select(*BRONZE_COLUMNS)
    root = os.path.join(tempfile.mkdtemp(prefix="bronze-", dir="/tmp"), "logs")
    write_bronze(logs, root)
    files = [f for _, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    assert len(files) <= 8  # the session's shuffle partitions; 900 days
    back = read_bronze(spark, root)
    assert back.schema["block_date"].dataType == DateType()
    assert sorted(back.select(*BRONZE_COLUMNS).collect()) == sorted(logs.collect())
    assert decode_feedback(back, "2023-02-01").count() == logs.where("block_timestamp >= '2023-02-01'").count() > 0
