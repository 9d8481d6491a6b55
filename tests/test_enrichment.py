"""Metadata fetch and name resolution on hand-made rows (error paths, caches)."""

import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerlens.operators import metadata as M
from ledgerlens.operators import names as N



def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _docs(spark):
    return spark.createDataFrame([
        ("https://a.example/1.json", json.dumps({"name": " One ", "x402": True})),
        ("https://ipfs.io/ipfs/cid2", json.dumps({"agentName": "Two", "services": [{"url": "https://x/X402"}]})),
        ("https://a.example/bad.json", "{nope"),
        ("https://a.example/page", "<html>not json</html>"),
        ("https://a.example/zero.json", "0"),
    ], "uri string, body string")


def test_fetch_metadata_paths(spark):
    b64 = base64.b64encode(json.dumps({"title": "Inline", "payment": {"to": "me"}}).encode()).decode()
    uris = spark.createDataFrame([(u,) for u in [
        "https://a.example/1.json", "ipfs://cid2", "https://a.example/bad.json", "https://a.example/page",
        "https://a.example/missing.json", "https://a.example/zero.json",
        "data:application/json;base64," + b64, "data:application/json,%7Bbroken", None, "ipfs://cid2",
    ]], "token_uri string")
    got = {r["token_uri"]: r for r in M.fetch_metadata(uris, _docs(spark), as_of()).collect()}
    assert len(got) == 8  # distinct, null dropped
    r = got["https://a.example/1.json"]
    assert r["x402"] and r["name"] == "One" and r["error"] is None
    r = got["ipfs://cid2"]
    assert r["resolved_uri"] == "https://ipfs.io/ipfs/cid2" and r["x402"] and r["name"] == "Two"
    assert got["https://a.example/bad.json"]["error"] == M.INVALID_JSON_ERROR
    assert got["https://a.example/page"]["error"] is None and not got["https://a.example/page"]["x402"]
    assert got["https://a.example/missing.json"]["error"] == M.NOT_FOUND_ERROR
    zero = got["https://a.example/zero.json"]
    assert zero["error"] is None and not zero["x402"] and zero["name"] is None
    inline = [v for k, v in got.items() if k.startswith("data:application/json;base64")][0]
    assert inline["x402"] and inline["name"] == "Inline" and inline["resolved_uri"].startswith("data:")
    broken = [v for k, v in got.items() if k.startswith("data:application/json,")][0]
    assert broken["error"] == "Failed to parse data: URI" and broken["raw"] is None


def test_batch_enrich_one_row_per_item(spark):
    items = spark.createDataFrame([(1, "https://a.example/1.json"), (2, None), (3, "https://a.example/1.json")],
                                  "agent_id bigint, token_uri string")
    got = {r["agent_id"]: r for r in M.batch_enrich(items, _docs(spark), as_of()).collect()}
    assert got[1]["x402"] and got[3]["x402"]
    assert got[2]["token_uri"] == "" and got[2]["error"] == "no tokenURI" and not got[2]["x402"]


def test_freshness_boundaries(spark):
    t = dt.datetime(2024, 2, 1)
    cache = spark.createDataFrame([
        ("ok-fresh", t - dt.timedelta(seconds=3600), None),
        ("ok-stale", t - dt.timedelta(seconds=3601), None),
        ("err-fresh", t - dt.timedelta(seconds=300), "boom"),
        ("err-stale", t - dt.timedelta(seconds=301), "boom"),
    ], "token_uri string, fetched_at timestamp, error string")
    fresh = {r["token_uri"] for r in M.fresh_entries(cache, as_of()).collect()}
    assert fresh == {"ok-fresh", "err-fresh"}
    targets = spark.createDataFrame([(k,) for k in ["ok-fresh", "ok-stale", "err-fresh", "err-stale", "new"]], "token_uri string")
    assert {r[0] for r in M.refetch_candidates(targets, cache, as_of()).collect()} == {"ok-stale", "err-stale", "new"}


def test_resolve_names_does_not_cache_failures(spark):
    summary = spark.createDataFrame([(1, "0xAA", 1), (2, "0xbb", 2), (3, "0xAa", 3), (4, "", 4), (5, "0xcc", 5)],
                                    "agent_id bigint, owner_address string, rank bigint")
    names = spark.createDataFrame([("0xaa", "alice.eth", True), ("0xbb", None, False)],
                                  "address string, name string, resolved boolean")
    empty = spark.createDataFrame([], "address string, name string, resolved boolean, fetched_at timestamp")
    results, cache = N.resolve_names(summary, names, empty, as_of())
    r = {x["address"]: x for x in results.collect()}
    assert set(r) == {"0xaa", "0xbb", "0xcc"}
    assert r["0xaa"]["name"] == "alice.eth" and r["0xcc"]["name"] is None and r["0xcc"]["resolved"]
    assert not r["0xbb"]["resolved"]
    assert {x["address"] for x in cache.collect()} == {"0xaa", "0xcc"}
    results2, _ = N.resolve_names(summary, names, cache, as_of())
    r2 = {x["address"]: x["from_cache"] for x in results2.collect()}
    assert r2 == {"0xaa": True, "0xcc": True, "0xbb": False}
    stale = cache.withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 25 HOURS"))
    assert not any(x["from_cache"] for x in N.resolve_names(summary, names, stale, as_of())[0].collect())
    summary_row = N.names_run_summary(results2).first()
    assert summary_row["processed"] == 3 and summary_row["from_cache"] == 2 and summary_row["errors"] == 1


def test_unique_owners_order(spark):
    summary = spark.createDataFrame([(1, "0xAA", 3), (2, "0xbb", 1), (3, "0xaa", 2), (4, None, 4)],
                                    "agent_id bigint, owner_address string, rank bigint")
    got = [(r["address"], r["best_rank"]) for r in N.unique_owners(summary, 10).collect()]
    assert got == [("0xbb", 1), ("0xaa", 2)]


def test_cache_hits_and_misses_partition_targets(spark):
    t = dt.datetime(2024, 2, 1)
    cache = spark.createDataFrame([("a", t, None), ("b", t - dt.timedelta(hours=2), None)],
                                  "token_uri string, fetched_at timestamp, error string")
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "token_uri string")
    hits = {r[0] for r in M.cache_hits(targets, cache, as_of()).collect()}
    misses = {r[0] for r in M.refetch_candidates(targets, cache, as_of()).collect()}
    assert hits == {"a"} and misses == {"b", "c"}
