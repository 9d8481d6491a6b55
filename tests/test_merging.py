"""Additive statistics, bucketed documents and strings by offset words."""

import uuid

from pyspark.sql import functions as F

from ledgerlens.config import AS_OF, REPUTATION_REGISTRY, TOPIC
from ledgerlens.functions.hexabi import abi_string_tail, uint_word
from ledgerlens.operators import metadata as M
from ledgerlens.operators import serve as S
from ledgerlens.operators.decode import decode_feedback_texts
from ledgerlens.plans import catalog  # noqa: F401  registers the queries in order
from ledgerlens.plans.queries_serve import unranked
from ledgerlens.session import checkpoint_dir, prepare
from ledgerlens.sources.fixtures import metadata_documents
from ledgerlens.sources.logs import BRONZE_COLUMNS
from ledgerlens.sources.snapshot import read_buckets

from .conftest import SF_SMALL


def now():
    return F.lit(AS_OF).cast("timestamp")


def test_parts_merge_to_the_direct_document(spark):
    prepare(spark)
    agents = unranked(spark, SF_SMALL).withColumn("x402", F.col("agent_id") % 3 == 0).cache()
    moved = agents.where("agent_id % 5 = 1").withColumns({"reputation_score": F.lit(93.25), "feedback_count": F.col("feedback_count") + 2,
                                                         "x402": ~F.col("x402"), "token_uri": F.lit(None).cast("string")})
    left = agents.where("agent_id % 5 = 1 OR agent_id % 5 = 2")
    after = agents.where("agent_id % 5 NOT IN (1, 2)").unionByName(moved)
    merged = S.merge_parts(S.stats_parts(moved), S.stats_parts(left, -1), S.stats_parts(agents))
    assert sorted(map(str, merged.collect())) == sorted(map(str, S.merge_parts(S.stats_parts(after)).collect()))
    assert S.stats_from_parts(merged, AS_OF, now()).collect() == S.stats_document_json(after, AS_OF).collect()


def test_parts_of_no_agents(spark):
    prepare(spark)
    agents = unranked(spark, SF_SMALL)
    gone = S.merge_parts(S.stats_parts(agents), S.stats_parts(agents, -1))
    assert gone.count() == 0
    assert S.stats_from_parts(gone, AS_OF, now()).collect() == S.stats_document_json(agents.limit(0), AS_OF).collect()


def test_bodies_stay_in_their_buckets_and_are_parsed_once(spark):
    prepare(spark)
    table = f"documents_{uuid.uuid4().hex[:8]}"
    documents = metadata_documents(spark, SF_SMALL)
    M.store_documents(documents, table, 8)
    uris = spark.createDataFrame([("https://example.org/agent/2.json",), ("ipfs://bafyagent4.json",), ("https://ipfs.io/ipfs/bafyagent4.json",), (None,),
                                  ("https://nowhere.example/x.json",), ("data:application/json,%7B%22name%22%3A%22n%22%7D",)], "token_uri string")
    uris = uris.unionByName(uris)
    got = M.fetch_stored(uris, table, now()).drop("raw")
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    below = lines[next(i for i, line in enumerate(lines) if "SortMergeJoin" in line):]
    bodies = next(i for i, line in enumerate(below) if "FileScan" in line and "Bucketed: true" in line)
    uris_end = next(i for i, line in enumerate(below) if "Scan ExistingRDD" in line)
    # The URIs are made distinct and go to the bodies' buckets; nothing moves the bodies.
    assert sum("Exchange" in line for line in below[:uris_end]) == 2 and not any("Exchange" in line for line in below[uris_end:bodies])
    assert sorted(map(str, got.collect())) == sorted(map(str, M.fetch_metadata(uris, documents, now()).drop("raw").collect()))

    root = f"{checkpoint_dir(spark)}/cache-{uuid.uuid4().hex[:8]}"
    summary = uris.where("token_uri is not null").distinct().select(F.monotonically_increasing_id().alias("agent_id"), "token_uri").withColumn("rank", F.col("agent_id") + 1)
    first = {r["token_uri"]: r for r in M.enrichment_run(summary, table, root, now()).collect()}
    again = {r["token_uri"]: r for r in M.enrichment_run(summary, table, root, now() + F.expr("INTERVAL 20 MINUTES")).collect()}
    assert not any(r["from_cache"] for r in first.values())
    # Errors live five minutes, records an hour.
    assert {u for u, r in again.items() if r["from_cache"]} == {u for u, r in first.items() if r["error"] is None}
    assert {r["token_uri"] for r in read_buckets(spark, root).collect()} == set(first)


def logs_with(spark, data):
    rows = [(REPUTATION_REGISTRY, [TOPIC["NewFeedback"], "0x" + f"{i:064x}", "0x" + "0" * 24 + "a" * 40, "0x" + "0" * 64], d, 0, f"0x{i}", 0, TOPIC["NewFeedback"], 4, None)
            for i, d in enumerate(data)]
    df = spark.createDataFrame(rows, "address string, topics array<string>, data string, s bigint, transaction_hash string, log_index bigint, topic0 string, topic_count int, d string")
    return df.withColumns({"block_timestamp": F.timestamp_seconds("s"), "block_date": F.to_date(F.timestamp_seconds("s"))}).select(*BRONZE_COLUMNS)


def words(spark, *columns):
    return spark.range(1).select(F.concat(*columns).alias("w")).first()["w"]


def test_texts_follow_their_offset_words(spark):
    prepare(spark)

    def w(n):
        return f"{n:064x}"
    tail = {t: words(spark, abi_string_tail(F.lit(t))) for t in ("", "a", "b" * 32, "c" * 33)}
    head = [w(5), w(1), w(0)]

    def data(offsets, *tails):
        return "0x" + "".join([*head, *(o if isinstance(o, str) else w(o) for o in offsets), w(9), *tails])
    a, b, c, e = tail["a"], tail["b" * 32], tail["c" * 33], tail[""]
    cases = {
        "plain": (data([256, 320, 384, 480], a, b, c, e), ("a", "b" * 32, "c" * 33, "")),
        "reversed": (data([448, 384, 288, 256], e, c, b, a), ("a", "b" * 32, "c" * 33, "")),
        "gap": (data([256, 384, 448, 544], a, "f" * 128, b, c, e), ("a", "b" * 32, "c" * 33, "")),
        "shared": (data([256, 256, 320, 416], a, c, e), (None, None, "c" * 33, "")),
        "inside": (data([256, 352, 288, 384], c, a, e), ("c" * 33, "a", None, None)),  # the bytes inside a text are no length
        "huge": (data(["f" * 64, "7" + "f" * 63, w(2**63), 256], a), (None, None, None, "a")),
        "beyond": (data([256, 320, 10**6, 384], a, a), ("a", "a", None, None)),
        "in the head": (data([0, 224, 32, 256], a), (None, None, None, "a")),
        "cut": (data([256, 320, 384, 480], a, b)[:-2], ("a", None, None, None)),
        "long": (data([256, 320, 384, 448], w(2**31) + w(0), w(2**64) + w(0), w(200) + w(0), a), (None, None, None, "a")),
        "junk": ("0x" + "zz" * 400, (None,) * 4), "empty": ("0x", (None,) * 4), "null": (None, (None,) * 4),
    }
    got = decode_feedback_texts(logs_with(spark, [d for d, _ in cases.values()])).orderBy("agent_id").collect()
    assert {k: (r["tag1"], r["tag2"], r["endpoint"], r["feedback_uri"]) for k, r in zip(cases, got)} == {k: v for k, (_, v) in cases.items()}
