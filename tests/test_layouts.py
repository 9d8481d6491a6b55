"""Stored layouts: what they return, and how little of the table they read."""

import os
import random
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerlens.config import AGENT_SUMMARY_SCHEMA
from ledgerlens.operators import clients as C
from ledgerlens.operators import paging as P
from ledgerlens.operators import rank as R
from ledgerlens.operators import serve as S
from ledgerlens.session import prepare
from ledgerlens.sources import snapshot as SN

N = 3000


@pytest.fixture(scope="module")
def agents(spark):
    """Agents with many ties: most are unrated, a third registered in the same second."""
    prepare(spark)
    rng = random.Random(4)
    rows = []
    for i in range(N):
        rated = rng.random() < 0.3
        n = rng.choice([1, 1, 2, 40]) if rated else 0
        uri = rng.choice([None, f"https://example.org/agent/{i}.json", f"IPFS://Bafy{i % 50}", "", "é🙂ü", "ab"])
        at = 1_700_000_000 + (0 if i % 3 == 0 else rng.randrange(10**6))
        rows.append((i * 7, f"0x{rng.randrange(40):040X}", uri, at, f"0x{i:064x}", n, n, n, 0, 0, 50.0 if rated else None,
                     round(rng.uniform(20, 90), rng.choice([0, 4])) if rated else 50.0, float(n), at if rated else None, at, 0, rng.random() < 0.2, 1_706_000_000))
    names = AGENT_SUMMARY_SCHEMA.names
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c.endswith('_at') else AGENT_SUMMARY_SCHEMA[c].dataType.simpleString()}" for c in names))
    df = df.select(*(F.timestamp_seconds(c).alias(c) if c.endswith("_at") else F.col(c) for c in names))
    from pyspark.sql import Window
    ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(*R.rank_order())).cast("bigint"))
    return spark.createDataFrame(ranked.collect(), AGENT_SUMMARY_SCHEMA).cache()


@pytest.fixture(scope="module")
def stored(spark, agents, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("paged"))
    P.write_paged(agents, root, rows_per_file=250)
    return P.PagedSummary(spark, root)


def ids(df):
    return [r["agent_id"] for r in df.collect()]


REQUESTS = [S.ListRequest(sort=sort, rated=rated, x402=x402, offset=offset, limit=limit)
            for sort, rated, x402, offset, limit in [
                ("rank", False, False, 0, 50), ("reputation", True, False, 240, 120), ("feedback", False, True, 500, 200),
                ("recency", True, True, 100, 50), ("recent", False, False, N - 10, 50), ("nonsense", False, False, 1234, 1),
                ("rank", False, False, 10**9, 50), ("feedback", False, False, "249", "2")]]


@pytest.mark.parametrize("req", REQUESTS)
def test_pages_equal_the_sorted_list(agents, stored, req):
    got = stored.page(req)
    assert ids(got) == ids(S.list_agents(agents, req))
    assert got.columns == agents.columns
    assert stored.envelope(req).collect() == S.list_envelope(agents, req).collect()


def test_a_page_reads_the_files_that_hold_it(stored):
    assert stored.index.where("mode = 'rank'").count() == N // 250
    for req in REQUESTS:
        found = stored.page(req).inputFiles()
        rows = stored.index.where(F.col("path").isin([f for f in found])).agg(F.sum("rows")).first()[0] if found else 0
        # As many files as a page can touch; under a filter a file holds fewer rows of the page.
        assert len(found) <= (2 if not (req.rated or req.x402) else 6), (req, rows)
    plan = stored.page(S.ListRequest(offset=2900))._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit 150" in plan or "Limit 200" in plan  # 100 or 150 rows skipped inside the file, not 2,900


@pytest.mark.parametrize("q", ["agent/12", "AGENT/1", "bafy4", "0x000", "7", "42", "147", "é🙂ü", "🙂ü", "ab", "no such", "json", "%", "e_a", "x" * 300])
def test_search_equals_the_scan(agents, stored, q):
    assert sorted(ids(stored.matches(q))) == sorted(ids(S.filter_agents(agents, q)))
    req = S.ListRequest(q=q, sort="feedback", limit=20, offset=15)
    assert ids(stored.page(req)) == ids(S.list_agents(agents, req))
    assert stored.envelope(req).collect() == S.list_envelope(agents, req).collect()


def test_search_reads_few_files_and_lists(spark, stored):
    ranks = stored.candidates("agent/1234")
    assert len(stored.candidate_files(ranks)) <= 1
    assert stored.candidates("no such agent").count() == 0 and stored.candidates("ab") is None
    lists = spark.read.parquet(f"{stored.base}/postings")
    assert lists.agg(F.max(F.size("ranks"))).first()[0] <= P.CHUNK
    wide = lists.where(F.size("ranks") != F.size(F.array_distinct("ranks"))).count()
    assert wide == 0


def test_many_small_files_neither_multiply_nor_meet_every_rank(spark, agents, tmp_path):
    P.write_paged(agents, str(tmp_path), rows_per_file=1)
    many = P.PagedSummary(spark, str(tmp_path))
    files = many.index.where("mode = 'rank'").collect()
    assert 0.9 * N ** 0.5 < len(files) <= N ** 0.5
    ranks = [1, 2, 700, N // 2, N]
    asked = spark.createDataFrame([(r,) for r in ranks], "rank bigint")
    want = {f["path"] for f in files if any(f["rows_before"] < r <= f["rows_before"] + f["rows"] for r in ranks)}
    assert sorted(many.candidate_files(asked)) == sorted(want)
    assert many.candidate_files(asked.where("rank > 10000000")) == []
    everything = many.candidate_files(spark.range(1, N + 1).select(F.col("id").alias("rank")))
    assert sorted(everything) == sorted(f["path"] for f in files)
    for q in ("agent/1234", "0x0", "json"):
        assert sorted(ids(many.matches(q))) == sorted(ids(S.filter_agents(agents, q)))


def test_long_texts_are_cut_into_trigrams_in_linear_time(spark):
    text = "".join(random.Random(1).choices("abcdefghij", k=200_000))
    got = spark.createDataFrame([(text,)], "t string").select(P.grams(F.col("t")).alias("g")).first()["g"]
    assert set(got) == {text[i:i + 3] for i in range(len(text) - 2)}
    short = spark.createDataFrame([(None,), ("",), ("ab",), ("ABc",)], "t string").select(P.grams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in short] == [[], [], [], ["abc"]]


def test_an_empty_table_has_empty_pages(spark, tmp_path):
    P.write_paged(spark.createDataFrame([], AGENT_SUMMARY_SCHEMA), str(tmp_path))
    empty = P.PagedSummary(spark, str(tmp_path))
    assert ids(empty.page(S.ListRequest())) == [] and ids(empty.page(S.ListRequest(q="agent"))) == []
    assert empty.envelope(S.ListRequest()).first()["total"] == 0
    with pytest.raises(ValueError):
        P.PagedSummary(spark, str(tmp_path / "nowhere"))


# --- ranks by counting -------------------------------------------------------

def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def unranked(agents):
    return agents.drop("rank", "x402", "computed_at")


def test_rank_by_counting_equals_row_number_and_plans_without_a_job(spark, agents):
    before = jobs(spark)
    got = R.rank_by_counting(unranked(agents))
    assert jobs(spark) == before
    assert {r["agent_id"]: r["rank"] for r in got.collect()} == {r["agent_id"]: r["rank"] for r in agents.collect()}
    assert R.rank_by_counting(unranked(agents.limit(0))).count() == 0


def test_rank_cells_are_bounded_when_everything_is_tied(spark):
    df = spark.range(200_000).select(F.col("id").alias("agent_id"), F.lit(50.0).alias("reputation_score"), F.lit(0).cast("bigint").alias("feedback_count"),
                                     F.timestamp_seconds(F.lit(1_700_000_000)).alias("registered_at"))
    assert R.cell_histogram(df).agg(F.max("n")).first()[0] <= 1 << R.BLOCK_BITS
    assert R.rank_by_counting(df).where(F.col("rank") != F.col("agent_id") + 1).count() == 0


def test_a_refresh_numbers_touched_cells_only(spark, agents, tmp_path):
    base = unranked(agents)
    def put(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    placed, cells = put(R.positions(base), "placed"), put(R.cell_histogram(base), "cells")
    some = base.where("agent_id % 91 = 0").withColumns({"reputation_score": F.lit(77.5), "feedback_count": F.col("feedback_count") + 1})
    new = base.limit(1).withColumns({"agent_id": F.lit(10**9).cast("bigint"), "reputation_score": F.lit(99.0)})
    changed = put(some.unionByName(new), "changed")
    same, again, delta = R.refresh_positions(placed, changed)
    got = R.apply_bases(same.unionByName(again), R.cell_bases(R.merge_cells(cells, delta)))
    after = put(base.join(changed.select("agent_id"), "agent_id", "left_anti").select(*base.columns).unionByName(changed.select(*base.columns)), "after")
    assert {r["agent_id"]: r["rank"] for r in got.collect()} == {r["agent_id"]: r["rank"] for r in R.rank_by_counting(after).collect()}
    # 700 unrated agents of one second are one cell, which some changed agents leave.
    assert again.count() < N / 3 and same.count() + again.count() == N + 1


# --- cache buckets -----------------------------------------------------------

def cache_rows(spark, keys, at):
    return spark.createDataFrame([Row(k=k, v=f"{k}@{at}", at=at) for k in keys], "k string, v string, at int")


def bucket_files(spark, root):
    return {(r["bucket"], r["p"]) for r in SN.read_buckets(spark, root).select("bucket", F.col("_metadata.file_path").alias("p")).distinct().collect()}


def test_an_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path)
    assert SN.read_buckets(spark, root) is None
    keys = [f"key{i}" for i in range(1000)]
    SN.upsert_buckets(spark, root, cache_rows(spark, keys, 1), "k")
    first = bucket_files(spark, root)
    touched = SN.upsert_buckets(spark, root, cache_rows(spark, keys[:10] + ["new"], 2), "k")
    second = bucket_files(spark, root)
    assert 1 <= len(touched) <= 11 and {b for b, _ in first ^ second} == set(touched)
    got = {r["k"]: r["v"] for r in SN.read_buckets(spark, root).collect()}
    assert got == {k: f"{k}@{2 if k in keys[:10] else 1}" for k in keys} | {"new": "new@2"}
    assert SN.upsert_buckets(spark, root, cache_rows(spark, [], 3), "k") == [] and bucket_files(spark, root) == second


@pytest.mark.parametrize("few", [11, 10])
def test_few_new_keys_move_no_old_row(spark, tmp_path, monkeypatch, few):
    root, keys, moved = str(tmp_path), [f"key{i}" for i in range(1000)], []
    monkeypatch.setattr(SN, "FEW_KEYS", few, raising=False)
    cls = type(spark.range(1))
    was = cls.repartition
    monkeypatch.setattr(cls, "repartition", lambda df, *a: (moved.append(df.count()), was(df, *a))[1])
    first = SN.upsert_buckets(spark, root, cache_rows(spark, keys, 1), "k", buckets=4)
    assert first == [0, 1, 2, 3] and not os.path.exists(f"{root}/_incoming")  # nothing staged for a new cache
    SN.upsert_buckets(spark, root, cache_rows(spark, keys[:10] + ["new"], 2), "k", buckets=4)
    assert moved == [1000, 11 if few == 11 else 1001]
    rows = SN.read_buckets(spark, root).collect()
    assert len(rows) == 1001 and {r["k"]: r["v"] for r in rows} == {k: f"{k}@{2 if k in keys[:10] else 1}" for k in keys} | {"new": "new@2"}


def test_a_first_run_that_fails_or_has_no_rows_leaves_no_cache(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(Exception):
        SN.upsert_buckets(spark, root, cache_rows(spark, ["a", "b"], 1).withColumn("v", F.raise_error(F.lit("lost"))), "k")
    assert SN.read_buckets(spark, root) is None
    assert SN.upsert_buckets(spark, root, cache_rows(spark, [], 1), "k") == [] and SN.read_buckets(spark, root) is None
    assert len(SN.upsert_buckets(spark, root, cache_rows(spark, ["a"], 1), "k")) == 1
    assert [r["v"] for r in SN.read_buckets(spark, root).collect()] == ["a@1"]


def test_expired_rows_leave_with_a_rewrite(spark, tmp_path):
    root = str(tmp_path)
    SN.upsert_buckets(spark, root, cache_rows(spark, [f"key{i}" for i in range(64)], 1), "k", buckets=2)
    touched = SN.upsert_buckets(spark, root, cache_rows(spark, ["key0"], 9), "k", F.col("at") > 5, buckets=2)
    left = SN.read_buckets(spark, root).collect()
    assert {r["k"] for r in left if r["bucket"] in touched} == {"key0"} and len({r["bucket"] for r in left}) == 2


def test_a_failed_run_leaves_the_old_rows(spark, tmp_path):
    root = str(tmp_path)
    SN.upsert_buckets(spark, root, cache_rows(spark, ["a", "b", "c"], 1), "k")
    before, files = sorted(map(tuple, SN.read_buckets(spark, root).collect())), bucket_files(spark, root)
    bad = cache_rows(spark, ["a", "d"], 2).withColumn("v", F.when(F.col("k") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        SN.upsert_buckets(spark, root, bad, "k")
    late = F.raise_error(F.lit("late")).cast("boolean")  # fails while the touched buckets are written
    with pytest.raises(Exception, match="late"):
        SN.upsert_buckets(spark, root, cache_rows(spark, ["a"], 3), "k", late)
    assert sorted(map(tuple, SN.read_buckets(spark, root).collect())) == before and bucket_files(spark, root) == files


# --- lookups by id -----------------------------------------------------------

def rows_scanned(df):
    """Rows that the scan of an executed, not adaptive plan passed on."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    leaves = qe.executedPlan().collectLeaves()
    scan = leaves.apply(0)
    return scan.metrics().get("numOutputRows").get().value()


def test_a_lookup_skips_row_groups(spark, agents, tmp_path):
    wide = spark.range(0, 40_000, 2).crossJoin(agents.limit(1).drop("agent_id")).select(
        F.col("id").alias("agent_id"), *[F.sha2(F.col("id").cast("string"), 256).alias("registered_tx") if c == "registered_tx" else F.col(c)
                                         for c in agents.columns if c != "agent_id"])
    root = str(tmp_path / uuid.uuid4().hex)
    SN.write_by_id(wide.select(*agents.columns), root, row_group_bytes=64 << 10)
    hit = SN.read_by_id(spark, root, [31_234])
    assert ids(hit) == [31_234]
    assert rows_scanned(SN.read_by_id(spark, root, [31_234])) < 5_000
    # An odd id lies between the bounds of a row group: only its Bloom filter tells that no agent has it.
    assert rows_scanned(SN.read_by_id(spark, root, [31_233])) == 0 and rows_scanned(SN.read_by_id(spark, root, [10**9])) == 0
    assert sorted(ids(SN.read_by_id(spark, root, [4, 6, 5, -1]))) == [4, 6] and ids(SN.read_by_id(spark, root, [])) == []
    found = S.lookup_agents(SN.read_by_id(spark, root, S.requested_ids(["8", "9", "x"])), ["8", "9", "x"])
    assert sorted((r["requested"], r["status"]) for r in found.collect()) == [("8", "found"), ("9", "missing"), ("x", "invalid")]


# --- client sketches ---------------------------------------------------------

def test_client_states_merge_and_stay_within_their_error(spark):
    day = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 10) * 86_400)
    feedback = spark.range(120_000).select((F.col("id") % 3).alias("agent_id"), F.sha1((F.col("id") % 60_000).cast("string").cast("binary")).alias("client_address"),
                                           day.alias("created_at"))
    states = C.client_states(feedback)
    exact = {r["agent_id"]: r for r in feedback.groupBy("agent_id").agg(F.countDistinct("client_address").alias("n"), F.count("*").alias("v")).collect()}
    for r in C.clients_between(states).collect():
        assert r["votes"] == exact[r["agent_id"]]["v"]
        assert abs(r["unique_clients"] / exact[r["agent_id"]]["n"] - 1) < 4 * 1.04 / 2 ** (C.LG_K / 2)
    halves = C.client_states(feedback.where("id % 2 = 0")).unionByName(C.client_states(feedback.where("id % 2 = 1")))
    one = sorted(map(tuple, C.clients_between(states, "2024-01-03", "2024-01-05").collect()))
    assert one == sorted(map(tuple, C.clients_between(C.merge_states(halves), "2024-01-03", "2024-01-05").collect())) and len(one) == 3
    few = C.client_states(feedback.where("id < 300"))
    assert all(r["unique_clients"] == 100 for r in C.clients_between(few).collect())
