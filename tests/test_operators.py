"""Operator-level properties: scaled rank, paging, score invariants, latest-per-key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_CONFIG
from ledgerlens.operators import serve as S
from ledgerlens.operators.latest import latest_per_key
from ledgerlens.operators.rank import global_row_number, rank_order
from ledgerlens.plans.summary import build_agent_summary, scored_agents
from ledgerlens.sources.fixtures import fixture_logs

from .conftest import SF_ORACLE, SF_SMALL


@pytest.fixture(scope="module")
def summary(spark):
    return build_agent_summary(fixture_logs(spark, SF_SMALL)).cache()


def test_scaled_rank_equals_window_rank(spark):
    scored = scored_agents(fixture_logs(spark, SF_ORACLE))
    w = Window.orderBy(*rank_order())
    expected = {r["agent_id"]: r["rn"] for r in scored.select("agent_id", F.row_number().over(w).alias("rn")).collect()}
    for parts in (1, 3, 16):
        got = {r["agent_id"]: r["rank"] for r in global_row_number(scored, rank_order(), "rank", parts).collect()}
        assert got == expected


def test_rank_is_permutation(summary):
    ranks = sorted(r["rank"] for r in summary.select("rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_score_properties(summary):
    rows = summary.collect()
    for r in rows:
        assert 0.0 <= r["reputation_score"] <= 100.0
        if r["feedback_count"] == 0:
            assert r["reputation_score"] == 50.0
            assert r["avg_raw_score"] is None and r["last_feedback_at"] is None
        else:
            assert r["positive_count"] + r["neutral_count"] + r["negative_count"] == r["feedback_count"]
            assert r["unique_clients"] <= r["feedback_count"]
        assert r["last_activity_at"] >= r["registered_at"]


def test_half_life(spark):
    from dataclasses import replace

    from ledgerlens.operators.decode import decode_feedback
    from ledgerlens.operators.score import score_feedback
    import datetime as dt

    fb = decode_feedback(fixture_logs(spark, SF_SMALL)).limit(50)
    a = score_feedback(fb, DEFAULT_CONFIG).select("w").collect()
    later = replace(DEFAULT_CONFIG, as_of=DEFAULT_CONFIG.as_of + dt.timedelta(days=30))
    b = score_feedback(fb, later).select("w").collect()
    for x, y in zip(a, b):
        assert abs(x["w"] / 2 - y["w"]) < 1e-12


def test_pages_follow_one_another_in_order(summary):
    order = S.sort_columns("feedback")
    every = sorted(summary.collect(), key=lambda r: (-r["feedback_count"], -r["reputation_score"], r["rank"]))
    got = [r["agent_id"] for o in range(0, 150, 20) for r in S.page(summary, order, 20, o).collect()]
    assert got == [r["agent_id"] for r in every]


def test_point_lookup(summary):
    assert S.agent_by_id(summary, "7").count() == 1
    assert S.agent_by_id(summary, 10**6).count() == 0
    assert S.agent_by_id(summary, str(2**63)).count() == 0
    for bad in ("x", "-1", None):
        with pytest.raises(ValueError):
            S.agent_by_id(summary, bad)


@pytest.mark.parametrize("raw,expected", [
    (None, 50), ("0", 50), ("junk", 50), ("-5", 1), ("500", 200), ("12abc", 12), (" 7", 7), (30, 30),
])
def test_parse_limit(raw, expected):
    assert S.parse_limit(raw) == expected


def test_parse_offset():
    assert S.parse_offset("-1") == 0 and S.parse_offset("x") == 0 and S.parse_offset("15") == 15


def test_point_lookup(summary):
    assert S.agent_by_id(summary, "3").count() == 1
    assert S.agent_by_id(summary, 10**9).count() == 0
    with pytest.raises(ValueError):
        S.agent_by_id(summary, "abc")
    with pytest.raises(ValueError):
        S.agent_by_id(summary, -1)


def test_latest_per_key_null_wins(spark):
    df = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, None), (2, 5, 1, "x"), (2, 5, 2, "y")],
                               "k int, ts int, li int, v string")
    got = {r["k"]: r["v"] for r in latest_per_key(df, "k", ["ts", "li"], ["v"]).collect()}
    assert got == {1: None, 2: "y"}


def test_sort_modes_end_in_rank():
    for mode in ("rank", "reputation", "feedback", "recent", "recency", "bogus"):
        assert "rank" in str(S.sort_columns(mode)[-1])


def test_latest_and_earliest_equal_window_forms(spark):
    from ledgerlens.operators.decode import latest_uris, registrations, first_registrations, uri_updates

    logs = fixture_logs(spark, SF_ORACLE)
    upd = uri_updates(logs)
    w = Window.partitionBy("agent_id").orderBy(F.col("block_timestamp").desc(), F.col("log_index").desc())
    by_window = {r["agent_id"]: r["new_uri"] for r in
                 upd.withColumn("rn", F.row_number().over(w)).where("rn = 1").collect()}
    assert {r["agent_id"]: r["new_uri"] for r in latest_uris(logs).collect()} == by_window
    reg = registrations(logs)
    w2 = Window.partitionBy("agent_id").orderBy("registered_at", "log_index")
    first = {r["agent_id"]: (r["owner_address"], r["registered_at"]) for r in
             reg.withColumn("rn", F.row_number().over(w2)).where("rn = 1").collect()}
    got = {r["agent_id"]: (r["owner_address"], r["registered_at"]) for r in first_registrations(logs).collect()}
    assert got == first


def test_wq_invariant_under_as_of_shift(spark):
    import datetime as dt
    from dataclasses import replace

    from ledgerlens.operators.decode import decode_feedback
    from ledgerlens.operators.score import aggregate_agents, score_feedback

    fb = decode_feedback(fixture_logs(spark, SF_SMALL))
    a = {r["agent_id"]: (r["wq"], r["eff_n"]) for r in aggregate_agents(score_feedback(fb, DEFAULT_CONFIG)).collect()}
    later = replace(DEFAULT_CONFIG, as_of=DEFAULT_CONFIG.as_of + dt.timedelta(days=45))
    b = {r["agent_id"]: (r["wq"], r["eff_n"]) for r in aggregate_agents(score_feedback(fb, later)).collect()}
    for k, (wq, eff) in a.items():
        assert abs(wq - b[k][0]) < 1e-9
        assert abs(eff * 0.5 ** 1.5 - b[k][1]) < 1e-9


def test_presentation_order(spark):
    from ledgerlens.operators.decode import decode_feedback, decode_identity

    logs = fixture_logs(spark, SF_SMALL)
    ids = [r["agent_id"] for r in decode_identity(logs, ordered=True).collect()]
    assert ids == sorted(ids)
    ts = [r["created_at"] for r in decode_feedback(logs, ordered=True).collect()]
    assert ts == sorted(ts)
