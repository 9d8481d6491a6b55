"""Edge rows for the column functions (hex, ABI strings, int128, URIs, JSON)."""

import base64
import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import hexabi, uri, variant
from ledgerlens.functions.names import attestation_key, classify_identifier
from ledgerlens.functions.scoring import bucket_percent, clamp01, relative_age, score_tier


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("h,expected", [
    ("0x" + "0" * 64, 0),
    ("0x" + "0" * 63 + "1", 1),
    ("0x" + "0" * 48 + "7fffffffffffffff", 2**63 - 1),
    ("0x" + "0" * 48 + "8000000000000000", None),
    ("0x" + "0" * 46 + "100000000000000000", None),
    ("0x" + "0" * 60 + "zz12", None),
    ("0x123", 0x123),
    ("0xABCDEF", 0xABCDEF),
    ("0x", None),
    (None, None),
])
def test_hex_to_long(spark, h, expected):
    assert one(spark, hexabi.hex_to_long, h) == expected


ABI_STRING = hexabi.sql_abi_string("data", hexabi.sql_hex_digits_to_long(hexabi.sql_data_word("data", 1)))


def decode(spark, data, sql):
    return spark.createDataFrame([(data,)], "data string").selectExpr(f"{sql} AS r").first()["r"]


def parsed(df):
    df = df.withColumn("v", variant.parse_json_or_null("body"))
    return df.withColumns({"o": variant.as_object(F.col("v")), "a": variant.as_array(F.col("v"))})


def word(n):
    return format(n % (1 << 256), "064x")


@pytest.mark.parametrize("v", [0, 1, -1, 2**63, -(2**63), 2**63 + 1, -(2**63 + 1), -(2**64), 85 * 10**18,
                               -85 * 10**18, 2**127 - 1, -(2**127)])
def test_int128(spark, v):
    data = "0x" + word(7) + word(v)
    got = decode(spark, data, hexabi.sql_int128_low_word(hexabi.sql_data_word('data', 1)))
    assert got == float(v)


def abi(s: bytes):
    n = len(s)
    pad = (-n) % 32
    return "0x" + word(32) + word(n) + (s + b"\0" * pad).hex()


@pytest.mark.parametrize("raw,expected", [
    (b"", ""),
    (b"https://a.example/x.json", "https://a.example/x.json"),
    ("héllo✓".encode(), "héllo✓"),
    (b"a\xffb", "a�b"),
])
def test_abi_string(spark, raw, expected):
    assert decode(spark, abi(raw), ABI_STRING) == expected


def test_abi_string_length_past_end(spark):
    data = "0x" + word(32) + word(100) + b"abc".hex()
    assert decode(spark, data, ABI_STRING) == "abc"


def test_encoders_roundtrip(spark):
    df = spark.createDataFrame([("héllo/x402",), ("",)], "s string")
    out = df.select(hexabi.abi_string_data(F.col("s")).alias("data"), "s").selectExpr(f"{ABI_STRING} AS r", "s").collect()
    assert all(r["r"] == r["s"] for r in out)
    df = spark.createDataFrame([(-5,), (0,), (2**62,)], "n bigint")
    out = df.select(hexabi.int_word(F.col("n")).alias("w"), "n").selectExpr(f"{hexabi.sql_int128_low_word('w')} AS r", "n").collect()
    assert [r["r"] for r in out] == [float(r["n"]) for r in out]


def test_clamp_keeps_null(spark):
    assert one(spark, clamp01, None, "double") is None
    assert one(spark, clamp01, 4.9, "double") == 1.0
    assert one(spark, clamp01, -0.2, "double") == 0.0


def test_tiers_and_percent(spark):
    assert one(spark, score_tier, 70.0, "double") == "high (>=70)"
    assert one(spark, score_tier, 40.0, "double") == "medium (40-70)"
    assert one(spark, score_tier, 39.99, "double") == "low (<40)"
    df = spark.createDataFrame([(1, 3), (0, 0), (1, 2)], "n bigint, t bigint")
    assert [r[0] for r in df.select(bucket_percent("n", "t")).collect()] == [33, None, 50]


def test_relative_age(spark):
    df = spark.sql("""select * from values
        (timestamp'2024-02-01 00:00:00'), (timestamp'2024-01-31 00:00:00'), (timestamp'2024-01-20 00:00:00'),
        (timestamp'2023-11-01 00:00:00'), (timestamp'2021-01-01 00:00:00'), (timestamp'2024-02-03 00:00:00') as t(ts)""")
    got = [r[0] for r in df.select(relative_age("ts", F.lit("2024-02-01 00:00:00").cast("timestamp"))).collect()]
    assert got == ["today", "1d ago", "12d ago", "3mo ago", "3y ago", "-2d ago"]


@pytest.mark.parametrize("u,expected", [
    ("data:application/json;base64," + base64.b64encode(b'{"a":1}').decode(), '{"a":1}'),
    ("data:application/json;base64," + base64.b64encode(b'{"a":12}').decode().rstrip("="), '{"a":12}'),
    ("data:application/json;base64," + base64.urlsafe_b64encode(b'{"a":"??>"}').decode(), '{"a":"??>"}'),
    ("data:application/json;base64,eyJh\n IjoxfQ==", '{"a":1}'),
    ("data:application/json," + quote('{"a": "x+y, z"}'), '{"a": "x+y, z"}'),
    ('data:text/plain,{"a":"1+1"}', '{"a":"1+1"}'),
    ("data:application/json,%E0%A4%A", None),
    ("data:application/json,", None),
    ("data:application/json;base64,", None),
    ("https://example.org/a.json", None),
    ("data:nocomma", None),
])
def test_data_uri(spark, u, expected):
    assert one(spark, uri.data_uri_text, u) == expected


def test_resolve_uri(spark):
    assert one(spark, uri.resolve_uri, "ipfs://bafy/x.json") == "https://ipfs.io/ipfs/bafy/x.json"
    assert one(spark, uri.resolve_uri, "https://a/b") == "https://a/b"


# x402 matrix: expected hits 1,4,5,7,8,9,10,11
X402_DOCS = {
    1: {"a": {"b": {"c": {"d": "has x402 inside"}}}},
    2: {"a": {"b": {"c": {"d": {"e": "x402"}}}}},
    3: {"X402Support": False},
    4: {"x402support": 1.0},
    5: {"payment": False},
    6: {"accepts": []},
    7: {"services": [["https://h/X402/pay"]]},
    8: '{"x402": false, "x402": true}',
    9: {"payment": {}},
    10: "plain x402 string",
    11: {"payable": "true"},
    12: "{not json",
}


def test_x402_matrix(spark):
    rows = [(k, v if isinstance(v, str) and k in (8, 12) else json.dumps(v)) for k, v in X402_DOCS.items()]
    df = spark.createDataFrame(rows, "k int, body string")
    got = {r["k"]: r["hit"] for r in parsed(df).selectExpr("k", f"{variant.sql_detect_x402('v', 'o', 'a')} AS hit").collect()}
    assert {k for k, v in got.items() if v} == {1, 4, 5, 7, 8, 9, 10, 11}


def test_first_string(spark):
    rows = [
        (1, json.dumps({"name": "  Alice ", "title": "T"})),
        (2, json.dumps({"name": 5, "agentName": "Bob"})),
        (3, json.dumps({"name": "   ", "title": " Tee\n"})),
        (4, json.dumps([{"name": "x"}])),
        (5, json.dumps({"other": 1})),
    ]
    df = spark.createDataFrame(rows, "k int, body string")
    got = {r["k"]: r["n"] for r in parsed(df).select("k", F.expr(variant.sql_first_string("v", ["name", "agentName", "agent_name", "title"])).alias("n")).collect()}
    assert got == {1: "Alice", 2: "Bob", 3: "Tee", 4: None, 5: None}


def test_truthy_root(spark):
    df = spark.createDataFrame([(s,) for s in ["0", "false", '""', "null", "1", "{}", "[]", '"a"']], "b string")
    got = [r[0] for r in parsed(df.withColumnRenamed("b", "body")).select(F.expr(variant.sql_is_truthy_root("v", "o", "a"))).collect()]
    assert got == [False, False, False, False, True, True, True, True]


def test_names_helpers(spark):
    assert one(spark, attestation_key, 7, "bigint") == (
        "agent-registration[0x0001000001018004a169fb4a3325136eb29fa0ceb6d2e539a432][7]")
    df = spark.createDataFrame([(s,) for s in ["  0x" + "aB" * 20 + " ", "alice.eth", "bob", "", None, "0x123"]], "q string")
    assert [r[0] for r in df.select(classify_identifier(F.col("q"))).collect()] == [
        "address", "name", "invalid", "invalid", "invalid", "invalid"]


def test_percent_body_may_spell_the_replacement_character(spark):
    from ledgerlens.functions.uri import data_uri_text
    rows = [("data:,a%EF%BF%BDb", "a\ufffdb"), ("data:,\ufffd%ef%bf%bd", "\ufffd\ufffd"), ("data:,%FF", None), ("data:,%EF%BF%BD%FF", None), ("data:,ok", "ok")]
    got = spark.createDataFrame(rows, "u string, want string").select(data_uri_text("u"), "want").collect()
    assert all(a == b for a, b in got), got


def test_rounding_of_old_snapshots_does_not_raise(spark):
    from ledgerlens.functions.scoring import round_half_up
    got = spark.sql("select 1e40D as x, cast(41.605 as decimal(20,9)) as d").select(round_half_up("x", 4), round_half_up("d", 2)).first()
    assert tuple(got) == (1e40, 41.61)


@pytest.mark.parametrize("w", ["f" * 64, "0" * 56 + "ffffffff", "0" * 48 + "7" + "f" * 15, "0" * 56 + "80000000"])
def test_hostile_length_words_do_not_raise(spark, w):
    got = decode(spark, "0x" + "0" * 62 + "20" + w + "61" * 32, ABI_STRING)
    assert got == (None if w == "f" * 64 else "a" * 32)


@pytest.mark.parametrize("w", ["zz" * 32, "", "abc"])
def test_words_that_are_not_hex_decode_to_null(spark, w):
    assert decode(spark, w, hexabi.sql_int128_low_word("data")) is None


def test_text_is_trimmed_as_javascript_does(spark):
    rows = [(1, json.dumps({"name": " \u3000\t", "title": "\ufeff Tee\n"})), (2, "{bad"), (3, json.dumps({"agent_name": "a b "}))]
    df = parsed(spark.createDataFrame(rows, "k int, body string"))
    got = {r["k"]: r["n"] for r in df.select("k", F.expr(variant.sql_first_string("v", ["name", "agent_name", "title"])).alias("n")).collect()}
    assert got == {1: "Tee", 2: None, 3: "a b"}
