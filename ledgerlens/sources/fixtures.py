"""Lay the driver's test tables out as the engine's inputs.

The mapping is fixed (FIXTURES.md section 2) so an independent SQL oracle can
compute every answer straight from the driver tables:

* ``customer``  -> Registered (+ Transfer mint) logs: agent = c_custkey,
  owner = 0x + 40-hex(c_nationkey + 1), URI '' for odd keys, an ipfs:// URI
  when c_custkey % 10 = 4, else https://example.org/agent/<key>.json,
  registered_at = 2023-11-01 + c_custkey hours.
* ``pages``     -> URIUpdated logs: agent = page_id % 100, URI = url ('' when
  page_id % 10 = 0), at 2023-12-01 + page_id minutes.
* ``events``    -> NewFeedback logs: agent = user_id, client = 0x + sha1(event_type),
  index = event_id, value = round(value * 100) with 2 decimals, at ts.
  Optional: negative values for 'error' events; FeedbackRevoked for event_id % 50 = 0.
* ``documents`` + ``labels`` -> metadata documents (uri -> JSON body) with
  payment keys placed by a rule on doc_id; ``pages`` -> non-JSON bodies.
* ``conversations`` -> data: URIs (base64 for even conv_id, percent-encoded for odd).
* ``nation`` / ``supplier`` / ``customer`` -> names and text records.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IDENTITY_REGISTRY, REPUTATION_REGISTRY, TOPIC
from ..functions.hexabi import (
    abi_string_data,
    abi_string_tail,
    address_word,
    hex_topic,
    int_word,
    uint_word,
)
from ..functions.names import attestation_key
from .logs import BRONZE_COLUMNS

# Fixed values of the mapping (oracles restate them in SQL).
REG_EPOCH = 1698796800      # 2023-11-01 00:00:00 UTC
URI_EPOCH = 1701388800      # 2023-12-01 00:00:00 UTC
AGENT_URI_PREFIX = "https://example.org/agent/"
IPFS_URI_PREFIX = "ipfs://bafyagent"
ZERO_ADDRESS = "0x" + "0" * 40


_TABLES: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread by a hash of its leading key: the files are single
    row groups, which Spark cannot split, and the mapping's per-row encoding is
    heavy. Handles are reused per session so the footer and file listing are
    read once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    handles = _TABLES.setdefault(spark, {})
    df = handles.get(path)
    if df is None:
        df = spark.read.parquet(path)
        df = handles[path] = df.repartition(spark.sparkContext.defaultParallelism, df.columns[0])
    return df


def hex_address(n: Column) -> Column:
    """Integer -> 0x + 40 lowercase hex digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n.cast("bigint"))), 40, "0"))


def owner_address(nationkey: Column) -> Column:
    return hex_address(nationkey + F.lit(1))


def supplier_address(suppkey: Column) -> Column:
    return hex_address(suppkey + F.lit(1000))


def client_address(event_type: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha1(event_type))


def tx_hash(tag: str, key: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit(tag + ":"), key.cast("string")), 256))


def agent_uri(custkey: Column) -> Column:
    return (F.when(custkey % 2 == 1, F.lit(""))
            .when(custkey % 10 == 4, F.concat(F.lit(IPFS_URI_PREFIX), custkey.cast("string"), F.lit(".json")))
            .otherwise(F.concat(F.lit(AGENT_URI_PREFIX), custkey.cast("string"), F.lit(".json"))))


def _log(address: str, topics: list[Column], data: Column, ts: Column, tx: Column, log_index: int) -> list[Column]:
    """Bronze-layout columns. Every encoder emits lowercase hex, and topic0 is
    the event's literal signature, so no lowering pass is needed and the
    event filter of a decoder folds to true/false per union branch."""
    return [
        F.lit(address).alias("address"),
        F.array(*topics).alias("topics"),
        data.alias("data"),
        ts.cast("timestamp").alias("block_timestamp"),
        tx.alias("transaction_hash"),
        F.lit(log_index).cast("bigint").alias("log_index"),
        topics[0].alias("topic0"),
        F.lit(len(topics)).alias("topic_count"),
        F.to_date(ts.cast("timestamp")).alias("block_date"),
    ]


def registered_logs(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(*_log(
        IDENTITY_REGISTRY,
        [F.lit(TOPIC["Registered"]), hex_topic(uint_word(k)), hex_topic(address_word(owner_address(F.col("c_nationkey"))))],
        abi_string_data(agent_uri(k)),
        F.timestamp_seconds(F.lit(REG_EPOCH) + k * 3600),
        tx_hash("reg", k),
        0,
    ))


def mint_logs(customer: DataFrame) -> DataFrame:
    """ERC-721 mints (from = 0x0); customers with c_custkey % 41 = 7 have none."""
    k = F.col("c_custkey")
    return customer.where(k % 41 != 7).select(*_log(
        IDENTITY_REGISTRY,
        [F.lit(TOPIC["Transfer"]), hex_topic(address_word(F.lit(ZERO_ADDRESS))),
         hex_topic(address_word(owner_address(F.col("c_nationkey")))), hex_topic(uint_word(k))],
        F.lit("0x"),
        F.timestamp_seconds(F.lit(REG_EPOCH) + k * 3600),
        tx_hash("reg", k),
        1,
    ))


def uri_update_logs(pages: DataFrame) -> DataFrame:
    p = F.col("page_id")
    uri = F.when(p % 10 == 0, F.lit("")).otherwise(F.col("url"))
    return pages.select(*_log(
        IDENTITY_REGISTRY,
        [F.lit(TOPIC["URIUpdated"]), hex_topic(uint_word(p % 100)), hex_topic(address_word(hex_address(p)))],
        abi_string_data(uri),
        F.timestamp_seconds(F.lit(URI_EPOCH) + p * 60),
        tx_hash("uri", p),
        0,
    ))


def feedback_value(signed: bool) -> Column:
    v = F.round(F.col("value") * 100).cast("bigint")
    return F.when(F.col("event_type") == "error", -v).otherwise(v) if signed else v


def feedback_logs(events: DataFrame, signed: bool = False) -> DataFrame:
    """NewFeedback: [sig, agentId, client, tagHash] + 8 head words + 4 string tails."""
    e = F.col("event_id")
    tag = F.col("event_type")
    tag_words = F.ceil(F.octet_length(tag) / F.lit(32)).cast("bigint")
    o1 = F.lit(256).cast("bigint")
    o2 = o1 + 32 + 32 * tag_words
    o3 = o2 + 32
    o4 = o3 + 32
    empty = abi_string_tail(F.lit(""))
    data = F.concat(
        F.lit("0x"), uint_word(e), int_word(feedback_value(signed)), uint_word(F.lit(2)),
        uint_word(o1), uint_word(o2), uint_word(o3), uint_word(o4),
        F.sha2(F.concat(F.lit("fbhash:"), e.cast("string")), 256),
        abi_string_tail(tag), empty, empty, empty,
    )
    return events.select(*_log(
        REPUTATION_REGISTRY,
        [F.lit(TOPIC["NewFeedback"]), hex_topic(uint_word(F.col("user_id"))),
         hex_topic(address_word(client_address(tag))), F.concat(F.lit("0x"), F.sha2(tag, 256))],
        data,
        F.col("ts"),
        tx_hash("fb", e),
        0,
    ))


def feedback_text_logs(events: DataFrame) -> DataFrame:
    """NewFeedback logs with four strings: event type, t<event_id>, an endpoint of several words, an ipfs:// URI.

    event_id % 10 tells what is odd: 1 tails in reverse order, 2 offset of tag2 2^255, 3 offset of the endpoint
    behind the data, 4 endpoint at the offset of tag1, 5 length of the URI 2^31, 6 offset of tag1 inside the head,
    7 length of tag2 beyond 64 bits, 8 offset of the URI not a whole word."""
    e = F.col("event_id")
    s = e.cast("string")
    r = e % 10
    texts = [F.col("event_type"), F.concat(F.lit("t"), s), F.concat(F.lit("https://agents.example.org/feedback/endpoint/"), s),
             F.concat(F.lit("ipfs://"), F.sha2(s, 256))]
    sizes = [32 + 32 * F.ceil(F.octet_length(t) / F.lit(32)).cast("bigint") for t in texts]
    tails = [abi_string_tail(t) for t in texts]
    forth, back, at = [], [None] * 4, F.lit(256).cast("bigint")
    for size in sizes:
        forth.append(at)
        at = at + size
    at = F.lit(256).cast("bigint")
    for i in (3, 2, 1, 0):
        back[i] = at
        at = at + sizes[i]
    o = [uint_word(F.when(r == 1, b).otherwise(f)) for f, b in zip(forth, back)]
    o[0] = F.when(r == 6, uint_word(F.lit(224))).otherwise(o[0])
    o[1] = F.when(r == 2, F.lit("8" + "0" * 63)).otherwise(o[1])
    o[2] = F.when(r == 3, uint_word(at)).when(r == 4, uint_word(F.lit(256))).otherwise(o[2])
    o[3] = F.when(r == 8, uint_word(forth[3] + 1)).otherwise(o[3])
    long_word = F.lit("0" * 40 + "f" * 24)
    tails[1] = F.when(r == 7, F.concat(long_word, F.substr(tails[1], F.lit(65)))).otherwise(tails[1])
    tails[3] = F.when(r == 5, F.concat(uint_word(F.lit(1 << 31)), F.substr(tails[3], F.lit(65)))).otherwise(tails[3])
    body = F.when(r == 1, F.concat(*reversed(tails))).otherwise(F.concat(*tails))
    data = F.concat(F.lit("0x"), uint_word(e), uint_word(F.lit(1)), uint_word(F.lit(0)), *o, F.sha2(F.concat(F.lit("fbhash:"), s), 256), body)
    return events.select(*_log(
        REPUTATION_REGISTRY,
        [F.lit(TOPIC["NewFeedback"]), hex_topic(uint_word(F.col("user_id"))),
         hex_topic(address_word(client_address(F.col("event_type")))), F.concat(F.lit("0x"), F.sha2(F.col("event_type"), 256))],
        data, F.col("ts"), tx_hash("ft", e), 0))


def revocation_logs(events: DataFrame) -> DataFrame:
    """FeedbackRevoked for every event_id % 50 = 0, one day after the feedback."""
    e = F.col("event_id")
    return events.where(e % 50 == 0).select(*_log(
        REPUTATION_REGISTRY,
        [F.lit(TOPIC["FeedbackRevoked"]), hex_topic(uint_word(F.col("user_id"))),
         hex_topic(address_word(client_address(F.col("event_type")))), hex_topic(uint_word(e))],
        F.lit("0x"),
        F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY"),
        tx_hash("rv", e),
        0,
    ))


def fixture_logs(spark: SparkSession, sf_dir: str, *, signed: bool = False,
                 revocations: bool = False, mints: bool = True) -> DataFrame:
    """All raw logs of the fixture in bronze layout."""
    parts = [
        registered_logs(table(spark, sf_dir, "customer")),
        uri_update_logs(table(spark, sf_dir, "pages")),
        feedback_logs(table(spark, sf_dir, "events"), signed=signed),
    ]
    if mints:
        parts.append(mint_logs(table(spark, sf_dir, "customer")))
    if revocations:
        parts.append(revocation_logs(table(spark, sf_dir, "events")))
    logs = parts[0]
    for p in parts[1:]:
        logs = logs.unionByName(p)
    return logs.select(*BRONZE_COLUMNS)


# ---------------------------------------------------------------------------
# Metadata documents (replace network fetches)
# ---------------------------------------------------------------------------

def kv(key: str, value: Column) -> Column:
    """One JSON member ``"key":value`` (NULL when value is NULL); values are
    serialised by ``to_json`` so strings are escaped correctly."""
    js = F.to_json(F.struct(value.alias(key)))
    return F.when(value.isNotNull(), F.substr(js, F.lit(2), F.length(js) - 2))


def json_object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def payment_members(r: Column, key: Column) -> list[Column]:
    """Payment keys by rule r = key % 12. Hits: r in {0,2,4,5,7,9,10,11}."""
    s = key.cast("string")
    return [
        F.when(r == 0, kv("x402support", F.lit(True))),
        F.when(r == 1, kv("x402support", F.lit(False))),
        F.when(r == 2, kv("payment", F.struct(F.lit("exact").alias("scheme"), F.lit("base").alias("network")))),
        F.when(r == 3, kv("accepts", F.array().cast("array<string>"))),
        F.when(r == 4, kv("services", F.array(F.struct(F.lit("api").alias("name"),
                                                      F.concat(F.lit("https://api.example.com/x402/"), s).alias("endpoint"))))),
        F.when(r == 5, kv("capabilities", F.struct(F.lit("true").alias("payable")))),
        F.when(r == 6, kv("capabilities", F.struct(F.lit("yes").alias("payable")))),
        F.when(r == 7, kv("paymentRequired", F.lit(1))),
        F.when(r == 8, kv("a", F.struct(F.struct(F.struct(F.struct(F.lit("x402").alias("e")).alias("d")).alias("c")).alias("b")))),
        F.when(r == 9, kv("a", F.struct(F.struct(F.struct(F.lit("x402 enabled").alias("d")).alias("c")).alias("b")))),
        F.when(r == 10, kv("monetization", F.lit(False))),
        F.when(r == 11, F.concat(kv("x402", F.lit(False)), F.lit(","), kv("x402", F.lit(True)))),
    ]


def name_members(key: Column) -> list[Column]:
    """Name candidates by rule key % 5 (first non-blank string wins)."""
    r = key % 5
    s = key.cast("string")
    return [
        F.when(r == 0, kv("name", F.concat(F.lit("Agent "), s))),
        F.when(r == 1, kv("name", F.lit("   "))),
        F.when(r == 1, kv("agentName", F.concat(F.lit("  agent-"), s, F.lit("  ")))),
        F.when(r == 2, kv("name", key)),
        F.when(r == 2, kv("title", F.concat(F.lit("Title "), s))),
        F.when(r == 3, kv("agent_name", F.concat(F.lit("agent_"), s))),
    ]


def document_uri(doc_id: Column) -> Column:
    """URI a document is served under (the resolved form for ipfs:// agents)."""
    return (F.when(doc_id % 10 == 4, F.concat(F.lit("https://ipfs.io/ipfs/bafyagent"), doc_id.cast("string"), F.lit(".json")))
            .otherwise(F.concat(F.lit(AGENT_URI_PREFIX), doc_id.cast("string"), F.lit(".json"))))


def metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uri -> body: JSON registration files from documents (+labels), raw html
    for page URLs. doc_id % 97 = 13 is truncated JSON; % 97 = 29 is ``false``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = F.col("doc_id")
    body = json_object(
        *name_members(d),
        F.when(d % 3 == 0, kv("about", F.col("text"))).otherwise(kv("description", F.col("text"))),
        kv("lang", F.col("lang")), kv("source", F.col("source")),
        kv("quality", F.col("quality")), kv("toxic", F.col("toxic")),
        *payment_members(d % 12, d),
    )
    body = (F.when(d % 97 == 13, F.concat(F.lit('{"name": "broken-'), d.cast("string")))
             .when(d % 97 == 29, F.lit("false"))
             .otherwise(body))
    json_docs = docs.join(labels, "doc_id", "left").select(document_uri(d).alias("uri"), body.alias("body"))
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("uri"), F.col("html").alias("body"))
    return json_docs.unionByName(pages)


def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One data: URI per conversation turn: base64 for even conv_id, percent
    form for odd. turn % 7 = 6 is broken (empty body / malformed escape)."""
    conv = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    body = json_object(
        kv("name", F.concat(F.col("role"), F.lit("-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))),
        kv("description", F.col("text")),
        *payment_members(key % 12, key),
    )
    b64 = F.concat(F.lit("data:application/json;base64,"),
                   F.when(F.col("turn") % 7 == 6, F.lit("")).otherwise(F.base64(F.encode(body, "UTF-8"))))
    pct = F.concat(F.lit("data:application/json,"),
                   F.when(F.col("turn") % 7 == 6, F.lit("%7B%22name%22%3A%E0%A4%A"))
                   .otherwise(F.replace(F.url_encode(body), F.lit("+"), F.lit("%20"))))
    return conv.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, b64).otherwise(pct).alias("uri"))


# ---------------------------------------------------------------------------
# Names and text records (replace chain RPC)
# ---------------------------------------------------------------------------

def nation_name(n_name: Column) -> Column:
    return F.concat(F.replace(F.lower(n_name), F.lit(" "), F.lit("-")), F.lit(".eth"))


def names_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address -> name-or-null (+ resolved flag): one row per nation owner
    (no name for n_nationkey % 3 = 2, lookup error for n_nationkey % 7 = 6)
    and per supplier (lookup error when s_suppkey % 10 = 9)."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    k = F.col("n_nationkey")
    n = nation.select(
        owner_address(k).alias("address"),
        F.when((k % 3 == 2) | (k % 7 == 6), F.lit(None).cast("string")).otherwise(nation_name(F.col("n_name"))).alias("name"),
        (k % 7 != 6).alias("resolved"),
    )
    s = supplier.select(
        supplier_address(F.col("s_suppkey")).alias("address"),
        F.when(F.col("s_suppkey") % 10 == 9, F.lit(None).cast("string"))
         .otherwise(F.concat(F.replace(F.lower(F.col("s_name")), F.lit("#"), F.lit("-")), F.lit(".eth"))).alias("name"),
        (F.col("s_suppkey") % 10 != 9).alias("resolved"),
    )
    return n.unionByName(s)


RECORD_KEYS = ["agent-context", "agent-endpoint[mcp]", "agent-endpoint[a2a]", "agent-endpoint[web]",
               "avatar", "url", "description", "com.twitter", "com.github", "email"]


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, key, value): for named nation n and key index i the record is
    absent when (n + i) % 4 = 0, blank when (n + i) % 4 = 1, else key:name.
    Plus one attestation record per agent with c_custkey % 5 = 0 whose
    owner's nation is named."""
    nation = table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 != 2)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("key")) for i, k in enumerate(RECORD_KEYS)])
    rec = (nation.select("n_nationkey", nation_name(F.col("n_name")).alias("name"), F.inline(keys))
           .where((F.col("n_nationkey") + F.col("i")) % 4 != 0)
           .select("name", "key",
                   F.when((F.col("n_nationkey") + F.col("i")) % 4 == 1, F.lit(""))
                    .otherwise(F.concat(F.col("key"), F.lit(":"), F.col("name"))).alias("value")))
    customer = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 5 == 0)
    att = (customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
           .select(nation_name(F.col("n_name")).alias("name"),
                   attestation_key(F.col("c_custkey")).alias("key"),
                   F.lit("1").alias("value")))
    return rec.unionByName(att)


def lookup_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs for the unified lookup, derived from nation and supplier:
    owner addresses (upper-case hex for even nations), nation names (padded
    with spaces for n % 4 = 0), upper-cased supplier names, raw supplier
    names (no dot: invalid) and one blank input."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    k = F.col("n_nationkey")
    addr = owner_address(k)
    a = nation.select(F.when(k % 2 == 0, F.concat(F.lit("0x"), F.upper(F.substr(addr, F.lit(3))))).otherwise(addr).alias("input"))
    nm = nation.select(F.when(k % 4 == 0, F.concat(F.lit("  "), nation_name(F.col("n_name")), F.lit(" ")))
                       .otherwise(nation_name(F.col("n_name"))).alias("input"))
    sn = supplier.select(F.upper(F.concat(F.replace(F.lower(F.col("s_name")), F.lit("#"), F.lit("-")), F.lit(".eth"))).alias("input"))
    raw = supplier.select(F.col("s_name").alias("input"))
    blank = nation.where(k == 0).select(F.lit("   ").alias("input"))
    return a.unionByName(nm).unionByName(sn).unionByName(raw).unionByName(blank)
