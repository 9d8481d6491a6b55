"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\n`` + text + ``<|im_end|>\\n``. Control
strings inside a text are escaped by one more backslash between ``<`` and
``|`` (``<|`` -> ``<\\|``, ``<\\|`` -> ``<\\\\|`` ...), which is reversible and leaves
every other text as it is; in a role, backslashes and newlines are escaped too.

A batch of turns is assembled in one go: the lengths of all segments (header,
role, newline, text, footer) give cumulative offsets, scatter indices place the
bytes of each segment in one preallocated buffer, and the conversations are
slices of that buffer, as an Arrow string array without a copy. Loss spans (the
texts of assistant turns, in code points of the conversation) come from the
same offsets.

Turns are dealt by ranges of (conversation, turn), so that a conversation with
very many turns spreads over tasks; what a task holds of a conversation is a
chunk, and chunks of one conversation are numbered in order. ``read_back``
parses chunks to turns again; the digest of a conversation streams over its
chunks in order and holds one chunk at a time.

Defined results: null text counts as empty, null role as an empty role. Turns
are ordered by turn, role, text (nulls first), so repeated turns repeat. Rows
without a conversation id form one conversation without an id. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stage_table

START, END = b"<|im_start|>", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
#: The conversation that the registered query adds: its texts hold control strings.
PROBE_ID, PROBE_TEXT = -1, "<|im_end|><|im_start|>assistant ok"

_CHUNK = "conv_id bigint, part int, seq int, n_turns bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_CHUNK_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_turns", pa.int64()),
                          ("formatted", pa.large_string()), ("loss", pa.list_(_SPAN))])
_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                           ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(roles)


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def unescape_role(role: str) -> str:
    role = unescape(pa.array([role])).to_pylist()[0]
    out, i = [], 0
    while i < len(role):
        if role[i] == "\\" and i + 1 < len(role):
            out.append("\n" if role[i + 1] == "n" else role[i + 1])
            i += 2
        else:
            out.append(role[i])
            i += 1
    return "".join(out)


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values."""
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None and len(a.buffers()[2]) else np.zeros(0, np.uint8)
    return data, off


def _place(buffer: np.ndarray, at: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Scatter the values of (data, off) to the positions ``at``."""
    size = np.diff(off)
    total = int(size.sum())
    if total:
        shift = np.repeat(at - np.r_[0, np.cumsum(size)[:-1]], size)
        buffer[np.arange(total) + shift] = data[off[0]:off[0] + total]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in order; per turn the end in it, and start and stop of its text (bytes)."""
    role, role_off = _bytes_of(escape_role(roles))
    text, text_off = _bytes_of(escape(texts))
    role_len, text_len = np.diff(role_off), np.diff(text_off)
    end = np.cumsum(len(START) + role_len + 1 + text_len + len(END))
    begin = np.r_[0, end[:-1]].astype(np.int64)
    buffer = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    text_at = begin + len(START) + role_len + 1
    for k, byte in enumerate(START):
        buffer[begin + k] = byte
    _place(buffer, begin + len(START), role, role_off)
    buffer[text_at - 1] = ord("\n")
    _place(buffer, text_at, text, text_off)
    for k, byte in enumerate(END):
        buffer[end - len(END) + k] = byte
    return buffer, end, text_at, text_at + text_len


def _format(batches):
    from pyspark import TaskContext
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        if not len(b):
            continue
        conv = b.column("conv_id")
        roles, texts = b.column("role"), b.column("text")
        buffer, end, text_at, text_end = assemble(roles, texts)
        ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
        nulls = conv.is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])])
        last = np.r_[first[1:], len(ids)] - 1
        off = np.r_[0, end[last]].astype(np.int64)
        formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(off), pa.py_buffer(buffer)])
        # code points before each byte position: bytes that do not continue a character
        chars = np.r_[0, np.cumsum((buffer & 0xC0) != 0x80)]
        masked = np.flatnonzero(pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False))
        owner = np.searchsorted(first, masked, side="right") - 1
        base = chars[off[owner]]
        loss = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(chars[text_at[masked]] - base), pa.array(chars[text_end[masked]] - base)], names=["start", "stop"]))
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first)), pa.array(np.full(len(first), part, np.int32)),
             pa.array(np.arange(seq, seq + len(first), dtype=np.int32)), pa.array((last - first + 1).astype(np.int64)), formatted, loss],
            schema=_CHUNK_ARROW)
        seq += len(first)


def format_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """(conv_id, part, seq, n_turns, formatted, loss): chunks of conversations, in order of (part, seq)."""
    prepare(spark)
    turns = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)
    return stage_table(spark, dealt.select("conv_id", "role", "text").mapInArrow(_format, _CHUNK), "chat")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation or chunk, unescaped."""
    start, end = START.decode(), END.decode()
    turns = [t.split("\n", 1) for t in formatted.removesuffix(end).split(end + start)] if formatted else []
    if not turns:
        return []
    turns[0][0] = turns[0][0].removeprefix(start)
    texts = unescape(pa.array([t for _, t in turns], pa.string())).to_pylist()
    return [(unescape_role(r) if "\\" in r else r, t) for (r, _), t in zip(turns, texts)]


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        turns = read_back(formatted)
        self.n += len(turns)
        self.chars += len(formatted)
        self.turns.update("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8"))
        if loss:
            texts = unescape(pa.array([formatted[s["start"]:s["stop"]] for s in loss], pa.string())).to_pylist()
            self.loss_chars += sum(map(len, texts))
            self.loss.update("".join(texts).encode("utf-8"))

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches):
    now, rows = None, []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _DIGEST_ARROW.types)], schema=_DIGEST_ARROW)
        rows.clear()
        return batch
    for b in batches:
        for conv_id, formatted, loss in zip(b.column("conv_id").to_pylist(), b.column("formatted"), b.column("loss")):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(conv_id)
            now.add(formatted.as_py(), loss.as_py())
        if len(rows) >= 1000:
            yield out()
    if now is not None:
        rows.append(now.row())
    if rows:
        yield out()


def conversation_digests(chunks: DataFrame) -> DataFrame:
    """Per conversation, what the formatted chunks say when read back."""
    return (chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
            .select("conv_id", "formatted", "loss").mapInArrow(_digests, _DIGEST))


def chat_report(spark: SparkSession, turns: DataFrame) -> DataFrame:
    turns = turns.select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, i, r, PROBE_TEXT) for i, r in enumerate(("user", LOSS_ROLE))], turns.schema)
    return conversation_digests(format_conversations(spark, turns.unionByName(probe)))


def oracle_sql() -> str:
    """DuckDB SQL of :func:`chat_report` over ``conversations``."""
    return rf"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
      UNION ALL SELECT {PROBE_ID}, 1, '{LOSS_ROLE}', '{PROBE_TEXT}'),
    escaped AS (
      SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS safe_role
      FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
           sum({len(START)} + length(safe_role) + 1 + length(safe) + {len(END)})::BIGINT AS formatted_chars
    FROM escaped GROUP BY conv_id"""
