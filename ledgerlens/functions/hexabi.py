"""ABI / hex decoding and encoding as Spark Column expressions.

Log fields are hex strings: ``topics`` hold 0x + 64 hex digits each, ``data``
holds 0x + n words of 64 hex digits. All decoders are null-safe and never raise
under ANSI mode: every ``conv`` is guarded so its input cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64  # hex digits per 32-byte word
_HEX_RE = "^[0-9a-fA-F]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_body(h) -> Column:
    """Everything after the first two characters (the ``0x``)."""
    return F.substr(_c(h), F.lit(3))


def hex_digits_to_long(digits) -> Column:
    """Unsigned hex digits (no prefix) -> BIGINT; NULL on junk or > int64.

    Everything before the last 16 digits must be zeros (a plain string
    compare, no trimming); ``conv`` then sees at most 16 digits, so it cannot
    overflow. All-zero input decodes to 0."""
    d = _c(digits)
    head = F.length(d) - 16
    zeros_head = (F.length(d) <= 16) | (F.substr(d, F.lit(1), head) == F.repeat(F.lit("0"), head))
    return F.when(d.rlike(_HEX_RE) & zeros_head, F.conv(F.right(d, F.lit(16)), 16, 10).try_cast("bigint"))


def hex_to_long(h) -> Column:
    """``0x``-prefixed hex word -> BIGINT (NULL on overflow or garbage)."""
    return hex_digits_to_long(hex_body(h))


def topic_to_address(t) -> Column:
    """indexed address topic -> ``0x`` + last 20 bytes."""
    return F.concat(F.lit("0x"), F.substr(_c(t), F.lit(27)))


# ---------------------------------------------------------------------------
# Encoders (used to lay test tables out as raw logs)
# ---------------------------------------------------------------------------

def uint_word(n) -> Column:
    """Non-negative integer -> 64 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(_c(n).cast("bigint"))), WORD, "0")


def int_word(n) -> Column:
    """Signed 64-bit integer -> 256-bit two's complement word (sign-extended)."""
    n = _c(n).cast("bigint")
    h = F.lower(F.hex(n))
    return F.when(n < 0, F.lpad(h, WORD, "f")).otherwise(F.lpad(h, WORD, "0"))


def address_word(addr) -> Column:
    """``0x`` + 40 hex address -> 64-digit topic word (left zero padded)."""
    return F.lpad(F.lower(hex_body(addr)), WORD, "0")


def hex_topic(word: Column) -> Column:
    return F.concat(F.lit("0x"), word)


def abi_string_tail(s) -> Column:
    """Length word + UTF-8 bytes right-padded to whole words."""
    s = _c(s)
    nbytes = F.octet_length(s)
    padded = F.ceil(nbytes / F.lit(32)).cast("int") * F.lit(WORD)
    return F.concat(uint_word(nbytes), F.rpad(F.lower(F.hex(F.encode(s, "UTF-8"))), padded, F.lit("0")))


def abi_string_data(s) -> Column:
    """``data`` holding a single dynamic string: offset 0x20, length, bytes."""
    return F.concat(F.lit("0x"), uint_word(F.lit(32)), abi_string_tail(s))


# ---------------------------------------------------------------------------
# The log decoders as SQL text, for ``selectExpr``: a whole projection is one
# round trip to the JVM instead of one per expression node. Arguments are SQL
# expressions (usually column names).
# ---------------------------------------------------------------------------

def sql_hex_digits_to_long(d: str) -> str:
    """SQL form of ``hex_digits_to_long`` (``d`` should be a column name)."""
    return (f"CASE WHEN {d} RLIKE '^[0-9a-fA-F]+$' AND (length({d}) <= 16 OR "
            f"substr({d}, 1, length({d}) - 16) = repeat('0', length({d}) - 16)) "
            f"THEN try_cast(conv(right({d}, 16), 16, 10) AS BIGINT) END")


def sql_hex_body(h: str) -> str:
    return f"substr({h}, 3)"


def sql_data_word(data: str, i: int) -> str:
    return f"substring({data}, {3 + WORD * i}, {WORD})"


def sql_topic_to_address(t: str) -> str:
    return f"concat('0x', substr({t}, 27))"


def sql_abi_string(data: str, length: str, head_words: int = 1) -> str:
    """F3 given the decoded length expression ``length``."""
    start = WORD // 2 * head_words + WORD // 2 + 1
    bounded = f"CASE WHEN ({length}) IS NOT NULL THEN CAST(least({length}, CAST(length({data}) AS BIGINT)) AS INT) END"
    return f"make_valid_utf8(CAST(substr(unhex(substr({data}, 3)), {start}, {bounded}) AS STRING))"


def sql_int128_low_word(word: str) -> str:
    """F4 on a 64-digit word held in column ``word``."""
    low = f"substring({word}, 33, 32)"
    hi_hex = f"lower(substring({word}, 33, 16))"
    lo = f"CAST(conv(substring({word}, 49, 16), 16, 10) AS DECIMAL(20,0))"
    hi0 = f"CAST(conv(substring({word}, 33, 16), 16, 10) AS DECIMAL(20,0))"
    two64 = "CAST(18446744073709551616 AS DECIMAL(20,0))"
    two63 = "CAST(9223372036854775808 AS DECIMAL(20,0))"
    signed_hi = f"(CASE WHEN {hi0} >= {two63} THEN {hi0} - {two64} ELSE {hi0} END)"
    value = (f"CASE WHEN {hi_hex} = '0000000000000000' THEN CAST({lo} AS DOUBLE) "
             f"WHEN {hi_hex} = 'ffffffffffffffff' THEN CAST({lo} - {two64} AS DOUBLE) "
             f"ELSE CAST({signed_hi} AS DOUBLE) * CAST(18446744073709551616 AS DOUBLE) + CAST({lo} AS DOUBLE) END")
    return f"CASE WHEN {low} RLIKE '^[0-9a-fA-F]{{32}}$' THEN {value} END"


# ---------------------------------------------------------------------------
# Dynamic tails by their offset words
# ---------------------------------------------------------------------------

def sql_tail_offset(data: str, word: str, head_words: int) -> str:
    """The byte offset in ``word`` (a column of 64 digits) where a tail can begin: whole words behind the
    head, with room for a length word; NULL otherwise."""
    offset = sql_hex_digits_to_long(word)
    room = f"CAST(length({data}) DIV 2 - 33 AS BIGINT)"
    return f"CASE WHEN ({offset}) BETWEEN {32 * head_words} AND {room} AND ({offset}) % 32 = 0 THEN {offset} END"


def sql_tail_length_word(data: str, offset: str) -> str:
    return f"substring({data}, CAST(3 + 2 * {offset} AS INT), {WORD})"


def sql_tail_end(data: str, offset: str, word: str) -> str:
    """The byte behind a tail whose length word is ``word``, padded to whole words; NULL where the data ends before."""
    length = sql_hex_digits_to_long(word)
    # Compared with what is left behind the offset, so that a huge length cannot overflow.
    left = f"CAST(length({data}) DIV 2 - 33 AS BIGINT) - {offset}"
    return f"CASE WHEN ({length}) BETWEEN 0 AND {left} THEN {offset} + 32 + 32 * CAST((({length}) + 31) DIV 32 AS BIGINT) END"


def sql_tail_text(data: str, offset: str, word: str) -> str:
    length = sql_hex_digits_to_long(word)
    return f"make_valid_utf8(CAST(unhex(substring({data}, CAST(3 + 2 * ({offset} + 32) AS INT), CAST(2 * ({length}) AS INT))) AS STRING))"
