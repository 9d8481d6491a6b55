"""JSON metadata on VARIANT.

The payment-support check walks a document to a fixed depth. Spark has no
recursive expressions, so ``sql_detect_x402`` unrolls the walk when the plan is
built: one ``exists`` over the children of each level, nested
``X402_MAX_DEPTH + 1`` deep. It is a plain per-row expression (no explode, no
shuffle), so it scales with the number of documents like any projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import X402_BOOLEAN_KEYS, X402_MAX_DEPTH, X402_PRESENCE_KEYS

_NUMERIC_SCHEMA = "^(DECIMAL|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT)"
# Characters JavaScript's String.prototype.trim removes (fixed values).
_JS_SPACE = ("\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
             "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_json_or_null(text) -> Column:
    """F16: text -> VARIANT, NULL when the text is not JSON."""
    return F.try_parse_json(_c(text))


def as_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>")


def as_array(v: Column) -> Column:
    return v.try_cast("array<variant>")


# ---------------------------------------------------------------------------
# SQL text: one JVM round trip for the whole detector. Arguments are column
# names or SQL expressions.
# ---------------------------------------------------------------------------
_BOOL_SQL = ", ".join(f"'{k}'" for k in X402_BOOLEAN_KEYS)
_PRESENCE_SQL = ", ".join(f"'{k}'" for k in X402_PRESENCE_KEYS)


def _sql_truthy_flag(v: str) -> str:
    return (f"(to_json({v}) IN ('true', '\"true\"') OR (schema_of_variant({v}) RLIKE '{_NUMERIC_SCHEMA}' "
            f"AND try_variant_get({v}, '$', 'double') = 1.0))")


def _sql_present(v: str) -> str:
    return f"(NOT is_variant_null({v}) AND NOT to_json({v}) IN ('\"\"', '[]'))"


def _sql_children(obj: str, arr: str, d: int) -> str:
    return (f"coalesce(transform(map_entries({obj}), e{d} -> named_struct('k', lower(e{d}.key), 'v', e{d}.value)), "
            f"transform({arr}, x{d} -> named_struct('k', CAST(NULL AS STRING), 'v', x{d})))")


def _sql_scalar_hit(v: str) -> str:
    return f"coalesce(contains(lower(try_variant_get({v}, '$', 'string')), 'x402'), false)"


def _sql_level(v: str, obj: str, arr: str, d: int) -> str:
    c = f"c{d}"
    if d + 1 > X402_MAX_DEPTH:
        deeper = "false"
    else:
        cv = f"{c}.v"
        deeper = _sql_level(cv, f"try_cast({cv} AS MAP<STRING, VARIANT>)", f"try_cast({cv} AS ARRAY<VARIANT>)", d + 1)
    body = (f"CASE WHEN {c}.k IN ({_BOOL_SQL}) THEN {_sql_truthy_flag(c + '.v')} "
            f"WHEN {c}.k IN ({_PRESENCE_SQL}) THEN {_sql_present(c + '.v')} "
            f"ELSE {deeper} END")
    return f"coalesce(exists({_sql_children(obj, arr, d)}, {c} -> {body}), {_sql_scalar_hit(v)})"


def sql_is_truthy_root(v: str, obj: str, arr: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN false "
            f"WHEN {obj} IS NOT NULL OR {arr} IS NOT NULL THEN true "
            f"ELSE NOT to_json({v}) IN ('false', '\"\"') AND NOT (schema_of_variant({v}) RLIKE '{_NUMERIC_SCHEMA}' "
            f"AND try_variant_get({v}, '$', 'double') = 0.0) END")


def sql_detect_x402(v: str, obj: str, arr: str) -> str:
    """F17 as SQL text over a parsed root ``v`` and its map / array views."""
    return f"CASE WHEN {sql_is_truthy_root(v, obj, arr)} THEN {_sql_level(v, obj, arr, 0)} ELSE false END"


def _sql_escape(text: str) -> str:
    """A Spark SQL string literal body (backslash escapes are decoded)."""
    return "".join(c if c.isalnum() or c in "-_.[] $" else f"\\u{ord(c):04x}" for c in text)


def sql_first_string(v: str, keys: list[str]) -> str:
    """F18 as SQL text: first candidate key holding a non-blank string, trimmed."""
    spaces = _sql_escape(_JS_SPACE)
    picks = []
    for k in keys:
        x = f"try_variant_get({v}, '$.{k}', 'variant')"
        s = (f"CASE WHEN schema_of_variant({x}) = 'STRING' "
             f"THEN trim(BOTH '{spaces}' FROM try_variant_get({x}, '$', 'string')) END")
        picks.append(f"nullif({s}, '')")
    return f"coalesce({', '.join(picks)})"
