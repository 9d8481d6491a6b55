"""Token-URI handling (F14, F15): gateway rewrite and inline data: URIs.

Both are pure Column expressions. Percent bodies are decoded like
``decodeURIComponent`` ('+' stays '+', malformed escapes fail); base64 bodies
like Node's lenient decoder (URL-safe alphabet, missing padding, whitespace
and junk skipped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import gateway_url


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def resolve_uri(uri) -> Column:
    """ipfs://X -> https://ipfs.io/ipfs/X, other URIs unchanged."""
    return gateway_url(uri)


def is_data_uri(uri) -> Column:
    return _c(uri).startswith("data:")


def data_uri_text(uri) -> Column:
    """data: URI -> decoded text, NULL for other URIs and on any failure.

    Header = text between 'data:' and the first comma; ';base64' at its end
    selects base64, else percent-decoding. An empty body is a failure."""
    u = _c(uri)
    comma = F.instr(u, ",")
    header = u.substr(F.lit(6), F.greatest(comma - 6, F.lit(0)))
    body = F.substr(u, comma + 1)
    b64 = F.regexp_replace(F.translate(body, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    # Node drops a dangling single character of a 4-char group; padding is optional.
    b64 = F.substr(b64, F.lit(1), F.length(b64) - F.when(F.length(b64) % 4 == 1, 1).otherwise(0))
    b64 = F.rpad(b64, (F.ceil(F.length(b64) / 4) * 4).cast("int"), "=")
    from_b64 = F.make_valid_utf8(F.try_to_binary(b64, F.lit("base64")).cast("string"))
    # decodeURIComponent keeps '+'; try_url_decode would map it to a space.
    pct = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    # Escapes that are not UTF-8 decode to U+FFFD where decodeURIComponent throws:
    # count the replacement characters that the body spells itself, plain or escaped.
    spelled = F.regexp_count(body, F.lit("\ufffd|%[eE][fF]%[bB][fF]%[bB][dD]"))
    pct_ok = F.when(pct.isNotNull() & (F.regexp_count(pct, F.lit("\ufffd")) == spelled), pct)
    text = F.when(header.endswith(";base64"), from_b64).otherwise(pct_ok)
    return F.when(is_data_uri(u) & (comma > 0) & (F.length(body) > 0), text)
