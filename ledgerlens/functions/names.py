"""Name-record helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ADDRESS_PATTERN, ATTESTATION_PREFIX, IDENTITY_REGISTRY


def attestation_key(agent_id: Column, registry: str = IDENTITY_REGISTRY) -> Column:
    """``agent-registration[<interop registry>][<agentId>]``."""
    interop = ATTESTATION_PREFIX + registry[2:].lower()
    return F.concat(F.lit(f"agent-registration[{interop}]["), agent_id.cast("string"), F.lit("]"))


def classify_identifier(q: Column) -> Column:
    """B16: 'address' | 'name' | 'invalid' for a trimmed lookup input."""
    t = F.trim(q)
    return (F.when(t.isNull() | (t == ""), F.lit("invalid"))
            .when(t.rlike(ADDRESS_PATTERN), F.lit("address"))
            .when(F.instr(t, ".") > 0, F.lit("name"))
            .otherwise(F.lit("invalid")))
