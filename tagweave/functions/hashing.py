"""Repeatable integer hash that DuckDB can state too (Spark's xxhash64 has no
DuckDB twin).  Multiplicative mix modulo 2^32:

    h(key) = (key * 2654435761 + seed) mod 2^32

The product is split as 2654435761 = 40503 * 2^16 + 31153 so every partial
product fits a signed long (safe under ANSI overflow checks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIX_MULTIPLIER = 2654435761
MIX_HI, MIX_LO = 40503, 31153          # MIX_MULTIPLIER = MIX_HI * 2^16 + MIX_LO
MIX_MODULUS = 4294967296


def mix_hash(key: Column, seed: int) -> Column:
    """(key * 2654435761 + seed) mod 2^32, non-negative, as long."""
    k = F.pmod(key.cast("long"), F.lit(MIX_MODULUS))
    hi = F.pmod(k * F.lit(MIX_HI), F.lit(65536)) * F.lit(65536)
    return F.pmod(hi + k * F.lit(MIX_LO) + F.lit(int(seed)), F.lit(MIX_MODULUS))


def mix_hash_sql(key_sql: str, seed: int) -> str:
    """The same hash as a DuckDB expression (for oracles)."""
    return (f"(((((({key_sql})::BIGINT % {MIX_MODULUS}) + {MIX_MODULUS}) % {MIX_MODULUS})"
            f"::HUGEINT * {MIX_MULTIPLIER} + {int(seed)}) % {MIX_MODULUS})::BIGINT")
