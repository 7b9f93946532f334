"""Deterministic hashing: uniform draws for splits, folds and sampling; id masking.

The uniform ``u(key) = int(first 8 hex digits of md5(salt || key)) / 2^32`` and
the 60-bit integer of the first 15 digits, from which rows are drawn, depend
only on the key, never on partitioning or task order, so a split or a draw is
identical after a retry, a repartition or on a different cluster, and it can be recomputed by any SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)


def _key(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hash_bits(key: str | Column, salt: str) -> Column:
    """First 60 bits of ``md5(salt || key)`` as a non-negative bigint."""
    return _digits(key, salt, 15)


def _digits(key: str | Column, salt: str, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), _key(key))), 1, n), 16, 10).cast("bigint")


def unit_hash(key: str | Column, salt: str) -> Column:
    """Uniform value in ``[0, 1)`` derived from the key."""
    return _digits(key, salt, 8) / F.lit(TWO_32)


def mask_id(key: str | Column, salt: str = "mask:") -> Column:
    """Mask an id before publishing; the same salt keeps tables joinable."""
    return F.md5(F.concat(F.lit(salt), _key(key)))


# DuckDB spellings of the same functions, used by the oracle SQL.
def sql_hash_bits(expr: str, salt: str, digits: int = 15) -> str:
    return f"(('0x' || substr(md5('{salt}' || cast({expr} as varchar)), 1, {digits}))::bigint)"


def sql_unit_hash(expr: str, salt: str) -> str:
    return f"({sql_hash_bits(expr, salt, 8)} / 4294967296.0)"
