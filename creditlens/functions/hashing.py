"""Reproducible pseudo-random numbers from row ids.

The numbers depend on the id and seed only, so they stay the same when the data is partitioned anew
or a task is run again. The arithmetic is plain BIGINT and never overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mersenne prime 2^31 - 1 and two multipliers of classic congruential generators.
MODULUS = 2147483647
FIRST_FACTOR = 48271
SECOND_FACTOR = 40692


def row_hash(row_id: Column, seed: int = 0) -> Column:
    """Whole number in [0, 2^31 - 1) by two congruential steps with a squaring in between."""
    m = F.lit(MODULUS).cast("long")
    h = F.pmod(row_id.cast("long"), m)
    h = (h * F.lit(FIRST_FACTOR).cast("long") + F.lit(seed % MODULUS).cast("long")) % m
    return (h * h + h * F.lit(SECOND_FACTOR).cast("long") + F.lit(seed % MODULUS).cast("long")) % m


def unit_hash(row_id: Column, seed: int = 0) -> Column:
    """Number in [0, 1)."""
    return row_hash(row_id, seed) / F.lit(float(MODULUS))
