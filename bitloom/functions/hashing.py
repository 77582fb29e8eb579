"""Counter-based pseudo-random numbers as column expressions.

The same ``(seed, i, j)`` gives the same number on any partitioning and on any SQL engine with
64-bit integers; inputs must be non-negative and below 10^12.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def _long(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def streamed(seed, stream) -> Column:
    """A seed of its own for every (seed, stream): streams are below 128, so no two pairs share one."""
    return (_long(seed) % MODULUS) * 128 + _long(stream)


def portable_hash(seed, i, j=0) -> Column:
    """Integer in ``[0, 2147483647)``."""
    seed, i, j = _long(seed), _long(i), _long(j)
    z = (seed * 1000003 + i * 48271 + j * 69621 + 12345) % MODULUS
    z = (z * z + z * 16807 + 11) % MODULUS
    z = (z * z + z * 48271 + i + 7) % MODULUS
    return (z * 69621 + j + 3) % MODULUS


def uniform(seed, i, j=0) -> Column:
    """Double in ``[0, 1)``."""
    return portable_hash(seed, i, j).cast("double") / float(MODULUS)


def uniform_integer(seed, i, j, low, high) -> Column:
    """Integer in ``[low, high]``, both ends included."""
    low, high = _long(low), _long(high)
    return low + portable_hash(seed, i, j) % (high - low + 1)


def standard_normal(seed, i, j=0) -> Column:
    """Box-Muller draw from two uniforms of one counter."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(seed, i, j)))
    return radius * F.cos(2.0 * 3.141592653589793 * uniform(_long(seed) + 1, i, j))
