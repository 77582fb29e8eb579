"""Rank and unrank index pairs ``i < j`` in the row-major upper triangle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _row_start(row: Column, n: Column) -> Column:
    # integer division of an even product
    return F.floor(F.shiftright(row * (2 * n - row - 1), 1)).cast("bigint")


def pair_count(n: Column) -> Column:
    n = n.cast("bigint")
    return F.shiftright(n * (n - 1), 1)


def pair_rank(i: Column, j: Column, n: Column) -> Column:
    i, j, n = (c.cast("bigint") for c in (i, j, n))
    return _row_start(i, n) + j - i - 1


def pair_unrank(rank: Column, n: Column) -> Column:
    """Struct ``(i, j)``; the square root is corrected by one row either way."""
    rank, n = rank.cast("bigint"), n.cast("bigint")
    side = (2 * n - 1).cast("double")
    guess = F.floor((side - F.sqrt(side * side - 8.0 * rank.cast("double"))) / 2.0).cast("bigint")
    row = (
        F.when(_row_start(guess + 1, n) <= rank, guess + 1)
        .when(_row_start(guess, n) > rank, guess - 1)
        .otherwise(guess)
    )
    return F.struct(row.alias("i"), (row + 1 + rank - _row_start(row, n)).alias("j"))
