"""Pairs of rows that share a group, spread evenly even if one group is huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 2048


def pairs_within(df: DataFrame, group: list[str], order: str, cell: int = CELL) -> DataFrame:
    """All pairs ``a.order < b.order`` of one group, columns suffixed ``_a`` and ``_b``.

    The pairs *are* the result here (an expanded square has one coefficient per pair), so none is
    left out. Groups of up to ``cell`` rows meet in a plain self-join whose two sides share one
    shuffle. A larger group is cut into ``ceil(size / cell)`` blocks and joined on ``(group,
    block_a, block_b)``, so that no task holds more than about ``cell`` rows of a side.
    """
    payload = [c for c in df.columns if c not in group]
    # one filter for every use of the rows, so that a shuffle below them is shared
    for c in [*group, order]:
        df = df.where(F.col(c).isNotNull())
    large = df.groupBy(*group).agg(F.count("*").alias("_rows")).where(F.col("_rows") > cell).select(
        *group, F.ceil(F.col("_rows") / cell).cast("bigint").alias("_blocks"))

    def side(rows: DataFrame, suffix: str, *extra) -> DataFrame:
        return rows.select(*group, *extra, *[F.col(c).alias(f"{c}_{suffix}") for c in payload])

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col(f"{order}_a") < F.col(f"{order}_b")).select(
            *group, *[f"{c}_{s}" for s in ("a", "b") for c in payload])

    small = df.join(large, group, "left_anti")
    plain = ordered(side(small, "a").join(side(small, "b"), group))
    cut_up = df.join(large, group).withColumn("_own", F.pmod(F.xxhash64(order), F.col("_blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    own = F.col("_own")
    cells = ordered(
        side(cut_up, "a", own.alias("_block_a"), every.alias("_block_b")).join(
            side(cut_up, "b", every.alias("_block_a"), own.alias("_block_b")),
            [*group, "_block_a", "_block_b"]))
    return plain.unionByName(cells)
