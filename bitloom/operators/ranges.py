"""Index ranges as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536
TASKS_A_CORE = 3


def spread_range(df: DataFrame, count: Column | str, name: str, block: int = BLOCK) -> DataFrame:
    """One row per ``0 .. count-1`` of every input row (none for a count below 1).

    A long range is first cut into blocks that are spread over tasks, so neither an array nor a
    task ever holds more than ``block`` values of one row. The number of tasks is given: by the few bytes that
    blocks have before their rows are made, adaptive execution would leave them all to one.
    """
    count = (F.col(count) if isinstance(count, str) else count).cast("bigint")
    counted = df.withColumn("_count", count).where("_count > 0")
    blocks = counted.withColumn(
        "_block", F.explode(F.expr(f"sequence(0L, (_count - 1L) DIV {block}L)")))
    spark = df.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    spread = blocks.repartition(tasks, F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(df)], "_block"))
    return spread.withColumn(name, F.explode(F.expr(
        f"sequence(_block * {block}L, least(_count, (_block + 1L) * {block}L) - 1L)"))).drop(
        "_count", "_block")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
