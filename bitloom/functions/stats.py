"""Long-form characteristics: one row ``(batch, instance_id, key, value, text)`` per number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.schemas import KEY

STATISTICS = ["count", "min", "max", "mean", "std"]


def stat_columns(value: Column | str, prefix: str) -> list[Column]:
    """count/min/max/mean/population deviation as aggregates named ``prefix.<name>``."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    calls = [F.count(value), F.min(value), F.max(value), F.avg(value), F.stddev_pop(value)]
    return [call.cast("double").alias(f"{prefix}.{name}") for call, name in zip(calls, STATISTICS)]


def melt(df: DataFrame, *, text: tuple[str, ...] = ()) -> DataFrame:
    """Turn every non-key column into a ``(key, value, text)`` row; booleans become 0/1."""
    names = [c for c in df.columns if c not in KEY]
    cells = [
        F.struct(
            F.lit(name).alias("key"),
            (F.lit(None) if name in text else F.col(f"`{name}`")).cast("double").alias("value"),
            (F.col(f"`{name}`") if name in text else F.lit(None)).cast("string").alias("text"),
        )
        for name in names
    ]
    return df.select(*KEY, F.inline(F.array(*cells)))


def stats(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Statistics of ``column`` per instance, long form."""
    return melt(df.groupBy(*KEY).agg(*stat_columns(column, prefix or column)))


def std_with_zeros(variance: Column, mean: Column, count: Column, total: Column) -> Column:
    """Population deviation of ``total`` values: ``count`` of known variance and mean, the others 0.

    The variance comes from mergeable moments (``var_pop``), so equal values deviate by exactly 0 and no sum of squares overflows.
    """
    spread = count * variance + count * (total - count) / total * mean * mean
    return F.when(total > 0, F.coalesce(F.sqrt(spread / total), F.lit(0.0))).otherwise(0.0)
