"""Canonical term tables and result records on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.schemas import (
    INSTANCES, KEY, LINEAR, QUADRATIC, VARIABLES, Batch,
)

_ORDER = {"instances": [], "linear": ["i"], "quadratic": ["i", "j"], "variables": ["i"]}
_SCHEMAS = {"instances": INSTANCES, "linear": LINEAR, "quadratic": QUADRATIC,
            "variables": VARIABLES}


def _fit(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a table, missing ones NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in _SCHEMAS[name].fields])


def write_batch(batch: Batch, path: str) -> None:
    """Write the term tables below ``path``, sorted, one folder per batch name.

    Rows are range-partitioned by (key, i, j), so a huge instance fills many files. Each table
    replaces only the batches it contains and is committed whole; ``instances`` comes last, and
    an instance exists only once its row there does.
    """
    parts = {"quadratic": batch.quadratic, "linear": batch.linear,
             "variables": batch.variables, "instances": batch.instances}
    for name, df in parts.items():
        if df is None:
            continue
        keys = [*KEY, *_ORDER[name]]
        (_fit(df, name).repartitionByRange(*keys).sortWithinPartitions(*keys)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(f"{path}/{name}"))


def read_batch(spark: SparkSession, path: str, batches: list[str] | None = None,
               variables: bool = False) -> Batch:
    """Read term tables; a list of batch names prunes folders."""

    def table(name: str) -> DataFrame:
        df = spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")
        return df if batches is None else df.where(F.col("batch").isin(batches))

    return Batch(table("instances"), table("linear"), table("quadratic"),
                 table("variables") if variables else None)


def passed_only(batch: Batch, issues: DataFrame) -> Batch:
    """Keep instances without validation errors."""
    failed = issues.where("severity = 'error'").select(*KEY).distinct()

    def keep(df):
        return None if df is None else df.join(failed, KEY, "left_anti")

    return Batch(keep(batch.instances), keep(batch.linear), keep(batch.quadratic),
                 keep(batch.variables))


def write_results(results: DataFrame, path: str, format: str = "json") -> None:
    """One record per run, in folders ``batch=.../result_set=...``."""
    (results.repartitionByRange("batch", "result_set", "run_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "result_set").format(format).save(path))
