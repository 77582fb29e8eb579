"""Manifest rows and their upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.validation import widen
from bitloom.schemas import KEY, PROBLEM_MANIFEST_COLUMNS, RESULT_MANIFEST_COLUMNS, Batch


def _latest(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Union in which a new row replaces the old one of its key.

    Within one side the row with the largest ``order`` wins (the last one, if the column numbers the
    rows); rows of equal order, or without such a column, are settled by their largest values. The
    pick is an aggregate, so repeated rows of one key combine before the shuffle.
    """
    if order is not None:
        old, new = (df.withColumn("_order", F.col(order) if order in df.columns else F.lit(None)) for df in (old, new))
        old, new = (df.drop(order) for df in (old, new))
    both = old.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    payload = [c for c in both.columns if c not in keys and c not in ("_new", "_order")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(payload)])
    picked = both.groupBy(*keys).agg(F.max(F.struct(
        "_new", *(["_order"] if order else []), row.alias("r"))).alias("m"))
    return picked.select(*keys, *[
        F.col(f"m.r.c{n}").alias(c) for n, c in enumerate(payload)])


def upsert_problem_manifest(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Replace rows by (batch, instance_id), keep unknown columns, sort by id; ``order``: see ``_latest``.

    Rows without an id are dropped. Known columns come first, others in name order.
    """
    rows = _latest(old, new, KEY, order).where("instance_id IS NOT NULL AND instance_id <> ''")
    known = [c for c in PROBLEM_MANIFEST_COLUMNS if c in rows.columns]
    extra = sorted(c for c in rows.columns if c not in known and c != "batch")
    return rows.select("batch", *known, *[F.col(f"`{c}`") for c in extra]).orderBy(*KEY)


def upsert_results_manifest(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Replace rows by run and instance within batch and result set; fixed columns; ``order``: see ``_latest``."""
    keys = ["batch", "result_set", "run_id", "instance_id"]
    fixed = ["batch", "result_set", *RESULT_MANIFEST_COLUMNS]
    given = [*fixed, order] if order else fixed

    def fit(df: DataFrame) -> DataFrame:
        return df.select(*[
            F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in given])

    return _latest(fit(old), fit(new), keys, order).select(*fixed).orderBy(
        "batch", "result_set", "solver_type", "instance_id")


def problem_manifest(batch: Batch, issues: DataFrame, characteristics: DataFrame,
                     parameter_keys: list[str], stat_keys: list[str]) -> DataFrame:
    """One row per instance: counts, status, ``;``-joined codes, dotted columns.

    Codes are sorted and, being from a fixed list, few; parameters and statistics are pivoted by
    the declared key lists.
    """
    linear = batch.linear.groupBy(*KEY).agg(F.count("*").alias("linear_terms"))
    quadratic = batch.quadratic.groupBy(*KEY).agg(F.count("*").alias("quadratic_terms"))

    def codes(severity: str):
        chosen = F.collect_set(F.when(F.col("severity") == severity, F.col("code")))
        return F.array_join(F.array_sort(chosen), ";")

    listed = issues.select(*KEY, "severity", "code").distinct().groupBy(*KEY).agg(
        codes("warning").alias("warning_codes"), codes("error").alias("error_codes"))
    stats = widen(characteristics, stat_keys)
    rows = (batch.instances.join(linear, KEY, "left").join(quadratic, KEY, "left")
            .join(listed, KEY, "left").join(stats, KEY, "left"))
    empty = F.lit("")
    return rows.select(
        *KEY, "problem_type", F.coalesce("problem_name", "problem_type").alias("problem_name"),
        "seed", F.concat("instance_id", F.lit(".qubo")).alias("file"), "num_variables",
        F.coalesce("linear_terms", F.lit(0)).alias("linear_terms"),
        F.coalesce("quadratic_terms", F.lit(0)).alias("quadratic_terms"),
        F.when(F.coalesce("error_codes", empty) == "", "passed").otherwise("failed")
        .alias("validation_status"),
        F.coalesce("warning_codes", empty).alias("warning_codes"),
        F.coalesce("error_codes", empty).alias("error_codes"),
        *[F.col("parameters")[k].alias(f"parameter.{k}") for k in parameter_keys],
        *[F.col(f"`{k}`").alias(f"stat.{k}") for k in stat_keys])


def results_manifest(records: DataFrame) -> DataFrame:
    """Nested result records to the 17 manifest columns (with batch and result_set)."""
    c = F.col
    columns = [
        c("run_id"), c("problem.instance_id").alias("instance_id"), c("problem.problem_type"),
        c("problem.num_variables"), c("problem.quadratic_terms"),
        c("solver.type").alias("solver_type"), c("solver.version").alias("solver_version"),
        c("solver.device"), c("status"), c("solution.energy"), c("verification.reported_energy"),
        c("verification.recomputed_energy"), c("verification.absolute_energy_difference"),
        c("verification.passed").alias("energy_check_passed"), c("timing.wall_seconds"),
        F.coalesce(F.size("snapshots"), F.lit(0)).cast("bigint").alias("snapshots"), c("file")]
    return records.select("batch", "result_set", *columns)
