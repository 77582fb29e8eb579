"""Solver runs: verification, checkpoint contract, incumbent curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.energy import energy
from bitloom.operators.terms import index_variables
from bitloom.operators.validation import _nonfinite
from bitloom.schemas import KEY, RESULT, Batch
from bitloom.session import cut

# Tolerances of the result check and of the final checkpoint.
RESULT_TOLERANCE = 1e-5
FINAL_TOLERANCE = 1e-9
PROGRESS_TOLERANCE = 1e-12
SCAN_BLOCK = 65_536


def run_key(df: DataFrame) -> list[str]:
    """Columns that name a run: result sets of one batch may repeat run ids, so the set belongs to it."""
    return ["batch", *(["result_set"] if "result_set" in df.columns else []), "instance_id", "run_id"]


def _close(a, b, tolerance: float):
    return F.abs(a - b) <= F.greatest(
        F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))


def unfold_samples(rows: DataFrame, sample: str = "sample") -> DataFrame:
    """Arrays of bits to one row per bit: the key columns, sample_id, i, x."""
    return rows.select(*KEY, "sample_id", F.posexplode(sample).alias("i", "x")).select(
        *KEY, "sample_id", F.col("i").cast("bigint").alias("i"),
        F.col("x").cast("bigint").alias("x"))


def _numbered(rows: DataFrame, place: list[str]) -> DataFrame:
    """Rows with a sample_id by their place. Both tables are written, as energies read the samples several times."""
    rows = cut(rows)
    return cut(rows.join(index_variables(rows.select(*place).distinct(), place[1:], name="sample_id"), place))


def _recompute(rows: DataFrame, batch: Batch) -> DataFrame:
    """Add ``recomputed_energy`` to rows (key, sample_id, sample, ...)."""
    computed = energy(batch, unfold_samples(rows.where("sample IS NOT NULL")))
    return rows.join(computed.withColumnRenamed("energy", "recomputed_energy"),
                     [*KEY, "sample_id"], "left")


def _graded(df: DataFrame) -> DataFrame:
    """Difference and verdict of reported against recomputed energies."""
    a, b = F.col("recomputed_energy"), F.col("reported_energy")
    difference = F.abs(a - b)
    limit = RESULT_TOLERANCE * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    finite = ~_nonfinite(a) & ~_nonfinite(b)
    return df.withColumn("absolute_energy_difference", difference).withColumn(
        "passed", F.coalesce(finite & (difference <= limit), F.lit(False)))


def verify_results(results: DataFrame, batch: Batch) -> DataFrame:
    """Recompute every run's energy; a mismatch is recorded, the recomputed value counts.

    ``results``: key, run_id, sample (array), reported_energy (NULL takes the recomputed one).
    """
    run = run_key(results)
    checked = _recompute(_numbered(results, run), batch).withColumn(
        "reported_energy", F.coalesce("reported_energy", "recomputed_energy"))
    return _graded(checked).drop("sample_id")


def normalize_results(runs: DataFrame) -> DataFrame:
    """Flat run columns to the nested record: key plus the fields of ``schemas.RESULT``."""
    c = F.col
    problem = F.struct("instance_id", "problem_type", "num_variables", "quadratic_terms", "source")
    solver = F.struct(
        c("solver_type").alias("type"), "instance_name", c("solver_name").alias("name"),
        c("solver_version").alias("version"), "parameters",
        F.coalesce("device", F.lit("cpu")).alias("device"))
    verification = F.struct(
        F.forall("sample", lambda x: x.isin(0, 1)).alias("binary_sample"), "reported_energy",
        "recomputed_energy", "absolute_energy_difference", "passed")
    fields = {
        "schema_version": F.lit(2), "run_id": c("run_id"), "problem": problem, "solver": solver,
        "status": c("status"),
        "solution": F.struct("sample", c("recomputed_energy").alias("energy")),
        "timing": F.struct("wall_seconds"), "verification": verification,
        "snapshots": c("snapshots"), "solver_metrics": c("solver_metrics")}
    return runs.select(*[c for c in run_key(runs) if c != "run_id"], *[
        fields[f.name].cast(f.dataType).alias(f.name) for f in RESULT.fields])


def checkpoint_issues(checkpoints: DataFrame, runs: DataFrame, batch: Batch | None = None) -> DataFrame:
    """Broken checkpoint rules per run: key, run_id, code, rows.

    ``checkpoints``: key, run_id, idx, progress, unit, value, total, elapsed, sample,
    reported_energy. ``runs``: key, run_id, k (checkpoints expected). The neighbour of a checkpoint
    is found by joining on its index, so a run's checkpoints need not share a task.
    """
    run = run_key(runs)
    rows = checkpoints.join(runs.select(*run, "k"), run)
    before = checkpoints.groupBy(*run, (F.col("idx") + 1).alias("idx")).agg(
        F.max("progress").alias("_before"))
    rows = rows.join(before, [*run, "idx"], "left")
    if batch is not None:
        rows = rows.join(batch.instances.select(*KEY, "num_variables"), KEY, "left")
        wrong_length = F.size("sample") != F.col("num_variables")
    else:
        wrong_length = F.lit(False)
    value, total = F.col("value"), F.col("total")
    elapsed = F.col("elapsed")
    expected = F.col("idx") / F.col("k")
    rules = {
        "invalid_index": F.coalesce((F.col("idx") < 1) | (F.col("idx") > F.col("k")), F.lit(True)),
        "uneven_progress": F.coalesce(
            ~_close(F.col("progress"), expected, PROGRESS_TOLERANCE), F.lit(True)),
        "progress_not_rising": F.col("progress") <= F.coalesce("_before", F.lit(0.0)),
        "empty_target_unit": F.coalesce(F.length("unit") == 0, F.lit(True)),
        "invalid_target_number": _nonfinite(value) | _nonfinite(total) | (value < 0) | (total < 0),
        "target_above_total": value > total,
        "invalid_elapsed_seconds": elapsed.isNotNull() & (_nonfinite(elapsed) | (elapsed < 0)),
        "energy_without_sample": F.col("sample").isNull() & F.col("reported_energy").isNotNull(),
        "wrong_sample_length": wrong_length,
        "nonbinary_sample": F.exists("sample", lambda x: ~x.isin(0, 1)),
    }
    per_row = rows.groupBy(*run).agg(*[
        F.count_if(F.coalesce(test, F.lit(False))).alias(code) for code, test in rules.items()])
    repeated = checkpoints.groupBy(*run, "idx").agg(F.count("*").alias("c")).groupBy(*run).agg(
        F.sum("c").alias("have"), F.sum(F.col("c") - 1).alias("repeated_index"))
    facts = runs.select(*run, "k").join(repeated, run, "left").join(per_row, run, "left").withColumn(
        "wrong_checkpoint_count", (F.coalesce("have", F.lit(0)) != F.col("k")).cast("bigint"))
    codes = ["wrong_checkpoint_count", "repeated_index", *rules]
    cells = [F.struct(F.lit(c).alias("code"), F.coalesce(c, F.lit(0)).alias("rows")) for c in codes]
    return facts.select(*run, F.inline(F.array(*cells))).where("rows > 0")


def verify_checkpoints(checkpoints: DataFrame, results: DataFrame, batch: Batch):
    """Recomputed checkpoint energies, and runs whose last checkpoint is not their solution.

    ``results``: key, run_id, sample, energy. Returns (checkpoints with verdict, issue rows).
    """
    run = run_key(checkpoints)
    checked = _graded(_recompute(_numbered(checkpoints, [*run, "idx"]), batch)).drop("sample_id")
    last = checked.groupBy(*run).agg(F.max_by(
        F.struct("sample", "recomputed_energy"), "idx").alias("last"))
    compared = results.select(*run, "sample", "energy").join(last, run)
    code = F.when(F.col("last.sample").isNull(), "final_checkpoint_without_incumbent").when(
        ~(F.col("last.sample").cast("array<bigint>") == F.col("sample").cast("array<bigint>"))
        | ~_close(F.col("last.recomputed_energy"), F.col("energy"), FINAL_TOLERANCE),
        "final_checkpoint_differs")
    return checked, compared.withColumn("code", code).where("code IS NOT NULL").select(*run, "code")


def incumbent_by_reads(reads: DataFrame, runs: DataFrame) -> DataFrame:
    """Best energy after equal shares of the reads: key, run_id, idx, target, energy, position.

    ``reads``: key, run_id, position, occurrences, energy. ``runs``: key, run_id, num_reads, k. A
    row stands for ``occurrences`` reads; missing and non-finite energies take reads but never win. Rows before a read are counted in blocks of positions:
    inside a block by a window, between blocks over one row per block. A read then belongs to the
    first target it can influence, which leaves at most ``k`` rows per run.
    """
    run = run_key(runs)
    blocked = reads.withColumn("_block", F.floor(F.col("position") / SCAN_BLOCK))
    sums = blocked.groupBy(*run, "_block").agg(F.sum("occurrences").alias("_sum"))
    upto = Window.partitionBy(*run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*run, "_block").orderBy("position").rowsBetween(
        Window.unboundedPreceding, -1)
    counted = blocked.withColumn("_in", F.coalesce(F.sum("occurrences").over(inside), F.lit(0))
                                 ).join(starts, [*run, "_block"]).withColumn(
        "before", F.col("_start") + F.col("_in"))
    placed = counted.join(runs.select(*run, "num_reads", "k"), run).withColumn(
        "idx", F.expr("(before * k) DIV num_reads + 1")).where("idx <= k AND occurrences > 0")
    best = placed.groupBy(*run, "idx").agg(
        F.min(F.when(~_nonfinite(F.col("energy")), F.struct("energy", "position"))).alias("b"))
    grid = runs.where("k >= 1 AND k <= num_reads").select(
        *run, "num_reads", "k", F.explode(F.expr("sequence(1L, CAST(k AS BIGINT))")).alias("idx"))
    so_far = Window.partitionBy(*run).orderBy("idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return grid.join(best, [*run, "idx"], "left").withColumn("b", F.min("b").over(so_far)).select(
        *run, "idx", F.expr("(idx * num_reads + k - 1) DIV k").alias("target"),
        F.col("b.energy").alias("energy"), F.col("b.position").alias("position"))


def incumbent_asof(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Last improvement before each target; the last target takes the final solution.

    ``events``: key, run_id, progress, seq, energy. ``runs``: key, run_id, k, total,
    initial_energy, final_energy; targets are ``total * idx / k``. A target is served before an
    improvement that arrives exactly on it, as a solver's callback does. Each event goes to the
    first target after it, so no event table is ever windowed.
    """
    run = run_key(runs)
    facts = runs.select(*run, "k", "total")
    progress, total, k = F.col("progress"), F.col("total"), F.col("k")
    guess = (F.floor(progress * k / total) + 1).cast("bigint")
    idx = F.when(total * (guess - 1) / k > progress, guess - 1).when(
        total * guess / k <= progress, guess + 1).otherwise(guess)
    last = events.join(facts, run).withColumn("idx", idx).where("idx < k").groupBy(
        *run, "idx").agg(F.max_by("energy", F.struct("progress", "seq")).alias("e"))
    grid = runs.where("k >= 1").withColumn(
        "idx", F.explode(F.expr("sequence(1L, CAST(k AS BIGINT))")))
    so_far = Window.partitionBy(*run).orderBy("idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return grid.join(last, [*run, "idx"], "left").withColumn(
        "e", F.last("e", ignorenulls=True).over(so_far)).select(
        *run, "idx", (F.col("total") * F.col("idx") / F.col("k")).alias("target"),
        F.when(F.col("idx") == F.col("k"), F.col("final_energy")).otherwise(
            F.coalesce("e", "initial_energy")).alias("energy"))


def trajectory(results: DataFrame) -> DataFrame:
    """One row per checkpoint of nested records: idx, progress %, energy, elapsed, target, unit.

    A run without checkpoints keeps one row of NULLs.
    """
    run = run_key(results)
    return results.select(*run, F.explode_outer("snapshots").alias("s")).select(
        *run, F.col("s.index").alias("checkpoint"),
        (F.coalesce("s.progress_fraction", F.when(F.col("s").isNotNull(), 0.0)) * 100.0)
        .alias("progress"),
        F.col("s.solution.energy").alias("energy"), F.col("s.elapsed_seconds").alias("elapsed"),
        F.col("s.target.value").alias("target"), F.col("s.target.unit").alias("unit"))


def metrics_json(df: DataFrame, column: str = "solver_metrics") -> DataFrame:
    """Nested or map metrics as JSON text; NULL becomes an empty object."""
    return df.withColumn(column, F.coalesce(F.to_json(F.col(column)), F.lit("{}")))

