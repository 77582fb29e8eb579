"""Comparing solvers: leaderboards, gaps, runtimes, histograms.

``results`` here are flat rows: batch, result_set, instance_id, run_id, solver_type, file, status,
energy, wall_seconds and ``position`` (row order, later rows win). Missing energies stay NULL and
never win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.labels import solver_label, status_class
from bitloom.operators.terms import union
from bitloom.operators.results import run_key
from bitloom.schemas import KEY, Batch

# Histogram bins and the tie tolerance of a win.
BINS = 12
WIN_TOLERANCE = 1e-9

SET = ["batch", "result_set"]
CASE = [*SET, "instance_id"]


def labelled(results: DataFrame) -> DataFrame:
    return results.withColumn("solver", solver_label(F.col("file"), F.col("solver_type")))


def solvers(results: DataFrame) -> DataFrame:
    """Distinct sorted solver labels per result set."""
    return labelled(results).select(*SET, "solver").distinct().orderBy(*SET, "solver")


def visible(results: DataFrame, label: str = "all") -> DataFrame:
    rows = labelled(results)
    return rows if label == "all" else rows.where(F.col("solver") == label)


def energy_matrix(results: DataFrame, labels: list[str]) -> DataFrame:
    """One row per instance, one column per label; the latest row of a pair counts."""
    latest = labelled(results).groupBy(*CASE, "solver").agg(
        F.max_by("energy", "position").alias("energy"))
    return latest.groupBy(*CASE).pivot("solver", labels).agg(F.first("energy"))


def mean_runtime(results: DataFrame) -> DataFrame:
    return labelled(results).groupBy(*SET, "solver").agg(F.avg("wall_seconds").alias("seconds"))


def _with_best(results: DataFrame) -> DataFrame:
    """Rows with the best energy of their instance (one small row per instance joined back)."""
    best = results.groupBy(*CASE).agg(F.min("energy").alias("best"))
    return results.join(best, CASE).withColumn("gap", F.col("energy") - F.col("best"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Wins (ties all win), mean gap to the instance's best, mean time, rank."""
    return ranked(labelled(results))


def ranked(runs: DataFrame) -> DataFrame:
    """``leaderboard`` of runs that name their solver."""
    board = _with_best(runs).groupBy(*SET, "solver").agg(
        F.count_if(F.abs("gap") < WIN_TOLERANCE).alias("wins"), F.avg("gap").alias("mean_gap"),
        F.avg("wall_seconds").alias("mean_time"))
    order = Window.partitionBy(*SET).orderBy(F.desc("wins"), F.asc_nulls_last("mean_gap"), "solver")
    return board.withColumn("rank", F.row_number().over(order))


def histogram(batch: Batch, bins: int = BINS) -> DataFrame:
    """Coefficients in equal bins per instance, empty bins kept: key, bin, low, count."""
    values = union(batch.linear.select(*KEY, "v"), batch.quadratic.select(*KEY, "v")).where(
        "NOT isnan(v) AND abs(v) < double('Infinity')")
    range_ = values.groupBy(*KEY).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn(
        "width", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / bins)
    counts = values.join(range_, KEY).groupBy(
        *KEY, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.col("width")))
        .cast("bigint").alias("bin")).agg(F.count("*").alias("count"))
    grid = range_.withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    return grid.join(counts, [*KEY, "bin"], "left").select(
        *KEY, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"),
        F.coalesce("count", F.lit(0)).alias("count"))


def batch_summary(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Problems, active (newest) result set, its solutions, solvers and best energy per batch."""
    problems = manifest.groupBy("batch").agg(F.count("*").alias("problems"))
    listing = result_sets_listing(results.select(*SET).distinct()).where("active")
    sets = results.groupBy("batch").agg(F.count_distinct("result_set").alias("result_sets"))
    current = labelled(results).join(listing.select(*SET), SET, "left_semi").groupBy(*SET).agg(
        F.count("*").alias("solutions"), F.count_distinct("solver").alias("solvers"),
        F.min("energy").alias("best_energy"))
    return problems.join(sets, "batch", "left").join(current, "batch", "left").select(
        "batch", "problems", F.coalesce("result_sets", F.lit(0)).alias("result_sets"),
        F.col("result_set").alias("active_set"), F.coalesce("solutions", F.lit(0)).alias("solutions"),
        F.coalesce("solvers", F.lit(0)).alias("solvers"), "best_energy")


def composition(samples: DataFrame) -> DataFrame:
    """Ones, zeros and share of ones per sample."""
    ones = F.count_if(F.col("x") == 1)
    return samples.groupBy(*KEY, "sample_id").agg(
        ones.alias("ones"), (F.count("*") - ones).alias("zeros"),
        (ones / F.count("*")).alias("share"))


def incumbents(trajectories: DataFrame) -> DataFrame:
    """Checkpoints that hold a finite energy, per run."""
    finite = F.col("energy").isNotNull() & ~F.isnan("energy") & (
        F.abs("energy") < float("inf"))
    return trajectories.groupBy(*run_key(trajectories)).agg(F.count_if(finite).alias("incumbents"))


def set_number(name: Column) -> Column:
    """Number of ``results_N`` or ``results(N)``, 0 for ``results``, NULL for other names."""
    digits = F.regexp_extract(name, r"^results(?:_(\d+)|\((\d+)\))?$", 1)
    other = F.regexp_extract(name, r"^results(?:_(\d+)|\((\d+)\))?$", 2)
    text = F.concat(digits, other)
    return F.when(name.rlike(r"^results(?:_\d+|\(\d+\))?$"),
                  F.coalesce(F.nullif(text, F.lit("")), F.lit("0")).cast("bigint"))


def result_sets_listing(sets: DataFrame) -> DataFrame:
    """Result sets in natural order per batch; the newest is active: number, active."""
    numbered = sets.select(*SET).distinct().withColumn(
        "number", set_number(F.col("result_set"))).where("number IS NOT NULL")
    newest = numbered.groupBy("batch").agg(
        F.max(F.struct("number", "result_set")).alias("top"))
    return numbered.join(newest, "batch").select(
        *SET, "number", (F.col("result_set") == F.col("top.result_set")).alias("active"))


def problem_detail(manifest: DataFrame, batch: Batch, instance_id: str | None = None):
    """Manifest rows with their terms (kind, i, j, v); optionally one instance only."""
    rows = manifest if instance_id is None else manifest.where(
        F.col("instance_id") == instance_id)
    terms = union(
        batch.linear.select(*KEY, F.lit("linear").alias("kind"), "i",
                            F.lit(None).cast("bigint").alias("j"), "v"),
        batch.quadratic.select(*KEY, F.lit("quadratic").alias("kind"), "i", "j", "v"))
    if instance_id is not None:
        terms = terms.where(F.col("instance_id") == instance_id)
    return rows.join(terms, KEY)


def result_detail(manifest: DataFrame, records: DataFrame, file: str | None = None) -> DataFrame:
    """Result manifest rows with their full records, matched by run and instance."""
    rows = manifest if file is None else manifest.where(F.col("file") == file)
    run = run_key(records)
    keep = [c for c in records.columns if c not in rows.columns or c in run]
    return rows.join(records.select(*keep), run)


def batch_tiles(manifest: DataFrame) -> DataFrame:
    """Size figures of a batch, taken from its first instance (manifests are sorted by id)."""
    first = manifest.groupBy("batch").agg(F.min_by(
        F.struct("num_variables", "quadratic_terms",
                 F.col("`parameter.quadratic_density`").alias("density")),
        "instance_id").alias("f"), F.count("*").alias("problems"))
    return first.select(
        "batch", "problems", "f.num_variables", "f.quadratic_terms",
        (F.expr("try_cast(f.density AS double)") * 100.0).alias("requested_density_percent"))


def with_status_class(results: DataFrame) -> DataFrame:
    return results.withColumn("status_class", status_class(F.col("status")))


def by_cell(results: DataFrame, manifest: DataFrame, cell: list[str]) -> DataFrame:
    """Runs, mean energy gap and mean time per benchmark cell and solver.

    ``manifest``: key and the cell columns (realised characteristics).
    """
    rows = _with_best(labelled(results)).join(manifest.select(*KEY, *cell), KEY)
    return rows.groupBy(*cell, "solver").agg(
        F.count("*").alias("runs"), F.avg("gap").alias("mean_gap"),
        F.avg("wall_seconds").alias("mean_time"))


def quality(results: DataFrame, known: DataFrame | None = None, q: float = 0.99) -> DataFrame:
    """Best-known gap, ground-state share and time to solution per instance and solver.

    ``known``: key, known_energy. Time to solution is ``t ln(1-q) / ln(1-p)``: ``t`` itself when
    every run succeeds, NULL when none does.
    """
    rows = labelled(results)
    best = rows.groupBy(*CASE).agg(F.min("energy").alias("best"))
    if known is not None:
        best = best.join(known.select(*KEY, "known_energy"), KEY, "left").withColumn(
            "best", F.least("best", "known_energy")).drop("known_energy")
    graded = rows.join(best, CASE).withColumn("gap", F.col("energy") - F.col("best"))
    sums = graded.groupBy(*CASE, "solver").agg(
        F.count("*").alias("runs"), F.min("gap").alias("best_gap"), F.avg("gap").alias("mean_gap"),
        F.count_if(F.abs("gap") < WIN_TOLERANCE).alias("successes"),
        F.avg("wall_seconds").alias("mean_time"))
    p = F.col("successes") / F.col("runs")
    tts = F.when(p >= 1, F.col("mean_time")).when(
        p > 0, F.col("mean_time") * F.log(F.lit(1.0 - q)) / F.log(1.0 - p))
    return sums.withColumn("success_share", p).withColumn("time_to_solution", tts)
