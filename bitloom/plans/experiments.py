"""Experiment planning: task tables, run names, result sets, checkpoint targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators.terms import canonical_json, index_variables

ENTRY_BLOCK = 64  # solver entries that a problem meets at a time

# Fixed value: characters no file name may contain.
FORBIDDEN = '<>:"/\\|?*'


def safe_name(name: Column) -> Column:
    """Is the text a single folder or file name?"""
    trimmed = F.trim(name)
    return F.coalesce(
        (F.length(trimmed) > 0) & ~trimmed.isin(".", "..") & ~F.exists(
            F.array(*[F.lit(c) for c in FORBIDDEN]), lambda c: F.contains(trimmed, c)),
        F.lit(False))


def run_names(solvers: DataFrame) -> DataFrame:
    """One row per replica with its name: solver columns, replica, run_name.

    ``solvers``: entry, solver_type, instance_name, replicas, and anything else to carry.
    """
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("replicas").cast("bigint")))
    base = F.trim("instance_name")
    return solvers.withColumn("replica", each).withColumn(
        "run_name", F.when(F.col("replicas") == 1, base).otherwise(
            F.concat(base, F.lit("_replica_"), F.col("replica").cast("string"))))


def run_name_issues(solvers: DataFrame) -> DataFrame:
    """Names used more than once, unsafe names, bad replica counts: code, run_name."""
    named = run_names(solvers.where("replicas >= 1"))
    repeated = named.groupBy("run_name").count().where("count > 1").select(
        F.lit("duplicate_run_name").alias("code"), "run_name")
    unsafe = solvers.where(~safe_name(F.col("instance_name"))).select(
        F.lit("unsafe_instance_name").alias("code"), F.col("instance_name").alias("run_name"))
    count = solvers.where(F.coalesce(F.col("replicas") < 1, F.lit(True))).select(
        F.lit("invalid_replicas").alias("code"), F.col("instance_name").alias("run_name"))
    return repeated.unionByName(unsafe).unionByName(count)


def plan_tasks(problems: DataFrame, solvers: DataFrame, results: DataFrame | None = None,
               order: str = "problem_first") -> DataFrame:
    """Problems x solver entries x replicas.

    ``problems``: key, path_dir, stem, problem_order. ``solvers``: entry, solver_type,
    instance_name, replicas, increment_seed, has_seed, default_seed, parameters (map). Entries are
    dealt into blocks of about ``ENTRY_BLOCK``; a problem is expanded to one row per block and meets
    its entries there, on keys salted so that few blocks still use every task.
    ``results``: batch, result_set.
    """
    if order not in ("problem_first", "solver_first"):
        raise ValueError("order must be problem_first or solver_first")
    blocks = max(1, math.ceil(solvers.count() / ENTRY_BLOCK))
    salts = max(1, int(problems.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    block = F.pmod(F.xxhash64("entry", "instance_name"), F.lit(blocks)).cast("int")
    packed = solvers.groupBy(block.alias("_block")).agg(F.collect_list(F.struct(
        "entry", "solver_type", "instance_name", "replicas", "increment_seed", "has_seed",
        "default_seed", F.map_entries("parameters").alias("parameters"))).alias("entries")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = problems.withColumn("_salt", F.pmod(F.xxhash64("batch", "stem", "problem_order"), F.lit(salts)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = dealt.join(packed, ["_block", "_salt"]).select(*problems.columns, F.inline("entries")).withColumn(
        "parameters", F.map_from_entries("parameters"))
    base = F.coalesce(F.expr("try_cast(parameters['seed'] AS bigint)"), F.col("default_seed"),
                      F.lit(0).cast("bigint"))
    seeded = F.when(
        (F.col("replicas") > 1) & F.col("increment_seed") & F.col("has_seed"),
        F.map_concat(F.map_filter("parameters", lambda k, v: k != "seed"),
                     F.create_map(F.lit("seed"),
                                  (base + F.col("replica") - 1).cast("string")))
    ).otherwise(F.col("parameters"))
    tasks = run_names(rows).select(
        *problems.columns, "entry", "replica", "solver_type",
        F.col("run_name").alias("instance_name"), seeded.alias("parameters"))
    if results is not None:
        tasks = tasks.join(results.select("batch", "result_set"), "batch")
    else:
        tasks = tasks.withColumn("result_set", F.lit("results"))
    output = F.concat_ws("/", "batch", "result_set", F.nullif("path_dir", F.lit("")),
                         F.concat("stem", F.lit("--"), "instance_name", F.lit(".json")))
    keys = ["problem_order", "entry", "replica"] if order == "problem_first" else \
        ["entry", "problem_order", "replica"]
    return tasks.withColumn("output_path", output).withColumn(
        "order_key", F.struct(*keys))


def order_tasks(tasks: DataFrame) -> DataFrame:
    """Queue order (a range-partitioned sort)."""
    return tasks.orderBy("order_key")


def limit_problems(problems: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` problems in path order, numbered by ``problem_order``."""
    numbered = index_variables(problems.withColumn("_all", F.lit(0)), ["path"], ["_all"],
                               "problem_order").drop("_all")
    return numbered if limit is None else numbered.where(F.col("problem_order") < limit)


def result_sets(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """Collision-free result folder per batch: batch, result_set.

    ``targets``: batch, file (the paths the tasks would write below the folder). ``existing``:
    batch, result_set, file. ``results`` is used unless one of its files exists; then the first
    free ``results_N``.
    """
    hit = targets.join(existing.where("result_set = 'results'").select("batch", "file"),
                       ["batch", "file"], "left_semi").select("batch").distinct()
    taken = existing.select(
        "batch", F.regexp_extract("result_set", r"^results_(\d+)$", 1).alias("n")).where(
        "n <> ''").select("batch", F.col("n").cast("bigint").alias("n")).distinct()
    # the smallest free number follows a taken one (or is 1): try each taken + 1
    tries = hit.withColumn("n", F.lit(1).cast("bigint")).unionByName(
        taken.join(hit, "batch", "left_semi").select("batch", F.col("n") + 1).toDF("batch", "n"))
    free = tries.join(taken, ["batch", "n"], "left_anti").groupBy("batch").agg(
        F.min("n").alias("n"))
    return targets.select("batch").distinct().join(free, "batch", "left").select(
        "batch", F.when(F.col("n").isNull(), "results").otherwise(
            F.concat(F.lit("results_"), F.col("n").cast("string"))).alias("result_set"))


def batch_names(entries: DataFrame) -> DataFrame:
    """Given name, else ``type_n_density`` (or just the type), with a safety flag.

    ``entries``: type, batch_name, num_variables, quadratic_density.
    """
    density = F.col("quadratic_density")
    text = F.regexp_replace(F.format_string("%.6g", density), r"\.?0+(e|$)", "$1")
    default = F.when(
        F.col("num_variables").isNotNull() & density.isNotNull(),
        F.concat_ws("_", "type", F.col("num_variables").cast("string"), text)
    ).otherwise(F.col("type"))
    name = F.trim(F.coalesce("batch_name", default))
    return entries.withColumn("name", name).withColumn("is_safe", safe_name(name))


def targets(work: DataFrame) -> DataFrame:
    """Equally spaced checkpoints ``ceil(i * total / k)``: adds idx, target.

    ``work``: any columns with total and k; rows with ``k > total`` or ``total < 1`` are reported
    by ``target_issues`` instead.
    """
    fit = work.where("total >= 1 AND k >= 1 AND k <= total")
    return fit.withColumn("idx", F.explode(F.expr("sequence(1L, CAST(k AS BIGINT))"))).withColumn(
        "target", F.expr("CAST((idx * total + k - 1) DIV k AS BIGINT)"))


def target_issues(work: DataFrame) -> DataFrame:
    code = (F.when(F.col("total") < 1, "no_work_units")
            .when(F.col("k") < 0, "negative_checkpoints")
            .when(F.col("k") > F.col("total"), "more_checkpoints_than_work"))
    return work.withColumn("code", code).where("code IS NOT NULL")


def target_plan(params: DataFrame) -> DataFrame:
    """Unit and targets of a run: seconds if a time limit is set, else nodes, else an error row.

    ``params``: any columns with time_limit, node_limit, k. Time targets are fractional.
    """
    unit = (F.when(F.col("time_limit") > 0, "seconds")
            .when(F.col("node_limit") > 0, "branch_and_bound_nodes"))
    total = F.when(F.col("time_limit") > 0, F.col("time_limit")).otherwise(
        F.col("node_limit").cast("double"))
    rows = params.where("k >= 1").withColumn("unit", unit).withColumn("total", total)
    # an integer budget must allow k distinct checkpoints; otherwise one row carries the error
    code = F.when(F.col("unit").isNull(), "no_budget").when(
        (F.col("unit") != "seconds") & (F.col("k") > F.col("total")), "more_checkpoints_than_work")
    rows = rows.withColumn("code", code).withColumn("idx", F.explode(F.when(
        F.col("code").isNull(), F.expr("sequence(1L, CAST(k AS BIGINT))")).otherwise(
        F.array(F.lit(None).cast("bigint")))))
    exact = F.col("total") * F.col("idx") / F.col("k")
    return rows.withColumn("target", F.when(F.col("unit") == "seconds", exact).otherwise(
        F.expr("CAST((idx * CAST(total AS BIGINT) + k - 1) DIV k AS DOUBLE)")))


def run_ids(runs: DataFrame) -> DataFrame:
    """Add ``run_id``: ``solver-<16 hex>`` of the canonical identity.

    ``runs``: instance_id, solver_type, instance_name, parameters (map). A ``num_snapshots`` of 0
    is left out of the identity; a missing instance name too.
    """
    kept = F.map_filter("parameters", lambda k, v: ~((k == "num_snapshots") & (v == "0")))
    identity = F.to_json(F.struct(
        "instance_id", canonical_json(kept).alias("parameters"),
        F.col("instance_name").alias("solver_instance_name"), "solver_type"))
    return runs.withColumn("run_id", F.concat(
        "solver_type", F.lit("-"), F.substring(F.sha2(identity, 256), 1, 16)))


def task_report(tasks: DataFrame, results: DataFrame, failures: DataFrame):
    """Per-task outcome (saved, failed with message, pending) and the counts per batch.

    All three are keyed by output_path; ``failures`` also has message.
    """
    saved = results.select("output_path", F.lit(True).alias("_saved")).distinct()
    failed = failures.groupBy("output_path").agg(F.max("message").alias("message"))
    rows = tasks.join(saved, "output_path", "left").join(failed, "output_path", "left").withColumn(
        "outcome", F.when(F.col("_saved"), "saved").when(
            F.col("message").isNotNull(), "failed").otherwise("pending")).drop("_saved")
    return rows, rows.groupBy("batch", "outcome").agg(F.count("*").alias("tasks"))
