"""Results and checkpoints (R-1 .. R-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import encoders as E
from bitloom.operators import results as R
from bitloom.plans.experiments import target_plan
from bitloom.schemas import KEY
from catalog.base import query

# A run per route sample: the sample as an array with a reported energy that is sometimes wrong.
_CUTS = """
c AS (SELECT e.instance_id, s.sample_id, sum(CASE WHEN s.x <> t.x THEN -e.w ELSE 0 END) AS e
      FROM {route_edges} e JOIN {route_samples} s ON s.instance_id = e.instance_id AND s.i = e.u
      JOIN {route_samples} t ON t.instance_id = e.instance_id AND t.i = e.v AND t.sample_id = s.sample_id GROUP BY ALL),
f AS (SELECT r.batch, r.instance_id, r.sample_id, coalesce(c.e, 0.0) AS e
      FROM (SELECT DISTINCT batch, instance_id, sample_id FROM {route_samples}) r LEFT JOIN c USING (instance_id, sample_id))"""


def _reported(v):
    """Runs with reported energies: the true one, plus 1 for every fifth customer's sample 2.

    Set ``results_1`` repeats the run ids of ``results``, each with the next sample.
    """
    from bitloom.operators.energy import cut_energy

    cuts = cut_energy(v.route_edges, v.route_samples)
    off = (F.col("instance_id").cast("bigint") % 5 == 0) & (F.col("sample_id") == 2)
    arrays = v.route_samples.groupBy(*KEY, "sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias(
            "sample"))
    sets = F.explode(F.array(F.struct(F.lit("results").alias("result_set"), F.col("sample_id").alias("n")),
                             F.struct(F.lit("results_1").alias("result_set"), ((F.col("sample_id") + 3) % 4).alias("n"))))
    return arrays.join(cuts, [*KEY, "sample_id"]).withColumn("set", sets).select(
        *KEY, "set.result_set", F.concat(F.lit("run-"), F.col("set.n")).alias("run_id"), "sample",
        (F.col("energy") + F.when(off, 1.0).otherwise(0.0)).alias("reported_energy"),
        "energy", "set.n")


def _model(v):
    v.keep("route_edges", "route_samples")
    return E.encode_max_cut(v.route_edges, v.route_sizes)


@query("r1_verify_results", f"""
WITH {_CUTS},
r AS (SELECT *, e + CASE WHEN CAST(instance_id AS BIGINT) % 5 = 0 AND sample_id = 2 THEN 1.0 ELSE 0.0 END AS rep FROM f),
s AS (SELECT *, 'results' AS result_set, sample_id AS n FROM r UNION ALL SELECT *, 'results_1', (sample_id + 3) % 4 FROM r)
SELECT batch, result_set, instance_id, concat('run-', CAST(n AS VARCHAR)) AS run_id, rep AS reported_energy, e AS recomputed_energy,
       abs(rep - e) AS absolute_energy_difference, abs(rep - e) <= 1e-5*greatest(1, abs(e), abs(rep)) AS passed FROM s""")
def r1(v):
    batch = _model(v)
    return R.verify_results(_reported(v), batch).select(
        *KEY, "result_set", "run_id", "reported_energy", "recomputed_energy", "absolute_energy_difference",
        "passed")


def _record_rows(v, runs=None):
    """Flat runs from events, with three checkpoints each, in the columns of a record."""
    steps = F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))
    snapshot = F.transform(steps, lambda k: F.struct(
        k.alias("index"), (k / 3).alias("progress_fraction"),
        F.struct(F.lit("states").alias("unit"), k.cast("double").alias("value"),
                 F.lit(3.0).alias("total")).alias("target"),
        (F.col("wall_seconds") * k / 3).alias("elapsed_seconds"),
        F.when((F.col("position") + k) % 4 != 0, F.struct(
            F.lit(None).cast("array<tinyint>").alias("sample"),
            (F.col("energy") + 3.0 - k).alias("energy"))).alias("solution"),
        F.lit(None).cast("struct<binary_sample:boolean,reported_energy:double,recomputed_energy:"
                         "double,absolute_energy_difference:double,passed:boolean>")
        .alias("verification"),
        F.create_map(F.lit("k"), k.cast("string")).alias("solver_metrics")))
    return (v.runs if runs is None else runs).select(
        *KEY, "result_set", "run_id", "file", "status", "wall_seconds", "solver_type", "position",
        F.lit("max_cut").alias("problem_type"), F.lit(3).cast("bigint").alias("num_variables"),
        F.lit(2).cast("bigint").alias("quadratic_terms"), F.lit(None).cast("string").alias("source"),
        F.col("solver_type").alias("instance_name"), F.upper("solver_type").alias("solver_name"),
        F.lit("1.0").alias("solver_version"),
        F.create_map(F.lit("seed"), F.col("position").cast("string")).alias("parameters"),
        F.lit(None).cast("string").alias("device"),
        F.array(F.lit(1), F.lit(0), (F.col("position") % 2).cast("int")).cast(
            "array<tinyint>").alias("sample"),
        F.col("energy").alias("recomputed_energy"),
        (F.col("energy") + F.when(F.col("position") % 10 == 0, 2.0).otherwise(0.0))
        .alias("reported_energy"),
        F.when(F.col("position") % 10 == 0, 2.0).otherwise(0.0).alias(
            "absolute_energy_difference"),
        (F.col("position") % 10 != 0).alias("passed"),
        F.when(F.col("position") % 6 != 0, snapshot).alias("snapshots"),
        F.create_map(F.lit("reads"), F.lit("10")).alias("solver_metrics"))


def records(v):
    """Normalised nested records with batch, result_set and file."""
    flat = _record_rows(v)
    return R.normalize_results(flat).join(
        flat.select(*KEY, "run_id", "result_set", "file"), [*KEY, "result_set", "run_id"])


@query("r2_normalize_results", """
SELECT batch, instance_id, run_id, 2 AS schema_version, status, 'cpu' AS device, energy, wall_seconds,
       position % 10 <> 0 AS passed, true AS binary_sample,
       CAST(CASE WHEN position % 6 = 0 THEN NULL ELSE 3 END AS INTEGER) AS snapshots
FROM {runs}""")
def r2(v):
    return R.normalize_results(_record_rows(v)).select(
        *KEY, "run_id", "schema_version", "status", "solver.device", "solution.energy",
        "timing.wall_seconds", "verification.passed", "verification.binary_sample",
        F.size("snapshots").alias("snapshots")).withColumn(
        "snapshots", F.when(F.col("snapshots") >= 0, F.col("snapshots")))


# every run's checkpoints are shared out over two result sets
_HALVES = "SELECT *, CASE WHEN value > 25 THEN 'results' ELSE 'results_1' END AS result_set FROM {checkpoints}"


@query("r3_checkpoint_issues", f"""
WITH k AS ({_HALVES}),
c AS (SELECT c.*, (SELECT max(progress) FROM k p WHERE p.run_id = c.run_id AND p.instance_id = c.instance_id
                   AND p.result_set = c.result_set AND p.idx = c.idx - 1) AS before FROM k c),
n AS (SELECT batch, result_set, instance_id, run_id, count(*) AS have, count(*) - count(DISTINCT idx) AS rep FROM k GROUP BY ALL)
SELECT batch, result_set, instance_id, run_id, code, count(*) AS rows FROM (
  SELECT batch, result_set, instance_id, run_id, 'empty_target_unit' AS code FROM c WHERE unit = ''
  UNION ALL SELECT batch, result_set, instance_id, run_id, 'target_above_total' FROM c WHERE value > total
  UNION ALL SELECT batch, result_set, instance_id, run_id, 'invalid_elapsed_seconds' FROM c WHERE elapsed < 0
  UNION ALL SELECT batch, result_set, instance_id, run_id, 'energy_without_sample' FROM c
  UNION ALL SELECT batch, result_set, instance_id, run_id, 'progress_not_rising' FROM c WHERE progress <= coalesce(before, 0)
  UNION ALL SELECT batch, result_set, instance_id, run_id, 'wrong_checkpoint_count' FROM n WHERE have <> 7) t GROUP BY ALL
UNION ALL SELECT batch, result_set, instance_id, run_id, 'repeated_index', rep FROM n WHERE rep > 0""")
def r3(v):
    v.keep("checkpoints")
    halves = v.sql(_HALVES)
    rows = halves.withColumnRenamed("energy", "reported_energy").withColumn(
        "sample", F.lit(None).cast("array<tinyint>"))
    runs = halves.select(*KEY, "result_set", "run_id").distinct().withColumn(
        "k", F.lit(7).cast("bigint"))
    return R.checkpoint_issues(rows, runs)


def _run_checkpoints(v):
    """The four samples of a route as the checkpoints of one run per customer."""
    rows = _reported(v)
    checkpoints = rows.select(*KEY, "result_set", F.lit("run").alias("run_id"), (F.col("n") + 1).alias("idx"),
                              "sample", "reported_energy")
    # the run claims the last sample as its solution; every third customer claims sample 0
    claim = F.when(F.col("instance_id").cast("bigint") % 3 == 0, 0).otherwise(3)
    finals = rows.where(F.col("n") == claim).select(
        *KEY, "result_set", F.lit("run").alias("run_id"), "sample", "energy")
    return checkpoints, finals


@query("r4_verify_checkpoints", f"""
WITH {_CUTS},
s AS (SELECT *, 'results' AS result_set, sample_id AS n FROM f UNION ALL SELECT *, 'results_1', (sample_id + 3) % 4 FROM f)
SELECT batch, result_set, instance_id, CAST(n + 1 AS BIGINT) AS idx, e AS recomputed_energy,
       NOT (CAST(instance_id AS BIGINT) % 5 = 0 AND sample_id = 2 AND 1 > 1e-5*greatest(1, abs(e), abs(e + 1))) AS passed FROM s""")
def r4(v):
    batch = _model(v)
    checkpoints, finals = _run_checkpoints(v)
    return R.verify_checkpoints(checkpoints, finals, batch)[0].select(
        *KEY, "result_set", "idx", "recomputed_energy", "passed")


@query("r4_final_checkpoint_issues", f"""
WITH a AS (SELECT batch, instance_id, sample_id, array_agg(x ORDER BY i) AS s FROM {{route_samples}} GROUP BY ALL)
SELECT p.batch, result_set, p.instance_id, 'run' AS run_id, 'final_checkpoint_differs' AS code
FROM a p JOIN a q ON q.instance_id = p.instance_id
JOIN (VALUES ('results', 0, 3), ('results_1', 1, 0)) t(result_set, claimed, last)
  ON p.sample_id = claimed AND q.sample_id = last
WHERE CAST(p.instance_id AS BIGINT) % 3 = 0 AND p.s <> q.s""")
def r4_final(v):
    batch = _model(v)
    checkpoints, finals = _run_checkpoints(v)
    return R.verify_checkpoints(checkpoints, finals, batch)[1]


@query("r5_incumbent_by_reads", """
WITH c AS (SELECT *, coalesce(sum(occurrences) OVER (PARTITION BY result_set, instance_id, run_id ORDER BY position
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {reads}),
t AS (SELECT *, unnest(generate_series(CAST(1 AS BIGINT), k)) AS idx FROM {read_runs}),
g AS (SELECT *, CAST((idx*num_reads + k - 1)//k AS BIGINT) AS target FROM t)
SELECT g.batch, g.result_set, g.instance_id, g.run_id, g.idx, g.target, min(c.energy) AS energy,
       arg_min(c.position, (c.energy, c.position)) FILTER (c.energy IS NOT NULL) AS position
FROM g JOIN c ON c.instance_id = g.instance_id AND c.run_id = g.run_id AND c.result_set = g.result_set
  AND c.before < g.target GROUP BY ALL""")
def r5(v):
    return R.incumbent_by_reads(v.reads, v.read_runs)


# Improvement events: progress in eighths of a day since the month began, so targets are hit exactly.
_EVENTS = """
SELECT 'events' AS batch, CASE WHEN event_id % 2 = 0 THEN 'results' ELSE 'results_1' END AS result_set,
       CAST(user_id AS STRING) AS instance_id, event_type AS run_id, CAST(day(ts)*8 + floor(hour(ts)/3) AS DOUBLE) / 8 AS progress, event_id AS seq,
       -CAST(floor(value) AS DOUBLE) AS energy FROM {events}"""
_EVENT_RUNS = """
SELECT 'events' AS batch, CASE WHEN event_id % 2 = 0 THEN 'results' ELSE 'results_1' END AS result_set,
       CAST(user_id AS STRING) AS instance_id, event_type AS run_id, CAST(16 AS BIGINT) AS k,
       CAST(32 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS initial_energy, min(-CAST(floor(value) AS DOUBLE)) AS final_energy
FROM {events} GROUP BY user_id, event_type, event_id % 2"""


@query("r6_incumbent_asof", f"""
WITH e AS ({_EVENTS}), r AS ({_EVENT_RUNS}),
t AS (SELECT *, unnest(generate_series(CAST(1 AS BIGINT), k)) AS idx FROM r),
g AS (SELECT *, total*idx/k AS target FROM t)
SELECT g.batch, g.result_set, g.instance_id, g.run_id, g.idx, g.target,
  CASE WHEN g.idx = g.k THEN g.final_energy ELSE coalesce(arg_max(e.energy, (e.progress, e.seq)), g.initial_energy) END AS energy
FROM g LEFT JOIN e ON e.instance_id = g.instance_id AND e.run_id = g.run_id AND e.result_set = g.result_set AND e.progress < g.target
GROUP BY g.batch, g.result_set, g.instance_id, g.run_id, g.idx, g.target, g.k, g.final_energy, g.initial_energy""")
def r6(v):
    return R.incumbent_asof(v.sql(_EVENTS), v.sql(_EVENT_RUNS))


@query("r7_target_plan", """
WITH p AS (SELECT o_orderkey AS run, CAST(o_orderkey % 4 + 1 AS BIGINT) AS k,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 50 AS DOUBLE) END AS time_limit,
  CASE WHEN o_orderstatus = 'O' THEN o_custkey % 20 END AS node_limit FROM orders),
u AS (SELECT *, CASE WHEN time_limit > 0 THEN 'seconds' WHEN node_limit > 0 THEN 'branch_and_bound_nodes' END AS unit,
  CASE WHEN time_limit > 0 THEN time_limit ELSE CAST(node_limit AS DOUBLE) END AS total FROM p),
c AS (SELECT *, CASE WHEN unit IS NULL THEN 'no_budget' WHEN unit <> 'seconds' AND k > total THEN 'more_checkpoints_than_work' END AS code FROM u)
SELECT run, unit, code, idx, CASE WHEN unit = 'seconds' THEN total*idx/k ELSE CAST(ceil(idx*total/k) AS DOUBLE) END AS target
FROM c, LATERAL (SELECT unnest(generate_series(CAST(1 AS BIGINT), k)) AS idx) i WHERE code IS NULL
UNION ALL SELECT run, unit, code, NULL, NULL FROM c WHERE code IS NOT NULL""")
def r7(v):
    status = F.col("o_orderstatus")
    params = v.orders.select(
        F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 4 + 1).alias("k"),
        F.when(status == "F", (F.col("o_custkey") % 50).cast("double")).alias("time_limit"),
        F.when(status == "O", F.col("o_custkey") % 20).alias("node_limit"))
    return target_plan(params).select("run", "unit", "code", "idx", "target")


_TRAJECTORY = """
SELECT batch, result_set, instance_id, run_id, k AS checkpoint, k/3.0::DOUBLE*100 AS progress,
  CASE WHEN (position + k) % 4 <> 0 THEN energy + 3.0 - k END AS energy,
  wall_seconds*k/3.0::DOUBLE AS elapsed, CAST(k AS DOUBLE) AS target, 'states' AS unit
FROM {reruns}, LATERAL (SELECT unnest(generate_series(CAST(1 AS BIGINT), CAST(3 AS BIGINT))) AS k) s WHERE position % 6 <> 0
UNION ALL SELECT batch, result_set, instance_id, run_id, NULL, NULL, NULL, NULL, NULL, NULL FROM {reruns} WHERE position % 6 = 0"""


@query("r8_trajectory", f"""
SELECT batch, result_set, instance_id, run_id, checkpoint, round(progress, 6) AS progress, energy, round(elapsed, 6) AS elapsed, target, unit
FROM ({_TRAJECTORY}) t""")
def r8(v):
    return R.trajectory(R.normalize_results(_record_rows(v, v.reruns))).withColumn(
        "progress", F.round("progress", 6)).withColumn("elapsed", F.round("elapsed", 6))


@query("r9_metrics_json", """
SELECT batch, instance_id, run_id, '@"reads":"10"}' AS solver_metrics FROM {runs}""")
def r9(v):
    return R.metrics_json(R.normalize_results(_record_rows(v))).select(
        *KEY, "run_id", "solver_metrics")
