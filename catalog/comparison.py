"""Batch analytics (A-1 .. A-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import analytics as A
from bitloom.operators import encoders as E
from bitloom.operators.results import normalize_results, trajectory
from bitloom.schemas import KEY
from catalog.base import query
from catalog.runs import _TRAJECTORY, _record_rows

_LABEL = """CASE WHEN position('--' IN file) > 0
  THEN replace(substring(file, position('--' IN file) + 2), '.json', '') ELSE solver_type END"""
_L = f"SELECT *, {_LABEL} AS solver FROM {{runs}}"
LABELS = [f"{t}_replica_{k}" for t in ("click", "error", "purchase", "signup", "view")
          for k in (1, 2, 3)] + ["click", "error", "purchase", "signup", "view"]


@query("a1_solver_label", f"SELECT run_id, solver FROM ({_L}) l")
def a1(v):
    return A.labelled(v.runs).select("run_id", "solver")


@query("a2_solvers", f"SELECT DISTINCT batch, result_set, solver FROM ({_L}) l")
def a2(v):
    return A.solvers(v.runs)


@query("a3_visible", f"SELECT run_id, solver FROM ({_L}) l WHERE solver = 'view_replica_2'")
def a3(v):
    return A.visible(v.runs, "view_replica_2").select("run_id", "solver")


@query("a4_energy_matrix", f"""
SELECT batch, result_set, instance_id, {', '.join(
    f"arg_max(energy, position) FILTER (WHERE solver = '{s}') AS {s}" for s in LABELS)}
FROM ({_L}) l GROUP BY batch, result_set, instance_id""")
def a4(v):
    return A.energy_matrix(v.runs, LABELS)


@query("a5_mean_runtime", f"""
SELECT batch, result_set, solver, round(avg(wall_seconds), 6) AS seconds FROM ({_L}) l GROUP BY ALL""")
def a5(v):
    return A.mean_runtime(v.runs).withColumn("seconds", F.round("seconds", 6))


_BEST = f"""
l AS ({_L}), b AS (SELECT batch, result_set, instance_id, min(energy) AS best FROM l GROUP BY ALL),
d AS (SELECT l.*, best, energy - best AS gap FROM l JOIN b USING (batch, result_set, instance_id))"""


LEADERBOARD = f"""
WITH {_BEST},
s AS (SELECT batch, result_set, solver, count(*) FILTER (WHERE abs(gap) < 1e-9) AS wins, avg(gap) AS g, avg(wall_seconds) AS t
      FROM d GROUP BY ALL)
SELECT batch, result_set, solver, wins, round(g, 6) AS mean_gap, round(t, 6) AS mean_time,
       CAST(row_number() OVER (PARTITION BY batch, result_set ORDER BY wins DESC, g, solver) AS INTEGER) AS rank FROM s"""


@query("a6_leaderboard", LEADERBOARD)
def a6(v):
    return A.leaderboard(v.runs).withColumn("mean_gap", F.round("mean_gap", 6)).withColumn(
        "mean_time", F.round("mean_time", 6))


@query("a7_histogram", """
WITH t AS (SELECT batch, instance_id, 2*w AS v FROM {edges}
           UNION ALL SELECT batch, instance_id, -sum(w) FROM (
             SELECT batch, instance_id, u, w FROM {edges} UNION ALL SELECT batch, instance_id, v, w FROM {edges}) e
           GROUP BY batch, instance_id, u),
r AS (SELECT batch, instance_id, min(v) AS lo, CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1.0 END/12 AS width FROM t GROUP BY ALL),
c AS (SELECT instance_id, least(11, CAST(floor((v - lo)/width) AS BIGINT)) AS bin, count(*) AS n FROM t JOIN r USING (instance_id) GROUP BY ALL)
SELECT r.batch, r.instance_id, k.bin, round(lo + k.bin*width, 6) AS low, coalesce(c.n, 0) AS count
FROM r CROSS JOIN range(0, 12) k(bin) LEFT JOIN c ON c.instance_id = r.instance_id AND c.bin = k.bin""")
def a7(v):
    v.keep("edges")
    return A.histogram(E.encode_max_cut(v.edges, v.sizes)).withColumn("low", F.round("low", 6))


_MANIFEST = """
SELECT 'events' AS batch, CAST(user_id AS STRING) AS instance_id, 100 + max(event_id) % 50 AS num_variables,
       count(*) AS quadratic_terms, CAST(max(event_id) % 4 AS DOUBLE) / 4 AS density FROM {events} GROUP BY user_id"""


@query("a8_batch_summary", f"""
WITH l AS ({_L})
SELECT 'events' AS batch, (SELECT count(DISTINCT user_id) FROM events) AS problems, count(DISTINCT result_set) AS result_sets,
  'results_1' AS active_set, count(*) FILTER (WHERE result_set = 'results_1') AS solutions,
  count(DISTINCT solver) FILTER (WHERE result_set = 'results_1') AS solvers,
  min(energy) FILTER (WHERE result_set = 'results_1') AS best_energy FROM l""")
def a8(v):
    return A.batch_summary(v.sql(_MANIFEST), v.runs)


@query("a9_composition", """
SELECT batch, instance_id, sample_id, count(*) FILTER (WHERE x = 1) AS ones, count(*) FILTER (WHERE x = 0) AS zeros,
       round(count(*) FILTER (WHERE x = 1)/count(*), 9) AS share FROM {samples} GROUP BY ALL""")
def a9(v):
    v.keep("edges")
    return A.composition(v.samples).withColumn("share", F.round("share", 9))


@query("a10_incumbents", f"""
SELECT batch, result_set, instance_id, run_id, count(energy) AS incumbents FROM ({_TRAJECTORY}) t GROUP BY ALL""")
def a10(v):
    return A.incumbents(trajectory(normalize_results(_record_rows(v, v.reruns))))


_SETS = """
SELECT DISTINCT c_mktsegment AS batch, CASE WHEN c_nationkey = 0 THEN 'results' WHEN c_nationkey % 3 = 0 THEN concat('results_', CAST(c_nationkey AS STRING))
  WHEN c_nationkey % 3 = 1 THEN concat('results(', CAST(c_nationkey AS STRING), ')') ELSE concat('resultsX', CAST(c_nationkey AS STRING)) END AS result_set
FROM {customer}"""


@query("a11_result_sets_listing", f"""
WITH s AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(result_set, '(\\d+)', 1), '') AS BIGINT), 0) AS number
  FROM ({_SETS}) x WHERE result_set NOT LIKE 'resultsX%')
SELECT batch, result_set, number, number = max(number) OVER (PARTITION BY batch) AS active FROM s""")
def a11(v):
    return A.result_sets_listing(v.sql(_SETS))


@query("a12_problem_detail", """
SELECT e.batch, e.instance_id, s.num_variables, 'quadratic' AS kind, u AS i, v AS j, 2*w AS v
FROM {edges} e JOIN {sizes} s USING (batch, instance_id) WHERE e.instance_id = '1998'
UNION ALL SELECT batch, instance_id, num_variables, 'linear', i, NULL, -sum(w) FROM (
  SELECT batch, instance_id, u AS i, w FROM {edges} UNION ALL SELECT batch, instance_id, v, w FROM {edges}) e
JOIN {sizes} s USING (batch, instance_id) WHERE instance_id = '1998' GROUP BY ALL""")
def a12(v):
    v.keep("edges")
    return A.problem_detail(v.sizes.select(*KEY, "num_variables"),
                            E.encode_max_cut(v.edges, v.sizes), "1998")


@query("a12_result_detail", """
SELECT batch, result_set, instance_id, run_id, file, energy, position % 10 <> 0 AS passed
FROM {reruns}""")
def a12_results(v):
    listed = v.reruns.select(*KEY, "result_set", "run_id", "file", "energy")
    return A.result_detail(listed, normalize_results(_record_rows(v, v.reruns))).select(
        *KEY, "result_set", "run_id", "file", "energy", "verification.passed")


@query("a13_batch_tiles", f"""
SELECT batch, count(*) AS problems, arg_min(num_variables, instance_id) AS num_variables,
       arg_min(quadratic_terms, instance_id) AS quadratic_terms, arg_min(density, instance_id)*100.0 AS requested_density_percent
FROM ({_MANIFEST}) m GROUP BY batch""")
def a13(v):
    manifest = v.sql(_MANIFEST).withColumn(
        "parameter.quadratic_density", F.col("density").cast("string"))
    return A.batch_tiles(manifest)


@query("a14_status_class", """
SELECT run_id, CASE WHEN status IN ('completed', 'optimal') THEN 'good' ELSE 'bad' END AS status_class FROM {runs}""")
def a14(v):
    return A.with_status_class(v.runs).select("run_id", "status_class")


@query("a15_by_cell", f"""
WITH {_BEST}
SELECT m.density, solver, count(*) AS runs, round(avg(gap), 6) AS mean_gap, round(avg(wall_seconds), 6) AS mean_time
FROM d JOIN ({_MANIFEST}) m ON m.instance_id = d.instance_id GROUP BY ALL""")
def a15(v):
    return A.by_cell(v.runs, v.sql(_MANIFEST), ["density"]).withColumn(
        "mean_gap", F.round("mean_gap", 6)).withColumn("mean_time", F.round("mean_time", 6))


@query("a16_quality", f"""
WITH {_BEST},
s AS (SELECT batch, result_set, instance_id, solver, count(*) AS runs, min(gap) AS best_gap, avg(gap) AS g,
        count(*) FILTER (WHERE abs(gap) < 1e-9) AS successes, avg(wall_seconds) AS t FROM d GROUP BY ALL)
SELECT batch, result_set, instance_id, solver, runs, best_gap, round(g, 6) AS mean_gap, successes, round(t, 6) AS mean_time,
  round(successes/runs, 6) AS success_share,
  round(CASE WHEN successes = runs THEN t WHEN successes > 0 THEN t*ln(1 - 0.99)/ln(1 - successes/runs) END, 6) AS time_to_solution
FROM s""")
def a16(v):
    rows = A.quality(v.runs)
    for name in ("mean_gap", "mean_time", "success_share", "time_to_solution"):
        rows = rows.withColumn(name, F.round(name, 6))
    return rows
