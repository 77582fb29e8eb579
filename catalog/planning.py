"""Experiment planning (P-1 .. P-9, U-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.plans import experiments as P
from bitloom.plans.registry import list_families
from bitloom.schemas import KEY
from catalog.base import query

# Solver entries of an experiment: one per market segment, its replicas by customer count.
SOLVERS = """
SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS entry, lower(c_mktsegment) AS solver_type,
       concat(lower(c_mktsegment), '_run') AS instance_name, CAST(count(*) % 3 + 1 AS BIGINT) AS replicas,
       count(*) % 2 = 0 AS increment_seed, true AS has_seed, CAST(7 AS BIGINT) AS default_seed
FROM {customer} GROUP BY c_mktsegment"""

_REPLICAS = f"""
SELECT s.*, replica, CASE WHEN replicas = 1 THEN instance_name
  ELSE concat(instance_name, '_replica_', CAST(replica AS VARCHAR)) END AS run_name
FROM ({SOLVERS}) s, LATERAL (SELECT unnest(generate_series(CAST(1 AS BIGINT), replicas)) AS replica) r"""


def solvers(v):
    return v.sql(SOLVERS).withColumn("parameters", F.create_map(
        F.lit("sweeps"), F.lit("100"), F.lit("num_snapshots"), F.lit("0")))


def problems(v):
    return v.listing.select(
        "batch", "instance_id", "path", "path_dir", "stem",
        F.col("stem").cast("bigint").alias("problem_order"))


_TASKS = f"""
SELECT p.batch, p.instance_id, r.solver_type, r.run_name AS instance_name,
  CASE WHEN replicas > 1 AND increment_seed THEN CAST(default_seed + replica - 1 AS VARCHAR) END AS seed,
  concat(p.batch, '/results/', p.stem, '--', r.run_name, '.json') AS output_path
FROM {{listing}} p, ({_REPLICAS}) r"""


@query("p1_plan_tasks", _TASKS)
def p1(v):
    tasks = P.plan_tasks(problems(v), solvers(v))
    return tasks.select(*KEY, "solver_type", "instance_name",
                        F.col("parameters")["seed"].alias("seed"), "output_path")


@query("p2_run_names", f"""
SELECT solver_type, replica, run_name, false AS repeated FROM ({_REPLICAS}) r""")
def p2(v):
    named = P.run_names(solvers(v))
    repeated = P.run_name_issues(solvers(v)).select("run_name", F.lit(True).alias("hit"))
    return named.join(repeated, "run_name", "left").select(
        "solver_type", "replica", "run_name", F.col("hit").isNotNull().alias("repeated"))


@query("p2_run_name_issues", """
WITH s AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY ALL)
SELECT 'invalid_replicas' AS code, name AS run_name FROM s WHERE n % 4 = 0
UNION ALL SELECT 'unsafe_instance_name', 'a/' || name FROM s WHERE n % 5 = 0 AND n % 4 <> 0
UNION ALL SELECT 'duplicate_run_name', 'same_' || CAST(n % 4 AS VARCHAR) FROM s
WHERE n % 4 <> 0 AND n % 5 <> 0 GROUP BY n % 4 HAVING count(*) > 1""")
def p2_issues(v):
    n = F.col("n")
    rows = v.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    # by part count: replicas of 0, unsafe names, or a shared name
    entries = rows.select(
        F.lit("s").alias("solver_type"),
        F.when(n % 4 == 0, F.col("p_brand")).when(n % 5 == 0, F.concat(F.lit("a/"), "p_brand"))
        .otherwise(F.concat(F.lit("same_"), (n % 4).cast("string"))).alias("instance_name"),
        F.when(n % 4 == 0, 0).otherwise(1).alias("replicas"))
    return P.run_name_issues(entries)


@query("p3_seed_increments", f"""
SELECT solver_type, instance_name, seed, count(*) AS tasks FROM ({_TASKS}) t GROUP BY ALL""")
def p3(v):
    tasks = P.plan_tasks(problems(v), solvers(v))
    return tasks.groupBy("solver_type", "instance_name",
                         F.col("parameters")["seed"].alias("seed")).agg(F.count("*").alias("tasks"))


@query("p4_order_tasks", f"""
SELECT batch, instance_id, instance_name, row_number() OVER (ORDER BY entry, ord, replica) - 1 AS queue_position FROM (
  SELECT p.batch, p.instance_id, r.run_name AS instance_name, r.entry, r.replica, CAST(p.stem AS BIGINT) AS ord
  FROM {{listing}} p, ({_REPLICAS}) r) t""")
def p4(v):
    from bitloom.operators.terms import index_variables

    tasks = P.plan_tasks(problems(v), solvers(v), order="solver_first")
    ordered = P.order_tasks(tasks).select(*KEY, "instance_name", "order_key.*")
    return index_variables(
        ordered.withColumn("all", F.lit(0)), ["entry", "problem_order", "replica"], ["all"],
        "queue_position").select(*KEY, "instance_name", "queue_position")


@query("p4_limit_problems", """
SELECT path, k AS problem_order FROM (
  SELECT path, row_number() OVER (ORDER BY path) - 1 AS k FROM {listing}) t WHERE k < 50""")
def p4_limit(v):
    return P.limit_problems(v.listing.select("path"), 50).select("path", "problem_order")


# Existing files: result sets of a batch hold some of the planned files.
_EXISTING = """
SELECT c_mktsegment AS batch, CASE WHEN c_custkey % 3 = 0 THEN 'results' ELSE concat('results_', CAST(c_nationkey + 1 AS STRING)) END AS result_set,
       concat(CAST(c_custkey AS STRING), '--run.json') AS file
FROM {customer} WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey <> 4"""


@query("p5_result_sets", f"""
WITH e AS ({_EXISTING}),
t AS (SELECT DISTINCT batch FROM {{listing}}),
hit AS (SELECT DISTINCT l.batch FROM {{listing}} l JOIN e ON e.batch = l.batch AND e.result_set = 'results'
        AND e.file = concat(l.stem, '--run.json')),
n AS (SELECT DISTINCT batch, TRY_CAST(substring(result_set, 9) AS BIGINT) AS n FROM e WHERE result_set LIKE 'results_%'),
f AS (SELECT h.batch, min(r.k) AS k FROM hit h, range(1, 200) r(k)
      WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.batch = h.batch AND n.n = r.k) GROUP BY ALL)
SELECT t.batch, CASE WHEN f.k IS NULL THEN 'results' ELSE concat('results_', CAST(f.k AS VARCHAR)) END AS result_set
FROM t LEFT JOIN f USING (batch)""")
def p5(v):
    targets = v.listing.select("batch", F.concat("stem", F.lit("--run.json")).alias("file"))
    return P.result_sets(targets, v.sql(_EXISTING))


@query("p6_batch_names", """
SELECT c_custkey AS entry, name, NOT (name LIKE '%/%' OR name LIKE '%:%' OR name IN ('.', '..')) AS is_safe FROM (
  SELECT c_custkey, trim(coalesce(given, CASE WHEN n IS NULL THEN t ELSE concat(t, '_', CAST(n AS VARCHAR), '_', d) END)) AS name
  FROM (SELECT c_custkey, lower(c_mktsegment) AS t,
    CASE c_custkey % 5 WHEN 0 THEN concat(' ', c_name, ' ') WHEN 1 THEN concat('a/', c_name) WHEN 2 THEN '..' END AS given,
    CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey*10 END AS n,
    CASE c_nationkey % 4 WHEN 0 THEN '0.25' WHEN 1 THEN '0.01' WHEN 2 THEN '1' ELSE '0.0125' END AS d FROM customer) x) y""")
def p6(v):
    k, nation = F.col("c_custkey") % 5, F.col("c_nationkey")
    density = F.when(nation % 4 == 0, 0.25).when(nation % 4 == 1, 0.01).when(
        nation % 4 == 2, 1.0).otherwise(0.0125)
    entries = v.customer.select(
        F.col("c_custkey").alias("entry"), F.lower("c_mktsegment").alias("type"),
        F.when(k == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).when(
            k == 1, F.concat(F.lit("a/"), "c_name")).when(k == 2, F.lit("..")).alias("batch_name"),
        F.when(nation % 2 == 0, nation * 10).alias("num_variables"),
        density.alias("quadratic_density"))
    return P.batch_names(entries).select("entry", "name", "is_safe")


_WORK = """SELECT l_orderkey AS run, max(l_linenumber) AS k, CAST(sum(l_quantity) AS BIGINT) % 40 AS total
FROM {lineitem} GROUP BY l_orderkey"""


def _work(v):
    return v.sql(_WORK).select("run", F.col("k").cast("bigint").alias("k"), "total")


@query("p7_targets", f"""
SELECT run, CAST(k AS BIGINT) AS k, total, idx, CAST((idx*total + k - 1)//k AS BIGINT) AS target
FROM ({_WORK}) w, LATERAL (SELECT unnest(generate_series(CAST(1 AS BIGINT), CAST(k AS BIGINT))) AS idx) i
WHERE total >= 1 AND k <= total""")
def p7(v):
    return P.targets(_work(v))


@query("p7_target_issues", f"""
SELECT run, CAST(k AS BIGINT) AS k, total, CASE WHEN total < 1 THEN 'no_work_units' ELSE 'more_checkpoints_than_work' END AS code
FROM ({_WORK}) w WHERE total < 1 OR k > total""")
def p7_issues(v):
    return P.target_issues(_work(v))


@query("p8_run_ids", """
SELECT position, concat(solver_type, '-', substring(sha256(concat(
  '{"instance_id":"', instance_id, '","parameters":"', replace('{"sweeps":"' || CAST(position % 7 AS VARCHAR) || '"}', '"', '\\"'),
  '","solver_instance_name":"', result_set, '","solver_type":"', solver_type, '"}')), 1, 16)) AS run_id
FROM {runs}""".replace('{"instance', '@"instance').replace("{\"sweeps", "@\"sweeps"))
def p8(v):
    runs = v.runs.select(
        "instance_id", "solver_type", F.col("result_set").alias("instance_name"), "position",
        F.create_map(F.lit("sweeps"), (F.col("position") % 7).cast("string"),
                     F.lit("num_snapshots"), F.lit("0")).alias("parameters"))
    return P.run_ids(runs).select("position", "run_id")


_OUTCOMES = f"""
WITH t AS ({_TASKS}),
o AS (SELECT *, CASE CAST(substring(instance_id, 6) AS BIGINT) % 4 WHEN 0 THEN 'saved' WHEN 1 THEN 'failed' ELSE 'pending' END AS outcome FROM t)
"""


def _report(v):
    tasks = P.plan_tasks(problems(v), solvers(v))
    kind = F.substring_index("instance_id", "_", -1).cast("bigint") % 4
    saved = tasks.where(kind == 0).select("output_path")
    failures = tasks.where(kind == 1).select("output_path", F.lit("out of time").alias("message"))
    return P.task_report(tasks.select(*KEY, "instance_name", "output_path"), saved, failures)


@query("p9_task_report", _OUTCOMES + """
SELECT batch, instance_id, instance_name, output_path, outcome,
       CASE WHEN outcome = 'failed' THEN 'out of time' END AS message FROM o""")
def p9(v):
    return _report(v)[0]


@query("p9_task_counts", _OUTCOMES + "SELECT batch, outcome, count(*) AS tasks FROM o GROUP BY ALL")
def p9_counts(v):
    return _report(v)[1]


@query("u1_families_by_segment", """
SELECT s.n AS families, c.batch, c.problems FROM (SELECT CAST(10 AS BIGINT) AS n) s,
(SELECT batch, count(*) AS problems FROM {listing} GROUP BY ALL) c""")
def u1(v):
    families = list_families(v.spark).agg(F.count("*").alias("families"))
    per = v.listing.groupBy("batch").agg(F.count("*").alias("problems"))
    return per.join(families)
