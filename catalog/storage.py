"""Sources, sinks and streams (S-1 .. S-12, W-1, W-2): round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bitloom.functions.stats import melt
from bitloom.operators import encoders as E
from bitloom.operators import validation as C
from bitloom.operators.analytics import labelled
from bitloom.operators.families import cut_facts
from bitloom.schemas import KEY, Batch
from bitloom.session import shared_folder
from bitloom.sources import files, manifests, tables
from bitloom.streaming import results as W
from catalog.base import query
from catalog.comparison import LEADERBOARD
from catalog.encoders import ROUTE_SIZES, SIZES, stack, terms_sql
from catalog.runs import records


def _folder(v) -> str:
    return f"{shared_folder(v.spark)}/{uuid.uuid4().hex}"


_CUT = """
SELECT batch, instance_id, 'linear' AS kind, u AS i, CAST(-1 AS BIGINT) AS j, -w AS v FROM {%s}
UNION ALL SELECT batch, instance_id, 'linear', v, -1, -w FROM {%s}
UNION ALL SELECT batch, instance_id, 'quadratic', u, v, 2*w FROM {%s}"""


@query("s1_s6_write_and_read_batch", terms_sql(_CUT.replace("%s", "edges"), SIZES))
def s1(v):
    v.keep("edges")
    path = _folder(v)
    tables.write_batch(E.encode_max_cut(v.edges, v.sizes), path)
    return stack(tables.read_batch(v.spark, path, ["trade"]))


def _problem_documents(v):
    """One problem document per season; odd years lack their validation record."""
    v.keep("season_edges")
    batch = E.encode_max_cut(v.season_edges, v.season_sizes)
    # at most 12 variables and 66 pairs per document
    linear = batch.linear.groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.array(F.col("i").cast("double"), "v"))).alias("linear"))
    quadratic = batch.quadratic.groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.array(F.col("i").cast("double"), F.col("j").cast("double"), "v"))).alias("quadratic"))
    return batch.instances.join(linear, KEY).join(quadratic, KEY).select(
        F.lit(3).alias("schema_version"), "instance_id", "problem_type",
        F.col("problem_type").alias("problem_name"), F.col("instance_id").cast("bigint").alias("seed"),
        F.struct("num_variables", "offset", "linear", "quadratic").alias("qubo"),
        F.when(F.col("instance_id").cast("bigint") % 2 == 0, F.struct(
            F.lit("passed").alias("status"))).alias("validation"),
        F.col("instance_id").alias("year"))


def _write_documents(v) -> str:
    root = _folder(v)
    docs = _problem_documents(v)
    docs.repartition("year").write.partitionBy("year").json(f"{root}/season/qubos")
    return root


@query("s2_read_problem_json", terms_sql(
    f"SELECT * FROM ({_CUT.replace('%s', 'season_edges')}) c WHERE CAST(instance_id AS BIGINT) % 2 = 0",
    "SELECT batch, instance_id, num_variables AS n FROM {season_sizes} WHERE CAST(instance_id AS BIGINT) % 2 = 0"))
def s2(v):
    return stack(files.read_problem_json(v.spark, f"{_write_documents(v)}/season/qubos")[0])


@query("s2_problem_json_errors", """
SELECT instance_id AS year, 'missing_validation' AS code FROM {season_sizes} WHERE CAST(instance_id AS BIGINT) % 2 = 1""")
def s2_errors(v):
    bad = files.read_problem_json(v.spark, f"{_write_documents(v)}/season/qubos")[1]
    return bad.select(F.regexp_extract("path", r"year=(\d+)", 1).alias("year"), "code")


@query("s5_discover", "SELECT batch, concat('year=', instance_id) AS path_dir FROM {season_sizes}")
def s5(v):
    return files.discover(v.spark, _write_documents(v))[0].select("batch", "path_dir")


_RUN_ROWS = """SELECT instance_id, run_id, solver_type, status, CAST(energy AS STRING) AS energy,
  CASE WHEN position % 9 = 0 THEN 'n/a, "unknown"' ELSE CAST(wall_seconds AS STRING) END AS wall_seconds, file FROM {runs}"""


@query("s3_read_manifest", """
SELECT 'events' AS batch, result_set AS folder, instance_id, run_id, energy,
       CASE WHEN position % 9 = 0 THEN NULL ELSE wall_seconds END AS wall_seconds FROM {runs}""")
def s3(v):
    root = _folder(v)
    rows = v.runs.withColumn("wall_seconds", F.when(
        F.col("position") % 9 == 0, 'n/a, "unknown"').otherwise(F.col("wall_seconds").cast("string")))
    paths = []
    for name in ("results", "results_1"):
        paths.append(f"{root}/events/{name}")
        rows.where(F.col("result_set") == name).select(
            "instance_id", "run_id", "energy", "wall_seconds").write.option(
            "header", "true").option("escape", '"').csv(paths[-1])
    return files.read_manifest(v.spark, paths).select(
        "batch", "folder", "instance_id", "run_id", "energy", "wall_seconds")


_RECORDS = """
SELECT batch, result_set, instance_id, run_id, status, energy, energy + CASE WHEN position % 10 = 0 THEN 2.0 ELSE 0.0 END AS reported_energy,
       wall_seconds, CAST(CASE WHEN position % 6 = 0 THEN 0 ELSE 3 END AS BIGINT) AS snapshots FROM {runs}"""


@query("s4_s12_write_and_read_results", _RECORDS)
def s4(v):
    path = _folder(v)
    tables.write_results(records(v), path)
    back = files.read_results(v.spark, path, multi_line=False)
    size = F.size("snapshots")
    return back.select(
        "batch", "result_set", "instance_id", "run_id", "status", "solution.energy",
        "verification.reported_energy", "timing.wall_seconds",
        F.when(size > 0, size).otherwise(0).cast("bigint").alias("snapshots"))


@query("s7_passed_only", terms_sql(
    f"""SELECT * FROM ({_CUT.replace('%s', 'route_edges')}) c WHERE instance_id NOT IN
        (SELECT instance_id FROM {{route_edges}} WHERE w > 4)""",
    f"SELECT * FROM ({ROUTE_SIZES}) s WHERE instance_id NOT IN (SELECT instance_id FROM {{route_edges}} WHERE w > 4)"))
def s7(v):
    v.keep("route_edges")
    heavy = v.route_edges.where("w > 4").select(
        *KEY, F.lit("error").alias("severity"), F.lit("cut_weight_out_of_range").alias("code"))
    return stack(tables.passed_only(E.encode_max_cut(v.route_edges, v.route_sizes), heavy))


@query("s8_upsert_problem_manifest", """
WITH o AS (SELECT c_custkey, 'old' AS status, c_name AS note FROM customer WHERE c_custkey % 3 <> 0)
SELECT 'm' AS batch, CAST(c.c_custkey AS VARCHAR) AS instance_id,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS validation_status,
       CASE WHEN c.c_custkey % 2 <> 0 THEN c.c_name END AS "parameter.note",
       CASE WHEN c.c_custkey % 2 = 0 THEN c.c_acctbal - 1 END AS "stat.balance"
FROM customer c WHERE c.c_custkey % 3 <> 0 OR c.c_custkey % 2 = 0""")
def s8(v):
    key = F.col("c_custkey")
    ids = [F.lit("m").alias("batch"), key.cast("string").alias("instance_id")]
    old = v.customer.where(key % 3 != 0).select(
        *ids, F.lit("old").alias("validation_status"), F.col("c_name").alias("parameter.note"))
    new = v.customer.where(key % 2 == 0).select(
        *ids, F.lit("new").alias("validation_status"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("row"), F.col("c_acctbal")).select(
        *[c for c in ("batch", "instance_id", "validation_status", "row")],
        (F.col("c_acctbal") + 1 - F.col("row")).alias("stat.balance"))  # the later row is the lower one
    return manifests.upsert_problem_manifest(old, new, "row")


@query("s9_upsert_results_manifest", """
WITH o AS (SELECT *, energy AS e FROM {runs} WHERE position % 3 <> 0),
n AS (SELECT *, energy - 2 AS e FROM {runs} WHERE position % 2 = 0)
SELECT batch, result_set, run_id, instance_id, solver_type, e AS energy FROM n
UNION ALL SELECT batch, result_set, run_id, instance_id, solver_type, e FROM o WHERE position % 2 <> 0""")
def s9(v):
    old = v.runs.where("position % 3 <> 0").drop("position")
    new = v.runs.where("position % 2 = 0").withColumn("row", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "energy", F.col("energy") - F.col("row")).drop("position")  # the later row is the lower one
    return manifests.upsert_results_manifest(old, new, "row").select(
        "batch", "result_set", "run_id", "instance_id", "solver_type", "energy")


@query("s10_problem_manifest", """
WITH e AS (SELECT batch, instance_id, count(*) AS m, sum(w) AS w, max(w) AS top, min(w) AS low FROM {route_edges} GROUP BY ALL),
l AS (SELECT instance_id, count(DISTINCT u) AS k FROM (
  SELECT instance_id, u FROM {route_edges} UNION SELECT instance_id, v FROM {route_edges}) t GROUP BY ALL)
SELECT batch, instance_id, 'max_cut' AS problem_type, concat(instance_id, '.qubo') AS file, num_variables,
  coalesce(k, 0) AS linear_terms, coalesce(m, 0) AS quadratic_terms,
  CASE WHEN top > 6 THEN 'failed' ELSE 'passed' END AS validation_status,
  CASE WHEN m > 26 THEN 'complete_conflict_graph;isolated_vertices' ELSE '' END AS warning_codes,
  CASE WHEN top > 6 THEN 'cut_weight_out_of_range' ELSE '' END AS error_codes,
  '12' AS "parameter.num_vertices", w AS "stat.total_edge_weight"
FROM {route_sizes} s LEFT JOIN e USING (batch, instance_id) LEFT JOIN l USING (instance_id)""")
def s10(v):
    from bitloom.operators.families import cut_issues

    v.keep("route_edges")
    batch = E.encode_max_cut(v.route_edges, v.route_sizes)
    described = Batch(batch.instances.withColumn("seed", F.lit(1).cast("bigint")).withColumn(
        "problem_name", F.lit(None).cast("string")).withColumn(
        "parameters", F.create_map(F.lit("num_vertices"), F.lit("12"))),
        batch.linear, batch.quadratic)
    params = v.route_sizes.select(*KEY, F.lit(True).alias("weighted"),
                                  F.lit(1).alias("min_edge_weight"), F.lit(6).alias("max_edge_weight"))
    many = v.route_edges.groupBy(*KEY).agg(F.count("*").alias("m")).where("m > 26")
    warned = C.issues(many, [("isolated_vertices", F.lit(1)), ("complete_conflict_graph", F.lit(1))],
                      "warning")
    issues = cut_issues(v.route_edges, params).unionByName(warned)
    return manifests.problem_manifest(
        described, issues, melt(cut_facts(v.route_edges)), ["num_vertices"],
        ["total_edge_weight"]).drop("problem_name", "seed")


@query("s11_results_manifest", _RECORDS.replace("FROM {runs}", ", file, position % 10 <> 0 AS energy_check_passed FROM {runs}"))
def s11(v):
    return manifests.results_manifest(records(v)).select(
        "batch", "result_set", "instance_id", "run_id", "status", "energy", "reported_energy",
        "wall_seconds", "snapshots", "file", "energy_check_passed")


@query("w1_stream_results", _RECORDS)
def w1(v):
    path = _folder(v)
    tables.write_results(records(v), f"{path}/records")
    W.stream_results(v.spark, f"{path}/records", f"{path}/log", f"{path}/state").awaitTermination()
    return W.current_manifest(v.spark, f"{path}/log").select(
        "batch", "result_set", "instance_id", "run_id", "status", "energy", "reported_energy",
        "wall_seconds", "snapshots")


@query("w2_stream_incumbent", """
SELECT batch, instance_id, solver_type AS solver, min(e) AS energy, arg_min(run_id, (e, run_id)) FILTER (e IS NOT NULL) AS run_id
FROM (SELECT *, CASE WHEN position % 5 <> 0 THEN energy END AS e FROM {runs}) r GROUP BY ALL""")
def w2(v):
    path = _folder(v)
    energy = F.when(F.col("position") % 5 != 0, F.col("energy"))
    rows = v.runs.select(*KEY, F.col("solver_type").alias("solver"), energy.alias("energy"), "run_id")
    rows.write.parquet(f"{path}/runs")
    stream = v.spark.readStream.schema(rows.schema).parquet(f"{path}/runs")
    W.write_incumbents(stream, f"{path}/log", f"{path}/state").awaitTermination()
    return W.current_incumbents(v.spark, f"{path}/log")


@query("w1_live_leaderboard", LEADERBOARD)
def w1_board(v):
    """Drafts of some runs, a snapshot, then all runs rewritten and the drafts once more: the newest versions count."""
    path = _folder(v)
    columns = ["batch", "result_set", "instance_id", "solver", "run_id", "energy", "wall_seconds"]
    final = labelled(v.runs).select(*columns, "position").withColumn("version", F.lit(2))
    drafts = final.where("position % 3 <> 0").withColumns({"energy": F.col("energy") - 5, "version": F.lit(1)})

    def run(*parts):
        for part in parts:
            part.drop("position").write.mode("append").parquet(f"{path}/runs")
        stream = v.spark.readStream.schema(final.drop("position").schema).option("maxFilesPerTrigger", 16).parquet(f"{path}/runs")
        W.stream_leaderboard(stream, f"{path}/log", f"{path}/state").awaitTermination()

    run(drafts)
    W.compact(v.spark, f"{path}/log", W.BOARD_KEYS)
    run(final, drafts)
    return W.current_leaderboard(v.spark, f"{path}/log").withColumns(
        {"mean_gap": F.round("mean_gap", 6), "mean_time": F.round("mean_time", 6)})
