"""Planning, results, analytics, storage and streams on small cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from bitloom.functions.labels import solver_label
from bitloom.operators import analytics as A
from bitloom.operators import results as R
from bitloom.operators.encoders import encode_max_cut
from bitloom.plans import experiments as P
from bitloom.plans.registry import family, list_families
from bitloom.sources import files, manifests, tables
from bitloom.streaming import results as W

K = ("a", "x")


def test_targets_round_up(spark):
    df = spark.createDataFrame([(10, 3), (4, 4), (2, 3)], "total long, k long")
    assert sorted((r.total, r.idx, r.target) for r in P.targets(df).collect()) == [
        (4, 1, 1), (4, 2, 2), (4, 3, 3), (4, 4, 4), (10, 1, 4), (10, 2, 7), (10, 3, 10)]
    assert [r.code for r in P.target_issues(df).collect()] == ["more_checkpoints_than_work"]


def test_run_names_and_seeds(spark):
    solvers = spark.createDataFrame(
        [(0, "annealer", "sa", 2, True, True, 5, {"seed": "40"}), (1, "exact", "ex", 1, True, False, None, {"a": "1"})],
        "entry long, solver_type string, instance_name string, replicas long, increment_seed boolean, "
        "has_seed boolean, default_seed long, parameters map<string,string>")
    problems = spark.createDataFrame([("b", "i", "sub", "p", 0)], "batch string, instance_id string, path_dir string, stem string, problem_order long")
    tasks = sorted((r.instance_name, r.parameters.get("seed"), r.output_path) for r in P.plan_tasks(problems, solvers).collect())
    assert tasks == [("ex", None, "b/results/sub/p--ex.json"), ("sa_replica_1", "40", "b/results/sub/p--sa_replica_1.json"),
                     ("sa_replica_2", "41", "b/results/sub/p--sa_replica_2.json")]


def test_every_problem_meets_every_entry_across_blocks(spark):
    n, m = 37, 3 * P.ENTRY_BLOCK + 5
    solvers = spark.range(m).selectExpr(
        "id AS entry", "'exact' AS solver_type", "concat('s', id) AS instance_name", "CAST(1 + id % 2 AS BIGINT) AS replicas",
        "false AS increment_seed", "false AS has_seed", "CAST(NULL AS BIGINT) AS default_seed", "map('a', CAST(id AS STRING)) AS parameters")
    problems = spark.range(n).selectExpr("'b' AS batch", "CAST(id AS STRING) AS instance_id", "'' AS path_dir",
                                         "concat('p', id) AS stem", "id AS problem_order")
    tasks = P.plan_tasks(problems, solvers)
    got = sorted((r.problem_order, r.entry, r.replica, r.parameters["a"]) for r in tasks.collect())
    assert got == [(p, e, k, str(e)) for p in range(n) for e in range(m) for k in range(1, 2 + e % 2)]
    assert "NestedLoop" not in tasks._jdf.queryExecution().toString() and "Cartesian" not in tasks._jdf.queryExecution().toString()
    assert P.plan_tasks(problems, solvers.limit(0)).count() == P.plan_tasks(problems.limit(0), solvers).count() == 0


def test_run_id_ignores_zero_snapshots(spark):
    schema = "instance_id string, solver_type string, instance_name string, parameters map<string,string>"
    rows = [("i", "exact", None, {"b": "1", "a": "2", "num_snapshots": "0"}), ("i", "exact", None, {"a": "2", "b": "1"}),
            ("i", "exact", None, {"a": "2", "b": "1", "num_snapshots": "3"})]
    ids = [r.run_id for r in P.run_ids(spark.createDataFrame(rows, schema)).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("exact-") and len(ids[0]) == 22


def test_incumbents_by_reads(table, rows):
    reads = table([(*K, "r", 0, 2, 5.0), (*K, "r", 1, 1, 3.0), (*K, "r", 2, 3, 3.0), (*K, "r", 3, 2, 1.0)],
                  "run_id string, position long, occurrences long, energy double")
    runs = table([(*K, "r", 8, 4)], "run_id string, num_reads long, k long")
    assert rows(R.incumbent_by_reads(reads, runs), "idx", "target", "energy", "position") == [
        (1, 2, 5.0, 0), (2, 4, 3.0, 1), (3, 6, 3.0, 1), (4, 8, 1.0, 3)]


def test_incumbent_on_a_target_counts_for_the_next(table, rows):
    events = table([(*K, "r", 2.5, 0, -1.0), (*K, "r", 5.0, 1, -2.0), (*K, "r", 9.9, 2, -9.0)],
                   "run_id string, progress double, seq long, energy double")
    runs = table([(*K, "r", 4, 10.0, 0.0, -10.0)],
                 "run_id string, k long, total double, initial_energy double, final_energy double")
    assert rows(R.incumbent_asof(events, runs), "idx", "target", "energy") == [
        (1, 2.5, 0.0), (2, 5.0, -1.0), (3, 7.5, -2.0), (4, 10.0, -10.0)]


def test_checkpoint_gap(table, rows):
    points = table([(*K, "r", 1, 1 / 3, "u", 1.0, 3.0, 0.5, [1, 0], -1.0), (*K, "r", 3, 1.0, "u", 3.0, 3.0, 1.0, [1, 0], -1.0)],
                   "run_id string, idx long, progress double, unit string, value double, total double, elapsed double, "
                   "sample array<int>, reported_energy double")
    runs = table([(*K, "r", 3)], "run_id string, k long")
    assert rows(R.checkpoint_issues(points, runs), "code") == [("wrong_checkpoint_count",)]


def test_verified_results(table, rows):
    batch = encode_max_cut(table([(*K, 0, 1, 2.0)], "u long, v long, w double"))
    runs = table([(*K, "r1", [1, 0], -2.0), (*K, "r2", [1, 1], -2.0), (*K, "r3", [0, 0], None)],
                 "run_id string, sample array<int>, reported_energy double")
    assert rows(R.verify_results(runs, batch), "run_id", "recomputed_energy", "passed") == [
        ("r1", -2.0, True), ("r2", 0.0, False), ("r3", 0.0, True)]


def _results(spark):
    data = [("b", "results", "i1", "s1", -5.0, 1.0, 0), ("b", "results", "i1", "s2", -5.0, 3.0, 1), ("b", "results", "i2", "s1", -1.0, 1.0, 2),
            ("b", "results", "i2", "s2", -4.0, 5.0, 3), ("b", "results", "i2", "s3", None, 2.0, 4), ("b", "results", "i1", "s1", -2.0, 1.0, 5)]
    return spark.createDataFrame(data, "batch string, result_set string, instance_id string, solver_type string, "
                                       "energy double, wall_seconds double, position long").withColumn("file", F.lit("plain.json"))


def test_leaderboard_ties_all_win_and_missing_energy_never(spark):
    board = A.leaderboard(_results(spark)).orderBy("rank").collect()
    assert [(r.solver, r.wins, r.mean_gap) for r in board] == [("s2", 2, 0.0), ("s1", 1, 2.0), ("s3", 0, None)]


def test_matrix_takes_the_later_row(spark):
    got = {r.instance_id: (r.s1, r.s2) for r in A.energy_matrix(_results(spark), ["s1", "s2"]).collect()}
    assert got == {"i1": (-2.0, -5.0), "i2": (-1.0, -4.0)}


@pytest.mark.parametrize("file,kind,label", [
    ("a/b/p--sa_replica_1.json", "t", "sa_replica_1"), ("p--x--y.JSON", "t", "x--y"), ("p.json", "t", "t"), (None, "", "unknown")])
def test_solver_label(spark, file, kind, label):
    df = spark.createDataFrame([(file, kind)], "file string, kind string")
    assert df.select(solver_label(F.col("file"), F.col("kind"))).first()[0] == label


def test_result_sets_in_natural_order(spark):
    df = spark.createDataFrame([("b", n) for n in ("results_2", "results_10", "results", "results(3)", "other")], "batch string, result_set string")
    got = A.result_sets_listing(df).orderBy("number").collect()
    assert [r.result_set for r in got] == ["results", "results_2", "results(3)", "results_10"]
    assert [r.result_set for r in got if r.active] == ["results_10"]


def test_histogram_of_equal_coefficients(table, rows):
    batch = encode_max_cut(table([(*K, 0, 1, 2.0)], "u long, v long, w double"))
    counts = {b: c for b, c in rows(A.histogram(batch), "bin", "count")}
    assert len(counts) == 12 and counts[0] == 2 and counts[11] == 1


def test_upserts_are_idempotent(table):
    old = table([("a", "x", "1"), ("a", "y", "1")], "validation_status string").withColumn("parameter.k", F.lit("v"))
    new = table([("a", "y", "2"), ("a", "z", "2")], "validation_status string")
    once = manifests.upsert_problem_manifest(old, new)
    twice = manifests.upsert_problem_manifest(once, new)
    assert once.columns == twice.columns and once.collect() == twice.collect()
    assert [(r.instance_id, r.validation_status, r["parameter.k"]) for r in once.collect()] == [
        ("x", "1", "v"), ("y", "2", None), ("z", "2", None)]


def test_problem_files(spark, tmp_path):
    good = {"schema_version": 3, "instance_id": "i", "problem_type": "max_cut", "seed": 1, "parameters": {"n": "2"},
            "validation": {"status": "passed"},
            "qubo": {"num_variables": 2, "offset": 0.5, "variable_names": ["p", "q"], "linear": [[0, -1.0]], "quadratic": [[0, 1, 2.0]]}}
    folder = tmp_path / "batch one" / "qubos" / "sub"
    folder.mkdir(parents=True)
    (folder / "good.json").write_text(json.dumps(good, indent=2))
    (folder / "old.json").write_text(json.dumps({**good, "validation": None}, indent=2))
    (folder / "bare.json").write_text(json.dumps({**good, "qubo": None}))
    (folder / "short.json").write_text(json.dumps({**good, "qubo": {**good["qubo"], "linear": [[0]]}}))
    (folder / "split.json").write_text(json.dumps({**good, "qubo": {**good["qubo"], "quadratic": [[0.5, 1, 2.0]]}}))
    (tmp_path / "stray.json").write_text("{}")
    batch, errors = files.read_problem_json(spark, str(tmp_path / "batch one"))
    assert [(r.batch, r.instance_id, r.i, r.j, r.v) for r in batch.quadratic.collect()] == [("batch one", "i", 0, 1, 2.0)]
    assert sorted(r.code for r in errors.collect()) == [
        "malformed_linear_term", "malformed_quadratic_term", "missing_qubo", "missing_validation"]
    found, misplaced = files.discover(spark, str(tmp_path))
    assert sorted((r.batch, r.path_dir, r.stem) for r in found.collect()) == [
        ("batch one", "sub", n) for n in ("bare", "good", "old", "short", "split")]
    assert [r.path.endswith("stray.json") for r in misplaced.collect()] == [True]


def test_manifests_with_quotes_and_bad_numbers(spark, tmp_path):
    folder = tmp_path / "b" / "results_1"
    folder.mkdir(parents=True)
    (folder / "manifest.csv").write_text('run_id,energy,wall_seconds,file\nr1,-3.5,"x","a ""q"", b.json"\n')
    got = files.read_manifest(spark, str(folder / "manifest.csv")).first()
    assert (got.batch, got.folder, got.energy, got.wall_seconds, got.file) == ("b", "results_1", -3.5, None, 'a "q", b.json')


def test_indented_result_files(spark, tmp_path):
    folder = tmp_path / "b" / "results(2)" / "exact"
    folder.mkdir(parents=True)
    record = {"schema_version": 2, "run_id": "r", "problem": {"instance_id": "i"}, "solution": {"sample": [1, 0], "energy": -1.0},
              "snapshots": [{"index": 1, "progress_fraction": 1.0, "target": {"unit": "states", "value": 4, "total": 4}}]}
    (folder / "i--r.json").write_text(json.dumps(record, indent=2))
    got = files.read_results(spark, str(tmp_path)).first()
    assert (got.batch, got.result_set, got.instance_id, got.file) == ("b", "results(2)", "i", "exact/i--r.json")
    assert got.solution.sample == [1, 0] and got.snapshots[0].target.value == 4.0


def test_batches_replace_only_themselves(spark, table, rows, tmp_path):
    path = str(tmp_path / "store")
    one = encode_max_cut(table([("a", "x", 0, 1, 1.0), ("b", "x", 0, 1, 5.0)], "u long, v long, w double"))
    tables.write_batch(one, path)
    tables.write_batch(encode_max_cut(table([("b", "y", 0, 1, 7.0)], "u long, v long, w double")), path)
    back = tables.read_batch(spark, path)
    assert rows(back.quadratic, "v", key=True) == [("a", "x", 2.0), ("b", "y", 14.0)]
    assert rows(tables.read_batch(spark, path, ["b"]).instances, "num_variables", key=True) == [("b", "y", 2)]


def test_registry(spark):
    assert list_families(spark).count() == 10 and family("max_cut").encode is encode_max_cut
    with pytest.raises(ValueError, match="available: .*max_cut"):
        family("nothing")


def test_runs_of_two_sets_and_missing_energies(spark, table):
    batch = encode_max_cut(table([(*K, 0, 1, 2.0)], "u long, v long, w double"))
    runs = table([(*K, "results", "r", [0, 1], -2.0), (*K, "results_1", "r", [0, 0], -2.0)],
                 "result_set string, run_id string, sample array<int>, reported_energy double")
    got = {r.result_set: (r.recomputed_energy, r.passed) for r in R.verify_results(runs, batch).collect()}
    assert got == {"results": (-2.0, True), "results_1": (0.0, False)}
    energies = table([(*K, 0, None), (*K, 1, float("nan")), (*K, 2, -5.0)], "sample_id long, energy double")
    from bitloom.operators.energy import best_sample

    assert best_sample(energies).first()["sample_id"] == 2
    assert best_sample(energies.where("sample_id < 2")).first()["energy"] is None
    rows = table([("a", "x", "5", 1), ("a", "x", "1", 2)], "validation_status string, row int")
    assert manifests.upsert_problem_manifest(rows.limit(0), rows, "row").first()["validation_status"] == "1"


def test_live_leaderboard(spark, tmp_path):
    """Late, rewritten and repeated runs, missing energies, ties, and snapshots taken on the way."""
    schema = ("batch string, result_set string, instance_id string, solver string, run_id string, version long, "
              "energy double, wall_seconds double")
    waves = [[("b", "results", "i", "s", "r1", 1, -3.0, 1.0), ("b", "results", "i", "t", "r2", 1, -3.0, None)],
             [("b", "results", "i", "s", "r1", 2, -1.0, 2.0), ("b", "results", "j", "s", "r3", 1, None, 4.0),
              ("b", "results", "j", "t", "r4", 1, float("nan"), 1.0)],
             [("b", "results", "i", "s", "r1", 1, -9.0, 9.0), ("b", "results", "i", "s", "r5", 1, -3.0 - 1e-12, 3.0)]]
    sink, newest = str(tmp_path / "log"), {}
    for k, wave in enumerate(waves):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "runs"))
        W.stream_leaderboard(stream, sink, str(tmp_path / "state")).awaitTermination()
        for row in wave:
            if row[4] not in newest or newest[row[4]][5] <= row[5]:
                newest[row[4]] = row
        if k < 2:
            assert W.compact(spark, sink, W.BOARD_KEYS) == W.compact(spark, sink, W.BOARD_KEYS)
        rows = [(*r[:5], None if r[6] != r[6] else r[6], r[7]) for r in newest.values()]
        runs = spark.createDataFrame(rows, "batch string, result_set string, instance_id string, solver_type string, run_id string, "
                                           "energy double, wall_seconds double").withColumn("file", F.lit("x"))
        got = W.current_leaderboard(spark, sink).collect()
        want = {r["solver"]: r for r in A.leaderboard(runs).collect()}
        assert {r["solver"]: (r["wins"], r["mean_time"], r["rank"]) for r in got} == {
            s: (r["wins"], r["mean_time"], r["rank"]) for s, r in want.items()}
        assert {r["solver"]: r["mean_gap"] for r in got} == pytest.approx({s: r["mean_gap"] for s, r in want.items()})


def test_live_leaderboard_of_many_cases(spark, tmp_path):
    """No case costs a call of Python: 40,000 cases in four micro-batches."""
    n = F.col("id")
    runs = spark.range(80_000).select(
        F.lit("b").alias("batch"), F.lit("results").alias("result_set"), (n % 40_000).cast("string").alias("instance_id"),
        F.concat(F.lit("s"), F.floor(n / 40_000).cast("string")).alias("solver"), n.cast("string").alias("run_id"),
        F.lit(1).alias("version"), (-(n % 7)).cast("double").alias("energy"), F.lit(1.0).alias("wall_seconds"))
    runs.repartition(4).write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
    started = time.monotonic()
    W.stream_leaderboard(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    got = {r["solver"]: r["wins"] for r in W.current_leaderboard(spark, str(tmp_path / "log")).collect()}
    took = time.monotonic() - started
    energy = [[-(k % 7) for k in range(start, start + 40_000)] for start in (0, 40_000)]
    assert got == {"s0": sum(a <= b for a, b in zip(*energy, strict=True)), "s1": sum(b <= a for a, b in zip(*energy, strict=True))}
    assert took < 30


def test_written_tables_are_dealt_by_rows(spark):
    """Rows that fill few bytes are still shared out: one task wrote them, several read them."""
    from bitloom.session import FILE_ROWS, cut

    df = cut(spark.range(0, 2 * FILE_ROWS + 1, 1, 1).selectExpr("id % 2 AS x"))
    assert len(df.inputFiles()) == 3 and df.count() == 2 * FILE_ROWS + 1
