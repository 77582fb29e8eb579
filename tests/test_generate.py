"""Generated data: shape, distribution, determinism."""

import pytest
from pyspark.sql import functions as F

from bitloom.operators import generate as G
from bitloom.plans.generation import PARAMETERS, check_parameters, declared_parameters, generate_batch
from bitloom.schemas import KEY

A = ("a", "x")


def test_sparse_pairs_are_valid_and_bernoulli(table):
    n, p = 3000, 0.002
    grid = table([(*A, s, n, p) for s in (1,)] + [("a", "y", 2, n, p)], "seed long, n long, density double")
    got = G.sample_pairs(grid).cache()
    assert got.where("NOT (0 <= i AND i < j AND j < n)").count() == 0
    assert got.select(*KEY, "i", "j").distinct().count() == got.count()
    total = n * (n - 1) / 2
    for r in got.groupBy(*KEY).count().collect():
        assert abs(r["count"] - total * p) < 5 * (total * p) ** 0.5
    # evenly spread over the rows of the triangle: the lower half of the ranks holds half of the pairs
    half = got.where(F.col("i") < n * (1 - 0.5 ** 0.5)).count() / got.count()
    assert abs(half - 0.5) < 0.03
    again = G.sample_pairs(grid.repartition(5))
    assert again.select(*KEY, "i", "j").exceptAll(got.select(*KEY, "i", "j")).isEmpty()


def test_gap_runs_follow_the_same_law_at_higher_density(table):
    grid = table([(*A, 7, 1600, 0.2)], "seed long, n long, density double")
    got = G.sample_pairs(grid)
    total = 1600 * 1599 / 2
    count = got.count()
    assert abs(count - total * 0.2) < 5 * (total * 0.2 * 0.8) ** 0.5
    assert got.select("i", "j").distinct().count() == count
    # a pair's neighbour is no more or less likely: adjacent ranks both present in 0.04 of all cases
    both = got.alias("p").join(got.alias("q"), (F.col("p.i") == F.col("q.i")) & (F.col("q.j") == F.col("p.j") + 1)).count()
    assert abs(both / total - 0.04) < 0.002


def test_regular_graphs(table):
    grid = table([("a", str(k), k, n, d) for k, (n, d) in enumerate([(4, 3), (8, 3), (10, 4), (9, 2), (5, 3), (3, 3)])],
                 "seed long, n long, degree long")
    edges = G.random_regular(grid).cache()
    degrees = edges.select(*KEY, F.explode(F.array("u", "v")).alias("x")).groupBy(*KEY, "x").count()
    facts = {r.instance_id: (r.n, r.lo, r.hi) for r in degrees.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("count").alias("lo"), F.max("count").alias("hi")).collect()}
    assert facts == {"0": (4, 3, 3), "1": (8, 3, 3), "2": (10, 4, 4), "3": (9, 2, 2)}
    assert edges.where("u >= v").count() == 0 and edges.distinct().count() == edges.count()
    issues = {(r.instance_id, r.code) for r in G.degree_issues(grid).collect()}
    assert issues == {("4", "odd_degree_sum"), ("5", "degree_too_large")}


def test_cycle_of_two_is_one_edge(table, rows):
    grid = table([("a", "x", 0, 2), ("a", "y", 0, 4)], "seed long, n long")
    assert rows(G.cycle_graph(grid), "u", "v", key=True) == [
        ("a", "x", 0, 1), ("a", "y", 0, 1), ("a", "y", 0, 3), ("a", "y", 1, 2), ("a", "y", 2, 3)]


def test_clauses_have_distinct_variables_and_planting_satisfies(table):
    grid = table([(*A, 3, 6, 400)], "seed long, n long, num_clauses long")
    literals = G.random_clauses(grid, 3).cache()
    shape = literals.groupBy("clause_id").agg(F.count("*").alias("c"), F.count_distinct("variable").alias("v"))
    assert shape.where("c <> 3 OR v <> 3").count() == 0 and shape.count() == 400
    use = literals.groupBy("variable").count().collect()
    assert len(use) == 6 and all(abs(r["count"] - 200) < 60 for r in use)
    assignment = G.planted_assignment(grid)
    fixed = G.plant(literals, assignment, grid)
    true = (F.col("x") == 1) != F.col("negated")
    ok = fixed.join(assignment.withColumnRenamed("i", "variable"), [*KEY, "variable"]).groupBy("clause_id").agg(
        F.bool_or(true).alias("ok"))
    assert ok.where("ok").count() == 400
    flipped = fixed.join(literals.withColumnRenamed("negated", "old"), [*KEY, "clause_id", "pos", "variable"])
    assert flipped.where("old <> negated").groupBy("clause_id").count().where("count > 1").isEmpty()


def test_rejected_instances_get_new_seeds(table, rows):
    grid = table([("a", str(k), k) for k in range(6)], "seed long")

    def judge(built, now):
        return now.where(F.col("seed") % 3 != 0).select(
            *KEY, F.lit("warning").alias("severity"), F.lit("empty_graph").alias("code"))

    accepted, failed = G.generate_accepted(grid, lambda g: g, judge, ["empty_graph"], 3)
    step = G.ATTEMPT_STEP
    want = [("a", str(k), next(s for s in (k, k + step, k + 2 * step) if s % 3 == 0)) for k in range(6)]
    assert rows(accepted, "seed", key=True) == want and failed.isEmpty()
    try:
        G.generate_accepted(grid, lambda g: g, judge, ["no_such_code"], 3)
        raise AssertionError("unknown code was accepted")
    except ValueError as error:
        assert "no_such_code" in str(error)


def test_normal_coefficients(spark):
    df = spark.range(20000).select(F.lit(4).alias("seed"), F.col("id").alias("i"))
    got = G.coefficients(df, "normal", F.col("i"), F.lit(0), scale=5.0).agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    assert abs(got.m) < 0.2 and abs(got.s - 5) < 0.2


def test_empty_sets_get_one_element(table):
    grid = table([(*A, 1, 50, 9, 0.0)], "seed long, num_sets long, universe_size long, inclusion_probability double")
    got = G.random_sets(grid)
    assert got.count() == 50 and got.where("element BETWEEN 0 AND 8").count() == 50


def test_streams_and_seeds_do_not_share_draws(table):
    grid = table([("b", f"i{s}", s, 200) for s in range(100, 140)], "seed long, n long")
    items = G.random_items(grid)
    drawn = {}
    for r in items.collect():
        drawn.setdefault(r.instance_id, {})[r.i] = (r.weight, r.value)
    series = [tuple(d[i][k] for i in range(200)) for d in drawn.values() for k in (0, 1)]
    assert len(set(series)) == 80
    weights, values = series[0::2], series[1::2]
    assert all(sum(w % 20 == v % 20 for w, v in zip(a, b, strict=True)) < 60 for a in weights for b in values)


def test_pairs_follow_one_rule_at_every_size(table):
    grid = table([("b", "small", 5, 60, 0.1), ("b", "large", 5, 1600, 0.01), ("b", "all", 5, 30, 1.0), ("b", "none", 5, 30, 0.0)],
                 "seed long, n long, density double")
    pairs = {}
    for r in G.sample_pairs(grid).collect():
        assert 0 <= r.i < r.j
        pairs.setdefault(r.instance_id, []).append((r.i, r.j))
    assert all(len(p) == len(set(p)) for p in pairs.values()) and "none" not in pairs and len(pairs["all"]) == 435
    for name, total, density in (("small", 1770, 0.1), ("large", 1600 * 1599 // 2, 0.01)):
        expected = total * density
        assert abs(len(pairs[name]) - expected) < 5 * expected ** 0.5


@pytest.mark.parametrize("name, given, code", [
    ("max_cut", {"num_vertices": 1}, "parameter_below_minimum"), ("max_cut", {"edge_probability": 1.5}, "parameter_above_maximum"),
    ("max_cut", {"weighted": 1}, "invalid_parameter_type"), ("max_cut", {"graph_type": "star"}, "invalid_parameter_type"),
    ("max_cut", {"colors": 3}, "unknown_parameter"), ("max_cut", {"min_edge_weight": 5, "max_edge_weight": 4}, "invalid_parameter_range"),
    ("spin_glass", {"graph_type": "random_regular", "num_vertices": 5}, "invalid_degree"),
    ("max_sat", {"num_variables": 2}, "too_few_variables"), ("random_qubo", {"coefficient_min": -1.5}, "noninteger_bound"),
    ("independent_set", {"penalty": None}, None), ("set_packing", {}, None)])
def test_parameters_of_families(name, given, code):
    values, wrong = check_parameters(name, given)
    assert [c for c, _ in wrong] == ([code] if code else [])
    assert set(values) == {row[0] for row in PARAMETERS[name]}


def test_wrong_parameters_fail_their_instances_only(spark, table):
    grid = table([("b", "x", 1), ("b", "y", 2)], "seed long")
    got = generate_batch(grid, "number_partitioning", {"num_numbers": 1})
    assert got.batch is None and {r.status for r in got.status.collect()} == {"failed"} and got.issues.count() == 2
    made = generate_batch(grid, "number_partitioning", {"num_numbers": 5})
    assert [(r.method, r.samples_checked, r.mismatches) for r in made.encoding.collect()] == [("exhaustive", 32, 0)] * 2
    assert {r.status for r in made.status.collect()} == {"passed"} and made.batch.quadratic.count() == 20
    assert declared_parameters(spark).select("owner").distinct().count() == 10


def test_mixed_table_is_generated_stored_and_checked_again(spark, tmp_path):
    """Families and parameters side by side, a regular graph, a redraw, wrong entries; then stored files, some spoilt."""
    from bitloom.plans import generation as P
    from bitloom.schemas import Batch
    from bitloom.sources.tables import read_batch

    rows = [("b", 0, 2, None, "max_cut", {"num_vertices": "6", "graph_type": "random_regular", "degree": "3", "weighted": "true"}),
            ("b", 1, 1, 77, "max_cut", {"num_vertices": "4", "edge_probability": "0.0"}),
            ("b", 2, 1, None, "number_partitioning", {"num_numbers": "5", "max_value": "9"}),
            ("b", 3, 1, None, "number_partitioning", {"num_numbers": "3", "min_value": "9", "max_value": "2"}),
            ("b", 4, 1, None, "max_sat", {"num_variables": "4", "num_clauses": "3", "clause_size": "2", "planted_solution": "false"}),
            ("b", 5, 1, None, "chess", {}), ("b", 6, 1, None, "max_cut", {"colour": "red"})]
    entries = spark.createDataFrame(
        rows, "batch string, entry long, count long, seed long, problem_type string, parameters map<string,string>")
    path = str(tmp_path / "made")
    made = P.generate_entries(entries, reject=["empty_graph"], max_attempts=2, path=path)
    status = {r.instance_id: r.status for r in made.status.collect()}
    good = {"seed_0", "seed_1", "seed_77", "seed_2000000", "seed_4000000"}
    assert {k for k, v in status.items() if v == "passed"} == good and len(status) == 8
    codes = {(r.instance_id, r.code) for r in made.issues.where("severity = 'error'").collect()}
    assert codes == {("seed_3000000", "invalid_parameter_range"), ("seed_5000000", "unknown_family"), ("seed_6000000", "unknown_parameter")}
    seeds = {r.instance_id: r.seed for r in made.grid.collect()}
    assert seeds["seed_77"] == 77 + 1_000_000_000 and seeds["seed_0"] == 0  # the edgeless graph was drawn again
    assert {r.mismatches for r in made.encoding.collect()} == {0} and made.encoding.count() == 5
    degrees = made.tables["edges"].where("instance_id = 'seed_0'").selectExpr("explode(array(u, v)) AS u").groupBy("u").count()
    assert {r["count"] for r in degrees.collect()} == {3} and degrees.count() == 6
    stored = read_batch(spark, path)
    spoilt = stored.linear.withColumn("v", F.when(F.col("instance_id") == "seed_1", F.col("v") + 1).otherwise(F.col("v")))
    tables = P.read_domain(spark, path, ["max_cut", "number_partitioning", "max_sat"])
    again = P.validate_stored(stored.instances, Batch(stored.instances, spoilt, stored.quadratic), tables)
    assert {r.instance_id: r.status for r in again[2].collect()} == {k: "failed" if k == "seed_1" else "passed" for k in good}
    bare = P.validate_stored(stored.instances, Batch(stored.instances, spoilt, stored.quadratic), {})
    assert {r.status for r in bare[2].collect()} == {"passed"} and bare[3] is None


def test_rows_and_dictionaries_agree_on_parameters(spark):
    from bitloom.plans import generation as P

    cases = [("max_cut", {"num_vertices": "1"}), ("max_cut", {"edge_probability": "1.5"}), ("max_cut", {"graph_type": "star"}),
             ("max_cut", {"weighted": "1"}), ("spin_glass", {"graph_type": "random_regular", "num_vertices": "5"}),
             ("max_sat", {"num_variables": "2"}), ("random_qubo", {"coefficient_min": "-1.5"}), ("set_packing", {}),
             ("independent_set", {"penalty": None}), ("quadratic_knapsack", {"min_value": "40"})]
    rows = [("b", str(k), *case) for k, case in enumerate(cases)]
    found = P.parameter_issues(spark.createDataFrame(
        rows, "batch string, instance_id string, problem_type string, parameters map<string,string>")).collect()
    assert sorted((int(r.instance_id), r.code) for r in found) == [
        (0, "parameter_below_minimum"), (1, "parameter_above_maximum"), (2, "invalid_parameter_type"), (3, "invalid_parameter_type"),
        (4, "invalid_degree"), (5, "too_few_variables"), (6, "noninteger_bound"), (9, "invalid_parameter_range")]
