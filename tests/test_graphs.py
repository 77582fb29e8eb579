"""Components, forests, graph checks and family validators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions.numbers import gcd_by
from bitloom.operators import families as D
from bitloom.operators import graphs as G
from bitloom.operators import validation as C
from bitloom.operators import satisfaction
from bitloom.operators.encoders import instances_of
from bitloom.operators.satisfaction import search
from bitloom.schemas import KEY, Batch

A = ("a", "x")


def test_long_path_is_one_component(spark):
    path = spark.range(999).select(F.lit("a").alias("batch"), F.lit("p").alias("instance_id"),
                                   (F.col("id") * 389 % 1000).alias("u"), ((F.col("id") + 1) * 389 % 1000).alias("v"))
    got = G.component_labels(path).agg(F.min("label"), F.max("label"), F.count("*")).first()
    assert tuple(got) == (0, 0, 1000)


def test_components_keep_isolated_vertices_and_instances_apart(table, rows):
    vertices = table([("a", k, u) for k in "xy" for u in range(6)], "u long")
    edges = table([("a", "x", 4, 2), ("a", "x", 2, 5), ("a", "y", 0, 1)], "u long, v long")
    labels = G.components(vertices, edges)
    got = {(r.instance_id, r.u): r.label for r in labels.collect()}
    assert [got["x", u] for u in range(6)] == [0, 1, 2, 3, 2, 2]
    assert [got["y", u] for u in range(6)] == [0, 0, 2, 3, 4, 5]
    assert rows(G.component_counts(labels), "components", key=True) == [("a", "x", 4), ("a", "y", 5)]


def _kruskal(edges):
    """Frustrated edges outside the forest that takes edges in index order, by union-find with signs."""
    parent, sign = {}, {}

    def find(v):
        s = 1
        while parent.setdefault(v, v) != v:
            s *= sign[v]
            v = parent[v]
        return v, s

    bad = extra = 0
    for i, j, coupling in sorted(edges):
        want = -1 if coupling > 0 else 1
        (a, sa), (b, sb) = find(i), find(j)
        if a == b:
            extra += 1
            bad += sa * sb != want
        else:
            parent[b], sign[b] = a, sa * sb * want
    return extra, bad


def test_frustration_against_union_find(table):
    rng = random.Random(11)
    data, truth = [], {}
    for g in range(8):
        n = rng.randrange(2, 14)
        chosen = [(i, j, rng.choice([-1.0, 1.0])) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        data += [("a", str(g), *e) for e in chosen]
        truth[str(g)] = _kruskal(chosen)
    sizes = table([("a", str(g), 14) for g in range(8)], "num_vertices long")
    got = {r.instance_id: (r.cycle_basis_size, r.frustrated_cycle_basis_count)
           for r in G.frustration(table(data, "i long, j long, coupling double"), sizes).collect()}
    assert got == truth


def test_forest_keeps_one_edge_between_two_components(table, monkeypatch):
    sides = [(0, range(2, 12)), (1, range(12, 22))]
    pairs = [(hub, leaf) for hub, leaves in sides for leaf in leaves] + list(itertools.product(sides[0][1], sides[1][1]))
    written, cut = [], G.cut

    def watched(df):
        done = cut(df)
        if "ci" in done.columns:
            written.append(done.count())
        return done

    monkeypatch.setattr(G, "cut", watched)
    gauge = G.spanning_gauge(table([(*A, i, j, 1.0) for i, j in pairs], "i long, j long, coupling double")).collect()
    signs = {r.u: r.sign for r in gauge}
    assert written == [1, 0]  # of a hundred edges between the stars the lowest one goes on
    assert len(signs) == 22 and len({r.label for r in gauge}) == 1
    assert all(signs[i] != signs[j] for i, j in [*pairs[:20], (2, 12)])


def test_two_vertex_cycle_is_one_edge(table, rows):
    edges = table([(*A, 0, 1)], "u long, v long")
    sizes = table([(*A, 2)], "num_vertices long")
    facts = C.graph_facts(edges, sizes, G.component_counts(G.component_labels(edges)))
    params = table([(*A, "cycle", 2)], "graph_type string, degree int")
    assert C.topology_issues(facts, params).count() == 0
    bad = table([(*A, "random_regular", 2)], "graph_type string, degree int")
    assert rows(C.topology_issues(facts, bad), "code") == [("wrong_regular_topology",)]


def test_edge_complaints_follow_their_order(table, rows):
    edges = table([(*A, 0, None, 1.0, 1.0), (*A, 1, 0.5, 9.0, 1.0), (*A, 2, 0.0, 9.0, 1.0), (*A, 3, 1.0, 1.0, 1.0),
                   (*A, 4, 0.0, 1.0, float("nan")), (*A, 5, 1.0, 0.0, 1.0)],
                  "position long, u double, v double, w double")
    sizes = table([(*A, 3)], "num_vertices long")
    assert rows(C.edge_issues(edges, sizes), "code") == [
        (c,) for c in sorted(["malformed_edge", "noninteger_vertex", "edge_out_of_range", "self_loop",
                              "duplicate_edge", "invalid_edge_weight"])]


def test_term_issues_and_names(table, rows):
    linear = table([(*A, 0, 1.0), (*A, 0, 2.0), (*A, 5, 1.0)], "i long, v double")
    quadratic = table([(*A, 1, 0, 1.0), (*A, 0, 1, float("inf")), (*A, 0, 1, 1.0)], "i long, j long, v double")
    names = table([(*A, 0, "n"), (*A, 1, "n")], "i long, name string")
    batch = Batch(instances_of(table([(*A, 2)], "num_variables long"), "t"), linear, quadratic, names)
    assert {c for (c,) in rows(C.term_issues(batch), "code")} == {
        "linear_index_out_of_range", "duplicate_linear_term", "invalid_quadratic_indices",
        "duplicate_quadratic_term", "nonfinite_coefficient", "duplicate_variable_names"}


def test_statistics_of_nothing(table):
    empty = Batch(instances_of(table([(*A, 1)], "num_variables long"), "t"),
                  table([], "i long, v double"), table([], "i long, j long, v double"))
    got = {r.key: r.value for r in C.term_stats(empty).collect()}
    assert got["qubo_quadratic_density"] == 0.0 and got["qubo_inactive_variables"] == 1
    assert got["qubo_coefficient_statistics.count"] == 0 and got["qubo_coefficient_statistics.mean"] is None


def test_gcd_and_perfect_partition(table, rows):
    numbers = table([("a", "x", 0, 12), ("a", "x", 1, 18), ("a", "x", 2, 30), ("a", "y", 0, 7), ("a", "y", 1, 9)],
                    "i long, value long")
    assert rows(gcd_by(numbers, KEY, "value"), "gcd", key=True) == [("a", "x", 6), ("a", "y", 1)]
    assert rows(G.perfect_partition(numbers), "perfect_partition_exists", key=True) == [
        ("a", "x", True), ("a", "y", False)]
    many = table([("a", "x", i, 1) for i in range(25)], "i long, value long")
    assert rows(G.perfect_partition(many), "perfect_partition_exists") == [(False,)]


def test_perfect_partition_of_any_count(table, rows):
    import itertools
    import random

    rng = random.Random(11)
    groups = {f"r{g}": [rng.randrange(0, 40) for _ in range(rng.randrange(1, 11))] for g in range(30)}
    groups |= {f"big{g}": [rng.randrange(-9, 10) << 50 for _ in range(7)] for g in range(8)}
    want = {g: any(sum(c) * 2 == sum(map(abs, v)) for n in range(len(v) + 1) for c in itertools.combinations(map(abs, v), n))
            for g, v in groups.items()}
    groups["long"], want["long"] = [rng.randrange(1, 1_000_000) for _ in range(199)], True
    groups["long"].append(2 - sum(groups["long"]) % 2)
    groups["copies"], want["copies"] = [3] * 500 + [1000], False  # neither 1250 nor 250 is a multiple of 3
    groups["halves"], want["halves"] = [(1 << 40) + 3 * i for i in range(39)] + [(1 << 40) + 3 * 39 + 2], False
    groups["halves2"], want["halves2"] = [(1 << 40) + 7 * (i // 2) for i in range(40)], True
    groups["open"], want["open"] = [(1 << 45) + 2 * i for i in range(42)], None
    groups["beyond"], want["beyond"] = [(1 << 62)] * 4, None
    numbers = table([("a", g, i, x) for g, v in groups.items() for i, x in enumerate(v)], "i long, value long")
    got = {k: v for _, k, v in rows(G.perfect_partition(numbers), "perfect_partition_exists", key=True)}
    assert sum(groups["long"]) > 5e7 and got == want


def test_small_totals_take_no_python_call_per_instance(table, rows):
    numbers = table([("a", str(g), i, v) for g in range(40) for i, v in enumerate((g, 2, 2, g % 3))], "i long, value long")
    found = G.perfect_partition(numbers)
    assert {k: v for _, k, v in rows(found, "perfect_partition_exists", key=True)} == {
        str(g): any(2 * sum(v for v, b in zip(n, bits) if b) == sum(n) for bits in itertools.product((0, 1), repeat=4))
        for g in range(40) for n in [(g, 2, 2, g % 3)]}
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


def test_colours_of_sparse_graphs_of_any_size(table):
    import random

    def ring(n):  # each vertex with the next two: three colours only if 3 divides n
        return [(u, (u + d) % n) for u in range(n) for d in (1, 2)]

    rng = random.Random(3)
    graphs = {"ring300": (300, ring(300), True, 4), "ring301": (301, ring(301), False, 4),
              "tree": (200, [(rng.randrange(u), u) for u in range(1, 200)], True, 0), "empty": (30, [], True, 0),
              "both": (60, ring(30) + [(30 + u, 30 + v) for u in range(4) for v in range(u)], False, None)}
    graphs["dense"] = (400, [(u, 200 + v) for u in range(200) for v in range(200) if rng.random() < 0.5], None, None)
    vertices = table([("a", g, u) for g, (n, *_) in graphs.items() for u in range(n)], "u long")
    edges = table([("a", g, *e) for g, (_, es, *_) in graphs.items() for e in es], "u long, v long")
    got = {r.instance_id: (r.colorable, r.width) for r in G.coloring_widths(vertices, edges, 3).collect()}
    assert {g: v[0] for g, v in got.items()} == {g: v[2] for g, v in graphs.items()}
    assert all(got[g][1] == v[3] for g, v in graphs.items() if v[3] is not None) and got["dense"][1] > 4
    assert {r.instance_id: r.colorable for r in G.colorable(vertices, edges, 3).collect()} == {g: v[2] for g, v in graphs.items()}


def test_frontier_coloring_against_search():
    import random

    def search(n, near, k, colors=()):
        u = len(colors)
        return u == n or any(search(n, near, k, (*colors, c)) for c in range(min(k, max(colors, default=-1) + 2))
                             if all(colors[v] != c for v in near[u] if v < u))

    rng, seen = random.Random(8), set()
    for _ in range(150):
        n, p = rng.randrange(5, 13), rng.choice((0.3, 0.5, 0.7))
        pairs = [(u, v) for v in range(1, n) for u in range(v) if u == v - 1 or rng.random() < p]
        near = [{a for e in pairs for a in e if u in e and a != u} for u in range(n)]
        for k in (3, 4):
            truth = search(n, near, k)
            seen.add((k, truth))
            assert G.frontier_coloring(pairs, k)[0] == truth
    assert len(seen) == 4


def test_slack_gap_and_duplicate_sets(table, rows):
    slack = table([(*A, 0, 1), (*A, 1, 2), (*A, 2, 2), (*A, 3, 7), (*A, 4, 8)], "k long, weight long")
    assert rows(D.slack_reach(slack), "represented") == [(5,)]
    members = table([(*A, s, e) for s, es in enumerate([[1, 2], [2, 1], [1, 2, 3], [1, 2], [4]]) for e in es],
                    "set_id long, element long")
    assert rows(D.duplicate_set_count(members), "duplicate_sets") == [(2,)]


def test_satisfiable_small_formulas(table):
    clauses = {"yes": [[(0, False), (1, True)], [(1, False), (0, False)]],
               "no": [[(0, False), (1, False)], [(0, True), (1, False)], [(0, False), (1, True)], [(0, True), (1, True)]]}
    literals = table([("a", k, c, p, v, neg) for k, cs in clauses.items() for c, cl in enumerate(cs)
                      for p, (v, neg) in enumerate(cl)], "clause_id long, pos long, variable long, negated boolean")
    sizes = table([("a", "yes", 2), ("a", "no", 2), ("a", "empty", 3), ("a", "free", 17), ("a", "big", 63)], "num_variables long")
    got = {r.instance_id: r.satisfiable for r in D.satisfiable(literals, sizes).collect()}
    assert got == {"yes": True, "no": False, "empty": True, "free": True, "big": None}


@pytest.mark.parametrize("first", [60, 1])
def test_satisfiable_wide_formulas(table, monkeypatch, first):
    """Against all assignments: random clauses of 17 variables, pigeons in holes, and a formula with few solutions."""
    monkeypatch.setattr(satisfaction, "FIRST_STEPS", first)  # 1: nearly all are split into cubes
    rng = np.random.default_rng(5)
    formulas, truth = {}, {}
    words = np.arange(1 << 17)
    for k in range(12):
        clauses = [[(int(v), bool(rng.random() < 0.5)) for v in rng.choice(17, 3, replace=False)] for _ in range(66 + k)]
        ok = np.ones(len(words), bool)
        for c in clauses:
            ok &= np.any([(words >> v & 1 == 1) != neg for v, neg in c], axis=0)
        formulas[f"r{k}"], truth[f"r{k}"] = (17, clauses), bool(ok.any())
    for pigeons, holes in ((5, 5), (6, 5), (7, 6)):
        name = f"p{pigeons}{holes}"
        clauses = [[(p * holes + h, False) for h in range(holes)] for p in range(pigeons)]
        clauses += [[(p * holes + h, True), (q * holes + h, True)] for h in range(holes) for p in range(pigeons) for q in range(p)]
        formulas[name], truth[name] = (pigeons * holes, clauses), pigeons <= holes
    chain = [[(k, True), (k + 1, False)] for k in range(61)] + [[(0, False)]]
    formulas["chain"], truth["chain"] = (62, chain), True
    formulas["broken"], truth["broken"] = (62, [*chain, [(61, True)]]), False
    formulas["twisted"], truth["twisted"] = (62, [[(5, True), (5, False)]]), True
    literals = table([("a", name, c, p, v, neg) for name, (_, cs) in formulas.items() for c, cl in enumerate(cs)
                      for p, (v, neg) in enumerate(cl)], "clause_id long, pos long, variable long, negated boolean")
    sizes = table([("a", name, n) for name, (n, _) in formulas.items()], "num_variables long")
    assert {r.instance_id: r.satisfiable for r in D.satisfiable(literals, sizes).collect()} == truth
    assert set(truth.values()) == {True, False} and sum(truth[f"r{k}"] for k in range(12)) not in (0, 12)


def test_search_gives_up_but_never_guesses():
    pairs = [(p * 4 + h, q * 4 + h) for h in range(4) for p in range(5) for q in range(p)]
    pos = np.array([sum(1 << (p * 4 + h) for h in range(4)) for p in range(5)] + [0] * len(pairs))
    neg = np.array([0] * 5 + [(1 << a) | (1 << b) for a, b in pairs])
    assert search(pos, neg, 2) is None and search(pos, neg) is False and search(pos[:5], neg[:5]) is True


def test_every_warning_code_has_one_rule(table, rows):
    assert sorted(code for code, _ in C.warning_rules()) == sorted(C.WARNING_CODES) and len(C.WARNING_CODES) == 26
    chars = table([(*A, "penalty_margin", 0.0, None), (*A, "largest_number_fraction_of_sum", 0.5, None)],
                  "key string, value double, text string")
    kinds = table([(*A, "number_partitioning")], "problem_type string")
    assert rows(C.warnings(chars, kinds), "code") == [("weak_penalty",)]


def test_later_characteristics_win_and_errors_fail(table, rows):
    schema = "key string, value double, text string"
    parts = [table([(*A, "k", 1.0, None)], schema), table([(*A, "k", 2.0, None)], schema)]
    issues = [table([(*A, "warning", "c", "")], "severity string, code string, message string")]
    kinds = table([(*A, "t")], "problem_type string")
    _, chars, status = C.merge_validation(kinds, issues, parts)
    assert rows(chars, "value") == [(2.0,)]
    assert rows(status, "status", "has_warnings") == [("passed", True)]


def test_gcd_is_folded_by_batches_not_by_groups(spark, table, rows):
    """Groups that run over several Arrow batches, nulls and negative values; no Python call per group."""
    values = {"p": [12, 18, None, -30, 48, 6], "q": [None, None], "r": [-4], "s": [0, 0], "t": [2 ** 62, 2 ** 61, 3 * 2 ** 60]}
    numbers = table([("a", k, v) for n in range(6) for k, vs in values.items() for v in vs[n:n + 1]], "value long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = gcd_by(numbers, KEY, "value")
        assert sorted(rows(found, "instance_id", "gcd")) == [("p", 6), ("q", 0), ("r", 4), ("s", 0), ("t", 2 ** 60)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    plan = found._jdf.queryExecution().toString()
    assert "ArrowAggregatePython" not in plan and "AggregateInPandas" not in plan
