"""Energies, exact minima and the families' own objectives."""

import itertools

from pyspark.sql import functions as F

from bitloom.operators import encoders as E
from bitloom.operators import energy as V
from bitloom.operators.exact import exact_checkpoints, exact_minimum
from bitloom.operators.graphs import colorable
from bitloom.schemas import KEY, Batch

A = ("a", "x")


def test_triangle_max_cut(table, rows):
    edges = table([(*A, 0, 1, 1.0), (*A, 0, 2, 2.0), (*A, 1, 2, 3.0)], "u long, v long, w double")
    batch = E.encode_max_cut(edges)
    assert rows(exact_minimum(batch), "energy", "assignment", "optima") == [(-5.0, 3, 2)]
    samples = V.all_samples(batch.instances)
    assert rows(V.energy(batch, samples), "sample_id", "energy") == rows(
        V.cut_energy(edges, samples), "sample_id", "energy")
    assert rows(V.best_sample(V.energy(batch, samples)), "sample_id", "energy") == [(3, -5.0)]


def test_same_id_in_two_batches_does_not_mix(table, rows):
    edges = table([("a", "x", 0, 1, 1.0), ("b", "x", 0, 1, 10.0)], "u long, v long, w double")
    samples = table([("a", "x", 0, 0, 1), ("a", "x", 0, 1, 0), ("b", "x", 5, 0, 0), ("b", "x", 5, 1, 1)],
                    "sample_id long, i long, x long")
    got = rows(V.energy(E.encode_max_cut(edges), samples), "sample_id", "energy", key=True)
    assert got == [("a", "x", 0, -1.0), ("b", "x", 5, -10.0)]


def test_zero_sample_keeps_the_offset_and_ids_span_words(table, rows):
    linear = table([(*A, 0, 2.0)], "i long, v double")
    none = table([], "i long, j long, v double")
    batch = Batch(E.instances_of(table([(*A, 1)], "num_variables long"), "t",
                                 table([(*A, 7.0)], "offset double")), linear, none)
    ids = [0, 63, 64, 65, 1000]
    samples = table([(*A, s, 0, s % 2) for s in ids], "sample_id long, i long, x long")
    assert rows(V.energy(batch, samples), "sample_id", "energy") == [
        (s, 7.0 + 2.0 * (s % 2)) for s in ids]


def test_exact_minimum_beyond_one_block(table):
    """13 variables: more than the low bits of a block, checked against plain enumeration."""
    n = 13
    lin = [(i * 5) % 7 - 3 for i in range(n)]
    quad = {(i, j): (i * 3 + j * 7) % 11 - 5 for i, j in itertools.combinations(range(n), 2)}
    batch = Batch(
        E.instances_of(table([(*A, n)], "num_variables long"), "t", table([(*A, 0.5)], "offset double")),
        table([(*A, i, float(v)) for i, v in enumerate(lin)], "i long, v double"),
        table([(*A, i, j, float(v)) for (i, j), v in quad.items()], "i long, j long, v double"))
    energies = []
    for s in range(1 << n):
        on = [i for i in range(n) if s >> i & 1]
        energies.append(sum(lin[i] for i in on) + sum(quad[p] for p in itertools.combinations(on, 2)) + 0.5)
    best = min(energies)
    got = exact_minimum(batch).first()
    assert (got.energy, got.assignment, got.optima, got.states_evaluated) == (
        best, energies.index(best), energies.count(best), 1 << n)
    for k in (1, 3, 7):
        for r in exact_checkpoints(batch, k).collect():
            target = -(-r.idx * (1 << n) // k)
            head = energies[:target]
            assert (r.target, r.energy, r.assignment) == (target, min(head), head.index(min(head)))


def test_two_item_knapsack(table):
    items = table([(*A, 0, 1, 4), (*A, 1, 2, 5)], "i long, weight long, value long")
    bonuses = table([], "i long, j long, v long")
    batch, capacity, slack = E.encode_knapsack(items, bonuses, ratio=0.34)
    assert capacity.first().capacity == 1
    best = exact_minimum(batch).first()
    assert best.energy == -4.0 and best.assignment & 3 == 1


def _check(batch, own, samples):
    facts = V.check_encoding(batch, own, samples).collect()
    assert facts and all(r.mismatches == 0 and r.first_mismatch is None for r in facts)


def test_every_family_matches_its_own_objective(table):
    vertices = table([(*A, u, u + 1) for u in range(4)], "u long, value long")
    edges = table([(*A, 0, 1, 1.0), (*A, 1, 2, 2.0), (*A, 0, 3, 1.0)], "u long, v long, w double")
    price = table([(*A, 6.0)], "penalty double")
    sizes = table([(*A, 4)], "num_variables long")
    batch = E.encode_independent_set(vertices, edges, 6.0, sizes)
    samples = V.all_samples(batch.instances)
    _check(batch, V.independent_set_energy(vertices, edges, price, samples), samples)
    batch, missing = E.encode_clique(vertices, edges, price, sizes)
    assert missing.count() == 3
    _check(batch, V.clique_energy(vertices, edges, price, samples), samples)

    batch = E.encode_coloring(vertices, edges, 2, 2.0, 1.0, sizes)
    samples = V.all_samples(batch.instances)
    _check(batch, V.coloring_energy(vertices, edges, samples, 2), samples)

    numbers = table([(*A, 0, 3), (*A, 1, 5), (*A, 2, 8)], "i long, value long")
    batch = E.encode_partition(numbers)
    samples = V.all_samples(batch.instances)
    _check(batch, V.partition_energy(numbers, samples), samples)
    assert exact_minimum(batch).first().energy == 0.0

    items = table([(*A, 0, 3, 4), (*A, 1, 2, 5), (*A, 2, 4, 1)], "i long, weight long, value long")
    bonuses = table([(*A, 0, 1, 2)], "i long, j long, v long")
    batch, capacity, slack = E.encode_knapsack(items, bonuses, 0.5)
    samples = V.all_samples(batch.instances)
    price = table([(*A, 13.0)], "penalty double")
    _check(batch, V.knapsack_energy(items, bonuses, capacity, slack, price, samples), samples)

    members = table([(*A, 0, 1), (*A, 0, 2), (*A, 1, 2), (*A, 1, 3), (*A, 2, 4), (*A, 2, 1), (*A, 2, 2)],
                    "set_id long, element long")
    values = table([(*A, 0, 2), (*A, 1, 3), (*A, 2, 4)], "set_id long, value long")
    batch = E.encode_set_packing(members, values)
    samples = V.all_samples(batch.instances)
    price = table([(*A, 5.0)], "penalty double")
    _check(batch, V.packing_energy(E.overlapping_pairs(members), values, price, samples), samples)

    fields = table([(*A, 0, 1.0), (*A, 1, 0.0), (*A, 2, -2.0)], "i long, h double")
    couplings = table([(*A, 0, 1, 1.0), (*A, 1, 2, -1.0)], "i long, j long, coupling double")
    batch = E.encode_spin_glass(fields, couplings)
    samples = V.all_samples(batch.instances)
    _check(batch, V.ising_energy(fields, couplings, samples), samples)


def test_clauses_on_all_assignments(table, rows):
    lits = [[(0, False), (1, True), (2, False)], [(0, True), (2, True), (1, True)]]
    literals = table([(*A, c, p, v, neg) for c, clause in enumerate(lits) for p, (v, neg) in enumerate(clause)],
                     "clause_id long, pos long, variable long, negated boolean")
    clauses = table([(*A, 0, 2), (*A, 1, 3)], "clause_id long, weight long")
    batch, ancillas = E.encode_max_sat(literals, clauses, 3)
    samples = V.all_samples(batch.instances)
    _check(batch, V.sat3_energy(literals, clauses, ancillas, samples), samples)
    # with the right ancillas the energy is the unsatisfied weight
    got = dict(rows(V.energy(batch, samples), "sample_id", "energy"))
    plain = dict(rows(V.unsatisfied_weight(literals, clauses, samples), "sample_id", "energy"))
    for s in range(8):
        x = [s >> k & 1 for k in range(3)]
        false = [[x[v] == (1 if neg else 0) for v, neg in clause] for clause in lits]
        full = s | (all(false[0][:2]) << 3) | (all(false[1][:2]) << 4)
        assert got[full] == plain[full] == sum(w for f, w in zip(false, (2, 3)) if all(f))
    two, _ = E.encode_max_sat(literals.where("pos < 2"), clauses, 2)
    small = V.all_samples(two.instances)
    _check(two, V.unsatisfied_weight(literals.where("pos < 2"), clauses, small), small)


def test_sample_contract(table, rows):
    batch = E.encode_max_cut(table([(*A, 0, 1, 1.0)], "u long, v long, w double"))
    samples = table([(*A, 0, 0, 1), (*A, 0, 1, 1), (*A, 1, 0, 1), (*A, 2, 0, 2), (*A, 2, 1, 0),
                     (*A, 3, 0, 0), (*A, 3, 0, 0)], "sample_id long, i long, x long")
    assert rows(V.sample_issues(batch, samples), "sample_id", "code") == [
        (1, "wrong_sample_length"), (2, "nonbinary_sample"), (3, "wrong_sample_length")]


def test_hub_variable_with_most_terms(spark, rows):
    """A star: one variable is in every term, and the samples still add up."""
    n = 3000
    edges = spark.range(1, n).select(F.lit("a").alias("batch"), F.lit("x").alias("instance_id"),
                                     F.lit(0).cast("long").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))
    samples = spark.range(n * 3).select(
        F.lit("a").alias("batch"), F.lit("x").alias("instance_id"), (F.col("id") % 3).alias("sample_id"),
        F.floor(F.col("id") / 3).alias("i")).withColumn(
        "x", F.when(F.col("i") == 0, F.col("sample_id") % 2).otherwise((F.col("i") % (F.col("sample_id") + 2) == 0).cast("long")))
    got = rows(V.energy(E.encode_max_cut(edges), samples), "sample_id", "energy")
    want = [sum((0 if s != 1 else 1) != (1 if i % (s + 2) == 0 else 0) for i in range(1, n)) for s in range(3)]
    assert got == [(s, -float(w)) for s, w in enumerate(want)]


def test_colorability_against_brute_force(table, rows):
    import random

    rng = random.Random(5)
    vertices, edges, truth = [], [], {}
    for g in range(12):
        n = rng.randrange(1, 7)
        vertices += [("a", str(g), u) for u in range(n)]
        chosen = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.7]
        edges += [("a", str(g), *p) for p in chosen]
        for k in (1, 2, 3):
            truth[str(g), k] = any(all(c[u] != c[v] for u, v in chosen) for c in itertools.product(range(k), repeat=n))
    vt, et = table(vertices, "u long"), table(edges, "u long, v long")
    for k in (1, 2, 3):
        got = {r.instance_id: r.colorable for r in colorable(vt, et, k).collect()}
        assert got == {g: t for (g, kk), t in truth.items() if kk == k}
    assert set(KEY) <= set(colorable(vt, et, 2).columns)


def test_encoding_checks_look_at_words(table, rows):
    """What an encoding check looks at is a row per 64 samples and variable, and the same samples as row by row."""
    from bitloom.plans.generation import intended_samples

    sizes = table([("b", str(n), n) for n in (1, 3, 5, 6, 7, 9, 14)], "num_variables long")
    words = intended_samples(sizes)
    columns = ["instance_id", "block", "i", "known", "mask"]
    small = V.pack_samples(V.all_samples(sizes))
    assert sorted(rows(words.where("instance_id <> '14'"), *columns)) == sorted(rows(small, *columns))
    large = V.pack_samples(V.probe_samples(sizes.where("num_variables = 14")))
    assert sorted(rows(words.where("instance_id = '14'"), *columns)) == sorted(rows(large, *columns))
    assert words.count() == 1 + 3 + 5 + 6 + 7 * 2 + 9 * 8 + 14 * 3


def test_coloring_energy_of_words_and_of_samples(table, rows):
    vertices = table([(*A, u) for u in range(3)], "u long")
    edges = table([(*A, 0, 1, 1.0), (*A, 1, 2, 1.0)], "u long, v long, w double")
    sizes = table([(*A, 9)], "num_variables long")
    want = {}
    for s in range(512):
        x = [[s >> (3 * u + c) & 1 for c in range(3)] for u in range(3)]
        want[s] = sum(1.5 * (sum(colors) - 1) ** 2 for colors in x) + 0.5 * sum(
            x[u][c] * x[v][c] for u, v in ((0, 1), (1, 2)) for c in range(3))
    for samples in (V.all_words(sizes), V.all_samples(sizes)):
        assert dict(rows(V.coloring_energy(vertices, edges, samples, 3, 1.5, 0.5), "sample_id", "energy")) == want
