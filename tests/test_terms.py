"""Term algebra on hand-written cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions.pairs import pair_rank, pair_unrank
from bitloom.operators import encoders as E
from bitloom.operators import ising as S
from bitloom.operators import terms as T
from bitloom.operators.energy import all_samples, energy
from bitloom.operators.pairing import pairs_within
from bitloom.schemas import KEY, Batch

A = ("a", "x")


def test_duplicates_reversed_and_diagonal_terms(table, rows):
    quadratic = table([(*A, 0, 1, 1.0), (*A, 1, 0, 2.0), (*A, 2, 2, 5.0), (*A, 1, 2, -3.0)],
                      "i long, j long, v double")
    linear = table([(*A, 2, -1.0)], "i long, v double")
    off, lin = T.fold_diagonal(quadratic, linear)
    assert rows(T.accumulate(off), "i", "j", "v") == [(0, 1, 3.0), (1, 2, -3.0)]
    assert rows(lin, "i", "v") == [(2, 4.0)]


def test_tiny_terms_are_dropped_after_summing(table, rows):
    quadratic = table([(*A, 0, 1, 1.0), (*A, 0, 1, -1.0), (*A, 0, 2, 1e-12), (*A, 1, 2, 1.1e-12)],
                      "i long, j long, v double")
    assert rows(T.drop_tiny(T.accumulate(quadratic)), "i", "j") == [(1, 2)]


def test_accumulation_does_not_depend_on_order_or_partitioning(table, rows):
    rng = random.Random(1)
    data = [(*A, rng.randrange(6), rng.randrange(6), float(rng.randrange(-5, 6))) for _ in range(200)]
    one = table(data, "i long, j long, v double")
    rng.shuffle(data)
    two = table(data, "i long, j long, v double").repartition(7)
    assert rows(T.accumulate(one), "i", "j", "v") == rows(T.accumulate(two), "i", "j", "v")


def test_square_and_product_against_brute_force(table, rows):
    members = table([(*A, 7, 0, 1.0), (*A, 7, 1, -2.0), (*A, 7, 2, 3.0), (*A, 8, 1, 1.0)],
                    "constraint_id long, i long, a double")
    constraints = table([(*A, 7, 2.0, -1.0), (*A, 8, 1.0, 4.0)],
                        "constraint_id long, weight double, constant double")
    offset, linear, quadratic = T.square_terms(constraints, members)
    sizes = table([(*A, 3)], "num_variables long")
    batch = Batch(E.instances_of(sizes, "t", offset), linear, quadratic)
    got = {r.sample_id: r.energy for r in energy(batch, all_samples(batch.instances)).collect()}
    for s in range(8):
        x = [(s >> k) & 1 for k in range(3)]
        assert got[s] == 2 * (-1 + x[0] - 2 * x[1] + 3 * x[2]) ** 2 + (4 + x[1]) ** 2

    products = table([(*A, 1, 2.0, 1.0, -1.0)], "product_id long, weight double, c1 double, c2 double")
    left = table([(*A, 1, 0, 2.0), (*A, 1, 1, 1.0)], "product_id long, i long, a double")
    right = table([(*A, 1, 1, 3.0), (*A, 1, 2, -1.0)], "product_id long, i long, a double")
    offset, linear, quadratic = T.product_terms(products, left, right)
    batch = Batch(E.instances_of(sizes, "t", offset), linear, quadratic)
    got = {r.sample_id: r.energy for r in energy(batch, all_samples(batch.instances)).collect()}
    for s in range(8):
        x = [(s >> k) & 1 for k in range(3)]
        assert got[s] == 2 * (1 + 2 * x[0] + x[1]) * (-1 + 3 * x[1] - x[2])


def test_pair_rank_round_trip_near_row_ends(spark):
    for n in (2, 3, 1000, 10_000_000):
        points = sorted({(i, j) for i in (0, 1, n // 2, n - 2) for j in (i + 1, n - 1) if i < j < n})
        df = spark.createDataFrame(points, "i long, j long").withColumn("n", F.lit(n).cast("long"))
        ranked = df.withColumn("r", pair_rank(F.col("i"), F.col("j"), F.col("n")))
        back = ranked.withColumn("b", pair_unrank(F.col("r"), F.col("n")))
        assert all((r.i, r.j) == (r.b.i, r.b.j) for r in back.collect())
    small = spark.range(45).select(pair_unrank(F.col("id"), F.lit(10)).alias("b")).collect()
    assert [(r.b.i, r.b.j) for r in small] == list(itertools.combinations(range(10), 2))


@pytest.mark.parametrize("capacity", [1, 2, 3, 5, 8, 13, 100])
def test_slack_weights_cover_every_value(table, rows, capacity):
    weights = [w for _, w in rows(T.slack_weights(table([(*A, capacity)], "capacity long")), "k", "weight")]
    sums = {sum(c) for n in range(len(weights) + 1) for c in itertools.combinations(weights, n)}
    assert sums == set(range(capacity + 1))


def test_index_variables_is_contiguous_per_instance(spark):
    df = spark.range(5000).select(
        F.lit("a").alias("batch"), (F.col("id") % 3).cast("string").alias("instance_id"),
        (F.col("id") * 7919 % 5003).alias("name"))
    got = T.index_variables(df, ["name"]).collect()
    for k in "012":
        part = sorted((r.name, r.i) for r in got if r.instance_id == k)
        assert [i for _, i in part] == list(range(len(part)))


def test_digest_ignores_row_order_and_sees_changes(table, rows):
    data = [(*A, i, j, float(i + j)) for i in range(300, 330) for j in range(i + 1, 700, 40)]
    sizes = table([(*A, 700)], "num_variables long")
    empty = table([], "i long, v double")

    def digest(terms):
        batch = Batch(E.instances_of(sizes, "t"), empty, table(terms, "i long, j long, v double"))
        return rows(T.content_digest(batch), "digest")

    shuffled = data[:]
    random.Random(3).shuffle(shuffled)
    changed = data[:-1] + [(*data[-1][:4], data[-1][4] + 1)]
    assert digest(data) == digest(shuffled) != digest(changed)


def test_instance_ids(table):
    instances = table([("a", "x", "max_cut", 3, {"b": "1", "a": "2"}), ("a", "y", "max_cut", 3, {"a": "2", "b": "1"}),
                       ("a", "z", "random_qubo", 9, {})],
                      "problem_type string, seed long, parameters map<string,string>")
    digests = table([("a", k, "d") for k in "xyz"], "digest string")
    ids = {r.instance_id: r.new_id for r in T.instance_ids(instances, digests).collect()}
    assert ids["x"] == ids["y"] and ids["x"].startswith("max_cut-") and len(ids["x"]) == 8 + 16
    assert ids["z"] == "seed_9"


def test_spin_round_trip_keeps_energies(table):
    linear = table([(*A, 0, 3.0), (*A, 2, -1.0)], "i long, v double")
    quadratic = table([(*A, 0, 1, 2.0), (*A, 1, 2, -5.0)], "i long, j long, v double")
    sizes, offsets = table([(*A, 3)], "num_variables long"), table([(*A, 4.0)], "offset double")
    batch = Batch(E.instances_of(sizes, "t", offsets), linear, quadratic)
    fields, couplings, constant = S.to_ising(batch)
    offset, lin, quad = S.from_ising(fields, couplings)
    offset = offset.join(constant, KEY).select(*KEY, (F.col("offset") + F.col("constant")).alias("offset"))
    back = Batch(E.instances_of(sizes, "t", offset), lin, quad)
    samples = all_samples(batch.instances)
    one = {r.sample_id: r.energy for r in energy(batch, samples).collect()}
    two = {r.sample_id: r.energy for r in energy(back, samples).collect()}
    assert one == pytest.approx(two) and len(one) == 8


def test_large_groups_are_paired_in_cells(spark):
    df = spark.range(57).select(F.lit("g").alias("g"), F.col("id").alias("u"))
    got = pairs_within(df, ["g"], "u", cell=10).select("u_a", "u_b").collect()
    assert sorted(map(tuple, got)) == list(itertools.combinations(range(57), 2))


def test_linearized_rows_force_products(table, rows):
    linear = table([(*A, 0, 1.0)], "i long, v double")
    quadratic = table([(*A, 0, 1, 2.0)], "i long, j long, v double")
    batch = Batch(E.instances_of(table([(*A, 2)], "num_variables long"), "t"), linear, quadratic)
    columns, limits, cells = S.linearize(batch)
    assert rows(columns, "col", "cost", "is_integer") == [(0, 1.0, True), (1, 0.0, True), (2, 2.0, False)]
    matrix = {(r, c): v for r, c, v in rows(cells, "row", "col", "value")}
    bounds = {r.row: (r.lower, r.upper) for r in limits.collect()}
    for x0, x1 in itertools.product((0, 1), repeat=2):
        feasible = []
        for y in (0, 1):
            point = [x0, x1, y]
            value = {r: sum(matrix.get((r, c), 0) * point[c] for c in range(3)) for r in range(3)}
            if all((lo is None or value[r] >= lo) and (hi is None or value[r] <= hi)
                   for r, (lo, hi) in bounds.items()):
                feasible.append(y)
        assert feasible == [x0 * x1]


def test_coupling_products_of_many_states(table, rows):
    from bitloom.operators.ising import coupling_product

    couplings = table([("a", "x", 0, 1, 2.0), ("a", "x", 1, 2, -3.0), ("a", "x", 0, 2, 0.5)], "i long, j long, coupling double")
    values = [[((7 * i + 3 * s) % 5) - 2.0 for s in range(19)] for i in range(3)]
    values[2][4] = None
    states = table([("a", "x", i, v) for i, v in enumerate(values)] + [("a", "y", 0, [])], "i long, values array<double>")
    matrix = [[0, 2.0, 0.5], [2.0, 0, -3.0], [0.5, -3.0, 0]]
    want = [(i, s, sum(matrix[i][j] * values[j][s] for j in range(3) if j != i and values[j][s] is not None))
            for i in range(3) for s in range(19)]
    assert rows(coupling_product(couplings, states), "i", "state", "value") == want
