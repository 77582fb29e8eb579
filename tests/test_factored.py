"""Unexpanded squares against the models they stand for."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import encoders as E
from bitloom.operators import factored as Q
from bitloom.operators.energy import all_samples, energy
from bitloom.operators.ising import interaction_scale, to_ising
from bitloom.operators.ranges import spread_range
from bitloom.operators.validation import term_facts
from bitloom.schemas import KEY, Batch
from bitloom.session import configure


@pytest.fixture(scope="module")
def model(spark):
    """Random models; some without sparse terms, pairs, members, or with pairs that cancel the square."""
    rng = random.Random(3)
    instances, linear, quadratic, squares, members = [], [], [], [], []
    for k in range(24):
        name, n = f"m{k:02d}", rng.randrange(1, 8)
        instances.append(("t", name, "x", n, float(rng.randrange(-3, 4))))
        weight = rng.choice([0.5, 1.0, 2.0, -1.5])
        squares.append(("t", name, weight, float(rng.randrange(-4, 5))))
        a = {i: float(rng.choice([-2, -1, 0, 1, 1, 3])) for i in range(n) if rng.random() < 0.85}
        if k % 6 == 5:
            a = dict.fromkeys(range(n), 1.0)
        members += [("t", name, i, x) for i, x in a.items()]
        linear += [("t", name, i, float(rng.randrange(-5, 6))) for i in range(n) if rng.random() < 0.5 and k % 3]
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < 0.5 and k % 4:
                cancel = -2.0 * weight * a.get(i, 0.0) * a.get(j, 0.0)
                quadratic.append(("t", name, i, j, cancel if rng.random() < 0.5 and cancel else float(rng.randrange(1, 6))))
    key = "batch string, instance_id string, "
    make = spark.createDataFrame
    batch = Batch(make(instances, key + "problem_type string, num_variables long, offset double"),
                  make(linear, key + "i long, v double").where("v <> 0"), make(quadratic, key + "i long, j long, v double"))
    return Q.Factored(batch, make(squares, key + "weight double, constant double"), make(members, key + "i long, a double"))


def table(df, *names):
    return {tuple(r[k] for k in names[:-1]): r[names[-1]] for r in df.collect()}


def test_energies(model):
    samples = all_samples(model.sparse.instances)
    names = ("instance_id", "sample_id", "energy")
    assert table(Q.factored_energy(model, samples), *names) == pytest.approx(table(energy(Q.expand(model), samples), *names))


def test_spin_form(model):
    spins, (fields, couplings, constant) = Q.factored_ising(model), to_ising(Q.expand(model))
    got, want = table(spins.fields, "instance_id", "i", "h"), table(fields, "instance_id", "i", "h")
    assert all(got.get(k, 0.0) == pytest.approx(want.get(k, 0.0)) for k in got.keys() | want.keys())
    assert table(spins.constant, "instance_id", "constant") == pytest.approx(table(constant, "instance_id", "constant"))
    pairs = Q._with_members(couplings, spins.loadings, "b").join(spins.weights, KEY).select(
        "instance_id", "i", "j", (F.col("coupling") - 2 * F.col("weight") * F.col("b_i") * F.col("b_j")).alias("c"))
    rest, sparse = table(pairs, "instance_id", "i", "j", "c"), table(spins.couplings, "instance_id", "i", "j", "coupling")
    assert all(rest[k] == pytest.approx(sparse.get(k, 0.0)) for k in rest)
    scales = table(Q.factored_scale(spins, model.sparse.instances), "instance_id", "scale")
    assert scales == pytest.approx(table(interaction_scale(fields, couplings, model.sparse.instances), "instance_id", "scale"))


def test_statistics(model):
    got = {r["instance_id"]: r.asDict() for r in Q.factored_facts(model).collect()}
    want = {r["instance_id"]: r.asDict() for r in term_facts(Q.expand(model)).collect()}
    assert got.keys() == want.keys()
    for name, row in want.items():
        for column, value in row.items():
            assert got[name][column] == (value if isinstance(value, str) or value is None else pytest.approx(value, abs=1e-6)), (name, column)


def test_linear_model(model):
    """With x fixed, the rows leave one value to every other column, and costs add up to the energy."""
    columns, rows, nonzeros, offset = (df.collect() for df in Q.factored_linear(model))
    want = table(energy(Q.expand(model), all_samples(model.sparse.instances)), "instance_id", "sample_id", "energy")
    sizes = table(model.sparse.instances, "instance_id", "num_variables")
    offsets = {r["instance_id"]: r["offset"] for r in offset}
    for (name, sample), value in want.items():
        if sample % 5 > 1:
            continue
        cols = {r["col"]: r for r in columns if r["instance_id"] == name}
        bounds = {r["row"]: (r["lower"], r["upper"]) for r in rows if r["instance_id"] == name}
        cells = {}
        for r in nonzeros:
            if r["instance_id"] == name:
                cells.setdefault(r["row"], {})[r["col"]] = r["value"]
        assert sorted(cols) == list(range(len(cols))) and set(cells) <= set(bounds)
        n = sizes[name,]
        span = {c: [float(sample >> c & 1)] * 2 if c < n else [cols[c]["lower"], cols[c]["upper"]] for c in cols}
        for _ in range(2 * n + 3):  # bounds tighten along the chain, last member first
            for row, terms in cells.items():
                lower, upper = bounds[row]
                for c, v in terms.items():
                    others = [sorted((w * span[d][0], w * span[d][1])) for d, w in terms.items() if d != c]
                    ends = []
                    if upper is not None:
                        ends.append((upper - sum(o[0] for o in others), v > 0))
                    if lower is not None:
                        ends.append((lower - sum(o[1] for o in others), v < 0))
                    for end, above in ends:
                        side = int(above)
                        span[c][side] = (min if above else max)(span[c][side], end / v)
        assert all(high - low < 1e-9 for low, high in span.values())
        assert offsets[name] + sum(cols[c]["cost"] * span[c][0] for c in cols) == pytest.approx(value)


def test_factored_families(spark):
    rng = random.Random(9)
    key = "batch string, instance_id string, "
    names = [("t", f"k{k}") for k in range(6)]
    numbers = spark.createDataFrame([(*k, i, rng.randrange(1, 30)) for k in names for i in range(5)], key + "i long, value long")
    vertices = spark.createDataFrame([(*k, i, rng.randrange(1, 9)) for k in names for i in range(5)], key + "u long, value long")
    edges = spark.createDataFrame([(*k, i, j, 1.0) for n, k in enumerate(names) for i, j in itertools.combinations(range(5), 2)
                                   if rng.random() < n / 5], key + "u long, v long, w double")
    items = spark.createDataFrame([(*k, i, rng.randrange(1, 5), rng.randrange(1, 9)) for k in names for i in range(3)],
                                  key + "i long, weight long, value long")
    bonuses = spark.createDataFrame([(*k, 0, 2, rng.randrange(1, 5)) for k in names[:4]], key + "i long, j long, v long")
    sizes = spark.createDataFrame([(*k, 5) for k in names], key + "num_variables long")
    for got, want in ((Q.factor_partition(numbers), E.encode_partition(numbers)),
                      (Q.factor_clique(vertices, edges, sizes=sizes), E.encode_clique(vertices, edges, sizes=sizes)[0]),
                      (Q.factor_knapsack(items, bonuses)[0], E.encode_knapsack(items, bonuses)[0])):
        whole = Q.expand(got)
        for a, b, columns in ((whole.instances, want.instances, ("instance_id", "offset")),
                              (whole.linear, want.linear, ("instance_id", "i", "v")),
                              (whole.quadratic, want.quadratic, ("instance_id", "i", "j", "v"))):
            assert table(a, *columns) == pytest.approx(table(b, *columns))


def test_a_million_variables(spark):
    """Half a million million pairs: sums, statistics and a linear model without any of them."""
    size = spark.createDataFrame([("t", "big", 1_000_000)], "batch string, instance_id string, num_variables long")
    numbers = spread_range(size, "num_variables", "i").select(*KEY, "i", (F.col("i") % 100 + 1).alias("value"))
    model = Q.factor_partition(numbers, size)
    samples = numbers.select(*KEY, F.lit(0).cast("bigint").alias("sample_id"), "i", (F.col("i") % 2).alias("x"))
    total, odd = 10_000 * 5050, 10_000 * 2550
    assert Q.factored_energy(model, samples).collect()[0]["energy"] == (2 * odd - total) ** 2
    facts = Q.factored_facts(model).collect()[0]
    assert facts["qubo_quadratic_terms"] == 1_000_000 * 999_999 // 2 and facts["qubo_inactive_variables"] == 0
    assert facts["qubo_coefficient_statistics.max"] == 80_000.0
    columns, rows, nonzeros, _ = Q.factored_linear(model)
    assert columns.count() == 3_000_000 and rows.count() == 5_000_000
    assert nonzeros.count() <= 13_000_000


def test_statistics_deal_an_instance_over_tasks(spark, table):
    """No step over couplings runs in one task per instance: its rows are dealt by variable, too."""
    edges = table([("t", "a", u, u + 1, 1.0) for u in range(50)], "u long, v long, w double")
    vertices = table([("t", "a", u, u % 7 + 1) for u in range(60)], "u long, value long")
    plan = Q.factored_stats(Q.factor_clique(vertices, edges))._jdf.queryExecution().executedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    ranked = [k for k, line in enumerate(lines) if line.startswith("Window")]
    assert ranked
    for k in ranked:
        below = next(line for line in lines[k:] if line.startswith("Exchange"))
        assert ", i#" in below or ", side#" in below, below


def test_facts_of_one_instance_are_broadcast(spark, table):
    """A join with the facts of a few instances leaves their rows where they are."""
    configure(spark)
    rows = table([("t", "a", u, 1.0) for u in range(5000)], "i long, a double").repartition(8)
    facts = rows.groupBy(*KEY).agg(F.sum("a").alias("total"))
    joined = rows.join(facts, KEY)
    assert joined.count() == 5000
    final = joined.select(F.sum(F.col("a") * F.col("total")))
    assert final.collect()[0][0] == 25e6
    assert "BroadcastHashJoin" in final._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
