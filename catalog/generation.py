"""Synthetic data (G-1 .. G-15) for grids of instances taken from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import generate as G
from bitloom.operators import validation as C
from bitloom.operators.generate import (
    CLAUSES, COUPLINGS, FALLBACK, FIELDS, FLIP, LINEAR, MEMBERS, PAIRS, PLANT, SIGNS, VALUES,
    WEIGHTS,
)
from bitloom.schemas import KEY
from catalog.base import query


def h(seed: str, i: str, j: str) -> str:
    """Portable hash as SQL text."""
    z = f"((({seed})*1000003 + ({i})*48271 + ({j})*69621 + 12345) % 2147483647)"
    z = f"(({z}*{z} + {z}*16807 + 11) % 2147483647)"
    z = f"(({z}*{z} + {z}*48271 + ({i}) + 7) % 2147483647)"
    return f"(({z}*69621 + ({j}) + 3) % 2147483647)"


def unit(seed: str, i: str, j: str) -> str:
    return f"({h(seed, i, j)} / 2147483647.0::DOUBLE)"


def span(n: str) -> str:
    return f"unnest(generate_series(CAST(0 AS BIGINT), CAST({n} AS BIGINT) - 1))"


# One instance per customer: seed = key, 2..26 vertices, density by nation.
GRID = """
SELECT 'generated' AS batch, CAST(c_custkey AS STRING) AS instance_id, c_custkey AS seed,
       CAST(c_nationkey + 2 AS BIGINT) AS n, CAST(c_nationkey AS DOUBLE) / 24 AS density
FROM {customer}"""
_N = f"g AS ({GRID}), a AS (SELECT *, {span('n')} AS i FROM g)"


@query("g1_seed_grid", f"""
SELECT batch, concat('seed_', CAST(s + idx AS VARCHAR)) AS instance_id, idx AS "index", s + idx AS seed FROM (
  SELECT c_mktsegment AS batch, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey*1000000 END AS s,
         {span('c_nationkey % 4 + 1')} AS idx FROM customer) t""")
def g1(v):
    entries = v.customer.select(
        F.col("c_mktsegment").alias("batch"), F.col("c_custkey").alias("entry"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("seed"),
        (F.col("c_nationkey") % 4 + 1).cast("bigint").alias("count"))
    return G.seed_grid(entries).select(*KEY, "index", "seed")


def pair_sql(grid: str) -> str:
    """Pairs by running gaps: blocks of 65,536 ranks, runs of about 8 hits, up to 64 gaps each, then rank by rank."""
    gap = f"greatest(1, CAST(ceil(ln(1.0 - {{u}}) / ln(1.0 - density)) AS BIGINT))"
    first = gap.replace("{u}", unit("seed", "first", str(PAIRS + 1)))
    later = gap.replace("{u}", unit("seed", "(first + k + 1)", str(PAIRS + 1)))
    return f"""
WITH RECURSIVE g AS (SELECT *, n*(n - 1)//2 AS total FROM ({grid}) q WHERE density > 0 AND n > 1),
b AS (SELECT *, least(65536, total - block*65536) AS bsize,
        CAST(greatest(1, least(CAST(least(65536, total - block*65536) AS DOUBLE), ceil(8.0 / density))) AS BIGINT) AS run
      FROM (SELECT *, unnest(range(0, (total - 1)//65536 + 1)) AS block FROM g WHERE density < 1) x),
r AS (SELECT batch, instance_id, seed, n, density, block*65536 + off AS first, least(run, bsize - off) AS size
      FROM (SELECT *, unnest(range(0, bsize, run)) AS off FROM b) y),
w AS (SELECT *, CAST(0 AS BIGINT) AS k, -1 + {first} AS pos FROM r
      UNION ALL SELECT batch, instance_id, seed, n, density, first, size, k + 1, pos + {later} FROM w WHERE pos < size AND k < 63),
tail AS (SELECT *, unnest(range(pos + 1, size)) AS x FROM w WHERE k = 63 AND pos < size),
hits AS (SELECT batch, instance_id, n, first + pos AS rank FROM w WHERE pos < size
  UNION ALL SELECT batch, instance_id, n, first + x FROM tail WHERE {unit('seed', '(first + x)', str(PAIRS + 2))} < density
  UNION ALL SELECT batch, instance_id, n, unnest(range(0, total)) FROM g WHERE density >= 1),
p AS (SELECT *, CAST(floor(((2*n - 1) - sqrt(CAST((2*n - 1)*(2*n - 1) - 8*rank AS DOUBLE))) / 2) AS BIGINT) AS i0 FROM hits),
q AS (SELECT *, CASE WHEN (i0 + 1)*(2*n - i0 - 2)//2 <= rank THEN i0 + 1 WHEN i0*(2*n - i0 - 1)//2 > rank THEN i0 - 1 ELSE i0 END AS i FROM p)
SELECT batch, instance_id, i, rank - i*(2*n - i - 1)//2 + i + 1 AS j FROM q"""


_PAIR_SQL = pair_sql(GRID)

@query("g2_sample_pairs", _PAIR_SQL)
def g2(v):
    return G.sample_pairs(v.sql(GRID)).select(*KEY, "i", "j")


@query("g3_sample_pairs_sparse", pair_sql("""
SELECT 'sparse' AS batch, CAST(s_suppkey AS VARCHAR) AS instance_id, s_suppkey AS seed,
       CAST(s_nationkey + 1500 AS BIGINT) AS n, 0.0005::DOUBLE AS density FROM supplier"""))
def g3(v):
    # 1.1 million pairs and more per instance, one in two thousand of them present
    grid = v.supplier.select(
        F.lit("sparse").alias("batch"), F.col("s_suppkey").cast("string").alias("instance_id"),
        F.col("s_suppkey").alias("seed"), (F.col("s_nationkey") + 1500).cast("bigint").alias("n"),
        F.lit(0.0005).alias("density"))
    return G.sample_pairs(grid).select(*KEY, "i", "j")


@query("g4_coefficients_integer", f"""
SELECT batch, instance_id, u AS i, v AS j,
       CAST(-10 + {h(f'(CAST(instance_id AS BIGINT))*128 + {WEIGHTS}', 'u', 'v')} % 21 AS DOUBLE) AS v
FROM {{edges}}""")
def g4(v):
    rows = v.edges.select(*KEY, F.col("instance_id").cast("bigint").alias("seed"),
                          F.col("u").alias("i"), F.col("v").alias("j"))
    return G.coefficients(rows, "integer", F.col("i"), F.col("j")).drop("seed")


@query("g4_coefficients_uniform", f"""
SELECT batch, instance_id, u AS i, v AS j,
       round(-1 + 2*{unit(f'(CAST(instance_id AS BIGINT))*128 + {WEIGHTS}', 'u', 'v')}, 9) AS v
FROM {{edges}}""")
def g4_uniform(v):
    rows = v.edges.select(*KEY, F.col("instance_id").cast("bigint").alias("seed"),
                          F.col("u").alias("i"), F.col("v").alias("j"))
    return G.coefficients(rows, "uniform", F.col("i"), F.col("j"), -1, 1).withColumn(
        "v", F.round("v", 9)).drop("seed")


@query("g5_random_linear", f"""
WITH {_N}
SELECT batch, instance_id, i, CAST(-10 + {h(f'(seed)*128 + {LINEAR}', 'i', '0')} % 21 AS DOUBLE) AS v
FROM a WHERE {unit('seed', 'i', str(LINEAR))} >= 0.3""")
def g5(v):
    return G.random_linear(v.sql(GRID), zero_probability=0.3)


@query("g6_erdos_renyi", _PAIR_SQL.replace("SELECT batch, instance_id, i, rank - i*(2*n - i - 1)//2 + i + 1 AS j FROM q",
                                           "SELECT batch, instance_id, i AS u, rank - i*(2*n - i - 1)//2 + i + 1 AS v FROM q"))
def g6(v):
    return G.erdos_renyi(v.sql(GRID))


@query("g7_random_regular")
def g7(v):
    grid = v.supplier.select(
        F.lit("regular").alias("batch"), F.col("s_suppkey").cast("string").alias("instance_id"),
        F.col("s_suppkey").alias("seed"), (2 * F.col("s_nationkey") + 16).cast("bigint").alias("n"),
        F.lit(3).cast("bigint").alias("degree"))
    return G.random_regular(grid)


@query("g8_cycle_graph", f"""
WITH {_N}
SELECT batch, instance_id, least(i, (i + 1) % n) AS u, greatest(i, (i + 1) % n) AS v
FROM a WHERE n > 2 OR i = 0""")
def g8(v):
    return G.cycle_graph(v.sql(GRID))


@query("g8_complete_graph", f"""
WITH {_N} SELECT batch, instance_id, i AS u, j AS v FROM (SELECT a.*, {span('n')} AS j FROM a) t WHERE i < j""")
def g8_complete(v):
    return G.complete_graph(v.sql(GRID))


@query("g9_random_integers", f"""
WITH {_N}
SELECT batch, instance_id, i, 1 + {h(f'(seed)*128 + {VALUES}', 'i', '0')} % n AS value FROM a""")
def g9(v):
    from bitloom.operators.ranges import spread_range

    rows = spread_range(v.sql(GRID), "n", "i")
    return G.random_integers(rows, "value", F.col("i"), 1, F.col("n")).select(*KEY, "i", "value")


@query("g10_random_sets", f"""
WITH {_N},
m AS (SELECT *, {span('20')} AS element FROM a),
r AS (SELECT * FROM m WHERE {unit(f'(seed)*128 + {MEMBERS}', 'i', 'element')} < density / 4)
SELECT batch, instance_id, i AS set_id, element FROM r
UNION ALL SELECT batch, instance_id, i, {h(f'(seed)*128 + {FALLBACK}', 'i', '0')} % 20
FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.instance_id = a.instance_id AND r.i = a.i)""")
def g10(v):
    grid = v.sql(GRID).withColumn("universe_size", F.lit(20).cast("bigint")).withColumn(
        "density", F.col("density") / 4)
    return G.random_sets(grid, "n", "universe_size", "density")


@query("g11_random_clauses", f"""
WITH g AS ({GRID}), a AS (SELECT batch, instance_id, seed, n + 3 AS n, {span('n + 3')} AS c FROM g),
d AS (SELECT *, {h(f'(seed)*128 + {CLAUSES}', 'c', '0')} % n AS a0, {h(f'(seed)*128 + {CLAUSES}', 'c', '1')} % (n - 1) AS d1,
             {h(f'(seed)*128 + {CLAUSES}', 'c', '2')} % (n - 2) AS d2 FROM a),
e AS (SELECT *, CASE WHEN d1 >= a0 THEN d1 + 1 ELSE d1 END AS a1 FROM d),
f AS (SELECT *, CASE WHEN d2 >= least(a0, a1) THEN d2 + 1 ELSE d2 END AS b2 FROM e),
k AS (SELECT *, CASE WHEN b2 >= greatest(a0, a1) THEN b2 + 1 ELSE b2 END AS a2 FROM f),
p AS (SELECT *, {span('3')} AS pos FROM k)
SELECT batch, instance_id, c AS clause_id, pos, CASE pos WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS variable,
       {h(f'(seed)*128 + {SIGNS}', 'c', 'pos')} % 2 = 1 AS negated FROM p""")
def g11(v):
    grid = v.sql(GRID).withColumn("n", F.col("n") + 3)
    return G.random_clauses(grid, 3, "n", "n")


_SAT_GRID = "SELECT batch, instance_id, CAST(instance_id AS BIGINT) AS seed, num_variables AS n FROM {small_clause_sizes}"


@query("g12_plant", f"""
WITH g AS ({_SAT_GRID}),
p AS (SELECT instance_id, i, {h(f'(seed)*128 + {PLANT}', 'i', '0')} % 2 AS x FROM (SELECT *, {span('n')} AS i FROM g) t),
l AS (SELECT l.*, p.x, (p.x = 1) <> negated AS ok, g.seed FROM {{small_literals}} l
      JOIN p ON p.instance_id = l.instance_id AND p.i = l.variable JOIN g ON g.instance_id = l.instance_id),
c AS (SELECT instance_id, clause_id, bool_or(ok) AS ok, count(*) AS size FROM l GROUP BY ALL)
SELECT l.batch, l.instance_id, l.clause_id, l.pos, l.variable,
  CASE WHEN NOT c.ok AND l.pos = {h(f'(l.seed)*128 + {FLIP}', 'l.clause_id', '0')} % c.size THEN l.x = 0 ELSE l.negated END AS negated
FROM l JOIN c USING (instance_id, clause_id)""")
def g12(v):
    v.keep("small_clauses")
    grid = v.sql(_SAT_GRID)
    return G.plant(v.small_literals, G.planted_assignment(grid), grid)


@query("g13_random_couplings", f"""
SELECT batch, instance_id, u AS i, v AS j,
  CASE WHEN {h(f'(CAST(instance_id AS BIGINT))*128 + {COUPLINGS}', 'u', 'v')}*2 < 2147483647 THEN -1.0::DOUBLE ELSE 1.0 END AS coupling
FROM {{route_edges}}""")
def g13(v):
    v.keep("route_edges")
    seeds = v.route_sizes.select(*KEY, F.col("instance_id").cast("bigint").alias("seed"))
    return G.random_couplings(v.route_edges, seeds)


@query("g13_random_fields", f"""
WITH {_N}
SELECT batch, instance_id, i, CASE WHEN {unit(f'(seed)*128 + {FIELDS}', 'i', '0')} < 0.4
  THEN CASE WHEN {h(f'(seed)*128 + {FIELDS}', 'i', '1')}*2 < 2147483647 THEN -1.5::DOUBLE ELSE 1.5 END ELSE 0.0 END AS h FROM a""")
def g13_fields(v):
    return G.random_fields(v.sql(GRID), probability=0.4, scale=1.5)


@query("g14_random_items", f"""
WITH {_N}
SELECT batch, instance_id, i, 1 + {h(f'(seed)*128 + {WEIGHTS}', 'i', '0')} % 20 AS weight,
       1 + {h(f'(seed)*128 + {VALUES}', 'i', '0')} % 30 AS value FROM a""")
def g14(v):
    return G.random_items(v.sql(GRID))


@query("g14_random_bonuses", f"""
SELECT batch, instance_id, i, j, 1 + {h(f'(CAST(instance_id AS BIGINT))*128 + {VALUES + 1}', 'i', 'j')} % 10 AS v
FROM ({_PAIR_SQL}) p""")
def g14_bonuses(v):
    return G.random_bonuses(v.sql(GRID))


_ATTEMPTS = f"""
SELECT a AS batch, instance_id, seed + a*1000000000 AS seed, n, density FROM ({GRID}) g, range(0, 5) r(a)"""


@query("g15_generate_accepted", f"""
WITH e AS ({pair_sql(_ATTEMPTS)}),
k AS (SELECT instance_id, batch AS a, count(DISTINCT u) AS touched FROM (
        SELECT instance_id, batch, i AS u FROM e UNION ALL SELECT instance_id, batch, j FROM e) x GROUP BY ALL),
ok AS (SELECT g.instance_id, min(k.a) AS a FROM ({GRID}) g JOIN k ON k.instance_id = g.instance_id
       WHERE touched = n GROUP BY ALL)
SELECT g.batch, g.instance_id, seed + coalesce(ok.a, 4)*1000000000 AS seed, ok.a IS NOT NULL AS accepted
FROM ({GRID}) g LEFT JOIN ok USING (instance_id)""")
def g15(v):
    """Random graphs regenerated until no vertex is isolated, as far as five attempts go."""
    grid = v.sql(GRID)

    def judge(edges, now):
        sizes = now.select(*KEY, F.col("n").alias("num_vertices"))
        facts = C.graph_facts(edges, sizes)
        return C.issues(facts, [("isolated_vertices", F.col("isolated_vertices"))], "warning")

    accepted, failed = G.generate_accepted(grid, G.erdos_renyi, judge, ["isolated_vertices"], 5)
    return accepted.select(*KEY, "seed", F.lit(True).alias("accepted")).unionByName(
        failed.select(*KEY, "seed", F.lit(False).alias("accepted")))


