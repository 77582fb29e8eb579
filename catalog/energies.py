"""Energies and independent objectives (V-1 .. V-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import encoders as E
from bitloom.operators import energy as V
from bitloom.operators.exact import exact_checkpoints, exact_minimum
from bitloom.operators.terms import union
from bitloom.schemas import KEY
from bitloom.session import cut
from catalog.base import query
from catalog.encoders import KNAPSACK


def _by_samples(edges: str, samples: str, value: str) -> str:
    """Sum of an expression over edges with both ends' bits ``s.x`` and ``t.x``."""
    return f"""
SELECT e.batch, e.instance_id, s.sample_id, CAST(sum({value}) AS DOUBLE) AS e
FROM {{{edges}}} e JOIN {{{samples}}} s ON s.instance_id = e.instance_id AND s.i = e.u
JOIN {{{samples}}} t ON t.instance_id = e.instance_id AND t.i = e.v AND t.sample_id = s.sample_id
GROUP BY ALL"""


_IDS = "SELECT DISTINCT batch, instance_id, sample_id FROM {%s}"


@query("v1_energy", f"""
WITH c AS ({_by_samples('edges', 'samples', '2*e.w*s.x*t.x - e.w*s.x - e.w*t.x')})
SELECT batch, instance_id, sample_id, e AS energy FROM c""")
def v1(v):
    v.keep("edges", "samples")
    return V.energy(E.encode_max_cut(v.edges, v.sizes), v.samples)


@query("v2_sample_issues", """
WITH s AS (SELECT batch, instance_id, sample_id, i, x + CASE WHEN i % 7 = 0 AND sample_id = 3 THEN 2 ELSE 0 END AS x
           FROM {route_samples} WHERE NOT (i = 4 AND sample_id = 1)),
f AS (SELECT batch, instance_id, sample_id, count(*) AS n, count(*) FILTER (WHERE x NOT IN (0, 1)) AS bad
      FROM s GROUP BY ALL)
SELECT batch, instance_id, sample_id, 'wrong_sample_length' AS code FROM f WHERE n <> 12
UNION ALL SELECT batch, instance_id, sample_id, 'nonbinary_sample' FROM f WHERE bad > 0""")
def v2(v):
    # break some samples: a missing position in sample 1, values above 1 in sample 3
    broken = v.route_samples.where("NOT (i = 4 AND sample_id = 1)").withColumn(
        "x", F.col("x") + F.when((F.col("i") % 7 == 0) & (F.col("sample_id") == 3), 2).otherwise(0))
    batch = E.encode_max_cut(v.route_edges, v.route_sizes)
    return V.sample_issues(batch, broken)


@query("v3_best_sample", f"""
WITH c AS ({_by_samples('route_edges', 'route_samples', 'CASE WHEN s.x <> t.x THEN -e.w ELSE 0 END')}),
a AS (SELECT i.*, coalesce(e, 0.0) AS e FROM (SELECT DISTINCT batch, instance_id, sample_id FROM {{route_samples}}) i
      LEFT JOIN c USING (batch, instance_id, sample_id))
SELECT batch, instance_id, arg_min(sample_id, (e, sample_id)) FILTER (e IS NOT NULL) AS sample_id, min(e) AS energy
FROM (SELECT batch, instance_id, sample_id, CASE WHEN (CAST(instance_id AS BIGINT) + sample_id) % 3 <> 0
        AND CAST(instance_id AS BIGINT) % 11 <> 0 THEN e END AS e FROM a) b GROUP BY ALL""")
def v3(v):
    v.keep("route_edges")
    scored = V.energy(E.encode_max_cut(v.route_edges, v.route_sizes), v.route_samples)
    # some energies are missing, others are not numbers, and some instances have no energy at all
    key = F.col("instance_id").cast("bigint")
    gap = F.when(F.col("sample_id") % 2 == 0, F.lit(float("nan")))
    return V.best_sample(scored.withColumn("energy", F.when(
        ((key + F.col("sample_id")) % 3 != 0) & (key % 11 != 0), F.col("energy")).otherwise(gap)))


_ALL = """
SELECT batch, instance_id, a AS sample_id, i, (a >> i) & 1 AS x FROM (
  SELECT batch, instance_id, a, unnest(generate_series(CAST(0 AS BIGINT), CAST(11 AS BIGINT))) AS i FROM (
    SELECT batch, instance_id, unnest(generate_series(CAST(0 AS BIGINT), CAST(4095 AS BIGINT))) AS a FROM {season_sizes}) s) t"""


@query("v4_all_samples", _ALL)
def v4(v):
    return V.all_samples(v.season_sizes)


@query("v5_probe_samples", """
SELECT batch, instance_id, sample_id, count(*) AS bits, CAST(sum(x) AS BIGINT) AS ones,
       CAST(sum(x * (i + 1) * (i + 1)) AS BIGINT) AS weighted
FROM (SELECT batch, instance_id, sample_id, i,
  CAST(CASE sample_id WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN i % 2 ELSE
    CASE WHEN (z2*69621 + sample_id + 3) % 2147483647 < 1073741824 THEN 1 ELSE 0 END END AS BIGINT) AS x
FROM (SELECT *, (z1*z1 + z1*48271 + i + 7) % 2147483647 AS z2
FROM (SELECT *, (z0*z0 + z0*16807 + 11) % 2147483647 AS z1
FROM (SELECT *, (seed*1000003 + i*48271 + sample_id*69621 + 12345) % 2147483647 AS z0
FROM (SELECT batch, instance_id, CAST(instance_id AS BIGINT) + 334462 AS seed, i,
             unnest(generate_series(CAST(0 AS BIGINT), CAST(130 AS BIGINT))) AS sample_id
      FROM (SELECT batch, instance_id, unnest(generate_series(CAST(0 AS BIGINT), CAST(11 AS BIGINT))) AS i
            FROM {route_sizes}) v) s) q0) q1) q2) p GROUP BY ALL""")
def v5(v):
    probes = V.probe_samples(v.route_sizes.withColumn("seed", F.col("instance_id").cast("bigint")))
    place = F.col("i") + 1
    return probes.groupBy(*KEY, "sample_id").agg(
        F.count("*").alias("bits"), F.sum("x").alias("ones"),
        F.sum(F.col("x") * place * place).alias("weighted"))


@query("v6_binarize", """
SELECT batch, instance_id, sample_id, i, CAST(CASE WHEN cos(theta) >= 0 THEN 1 ELSE 0 END AS BIGINT) AS x
FROM (SELECT batch, instance_id, sample_id, i, (i*7 + sample_id) / 10.0 - 3.0 AS theta FROM {samples}) t""")
def v6(v):
    states = v.samples.withColumn(
        "theta", (F.col("i") * 7 + F.col("sample_id")).cast("double") / 10.0 - 3.0)
    return V.binarize(states)


_SEASON = f"""
WITH s AS ({_ALL}),
e AS (SELECT e.instance_id, s.sample_id, sum(CASE WHEN s.x <> t.x THEN -e.w ELSE 0 END) AS e
      FROM {{season_edges}} e JOIN s ON s.instance_id = e.instance_id AND s.i = e.u
      JOIN s t ON t.instance_id = e.instance_id AND t.i = e.v AND t.sample_id = s.sample_id GROUP BY ALL)"""


@query("v7_exact_minimum", _SEASON + """,
m AS (SELECT instance_id, min(e) AS m, count(*) AS n FROM e GROUP BY ALL)
SELECT 'season' AS batch, instance_id, CAST(m AS DOUBLE) AS energy, min(sample_id) AS assignment,
       count(*) AS optima, n AS states_evaluated, 'enumerated' AS status
FROM e JOIN m USING (instance_id) WHERE e = m GROUP BY instance_id, m, n
UNION ALL SELECT batch, instance_id, NULL, NULL, NULL, NULL, 'not_enumerated' FROM {sizes}""")
def v7(v):
    v.keep("season_edges", "edges")
    # the trade graphs are far too large to enumerate
    return exact_minimum(E.encode_max_cut(
        union(v.season_edges, v.edges), union(v.season_sizes.select(*KEY, "num_vertices", "num_variables"),
                                                  v.sizes.select(*KEY, "num_vertices", "num_variables"))))


@query("v8_exact_checkpoints", _SEASON + """,
t AS (SELECT k AS idx, CAST(ceil(k*4096/7.0) AS BIGINT) AS target FROM range(1, 8) r(k))
SELECT 'season' AS batch, instance_id, CAST(idx AS BIGINT) AS idx, target, CAST(4096 AS BIGINT) AS total,
       CAST(min(e) AS DOUBLE) AS energy, arg_min(sample_id, (e, sample_id)) AS assignment, 'enumerated' AS status
FROM e JOIN t ON sample_id < target GROUP BY instance_id, idx, target""")
def v8(v):
    v.keep("season_edges")
    return exact_checkpoints(E.encode_max_cut(v.season_edges, v.season_sizes), 7)


@query("v9_cut_energy", f"""
WITH c AS ({_by_samples('edges', 'samples', 'CASE WHEN s.x <> t.x THEN -e.w ELSE 0 END')})
SELECT batch, instance_id, sample_id, e AS energy FROM c""")
def v9(v):
    v.keep("edges", "samples")
    return V.cut_energy(v.edges, v.samples)


def _value_parts(values: str, samples: str, index: str = "u") -> str:
    return f"""
SELECT s.batch, s.instance_id, s.sample_id, CAST(-sum(value*x) AS DOUBLE) AS e FROM {{{values}}} v
JOIN {{{samples}}} s ON s.instance_id = v.instance_id AND s.i = v.{index} GROUP BY ALL"""


def _price(v, table, column="value"):
    return table.groupBy(*KEY).agg((F.max(column) + 1).cast("double").alias("penalty"))


@query("v10_independent_set_energy", f"""
WITH c AS ({_by_samples('edges', 'samples', 's.x*t.x')}), a AS ({_value_parts('vertices', 'samples')}),
p AS (SELECT instance_id, max(value) + 1 AS p FROM {{vertices}} GROUP BY ALL)
SELECT a.batch, a.instance_id, a.sample_id, a.e + p.p*coalesce(c.e, 0) AS energy
FROM a LEFT JOIN c USING (instance_id, sample_id) JOIN p USING (instance_id)""")
def v10(v):
    v.keep("edges", "samples", "vertices")
    return V.independent_set_energy(v.vertices, v.edges, _price(v, v.vertices), v.samples)


@query("v11_clique_energy", f"""
WITH c AS ({_by_samples('edges', 'samples', 's.x*t.x')}), a AS ({_value_parts('vertices', 'samples')}),
n AS (SELECT instance_id, sample_id, sum(x) AS n FROM {{samples}} GROUP BY ALL),
p AS (SELECT instance_id, max(value) + 1 AS p FROM {{vertices}} GROUP BY ALL)
SELECT a.batch, a.instance_id, a.sample_id, a.e + p.p*(n*(n - 1)/2 - coalesce(c.e, 0)) AS energy
FROM a LEFT JOIN c USING (instance_id, sample_id) JOIN n USING (instance_id, sample_id) JOIN p USING (instance_id)""")
def v11(v):
    v.keep("edges", "samples", "vertices")
    return V.clique_energy(v.vertices, v.edges, _price(v, v.vertices), v.samples)


@query("v12_coloring_energy", """
WITH one AS (SELECT batch, instance_id, sample_id, sum(2.0*(n - 1)*(n - 1)) AS e FROM (
  SELECT batch, instance_id, sample_id, i//3 AS u, sum(x) AS n FROM {route_colors} GROUP BY ALL) t GROUP BY ALL),
same AS (SELECT e.instance_id, s.sample_id, sum(s.x*t.x) AS e FROM {route_edges} e
  JOIN {route_colors} s ON s.instance_id = e.instance_id AND s.i // 3 = e.u
  JOIN {route_colors} t ON t.instance_id = e.instance_id AND t.i // 3 = e.v AND t.i % 3 = s.i % 3
    AND t.sample_id = s.sample_id GROUP BY ALL)
SELECT batch, instance_id, sample_id, CAST(one.e + coalesce(same.e, 0) AS DOUBLE) AS energy
FROM one LEFT JOIN same USING (instance_id, sample_id)""")
def v12(v):
    v.keep("route_edges")
    return V.coloring_energy(v.route_vertices, v.route_edges, v.route_colors, 3)


@query("v13_partition_energy", """
SELECT n.batch, n.instance_id, sample_id, CAST(pow(2*sum(value*x) - sum(value), 2) AS DOUBLE) AS energy
FROM {numbers} n JOIN {number_samples} s ON s.instance_id = n.instance_id AND s.i = n.i GROUP BY ALL""")
def v13(v):
    v.keep("numbers")
    return V.partition_energy(v.numbers, v.number_samples)


@query("v14_knapsack_energy", f"""
WITH {KNAPSACK}
a AS (SELECT x.batch, x.instance_id, x.sample_id, sum(m.a*x.x) AS used FROM m
      JOIN {{item_samples}} x ON x.instance_id = m.instance_id AND x.i = m.i GROUP BY ALL),
g AS (SELECT x.instance_id, x.sample_id, sum(t.value*x.x) AS val FROM {{items}} t
      JOIN {{item_samples}} x ON x.instance_id = t.instance_id AND x.i = t.i GROUP BY ALL),
h AS (SELECT x.instance_id, x.sample_id, sum(t.v*x.x*y.x) AS bon FROM {{bonuses}} t
      JOIN {{item_samples}} x ON x.instance_id = t.instance_id AND x.i = t.i
      JOIN {{item_samples}} y ON y.instance_id = t.instance_id AND y.i = t.j AND y.sample_id = x.sample_id GROUP BY ALL)
SELECT a.batch, a.instance_id, a.sample_id,
       CAST(-val - coalesce(bon, 0) + p*(used - c)*(used - c) AS DOUBLE) AS energy
FROM a JOIN g USING (instance_id, sample_id) LEFT JOIN h USING (instance_id, sample_id) JOIN k USING (instance_id)""")
def v14(v):
    v.keep("items", "bonuses")
    batch, capacity, slack = E.encode_knapsack(v.items, v.bonuses)
    del batch
    price = v.items.groupBy(*KEY).agg(F.sum("value").alias("t")).join(
        v.bonuses.groupBy(*KEY).agg(F.sum("v").alias("b")), KEY, "left").select(
        *KEY, (F.col("t") + F.coalesce("b", F.lit(0)) + 1).cast("double").alias("penalty"))
    return V.knapsack_energy(v.items, v.bonuses, capacity, slack, price, v.item_samples)


@query("v15_packing_energy", """
WITH p AS (SELECT instance_id, max(value) + 1 AS p FROM {set_values} GROUP BY ALL),
a AS (SELECT s.batch, s.instance_id, sample_id, sum(value*x) AS e FROM {set_values} v
      JOIN {set_samples} s ON s.instance_id = v.instance_id AND s.i = v.set_id GROUP BY ALL),
o AS (SELECT DISTINCT a.instance_id, a.set_id AS a, b.set_id AS b FROM {members} a JOIN {members} b
      ON a.instance_id = b.instance_id AND a.element = b.element AND a.set_id < b.set_id),
c AS (SELECT o.instance_id, s.sample_id, sum(s.x*t.x) AS n FROM o
      JOIN {set_samples} s ON s.instance_id = o.instance_id AND s.i = o.a
      JOIN {set_samples} t ON t.instance_id = o.instance_id AND t.i = o.b AND t.sample_id = s.sample_id GROUP BY ALL)
SELECT batch, instance_id, sample_id, CAST(-e + p*coalesce(n, 0) AS DOUBLE) AS energy
FROM a LEFT JOIN c USING (instance_id, sample_id) JOIN p USING (instance_id)""")
def v15(v):
    v.keep("members", "set_samples")
    return V.packing_energy(E.overlapping_pairs(v.members), v.set_values,
                            _price(v, v.set_values), v.set_samples)


_FALSE_BITS = """
SELECT l.batch, l.instance_id, l.clause_id, s.sample_id,
       max(CASE WHEN pos = 0 THEN b END) AS f0, max(CASE WHEN pos = 1 THEN b END) AS f1,
       max(CASE WHEN pos = 2 THEN b END) AS f2
FROM (SELECT *, CASE WHEN negated THEN 1 ELSE 0 END AS want FROM {literals}) l
JOIN (SELECT *, x AS y FROM {clause_samples}) s ON s.instance_id = l.instance_id AND s.i = l.variable,
LATERAL (SELECT CASE WHEN s.y = l.want THEN 1 ELSE 0 END AS b) t GROUP BY ALL"""


@query("v16_unsatisfied_weight", f"""
WITH f AS ({_FALSE_BITS})
SELECT f.batch, f.instance_id, f.sample_id, CAST(sum(CASE WHEN f0 + f1 + f2 = 3 THEN weight ELSE 0 END) AS DOUBLE) AS energy
FROM f JOIN {{clauses}} c ON c.instance_id = f.instance_id AND c.clause_id = f.clause_id GROUP BY ALL""")
def v16(v):
    v.keep("clauses", "clause_samples")
    return V.unsatisfied_weight(v.literals, v.clauses, v.clause_samples)


@query("v17_sat3_energy", f"""
WITH f AS ({_FALSE_BITS}),
g AS (SELECT f.*, c.weight AS w, c.weight + 1 AS p, s.x AS z FROM f
      JOIN {{clauses}} c ON c.instance_id = f.instance_id AND c.clause_id = f.clause_id
      JOIN {{clause_sizes}} n ON n.instance_id = f.instance_id
      JOIN {{clause_samples}} s ON s.instance_id = f.instance_id AND s.sample_id = f.sample_id
        AND s.i = n.num_variables + f.clause_id)
SELECT batch, instance_id, sample_id,
       CAST(sum(p*(f0*f1 - 2*f0*z - 2*f1*z + 3*z) + w*z*f2) AS DOUBLE) AS energy FROM g GROUP BY ALL""")
def v17(v):
    v.keep("clauses")
    ancillas = cut(E.encode_max_sat(v.literals, v.clauses, 3, sizes=v.clause_sizes)[1])
    return V.sat3_energy(v.literals, v.clauses, ancillas, v.clause_samples)


@query("v18_ising_energy", """
WITH a AS (SELECT s.batch, s.instance_id, sample_id, sum(h*(2*x - 1)) AS e FROM {fields} f
           JOIN {samples} s ON s.instance_id = f.instance_id AND s.i = f.i GROUP BY ALL),
b AS (SELECT c.instance_id, s.sample_id, sum(coupling*(2*s.x - 1)*(2*t.x - 1)) AS e FROM {couplings} c
      JOIN {samples} s ON s.instance_id = c.instance_id AND s.i = c.i
      JOIN {samples} t ON t.instance_id = c.instance_id AND t.i = c.j AND t.sample_id = s.sample_id GROUP BY ALL)
SELECT batch, instance_id, sample_id, a.e + coalesce(b.e, 0) AS energy FROM a LEFT JOIN b USING (instance_id, sample_id)""")
def v18(v):
    v.keep("edges", "samples")
    return V.ising_energy(v.fields, v.couplings, v.samples)


# One stored model is spoilt in some instances, so that the check has something to find.
_CHECK = f"""
WITH s AS ({_ALL}),
e AS (SELECT e.instance_id, s.sample_id, sum(CASE WHEN s.x <> t.x THEN -e.w ELSE 0 END) AS want,
             sum(CASE WHEN s.x <> t.x THEN -e.w ELSE 0 END
                 + CASE WHEN e.instance_id IN ('1997', '1999') AND e.u = 2 AND e.v = 5 THEN s.x*t.x ELSE 0 END) AS have
      FROM {{season_edges}} e JOIN s ON s.instance_id = e.instance_id AND s.i = e.u
      JOIN s t ON t.instance_id = e.instance_id AND t.i = e.v AND t.sample_id = s.sample_id GROUP BY ALL)
SELECT 'season' AS batch, instance_id, 'exhaustive' AS method, count(*) AS samples_checked,
       CAST(4096 AS BIGINT) AS intended_samples, CAST(max(abs(have - want)) AS DOUBLE) AS maximum_absolute_error,
       count(*) FILTER (WHERE abs(have - want) > 1e-8*greatest(1, abs(have), abs(want))) AS mismatches,
       min(sample_id) FILTER (WHERE abs(have - want) > 1e-8*greatest(1, abs(have), abs(want))) AS first_mismatch
FROM e GROUP BY instance_id"""


@query("v19_check_encoding", _CHECK)
def v19(v):
    from dataclasses import replace

    v.keep("season_edges")
    batch = E.encode_max_cut(v.season_edges, v.season_sizes)
    spoilt = batch.quadratic.withColumn("v", F.col("v") + F.when(
        F.col("instance_id").isin("1997", "1999") & (F.col("i") == 2) & (F.col("j") == 5), 1.0
    ).otherwise(0.0))
    samples = V.all_samples(batch.instances)
    return V.check_encoding(replace(batch, quadratic=spoilt),
                            V.cut_energy(v.season_edges, samples), samples)


@query("v19_check_encoding_probes", """
SELECT batch, instance_id, 'deterministic_random' AS method, CAST(131 AS BIGINT) AS samples_checked,
       CAST(131 AS BIGINT) AS intended_samples, 0.0::DOUBLE AS maximum_absolute_error,
       CAST(0 AS BIGINT) AS mismatches, CAST(NULL AS BIGINT) AS first_mismatch
FROM {sizes}""")
def v19_probes(v):
    v.keep("edges")
    batch = E.encode_max_cut(v.edges, v.sizes)
    samples = V.Probes(batch.instances)
    return V.check_encoding(batch, V.cut_energy(v.edges, samples), samples)
