"""Partition, clique and knapsack models (E-3, E-5, E-6) whose squares are not multiplied out."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import factored as Q
from bitloom.operators.terms import index_variables
from bitloom.session import cut
from catalog.base import query
from catalog.encoders import KNAPSACK

# one number per order line: instances are years, with as many variables as a year has lines
_LINES = """
SELECT batch, instance_id, row_number() OVER (PARTITION BY batch, instance_id ORDER BY l_orderkey, l_linenumber, value) - 1 AS i, value
FROM (SELECT 'lines' AS batch, CAST(year(l_shipdate) AS STRING) AS instance_id, l_orderkey, l_linenumber,
             CAST(l_quantity AS BIGINT) AS value FROM {lineitem}) l"""


def _numbers(v):
    lines = v.sql("""SELECT 'lines' AS batch, CAST(year(l_shipdate) AS STRING) AS instance_id, l_orderkey, l_linenumber,
        CAST(l_quantity AS BIGINT) AS value FROM {lineitem}""")
    return index_variables(lines, ["l_orderkey", "l_linenumber", "value"]).select("batch", "instance_id", "i", "value")


def _every_third(members):
    """Two samples that both engines write down alike."""
    return members.select("batch", "instance_id", "i", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("sample_id")).withColumn(
        "x", F.expr("CAST(CASE WHEN (i + sample_id) % 3 = 0 THEN 1 ELSE 0 END AS BIGINT)"))


@query("e5_partition_factored", f"""
WITH n AS ({_LINES}), s AS (SELECT unnest([CAST(0 AS BIGINT), 1]) AS sample_id)
SELECT batch, instance_id, sample_id, CAST(pow(sum(CASE WHEN (i + sample_id) % 3 = 0 THEN value ELSE -value END), 2) AS DOUBLE) AS energy
FROM n, s GROUP BY ALL""")
def e5_factored(v):
    numbers = cut(_numbers(v))
    return Q.factored_energy(Q.factor_partition(numbers), _every_third(numbers))


@query("e3_clique_factored", """
WITH s AS (SELECT unnest([CAST(0 AS BIGINT), 1]) AS sample_id),
p AS (SELECT batch, instance_id, max(value) + 1 AS p FROM {vertices} GROUP BY ALL),
c AS (SELECT batch, instance_id, sample_id, count(*) AS n, sum(value) AS value FROM {vertices}, s WHERE (u + sample_id) % 3 = 0 GROUP BY ALL),
e AS (SELECT batch, instance_id, sample_id, count(*) AS m FROM {edges}, s WHERE (u + sample_id) % 3 = 0 AND (v + sample_id) % 3 = 0 GROUP BY ALL)
SELECT batch, instance_id, sample_id, CAST(coalesce(p * (n*(n - 1)/2 - coalesce(m, 0)) - value, 0) AS DOUBLE) AS energy
FROM p CROSS JOIN s LEFT JOIN c USING (batch, instance_id, sample_id) LEFT JOIN e USING (batch, instance_id, sample_id)""")
def e3_factored(v):
    v.keep("edges", "vertices")
    model = Q.factor_clique(v.vertices, v.edges, sizes=v.sizes)
    return Q.factored_energy(model, _every_third(model.members))


@query("e6_knapsack_factored", f"""
WITH {KNAPSACK}s2 AS (SELECT unnest([CAST(0 AS BIGINT), 1]) AS sample_id),
u AS (SELECT m.instance_id, sample_id, sum(a) AS used FROM m, s2 WHERE (i + sample_id) % 3 = 0 GROUP BY ALL),
r AS (SELECT instance_id, sample_id, sum(value) AS value FROM {{items}}, s2 WHERE (i + sample_id) % 3 = 0 GROUP BY ALL),
o AS (SELECT instance_id, sample_id, sum(v) AS bonus FROM {{bonuses}}, s2 WHERE (i + sample_id) % 3 = 0 AND (j + sample_id) % 3 = 0 GROUP BY ALL)
SELECT batch, instance_id, sample_id,
       CAST(p * pow(coalesce(used, 0) - c, 2) - coalesce(value, 0) - coalesce(bonus, 0) AS DOUBLE) AS energy
FROM k CROSS JOIN s2 LEFT JOIN u USING (instance_id, sample_id) LEFT JOIN r USING (instance_id, sample_id) LEFT JOIN o USING (instance_id, sample_id)""")
def e6_factored(v):
    v.keep("items", "bonuses")
    every = v.sql("SELECT batch, instance_id, SERIES(64) AS i FROM (SELECT DISTINCT batch, instance_id FROM {items}) n")
    return Q.factored_energy(Q.factor_knapsack(v.items, v.bonuses)[0], _every_third(every))


@query("t13_factored_ising", f"""
WITH n AS ({_LINES}), t AS (SELECT batch, instance_id, sum(value) AS b1 FROM n GROUP BY ALL)
SELECT batch, instance_id, 'field' AS kind, i, 0.0 AS v FROM n
UNION ALL SELECT batch, instance_id, 'loading', i, CAST(value AS DOUBLE) FROM n
UNION ALL SELECT batch, instance_id, 'constant', -1, CAST(sum(value * value) AS DOUBLE) FROM n GROUP BY ALL""")
def t13_factored(v):
    spins = Q.factored_ising(Q.factor_partition(cut(_numbers(v))))
    key, none = ["batch", "instance_id"], F.lit(-1).cast("bigint")
    return spins.fields.select(*key, F.lit("field").alias("kind"), "i", F.col("h").alias("v")).unionByName(
        spins.loadings.select(*key, F.lit("loading").alias("kind"), "i", F.col("b").alias("v"))).unionByName(
        spins.constant.select(*key, F.lit("constant").alias("kind"), none.alias("i"), F.col("constant").alias("v")))


@query("d2_factored_stats", """
WITH p AS (SELECT batch, instance_id, max(value) + 1 AS p, count(*) AS z, sum(value) AS s, sum(value*value) AS s2, min(-value) AS low, max(-value) AS high
    FROM {vertices} GROUP BY ALL),
g AS (SELECT batch, instance_id, count(*) AS m FROM {edges} GROUP BY ALL),
d AS (SELECT batch, instance_id, u, count(*) AS d FROM (SELECT batch, instance_id, u FROM {edges}
    UNION ALL SELECT batch, instance_id, v FROM {edges}) e GROUP BY ALL),
f AS (SELECT *, z*(z - 1)//2 - m AS q FROM p JOIN g USING (batch, instance_id) JOIN {sizes} USING (batch, instance_id)),
t AS (SELECT *, CAST(z + q AS DOUBLE) AS c, (CAST(p AS DOUBLE)*q - s) / (z + q) AS mean FROM f)
SELECT batch, instance_id, unnest(['qubo_variables', 'qubo_linear_terms', 'qubo_quadratic_terms', 'qubo_inactive_variables',
    'qubo_coefficient_statistics.count', 'qubo_coefficient_statistics.min', 'qubo_coefficient_statistics.max', 'qubo_coefficient_statistics.mean',
    'qubo_coefficient_statistics.std']) AS key,
  unnest([CAST(num_variables AS DOUBLE), z, q, num_variables - z, c, low, CASE WHEN q > 0 THEN p ELSE high END, round(mean, 6),
    round(sqrt((CAST(p AS DOUBLE)*p*q + s2) / c - mean*mean), 6)]) AS value
FROM t""")
def d2_factored(v):
    v.keep("edges", "vertices")
    stats = Q.factored_stats(Q.factor_clique(v.vertices, v.edges, sizes=v.sizes))
    return stats.where("key <> 'qubo_quadratic_density'").select("batch", "instance_id", "key", F.round("value", 6).alias("value"))


@query("t18_factored_linear", f"""
WITH n AS ({_LINES}), w AS (SELECT *, count(*) OVER k AS m, sum(value) OVER k AS total,
    coalesce(sum(value) OVER (PARTITION BY batch, instance_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
    FROM n WINDOW k AS (PARTITION BY batch, instance_id))
SELECT batch, instance_id, 'x' AS kind, i AS col, CAST(4*value*value - 4*total*value AS DOUBLE) AS cost, 1.0 AS upper FROM w
UNION ALL SELECT batch, instance_id, 'rest', m + i, 0.0, CAST(2*rest AS DOUBLE) FROM w
UNION ALL SELECT batch, instance_id, 'rest', 2*m + i, CAST(4*value AS DOUBLE), CAST(2*rest AS DOUBLE) FROM w""")
def t18_factored(v):
    columns = Q.factored_linear(Q.factor_partition(cut(_numbers(v))))[0]
    return columns.select("batch", "instance_id", F.when(F.col("is_integer"), "x").otherwise("rest").alias("kind"), "col", "cost", "upper")
