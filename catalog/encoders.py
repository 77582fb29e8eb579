"""Encoders (E-1 .. E-11): the terms of every family, checked coefficient by coefficient."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import encoders as E
from bitloom.operators.terms import union
from bitloom.schemas import KEY, Batch
from catalog.base import query


def stack(batch: Batch):
    """A batch as one table: key, kind, i, j, v (offset and size at -1, -1)."""
    none = F.lit(-1).cast("bigint")

    def scalar(kind: str, column: str):
        return batch.instances.select(
            *KEY, F.lit(kind).alias("kind"), none.alias("i"), none.alias("j"),
            F.col(column).cast("double").alias("v"))

    return union(
        scalar("offset", "offset"), scalar("size", "num_variables"),
        batch.linear.select(*KEY, F.lit("linear").alias("kind"), "i", none.alias("j"), "v"),
        batch.quadratic.select(*KEY, F.lit("quadratic").alias("kind"), "i", "j", "v"))


def terms_sql(parts: str, size: str, offset: str = "SELECT batch, instance_id, 0.0 AS v FROM n",
              before: str = "") -> str:
    """SQL for ``stack``: ``parts`` yields kind, i, j, v rows that are summed and cleaned."""
    return f"""
WITH {before} n AS ({size}), t AS ({parts})
SELECT batch, instance_id, kind, i, j, CAST(v AS DOUBLE) AS v FROM (
  SELECT batch, instance_id, kind, i, j, sum(v) AS v FROM t GROUP BY ALL) s WHERE abs(v) > 1e-12
UNION ALL SELECT batch, instance_id, 'offset', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(v AS DOUBLE) FROM ({offset}) o
UNION ALL SELECT batch, instance_id, 'size', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(n AS DOUBLE) FROM n"""


NO_J = "CAST(-1 AS BIGINT) AS j"
SIZES = "SELECT batch, instance_id, num_variables AS n FROM {sizes}"
ROUTE_SIZES = "SELECT batch, instance_id, num_variables AS n FROM {route_sizes}"


@query("e1_max_cut", terms_sql(f"""
SELECT batch, instance_id, 'linear' AS kind, u AS i, {NO_J}, -w AS v FROM {{edges}}
UNION ALL SELECT batch, instance_id, 'linear', v, -1, -w FROM {{edges}}
UNION ALL SELECT batch, instance_id, 'quadratic', u, v, 2*w FROM {{edges}}""", SIZES))
def e1(v):
    v.keep("edges")
    return stack(E.encode_max_cut(v.edges, v.sizes))


@query("e2_independent_set", terms_sql(f"""
SELECT batch, instance_id, 'linear' AS kind, u AS i, {NO_J}, -value AS v FROM {{vertices}}
UNION ALL SELECT e.batch, e.instance_id, 'quadratic', e.u, e.v, p.p
FROM {{edges}} e JOIN (SELECT instance_id, max(value) + 1 AS p FROM {{vertices}} GROUP BY ALL) p
USING (instance_id)""", SIZES))
def e2(v):
    v.keep("edges")
    return stack(E.encode_independent_set(v.vertices, v.edges, sizes=v.sizes))


_NON_EDGES = """
SELECT a.batch, a.instance_id, a.u AS i, b.u AS j
FROM {route_vertices} a JOIN {route_vertices} b ON a.instance_id = b.instance_id AND a.u < b.u
ANTI JOIN {route_edges} e ON e.instance_id = a.instance_id AND e.u = a.u AND e.v = b.u"""


@query("e3_clique", terms_sql(f"""
SELECT batch, instance_id, 'linear' AS kind, u AS i, {NO_J}, -value AS v FROM {{route_vertices}}
UNION ALL SELECT e.batch, e.instance_id, 'quadratic', e.i, e.j, p.p
FROM ({_NON_EDGES}) e JOIN (SELECT instance_id, max(value) + 1 AS p FROM {{route_vertices}} GROUP BY ALL) p
USING (instance_id)""", ROUTE_SIZES))
def e3(v):
    v.keep("route_edges")
    return stack(E.encode_clique(v.route_vertices, v.route_edges, sizes=v.route_sizes)[0])


@query("e3_non_edges", _NON_EDGES)
def e3_missing(v):
    v.keep("route_edges")
    return E.encode_clique(v.route_vertices, v.route_edges)[1]


_COLOR = """
WITH c AS (SELECT unnest(generate_series(CAST(0 AS BIGINT), CAST(2 AS BIGINT))) AS c),
n AS (SELECT batch, instance_id, 36 AS n FROM {route_sizes}),
t AS (
SELECT batch, instance_id, 'linear' AS kind, u*3 + c AS i, CAST(-1 AS BIGINT) AS j, -2.0 AS v FROM {route_vertices}, c
UNION ALL SELECT batch, instance_id, 'quadratic', u*3 + c.c, u*3 + d.c, 4.0
FROM {route_vertices}, c, c d WHERE c.c < d.c
UNION ALL SELECT batch, instance_id, 'quadratic', u*3 + c, v*3 + c, 1.0 FROM {route_edges}, c)
SELECT batch, instance_id, kind, i, j, CAST(sum(v) AS DOUBLE) AS v FROM t GROUP BY ALL
UNION ALL SELECT batch, instance_id, 'offset', -1, -1, 24.0 FROM n
UNION ALL SELECT batch, instance_id, 'size', -1, -1, 36.0 FROM n"""


@query("e4_coloring", _COLOR)
def e4(v):
    v.keep("route_edges")
    return stack(E.encode_coloring(v.route_vertices, v.route_edges, 3, sizes=v.route_sizes))


@query("e5_partition", terms_sql(f"""
SELECT a.batch, a.instance_id, 'linear' AS kind, i, {NO_J}, 4*value*value - 4*total*value AS v
FROM {{numbers}} a JOIN s USING (instance_id)
UNION ALL SELECT a.batch, a.instance_id, 'quadratic', a.i, b.i, 8*a.value*b.value
FROM {{numbers}} a JOIN {{numbers}} b ON a.instance_id = b.instance_id AND a.i < b.i""",
    "SELECT batch, instance_id, max(i) + 1 AS n FROM {numbers} GROUP BY ALL",
    "SELECT 'months' AS batch, instance_id, total*total AS v FROM s",
    "s AS (SELECT instance_id, sum(value) AS total FROM {numbers} GROUP BY ALL),"))
def e5(v):
    v.keep("numbers")
    return stack(E.encode_partition(v.numbers))


KNAPSACK = """
b AS (SELECT instance_id, sum(v) AS b FROM {bonuses} GROUP BY ALL),
f AS (SELECT i.batch, instance_id, max(i) + 1 AS n, CAST(greatest(1, floor(sum(weight)*0.5)) AS BIGINT) AS c,
             sum(value) AS total FROM {items} i GROUP BY ALL),
k AS (SELECT batch, instance_id, n, c, total + coalesce(b, 0) + 1 AS p FROM f LEFT JOIN b USING (instance_id)),
s0 AS (SELECT k.*, unnest(generate_series(CAST(0 AS BIGINT), CAST(40 AS BIGINT))) AS k FROM k),
s AS (SELECT batch, instance_id, n + k AS i, k,
        CASE WHEN c + 1 >= 2*(CAST(1 AS BIGINT) << k) THEN CAST(1 AS BIGINT) << k
             ELSE c - (CAST(1 AS BIGINT) << k) + 1 END AS a
      FROM s0 WHERE (CAST(1 AS BIGINT) << k) <= c),
m AS (SELECT batch, instance_id, i, weight AS a FROM {items} UNION ALL SELECT batch, instance_id, i, a FROM s),
"""


@query("e6_knapsack", terms_sql(f"""
SELECT batch, instance_id, 'linear' AS kind, i, {NO_J}, -value AS v FROM {{items}}
UNION ALL SELECT m.batch, m.instance_id, 'linear', i, -1, p*(a*a - 2*c*a) FROM m JOIN k USING (instance_id)
UNION ALL SELECT batch, instance_id, 'quadratic', i, j, -v FROM {{bonuses}}
UNION ALL SELECT x.batch, x.instance_id, 'quadratic', x.i, y.i, 2*p*x.a*y.a
FROM m x JOIN m y ON x.instance_id = y.instance_id AND x.i < y.i JOIN k ON k.instance_id = x.instance_id""",
    "SELECT batch, instance_id, max(i) + 1 AS n FROM m GROUP BY ALL",
    "SELECT batch, instance_id, p*c*c AS v FROM k", KNAPSACK))
def e6(v):
    v.keep("items", "bonuses")
    return stack(E.encode_knapsack(v.items, v.bonuses)[0])


_OVERLAP = """
SELECT a.batch, a.instance_id, a.set_id AS a, b.set_id AS b, array_agg(a.element ORDER BY a.element) AS shared
FROM {members} a JOIN {members} b ON a.instance_id = b.instance_id AND a.element = b.element AND a.set_id < b.set_id
GROUP BY ALL"""


@query("e7_set_packing", terms_sql(f"""
SELECT batch, instance_id, 'linear' AS kind, set_id AS i, {NO_J}, -value AS v FROM {{set_values}}
UNION ALL SELECT o.batch, o.instance_id, 'quadratic', o.a, o.b, p.p
FROM ({_OVERLAP}) o JOIN (SELECT instance_id, max(value) + 1 AS p FROM {{set_values}} GROUP BY ALL) p
USING (instance_id)""", "SELECT batch, instance_id, max(set_id) + 1 AS n FROM {set_values} GROUP BY ALL"))
def e7(v):
    v.keep("members")
    return stack(E.encode_set_packing(v.members, v.set_values))


@query("e7_overlaps", f"""
SELECT batch, instance_id, a, b, array_to_string(shared, ',') AS shared FROM ({_OVERLAP}) o""")
def e7_overlaps(v):
    v.keep("members")
    return E.set_overlaps(v.members).withColumn(
        "shared", F.array_join(F.col("shared").cast("array<string>"), ","))


# false indicator of literal p: c + a*x
_FALSE = """
f AS (SELECT l.batch, l.instance_id, l.clause_id, l.pos, l.variable AS i,
             CASE WHEN negated THEN 1.0 ELSE -1.0 END AS a, CASE WHEN negated THEN 0.0 ELSE 1.0 END AS c,
             CAST(q.weight AS DOUBLE) AS w, s.num_variables + l.clause_id AS z
      FROM {literals} l JOIN {clauses} q USING (batch, instance_id, clause_id)
      JOIN {clause_sizes} s USING (batch, instance_id)),
"""


def _product(left: str, right: str, weight: str) -> str:
    """Expanded product of two factors given as (i, a, c) column triples over joined rows g."""
    li, la, lc = (f"{left}.{x}" for x in "iac")
    ri, ra, rc = (f"{right}.{x}" for x in "iac")
    head = "SELECT g.batch, g.instance_id,"
    return "\nUNION ALL ".join([
        f"{head} 'linear' AS kind, {li} AS i, CAST(-1 AS BIGINT) AS j, {weight}*{la}*{rc} AS v FROM g",
        f"{head} 'linear', {ri}, -1, {weight}*{lc}*{ra} FROM g",
        f"{head} CASE WHEN {li} = {ri} THEN 'linear' ELSE 'quadratic' END, least({li}, {ri}), "
        f"CASE WHEN {li} = {ri} THEN -1 ELSE greatest({li}, {ri}) END, {weight}*{la}*{ra} FROM g"])


_G = """g AS (SELECT x.batch, x.instance_id, x.w, x.w + 1 AS p,
  struct_pack(i := x.i, a := x.a, c := x.c) AS f0, struct_pack(i := y.i, a := y.a, c := y.c) AS f1,
  struct_pack(i := q.i, a := q.a, c := q.c) AS f2, struct_pack(i := x.z, a := 1.0, c := 0.0) AS z
  FROM f x JOIN f y ON x.instance_id = y.instance_id AND x.clause_id = y.clause_id AND y.pos = 1
  JOIN f q ON x.instance_id = q.instance_id AND x.clause_id = q.clause_id AND q.pos = 2
  WHERE x.pos = 0),"""


@query("e8_max_2_sat", terms_sql(
    _product("f0", "f1", "w"), "SELECT batch, instance_id, num_variables AS n FROM {clause_sizes}",
    "SELECT batch, instance_id, sum(w*f0.c*f1.c) AS v FROM g GROUP BY ALL", _FALSE + """g AS (
  SELECT x.batch, x.instance_id, x.w, struct_pack(i := x.i, a := x.a, c := x.c) AS f0, struct_pack(i := y.i, a := y.a, c := y.c) AS f1
  FROM f x JOIN f y ON x.instance_id = y.instance_id AND x.clause_id = y.clause_id AND y.pos = x.pos + 1),"""))
def e8(v):
    v.keep("clauses")
    # the first two and the last two literals of an order line are a clause each
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    pairs = v.literals.withColumn("half", half).where(F.col("pos").between(F.col("half"), F.col("half") + 1)).select(
        *KEY, (2 * F.col("clause_id") + F.col("half")).alias("clause_id"), (F.col("pos") - F.col("half")).alias("pos"),
        "variable", "negated")
    weights = v.clauses.withColumn("half", half).withColumn("clause_id", 2 * F.col("clause_id") + F.col("half"))
    return stack(E.encode_max_sat(pairs, weights, 2, sizes=v.clause_sizes)[0])


@query("e9_max_3_sat", terms_sql(
    "\nUNION ALL ".join([
        _product("f0", "f1", "p"), _product("f0", "z", "-2*p"), _product("f1", "z", "-2*p"),
        _product("z", "f2", "w"),
        "SELECT g.batch, g.instance_id, 'linear', z.i, -1, 3*p FROM g"]),
    "SELECT s.batch, s.instance_id, s.num_variables + max(clause_id) + 1 AS n FROM {clause_sizes} s "
    "JOIN {clauses} c ON c.instance_id = s.instance_id GROUP BY s.batch, s.instance_id, s.num_variables",
    "SELECT batch, instance_id, sum(p*f0.c*f1.c) AS v FROM g GROUP BY ALL", _FALSE + _G))
def e9(v):
    v.keep("clauses")
    return stack(E.encode_max_sat(v.literals, v.clauses, 3, sizes=v.clause_sizes)[0])


@query("e9_ancillas", """
SELECT c.batch, c.instance_id, clause_id, num_variables + clause_id AS variable,
       CAST(weight + 1 AS DOUBLE) AS penalty
FROM {clauses} c JOIN {clause_sizes} s USING (batch, instance_id)""")
def e9_ancillas(v):
    v.keep("clauses")
    return E.encode_max_sat(v.literals, v.clauses, 3, sizes=v.clause_sizes)[1]


@query("e10_spin_glass", terms_sql(f"""
SELECT batch, instance_id, 'linear' AS kind, i, {NO_J}, 2*h AS v FROM {{fields}}
UNION ALL SELECT batch, instance_id, 'linear', i, -1, -2*coupling FROM {{couplings}}
UNION ALL SELECT batch, instance_id, 'linear', j, -1, -2*coupling FROM {{couplings}}
UNION ALL SELECT batch, instance_id, 'quadratic', i, j, 4*coupling FROM {{couplings}}""",
    SIZES, """
SELECT batch, instance_id, sum(v) AS v FROM (
  SELECT batch, instance_id, coupling AS v FROM {couplings}
  UNION ALL SELECT batch, instance_id, -h FROM {fields}) o GROUP BY ALL"""))
def e10(v):
    v.keep("edges")
    return stack(E.encode_spin_glass(v.fields, v.couplings, v.sizes))


@query("e11_direct", terms_sql(f"""
SELECT batch, instance_id, 'linear' AS kind, i, {NO_J}, v FROM {{raw_linear}}
UNION ALL SELECT batch, instance_id, CASE WHEN i = j THEN 'linear' ELSE 'quadratic' END,
  least(i, j), CASE WHEN i = j THEN -1 ELSE greatest(i, j) END, v FROM {{raw_quadratic}}""",
    "SELECT batch, instance_id, num_variables AS n FROM {raw_sizes}"))
def e11(v):
    return stack(E.encode_direct(v.raw_linear, v.raw_quadratic, v.raw_sizes))
