"""Term algebra (T-1 .. T-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions.pairs import pair_rank, pair_unrank
from bitloom.operators import ising as S
from bitloom.operators import terms as T
from bitloom.operators.encoders import (
    encode_max_cut, instances_of, variable_table,
)
from bitloom.schemas import KEY, Batch
from catalog.base import query

_PAIRS = """least(i, j) AS i, greatest(i, j) AS j"""


@query("t1_accumulate", f"""
SELECT batch, instance_id, {_PAIRS}, sum(v) AS v FROM {{raw_quadratic}} GROUP BY ALL""")
def t1(v):
    return T.accumulate(v.raw_quadratic)


@query("t2_fold_diagonal", """
SELECT batch, instance_id, i, sum(v) AS v FROM (
  SELECT batch, instance_id, i, v FROM {raw_linear}
  UNION ALL SELECT batch, instance_id, i, v FROM {raw_quadratic} WHERE i = j) t GROUP BY ALL""")
def t2(v):
    return T.fold_diagonal(v.raw_quadratic, v.raw_linear)[1]


@query("t3_drop_tiny", f"""
SELECT * FROM (SELECT batch, instance_id, {_PAIRS}, sum(v) AS v FROM {{raw_quadratic}}
               WHERE i <> j GROUP BY ALL) t WHERE abs(v) > 1e-12""")
def t3(v):
    return T.drop_tiny(T.accumulate(v.raw_quadratic.where("i <> j")))


@query("t4_accumulate_linear", """
SELECT batch, instance_id, i, sum(v) AS v FROM {raw_linear} GROUP BY ALL""")
def t4(v):
    return T.accumulate_linear(v.raw_linear)


@query("t4_accumulate_offset", """
SELECT batch, instance_id, sum(v) AS "offset" FROM {raw_linear} GROUP BY ALL""")
def t4b(v):
    return T.accumulate_offset(v.raw_linear)


_SQUARE = """
WITH m AS (SELECT m.*, c.weight, c.constant FROM {square_members} m JOIN {square_constraints} c
           USING (batch, instance_id, constraint_id))
SELECT batch, instance_id, kind, i, j, sum(v) AS v FROM (
  SELECT batch, instance_id, 'linear' AS kind, i, CAST(-1 AS BIGINT) AS j,
         weight*(a*a + 2*constant*a) AS v FROM m
  UNION ALL
  SELECT a.batch, a.instance_id, 'quadratic', a.i, b.i, 2*a.weight*a.a*b.a
  FROM m a JOIN m b ON a.instance_id = b.instance_id AND a.constraint_id = b.constraint_id AND a.i < b.i
  UNION ALL
  SELECT batch, instance_id, 'offset', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), weight*constant*constant
  FROM {square_constraints}) t GROUP BY ALL"""


def _stack(offset, linear, quadratic):
    none = F.lit(-1).cast("bigint")
    return T.union(
        offset.select(*KEY, F.lit("offset").alias("kind"), none.alias("i"), none.alias("j"),
                      F.col("offset").alias("v")),
        linear.select(*KEY, F.lit("linear").alias("kind"), "i", none.alias("j"), "v"),
        quadratic.select(*KEY, F.lit("quadratic").alias("kind"), "i", "j", "v"))


@query("t5_square_terms", _SQUARE)
def t5(v):
    v.keep("square_members")
    return _stack(*T.square_terms(v.square_constraints, v.square_members))


# a product per order line: (1 + quantity-class variable) * (part variable - supplier variable)
_PRODUCTS = """
SELECT 'products' AS batch, CAST(year(l_shipdate) AS STRING) AS instance_id,
       l_orderkey*8 + l_linenumber AS product_id, min(l_linenumber) AS weight, 1 AS c1, -1 AS c2,
       CAST(min(l_quantity) AS BIGINT) AS x, min(l_suppkey) AS y
FROM {lineitem} GROUP BY year(l_shipdate), l_orderkey, l_linenumber"""


@query("t6_product_terms", f"""
WITH p AS (SELECT batch, instance_id, product_id, CAST(weight AS DOUBLE) AS w, x, y FROM ({_PRODUCTS}) q)
SELECT batch, instance_id, kind, i, j, sum(v) AS v FROM (
  SELECT batch, instance_id, 'offset' AS kind, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS j, -w AS v FROM p
  UNION ALL SELECT batch, instance_id, 'linear', x, CAST(-1 AS BIGINT), -2*w FROM p
  UNION ALL SELECT batch, instance_id, 'linear', y, CAST(-1 AS BIGINT), 3*w FROM p
  UNION ALL SELECT batch, instance_id, 'linear', x, CAST(-1 AS BIGINT), 6*w FROM p WHERE x = y
  UNION ALL SELECT batch, instance_id, 'quadratic', least(x, y), greatest(x, y), 6*w FROM p WHERE x <> y
) t GROUP BY ALL""")
def t6(v):
    rows = v.sql(_PRODUCTS)
    products = rows.select(*KEY, "product_id", *[
        F.col(c).cast("double").alias(c) for c in ("weight", "c1", "c2")])
    left = rows.select(*KEY, "product_id", F.col("x").alias("i"), F.lit(2.0).alias("a"))
    right = rows.select(*KEY, "product_id", F.col("y").alias("i"), F.lit(3.0).alias("a"))
    return _stack(*T.product_terms(products, left, right))


def _raw(v) -> Batch:
    # the declared size is the supplier range only, so larger quantity indices are out of range
    sizes = v.raw_quadratic.groupBy(*KEY).agg((F.max("i") - 10).alias("num_variables"))
    return Batch(instances_of(sizes, "raw"), v.raw_linear, v.raw_quadratic)


@query("t7_bad_indices", """
WITH n AS (SELECT batch, instance_id, max(i) - 10 AS n FROM {raw_quadratic} GROUP BY ALL)
SELECT batch, instance_id, kind, i, j, count(*) AS terms FROM (
  SELECT batch, instance_id, 'linear' AS kind, i, CAST(NULL AS BIGINT) AS j, i AS top, i AS low FROM {raw_linear}
  UNION ALL SELECT batch, instance_id, 'quadratic', i, j, greatest(i, j), least(i, j) FROM {raw_quadratic}) t
JOIN n USING (batch, instance_id) WHERE low < 0 OR top >= n
GROUP BY ALL""")
def t7(v):
    return T.bad_indices(_raw(v)).groupBy(*KEY, "kind", "i", "j").agg(
        F.count("*").alias("terms"))


@query("t8_pair_rank", """
SELECT batch, instance_id, i, j, r, i AS i_back, j AS j_back FROM (
  SELECT e.batch, e.instance_id, u AS i, v AS j,
         u*(2*num_variables - u - 1)//2 + v - u - 1 AS r
  FROM {edges} e JOIN {sizes} s USING (batch, instance_id)) t""")
def t8(v):
    n = F.col("num_variables")
    rows = v.edges.join(v.sizes, KEY).select(
        *KEY, F.col("u").alias("i"), F.col("v").alias("j"),
        pair_rank(F.col("u"), F.col("v"), n).alias("r"), n)
    back = pair_unrank(F.col("r"), n)
    return rows.withColumn("b", back).select(
        *KEY, "i", "j", "r", F.col("b.i").alias("i_back"), F.col("b.j").alias("j_back"))


@query("t9_index_variables", """
SELECT batch, instance_id, u AS vertex, row_number() OVER (PARTITION BY batch, instance_id ORDER BY u) - 1 AS i,
       concat('vertex_', CAST(row_number() OVER (PARTITION BY batch, instance_id ORDER BY u) - 1 AS VARCHAR)) AS name
FROM {vertices}""")
def t9(v):
    numbered = T.index_variables(v.vertices.select(*KEY, F.col("u").alias("vertex")), ["vertex"])
    names = T.variable_names(numbered, "vertex", "i")
    return numbered.join(names, [*KEY, "i"]).select(*KEY, "vertex", "i", "name")


@query("t9_variable_names", """
SELECT batch, instance_id, i, concat('vertex_', CAST(i // 3 AS VARCHAR), '_color_', CAST(i % 3 AS VARCHAR)) AS name
FROM (SELECT batch, instance_id, unnest(generate_series(CAST(0 AS BIGINT), CAST(35 AS BIGINT))) AS i FROM {route_sizes}) r
UNION ALL
SELECT batch, instance_id, i, CASE WHEN i < 10 THEN concat('boolean_', CAST(i AS VARCHAR))
  ELSE concat('clause_', CAST(i - 10 AS VARCHAR), '_ancilla') END
FROM (SELECT batch, instance_id, unnest(generate_series(CAST(0 AS BIGINT), 10 + m - 1)) AS i
      FROM (SELECT batch, instance_id, count(*) AS m FROM {small_clauses} GROUP BY ALL) c) s""")
def t9_names(v):
    colored = Batch(instances_of(v.route_sizes.withColumn("num_variables", F.lit(36)),
                                 "graph_coloring"), None, None)
    counts = v.small_clauses.groupBy(*KEY).agg((F.count("*") + 10).alias("num_variables"))
    formulas = Batch(instances_of(counts, "max_sat"), None, None)
    return variable_table(colored, 3).unionByName(variable_table(
        formulas, primary=counts.select(*KEY, F.lit(10).alias("primary"))))


@query("t10_slack_weights", """
WITH c AS (SELECT batch, instance_id, CAST(sum(weight) AS BIGINT) AS c FROM {items} GROUP BY ALL),
     k AS (SELECT *, unnest(generate_series(CAST(0 AS BIGINT), CAST(62 AS BIGINT))) AS k FROM c)
SELECT batch, instance_id, k,
       CASE WHEN c + 1 >= 2*(CAST(1 AS BIGINT) << k) THEN CAST(1 AS BIGINT) << k
            ELSE c - (CAST(1 AS BIGINT) << k) + 1 END AS weight
FROM k WHERE k < 40 AND (CAST(1 AS BIGINT) << k) <= c""")
def t10(v):
    capacity = v.items.groupBy(*KEY).agg(F.sum("weight").alias("capacity"))
    return T.slack_weights(capacity)


@query("t11_content_digest")
def t11(v):
    v.keep("edges")
    return T.content_digest(encode_max_cut(v.edges, v.sizes))


@query("t12_instance_ids")
def t12(v):
    v.keep("edges")
    batch = encode_max_cut(v.edges, v.sizes)
    digests = T.content_digest(batch)
    described = batch.instances.withColumn("seed", F.col("instance_id").cast("bigint")).withColumn(
        "parameters", F.create_map(F.lit("weighted"), F.lit("true"),
                                   F.lit("graph_type"), F.lit("erdos_renyi")))
    return T.instance_ids(described, digests)


_MODEL = """
q AS (SELECT batch, instance_id, u AS i, v AS j, 2*w AS v FROM {edges}),
l AS (SELECT batch, instance_id, i, -sum(w) AS v FROM (
        SELECT batch, instance_id, u AS i, w FROM {edges}
        UNION ALL SELECT batch, instance_id, v, w FROM {edges}) t GROUP BY ALL)"""


def _cut_model(v) -> Batch:
    v.keep("edges")
    # the linear terms are kept as they are, so that spins have fields
    return encode_max_cut(v.edges, v.sizes)


@query("t13_to_ising", f"""
WITH {_MODEL}
SELECT batch, instance_id, kind, i, j, sum(v) AS v FROM (
  SELECT batch, instance_id, 'field' AS kind, i, CAST(-1 AS BIGINT) AS j, v/2 AS v FROM l
  UNION ALL SELECT batch, instance_id, 'field', i, CAST(-1 AS BIGINT), v/4 FROM q
  UNION ALL SELECT batch, instance_id, 'field', j, CAST(-1 AS BIGINT), v/4 FROM q
  UNION ALL SELECT batch, instance_id, 'coupling', i, j, v/4 FROM q
  UNION ALL SELECT batch, instance_id, 'constant', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), v/2 FROM l
  UNION ALL SELECT batch, instance_id, 'constant', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), v/4 FROM q
) t GROUP BY ALL""")
def t13(v):
    fields, couplings, constant = S.to_ising(_cut_model(v))
    none = F.lit(-1).cast("bigint")
    return T.union(
        fields.select(*KEY, F.lit("field").alias("kind"), "i", none.alias("j"),
                      F.col("h").alias("v")),
        couplings.select(*KEY, F.lit("coupling").alias("kind"), "i", "j",
                         F.col("coupling").alias("v")),
        constant.select(*KEY, F.lit("constant").alias("kind"), none.alias("i"), none.alias("j"),
                        F.col("constant").alias("v")))


_FROM_ISING = """
SELECT batch, instance_id, kind, i, j, sum(v) AS v FROM (
  SELECT batch, instance_id, 'linear' AS kind, i, CAST(-1 AS BIGINT) AS j, 2*h AS v FROM {fields}
  UNION ALL SELECT batch, instance_id, 'linear', i, CAST(-1 AS BIGINT), -2*coupling FROM {couplings}
  UNION ALL SELECT batch, instance_id, 'linear', j, CAST(-1 AS BIGINT), -2*coupling FROM {couplings}
  UNION ALL SELECT batch, instance_id, 'quadratic', i, j, 4*coupling FROM {couplings}
  UNION ALL SELECT batch, instance_id, 'offset', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), coupling FROM {couplings}
  UNION ALL SELECT batch, instance_id, 'offset', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), -h FROM {fields}
) t GROUP BY ALL"""


@query("t14_from_ising", _FROM_ISING)
def t14(v):
    v.keep("edges")
    return _stack(*S.from_ising(v.fields, v.couplings))


@query("t15_interaction_scale", """
SELECT batch, instance_id, coalesce(scale, 1.0) AS scale FROM (
  SELECT batch, instance_id FROM {sizes} UNION ALL SELECT batch, concat(instance_id, '-empty') FROM {sizes}) n
LEFT JOIN (SELECT batch, instance_id, CASE WHEN max(b) > 0 THEN max(b) ELSE 1.0 END AS scale FROM (
  SELECT batch, instance_id, i, sum(v) AS b FROM (
    SELECT batch, instance_id, i, abs(h) AS v FROM {fields}
    UNION ALL SELECT batch, instance_id, i, abs(coupling) FROM {couplings}
    UNION ALL SELECT batch, instance_id, j, abs(coupling) FROM {couplings}) t GROUP BY ALL) s
GROUP BY ALL) x USING (batch, instance_id)""")
def t15(v):
    v.keep("edges")
    # as many instances without any term as with
    bare = v.sizes.withColumn("instance_id", F.concat("instance_id", F.lit("-empty")))
    return S.interaction_scale(v.fields, v.couplings, v.sizes.unionByName(bare))


@query("t16_matrix_profile", """
WITH m AS (SELECT batch, instance_id, count(*) AS m, CAST(max(v) + 1 AS DOUBLE) AS n
           FROM {edges} GROUP BY ALL)
SELECT batch, instance_id, CAST(n AS BIGINT) AS num_variables, m AS quadratic_terms,
       2.0*m/(n*n) AS density, n*n*8/1048576.0 AS dense_mib, 2.0*m*24/1048576.0 AS sparse_mib,
       CASE WHEN 2.0*m/(n*n) <= 0.15 THEN 'sparse' ELSE 'dense' END AS advice
FROM m""")
def t16(v):
    return S.matrix_profile(_cut_model(v))


@query("t17_coupling_product", """
WITH b AS (SELECT batch, instance_id, i, j, coupling FROM {couplings}
           UNION ALL SELECT batch, instance_id, j, i, coupling FROM {couplings})
SELECT b.batch, b.instance_id, b.i, s.sample_id AS state, sum(b.coupling * (2*s.x - 1)) AS value
FROM b JOIN {samples} s ON s.instance_id = b.instance_id AND s.i = b.j GROUP BY ALL""")
def t17(v):
    v.keep("edges")
    # spins of all samples of a variable as one array in sample order
    states = v.samples.groupBy(*KEY, "i").agg(F.array_sort(F.collect_list(
        F.struct("sample_id", (2 * F.col("x") - 1).cast("double").alias("s")))).alias("a")
    ).select(*KEY, "i", F.transform("a", lambda r: r["s"]).alias("values"))
    return S.coupling_product(v.couplings, states)


_LINEAR_MODEL = f"""
WITH {_MODEL},
p AS (SELECT *, row_number() OVER (PARTITION BY batch, instance_id ORDER BY i, j) - 1 AS p FROM q),
y AS (SELECT p.*, s.num_variables + p AS y FROM p JOIN {{sizes}} s USING (batch, instance_id))"""


@query("t18_linearized_columns", _LINEAR_MODEL + """
SELECT z.batch, z.instance_id, z.col, coalesce(l.v, 0.0) AS cost, 0.0::DOUBLE AS lower, 1.0::DOUBLE AS upper,
       true AS is_integer
FROM (SELECT batch, instance_id, unnest(generate_series(CAST(0 AS BIGINT), num_variables - 1)) AS col FROM {sizes}) z
LEFT JOIN l ON l.instance_id = z.instance_id AND l.i = z.col
UNION ALL SELECT batch, instance_id, y, v, 0.0, 1.0, false FROM y""")
def t18_columns(v):
    return S.linearize(_cut_model(v))[0]


@query("t18_linearized_rows", _LINEAR_MODEL + """
SELECT batch, instance_id, 3*p AS "row", CAST(NULL AS DOUBLE) AS lower, 0.0::DOUBLE AS upper FROM y
UNION ALL SELECT batch, instance_id, 3*p + 1, NULL, 0.0 FROM y
UNION ALL SELECT batch, instance_id, 3*p + 2, -1.0, NULL FROM y""")
def t18_rows(v):
    return S.linearize(_cut_model(v))[1]


@query("t18_linearized_nonzeros", _LINEAR_MODEL + """
SELECT batch, instance_id, 3*p AS "row", i AS col, -1.0::DOUBLE AS value FROM y
UNION ALL SELECT batch, instance_id, 3*p, y, 1.0 FROM y
UNION ALL SELECT batch, instance_id, 3*p + 1, j, -1.0 FROM y
UNION ALL SELECT batch, instance_id, 3*p + 1, y, 1.0 FROM y
UNION ALL SELECT batch, instance_id, 3*p + 2, i, -1.0 FROM y
UNION ALL SELECT batch, instance_id, 3*p + 2, j, -1.0 FROM y
UNION ALL SELECT batch, instance_id, 3*p + 2, y, 1.0 FROM y""")
def t18_nonzeros(v):
    return S.linearize(_cut_model(v))[2]


@query("t19_capability_issues", """
WITH f AS (
  SELECT batch, instance_id, max(v) + 1 AS n, count(*) AS m FROM {edges} GROUP BY ALL
  UNION ALL SELECT batch, instance_id, CAST(12 AS BIGINT), count(*) FROM {route_edges} GROUP BY ALL),
t AS (SELECT *, n*32*200 AS updates, 2.0*m/(CAST(n AS DOUBLE)*n) > 0.15 AS dense FROM f)
SELECT batch, instance_id, 'error' AS severity, code,
       concat(CAST(amount AS VARCHAR), ' exceeds the limit of ', CAST(lim AS VARCHAR)) AS message
FROM (SELECT batch, instance_id, 'exact_variables' AS code, n AS amount, 24 AS lim FROM t
  UNION ALL SELECT batch, instance_id, 'exact_index_bits', n, 62 FROM t
  UNION ALL SELECT batch, instance_id, 'milp_products', m, 25000 FROM t
  UNION ALL SELECT batch, instance_id, 'milp_columns', n + m, 100000 FROM t
  UNION ALL SELECT batch, instance_id, 'annealing_updates', updates, 1000000 FROM t
  UNION ALL SELECT batch, instance_id, 'bifurcation_variables', n, 5000 FROM t
  UNION ALL SELECT batch, instance_id, 'flow_variables', n, 100000 FROM t
  UNION ALL SELECT batch, instance_id, 'flow_dense_variables', n, 10000 FROM t WHERE dense) c
WHERE amount > lim""")
def t19(v):
    v.keep("edges", "route_edges")
    big, small = encode_max_cut(v.edges, v.sizes), encode_max_cut(v.route_edges, v.route_sizes)
    both = Batch(T.union(big.instances, small.instances), T.union(big.linear, small.linear),
                 T.union(big.quadratic, small.quadratic))
    tasks = both.instances.select(*KEY, F.lit(32).cast("bigint").alias("reads"),
                                  F.lit(200).cast("bigint").alias("sweeps"))
    return S.capability_issues(both, tasks, {"annealing_updates": 1_000_000})


@query("t_canonical_model", """
WITH l AS (SELECT batch, instance_id, i, sum(v) AS v FROM (
             SELECT batch, instance_id, i, v FROM {raw_linear}
             UNION ALL SELECT batch, instance_id, i, v FROM {raw_quadratic} WHERE i = j) t GROUP BY ALL),
     q AS (SELECT batch, instance_id, least(i, j) AS i, greatest(i, j) AS j, sum(v) AS v
           FROM {raw_quadratic} WHERE i <> j GROUP BY ALL)
SELECT batch, instance_id, (SELECT count(*) FROM l WHERE l.instance_id = s.instance_id AND abs(v) > 1e-12) AS linear_terms,
       (SELECT count(*) FROM q WHERE q.instance_id = s.instance_id AND abs(v) > 1e-12) AS quadratic_terms
FROM {raw_sizes} s""")
def canonical(v):
    batch = T.canonical(instances_of(v.raw_sizes, "raw"), v.raw_linear, v.raw_quadratic)
    linear = batch.linear.groupBy(*KEY).agg(F.count("*").alias("linear_terms"))
    quadratic = batch.quadratic.groupBy(*KEY).agg(F.count("*").alias("quadratic_terms"))
    return batch.instances.select(*KEY).join(linear, KEY, "left").join(
        quadratic, KEY, "left").fillna(0)


