"""Views that turn the given tables into quadratic-model data, and the query registry.

Each view is one SQL text that Spark and DuckDB both run. All of them read whole tables and are
linear in them (aggregations and key joins, no self-joins), and vertex sets that feed dense models
are naturally bounded (months, nations, part sizes), so instances do not blow up with the data.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.session import configure, cut

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# Portable hash of (seed, i, j) in four integer steps; SERIES(n) is 0..n-1 as rows.
_HASHED = """
SELECT batch, instance_id, sample_id, i,
       CAST(CASE WHEN (z2*69621 + sample_id + 3) % 2147483647 < 1073741824 THEN 1 ELSE 0 END AS BIGINT) AS x
FROM (SELECT *, (z1*z1 + z1*48271 + i + 7) % 2147483647 AS z2
FROM (SELECT *, (z0*z0 + z0*16807 + 11) % 2147483647 AS z1
FROM (SELECT *, (i*48271 + sample_id*69621 + 12345) % 2147483647 AS z0
FROM (SELECT batch, instance_id, i, SERIES(%d) AS sample_id FROM (%s) v) s) q0) q1) q2
"""


def _samples(source: str, count: int) -> str:
    return _HASHED.replace("%d", str(count)).replace("%s", source)


VIEWS: dict[str, str] = {
    # part-supplier graph per ship year: few, huge instances
    "edges": """
SELECT 'trade' AS batch, instance_id, u, v, CAST(count(*) AS DOUBLE) AS w
FROM (SELECT CAST(year(l_shipdate) AS STRING) AS instance_id,
             least(2*l_partkey, 2*l_suppkey + 1) AS u,
             greatest(2*l_partkey, 2*l_suppkey + 1) AS v FROM {lineitem}) e
GROUP BY instance_id, u, v""",
    "vertices": """
SELECT batch, instance_id, u, u % 50 + 1 AS value
FROM (SELECT batch, instance_id, u FROM {edges}
      UNION SELECT batch, instance_id, v AS u FROM {edges}) e""",
    "sizes": """
SELECT batch, instance_id, max(v) + 1 AS num_variables, max(v) + 1 AS num_vertices
FROM {edges} GROUP BY batch, instance_id""",
    "samples": _samples("SELECT batch, instance_id, u AS i FROM {vertices}", 16),
    "couplings": """
SELECT batch, instance_id, u AS i, v AS j,
       CAST(CASE WHEN (u*7 + v*13) % 3 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS coupling FROM {edges}""",
    "fields": """
SELECT batch, instance_id, u AS i,
       CAST(CASE WHEN u % 3 <> 0 THEN 0 WHEN u % 2 = 0 THEN 2 ELSE -2 END AS DOUBLE) AS h
FROM {vertices}""",
    # order-month to ship-month graph: per order year (12 vertices, dense) ...
    "season_edges": """
SELECT 'season' AS batch, instance_id, u, v, CAST(count(*) AS DOUBLE) AS w
FROM (SELECT CAST(year(o_orderdate) AS STRING) AS instance_id,
             CAST(least(month(o_orderdate), month(l_shipdate)) - 1 AS BIGINT) AS u,
             CAST(greatest(month(o_orderdate), month(l_shipdate)) - 1 AS BIGINT) AS v
      FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey) e
WHERE u <> v GROUP BY instance_id, u, v""",
    "season_sizes": """
SELECT batch, instance_id, CAST(12 AS BIGINT) AS num_variables, CAST(12 AS BIGINT) AS num_vertices
FROM {season_edges} GROUP BY batch, instance_id""",
    # ... and per customer (12 vertices, sparse, very many instances)
    "route_edges": """
SELECT 'routes' AS batch, instance_id, u, v, CAST(count(*) AS DOUBLE) AS w
FROM (SELECT CAST(o_custkey AS STRING) AS instance_id,
             CAST(least(month(o_orderdate), month(l_shipdate)) - 1 AS BIGINT) AS u,
             CAST(greatest(month(o_orderdate), month(l_shipdate)) - 1 AS BIGINT) AS v
      FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey) e
WHERE u <> v GROUP BY instance_id, u, v""",
    "route_sizes": """
SELECT 'routes' AS batch, CAST(o_custkey AS STRING) AS instance_id,
       CAST(12 AS BIGINT) AS num_variables, CAST(12 AS BIGINT) AS num_vertices
FROM {orders} GROUP BY o_custkey""",
    "route_vertices": """
SELECT batch, instance_id, u, (CAST(instance_id AS BIGINT) + u*7) % 20 + 1 AS value
FROM (SELECT batch, instance_id, SERIES(12) AS u FROM {route_sizes}) s""",
    "route_samples": _samples("SELECT batch, instance_id, u AS i FROM {route_vertices}", 4),
    "route_couplings": """
SELECT batch, instance_id, u AS i, v AS j,
       CAST(CASE WHEN (u*7 + v*13 + CAST(w AS BIGINT)) % 2 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS coupling
FROM {route_edges}""",
    "route_colors": _samples(
        "SELECT batch, instance_id, SERIES(36) AS i FROM {route_sizes}", 4),
    # one number per customer and order month
    "numbers": """
SELECT 'months' AS batch, CAST(o_custkey AS STRING) AS instance_id,
       CAST(month(o_orderdate) - 1 AS BIGINT) AS i,
       CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) % 100 + 1 AS value
FROM {orders} GROUP BY o_custkey, month(o_orderdate)""",
    "number_samples": _samples(
        "SELECT batch, instance_id, SERIES(12) AS i FROM (SELECT DISTINCT batch, instance_id FROM {numbers}) n", 4),
    # items = part sizes of a brand; a bonus where a line's quantity equals another size
    "items": """
SELECT 'brands' AS batch, p_brand AS instance_id, CAST(p_size - 1 AS BIGINT) AS i,
       CAST(p_size AS BIGINT) AS weight, CAST(count(*) AS BIGINT) % 30 + 1 AS value
FROM {part} GROUP BY p_brand, p_size""",
    "bonuses": """
SELECT 'brands' AS batch, instance_id, i, j, CAST(count(*) AS BIGINT) % 10 + 1 AS v
FROM (SELECT p_brand AS instance_id,
             least(CAST(p_size AS BIGINT), CAST(l_quantity AS BIGINT)) - 1 AS i,
             greatest(CAST(p_size AS BIGINT), CAST(l_quantity AS BIGINT)) - 1 AS j
      FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) b
WHERE i <> j GROUP BY instance_id, i, j""",
    "item_samples": _samples(
        "SELECT batch, instance_id, SERIES(64) AS i FROM (SELECT DISTINCT batch, instance_id FROM {items}) n", 4),
    # set = supplier nation, element = order month, instance = customer
    "members": """
SELECT DISTINCT 'supply' AS batch, CAST(o_custkey AS STRING) AS instance_id,
       CAST(s_nationkey AS BIGINT) AS set_id,
       CAST((year(o_orderdate) - 1995)*12 + month(o_orderdate) - 1 AS BIGINT) AS element
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "set_values": """
SELECT DISTINCT batch, instance_id, set_id, set_id % 10 + 1 AS value FROM {members}""",
    "set_samples": _samples("SELECT batch, instance_id, set_id AS i FROM {set_values}", 4),
    # one three-literal clause per order line: part, supplier and order variables
    "clauses": """
SELECT 'sat' AS batch, instance_id, l_orderkey*8 + l_linenumber AS clause_id,
       3*min(l_partkey) AS a, 3*min(l_suppkey) + 1 AS b, 3*l_orderkey + 2 AS c,
       min(l_returnflag) = 'R' AS na, min(l_linestatus) = 'O' AS nb, l_linenumber % 2 = 1 AS nc,
       CAST(min(l_quantity) AS BIGINT) % 5 + 1 AS weight
FROM (SELECT *, CAST(year(l_shipdate) AS STRING) AS instance_id FROM {lineitem}) l
GROUP BY instance_id, l_orderkey, l_linenumber""",
    "literals": """
SELECT batch, instance_id, clause_id, pos,
       CASE pos WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS variable,
       CASE pos WHEN 0 THEN na WHEN 1 THEN nb ELSE nc END AS negated
FROM (SELECT *, SERIES(3) AS pos FROM {clauses}) c""",
    "clause_sizes": """
SELECT batch, instance_id, greatest(max(a), max(b), max(c)) + 1 AS num_variables
FROM {clauses} GROUP BY batch, instance_id""",
    "clause_samples": _samples("""
SELECT DISTINCT batch, instance_id, variable AS i FROM {literals}
UNION ALL SELECT c.batch, c.instance_id, s.num_variables + c.clause_id AS i
FROM {clauses} c JOIN {clause_sizes} s ON c.batch = s.batch AND c.instance_id = s.instance_id""", 4),
    # small formulas per customer over ten variables
    "small_clauses": """
SELECT 'small_sat' AS batch, CAST(o_custkey AS STRING) AS instance_id,
       l_orderkey*8 + l_linenumber AS clause_id,
       CAST(CASE min(l_returnflag) WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS a,
       CAST(CASE min(l_linestatus) WHEN 'F' THEN 3 ELSE 4 END AS BIGINT) AS b,
       CAST(substring(min(o_orderpriority), 1, 1) AS BIGINT) + 4 AS c,
       CAST(min(l_quantity) AS BIGINT) % 2 = 0 AS na, min(l_partkey) % 2 = 0 AS nb,
       min(l_suppkey) % 3 = 0 AS nc, CAST(min(l_quantity) AS BIGINT) % 5 + 1 AS weight
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_orderkey, l_linenumber""",
    "small_literals": """
SELECT batch, instance_id, clause_id, pos,
       CASE pos WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS variable,
       CASE pos WHEN 0 THEN na WHEN 1 THEN nb ELSE nc END AS negated
FROM (SELECT *, SERIES(3) AS pos FROM {small_clauses}) c""",
    "small_clause_sizes": """
SELECT batch, instance_id, CAST(10 AS BIGINT) AS num_variables
FROM {small_clauses} GROUP BY batch, instance_id""",
    # coefficients with repeats, reversed pairs, diagonal pairs and cancelling terms
    "raw_quadratic": """
SELECT 'raw' AS batch, CAST(year(l_shipdate) AS STRING) AS instance_id, l_suppkey AS i,
       CAST(l_quantity AS BIGINT) AS j,
       CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_linenumber - 3) AS DOUBLE) AS v
FROM {lineitem}""",
    "raw_linear": """
SELECT 'raw' AS batch, CAST(year(l_shipdate) AS STRING) AS instance_id, l_suppkey AS i,
       CAST(CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END * (l_linenumber - 2) AS DOUBLE) AS v
FROM {lineitem}""",
    "raw_sizes": """
SELECT batch, instance_id, greatest(max(i), max(j)) + 1 AS num_variables
FROM {raw_quadratic} GROUP BY batch, instance_id""",
    # one square per customer: order months weighted by order counts
    "square_members": """
SELECT 'squares' AS batch, CAST(c_nationkey AS STRING) AS instance_id, o_custkey AS constraint_id,
       CAST(month(o_orderdate) - 1 AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS a
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
GROUP BY c_nationkey, o_custkey, month(o_orderdate)""",
    "square_constraints": """
SELECT DISTINCT batch, instance_id, constraint_id, CAST(constraint_id % 3 + 1 AS DOUBLE) AS weight,
       CAST(constraint_id % 5 AS DOUBLE) - 2 AS constant FROM {square_members}""",
    # solver runs
    "runs": """
SELECT 'events' AS batch, CASE WHEN day(ts) <= 15 THEN 'results' ELSE 'results_1' END AS result_set,
       CAST(user_id AS STRING) AS instance_id, concat(event_type, '-', CAST(event_id AS STRING)) AS run_id,
       event_type AS solver_type,
       CASE WHEN event_id % 4 = 0 THEN concat(event_type, '/plain_', CAST(event_id AS STRING), '.json')
            ELSE concat(event_type, '/seed_', CAST(user_id AS STRING), '--', event_type, '_replica_',
                        CAST(event_id % 3 + 1 AS STRING), '.json') END AS file,
       CASE event_type WHEN 'signup' THEN 'optimal' WHEN 'error' THEN 'time_limit' ELSE 'completed' END AS status,
       -CAST(floor(value) AS DOUBLE) AS energy, CAST(event_id % 97 AS DOUBLE) / 8 AS wall_seconds,
       event_id AS position
FROM {events}""",
    # every run again in the other result set, with other energies
    "reruns": """
SELECT batch, result_set, instance_id, run_id, solver_type, file, status, energy, wall_seconds, position FROM {runs}
UNION ALL
SELECT batch, CASE result_set WHEN 'results' THEN 'results_1' ELSE 'results' END AS result_set, instance_id, run_id,
       solver_type, file, status, energy - 1 AS energy, wall_seconds, position + 1 AS position FROM {runs}""",
    "reads": """
SELECT 'events' AS batch, CASE WHEN event_id % 2 = 0 THEN 'results' ELSE 'results_1' END AS result_set,
       CAST(user_id AS STRING) AS instance_id, event_type AS run_id,
       event_id AS position, event_id % 3 + 1 AS occurrences,
       CASE WHEN event_id % 7 <> 0 THEN -CAST(floor(value) AS DOUBLE) END AS energy
FROM {events}""",
    "read_runs": """
SELECT batch, result_set, instance_id, run_id, CAST(sum(occurrences) AS BIGINT) AS num_reads,
       least(CAST(sum(occurrences) AS BIGINT), CAST(5 AS BIGINT)) AS k
FROM {reads} GROUP BY batch, result_set, instance_id, run_id""",
    # checkpoints: lines of an order are the checkpoints of a run
    "checkpoints": """
SELECT 'orders' AS batch, CAST(o_custkey AS STRING) AS instance_id, CAST(l_orderkey AS STRING) AS run_id,
       CAST(l_linenumber AS BIGINT) AS idx, CAST(l_linenumber AS DOUBLE) / 7 AS progress,
       CASE WHEN l_returnflag = 'R' THEN '' ELSE 'states' END AS unit,
       CAST(l_quantity AS DOUBLE) AS value, CAST(CAST(o_orderkey AS BIGINT) % 60 AS DOUBLE) AS total,
       CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS DOUBLE) - 2 END AS elapsed,
       -l_quantity AS energy
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # a small file listing: problem and result files named after customers and their orders
    "listing": """
SELECT c_mktsegment AS batch, CAST(c_custkey AS STRING) AS stem, concat('seed_', CAST(c_custkey AS STRING)) AS instance_id,
       concat(c_mktsegment, '/qubos/', CAST(c_custkey AS STRING), '.qubo') AS path, '' AS path_dir
FROM {customer}""",
}


def _series(sql: str, spark: bool) -> str:
    text = r"explode(sequence(0L, \1L - 1L))" if spark else \
        r"unnest(generate_series(CAST(0 AS BIGINT), CAST(\1 - 1 AS BIGINT)))"
    return re.sub(r"SERIES\((\d+)\)", text, sql)


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """Lazily built DataFrames of the views and the raw tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._built = configure(spark), folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in TABLES:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._built[name] = self.sql(VIEWS[name])
        return self._built[name]

    def keep(self, *names: str) -> Views:
        """Write views that a query uses several times once, as the tables they stand for."""
        for name in names:
            self._built[name] = cut(getattr(self, name))
        return self

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(
            _series(text, True), **{n: getattr(self, n) for n in _needs(text)})


def duck(sql: str) -> str:
    """DuckDB text of a query over views: ``{name}`` becomes a CTE or a table name.

    ``@"`` stands for the ``{"`` that starts JSON text.
    """
    chain: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in _needs(text):
            if name in VIEWS and name not in chain:
                visit(VIEWS[name])
                chain[name] = VIEWS[name]

    def fill(text: str) -> str:
        text = re.sub(r"\{(\w+)\}", lambda m: f"fx_{m[1]}" if m[1] in VIEWS else m[1], text)
        return _series(text, False).replace('@"', '{"')

    visit(sql)
    ctes = [f"fx_{n} AS ({fill(t)})" for n, t in chain.items()]
    body = fill(sql).strip()
    start = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if start:
        return f"WITH {start[1] or ''}" + ",\n".join([*ctes, body[start.end():]])
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` with an optional oracle over the same views."""

    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return fn

    return wrap
