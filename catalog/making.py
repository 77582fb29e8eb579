"""Generation of whole entry tables (U-1, G-15, S-6) and re-validation by problem type (D-24).

Every supplier is an entry; its key and nation set the parameters. One in ten has a size below the minimum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bitloom.plans import generation as P
from bitloom.schemas import KEY, Batch
from bitloom.session import shared_folder
from bitloom.sources.tables import read_batch
from catalog.base import query

# Parameters by family as SQL, the size first, and the number of variables that a model must have.
_N = "(4 + s_nationkey % 4)"
_GRAPH = {"num_vertices": _N, "graph_type": "CASE s_suppkey % 3 WHEN 0 THEN 'cycle' WHEN 1 THEN 'complete' ELSE 'erdos_renyi' END",
          "edge_probability": "0.6"}
_EVEN = "CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END"
_WEIGHTED = {"weighted": _EVEN, "max_edge_weight": "3 + s_nationkey"}
_FAMILIES = {
    "max_cut": ({**_GRAPH, **_WEIGHTED}, _N),
    "independent_set": ({**_GRAPH, **_WEIGHTED, "weighted_vertices": "'true'", "penalty": "20 + s_nationkey"}, _N),
    "maximum_clique": ({**_GRAPH, "weighted_vertices": "'true'", "max_vertex_value": "2 + s_nationkey"}, _N),
    "graph_coloring": ({**_GRAPH, "num_colors": "2 + s_suppkey % 2", "edge_penalty": "1.5"}, f"{_N} * (2 + s_suppkey % 2)"),
    "number_partitioning": ({"num_numbers": _N, "min_value": "5", "max_value": "50 + s_nationkey"}, _N),
    "quadratic_knapsack": ({"num_items": _N, "max_weight": "5", "quadratic_density": "0.5", "capacity_ratio": "0.4"}, _N),
    "set_packing": ({"num_sets": _N, "universe_size": "6 + s_nationkey % 3", "inclusion_probability": "0.4"}, _N),
    "max_sat": ({"num_variables": _N, "num_clauses": "3", "clause_size": "2 + s_suppkey % 2", "weighted_clauses": "'true'",
                 "planted_solution": "CASE WHEN s_nationkey % 2 = 0 THEN 'true' ELSE 'false' END"}, f"{_N} + (s_suppkey % 2) * 3"),
    "spin_glass": ({**_GRAPH, "coupling_distribution": "CASE WHEN s_suppkey % 2 = 0 THEN 'bimodal' ELSE 'gaussian' END",
                    "field_probability": "0.5"}, _N),
    "random_qubo": ({"num_variables": _N, "distribution": "CASE s_suppkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'uniform' ELSE 'normal' END",
                     "coefficient_min": "-3 - s_nationkey", "coefficient_max": "7", "zero_linear_probability": "0.1"}, _N),
}


def _entries(v, names: list[str]):
    """The suppliers as entries; with several families, they take turns."""
    def texts(name: str) -> str:
        values = {k: f"CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE {sql} END" if n == 0 else sql
                  for n, (k, sql) in enumerate(_FAMILIES[name][0].items())}
        return "map(" + ", ".join(f"'{k}', CAST({sql} AS STRING)" for k, sql in values.items()) + ")"

    def turn(k: int) -> str:
        return "true" if len(names) == 1 else f"(s_suppkey DIV 10) % {len(names)} = {k}"

    return v.sql(" UNION ALL ".join(f"""SELECT 'made' AS batch, s_suppkey AS entry, 1L AS count, CAST(NULL AS BIGINT) AS seed,
        '{name}' AS problem_type, {texts(name)} AS parameters FROM {{supplier}} WHERE {turn(k)}""" for k, name in enumerate(names)))


def _sizes(made):
    """num_variables of every model, the number of items for a knapsack."""
    sizes = made.batch.instances.select(*KEY, "num_variables")
    if "items" not in made.tables:
        return sizes
    items = made.tables["items"].groupBy(*KEY).agg(F.count("*").alias("items"))
    return sizes.join(items, KEY, "left").select(*KEY, F.coalesce("items", "num_variables").alias("num_variables"))


def _outcome(v, names: list[str], **options):
    entries = _entries(v, names)
    made = P.generate_entries(entries, **options)
    asked = P.seed_grid_of(entries).select(*KEY, "problem_type")
    status = asked.join(made.status.select(*KEY, "status"), KEY).join(_sizes(made), KEY, "left")
    if made.encoding is None:
        return status.withColumn("mismatches", F.lit(None).cast("bigint"))
    return status.join(made.encoding.select(*KEY, "mismatches"), KEY, "left")


def _expected(names: list[str]) -> str:
    def part(k: int, name: str) -> str:
        turn = "true" if len(names) == 1 else f"(s_suppkey // 10) % {len(names)} = {k}"
        checked = "NULL" if name == "random_qubo" else "0"
        return f"""SELECT 'made' AS batch, 'seed_' || (s_suppkey * 1000000) AS instance_id, '{name}' AS problem_type,
CASE WHEN s_suppkey % 10 = 9 THEN 'failed' ELSE 'passed' END AS status,
CASE WHEN s_suppkey % 10 <> 9 THEN CAST({_FAMILIES[name][1]} AS BIGINT) END AS num_variables,
CASE WHEN s_suppkey % 10 <> 9 THEN CAST({checked} AS BIGINT) END AS mismatches FROM {{supplier}} WHERE {turn}"""

    return " UNION ALL ".join(part(k, name) for k, name in enumerate(names))


def _register(name: str) -> None:
    @query(f"u1_generate_{name}", _expected([name]))
    def one(v):
        return _outcome(v, [name])


for _name in _FAMILIES:
    _register(_name)


@query("u1_generate_mixed", _expected(list(_FAMILIES)))
def mixed(v):
    return _outcome(v, list(_FAMILIES), reject=["empty_graph"], max_attempts=2)


_ERRORS = """CASE WHEN s_suppkey % 10 = 9 THEN 'parameter_below_minimum'
WHEN s_suppkey % 10 = 3 AND problem_type = 'random_qubo' THEN 'nonfinite_offset'
WHEN s_suppkey % 10 = 3 THEN 'encoding_mismatch'
WHEN s_suppkey % 10 = 5 AND problem_type = 'number_partitioning' THEN 'encoding_mismatch,partition_value_out_of_range' END"""


@query("d24_revalidate_families", f"""
SELECT batch, instance_id, problem_type, CASE WHEN errors IS NULL THEN 'passed' ELSE 'failed' END AS status, errors
FROM (SELECT *, {_ERRORS} AS errors FROM (SELECT *, CAST(substr(instance_id, 6) AS BIGINT) // 1000000 AS s_suppkey
    FROM ({_expected(list(_FAMILIES))}) e) x) y""")
def d24_families(v):
    """A stored batch of all ten families, some spoilt, from its files."""
    path = f"{shared_folder(v.spark)}/{uuid.uuid4().hex}"
    entries = _entries(v, list(_FAMILIES))
    P.generate_entries(entries, path=path)
    stored = read_batch(v.spark, path)
    tables = P.read_domain(v.spark, path, [row[0] for row in stored.instances.select("problem_type").distinct().collect()])
    supplier = F.expr("CAST(substring(instance_id, 6) AS BIGINT) DIV 1000000 % 10")
    wrong = F.when(F.col("problem_type") == "random_qubo", F.lit(float("nan"))).otherwise(F.col("offset") + 1)
    spoilt = stored.instances.withColumn("offset", F.when(supplier == 3, wrong).otherwise(F.col("offset")))
    if "numbers" in tables:
        tables["numbers"] = tables["numbers"].withColumn("value", F.when(
            (supplier == 5) & (F.col("i") == 0), F.col("value") + 1000).otherwise(F.col("value")))
    asked = P.seed_grid_of(entries)
    found, _, status, _ = P.validate_stored(asked, Batch(spoilt, stored.linear, stored.quadratic), tables)
    errors = found.where("severity = 'error'").groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("errors"))
    return asked.select(*KEY, "problem_type").join(status.select(*KEY, "status"), KEY).join(errors, KEY, "left")
