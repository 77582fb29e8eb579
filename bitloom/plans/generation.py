"""From parameters to checked batches: declared parameters, domain data, models and their validation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import encoders as E
from bitloom.operators import energy as V
from bitloom.operators import families as D
from bitloom.operators import generate as G
from bitloom.operators.graphs import component_counts, components
from bitloom.operators.ranges import spread_range
from bitloom.operators.terms import slack_weights, union
from bitloom.operators.validation import (
    PARAMETER_SCHEMA, WARNING_CODES, edge_issues, graph_facts, issues, merge_validation, term_issues, term_stats,
    topology_issues, validate_parameters, warnings,
)
from bitloom.schemas import KEY, Batch
from bitloom.session import cut
from bitloom.sources.tables import write_batch

# Declared parameters (name, type, default, min, max, choices, may be null).
_KINDS = ["erdos_renyi", "random_regular", "cycle", "complete"]
_GRAPH = [
    ("num_vertices", "integer", 20, 2, None, None, False),
    ("graph_type", "choice", "erdos_renyi", None, None, _KINDS, False),
    ("edge_probability", "number", 0.25, 0, 1, None, False),
    ("degree", "integer", 3, 1, None, None, False),
]
_WEIGHTS = [
    ("weighted", "boolean", False, None, None, None, False),
    ("min_edge_weight", "integer", 1, 1, None, None, False),
    ("max_edge_weight", "integer", 10, 1, None, None, False),
]
_VERTEX_VALUES = [
    ("weighted_vertices", "boolean", False, None, None, None, False),
    ("min_vertex_value", "integer", 1, 1, None, None, False),
    ("max_vertex_value", "integer", 10, 1, None, None, False),
    ("penalty", "number", None, 0, None, None, True),
]
PARAMETERS: dict[str, list[tuple]] = {
    "max_cut": _GRAPH + _WEIGHTS,
    "independent_set": _GRAPH + _WEIGHTS + _VERTEX_VALUES,
    "maximum_clique": _GRAPH + _WEIGHTS + _VERTEX_VALUES,
    "graph_coloring": _GRAPH + _WEIGHTS + [
        ("num_colors", "integer", 3, 1, None, None, False),
        ("one_color_penalty", "number", 2.0, 0, None, None, False),
        ("edge_penalty", "number", 1.0, 0, None, None, False),
    ],
    "number_partitioning": [
        ("num_numbers", "integer", 20, 2, None, None, False),
        ("min_value", "integer", 1, 1, None, None, False),
        ("max_value", "integer", 100, 1, None, None, False),
    ],
    "quadratic_knapsack": [
        ("num_items", "integer", 15, 1, None, None, False),
        ("min_weight", "integer", 1, 1, None, None, False),
        ("max_weight", "integer", 20, 1, None, None, False),
        ("min_value", "integer", 1, 1, None, None, False),
        ("max_value", "integer", 30, 1, None, None, False),
        ("quadratic_density", "number", 0.25, 0, 1, None, False),
        ("min_quadratic_value", "integer", 1, 1, None, None, False),
        ("max_quadratic_value", "integer", 10, 1, None, None, False),
        ("capacity_ratio", "number", 0.5, 0.01, 1, None, False),
        ("penalty", "number", None, 0, None, None, True),
    ],
    "set_packing": [
        ("universe_size", "integer", 20, 1, None, None, False),
        ("num_sets", "integer", 30, 1, None, None, False),
        ("inclusion_probability", "number", 0.15, 0, 1, None, False),
        ("weighted_sets", "boolean", True, None, None, None, False),
        ("min_set_value", "integer", 1, 1, None, None, False),
        ("max_set_value", "integer", 10, 1, None, None, False),
        ("penalty", "number", None, 0, None, None, True),
    ],
    "max_sat": [
        ("num_variables", "integer", 20, 2, None, None, False),
        ("num_clauses", "integer", 80, 1, None, None, False),
        ("clause_size", "integer", 3, 2, 3, None, False),
        ("weighted_clauses", "boolean", False, None, None, None, False),
        ("min_clause_weight", "integer", 1, 1, None, None, False),
        ("max_clause_weight", "integer", 10, 1, None, None, False),
        ("planted_solution", "boolean", True, None, None, None, False),
        ("ancilla_penalty", "number", None, 0, None, None, True),
    ],
    "spin_glass": _GRAPH + [
        ("coupling_distribution", "choice", "bimodal", None, None, ["bimodal", "gaussian"], False),
        ("coupling_scale", "number", 1.0, 0, None, None, False),
        ("field_probability", "number", 0.0, 0, 1, None, False),
        ("field_scale", "number", 1.0, 0, None, None, False),
    ],
    "random_qubo": [
        ("num_variables", "integer", 50, 1, None, None, False),
        ("quadratic_density", "number", 0.25, 0, 1, None, False),
        ("distribution", "choice", "integer", None, None, ["integer", "uniform", "normal"], False),
        ("coefficient_min", "number", -10, None, None, None, False),
        ("coefficient_max", "number", 10, None, None, None, False),
        ("normal_scale", "number", 5.0, 0, None, None, False),
        ("zero_linear_probability", "number", 0.0, 0, 1, None, False),
    ],
}
# Parameter pairs whose first must not exceed the second.
RANGES = [
    ("min_edge_weight", "max_edge_weight"), ("min_vertex_value", "max_vertex_value"), ("min_value", "max_value"),
    ("min_weight", "max_weight"), ("min_quadratic_value", "max_quadratic_value"), ("min_set_value", "max_set_value"),
    ("min_clause_weight", "max_clause_weight"), ("coefficient_min", "coefficient_max"),
]


def declared_parameters(spark: SparkSession) -> DataFrame:
    """The declared parameters of all families, as ``validate_parameters`` reads them."""
    rows = [(owner, name, kind, _text(default), *(None if b is None else float(b) for b in (low, high)), choices, none)
            for owner, listed in PARAMETERS.items() for name, kind, default, low, high, choices, none in listed]
    return spark.createDataFrame(rows, PARAMETER_SCHEMA)


def check_parameters(name: str, given: dict) -> tuple[dict, list[tuple[str, str]]]:
    """Parameters of one entry with their defaults, and what is wrong: [(code, parameter)].

    Covers unknown names, types, bounds and the rules between parameters (ranges, degrees, clause
    sizes, whole bounds of whole coefficients).
    """
    declared = {row[0]: row[1:] for row in PARAMETERS[name]}
    wrong = [("unknown_parameter", k) for k in sorted(given.keys() - declared.keys())]
    values = {k: given.get(k, d[1]) for k, d in declared.items()}
    kinds = {"integer": (int,), "number": (int, float), "boolean": (bool,), "choice": (str,)}
    for key, (kind, _, low, high, choices, none) in declared.items():
        value = values[key]
        if value is None and none:
            continue
        typed = isinstance(value, kinds[kind]) and (kind == "boolean" or not isinstance(value, bool))
        if not typed or (choices and value not in choices):
            wrong.append(("invalid_parameter_type", key))
        elif low is not None and value < low:
            wrong.append(("parameter_below_minimum", key))
        elif high is not None and value > high:
            wrong.append(("parameter_above_maximum", key))
    if not wrong:
        wrong += [("invalid_parameter_range", a) for a, b in RANGES if a in values and values[a] > values[b]]
        if values.get("graph_type") == "random_regular" and (
                values["degree"] >= values["num_vertices"] or values["degree"] * values["num_vertices"] % 2):
            wrong.append(("invalid_degree", "degree"))
        if name == "max_sat" and values["num_variables"] < values["clause_size"]:
            wrong.append(("too_few_variables", "num_variables"))
        if values.get("distribution") == "integer" and any(
                values[k] != int(values[k]) for k in ("coefficient_min", "coefficient_max")):
            wrong.append(("noninteger_bound", "coefficient_min"))
    return values, wrong


@dataclass
class Domain:
    """What models stand for: tables by name, and what can be said about them."""

    tables: dict[str, DataFrame]
    batch: Batch
    energy: Callable[[DataFrame], DataFrame] | None
    issues: list[DataFrame] = field(default_factory=list)
    stats: list[DataFrame] = field(default_factory=list)


# Families over graphs, and the order of families in a table of entries.
GRAPHS = ("max_cut", "independent_set", "maximum_clique", "graph_coloring", "spin_glass")
FAMILIES = tuple(PARAMETERS)
_SQL_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "choice": "string"}


def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def typed(grid: DataFrame, name: str) -> DataFrame:
    """The parameters of a family as columns, from the map ``parameters`` (texts) and the defaults."""
    def value(key: str, kind: str, default) -> Column:
        return F.coalesce(F.element_at("parameters", key), F.lit(_text(default))).cast(_SQL_TYPES[kind]).alias(key)

    return grid.select(*[c for c in grid.columns if c != "parameters"], *[value(*row[:3]) for row in PARAMETERS[name]])


def parameter_issues(entries: DataFrame) -> DataFrame:
    """What is wrong with the parameters of entries (key, problem_type, parameters): issue rows by key.

    Types, bounds and unknown names as in ``validate_parameters``; ranges, degrees, clause sizes and whole bounds only
    where all of them are right. A text counts as what it looks like: ``true``, a whole number, a number, else a word.
    """
    spark = entries.sparkSession
    value = F.col("value")
    kind = F.when(value.isNull(), "null").when(value.isin("true", "false"), "boolean").when(
        value.rlike("^[+-]?[0-9]+$"), "integer").when(F.expr("try_cast(value AS double)").isNotNull(), "number").otherwise("string")
    supplied = entries.select(*KEY, F.explode("parameters").alias("name", "value")).withColumn("kind", kind)
    unknown = entries.where(~F.col("problem_type").isin(*FAMILIES) | F.col("problem_type").isNull()).select(
        *KEY, F.lit("error").alias("severity"), F.lit("unknown_family").alias("code"),
        F.coalesce("problem_type", F.lit("")).alias("message"))
    accepted, wrong = validate_parameters(
        declared_parameters(spark), entries.select(*KEY, F.col("problem_type").alias("owner")), supplied)
    names = sorted({a for pair in RANGES for a in pair} | {"degree", "num_vertices", "num_variables", "clause_size"})
    picked = [F.max(F.when(F.col("name") == n, F.expr("try_cast(value AS double)"))).alias(n) for n in names]
    words = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("graph_type", "distribution")]
    wide = accepted.join(wrong.select(*KEY).distinct(), KEY, "left_anti").groupBy(*KEY).agg(*picked, *words).join(
        entries.select(*KEY, "problem_type"), KEY)
    c = F.col
    fraction = [c(n) != F.floor(c(n)) for n in ("coefficient_min", "coefficient_max")]
    rules = [*[("invalid_parameter_range", a, c(a) > c(b)) for a, b in RANGES],
             ("invalid_degree", "degree", (c("graph_type") == "random_regular") & (
                 (c("degree") >= c("num_vertices")) | ((c("degree") * c("num_vertices")) % 2 != 0))),
             ("too_few_variables", "num_variables", (c("problem_type") == "max_sat") & (c("num_variables") < c("clause_size"))),
             ("noninteger_bound", "coefficient_min", (c("distribution") == "integer") & (fraction[0] | fraction[1]))]
    cells = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(key).alias("message"))) for code, key, test in rules]
    return union(unknown, wrong, wide.select(*KEY, F.lit("error").alias("severity"), F.inline(F.array_compact(F.array(*cells)))))


def _drawn(rows: DataFrame, name: str, i, low: str, high: str, stream: int, j=0, draw: Column | None = None) -> DataFrame:
    """A drawn whole number between two parameters, or 1 where nothing is drawn."""
    made = G.random_integers(rows, name, i, F.col(low), F.col(high), stream, j)
    return made if draw is None else made.withColumn(name, F.when(draw, F.col(name)).otherwise(F.lit(1).cast("bigint")))


def _values(p: DataFrame, name: str) -> list:
    """The choices that occur in a parameter: as few as are declared."""
    return sorted(r[0] for r in p.select(name).distinct().collect())


def _graph_edges(g: DataFrame) -> DataFrame:
    shaped = g.select(*KEY, "seed", "graph_type", F.col("num_vertices").alias("n"), F.col("edge_probability").alias("density"), "degree")
    make = {"erdos_renyi": G.erdos_renyi, "random_regular": G.random_regular, "cycle": G.cycle_graph, "complete": G.complete_graph}
    bare = union(*[make[kind](shaped.where(F.col("graph_type") == kind)).select(*KEY, "u", "v") for kind in _values(g, "graph_type")])
    if "weighted" not in g.columns:
        return bare.withColumn("w", F.lit(1.0))
    settings = g.select(*KEY, "seed", "weighted", "min_edge_weight", "max_edge_weight")
    return _drawn(bare.join(settings, KEY), "w", F.col("u"), "min_edge_weight", "max_edge_weight", G.WEIGHTS, F.col("v"),
                  F.col("weighted")).select(*KEY, "u", "v", F.col("w").cast("double").alias("w"))


def draw(name: str, g: DataFrame) -> dict[str, DataFrame]:
    """Domain tables of a family for a grid (key, seed, parameters as columns; not empty)."""
    if name in GRAPHS:
        edges = cut(_graph_edges(g))
        if name == "spin_glass":
            scaled = edges.join(g.select(*KEY, "coupling_distribution", "coupling_scale"), KEY)
            couplings = union(*[G.random_couplings(
                scaled.where(F.col("coupling_distribution") == d), g, d, F.col("coupling_scale")) for d in _values(g, "coupling_distribution")])
            return {"edges": edges, "couplings": couplings,
                    "fields": G.random_fields(g, "num_vertices", F.col("field_probability"), F.col("field_scale"))}
        if name in ("independent_set", "maximum_clique"):
            vertices = _drawn(spread_range(g, "num_vertices", "u"), "value", F.col("u"), "min_vertex_value", "max_vertex_value",
                              G.VALUES, draw=F.col("weighted_vertices")).select(*KEY, "u", "value")
            more = {"non_edges": E.complement(vertices, edges)} if name == "maximum_clique" else {}
            return {"edges": edges, "vertices": vertices, **more}
        return {"edges": edges}
    if name == "number_partitioning":
        return {"numbers": _drawn(spread_range(g, "num_numbers", "i"), "value", F.col("i"), "min_value", "max_value", G.VALUES).select(
            *KEY, "i", "value")}
    if name == "quadratic_knapsack":
        items = cut(G.random_items(g, "num_items", *[[F.col(f"{b}_{n}") for b in ("min", "max")] for n in ("weight", "value")]))
        capacity = E.knapsack_capacity(items, g)
        return {"items": items, "capacity": capacity, "slack": slack_weights(capacity),
                "bonuses": G.random_bonuses(g, "num_items", "quadratic_density",
                                            (F.col("min_quadratic_value"), F.col("max_quadratic_value")))}
    if name == "set_packing":
        members = cut(G.random_sets(g))
        return {"members": members, "overlaps": E.set_overlaps(members), "set_values": _drawn(
            spread_range(g, "num_sets", "set_id"), "value", F.col("set_id"), "min_set_value", "max_set_value", G.VALUES,
            draw=F.col("weighted_sets")).select(*KEY, "set_id", "value")}
    if name == "max_sat":
        literals = cut(union(*[G.random_clauses(g.where(F.col("clause_size") == size), size, "num_variables") for size in _values(g, "clause_size")]))
        hidden = g.where("planted_solution")
        planted = cut(G.planted_assignment(hidden, "num_variables"))
        solved = G.plant(literals.join(hidden.select(*KEY), KEY, "left_semi"), planted, hidden)
        clauses = _drawn(spread_range(g, "num_clauses", "clause_id"), "weight", F.col("clause_id"), "min_clause_weight",
                         "max_clause_weight", G.VALUES, draw=F.col("weighted_clauses")).select(*KEY, "clause_id", "weight")
        free = literals.join(hidden.select(*KEY), KEY, "left_anti").select(*solved.columns)
        return {"literals": union(solved, free), "clauses": clauses, "planted": planted}
    span = [F.col(n) for n in ("coefficient_min", "coefficient_max", "normal_scale")]
    linear, quadratic = [], []
    for d in _values(g, "distribution"):
        of = g.where(F.col("distribution") == d)
        linear.append(G.random_linear(of, "num_variables", F.col("zero_linear_probability"), d, *span))
        quadratic.append(G.coefficients(G.sample_pairs(of, "num_variables", "quadratic_density"), d, F.col("i"), F.col("j"),
                                        *span).select(*KEY, "i", "j", "v"))
    return {"linear": union(*linear), "quadratic": union(*quadratic)}


def _penalty(p: DataFrame, default: DataFrame) -> DataFrame:
    """The given penalty, else the family's own."""
    return default.join(p.select(*KEY, F.col("penalty").alias("given")), KEY).select(
        *KEY, F.coalesce("given", F.col("penalty").cast("double")).alias("penalty"))


def _on_graph(name: str, p: DataFrame, t: dict[str, DataFrame]) -> Domain:
    edges = t["edges"]
    sizes = p.select(*KEY, "num_vertices", F.col("num_vertices").alias("num_variables"))
    vertices = t.get("vertices", spread_range(sizes, "num_vertices", "u").select(*KEY, "u"))
    listed = edges.withColumn("position", F.lit(0))
    facts = cut(graph_facts(edges, sizes, component_counts(components(vertices, edges))))
    found = [edge_issues(listed, sizes), topology_issues(facts, p)]
    stats = [D.long_stats(facts, ("num_vertices",))]
    if name == "max_cut":
        return Domain(t, E.encode_max_cut(edges, sizes), lambda s: V.cut_energy(edges, s),
                      [*found, D.cut_issues(edges, p.select(*KEY, "weighted", "min_edge_weight", "max_edge_weight"))],
                      [*stats, D.cut_stats(edges)])
    if name == "graph_coloring":
        return Domain(t, E.encode_coloring(vertices, edges, p, sizes=sizes), lambda s: V.coloring_energy(vertices, edges, s, p),
                      found, [*stats, D.coloring_stats(sizes, p)])
    if name == "spin_glass":
        fields, couplings = t["fields"], t["couplings"]
        return Domain(t, E.encode_spin_glass(fields, couplings, sizes), lambda s: V.ising_energy(fields, couplings, s),
                      [*found, D.spin_issues(fields, couplings, sizes)], [*stats, D.spin_stats(fields, couplings, sizes)])
    penalty = _penalty(p, vertices.groupBy(*KEY).agg((F.max("value") + 1).alias("penalty")))
    found.append(D.value_issues(vertices, p.select(*KEY, "num_vertices", "weighted_vertices", "min_vertex_value", "max_vertex_value")))
    if name == "independent_set":
        return Domain(t, E.encode_independent_set(vertices, edges, penalty, sizes),
                      lambda s: V.independent_set_energy(vertices, edges, penalty, s), found,
                      [*stats, D.independent_set_stats(vertices, edges, penalty)])
    return Domain(t, E.encode_clique(vertices, edges, penalty, sizes)[0], lambda s: V.clique_energy(vertices, edges, penalty, s),
                  [*found, D.clique_issues(edges, t["non_edges"], sizes)], [*stats, D.clique_stats(vertices, t["non_edges"], penalty)])


def _on_clauses(p: DataFrame, t: dict[str, DataFrame]) -> Domain:
    batches, energies, found, stats = [], [], [], []
    for size in _values(p, "clause_size"):
        of = p.where(F.col("clause_size") == size)
        literals, clauses, planted = (t[n].join(of.select(*KEY), KEY, "left_semi") for n in ("literals", "clauses", "planted"))
        sizes = of.select(*KEY, "num_variables")
        batch, ancillas = E.encode_max_sat(literals, clauses, size, of, sizes)
        batches.append(batch)
        energies.append((of, (lambda s, a=literals, c=clauses, z=ancillas: V.sat3_energy(a, c, z, s)) if size == 3 else (
            lambda s, a=literals, c=clauses: V.unsatisfied_weight(a, c, s))))
        held = of.where("planted_solution").select(*KEY)
        found += [D.clause_issues(literals, clauses, sizes, size),
                  D.planted_issues(literals.join(held, KEY, "left_semi"), planted, sizes.join(held, KEY, "left_semi"))]
        stats.append(D.clause_stats(literals, clauses, sizes, size, ancillas, planted))
    return Domain(t, _together(batches), _energies(energies), found, stats)


def model(name: str, p: DataFrame, t: dict[str, DataFrame]) -> Domain:
    """Models of a family from its parameters as columns and its domain tables, drawn or stored."""
    if name in GRAPHS:
        return _on_graph(name, p, t)
    if name == "number_partitioning":
        numbers = t["numbers"]
        return Domain(t, E.encode_partition(numbers, p.select(*KEY, F.col("num_numbers").alias("num_variables"))),
                      lambda s: V.partition_energy(numbers, s),
                      [D.partition_issues(numbers, p.select(*KEY, "num_numbers", "min_value", "max_value"))], [D.partition_stats(numbers)])
    if name == "quadratic_knapsack":
        items, bonuses, capacity, slack = (t[n] for n in ("items", "bonuses", "capacity", "slack"))
        bonus = bonuses.groupBy(*KEY).agg(F.sum("v").alias("bonus"))
        penalty = _penalty(p, items.groupBy(*KEY).agg(F.sum("value").alias("total")).join(bonus, KEY, "left").select(
            *KEY, (F.col("total") + F.coalesce("bonus", F.lit(0)) + 1).alias("penalty")))
        return Domain(t, E.encode_knapsack(items, bonuses, p, penalty)[0],
                      lambda s: V.knapsack_energy(items, bonuses, capacity, slack, penalty, s),
                      [D.knapsack_issues(items, bonuses, capacity, slack, p.select(*KEY, "num_items"))],
                      [D.knapsack_stats(items, bonuses, capacity, slack, penalty)])
    if name == "set_packing":
        members, values = t["members"], t["set_values"]
        penalty = _penalty(p, values.groupBy(*KEY).agg((F.max("value") + 1).alias("penalty")))
        overlaps = E.overlapping_pairs(members)
        return Domain(t, E.encode_set_packing(members, values, penalty), lambda s: V.packing_energy(overlaps, values, penalty, s),
                      [D.packing_issues(members, values, t["overlaps"], p.select(*KEY, "num_sets", "universe_size"))],
                      [D.packing_stats(members, values, p.select(*KEY, "universe_size"), penalty)])
    if name == "max_sat":
        return _on_clauses(p, t)
    batch = E.encode_direct(t["linear"], t["quadratic"], p.select(*KEY, "num_variables"))
    return Domain({}, batch, None, [], [D.direct_stats(batch, p.select(*KEY, "quadratic_density"))])


def _together(batches: list[Batch]) -> Batch:
    columns = [*KEY, "problem_type", "num_variables", "offset"]
    return Batch(union(*[b.instances.select(*columns) for b in batches]), union(*[b.linear.select(*KEY, "i", "v") for b in batches]),
                 union(*[b.quadratic.select(*KEY, "i", "j", "v") for b in batches]))


def _energies(parts: list[tuple[DataFrame, Callable]]) -> Callable:
    """One energy for samples of all parts (instances, energy)."""
    return lambda s: union(*[f(s.join(of.select(*KEY), KEY, "left_semi")).select(
        *KEY, "sample_id", F.col("energy").cast("double").alias("energy")) for of, f in parts])


def intended_samples(instances: DataFrame) -> DataFrame:
    """All assignments of small instances, probes of the others, packed: what an encoding check looks at."""
    small = F.col("num_variables") <= V.EXHAUSTIVE_LIMIT
    columns = [*KEY, "block", "i", "known", "mask"]
    return union(V.all_words(instances.where(small)).select(*columns),
                 V.pack_samples(V.probe_samples(instances.where(~small))).select(*columns))


def validate(domain: Domain):
    """Structure, family rules, encoding and warnings: (issues, characteristics, status, encoding)."""
    parts, stats = [term_issues(domain.batch), *domain.issues], [term_stats(domain.batch), *domain.stats]
    encoding = None
    if domain.energy is not None:
        samples = cut(intended_samples(domain.batch.instances))
        encoding = cut(V.check_encoding(domain.batch, domain.energy(samples), samples))
        parts.append(issues(encoding, [
            ("encoding_mismatch", F.col("mismatches")),
            ("incomplete_encoding_check", (F.col("method") == "incomplete").cast("int"))]))
    characteristics = cut(merge_validation(domain.batch.instances, parts, stats)[1])
    parts.append(warnings(characteristics, domain.batch.instances))
    return cut(union(*parts)), characteristics, encoding


def _each(spark: SparkSession, names: list[str], work: Callable[[str], object]) -> list:
    """``work`` for every family at once: their jobs are many and short, and none waits for another family's."""
    with ThreadPoolExecutor(max(1, len(names))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), names))


def _present(instances: DataFrame) -> list[str]:
    found = _values(instances, "problem_type")
    return [name for name in FAMILIES if name in found]


def validate_stored(instances: DataFrame, batch: Batch, tables: dict[str, DataFrame]):
    """Check stored models against their domain tables, family by family: (issues, characteristics, status, encoding).

    ``instances``: key, problem_type, parameters (map of texts). ``tables`` by name for all families at once, as
    ``draw`` names them. The stored terms are what is checked: their structure, the family's rules on its tables, and their
    energies against the family's own. Wrong parameters and unknown families are issues; such instances, and
    families whose tables were not all stored, are checked for their structure alone.
    """
    instances = cut(instances.select(*KEY, "problem_type", "parameters"))
    broken = cut(parameter_issues(instances))
    wrong = broken.select(*KEY).distinct()
    sound = instances.join(wrong, KEY, "left_anti")
    whole = [name for name in _present(sound) if all(n in tables for n in TABLES_OF[name])]

    def check(name: str):
        p = cut(typed(sound.where(F.col("problem_type") == name), name))

        def of(table: DataFrame) -> DataFrame:
            return table.join(p.select(*KEY), KEY, "left_semi")

        stored = Batch(of(batch.instances), of(batch.linear), of(batch.quadratic))
        own = {n: of(tables[n]) for n in TABLES_OF[name]}
        domain = model(name, p, {**own, "linear": stored.linear, "quadratic": stored.quadratic})
        return validate(Domain(domain.tables, stored, domain.energy, domain.issues, domain.stats))

    checked = _each(batch.linear.sparkSession, whole, check)
    bare = union(sound.where(~F.col("problem_type").isin(whole)).select(*KEY), instances.join(wrong, KEY, "left_semi").select(*KEY))
    plain = Batch(*[df.join(bare, KEY, "left_semi") for df in (batch.instances, batch.linear, batch.quadratic)])
    encodings = [encoding for _, _, encoding in checked if encoding is not None]
    return *merge_validation(instances, [broken, term_issues(plain), *[found for found, _, _ in checked]],
                             [term_stats(plain), *[known for _, known, _ in checked]]), union(*encodings) if encodings else None


# Domain tables that a family's checks need.
TABLES_OF = {
    "max_cut": ("edges",), "independent_set": ("edges", "vertices"), "maximum_clique": ("edges", "vertices", "non_edges"),
    "graph_coloring": ("edges",), "number_partitioning": ("numbers",), "quadratic_knapsack": ("items", "bonuses", "capacity", "slack"),
    "set_packing": ("members", "overlaps", "set_values"), "max_sat": ("literals", "clauses", "planted"),
    "spin_glass": ("edges", "fields", "couplings"), "random_qubo": (),
}


# Columns of the domain tables besides the key.
DOMAIN_COLUMNS = {
    "edges": "u long, v long, w double", "vertices": "u long, value long", "non_edges": "i long, j long",
    "numbers": "i long, value long", "items": "i long, weight long, value long", "bonuses": "i long, j long, v long",
    "capacity": "capacity long", "slack": "k long, weight long", "members": "set_id long, element long",
    "overlaps": "a long, b long, shared array<long>", "set_values": "set_id long, value long",
    "literals": "clause_id long, pos long, variable long, negated boolean", "clauses": "clause_id long, weight long",
    "planted": "i long, x long", "fields": "i long, h double", "couplings": "i long, j long, coupling double",
}


@dataclass
class Generated:
    """A generated table of entries: seeds and parameters (``grid``), models, domain tables and their validation."""

    grid: DataFrame
    batch: Batch | None
    tables: dict[str, DataFrame]
    issues: DataFrame
    characteristics: DataFrame | None
    status: DataFrame
    encoding: DataFrame | None


def _build(grid: DataFrame):
    """Draw, encode and check every instance of a grid (key, seed, problem_type, parameters): one plan per family."""
    def build(name: str):
        g = cut(typed(grid.where(F.col("problem_type") == name), name))
        t = {n: cut(df) for n, df in draw(name, g).items()}
        domain = model(name, g.drop("seed"), t)
        held = Batch(*[cut(df) for df in (domain.batch.instances, domain.batch.linear, domain.batch.quadratic)])
        return held, {n: t[n] for n in TABLES_OF[name]}, *validate(Domain(t, held, domain.energy, domain.issues, domain.stats))

    made = _each(grid.sparkSession, _present(grid), build)
    tables: dict[str, DataFrame] = {}
    for _, own, *_ in made:
        for n, df in own.items():
            tables[n] = df if n not in tables else union(tables[n], df.select(*tables[n].columns))
    encodings = [encoding for *_, encoding in made if encoding is not None]
    return (_together([held for held, *_ in made]), tables, [found for _, _, found, _, _ in made],
            [known for _, _, _, known, _ in made], union(*encodings) if encodings else None)


def generate(grid: DataFrame, reject: list[str] | None = None, max_attempts: int = 1) -> Generated:
    """Draw, encode and validate all instances of a grid: key, seed, problem_type, parameters (map of texts).

    A grid may mix families and parameters; every family is one plan over all its instances. Instances with wrong
    parameters get error rows, the status ``failed`` and no model. Up to ``max_attempts`` times, instances with errors or
    one of the warnings ``reject`` are drawn again with a seed moved on by ``ATTEMPT_STEP``; the last draw stays.
    """
    unknown = sorted(set(reject or []) - set(WARNING_CODES))
    if unknown:
        raise ValueError("unknown warning codes: " + ", ".join(unknown))
    grid = cut(grid.select(*KEY, F.col("seed").cast("bigint").alias("seed"), "problem_type", "parameters"))
    broken = cut(parameter_issues(grid))
    todo = cut(grid.join(broken.select(*KEY).distinct(), KEY, "left_anti"))
    seeds, batches, tables, parts, stats, encodings = [], [], {}, [broken], [], []
    for attempt in range(max_attempts):
        if todo.isEmpty():
            break
        batch, drawn, found, known, encoding = _build(todo)
        bad = cut(union(*found).where((F.col("severity") == "error") | F.col("code").isin(reject or [])).select(*KEY).distinct())
        again = attempt + 1 < max_attempts
        stays = cut(todo.join(bad, KEY, "left_anti") if again else todo)

        def kept(df: DataFrame, stays=stays) -> DataFrame:
            return df.join(stays.select(*KEY), KEY, "left_semi")

        seeds.append(stays)
        batches.append(Batch(kept(batch.instances), kept(batch.linear), kept(batch.quadratic)))
        for n, df in drawn.items():
            tables[n] = kept(df) if n not in tables else union(tables[n], kept(df).select(*tables[n].columns))
        parts += [kept(df) for df in found]
        stats += [kept(df) for df in known]
        if encoding is not None:
            encodings.append(kept(encoding))
        if not again:
            break
        todo = cut(todo.join(bad, KEY, "left_semi").withColumn("seed", F.col("seed") + G.ATTEMPT_STEP))
    if not batches:
        return Generated(grid, None, {}, broken, None, merge_validation(grid, [broken], [_no_stats(grid)])[2], None)
    whole = _together(batches)
    final = union(*seeds)
    whole = Batch(whole.instances.join(final.select(*KEY, "seed", "parameters"), KEY), whole.linear, whole.quadratic)
    return Generated(final, whole, tables, *merge_validation(grid, parts, stats), union(*encodings) if encodings else None)


def _no_stats(grid: DataFrame) -> DataFrame:
    return grid.select(*KEY, F.lit("seed").alias("key"), F.col("seed").cast("double").alias("value"), F.lit(None).cast("string").alias("text"))


def generate_entries(entries: DataFrame, base_seed: int = 0, reject: list[str] | None = None, max_attempts: int = 1,
                     path: str | None = None) -> Generated:
    """Generate a table of entries (batch, entry, count, seed or NULL, problem_type, parameters) and store the outcome.

    Below ``path`` go the terms (``write_batch``), the domain tables (``domain/<name>``), ``issues``, ``characteristics`` and
    ``status``; ``instances`` is written last.
    """
    made = generate(seed_grid_of(entries, base_seed), reject, max_attempts)
    if path is not None and made.batch is not None:
        for name, df in {**{f"domain/{n}": df for n, df in made.tables.items()}, "issues": made.issues,
                         "characteristics": made.characteristics, "status": made.status}.items():
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
        write_batch(made.batch, path)
    return made


def seed_grid_of(entries: DataFrame, base_seed: int = 0) -> DataFrame:
    return G.seed_grid(entries, base_seed).select(*KEY, "seed", "problem_type", "parameters")


def read_domain(spark: SparkSession, path: str, families: list[str] | tuple[str, ...] = FAMILIES) -> dict[str, DataFrame]:
    """The domain tables of families that ``generate_entries`` stored below ``path``."""
    names = sorted({n for family in families for n in TABLES_OF[family]})
    return {name: spark.read.schema(f"batch string, instance_id string, {DOMAIN_COLUMNS[name]}").parquet(f"{path}/domain/{name}")
            for name in names}


def generate_batch(grid: DataFrame, name: str, parameters: dict | None = None) -> Generated:
    """``generate`` for a grid (key, seed) of one family and one set of parameters."""
    values, wrong = check_parameters(name, parameters or {})
    given = values if not wrong else parameters or {}
    texts = [F.lit(x) for k, v in given.items() if v is not None for x in (k, _text(v))]
    full = grid.select(*KEY, "seed").withColumns({
        "problem_type": F.lit(name), "parameters": (F.create_map(*texts) if texts else F.create_map()).cast("map<string,string>")})
    return generate(full)
