"""Structural checks, graph checks, warning rules and parameter validation.

Issue tables have one row per (instance, code): key, severity, code, message; the message carries
how many rows are affected. Facts are wide rows per instance; ``stats.melt`` makes them long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions.pairs import pair_count
from bitloom.functions.stats import melt, stat_columns, std_with_zeros
from bitloom.operators.terms import union
from bitloom.schemas import KEY, Batch

VALIDATOR_VERSION = 1


def issues(facts: DataFrame, rules: list[tuple[str, Column]], severity: str = "error") -> DataFrame:
    """Turn counts (or booleans) into issue rows where they are positive."""
    cells = [
        F.struct(F.lit(code).alias("code"),
                 F.coalesce(count.cast("bigint"), F.lit(0)).alias("_n"))
        for code, count in rules]
    return facts.select(*KEY, F.inline(F.array(*cells))).where("_n > 0").select(
        *KEY, F.lit(severity).alias("severity"), "code",
        F.concat(F.lit("affects "), F.col("_n").cast("string")).alias("message"))


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return F.coalesce(value, F.lit(empty)) if empty is not None else value


def _nonfinite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def term_issues(batch: Batch) -> DataFrame:
    """Ranges, order, duplicates, finiteness, declared counts and variable names."""
    size = batch.instances.select(*KEY, "num_variables")
    n = F.coalesce("num_variables", F.lit(0))
    linear = batch.linear.join(size, KEY, "left").groupBy(*KEY, "i").agg(
        F.count("*").alias("rows"),
        F.count_if((F.col("i") < 0) | (F.col("i") >= n) | F.col("i").isNull()).alias("outside"),
        F.count_if(_nonfinite(F.col("v"))).alias("nonfinite"),
    ).groupBy(*KEY).agg(
        F.sum("outside").alias("lin_outside"), F.sum(F.col("rows") - 1).alias("lin_repeated"),
        F.sum("nonfinite").alias("lin_nonfinite"), F.sum("rows").alias("lin_rows"))
    ordered = (F.col("i") >= 0) & (F.col("i") < F.col("j")) & (F.col("j") < n)
    quadratic = batch.quadratic.join(size, KEY, "left").groupBy(*KEY, "i", "j").agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce(ordered, F.lit(False))).alias("outside"),
        F.count_if(_nonfinite(F.col("v"))).alias("nonfinite"),
    ).groupBy(*KEY).agg(
        F.sum("outside").alias("quad_outside"), F.sum(F.col("rows") - 1).alias("quad_repeated"),
        F.sum("nonfinite").alias("quad_nonfinite"), F.sum("rows").alias("quad_rows"))
    facts = batch.instances.join(linear, KEY, "left").join(quadratic, KEY, "left")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    rules = [
        ("invalid_variable_count", n < 1),
        ("linear_index_out_of_range", number("lin_outside")),
        ("duplicate_linear_term", number("lin_repeated")),
        ("invalid_quadratic_indices", number("quad_outside")),
        ("duplicate_quadratic_term", number("quad_repeated")),
        ("nonfinite_coefficient", number("lin_nonfinite") + number("quad_nonfinite")),
        ("nonfinite_offset", _nonfinite(F.col("offset"))),
    ]
    declared = {"linear_terms": "lin_rows", "quadratic_terms": "quad_rows"}
    stated = [F.col(a) != number(b) for a, b in declared.items() if a in batch.instances.columns]
    if stated:
        rules.append(("invalid_term_count", stated[0] if len(stated) == 1 else stated[0] | stated[1]))
    if batch.variables is not None:
        names = batch.variables.groupBy(*KEY, "name").agg(F.count("*").alias("rows")).groupBy(
            *KEY).agg(F.sum("rows").alias("name_rows"),
                      F.sum(F.col("rows") - 1).alias("name_repeated"))
        facts = facts.join(names, KEY, "left")
        rules += [("invalid_variable_names", number("name_rows") != n),
                  ("duplicate_variable_names", number("name_repeated"))]
    return issues(facts, rules)


def term_facts(batch: Batch) -> DataFrame:
    """Term counts, density, inactive variables and statistics of non-zero coefficients."""
    touched = union(
        batch.linear.where("v <> 0").select(*KEY, "i"),
        batch.quadratic.select(*KEY, F.explode(F.array("i", "j")).alias("i")),
    ).distinct().groupBy(*KEY).agg(F.count("*").alias("active"))
    one, none = F.lit(1), F.lit(0)
    tagged = union(
        batch.linear.where("v <> 0").select(*KEY, "v", one.alias("l"), none.alias("q")),
        batch.quadratic.select(*KEY, "v", none.alias("l"), one.alias("q")))
    sums = tagged.groupBy(*KEY).agg(
        F.sum("l").alias("qubo_linear_terms"), F.sum("q").alias("qubo_quadratic_terms"),
        *stat_columns(F.when(F.col("v") != 0, F.col("v")), "qubo_coefficient_statistics"))
    facts = batch.instances.select(*KEY, "num_variables").join(sums, KEY, "left").join(
        touched, KEY, "left").fillna(
        0, ["qubo_linear_terms", "qubo_quadratic_terms", "active"])
    n = F.col("num_variables")
    statistics = [F.coalesce(F.col("`qubo_coefficient_statistics.count`"), F.lit(0.0)).alias(
        "qubo_coefficient_statistics.count")] + [
        F.col(f"`qubo_coefficient_statistics.{s}`") for s in ("min", "max", "mean", "std")]
    return facts.select(
        *KEY, n.alias("qubo_variables"), "qubo_linear_terms", "qubo_quadratic_terms",
        ratio(F.col("qubo_quadratic_terms"), pair_count(n)).alias("qubo_quadratic_density"),
        (n - F.col("active")).alias("qubo_inactive_variables"), *statistics)


def term_stats(batch: Batch) -> DataFrame:
    return melt(term_facts(batch))


def _graded_edges(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges with the first complaint about each (NULL for none); endpoints may be doubles."""
    u, v, n = F.col("u"), F.col("v"), F.col("num_vertices")
    problem = (
        F.when(u.isNull() | v.isNull(), "malformed_edge")
        .when((u != F.floor(u)) | (v != F.floor(v)), "noninteger_vertex")
        .when((u < 0) | (v < 0) | (u >= n) | (v >= n), "edge_out_of_range")
        .when(u == v, "self_loop"))
    return edges.join(sizes.select(*KEY, "num_vertices"), KEY).withColumn("problem", problem)


def _kept_pairs(graded: DataFrame) -> DataFrame:
    """Distinct valid pairs with their number of rows and the first row's weight."""
    return graded.where("problem IS NULL").groupBy(
        *KEY, F.least("u", "v").cast("bigint").alias("u"),
        F.greatest("u", "v").cast("bigint").alias("v"),
    ).agg(F.count("*").alias("rows"), F.min_by("w", "position").alias("w"))


def edge_issues(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Malformed, non-integer, out-of-range, self-loop, duplicate and non-finite-weight edges.

    ``edges``: key, position, u, v, w; ``sizes``: key, num_vertices.
    """
    graded = _graded_edges(edges, sizes)
    codes = ["malformed_edge", "noninteger_vertex", "edge_out_of_range", "self_loop"]
    single = graded.groupBy(*KEY).agg(*[
        F.count_if(F.col("problem") == c).alias(c) for c in codes])
    pairs = _kept_pairs(graded).groupBy(*KEY).agg(
        F.sum(F.col("rows") - 1).alias("duplicate_edge"),
        F.count_if(_nonfinite(F.col("w"))).alias("invalid_edge_weight"))
    codes += ["duplicate_edge", "invalid_edge_weight"]
    return issues(single.join(pairs, KEY, "left"), [(c, F.col(c)) for c in codes])


def valid_edges(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Simple edges with ``u < v``; invalid and repeated ones are skipped."""
    return _kept_pairs(_graded_edges(edges, sizes)).drop("rows")


def graph_facts(edges: DataFrame, sizes: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Edges, density, isolated vertices and degree statistics of simple edges.

    Isolated vertices only enter the sums, so no vertex table is joined. ``components``: key,
    components among the vertices that have an edge (``graphs.component_counts``).
    """
    degrees = edges.select(*KEY, F.explode(F.array("u", "v")).alias("u")).groupBy(
        *KEY, "u").agg(F.count("*").alias("d"))
    sums = degrees.groupBy(*KEY).agg(
        F.count("*").alias("touched"), F.sum("d").alias("ends"),
        F.var_pop("d").alias("variance"), F.min("d").alias("low"), F.max("d").alias("high"))
    base = sizes.select(*KEY, "num_vertices").join(sums, KEY, "left").fillna(
        0, ["touched", "ends", "variance", "low", "high"])
    n = F.col("num_vertices")
    isolated = n - F.col("touched")
    mean = ratio(F.col("ends"), n)
    columns = [
        *KEY, "num_vertices", (F.col("ends") / 2).cast("bigint").alias("graph_edges"),
        ratio(F.col("ends") / 2, pair_count(n)).alias("graph_density"),
        isolated.alias("isolated_vertices"),
        F.when(isolated > 0, 0).otherwise(F.col("low")).cast("bigint").alias("degree_min"),
        F.col("high").alias("degree_max"), mean.alias("degree_mean"),
        std_with_zeros(F.col("variance"), ratio(F.col("ends"), F.col("touched")), F.col("touched"), n).alias("degree_std")]
    if components is not None:
        base = base.join(components, KEY, "left")
        columns.append((F.coalesce("components", F.lit(0)) + isolated).cast("bigint")
                       .alias("graph_components"))
    return base.select(*columns)


def graph_stats(edges: DataFrame, sizes: DataFrame, components: DataFrame | None = None) -> DataFrame:
    return melt(graph_facts(edges, sizes, components).drop("num_vertices"))


def topology_issues(facts: DataFrame, params: DataFrame) -> DataFrame:
    """Does the realised graph match its declared type?

    ``facts`` from ``graph_facts`` with components; ``params``: key, graph_type, degree.
    """
    n, m = F.col("num_vertices"), F.col("graph_edges")
    expected_cycle = F.when(n == 2, 1).otherwise(n)
    kind = F.col("graph_type")
    return issues(facts.join(params.select(*KEY, "graph_type", "degree"), KEY), [
        ("wrong_complete_topology", (kind == "complete") & (m != pair_count(n))),
        ("wrong_cycle_topology", (kind == "cycle")
         & ((m != expected_cycle) | (F.col("graph_components") != 1))),
        ("wrong_regular_topology", (kind == "random_regular")
         & ((F.col("degree_min") != F.col("degree")) | (F.col("degree_max") != F.col("degree")))),
    ])


# The 26 warning codes.
WARNING_CODES = [
    "all_items_fit", "all_sets_overlap", "complete_clique_graph", "complete_conflict_graph",
    "disconnected_graph", "dominant_partition_number", "duplicate_candidate_sets",
    "duplicate_clauses", "edgeless_clique_graph", "empty_graph", "excess_colors",
    "inactive_random_variables", "interaction_free_spin_glass", "isolated_vertices",
    "identical_partition_numbers", "literal_sign_imbalance", "no_item_fits",
    "no_quadratic_interactions", "no_set_overlaps", "not_k_colorable", "one_sided_coefficients",
    "unused_boolean_variables", "weak_ancilla_penalty", "weak_penalty", "zero_edge_penalty",
    "zero_one_hot_penalty",
]

# Characteristics the rules read; a family without one of them has it NULL and stays silent.
RULE_KEYS = [
    "graph_edges", "graph_components", "isolated_vertices", "num_vertices", "penalty_margin",
    "colors", "one_color_penalty", "edge_penalty", "colorable_when_checked",
    "distinct_numbers", "largest_number_fraction_of_sum", "items_fitting_individually",
    "capacity", "total_weight", "duplicate_sets", "overlapping_set_pairs", "possible_set_pairs",
    "duplicate_clauses", "unused_boolean_variables", "positive_literal_fraction",
    "total_literals", "weak_ancillas", "couplings", "qubo_quadratic_terms", "qubo_variables",
    "inactive_random_variables", "positive_coefficient_fraction", "negative_coefficient_fraction",
]


def widen(characteristics: DataFrame, keys: list[str]) -> DataFrame:
    """Declared characteristic keys as columns (NULL where an instance lacks them)."""
    return characteristics.groupBy(*KEY).agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def warning_rules() -> list[tuple[str, Column]]:
    c = F.col
    graph = c("problem_type").isin(
        "max_cut", "independent_set", "maximum_clique", "graph_coloring", "spin_glass")
    n = c("num_vertices")
    full = c("graph_edges") == n * (n - 1) / 2
    clique, independent = (c("problem_type") == t for t in ("maximum_clique", "independent_set"))
    share = c("positive_literal_fraction")
    direct = c("problem_type") == "random_qubo"
    return [
        ("empty_graph", graph & (c("graph_edges") == 0)),
        ("disconnected_graph", graph & (c("graph_components") > 1)),
        ("isolated_vertices", graph & (c("isolated_vertices") > 0)),
        ("complete_conflict_graph", independent & full),
        ("edgeless_clique_graph", clique & (c("graph_edges") == 0)),
        ("complete_clique_graph", clique & full),
        ("weak_penalty", c("penalty_margin") <= 0),
        ("excess_colors", c("colors") >= n),
        ("zero_one_hot_penalty", c("one_color_penalty") == 0),
        ("zero_edge_penalty", (c("edge_penalty") == 0) & (c("graph_edges") > 0)),
        ("not_k_colorable", c("colorable_when_checked") == 0),
        ("identical_partition_numbers", c("distinct_numbers") == 1),
        ("dominant_partition_number", c("largest_number_fraction_of_sum") > 0.5),
        ("no_item_fits", c("items_fitting_individually") == 0),
        ("all_items_fit", c("total_weight") <= c("capacity")),
        ("duplicate_candidate_sets", c("duplicate_sets") > 0),
        ("no_set_overlaps", c("overlapping_set_pairs") == 0),
        ("all_sets_overlap", (c("possible_set_pairs") > 0)
         & (c("overlapping_set_pairs") == c("possible_set_pairs"))),
        ("duplicate_clauses", c("duplicate_clauses") > 0),
        ("unused_boolean_variables", c("unused_boolean_variables") > 0),
        ("literal_sign_imbalance", (c("total_literals") > 0) & ((share < 0.2) | (share > 0.8))),
        ("weak_ancilla_penalty", c("weak_ancillas") > 0),
        ("interaction_free_spin_glass", c("couplings") == 0),
        ("no_quadratic_interactions", direct & (c("qubo_quadratic_terms") == 0)
         & (c("qubo_variables") > 1)),
        ("inactive_random_variables", c("inactive_random_variables") > 0),
        ("one_sided_coefficients", (c("positive_coefficient_fraction") == 0)
         | (c("negative_coefficient_fraction") == 0)),
    ]


def warnings(characteristics: DataFrame, instances: DataFrame) -> DataFrame:
    """All warning rules over long-form characteristics; one pass, one row per instance."""
    wide = widen(characteristics, RULE_KEYS).join(instances.select(*KEY, "problem_type"), KEY)
    return issues(wide, [(code, test.cast("int")) for code, test in warning_rules()], "warning")


def merge_validation(instances: DataFrame, issue_parts: list[DataFrame],
                     characteristic_parts: list[DataFrame]):
    """Union issues, merge characteristics (a later part replaces a key), derive the status.

    Returns (issues, characteristics, status); status: key, status, has_warnings, version.
    """
    all_issues = union(*issue_parts)
    ranked = union(*[
        part.select(*KEY, "key", "value", "text").withColumn("_part", F.lit(n))
        for n, part in enumerate(characteristic_parts)])
    characteristics = ranked.groupBy(*KEY, "key").agg(
        F.max_by(F.struct("value", "text"), "_part").alias("c")).select(*KEY, "key", "c.*")
    flags = all_issues.groupBy(*KEY).agg(
        F.bool_or(F.col("severity") == "error").alias("failed"),
        F.bool_or(F.col("severity") == "warning").alias("warned"))
    no = F.lit(False)
    status = instances.select(*KEY).join(flags, KEY, "left").select(
        *KEY, F.when(F.coalesce("failed", no), "failed").otherwise("passed").alias("status"),
        F.coalesce("warned", no).alias("has_warnings"),
        F.lit(VALIDATOR_VERSION).alias("validator_version"))
    return all_issues, characteristics, status


PARAMETER_SCHEMA = T.StructType([
    T.StructField("owner", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("default", T.StringType()),
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("allow_none", T.BooleanType())])


def validate_parameters(schema: DataFrame, subjects: DataFrame, supplied: DataFrame):
    """Check supplied parameters against declared ones; returns (parameters, issues).

    ``schema`` as ``PARAMETER_SCHEMA``; ``subjects``: key, owner; ``supplied``: key, name, value
    (text, NULL for none), kind (integer, number, boolean, string or null). Missing ones take the
    default. The declared table is a fixed list of a few dozen rows per owner.
    """
    owned = subjects.select(*KEY, "owner")
    given = supplied.join(owned, KEY)
    unknown = given.join(schema.select("owner", "name"), ["owner", "name"], "left_anti").select(
        *KEY, F.lit("error").alias("severity"), F.lit("unknown_parameter").alias("code"),
        F.col("name").alias("message"))
    full = owned.join(schema, "owner").join(
        supplied.select(*KEY, "name", "value", "kind", F.lit(True).alias("given")),
        [*KEY, "name"], "left")
    value = F.when(F.col("given"), F.col("value")).otherwise(F.col("default"))
    kind = F.when(F.col("given"), F.col("kind")).when(
        F.col("default").isNull(), "null").otherwise(F.col("type"))
    full = full.withColumn("value", value).withColumn("kind", kind)
    number = F.expr("try_cast(value AS double)")
    expected = F.col("type")
    typed = (
        F.when(expected == "integer", (F.col("kind") == "integer"))
        .when(expected == "number", F.col("kind").isin("integer", "number"))
        .when(expected == "boolean", F.col("kind") == "boolean")
        .when(expected == "string", F.col("kind") == "string")
        .when(expected == "choice", F.array_contains("choices", F.col("value")))
        .otherwise(False))
    skip = F.col("value").isNull() & F.coalesce("allow_none", F.lit(False))
    code = (
        F.when(skip, None)
        .when(~F.coalesce(typed, F.lit(False)), "invalid_parameter_type")
        .when(F.col("min").isNotNull() & (number < F.col("min")), "parameter_below_minimum")
        .when(F.col("max").isNotNull() & (number > F.col("max")), "parameter_above_maximum"))
    checked = full.withColumn("code", code)
    broken = checked.where("code IS NOT NULL").select(
        *KEY, F.lit("error").alias("severity"), "code", F.col("name").alias("message"))
    accepted = checked.where("code IS NULL").select(*KEY, "name", "value")
    return accepted, union(unknown, broken)
