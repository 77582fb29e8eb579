"""Characteristics and checks of each problem family.

``*_facts`` are wide, one row per instance, and feed both ``stats.melt`` and the warning rules;
``*_issues`` are issue rows. ``sizes``: key, num_vertices. ``penalty``: key, penalty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.numbers import gcd_by
from bitloom.functions.pairs import pair_count
from bitloom.functions.stats import melt, stat_columns, std_with_zeros
from bitloom.operators.encoders import coloring_settings, overlapping_pairs
from bitloom.operators.satisfaction import WORD_VARIABLES, search_cubes
from bitloom.operators.terms import union
from bitloom.operators.validation import _nonfinite, issues, ratio
from bitloom.schemas import KEY, Batch
from bitloom.session import in_slices

# Fixed value: largest formula whose assignments are tried one by one.
SATISFIABLE_LIMIT = 16


def long_stats(facts: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Long-form characteristics without the helper columns that only rules read."""
    return melt(facts.drop(*drop))


# --- numbers ---------------------------------------------------------------------------------


def partition_facts(numbers: DataFrame) -> DataFrame:
    distinct = numbers.groupBy(*KEY, "value").agg(F.count("*").alias("c")).groupBy(*KEY).agg(
        F.count("*").alias("distinct_numbers"))
    sums = numbers.groupBy(*KEY).agg(
        *stat_columns("value", "number_statistics"), F.sum("value").alias("number_sum"),
        F.max("value").alias("_top"), F.count("*").alias("_n"))
    gcd = gcd_by(numbers, KEY, "value", "numbers_gcd")
    return sums.join(distinct, KEY).join(gcd, KEY).select(
        *KEY, *[F.col(f"`number_statistics.{s}`") for s in ("count", "min", "max", "mean", "std")],
        "number_sum",
        F.when(F.col("_top") > 0, F.length(F.bin("_top"))).otherwise(0).alias("number_bit_length"),
        "numbers_gcd",
        (1.0 - ratio(F.col("distinct_numbers"), F.col("_n"))).alias("duplicate_number_fraction"),
        ratio(F.col("_top"), F.col("number_sum")).alias("largest_number_fraction_of_sum"),
        "distinct_numbers")


def partition_stats(numbers: DataFrame) -> DataFrame:
    return long_stats(partition_facts(numbers), ("distinct_numbers",))


def partition_issues(numbers: DataFrame, params: DataFrame) -> DataFrame:
    """``params``: key, num_numbers, min_value, max_value."""
    value = F.col("value")
    facts = params.join(numbers, KEY, "left").groupBy(*KEY, "num_numbers").agg(
        F.count("value").alias("n"), F.count_if(value <= 0).alias("low"),
        F.count_if((value < F.col("min_value")) | (value > F.col("max_value"))).alias("outside"))
    return issues(facts, [
        ("invalid_partition_numbers", (F.col("n") != F.col("num_numbers")) | (F.col("low") > 0)),
        ("partition_value_out_of_range", F.col("outside"))])


# --- graphs with values ----------------------------------------------------------------------


def cut_facts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*KEY).agg(
        F.sum("w").cast("double").alias("total_edge_weight"),
        *stat_columns("w", "edge_weight_statistics"))


def cut_stats(edges: DataFrame) -> DataFrame:
    return long_stats(cut_facts(edges))


def cut_issues(edges: DataFrame, params: DataFrame) -> DataFrame:
    """``params``: key, weighted, min_edge_weight, max_edge_weight."""
    w = F.col("w")
    facts = edges.join(params, KEY).groupBy(*KEY).agg(
        F.count_if(w <= 0).alias("low"),
        F.count_if(F.col("weighted") & ((w < F.col("min_edge_weight"))
                                        | (w > F.col("max_edge_weight")))).alias("outside"))
    return issues(facts, [("nonpositive_cut_weight", F.col("low")),
                          ("cut_weight_out_of_range", F.col("outside"))])


def value_facts(vertices: DataFrame, penalty: DataFrame) -> DataFrame:
    """Vertex-value statistics with the safe penalty threshold and margin."""
    return vertices.groupBy(*KEY).agg(
        *stat_columns("value", "vertex_value_statistics"),
        F.max("value").cast("double").alias("penalty_safe_threshold"),
    ).join(penalty.select(*KEY, "penalty"), KEY).withColumn(
        "penalty_margin", F.col("penalty") - F.col("penalty_safe_threshold")).drop("penalty")


def value_issues(vertices: DataFrame, params: DataFrame) -> DataFrame:
    """``params``: key, num_vertices, weighted_vertices, min_vertex_value, max_vertex_value."""
    value = F.col("value")
    facts = params.join(vertices, KEY, "left").groupBy(*KEY, "num_vertices").agg(
        F.count("value").alias("n"), F.count_if(value <= 0).alias("low"),
        F.count_if(F.col("weighted_vertices") & ((value < F.col("min_vertex_value"))
                                                 | (value > F.col("max_vertex_value"))))
        .alias("outside"))
    return issues(facts, [
        ("invalid_vertex_values", (F.col("n") != F.col("num_vertices")) | (F.col("low") > 0)),
        ("vertex_value_out_of_range", F.col("outside"))])


def independent_set_stats(vertices: DataFrame, edges: DataFrame, penalty: DataFrame) -> DataFrame:
    conflicts = edges.groupBy(*KEY).agg(F.count("*").alias("conflicting_vertex_pairs"))
    return long_stats(value_facts(vertices, penalty).join(conflicts, KEY, "left").fillna(
        0, ["conflicting_vertex_pairs"]))


def clique_stats(vertices: DataFrame, non_edges: DataFrame, penalty: DataFrame) -> DataFrame:
    """``non_edges``: key, i, j (the second result of ``encode_clique``)."""
    stored = non_edges.groupBy(*KEY).agg(F.count("*").alias("clique_non_edges"))
    count = vertices.groupBy(*KEY).agg(F.count("*").alias("n"))
    return long_stats(
        value_facts(vertices, penalty).join(stored, KEY, "left").fillna(0, ["clique_non_edges"])
        .join(count, KEY).withColumn(
            "clique_qubo_constraint_density",
            ratio(F.col("clique_non_edges"), pair_count(F.col("n")))).drop("n"))


def clique_issues(edges: DataFrame, non_edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stored non-edges must complement the graph."""
    m = edges.groupBy(*KEY).agg(F.count("*").alias("m"))
    k = non_edges.groupBy(*KEY).agg(F.count("*").alias("k"))
    facts = sizes.join(m, KEY, "left").join(k, KEY, "left").fillna(0, ["m", "k"])
    return issues(facts, [("invalid_non_edges",
                           F.col("m") + F.col("k") != pair_count(F.col("num_vertices")))])


def coloring_facts(sizes: DataFrame, colors: int | DataFrame, one_color_penalty: float = 2.0,
                   edge_penalty: float = 1.0, colorable: DataFrame | None = None) -> DataFrame:
    """``colors`` may be a table of all three settings by key."""
    facts = coloring_settings(sizes, colors, one_color_penalty, edge_penalty).select(
        *KEY, F.col("num_colors").alias("colors"),
        (F.col("num_vertices") * F.col("num_colors")).alias("coloring_variables"),
        F.try_divide("one_color_penalty", F.nullif("edge_penalty", F.lit(0.0))).alias("one_color_to_edge_penalty_ratio"))
    if colorable is not None:
        facts = facts.join(colorable.withColumnRenamed("colorable", "colorable_when_checked"),
                           KEY, "left")
    return facts


def coloring_stats(sizes: DataFrame, colors: int | DataFrame, one_color_penalty: float = 2.0, edge_penalty: float = 1.0,
                   colorable: DataFrame | None = None) -> DataFrame:
    return long_stats(coloring_facts(sizes, colors, one_color_penalty, edge_penalty, colorable))


# --- knapsack --------------------------------------------------------------------------------


def slack_reach(slack: DataFrame) -> DataFrame:
    """Largest ``c`` such that 0..c are all subset sums by the "no gap" rule: key, represented.

    Weights are taken in order until one exceeds the sum so far by more than 1 (or is not
    positive). Among weights of one bit length only the smallest can open such a gap: once it
    fits, the sum has at least doubled it. So one row per bit length decides, at most 64 of them.
    """
    from pyspark.sql import Window

    weight = F.col("weight")
    bits = F.when(weight > 0, F.length(F.bin("weight"))).otherwise(0)
    grouped = slack.groupBy(*KEY, bits.alias("bits")).agg(
        F.min("weight").alias("low"), F.sum("weight").alias("amount"))
    earlier = Window.partitionBy(*KEY).orderBy("bits").rowsBetween(
        Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("bits").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    reached = F.coalesce(F.sum("amount").over(earlier), F.lit(0))
    gap = grouped.withColumn(
        "gap", ((F.col("low") <= 0) | (F.col("low") > reached + 1)).cast("int"))
    return gap.withColumn("gaps", F.sum("gap").over(upto)).groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(F.col("gaps") == 0, F.col("amount"))), F.lit(0))
        .alias("represented"))


def knapsack_facts(items: DataFrame, bonuses: DataFrame, capacity: DataFrame, slack: DataFrame,
                   penalty: DataFrame) -> DataFrame:
    fits = items.join(capacity, KEY).groupBy(*KEY).agg(
        *stat_columns("weight", "item_weight_statistics"),
        *stat_columns("value", "item_value_statistics"),
        F.sum("weight").alias("total_weight"), F.sum("value").alias("total_value"),
        F.count("*").alias("n"),
        F.count_if(F.col("weight") <= F.col("capacity")).alias("items_fitting_individually"))
    extra = bonuses.groupBy(*KEY).agg(
        *stat_columns("v", "quadratic_bonus_statistics"), F.sum("v").alias("bonus"),
        F.count("*").alias("pairs"))
    slots = slack.groupBy(*KEY).agg(F.count("*").alias("slack_variables"))
    threshold = (F.col("total_value") + F.coalesce("bonus", F.lit(0))).cast("double")
    return (
        fits.join(capacity, KEY).join(extra, KEY, "left").join(slots, KEY, "left")
        .fillna(0, ["slack_variables", "pairs"]).join(penalty.select(*KEY, "penalty"), KEY)
        .withColumn("quadratic_bonus_density", ratio(F.col("pairs"), pair_count(F.col("n"))))
        .withColumn("capacity_fraction_of_total_weight",
                    ratio(F.col("capacity"), F.col("total_weight"), None))
        .withColumn("penalty_safe_threshold", threshold)
        .withColumn("penalty_margin", F.col("penalty") - threshold)
        .drop("n", "pairs", "bonus", "total_value", "penalty"))


def knapsack_stats(items, bonuses, capacity, slack, penalty) -> DataFrame:
    return long_stats(knapsack_facts(items, bonuses, capacity, slack, penalty), ("total_weight",))


def knapsack_issues(items: DataFrame, bonuses: DataFrame, capacity: DataFrame, slack: DataFrame,
                    params: DataFrame) -> DataFrame:
    """``params``: key, num_items."""
    sums = items.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"),
        F.count_if(F.col("weight") <= 0).alias("bad_weights"),
        F.count_if(F.col("value") <= 0).alias("bad_values"))
    pairs = bonuses.join(params, KEY).groupBy(*KEY, "i", "j").agg(
        F.count("*").alias("rows"),
        F.count_if((F.col("i") < 0) | (F.col("i") >= F.col("j"))
                   | (F.col("j") >= F.col("num_items")) | (F.col("v") <= 0)
                   | _nonfinite(F.col("v").cast("double"))).alias("bad"),
    ).groupBy(*KEY).agg(F.sum(F.col("bad") + F.col("rows") - 1).alias("bad_bonuses"))
    facts = (params.join(sums, KEY, "left").join(capacity, KEY, "left").join(pairs, KEY, "left")
             .join(slack_reach(slack), KEY, "left"))
    count_off = F.coalesce(F.col("n"), F.lit(0)) != F.col("num_items")
    c = F.col("capacity")
    return issues(facts, [
        ("invalid_item_weights", count_off | (F.col("bad_weights") > 0)),
        ("invalid_item_values", count_off | (F.col("bad_values") > 0)),
        ("invalid_capacity", F.coalesce((c < 1) | (c > F.col("w")), F.lit(True))),
        ("invalid_quadratic_bonus", F.col("bad_bonuses")),
        ("invalid_slack_encoding", F.coalesce("represented", F.lit(0)) < c)])


# --- sets ------------------------------------------------------------------------------------


def _set_prints(members: DataFrame) -> DataFrame:
    """Per set: size and order-free 128-bit fingerprint of its members (with repeats)."""
    counted = members.groupBy(*KEY, "set_id", "element").agg(F.count("*").alias("c"))
    text = F.concat_ws(":", F.col("element").cast("string"), F.col("c").cast("string"))
    return counted.groupBy(*KEY, "set_id").agg(
        F.sum("c").alias("size"), F.bit_xor(F.xxhash64(text)).alias("p1"),
        F.bit_xor(F.xxhash64(F.concat(F.lit("#"), text))).alias("p2"))


def duplicate_set_count(members: DataFrame) -> DataFrame:
    """Sets that repeat an earlier one: key, duplicate_sets.

    Fingerprints only nominate: a set counts as a repeat after it was compared, element by
    element, with the lowest set of its fingerprint.
    """
    prints = _set_prints(members)
    group = [*KEY, "size", "p1", "p2"]
    leads = prints.groupBy(*group).agg(
        F.min("set_id").alias("lead"), F.count("*").alias("sets")).where("sets > 1")
    nominated = prints.join(leads, group).where("set_id <> lead").select(
        *KEY, "set_id", "lead", "size")
    counted = members.groupBy(*KEY, "set_id", "element").agg(F.count("*").alias("c"))
    same = nominated.join(counted, [*KEY, "set_id"]).join(
        counted.select(*KEY, F.col("set_id").alias("lead"), "element", "c"),
        [*KEY, "lead", "element", "c"])
    repeats = same.groupBy(*KEY, "set_id", "size").agg(F.sum("c").alias("matched")).where(
        "matched = size")
    return repeats.groupBy(*KEY).agg(F.count("*").alias("duplicate_sets"))


def packing_facts(members: DataFrame, set_values: DataFrame, universe: DataFrame,
                  penalty: DataFrame) -> DataFrame:
    """``universe``: key, universe_size. All groups lie within an instance, so many members go in slices of instances."""
    return in_slices(_packing_facts, [members, set_values, universe, penalty], KEY, members.count())


def _packing_facts(members, set_values, universe, penalty) -> DataFrame:
    sizes = members.groupBy(*KEY, "set_id").agg(F.count("*").alias("size")).groupBy(*KEY).agg(
        *stat_columns("size", "set_size_statistics"))
    values = set_values.groupBy(*KEY).agg(
        *stat_columns("value", "set_value_statistics"), F.count("*").alias("sets"),
        F.max("value").cast("double").alias("penalty_safe_threshold"))
    pairs = overlapping_pairs(members).groupBy(*KEY).agg(
        F.count("*").alias("overlapping_set_pairs"))
    used = members.select(*KEY, "element").distinct().groupBy(*KEY).agg(
        F.count("*").alias("used"))
    return (
        values.join(sizes, KEY, "left").join(duplicate_set_count(members), KEY, "left")
        .join(pairs, KEY, "left").join(used, KEY, "left")
        .fillna(0, ["duplicate_sets", "overlapping_set_pairs", "used"])
        .join(universe, KEY).join(penalty.select(*KEY, "penalty"), KEY)
        .withColumn("possible_set_pairs", pair_count(F.col("sets")))
        .withColumn("overlap_density",
                    ratio(F.col("overlapping_set_pairs"), F.col("possible_set_pairs")))
        .withColumn("unused_universe_elements", F.col("universe_size") - F.col("used"))
        .withColumn("penalty_margin", F.col("penalty") - F.col("penalty_safe_threshold"))
        .drop("sets", "used", "universe_size", "penalty"))


def packing_stats(members, set_values, universe, penalty) -> DataFrame:
    return long_stats(packing_facts(members, set_values, universe, penalty),
                      ("possible_set_pairs",))


def packing_issues(members: DataFrame, set_values: DataFrame, overlaps: DataFrame,
                   params: DataFrame) -> DataFrame:
    """``overlaps`` as stored: key, a, b, shared. ``params``: key, num_sets, universe_size.

    Pairs are many times the members, so many members go in slices of instances.
    """
    return in_slices(_packing_issues, [members, set_values, overlaps, params], KEY, members.count())


def _packing_issues(members, set_values, overlaps, params) -> DataFrame:
    counted = members.groupBy(*KEY, "set_id", "element").agg(F.count("*").alias("c"))
    element = F.col("element")
    by_set = counted.join(params, KEY).groupBy(*KEY, "set_id").agg(
        F.max("c").alias("c"),
        F.count_if((element < 0) | (element >= F.col("universe_size"))).alias("outside"))
    sets = union(set_values.select(*KEY, "set_id"), members.select(*KEY, "set_id")).distinct()
    checked = sets.join(by_set, [*KEY, "set_id"], "left").join(
        set_values.select(*KEY, "set_id", "value"), [*KEY, "set_id"], "left").groupBy(*KEY).agg(
        F.count("*").alias("sets"), F.count("value").alias("valued"),
        F.count_if(F.col("c").isNull() | (F.col("c") > 1)).alias("bad_sets"),
        F.count_if(F.col("outside") > 0).alias("outside"),
        F.count_if(F.col("value") <= 0).alias("bad_values"))
    # shared elements are compared one row at a time, never as whole lists
    distinct = members.select(*KEY, "set_id", "element").distinct()
    from bitloom.operators.pairing import pairs_within

    expected = pairs_within(distinct, [*KEY, "element"], "set_id").select(
        *KEY, F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "element",
        F.lit(1).alias("side"))
    stored = overlaps.select(*KEY, "a", "b", F.explode("shared").alias("element"),
                             F.lit(-1).alias("side"))
    wrong = union(expected, stored).groupBy(*KEY, "a", "b", "element").agg(
        F.sum("side").alias("side")).where("side <> 0").groupBy(*KEY).agg(
        F.count("*").alias("bad_overlaps"))
    facts = params.join(checked, KEY, "left").join(wrong, KEY, "left")
    return issues(facts, [
        ("invalid_set_count", (F.coalesce("sets", F.lit(0)) != F.col("num_sets"))
         | (F.coalesce("valued", F.lit(0)) != F.col("num_sets"))),
        ("invalid_candidate_set", F.col("bad_sets")),
        ("set_element_out_of_range", F.col("outside")),
        ("invalid_set_value", F.col("bad_values")),
        ("invalid_overlap_data", F.col("bad_overlaps"))])


# --- clauses ---------------------------------------------------------------------------------


def graded_clauses(literals: DataFrame, clauses: DataFrame, sizes: DataFrame,
                   clause_size: int) -> DataFrame:
    """One row per clause: weight, problem flags and, for usable ones, a canonical text.

    ``sizes``: key, num_variables. The text is built only from clauses of the right size, so no
    list is longer than ``clause_size``.
    """
    facts = literals.join(sizes.select(*KEY, "num_variables"), KEY).groupBy(*KEY, "clause_id").agg(
        F.count("*").alias("size"),
        F.count_if((F.col("variable") < 0) | (F.col("variable") >= F.col("num_variables"))
                   | F.col("variable").isNull()).alias("outside"))
    text = F.concat_ws(":", F.col("variable").cast("string"), F.col("negated").cast("string"))
    right = facts.where(F.col("size") == clause_size).select(*KEY, "clause_id")
    picked = literals.join(right, [*KEY, "clause_id"]).groupBy(*KEY, "clause_id").agg(
        F.array_join(F.array_sort(F.collect_list(text)), ",").alias("canonical"),
        F.count_distinct("variable").alias("variables"))
    graded = clauses.select(*KEY, "clause_id", "weight").join(
        facts, [*KEY, "clause_id"], "left").join(picked, [*KEY, "clause_id"], "left")
    bad = (F.coalesce("size", F.lit(0)) != clause_size) | (F.col("weight") <= 0)
    return graded.select(
        *KEY, "clause_id", "weight", "canonical", bad.alias("invalid"),
        (~bad & (F.col("variables") < clause_size)).alias("repeats"),
        (~bad & (F.col("outside") > 0)).alias("outside"),
        (~bad & (F.col("outside") == 0)).alias("usable"))


def clause_facts(literals: DataFrame, clauses: DataFrame, sizes: DataFrame, clause_size: int,
                 ancillas: DataFrame | None = None, planted: DataFrame | None = None) -> DataFrame:
    graded = graded_clauses(literals, clauses, sizes, clause_size)
    usable = graded.where("usable")
    weights = clauses.groupBy(*KEY).agg(
        F.count("*").alias("clauses"), *stat_columns("weight", "clause_weight_statistics"))
    distinct = usable.groupBy(*KEY, "canonical").agg(F.count("*").alias("c")).groupBy(*KEY).agg(
        F.sum(F.col("c") - 1).alias("duplicate_clauses"))
    used = literals.join(usable.select(*KEY, "clause_id"), [*KEY, "clause_id"])
    occurrences = used.groupBy(*KEY, "variable").agg(
        F.count("*").alias("c"), F.count_if(~F.col("negated")).alias("positive")
    ).groupBy(*KEY).agg(
        F.count("*").alias("used"), F.sum("c").alias("total_literals"),
        F.var_pop("c").alias("variance"), F.min("c").alias("low"),
        F.max("c").alias("high"), F.sum("positive").alias("positive"))
    base = (sizes.select(*KEY, "num_variables").join(weights, KEY, "left")
            .join(distinct, KEY, "left").join(occurrences, KEY, "left"))
    if ancillas is not None:
        facts = ancillas.join(clauses.select(*KEY, "clause_id", "weight"), [*KEY, "clause_id"],
                              "left").groupBy(*KEY).agg(
            F.count("*").alias("ancilla_variables"),
            F.count_if(F.col("penalty") <= F.col("weight")).alias("weak_ancillas"))
        base = base.join(facts, KEY, "left")
    else:
        base = base.withColumn("ancilla_variables", F.lit(0)).withColumn(
            "weak_ancillas", F.lit(0))
    if planted is not None:
        base = base.join(planted.select(*KEY).distinct().withColumn("has_planted_solution",
                                                                    F.lit(True)), KEY, "left")
    else:
        base = base.withColumn("has_planted_solution", F.lit(False))
    base = base.fillna(0, ["clauses", "duplicate_clauses", "used", "total_literals", "variance",
                           "low", "high", "positive", "ancilla_variables", "weak_ancillas"])
    n = F.col("num_variables")
    mean = ratio(F.col("total_literals"), n)
    prefix = "variable_occurrence_statistics"
    unused = n - F.col("used")
    return base.select(
        *KEY, n.alias("boolean_variables"), "clauses",
        ratio(F.col("clauses"), n).alias("clause_to_variable_ratio"),
        *[F.col(f"`clause_weight_statistics.{s}`") for s in ("count", "min", "max", "mean", "std")],
        n.alias(f"{prefix}.count"),
        F.when(unused > 0, 0).otherwise(F.col("low")).alias(f"{prefix}.min"),
        F.col("high").alias(f"{prefix}.max"), mean.alias(f"{prefix}.mean"),
        std_with_zeros(F.col("variance"), ratio(F.col("total_literals"), F.col("used")), F.col("used"), n).alias(f"{prefix}.std"),
        ratio(F.col("positive"), F.col("total_literals")).alias("positive_literal_fraction"),
        "duplicate_clauses", unused.alias("unused_boolean_variables"), "ancilla_variables",
        F.coalesce("has_planted_solution", F.lit(False)).alias("has_planted_solution"),
        "total_literals", "weak_ancillas")


def clause_stats(literals, clauses, sizes, clause_size, ancillas=None, planted=None) -> DataFrame:
    return long_stats(clause_facts(literals, clauses, sizes, clause_size, ancillas, planted),
                      ("total_literals", "weak_ancillas"))


def clause_issues(literals: DataFrame, clauses: DataFrame, sizes: DataFrame,
                  clause_size: int) -> DataFrame:
    facts = graded_clauses(literals, clauses, sizes, clause_size).groupBy(*KEY).agg(
        F.count_if("invalid").alias("a"), F.count_if("repeats").alias("b"),
        F.count_if("outside").alias("c"))
    return issues(facts, [("invalid_clause", F.col("a")),
                          ("repeated_clause_variable", F.col("b")),
                          ("literal_out_of_range", F.col("c"))])


def planted_issues(literals: DataFrame, planted: DataFrame, sizes: DataFrame) -> DataFrame:
    """``planted``: key, i, x. A malformed assignment is not also reported as broken."""
    shape = planted.join(sizes.select(*KEY, "num_variables"), KEY, "right").groupBy(
        *KEY, "num_variables").agg(
        F.count("i").alias("n"), F.count_if(~F.col("x").isin(0, 1)).alias("bad"))
    false = literals.join(
        planted.select(*KEY, F.col("i").alias("variable"), "x"), [*KEY, "variable"]).select(
        *KEY, "clause_id", (F.col("x") == F.when(F.col("negated"), 1).otherwise(0)).alias("f"))
    broken = false.groupBy(*KEY, "clause_id").agg(F.bool_and("f").alias("f")).where("f").groupBy(
        *KEY).agg(F.count("*").alias("broken"))
    malformed = (F.col("n") != F.col("num_variables")) | (F.col("bad") > 0)
    return issues(shape.where("n > 0").join(broken, KEY, "left"), [
        ("invalid_planted_assignment", malformed),
        ("broken_planted_assignment", F.when(~malformed, F.col("broken")))])


def ancilla_issues(clauses: DataFrame, ancillas: DataFrame, params: DataFrame) -> DataFrame:
    """``params``: key, clause_size."""
    m = clauses.groupBy(*KEY).agg(F.count("*").alias("m"))
    a = ancillas.groupBy(*KEY).agg(F.count("*").alias("a"))
    facts = params.join(m, KEY, "left").join(a, KEY, "left").fillna(0, ["m", "a"])
    size = F.col("clause_size")
    return issues(facts, [
        ("invalid_ancilla_count", (size == 3) & (F.col("a") != F.col("m"))),
        ("unexpected_ancillas", (size != 3) & (F.col("a") > 0))])


def satisfiable(literals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Exact satisfiability: key, satisfiable, NULL beyond 62 variables or where ``search_cubes`` gives up.

    Up to 16 variables a clause becomes two bit masks; equal clauses collapse before an instance's masks meet, so the
    list is bounded by the clauses that 16 variables allow. The assignments are tried lazily
    inside the row and stop at the first that satisfies all.
    """
    small = sizes.where(F.col("num_variables").between(0, SATISFIABLE_LIMIT))
    bit = F.expr("shiftleft(1, CAST(variable AS INT))")
    zero = F.lit(0)
    masks = literals.join(small.select(*KEY), KEY, "left_semi").groupBy(*KEY, "clause_id").agg(
        F.bit_or(F.when(F.col("negated"), zero).otherwise(bit)).alias("pos"),
        F.bit_or(F.when(F.col("negated"), bit).otherwise(zero)).alias("neg"),
    ).select(*KEY, "pos", "neg").distinct().groupBy(*KEY).agg(
        F.collect_list(F.struct("pos", "neg")).alias("m"))
    test = F.expr(
        "exists(sequence(0, shiftleft(1, CAST(num_variables AS INT)) - 1), a -> "
        "forall(m, c -> (a & c.pos) <> 0 OR (a & c.neg) <> c.neg))")
    answers = small.join(masks, KEY, "left").select(
        *KEY, F.when(F.col("m").isNull(), True).otherwise(test).alias("satisfiable"))
    larger = sizes.where((F.col("num_variables") > SATISFIABLE_LIMIT) & (F.col("num_variables") <= WORD_VARIABLES))
    if not larger.isEmpty():
        answers = union(answers, search_cubes(literals, larger))
    return sizes.select(*KEY).join(answers, KEY, "left")


# --- spins and direct coefficients -----------------------------------------------------------


def spin_facts(fields: DataFrame, couplings: DataFrame, sizes: DataFrame) -> DataFrame:
    h = fields.groupBy(*KEY).agg(
        *stat_columns("h", "field_statistics"),
        F.count_if(F.col("h") != 0).alias("nonzero_fields"))
    j = couplings.groupBy(*KEY).agg(
        *stat_columns("coupling", "coupling_statistics"),
        F.count("*").alias("couplings"), F.count_if(F.col("coupling") > 0).alias("positive"))
    return (
        sizes.select(*KEY, "num_vertices").join(h, KEY, "left").join(j, KEY, "left")
        .fillna(0, ["nonzero_fields", "couplings", "positive"])
        .withColumn("realized_field_fraction",
                    ratio(F.col("nonzero_fields"), F.col("num_vertices")))
        .withColumn("positive_coupling_fraction",
                    ratio(F.col("positive"), F.col("couplings"), None))
        .drop("num_vertices", "positive"))


def spin_stats(fields, couplings, sizes) -> DataFrame:
    return long_stats(spin_facts(fields, couplings, sizes), ("couplings",))


def spin_issues(fields: DataFrame, couplings: DataFrame, sizes: DataFrame) -> DataFrame:
    h = fields.groupBy(*KEY).agg(F.count("*").alias("n"),
                                 F.count_if(_nonfinite(F.col("h"))).alias("bad_h"))
    j = couplings.groupBy(*KEY).agg(F.count_if(_nonfinite(F.col("coupling"))).alias("bad_j"))
    facts = sizes.join(h, KEY, "left").join(j, KEY, "left")
    return issues(facts, [
        ("invalid_spin_fields", (F.coalesce("n", F.lit(0)) != F.col("num_vertices"))
         | (F.col("bad_h") > 0)),
        ("invalid_couplings", F.col("bad_j"))])


def direct_facts(batch: Batch, requested: DataFrame | None = None) -> DataFrame:
    """``requested``: key, quadratic_density."""
    from bitloom.operators.validation import term_facts

    base = term_facts(batch)
    values = union(batch.linear.where("v <> 0").select(*KEY, "v"),
                   batch.quadratic.select(*KEY, "v"))
    signs = values.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if(F.col("v") > 0).alias("positive"),
        F.count_if(F.col("v") < 0).alias("negative"), F.count_if(F.col("v") == 0).alias("zero"))
    facts = base.join(signs, KEY, "left").fillna(0, ["n", "positive", "negative", "zero"])
    asked = F.lit(None).cast("double")
    if requested is not None:
        facts = facts.join(requested.select(*KEY, "quadratic_density"), KEY, "left")
        asked = F.col("quadratic_density")
    return facts.select(
        *KEY, F.col("qubo_quadratic_density").alias("realized_quadratic_density"),
        asked.alias("requested_quadratic_density"),
        ratio(F.col("positive"), F.col("n"), None).alias("positive_coefficient_fraction"),
        ratio(F.col("negative"), F.col("n"), None).alias("negative_coefficient_fraction"),
        F.col("zero").alias("stored_zero_coefficients"),
        F.col("qubo_inactive_variables").alias("inactive_random_variables"),
        *[F.col(f"`qubo_coefficient_statistics.{s}`").alias(f"random_coefficient_statistics.{s}")
          for s in ("count", "min", "max", "mean", "std")])


def direct_stats(batch: Batch, requested: DataFrame | None = None) -> DataFrame:
    return long_stats(direct_facts(batch, requested))
