"""Problem families as quadratic terms; every function encodes all instances at once.

``penalty`` arguments take ``None`` (the family's safe default), a number, or a DataFrame
``key, penalty``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.ising import from_ising
from bitloom.operators.pairing import pairs_within
from bitloom.operators.ranges import spread_range
from bitloom.operators.terms import (
    accumulate, accumulate_linear, accumulate_offset, drop_tiny, fold_diagonal, slack_weights,
    square_terms, union,
)
from bitloom.schemas import KEY, Batch
from bitloom.session import in_slices


def instances_of(sizes: DataFrame, problem_type: str, offsets: DataFrame | None = None) -> DataFrame:
    """``instances`` rows from key, num_variables and optional key, offset."""
    if offsets is None:
        sized = sizes.withColumn("offset", F.lit(0.0))
    else:
        sized = sizes.join(offsets.select(*KEY, "offset"), KEY, "left").fillna(0.0, ["offset"])
    return sized.select(*KEY, F.lit(problem_type).alias("problem_type"),
                        F.col("num_variables").cast("bigint").alias("num_variables"),
                        F.col("offset").cast("double").alias("offset"))


def sizes_from(vertices: DataFrame, column: str = "u") -> DataFrame:
    """Smallest ``n`` that covers every index of the table."""
    return vertices.groupBy(*KEY).agg((F.max(column) + 1).alias("num_variables"))


def penalties(penalty, default: DataFrame) -> DataFrame:
    """Table key, penalty; ``default`` supplies the instances and the fallback value."""
    if penalty is None:
        return default.select(*KEY, F.col("penalty").cast("double").alias("penalty"))
    if isinstance(penalty, DataFrame):
        return penalty.select(*KEY, F.col("penalty").cast("double").alias("penalty"))
    return default.select(*KEY, F.lit(float(penalty)).alias("penalty"))


def _finish(sizes, problem_type, linear, quadratic, offsets=None, variables=None) -> Batch:
    return Batch(instances_of(sizes, problem_type, offsets), drop_tiny(linear),
                 drop_tiny(quadratic), variables)


def encode_max_cut(edges: DataFrame, sizes: DataFrame | None = None) -> Batch:
    """Energy is the negative cut weight."""
    sizes = sizes if sizes is not None else sizes_from(edges, "v")
    linear = accumulate_linear(edges.select(
        *KEY, F.explode(F.array("u", "v")).alias("i"), (-F.col("w")).alias("v")))
    quadratic = accumulate(edges.select(
        *KEY, F.col("u").alias("i"), F.col("v").alias("j"), (2.0 * F.col("w")).alias("v")))
    return _finish(sizes, "max_cut", linear, quadratic)


def _value_default(vertices: DataFrame, column: str = "value") -> DataFrame:
    return vertices.groupBy(*KEY).agg((F.max(column) + 1).alias("penalty"))


def _reward(vertices: DataFrame) -> DataFrame:
    return vertices.select(*KEY, F.col("u").alias("i"), (-F.col("value")).cast("double").alias("v"))


def encode_independent_set(vertices: DataFrame, edges: DataFrame, penalty=None,
                           sizes: DataFrame | None = None) -> Batch:
    """Reward chosen vertices, penalise chosen neighbours; edge weights are ignored."""
    sizes = sizes if sizes is not None else sizes_from(vertices)
    price = penalties(penalty, _value_default(vertices))
    quadratic = edges.select(*KEY, F.col("u").alias("i"), F.col("v").alias("j")).join(
        price, KEY).select(*KEY, "i", "j", F.col("penalty").alias("v"))
    return _finish(sizes, "independent_set", _reward(vertices), quadratic)


def complement(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertex pairs without an edge: key, i, j. Their number is what the clique model needs."""
    pairs = pairs_within(vertices.select(*KEY, "u"), KEY, "u").select(
        *KEY, F.col("u_a").alias("i"), F.col("u_b").alias("j"))
    return pairs.join(
        edges.select(*KEY, F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")),
        [*KEY, "i", "j"], "left_anti")


def encode_clique(vertices: DataFrame, edges: DataFrame, penalty=None,
                  sizes: DataFrame | None = None) -> tuple[Batch, DataFrame]:
    """Like independent set on the complement; returns the batch and the non-edges."""
    sizes = sizes if sizes is not None else sizes_from(vertices)
    missing = complement(vertices, edges)
    price = penalties(penalty, _value_default(vertices))
    quadratic = missing.join(price, KEY).select(*KEY, "i", "j", F.col("penalty").alias("v"))
    return _finish(sizes, "maximum_clique", _reward(vertices), quadratic), missing


def coloring_settings(table: DataFrame, colors: int | DataFrame, one_color_penalty: float = 2.0,
                      edge_penalty: float = 1.0) -> DataFrame:
    """``table`` with num_colors, one_color_penalty and edge_penalty; ``colors`` may be a table of all three by key."""
    if isinstance(colors, DataFrame):
        return table.join(colors.select(*KEY, "num_colors", "one_color_penalty", "edge_penalty"), KEY)
    return table.withColumns({"num_colors": F.lit(colors).cast("bigint"), "one_color_penalty": F.lit(float(one_color_penalty)),
                              "edge_penalty": F.lit(float(edge_penalty))})


def encode_coloring(vertices: DataFrame, edges: DataFrame, colors: int | DataFrame = 3,
                    one_color_penalty: float = 2.0, edge_penalty: float = 1.0,
                    sizes: DataFrame | None = None) -> Batch:
    """Variable ``v * colors + c``; exactly one colour per vertex, different ones on an edge."""
    sizes = sizes if sizes is not None else sizes_from(vertices)

    def painted(table: DataFrame) -> DataFrame:
        return coloring_settings(table, colors, one_color_penalty, edge_penalty)

    k = F.col("num_colors")
    palette = F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1))
    members = painted(vertices).select(*KEY, F.col("u").alias("constraint_id"), "num_colors", palette.alias("c")).select(
        *KEY, "constraint_id", (F.col("constraint_id") * k + F.col("c")).alias("i"), F.lit(1.0).alias("a"))
    constraints = painted(vertices).select(*KEY, F.col("u").alias("constraint_id"),
                                           F.col("one_color_penalty").alias("weight"), F.lit(-1.0).alias("constant"))
    offset, linear, one_hot = square_terms(constraints, members)
    same = painted(edges).select(*KEY, "u", "v", "num_colors", "edge_penalty", palette.alias("c")).select(
        *KEY, (F.col("u") * k + F.col("c")).alias("i"), (F.col("v") * k + F.col("c")).alias("j"),
        F.col("edge_penalty").alias("v"))
    return _finish(painted(sizes).withColumn("num_variables", F.col("num_variables") * k),
                   "graph_coloring", linear, accumulate(union(one_hot, same)), offset)


def partition_square(numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The one square ``(sum 2 a_i x_i - total)^2`` in unexpanded, linear-size form."""
    totals = numbers.groupBy(*KEY).agg(F.sum("value").alias("total"))
    constraints = totals.select(*KEY, F.lit(0).cast("bigint").alias("constraint_id"),
                                F.lit(1.0).alias("weight"),
                                (-F.col("total")).cast("double").alias("constant"))
    members = numbers.select(*KEY, F.lit(0).cast("bigint").alias("constraint_id"), "i",
                             (2.0 * F.col("value")).alias("a"))
    return constraints, members


def encode_partition(numbers: DataFrame, sizes: DataFrame | None = None) -> Batch:
    """Energy is the squared difference of the two sums."""
    offset, linear, quadratic = square_terms(*partition_square(numbers))
    sizes = sizes if sizes is not None else sizes_from(numbers, "i")
    return _finish(sizes, "number_partitioning", linear, quadratic, offset)


def knapsack_capacity(items: DataFrame, ratio: float | DataFrame) -> DataFrame:
    """``max(1, int(ratio * total weight))`` per instance; ``ratio`` may be a table key, capacity_ratio."""
    totals = items.groupBy(*KEY).agg(F.sum("weight").alias("_w"))
    if isinstance(ratio, DataFrame):
        totals = totals.join(ratio.select(*KEY, "capacity_ratio"), KEY)
    else:
        totals = totals.withColumn("capacity_ratio", F.lit(float(ratio)))
    return totals.select(*KEY, F.greatest(F.lit(1), F.floor(F.col("_w") * F.col("capacity_ratio"))).cast(
        "bigint").alias("capacity"))


def knapsack_square(items: DataFrame, bonuses: DataFrame, ratio: float | DataFrame = 0.5, penalty=None):
    """The penalised capacity square in unexpanded form: (constraints, members, capacity, slack, sizes)."""
    capacity = knapsack_capacity(items, ratio)
    slack = slack_weights(capacity)
    counts = items.groupBy(*KEY).agg((F.max("i") + 1).alias("n"), F.sum("value").alias("total"))
    bonus_total = bonuses.groupBy(*KEY).agg(F.sum("v").alias("bonus"))
    facts = counts.join(bonus_total, KEY, "left").join(capacity, KEY)
    price = penalties(penalty, facts.select(
        *KEY, (F.col("total") + F.coalesce("bonus", F.lit(0)) + 1).alias("penalty")))
    facts = facts.join(price, KEY)
    constraints = facts.select(*KEY, F.lit(0).cast("bigint").alias("constraint_id"),
                               F.col("penalty").alias("weight"),
                               (-F.col("capacity")).cast("double").alias("constant"))
    members = union(
        items.select(*KEY, "i", F.col("weight").cast("double").alias("a")),
        slack.join(counts, KEY).select(*KEY, (F.col("n") + F.col("k")).alias("i"),
                                       F.col("weight").cast("double").alias("a")),
    ).withColumn("constraint_id", F.lit(0).cast("bigint"))
    slots = slack.groupBy(*KEY).agg(F.count("*").alias("slots"))
    sizes = counts.join(slots, KEY, "left").select(
        *KEY, (F.col("n") + F.coalesce("slots", F.lit(0))).alias("num_variables"))
    return constraints, members, capacity, slack, sizes


def encode_knapsack(items: DataFrame, bonuses: DataFrame, ratio: float | DataFrame = 0.5, penalty=None):
    """Quadratic knapsack; returns (batch, capacity, slack).

    Items are variables ``0..n-1``; slack weight ``k`` is variable ``n + k``.
    """
    constraints, members, capacity, slack, sizes = knapsack_square(items, bonuses, ratio, penalty)
    offset, square_linear, square_pairs = square_terms(constraints, members)
    linear = accumulate_linear(union(square_linear, items.select(
        *KEY, "i", (-F.col("value")).cast("double").alias("v"))))
    quadratic = accumulate(union(square_pairs, bonuses.select(
        *KEY, "i", "j", (-F.col("v")).cast("double").alias("v"))))
    return _finish(sizes, "quadratic_knapsack", linear, quadratic, offset), capacity, slack


def set_overlaps(members: DataFrame) -> DataFrame:
    """Set pairs ``a < b`` that share elements, with the sorted shared elements.

    A popular element's sets are paired in even cells (see ``pairs_within``). Many members go in slices of instances.
    """
    return in_slices(_set_overlaps, [members], KEY, members.count())


def _set_overlaps(members: DataFrame) -> DataFrame:
    distinct = members.select(*KEY, "set_id", "element").distinct()
    pairs = pairs_within(distinct, [*KEY, "element"], "set_id")
    return pairs.groupBy(*KEY, F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).agg(
        F.array_sort(F.collect_list("element")).alias("shared"))


def overlapping_pairs(members: DataFrame) -> DataFrame:
    """Distinct overlapping set pairs only, with no element lists: key, a, b."""
    distinct = members.select(*KEY, "set_id", "element").distinct()
    return pairs_within(distinct, [*KEY, "element"], "set_id").select(
        *KEY, F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).distinct()


def encode_set_packing(members: DataFrame, set_values: DataFrame, penalty=None) -> Batch:
    """Reward chosen sets, penalise each overlapping chosen pair once."""
    price = penalties(penalty, _value_default(set_values))
    linear = set_values.select(*KEY, F.col("set_id").alias("i"),
                               (-F.col("value")).cast("double").alias("v"))
    quadratic = overlapping_pairs(members).join(price, KEY).select(
        *KEY, F.col("a").alias("i"), F.col("b").alias("j"), F.col("penalty").alias("v"))
    return _finish(sizes_from(set_values, "set_id"), "set_packing", linear, quadratic)


def false_indicators(literals: DataFrame) -> DataFrame:
    """Affine form of "this literal is false": ``x`` when negated, else ``1 - x``."""
    sign = F.when(F.col("negated"), 1.0).otherwise(-1.0)
    return literals.select(*KEY, "clause_id", "pos", F.col("variable").alias("i"),
                           sign.alias("a"),
                           F.when(F.col("negated"), 0.0).otherwise(1.0).alias("c"))


def _affine_clauses(literals: DataFrame, size: int) -> DataFrame:
    """One row per clause with i0, a0, c0, i1, ... side by side."""
    flat = false_indicators(literals)
    picks = [
        F.max(F.when(F.col("pos") == p, F.col(name))).alias(f"{name}{p}")
        for p in range(size) for name in ("i", "a", "c")]
    return flat.groupBy(*KEY, "clause_id").agg(*picks)


def encode_max_sat(literals: DataFrame, clauses: DataFrame, clause_size: int = 3,
                   ancilla_penalty: float | DataFrame | None = None, sizes: DataFrame | None = None):
    """Max-2-SAT or Max-3-SAT; returns (batch, ancillas).

    ``literals``: key, clause_id, pos (0-based), variable, negated. ``clauses``: key, clause_id,
    weight. With three literals, clause ``c`` adds the variable ``n + c`` that stands for "the
    first two literals are false". ``clause_id`` must be ``0..m-1`` for a gapless model.
    ``ancilla_penalty`` may be a table key, ancilla_penalty (NULL for the default).
    """
    sizes = sizes if sizes is not None else sizes_from(literals, "variable")
    wide = _affine_clauses(literals, clause_size).join(
        clauses.select(*KEY, "clause_id", F.col("weight").cast("double").alias("w")),
        [*KEY, "clause_id"])

    def factor(p: int):
        return F.struct(F.col(f"i{p}").alias("i"), F.col(f"a{p}").alias("a"),
                        F.col(f"c{p}").alias("c"))

    def product(slot: int, left, right, weight):
        return F.struct(F.lit(slot).alias("slot"), weight.alias("weight"), left.alias("l"),
                        right.alias("r"))

    if clause_size == 2:
        rows = F.array(product(0, factor(0), factor(1), F.col("w")))
        extra = None
        ancillas = None
        total = sizes
    else:
        given = F.lit(None if ancilla_penalty is None or isinstance(ancilla_penalty, DataFrame) else float(ancilla_penalty))
        if isinstance(ancilla_penalty, DataFrame):
            wide, given = wide.join(ancilla_penalty.select(*KEY, "ancilla_penalty"), KEY), F.col("ancilla_penalty")
        wide = wide.join(sizes, KEY).withColumn(
            "z", F.col("num_variables") + F.col("clause_id")).withColumn(
            "p", F.coalesce(given.cast("double"), F.col("w") + 1.0))
        z = F.struct(F.col("z").alias("i"), F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
        p = F.col("p")
        rows = F.array(
            product(0, factor(0), factor(1), p), product(1, factor(0), z, -2.0 * p),
            product(2, factor(1), z, -2.0 * p), product(3, z, factor(2), F.col("w")))
        extra = wide.select(*KEY, F.col("z").alias("i"), (3.0 * p).alias("v"))
        ancillas = wide.select(*KEY, "clause_id", F.col("z").alias("variable"),
                               p.alias("penalty"))
        top = clauses.groupBy(*KEY).agg((F.max("clause_id") + 1).alias("slots"))
        total = sizes.join(top, KEY).select(
            *KEY, (F.col("num_variables") + F.col("slots")).alias("num_variables"))

    # Every factor has one variable, so a product expands inside its own row: no join, and one
    # shuffle for the sums.
    flat = wide.select(*KEY, F.inline(rows)).select(
        *KEY, "weight", "l.i", "l.a", "l.c", F.col("r.i").alias("j"), F.col("r.a").alias("b"),
        F.col("r.c").alias("d"))
    w, a, b, c, d = (F.col(x) for x in ("weight", "a", "b", "c", "d"))
    offset = accumulate_offset(flat.select(*KEY, (w * c * d).alias("v")))
    same = F.col("i") == F.col("j")
    singles = flat.select(*KEY, F.inline(F.array(
        F.struct(F.col("i").alias("i"), (w * a * d).alias("v")),
        F.struct(F.col("j").alias("i"), (w * c * b).alias("v")),
        F.struct(F.col("i").alias("i"), F.when(same, w * a * b).otherwise(0.0).alias("v")))))
    linear = accumulate_linear(singles if extra is None else union(singles, extra))
    quadratic = accumulate(flat.where(~same).select(*KEY, "i", "j", (w * a * b).alias("v")))
    return _finish(total, "max_sat", linear, quadratic, offset), ancillas


def encode_spin_glass(fields: DataFrame, couplings: DataFrame,
                      sizes: DataFrame | None = None) -> Batch:
    offset, linear, quadratic = from_ising(fields, couplings)
    sizes = sizes if sizes is not None else sizes_from(fields, "i")
    return _finish(sizes, "spin_glass", linear, quadratic, offset)


def encode_direct(linear: DataFrame, quadratic: DataFrame, sizes: DataFrame | None = None,
                  offsets: DataFrame | None = None) -> Batch:
    """Coefficients that already are the model."""
    quadratic, linear = fold_diagonal(quadratic, linear)
    if sizes is None:
        sizes = sizes_from(union(linear.select(*KEY, "i"),
                                 quadratic.select(*KEY, F.col("j").alias("i"))), "i")
    return _finish(sizes, "random_qubo", linear, accumulate(quadratic), offsets)


# How each family names its variables.
VARIABLE_WORDS = {
    "max_cut": "vertex", "independent_set": "vertex", "maximum_clique": "vertex",
    "number_partitioning": "number", "set_packing": "set", "spin_glass": "spin",
    "random_qubo": "binary",
}


def variable_table(batch: Batch, colors: int | None = None,
                   primary: DataFrame | None = None) -> DataFrame:
    """Readable names of all variables of a batch: key, i, name.

    ``colors`` is needed for colourings; ``primary`` (key, primary: the number of items or Boolean
    variables) for knapsacks and formulas, whose later variables are slack bits and ancillas.
    """
    size = batch.instances.select(*KEY, "problem_type", "num_variables")
    size = size.withColumn("primary", F.lit(None).cast("bigint")) if primary is None else \
        size.join(primary.select(*KEY, F.col("primary").cast("bigint").alias("primary")), KEY, "left")
    rows = spread_range(size, "num_variables", "i")
    i, kind, extra = F.col("i"), F.col("problem_type"), F.col("i") - F.col("primary")
    word = F.element_at(F.create_map(*[
        F.lit(x) for pair in VARIABLE_WORDS.items() for x in pair]), kind)
    later = F.col("primary").isNotNull() & (extra >= 0)
    k = colors or 1

    def text(*parts):
        return F.concat_ws("_", *[F.lit(p) if isinstance(p, str) else p.cast("string")
                                  for p in parts])

    name = (
        F.when(kind == "graph_coloring", text("vertex", F.floor(i / k), "color", i % k))
        .when(kind == "quadratic_knapsack",
              F.when(later, text("capacity_slack", extra)).otherwise(text("item", i)))
        .when(kind == "max_sat",
              F.when(later, text("clause", extra, "ancilla")).otherwise(text("boolean", i)))
        .otherwise(text(word, i)))
    return rows.select(*KEY, "i", name.alias("name"))
