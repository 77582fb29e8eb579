"""Models with one square per instance that is never multiplied out.

``sparse`` terms plus ``weight * (constant + sum a_i x_i)^2``: tables stay linear in the variables where the
expanded model has a coefficient for every pair. "All pairs except these edges" is such a square too,
with the edges taken back as sparse terms. Energies, spin form, statistics and a linear 0/1 model are
those of the expanded model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.pairs import pair_count
from bitloom.functions.stats import melt
from bitloom.operators import encoders as E
from bitloom.operators.energy import energy, masked_sums, pack_samples
from bitloom.operators.ising import linearize, to_ising
from bitloom.operators.terms import (
    TINY, accumulate, accumulate_linear, accumulate_offset, drop_tiny, index_variables, square_terms, union,
)
from bitloom.operators.validation import ratio
from bitloom.schemas import KEY, Batch
from bitloom.session import cut

BLOCK = 65_536  # members per window of a running sum


@dataclass(frozen=True)
class Factored:
    """``sparse``, and ``squares`` (key, weight, constant; a row per instance) over ``members`` (key, i, a; i once)."""

    sparse: Batch
    squares: DataFrame
    members: DataFrame


def _nothing(like: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty linear and quadratic terms."""
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    empty = like.where(F.lit(False))
    return empty.select(*KEY, zero.alias("i"), none.alias("v")), empty.select(
        *KEY, zero.alias("i"), zero.alias("j"), none.alias("v"))


def dealt(rows: DataFrame, *names: str) -> DataFrame:
    """Rows dealt to tasks by key and ``names``.

    A join on the key alone brings an instance into one task, and grouping by more columns would leave it there.
    """
    return rows.repartition(*KEY, *names)


def factor_partition(numbers: DataFrame, sizes: DataFrame | None = None) -> Factored:
    """``encode_partition`` without its pairs: the square of the difference of the two sums."""
    constraints, members = E.partition_square(numbers)
    sizes = sizes if sizes is not None else E.sizes_from(numbers, "i")
    return Factored(Batch(E.instances_of(sizes, "number_partitioning"), *_nothing(numbers)),
                    constraints.drop("constraint_id"), members.drop("constraint_id"))


def factor_clique(vertices: DataFrame, edges: DataFrame, penalty=None, sizes: DataFrame | None = None) -> Factored:
    """``encode_clique`` without its non-edges: half the penalty times the squared count, less the edges."""
    sizes = sizes if sizes is not None else E.sizes_from(vertices)
    price = E.penalties(penalty, vertices.groupBy(*KEY).agg((F.max("value") + 1).alias("penalty")))
    half = price.select(*KEY, (F.col("penalty") / 2.0).alias("weight"))
    linear = vertices.join(half, KEY).select(
        *KEY, F.col("u").alias("i"), (-F.col("value") - F.col("weight")).cast("double").alias("v"))
    present = edges.where("u <> v").select(
        *KEY, F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")).distinct()
    quadratic = dealt(present.join(price, KEY), "i", "j").select(*KEY, "i", "j", (-F.col("penalty")).alias("v"))
    return Factored(Batch(E.instances_of(sizes, "maximum_clique"), linear, drop_tiny(quadratic)),
                    half.withColumn("constant", F.lit(0.0)),
                    vertices.select(*KEY, F.col("u").alias("i"), F.lit(1.0).alias("a")))


def factor_knapsack(items: DataFrame, bonuses: DataFrame, ratio: float = 0.5, penalty=None):
    """``encode_knapsack`` with its capacity square as it stands; returns (model, capacity, slack)."""
    constraints, members, capacity, slack, sizes = E.knapsack_square(items, bonuses, ratio, penalty)
    linear = items.select(*KEY, "i", (-F.col("value")).cast("double").alias("v"))
    quadratic = accumulate(bonuses.select(*KEY, "i", "j", (-F.col("v")).cast("double").alias("v")))
    batch = Batch(E.instances_of(sizes, "quadratic_knapsack"), drop_tiny(linear), drop_tiny(quadratic))
    return Factored(batch, constraints.drop("constraint_id"), members.drop("constraint_id")), capacity, slack


def expand(model: Factored) -> Batch:
    """The model with every pair as a coefficient; for instances that are small enough."""
    one = F.lit(0).cast("bigint").alias("constraint_id")
    offset, linear, quadratic = square_terms(model.squares.select("*", one), model.members.select("*", one))
    sparse = model.sparse
    offsets = accumulate_offset(union(sparse.instances.select(*KEY, F.col("offset").alias("v")),
                                      offset.select(*KEY, F.col("offset").alias("v"))))
    return Batch(sparse.instances.drop("offset").join(offsets, KEY),
                 drop_tiny(accumulate_linear(union(sparse.linear.select(*KEY, "i", "v"), linear))),
                 drop_tiny(accumulate(union(sparse.quadratic.select(*KEY, "i", "j", "v"), quadratic))), sparse.variables)


def factored_energy(model: Factored, samples: DataFrame) -> DataFrame:
    """Energies as ``energy`` gives them: sparse terms, and the square of one sum per sample."""
    none = F.lit(0).cast("bigint")
    packed = pack_samples(samples)
    chosen = packed.join(model.members, [*KEY, "i"]).select(
        *KEY, "block", none.alias("known"), "mask", F.col("a").cast("double").alias("v")).where("mask <> 0")
    sums = masked_sums(union(chosen, packed.select(*KEY, "block", "known", none.alias("mask"), F.lit(0.0).alias("v"))))
    gap = F.col("constant") + F.col("sum")
    return energy(model.sparse, samples).join(
        sums.withColumnRenamed("energy", "sum"), [*KEY, "sample_id"]).join(model.squares, KEY, "left").select(
        *KEY, "sample_id", (F.col("energy") + F.coalesce(F.col("weight") * gap * gap, F.lit(0.0))).alias("energy"))


@dataclass(frozen=True)
class SpinForm:
    """Fields h, sparse couplings, constant, and ``weight * sum_{i <> j} b_i b_j s_i s_j`` by its loadings."""

    fields: DataFrame
    couplings: DataFrame
    constant: DataFrame
    weights: DataFrame
    loadings: DataFrame


def factored_ising(model: Factored) -> SpinForm:
    """Spin form of ``x = (1 + s) / 2``: a square of sums of bits is one of sums of spins."""
    fields, couplings, constant = to_ising(model.sparse)
    loadings = model.members.select(*KEY, "i", (F.col("a") / 2.0).alias("b"))
    sums = loadings.groupBy(*KEY).agg(F.sum("b").alias("b1"), F.sum(F.col("b") * F.col("b")).alias("b2"))
    # written, as adaptive execution broadcasts a shuffled table by its measured size but no join of two
    middle = cut(model.squares.join(sums, KEY, "left").fillna(0.0, ["b1", "b2"]).select(
        *KEY, "weight", "b2", (F.col("constant") + F.col("b1")).alias("middle")))
    more = dealt(loadings.join(middle, KEY), "i").select(
        *KEY, "i", (2.0 * F.col("weight") * F.col("middle") * F.col("b")).alias("v"))
    return SpinForm(
        accumulate_linear(union(fields.withColumnRenamed("h", "v"), more)).withColumnRenamed("v", "h"), couplings,
        union(constant, middle.select(*KEY, (F.col("weight") * (F.col("middle") * F.col("middle") + F.col("b2"))).alias(
            "constant"))).groupBy(*KEY).agg(F.sum("constant").alias("constant")),
        model.squares.select(*KEY, "weight"), loadings)


def factored_scale(spins: SpinForm, instances: DataFrame) -> DataFrame:
    """Largest ``|h_i| + sum_j |J_ij|`` per instance over all couplings, 1 when that is 0 (``interaction_scale``)."""
    loads = spins.loadings.join(spins.weights, KEY)
    size = F.abs("b")
    total = spins.loadings.groupBy(*KEY).agg(F.sum(size).alias("all"))
    whole = loads.join(total, KEY).select(
        *KEY, "i", (2.0 * F.abs("weight") * size * (F.col("all") - size)).alias("v"))
    mixed = _with_members(spins.couplings, spins.loadings, "b").join(spins.weights, KEY)
    alone = 2.0 * F.col("weight") * F.col("b_i") * F.col("b_j")
    moved = mixed.select(*KEY, F.explode(F.array("i", "j")).alias("i"),
                         (F.abs(F.col("coupling") + alone) - F.abs(alone)).alias("v"))
    bound = accumulate_linear(union(spins.fields.select(*KEY, "i", F.abs("h").alias("v")), whole, moved))
    largest = F.max("v")
    scales = bound.groupBy(*KEY).agg(F.when(largest > 0, largest).otherwise(1.0).alias("scale"))
    return instances.select(*KEY).join(scales, KEY, "left").select(*KEY, F.coalesce("scale", F.lit(1.0)).alias("scale"))


def _with_members(pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Pairs with the members' values at both ends, 0 where there is none."""
    def end(index: str):
        return members.select(*KEY, F.col("i").alias(index), F.col(name).alias(f"{name}_{index}"))

    return pairs.join(end("i"), [*KEY, "i"], "left").join(end("j"), [*KEY, "j"], "left").fillna(
        0.0, [f"{name}_i", f"{name}_j"])


def _extremes(ranked: DataFrame, tops: DataFrame, touched: DataFrame) -> DataFrame:
    """Least and greatest product of two members that no sparse term couples: key, low, high.

    A member's best partner is the first one, from either end of the order, that is not the member itself and
    not coupled with it: one of as many as it has couplings, plus two. ``ranked``: key, i, a, rank (descending), z (members);
    ``tops``: key, top0, top1, bottom0, bottom1; ``touched``: key, i, rank of a coupled member, z.
    """
    last = F.col("z") - 1
    free = ranked.join(touched.select(*KEY, "i").distinct(), [*KEY, "i"], "left_anti").join(tops, KEY).where("z > 1").select(
        *KEY, "a", F.explode(F.array(
            F.when(F.col("rank") == 0, F.col("top1")).otherwise(F.col("top0")),
            F.when(F.col("rank") == last, F.col("bottom1")).otherwise(F.col("bottom0")))).alias("b"))
    own = ranked.select(*KEY, "i", "rank", "z").join(touched.select(*KEY, "i").distinct(), [*KEY, "i"])
    barred = union(own, touched)
    of = [*KEY, "i"]
    sides = union(barred.select(*of, "z", F.lit(0).alias("side"), F.col("rank").alias("r")),
                  barred.select(*of, "z", F.lit(1).alias("side"), (last - F.col("rank")).alias("r"))).distinct()
    # the first gap in a member's sorted list of barred ranks
    place = F.row_number().over(Window.partitionBy(*of, "side").orderBy("r")) - 1
    gap = sides.withColumn("place", place.cast("bigint")).groupBy(*of, "side").agg(
        F.coalesce(F.min(F.when(F.col("place") != F.col("r"), F.col("place"))), F.count("*")).alias("r"), F.max("z").alias("z"))
    partner = gap.where("r < z").select(*of, F.when(F.col("side") == 0, F.col("r")).otherwise(last - F.col("r")).alias("rank"))
    rest = partner.join(ranked.select(*KEY, "rank", F.col("a").alias("b")), [*KEY, "rank"]).join(
        ranked.select(*of, "a"), of).select(*KEY, "a", "b")
    product = F.col("a") * F.col("b")
    return union(free, rest).groupBy(*KEY).agg(F.min(product).alias("low"), F.max(product).alias("high"))


def factored_facts(model: Factored) -> DataFrame:
    """``term_facts`` of the expanded model, from sums of powers and the sparse terms.

    Coefficients at most ``TINY`` are left out after summing, as in the expanded model, but for pairs of the
    square alone, which count where both members are not 0. The deviation comes from sums of squares.
    """
    w, a = F.col("weight"), F.col("a")
    live = cut(model.members.join(model.squares, KEY).where("a <> 0 AND weight <> 0"))
    sums = live.groupBy(*KEY).agg(
        F.count("*").alias("z"), F.max("weight").alias("weight"), F.sum("a").alias("s1"),
        F.sum(a * a).alias("s2"), F.sum(a * a * a * a).alias("s4"))
    linear = drop_tiny(accumulate_linear(union(
        model.sparse.linear.select(*KEY, "i", "v"),
        live.select(*KEY, "i", (w * (a * a + 2.0 * F.col("constant") * a)).alias("v")))))
    pairs = cut(_with_members(accumulate(model.sparse.quadratic), live.select(*KEY, "i", "a"), "a").join(
        model.squares.select(*KEY, "weight"), KEY, "left").select(
        *KEY, "i", "j", (F.col("a_i") * F.col("a_j") != 0).alias("shared"),
        (2.0 * F.coalesce(w, F.lit(0.0)) * F.col("a_i") * F.col("a_j")).alias("alone"), "v").withColumn(
        "both", F.col("v") + F.col("alone")))
    placed = index_variables(live.select(*KEY, "i", "a", (-a).alias("_down")), ["_down", "i"], name="rank").drop("_down")
    ranked = cut(placed.join(sums.select(*KEY, "z"), KEY))
    last = F.col("z") - 1

    def at(rank: Column, name: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, a)).alias(name)

    tops = ranked.groupBy(*KEY).agg(
        at(F.lit(0), "top0"), at(F.lit(1), "top1"), at(last, "bottom0"), at(last - 1, "bottom1"))
    shared = pairs.where("shared").select(*KEY, "i", "j")
    ends = union(shared, shared.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j")))
    touched = ends.join(ranked.select(*KEY, F.col("i").alias("j"), "rank", "z"), [*KEY, "j"]).select(*KEY, "i", "rank", "z")
    extremes = _extremes(ranked, tops, touched)
    there = F.abs("both") > TINY
    listed = union(linear.select(*KEY, F.lit(0).alias("pair"), "v"),
                   pairs.where(there).select(*KEY, F.lit(1).alias("pair"), F.col("both").alias("v"))).groupBy(*KEY).agg(
        F.count_if(F.col("pair") == 0).alias("l"), F.count_if(F.col("pair") == 1).alias("q"), F.sum("v").alias("t1"),
        F.sum(F.col("v") * F.col("v")).alias("t2"), F.min("v").alias("least"), F.max("v").alias("most"))
    replaced = pairs.where("shared").groupBy(*KEY).agg(
        F.count("*").alias("r"), F.sum("alone").alias("r1"), F.sum(F.col("alone") * F.col("alone")).alias("r2"))
    # partners left to a variable: all other members, less the coupled ones, plus coefficients that are there
    kept = F.when(there, 1).otherwise(0) - F.when(F.col("shared"), 1).otherwise(0)
    changes = pairs.select(*KEY, F.explode(F.array("i", "j")).alias("i"), kept.alias("n"))
    degrees = union(ranked.select(*KEY, "i", last.alias("n")),
                    changes.select(*KEY, "i", F.col("n").cast("bigint").alias("n"))).groupBy(*KEY, "i").agg(F.sum("n").alias("n"))
    active = union(degrees.where("n > 0").select(*KEY, "i"), linear.select(*KEY, "i")).distinct().groupBy(*KEY).agg(
        F.count("*").alias("active"))
    facts = model.sparse.instances.select(*KEY, "num_variables")
    for part in (sums, listed, replaced, extremes, active):
        facts = facts.join(part, KEY, "left")
    facts = facts.fillna(0, ["z", "weight", "s1", "s2", "s4", "l", "q", "t1", "t2", "r", "r1", "r2", "active"])
    n, square = F.col("num_variables"), F.col("s2") * F.col("s2") - F.col("s4")
    facts = facts.withColumns({
        "pairs": F.expr("z * (z - 1) DIV 2 - r + q"),
        "u1": w * (F.col("s1") * F.col("s1") - F.col("s2")) - F.col("r1") + F.col("t1"),
        "u2": 2.0 * w * w * square - F.col("r2") + F.col("t2"),
        "x": 2.0 * w * F.col("low"), "y": 2.0 * w * F.col("high")}).withColumn("count", F.col("l") + F.col("pairs"))
    mean = F.try_divide("u1", "count")
    prefix = "qubo_coefficient_statistics"
    return facts.select(
        *KEY, n.alias("qubo_variables"), F.col("l").alias("qubo_linear_terms"), F.col("pairs").alias("qubo_quadratic_terms"),
        ratio(F.col("pairs"), pair_count(n)).alias("qubo_quadratic_density"),
        (n - F.col("active")).alias("qubo_inactive_variables"), F.col("count").cast("double").alias(f"{prefix}.count"),
        F.least("least", "x", "y").alias(f"{prefix}.min"), F.greatest("most", "x", "y").alias(f"{prefix}.max"),
        mean.alias(f"{prefix}.mean"),
        F.when(F.col("count") > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide("u2", "count") - mean * mean))).alias(
            f"{prefix}.std"))


def factored_stats(model: Factored) -> DataFrame:
    return melt(factored_facts(model))


def rest_sums(members: DataFrame) -> DataFrame:
    """Members in index order with what follows: key, r, i, a, next_i, next_a, low, high.

    low and high are the least and the greatest sum that later members can reach. Sums run over blocks of ``BLOCK``
    members; only block totals meet per instance.
    """
    placed = cut(index_variables(members.select(*KEY, "i", "a"), ["i"], name="r")).withColumn(
        "block", F.expr(f"r DIV {BLOCK}L"))
    down, up = F.least("a", F.lit(0.0)), F.greatest("a", F.lit(0.0))
    totals = placed.groupBy(*KEY, "block").agg(
        F.sum(down).alias("down"), F.sum(up).alias("up"), F.min_by("i", "r").alias("head_i"), F.min_by("a", "r").alias("head_a"))
    # from the back, as frames that end at the current row are added up in one pass
    following = Window.partitionBy(*KEY).orderBy(F.col("block").desc())
    later = following.rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.select(
        *KEY, "block", *[F.coalesce(F.sum(n).over(later), F.lit(0.0)).alias(f"{n}_after") for n in ("down", "up")],
        *[F.lag(n).over(following).alias(n.replace("head", "after")) for n in ("head_i", "head_a")])
    inside = Window.partitionBy(*KEY, "block").orderBy(F.col("r").desc())
    rest = inside.rowsBetween(Window.unboundedPreceding, -1)
    held = placed.select(
        *KEY, "block", "r", "i", "a", F.lag("i").over(inside).alias("next_i"), F.lag("a").over(inside).alias("next_a"),
        F.coalesce(F.sum(down).over(rest), F.lit(0.0)).alias("low"), F.coalesce(F.sum(up).over(rest), F.lit(0.0)).alias("high"))
    return held.join(blocks, [*KEY, "block"]).select(
        *KEY, "r", "i", "a", F.coalesce("next_i", "after_i").alias("next_i"), F.coalesce("next_a", "after_a").alias("next_a"),
        (F.col("low") + F.col("down_after")).alias("low"), (F.col("high") + F.col("up_after")).alias("high"))


def factored_linear(model: Factored) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Columns, rows, non-zeros and offset of a 0/1 model whose size is linear in the variables.

    Variables and products of sparse pairs are laid out as in ``linearize``. The ``r``-th of ``m`` members, in index
    order, adds ``T_r``, the sum of the later members (a chain: ``T_r = a x + T_{r+1}`` of the next one), and
    ``z_r = x_r T_r`` by four bounds, of cost ``2 w a_r``. With ``p`` sparse products, ``T_r`` is column
    ``n + p + r``, ``z_r`` column ``n + p + m + r``, and their rows are ``3p + 5r`` (chain) and the four after it.
    """
    columns, rows, nonzeros = linearize(model.sparse)
    sizes = model.sparse.instances.select(*KEY, "num_variables").join(
        model.sparse.quadratic.groupBy(*KEY).agg(F.count("*").alias("p")), KEY, "left").join(
        model.members.groupBy(*KEY).agg(F.count("*").alias("m")), KEY, "left").fillna(0, ["p", "m"])
    chain = cut(rest_sums(model.members).join(sizes, KEY).join(model.squares, KEY).withColumns({
        "t": F.expr("num_variables + p + r"), "z": F.expr("num_variables + p + m + r"), "row": F.expr("3 * p + 5 * r"),
        "cost": 2.0 * F.col("weight") * F.col("a")}))
    w, a, t, z, low, high = (F.col(x) for x in ("weight", "a", "t", "z", "low", "high"))
    own = chain.select(*KEY, F.col("i").alias("col"), (w * (a * a + 2.0 * F.col("constant") * a)).alias("more"))
    first = columns.join(own, [*KEY, "col"], "left").withColumn(
        "cost", F.col("cost") + F.coalesce("more", F.lit(0.0))).drop("more")
    added = chain.select(*KEY, F.inline(F.array(
        F.struct(t.alias("col"), F.lit(0.0).alias("cost"), low.alias("lower"), high.alias("upper"), F.lit(False).alias("is_integer")),
        F.struct(z.alias("col"), F.col("cost"), low.alias("lower"), high.alias("upper"), F.lit(False).alias("is_integer")))))
    free, none = F.lit(None).cast("double"), F.lit(0.0)

    def bound(step: int, lower, upper):
        return F.struct((F.col("row") + step).alias("row"), lower.alias("lower"), upper.alias("upper"))

    bounds = chain.select(*KEY, F.inline(F.array(
        bound(0, none, none), bound(1, free, none), bound(2, none, free), bound(3, free, -low), bound(4, -high, free))))

    def cell(step: int, col: Column, value: Column):
        return F.struct((F.col("row") + step).alias("row"), col.alias("col"), value.alias("value"))

    one, x = F.lit(1.0), F.col("i")
    cells = chain.select(*KEY, F.inline(F.array(
        cell(0, t, one), cell(0, t + 1, F.when(F.col("next_i").isNotNull(), -one)), cell(0, F.col("next_i"), -F.col("next_a")),
        cell(1, z, one), cell(1, x, -high), cell(2, z, one), cell(2, x, -low),
        cell(3, z, one), cell(3, t, -one), cell(3, x, -low), cell(4, z, one), cell(4, t, -one), cell(4, x, -high)))
    ).where("value IS NOT NULL AND value <> 0")
    offset = model.sparse.instances.select(*KEY, "offset").join(model.squares, KEY, "left").select(
        *KEY, (F.col("offset") + F.coalesce(w * F.col("constant") * F.col("constant"), none)).alias("offset"))
    return union(first, added), union(rows, bounds), union(nonzeros, cells), offset
