"""Seeded synthetic problem data, generated where it is needed.

Every draw is a function of ``(seed, counter, stream)`` (see ``functions.hashing``), so data does
not depend on partitioning and a lost task regenerates the same rows. ``grid`` tables have one row
per instance: key, seed and the parameter columns a function names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.hashing import (
    MODULUS, portable_hash, standard_normal, streamed, uniform, uniform_integer,
)
from bitloom.functions.pairs import pair_count, pair_unrank
from bitloom.operators.ranges import spread_range
from bitloom.operators.terms import index_variables, union
from bitloom.operators.validation import WARNING_CODES
from bitloom.schemas import KEY
from bitloom.session import cut

# Seed steps between entries and between attempts.
ENTRY_STEP = 1_000_000
ATTEMPT_STEP = 1_000_000_000
PAIR_BLOCK = 65_536
ROW_GAPS = 16  # gaps of a run that are drawn as rows
GAPS = 64

# Streams keep the draws of one seed apart; ``streamed`` keeps them apart from those of other seeds.
PAIRS, WEIGHTS, LINEAR, MEMBERS, FALLBACK, VALUES, CLAUSES, SIGNS, PLANT, FLIP, COUPLINGS, FIELDS, \
    SHUFFLE = (7 * n + 1 for n in range(13))


def seed_grid(entries: DataFrame, base_seed: int = 0) -> DataFrame:
    """Entries (batch, entry, count, optional seed, parameters) to one row per instance.

    An entry without a seed starts at ``base_seed + entry * 1,000,000``; instance ``n`` adds ``n``.
    """
    first = F.coalesce("seed", F.lit(base_seed) + F.col("entry") * ENTRY_STEP)
    return spread_range(entries.withColumn("seed", first.cast("bigint")), "count", "index").withColumn(
        "seed", F.col("seed") + F.col("index")).withColumn(
        "instance_id", F.concat(F.lit("seed_"), F.col("seed").cast("string")))


def sample_pairs(grid: DataFrame, n: str = "n", density: str = "density") -> DataFrame:
    """Independent Bernoulli(density) pairs ``i < j`` of ``n`` vertices: grid columns, i, j.

    The pair ranks ``0..n(n-1)/2-1`` are cut into fixed blocks, which spread one huge instance over
    the cluster. Each block jumps from hit to hit by geometric gaps, at every size alike, so absent
    pairs cost nothing; with density 1 there is nothing to draw and every rank is a pair.
    """
    total = pair_count(F.col(n))
    sized = grid.withColumn("_total", total).where((F.col(density) > 0) & (F.col("_total") > 0))
    blocks = sized.withColumn("_block", F.explode(F.expr(
        f"sequence(0L, (_total - 1L) DIV {PAIR_BLOCK}L)"))).repartition(*KEY, "_block").withColumn(
        "_first", F.col("_block") * PAIR_BLOCK).withColumn(
        "_size", F.least(F.lit(PAIR_BLOCK), F.col("_total") - F.col("_first")))
    every = blocks.where(F.col(density) >= 1).withColumn("_rank", F.explode(F.expr(
        "sequence(_first, _first + _size - 1L)")))
    jumped = _gap_ranks(blocks.where(F.col(density) < 1), density)
    drop = ["_total", "_block", "_first", "_size"]
    ranks = union(every.drop(*drop), jumped.drop(*drop))
    return ranks.withColumn("_pair", pair_unrank(F.col("_rank"), F.col(n))).select(
        *grid.columns, "_pair.i", "_pair.j")


def _gap_ranks(blocks: DataFrame, density: str) -> DataFrame:
    """Hit positions of one block: running sums of geometric gaps from hashed uniforms.

    A block is split into runs of about 8 expected hits; gaps have no memory, so they may restart
    at every run. The first gaps are rows, drawn by compiled code and added up within their run, where they already lie;
    the few runs that need more fold up to ``GAPS`` of them, and one that still falls short is finished
    position by position, so no position is ever left undrawn.
    """
    def gap(k: Column) -> Column:
        u = 1.0 - uniform(F.col("seed"), F.col("_first") + k, PAIRS + 1)
        return F.greatest(F.lit(1.0), F.ceil(F.log(u) / F.log(1.0 - F.col(density)))).cast("bigint")

    def step(acc: Column, k: Column) -> Column:
        at = acc["at"] + gap(k)
        live = acc["at"] < F.col("_size")
        return F.struct(
            F.when(live, at).otherwise(acc["at"]).alias("at"),
            F.when(live & (at < F.col("_size")), F.concat(acc["hits"], F.array(at)))
            .otherwise(acc["hits"]).alias("hits"))

    run = F.greatest(F.lit(1.0), F.least(F.col("_size").cast("double"),
                                         F.ceil(8.0 / F.col(density)))).cast("bigint")
    rows = blocks.withColumn("_run", run).withColumn(
        "_offset", F.explode(F.expr("sequence(0L, _size - 1L, _run)"))).withColumn(
        "_first", F.col("_first") + F.col("_offset")).withColumn(
        "_size", F.least(F.col("_run"), F.col("_size") - F.col("_offset")))
    within = Window.partitionBy(*KEY, "_block", "_offset").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    drawn = rows.withColumn("_k", F.explode(F.expr(f"sequence(0L, {ROW_GAPS - 1}L)"))).withColumn("_gap", gap(F.col("_k"))).withColumn(
        "_at", F.sum("_gap").over(within) - 1).where("_at < _size")
    none = F.array().cast("array<bigint>")
    folded = F.aggregate(F.sequence(F.lit(ROW_GAPS).cast("bigint"), F.lit(GAPS - 1).cast("bigint")),
                         F.struct(F.col("_at").alias("at"), none.alias("hits")), step)
    tail = F.when(F.col("_fold.at") < F.col("_size"), F.filter(
        F.sequence(F.col("_fold.at") + 1, F.col("_size")),
        lambda x: (x < F.col("_size")) & (uniform(F.col("seed"), F.col("_first") + x, PAIRS + 2) < F.col(density)))).otherwise(none)
    ended = drawn.withColumn("_fold", F.when(F.col("_k") == ROW_GAPS - 1, folded)).withColumn("_hit", F.explode(
        F.when(F.col("_k") == ROW_GAPS - 1, F.concat(F.array("_at"), "_fold.hits", tail)).otherwise(F.array("_at"))))
    return ended.withColumn("_rank", F.col("_first") + F.col("_hit")).drop(
        "_hit", "_run", "_offset", "_k", "_gap", "_at", "_fold")


def coefficients(df: DataFrame, distribution: str, i: Column, j: Column, low: float | Column = -10,
                 high: float | Column = 10, scale: float | Column = 5.0, stream: int = WEIGHTS) -> DataFrame:
    """Add ``v``: integer in [low, high], uniform in [low, high) or normal(0, scale); columns are not checked."""
    plain = not isinstance(low, Column) and not isinstance(high, Column)
    if plain and low > high:
        raise ValueError("the lower coefficient bound exceeds the upper one")
    seed = streamed(F.col("seed"), stream)
    if distribution == "integer":
        if plain and (int(low) != low or int(high) != high):
            raise ValueError("integer coefficients need whole bounds")
        value = uniform_integer(seed, i, j, low, high).cast("double")
    elif distribution == "uniform":
        value = low + (high - low) * uniform(seed, i, j)
    elif distribution == "normal":
        value = scale * standard_normal(seed, i, j)
    else:
        raise ValueError(f"unknown distribution {distribution!r}")
    return df.withColumn("v", value)


def random_linear(grid: DataFrame, n: str = "n", zero_probability: float = 0.0,
                  distribution: str = "integer", low: float = -10, high: float = 10,
                  scale: float = 5.0) -> DataFrame:
    """One coefficient per variable, left out with the given probability."""
    rows = spread_range(grid, n, "i")
    kept = rows.where(uniform(F.col("seed"), F.col("i"), LINEAR) >= zero_probability)
    return coefficients(kept, distribution, F.col("i"), F.lit(0), low, high, scale,
                        LINEAR).select(*KEY, "i", "v")


def random_integers(df: DataFrame, name: str, i: Column, low, high, stream: int = VALUES,
                    j: Column | int = 0) -> DataFrame:
    """Add a uniform integer column in [low, high]."""
    return df.withColumn(name, uniform_integer(streamed(F.col("seed"), stream), i, j, low, high))


def erdos_renyi(grid: DataFrame, n: str = "n", p: str = "density") -> DataFrame:
    """Each pair is an edge with probability ``p``: key, u, v."""
    return sample_pairs(grid, n, p).select(*KEY, F.col("i").alias("u"), F.col("j").alias("v"))


def cycle_graph(grid: DataFrame, n: str = "n") -> DataFrame:
    """Ring of ``n`` vertices (a single edge for two): key, u, v."""
    step = spread_range(grid.select(*KEY, F.col(n).alias("n")), "n", "a")
    nxt = (F.col("a") + 1) % F.col("n")
    return step.where("n > 2 OR a = 0").where("n > 1").select(
        *KEY, F.least(F.col("a"), nxt).alias("u"), F.greatest(F.col("a"), nxt).alias("v"))


def complete_graph(grid: DataFrame, n: str = "n") -> DataFrame:
    return erdos_renyi(grid.select(*KEY, "seed", F.col(n).alias("n"), F.lit(1.0).alias("density")))


def degree_issues(grid: DataFrame, n: str = "n", degree: str = "degree") -> DataFrame:
    """Regular graphs need ``degree < n`` and an even ``degree * n``."""
    d, size = F.col(degree), F.col(n)
    code = F.when(d >= size, "degree_too_large").when((d * size) % 2 != 0, "odd_degree_sum")
    return grid.withColumn("code", code).where("code IS NOT NULL").select(
        *KEY, F.lit("error").alias("severity"), "code", F.lit("no such regular graph").alias(
            "message"))


def random_regular(grid: DataFrame, n: str = "n", degree: str = "degree", parallel: int = 4,
                   rounds: int = 200) -> DataFrame:
    """Random d-regular simple graphs by pairing shuffled stubs: key, u, v.

    A round pairs the open stubs of all instances in hash order and keeps pairs that are no loop,
    no repeat and not yet an edge; the other stubs stay open. An attempt that gained nothing in a
    round is given up; an instance without a live attempt starts ``parallel`` new ones, and the
    first attempt to finish wins. Impossible instances (``degree_issues``) are left out and
    ``d = n - 1`` is the complete graph. Raises if some instance is open after ``rounds``.
    """
    wanted = grid.select(*KEY, "seed", F.col(n).cast("bigint").alias("n"),
                         F.col(degree).cast("bigint").alias("d")).where(
        "d < n AND (d * n) % 2 = 0 AND d > 0")
    todo = cut(wanted.where("d < n - 1"))
    state = [*KEY, "attempt"]

    def stubs(attempts: DataFrame) -> DataFrame:
        of = todo.join(attempts, KEY)
        return spread_range(spread_range(of, "n", "u"), "d", "c").select(*state, "seed", "u", "c")

    alive = todo.select(*KEY, F.lit(0).cast("bigint").alias("attempt"))
    open_, edges, winners = stubs(alive), None, None
    for step in range(rounds):
        ordered = index_variables(
            open_.withColumn("_o", portable_hash(
                streamed(F.col("seed"), SHUFFLE) + step, F.col("u"), F.col("c") + 1000 * F.col("attempt"))),
            ["_o", "u", "c"], state, "at")
        pairs = ordered.groupBy(*state, F.shiftright("at", 1).alias("p")).agg(
            F.min(F.struct("u", "c")).alias("a"), F.max(F.struct("u", "c")).alias("b"))
        new = pairs.where("a.u <> b.u").groupBy(
            *state, F.col("a.u").alias("u"), F.col("b.u").alias("v")).agg(
            F.min(F.struct("p", F.col("a.c").alias("cu"), F.col("b.c").alias("cv"))).alias("s"))
        if edges is not None:
            new = new.join(edges, [*state, "u", "v"], "left_anti")
        new = cut(new.select(*state, "u", "v", "s.cu", "s.cv"))
        found = new.select(*state, "u", "v")
        edges = found if edges is None else edges.unionByName(found)
        used = union(new.select(*state, "u", F.col("cu").alias("c")),
                     new.select(*state, F.col("v").alias("u"), F.col("cv").alias("c")))
        left = ordered.select(*state, "seed", "u", "c").join(used, [*state, "u", "c"], "left_anti")
        unfinished = cut(left.select(*state).distinct().join(
            new.select(*state, F.lit(True).alias("gained")).distinct(), state, "left"))
        won = alive.join(unfinished, state, "left_anti").groupBy(*KEY).agg(
            F.min("attempt").alias("attempt"))
        winners = won if winners is None else winners.unionByName(won)
        going = unfinished.where("gained").select(*state).join(won, KEY, "left_anti")
        again = alive.select(*KEY).distinct().join(won, KEY, "left_anti").join(
            going, KEY, "left_anti").withColumn("attempt", F.explode(F.expr(
                f"sequence({(step + 1) * parallel}L, {(step + 2) * parallel - 1}L)")))
        alive = cut(union(going.withColumn("fresh", F.lit(False)),
                          again.withColumn("fresh", F.lit(True))))
        open_ = union(left.join(alive.where("NOT fresh").select(*state), state, "left_semi"),
                      stubs(alive.where("fresh").select(*state)))
        alive = alive.select(*state)
        if alive.isEmpty():
            return complete_graph(wanted.where("d = n - 1")).unionByName(
                edges.join(winners, state, "left_semi").select(*KEY, "u", "v"))
    raise RuntimeError(f"no regular graph found within {rounds} rounds")


def random_sets(grid: DataFrame, sets: str = "num_sets", universe: str = "universe_size",
                p: str = "inclusion_probability") -> DataFrame:
    """Bernoulli membership; a set left empty gets one random element: key, set_id, element."""
    each = spread_range(grid, sets, "set_id")
    rows = spread_range(each, universe, "element").where(
        uniform(streamed(F.col("seed"), MEMBERS), F.col("set_id"), F.col("element")) < F.col(p)
    ).select(*KEY, "set_id", "element")
    empty = each.join(rows.select(*KEY, "set_id").distinct(), [*KEY, "set_id"], "left_anti")
    single = empty.select(*KEY, "set_id", uniform_integer(
        streamed(F.col("seed"), FALLBACK), F.col("set_id"), 0, 0, F.col(universe) - 1).alias("element"))
    return union(rows, single)


def random_clauses(grid: DataFrame, clause_size: int, n: str = "n", m: str = "num_clauses"):
    """Clauses over distinct variables with random signs: key, clause_id, pos, variable, negated.

    Distinct variables come from drawing position ``p`` among ``n - p`` values and stepping over
    the earlier ones in ascending order, so no draw is ever repeated.
    """
    each = spread_range(grid.where(F.col(n) >= clause_size), m, "clause_id")
    draws = [uniform_integer(streamed(F.col("seed"), CLAUSES), F.col("clause_id"), p, 0, F.col(n) - 1 - p)
             for p in range(clause_size)]
    rows = each.withColumn("_v", F.array(draws[0]))
    for p in range(1, clause_size):
        rows = rows.withColumn("_d", draws[p]).withColumn("_d", F.aggregate(
            F.array_sort("_v"), F.col("_d"), lambda d, used: F.when(d >= used, d + 1).otherwise(d))
        ).withColumn("_v", F.concat("_v", F.array("_d")))
    signs = uniform_integer(streamed(F.col("seed"), SIGNS), F.col("clause_id"), F.col("pos"), 0, 1) == 1
    return rows.select(*KEY, "seed", "clause_id", F.posexplode("_v").alias("pos", "variable")
                       ).select(*KEY, "clause_id", F.col("pos").cast("bigint").alias("pos"),
                                "variable", signs.alias("negated"))


def planted_assignment(grid: DataFrame, n: str = "n") -> DataFrame:
    """Random 0/1 assignment: key, i, x."""
    return spread_range(grid, n, "i").select(
        *KEY, "i", uniform_integer(streamed(F.col("seed"), PLANT), F.col("i"), 0, 0, 1).alias("x"))


def plant(literals: DataFrame, planted: DataFrame, seeds: DataFrame) -> DataFrame:
    """Flip one random literal of every clause that the planted assignment leaves unsatisfied.

    ``seeds``: key, seed. Clauses are short, so a clause is one aggregation row.
    """
    true = (F.col("x") == 1) != F.col("negated")
    rows = literals.join(planted.select(*KEY, F.col("i").alias("variable"), "x"),
                         [*KEY, "variable"]).withColumn("_true", true)
    status = rows.groupBy(*KEY, "clause_id").agg(
        F.bool_or("_true").alias("_ok"), F.count("*").alias("_size"))
    chosen = status.join(seeds.select(*KEY, "seed"), KEY).select(
        *KEY, "clause_id",
        F.when(~F.col("_ok"), uniform_integer(
            streamed(F.col("seed"), FLIP), F.col("clause_id"), 0, 0, F.col("_size") - 1)).alias("_flip"))
    return rows.join(chosen, [*KEY, "clause_id"]).select(
        *KEY, "clause_id", "pos", "variable",
        F.when(F.col("pos") == F.col("_flip"), F.col("x") == 0).otherwise(F.col("negated"))
        .alias("negated"))


def random_couplings(edges: DataFrame, seeds: DataFrame, distribution: str = "bimodal",
                     scale: float = 1.0) -> DataFrame:
    """Couplings +-scale or normal(0, scale) on given edges: key, i, j, coupling."""
    rows = edges.join(seeds.select(*KEY, "seed"), KEY)
    seed = streamed(F.col("seed"), COUPLINGS)
    if distribution == "bimodal":
        value = F.when(portable_hash(seed, F.col("u"), F.col("v")) * 2 < MODULUS, -scale).otherwise(
            scale)
    elif distribution == "gaussian":
        value = scale * standard_normal(seed, F.col("u"), F.col("v"))
    else:
        raise ValueError(f"unknown distribution {distribution!r}")
    return rows.select(*KEY, F.col("u").alias("i"), F.col("v").alias("j"),
                       value.cast("double").alias("coupling"))


def random_fields(grid: DataFrame, n: str = "n", probability: float = 0.0,
                  scale: float = 1.0) -> DataFrame:
    """Field +-scale with the given probability, else 0: key, i, h."""
    rows = spread_range(grid, n, "i")
    seed = streamed(F.col("seed"), FIELDS)
    sign = F.when(portable_hash(seed, F.col("i"), 1) * 2 < MODULUS, -scale).otherwise(scale)
    return rows.select(*KEY, "i", F.when(
        uniform(seed, F.col("i"), 0) < probability, sign).otherwise(0.0).cast("double").alias("h"))


def random_items(grid: DataFrame, n: str = "n", weights=(1, 20), values=(1, 30)) -> DataFrame:
    """Knapsack items: key, i, weight, value."""
    rows = spread_range(grid, n, "i")
    rows = random_integers(rows, "weight", F.col("i"), *weights, stream=WEIGHTS)
    return random_integers(rows, "value", F.col("i"), *values, stream=VALUES).select(
        *KEY, "i", "weight", "value")


def random_bonuses(grid: DataFrame, n: str = "n", density: str = "density",
                   bonus=(1, 10)) -> DataFrame:
    """Bonuses on a random share of the item pairs: key, i, j, v."""
    pairs = sample_pairs(grid, n, density)
    return random_integers(pairs, "v", F.col("i"), *bonus, stream=VALUES + 1, j=F.col("j")).select(
        *KEY, "i", "j", "v")


def generate_accepted(grid: DataFrame, generate: Callable[[DataFrame], object],
                      judge: Callable[[object, DataFrame], DataFrame], reject: list[str],
                      max_attempts: int = 1):
    """Regenerate instances that have errors or listed warnings, with seed + attempt * 10^9.

    ``generate(grid)`` builds anything for all instances of a grid; ``judge(built, grid)`` returns
    its issue rows. Each attempt only touches instances still rejected. Returns (accepted grid
    with the seeds that passed, grid of the ones that never did); generating again from the
    accepted grid gives the accepted data.
    """
    unknown = sorted(set(reject) - set(WARNING_CODES))
    if unknown:
        raise ValueError("unknown warning codes: " + ", ".join(unknown))
    todo, accepted = grid, None
    for attempt in range(max_attempts):
        now = todo.withColumn("seed", F.col("seed") + (ATTEMPT_STEP if attempt else 0))
        found = judge(generate(now), now)
        bad = cut(found.where((F.col("severity") == "error") | F.col("code").isin(reject)).select(
            *KEY).distinct())
        good = now.join(bad, KEY, "left_anti")
        accepted = good if accepted is None else accepted.unionByName(good)
        todo = cut(now.join(bad, KEY, "left_semi"))
        if todo.isEmpty():
            break
    return accepted, todo
