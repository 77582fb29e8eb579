"""Satisfiability of formulas of up to 62 variables: hard ones become cubes of assignments, rows that are searched by themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.terms import union
from bitloom.schemas import KEY
from bitloom.session import cut

WORD_VARIABLES = 62  # variables of a formula whose signs fit two words
CUBE_VARIABLES = 4  # most used variables, whose assignments are rows of their own
CLAUSES_LIMIT = 400_000  # clauses of a cube that one task may hold
STEPS = 50_000  # branches of a cube before it is given up
FIRST_STEPS = 60  # branches of a whole formula before it is split


def _assign(pos: np.ndarray, neg: np.ndarray, true: int, false: int) -> tuple[np.ndarray, np.ndarray]:
    """Clauses that the assignment leaves open, without the literals it makes false."""
    open_ = (pos & true) | (neg & false) == 0
    return pos[open_] & ~false, neg[open_] & ~true


def search(pos: np.ndarray, neg: np.ndarray, steps: int = STEPS) -> bool | None:
    """Can all clauses be met?  ``pos`` and ``neg`` hold a clause's plain and negated variables as bits.

    Forced and one-sided variables are assigned first; then a variable of a shortest clause is tried both
    ways, the one that most clauses hold. No answer after ``steps`` branches.
    """
    todo = [(pos, neg)]
    while todo:
        steps -= 1
        if steps < 0:
            return None
        pos, neg = todo.pop()
        while True:
            if not len(pos):
                return True
            held = pos | neg
            if (held == 0).any():
                break
            single = held & (held - 1) == 0
            true, false = (int(np.bitwise_or.reduce(side[single], initial=0)) for side in (pos, neg))
            if true & false:
                break
            if not true | false:
                plain, negated = int(np.bitwise_or.reduce(pos)), int(np.bitwise_or.reduce(neg))
                true, false = plain & ~negated, negated & ~plain
            if not true | false:
                shortest = int(held[np.bitwise_count(held).argmin()])
                bits = [1 << b for b in range(WORD_VARIABLES) if shortest >> b & 1]
                bit = max(bits, key=lambda b: int(np.count_nonzero(held & b)))
                todo += [_assign(pos, neg, bit, 0), _assign(pos, neg, 0, bit)]
                break
            pos, neg = _assign(pos, neg, true, false)
    return False


def _decided(clauses: DataFrame, groups: list[str], steps: int) -> DataFrame:
    """``groups``, found: the search of every group's clauses; NULL also for more than ``CLAUSES_LIMIT`` of them."""

    @F.pandas_udf("boolean")
    def found(pos: pd.Series, neg: pd.Series) -> pd.Series:
        return pd.Series([search(p, n, steps) for p, n in zip(pos, neg, strict=True)], dtype="boolean")

    counts = clauses.groupBy(*groups).agg(F.count("*").alias("m"))
    fits = clauses.join(counts.where(F.col("m") <= CLAUSES_LIMIT).select(*groups), groups, "left_semi").groupBy(
        *groups).agg(F.collect_list(F.struct("pos", "neg")).alias("c"))
    return counts.select(*groups).join(
        fits.select(*groups, found(F.col("c.pos"), F.col("c.neg")).alias("found")), groups, "left")


def search_cubes(literals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Exact satisfiability: key, satisfiable, one row per row of ``sizes`` (key, num_variables, at most 62).

    A formula is searched whole at first. One that takes more than ``FIRST_STEPS`` branches, or has too many clauses,
    is split by its most used variables into at most 16 cubes, rows that are searched in tasks of their own.
    NULL where no cube is known to be met and one has more than ``CLAUSES_LIMIT`` clauses or ``STEPS`` branches.
    """
    bit = F.expr("shiftleft(1L, CAST(variable AS INT))")
    zero = F.lit(0).cast("bigint")
    held = literals.join(sizes.select(*KEY), KEY, "left_semi")
    clauses = cut(held.groupBy(*KEY, "clause_id").agg(
        F.bit_or(F.when(F.col("negated"), zero).otherwise(bit)).alias("pos"),
        F.bit_or(F.when(F.col("negated"), bit).otherwise(zero)).alias("neg"),
    ).where("pos & neg = 0").select(*KEY, "pos", "neg").distinct())
    first = cut(_decided(clauses, [*KEY], FIRST_STEPS))
    hard = first.where("found IS NULL").select(*KEY)
    if not hard.isEmpty():
        first = union(first.where("found IS NOT NULL"), _by_cubes(clauses.join(hard, KEY, "left_semi"), held.join(hard, KEY, "left_semi")))
    return sizes.select(*KEY).join(first.withColumn("seen", F.lit(True)), KEY, "left").select(
        *KEY, F.when(F.col("seen").isNull(), True).otherwise(F.col("found")).alias("satisfiable"))


def _by_cubes(clauses: DataFrame, held: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.desc("count"), "variable")  # at most 62 rows each
    used = held.groupBy(*KEY, "variable").count().withColumn("place", F.row_number().over(order) - 1).where(
        F.col("place") < CUBE_VARIABLES)
    cubes = used.groupBy(*KEY).agg(F.sort_array(F.collect_list("variable")).alias("split")).withColumn(
        "cube", F.explode(F.expr("sequence(0L, shiftleft(1L, size(split)) - 1)"))).select(*KEY, "cube", *(F.expr(
            "aggregate(sequence(0, size(split) - 1), 0L, (m, k) -> m | IF((shiftright(cube, k) & 1) = "
            f"{side}, shiftleft(1L, CAST(split[k] AS INT)), 0L))").alias(name) for side, name in ((1, "t"), (0, "f"))))
    rows = cut(clauses.join(cubes, KEY).where("pos & t = 0 AND neg & f = 0").select(
        *KEY, "cube", F.expr("pos & ~f").alias("pos"), F.expr("neg & ~t").alias("neg")).distinct())
    answers = cubes.select(*KEY, "cube").join(
        _decided(rows, [*KEY, "cube"], STEPS).withColumn("seen", F.lit(True)), [*KEY, "cube"], "left").groupBy(*KEY).agg(
        F.count_if(F.col("seen").isNull() | F.coalesce("found", F.lit(False))).alias("met"),
        F.count_if(F.col("seen").isNotNull() & F.col("found").isNull()).alias("unknown"))
    return answers.select(*KEY, F.when(F.col("met") > 0, True).when(F.col("unknown") == 0, False).alias("found"))
