"""Spin form, matrix profiles, coupling products and linearised model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.ranges import spread_range
from bitloom.operators.terms import accumulate_linear, index_variables, union
from bitloom.schemas import KEY, Batch

STATE_LANE = 8  # states summed side by side

# Solver capability limits and the dense/sparse switch.
SPARSE_THRESHOLD = 0.15
LIMITS = {
    "exact_variables": 24,
    "exact_index_bits": 62,
    "milp_products": 25_000,
    "milp_columns": 100_000,
    "annealing_updates": 100_000_000,
    "bifurcation_variables": 5_000,
    "flow_variables": 100_000,
    "flow_dense_variables": 10_000,
}


def to_ising(batch: Batch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields ``h``, couplings ``J`` and constant of ``x = (1 + s) / 2``."""
    quarter = batch.quadratic.select(*KEY, "i", "j", (F.col("v") / 4.0).alias("c"))
    ends = quarter.select(*KEY, F.explode(F.array("i", "j")).alias("i"), F.col("c").alias("v"))
    halves = batch.linear.select(*KEY, "i", (F.col("v") / 2.0).alias("v"))
    fields = accumulate_linear(union(halves, ends)).withColumnRenamed("v", "h")
    couplings = quarter.select(*KEY, "i", "j", F.col("c").alias("coupling"))
    constant = union(
        batch.instances.select(*KEY, F.col("offset").alias("v")),
        halves.select(*KEY, "v"),
        quarter.select(*KEY, F.col("c").alias("v")),
    ).groupBy(*KEY).agg(F.sum("v").alias("constant"))
    return fields, couplings, constant


def from_ising(fields: DataFrame, couplings: DataFrame):
    """Offset, linear and quadratic terms of ``sum h s + sum J s s`` with ``s = 2x - 1``."""
    linear = accumulate_linear(union(
        fields.select(*KEY, "i", (2.0 * F.col("h")).alias("v")),
        couplings.select(*KEY, F.explode(F.array("i", "j")).alias("i"),
                         (-2.0 * F.col("coupling")).alias("v"))))
    quadratic = couplings.groupBy(
        *KEY, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    ).agg((4.0 * F.sum("coupling")).alias("v"))
    offset = union(
        fields.select(*KEY, (-F.col("h")).alias("v")),
        couplings.select(*KEY, F.col("coupling").alias("v")),
    ).groupBy(*KEY).agg(F.sum("v").alias("offset"))
    return offset, linear, quadratic


def interaction_scale(fields: DataFrame, couplings: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """Largest ``|h_i| + sum |J_ij|`` per instance, 1 when that is 0.

    With ``instances`` every one of them has a row, also those without any term.
    """
    bound = union(
        fields.select(*KEY, "i", F.abs("h").alias("v")),
        couplings.select(*KEY, F.explode(F.array("i", "j")).alias("i"),
                         F.abs("coupling").alias("v")))
    largest = F.max("v")
    scales = accumulate_linear(bound).groupBy(*KEY).agg(
        F.when(largest > 0, largest).otherwise(F.lit(1.0)).alias("scale"))
    if instances is None:
        return scales
    return instances.select(*KEY).join(scales, KEY, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def matrix_profile(batch: Batch, threshold: float = SPARSE_THRESHOLD,
                   element_bytes: int = 8) -> DataFrame:
    """Directed density ``2m / n^2``, advised storage, and the MiB either storage would take."""
    n, m = F.col("num_variables").cast("double"), F.col("m").cast("double")
    counts = batch.quadratic.groupBy(*KEY).agg(F.count("*").alias("m"))
    profile = batch.instances.select(*KEY, "num_variables").join(counts, KEY, "left").fillna(
        0, ["m"])
    return profile.select(
        *KEY, "num_variables", F.col("m").alias("quadratic_terms"),
        (2.0 * m / F.greatest(F.lit(1.0), n * n)).alias("density"),
        (n * n * element_bytes / 1048576.0).alias("dense_mib"),
        (2.0 * m * (16 + element_bytes) / 1048576.0).alias("sparse_mib"),
    ).withColumn("advice", F.when(F.col("density") <= threshold, "sparse").otherwise("dense"))


def coupling_product(couplings: DataFrame, states: DataFrame) -> DataFrame:
    """``J . X`` for many state vectors at once: key, i, state, value.

    ``states`` holds one row per (key, i) with the array ``values``, one entry per state, so a
    coupling carries all states through a single shuffle. Sums of ``STATE_LANE`` states live side by
    side in one aggregation row; single states appear once they are summed.
    """
    both = union(
        couplings.select(*KEY, "i", "j", "coupling"),
        couplings.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), "coupling"))
    carried = both.join(states.where(F.size("values") > 0).select(*KEY, F.col("i").alias("j"), "values"), [*KEY, "j"])
    lanes = carried.select(*KEY, "i", "coupling", "values", F.explode(F.sequence(
        F.lit(0), F.expr(f"(size(values) - 1) DIV {STATE_LANE}").cast("int"))).alias("lane"))
    place = F.col("lane") * STATE_LANE
    sums = [F.sum(F.col("coupling") * F.get("values", place + b)).alias(f"s{b}") for b in range(STATE_LANE)]
    wide = lanes.groupBy(*KEY, "i", "lane").agg(F.max(F.size("values")).alias("count"), *sums)
    cells = F.array(*[F.col(f"s{b}") for b in range(STATE_LANE)])
    return wide.select(*KEY, "i", "lane", "count", F.posexplode(cells).alias("bit", "value")).where(
        F.col("bit") < F.col("count") - place).select(
        *KEY, "i", (place + F.col("bit")).cast("bigint").alias("state"), "value")


def linearize(batch: Batch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, rows and non-zeros of the 0/1 model with one product column per pair.

    Product ``p`` of pair ``(i, j)`` (pairs in order) is column ``n + p``; its rows
    ``3p, 3p+1, 3p+2`` say ``y <= x_i``, ``y <= x_j`` and ``y >= x_i + x_j - 1``.
    """
    size = batch.instances.select(*KEY, "num_variables")
    numbered = index_variables(batch.quadratic.select(*KEY, "i", "j", "v"), ["i", "j"], name="p")
    products = numbered.join(size, KEY).withColumn("y", F.col("num_variables") + F.col("p"))
    variables = spread_range(size, "num_variables", "col").select(*KEY, "col").join(
        batch.linear.select(*KEY, F.col("i").alias("col"), "v"), [*KEY, "col"], "left")
    columns = union(
        variables.select(*KEY, "col", F.coalesce("v", F.lit(0.0)).alias("cost"),
                         F.lit(True).alias("is_integer")),
        products.select(*KEY, F.col("y").alias("col"), F.col("v").alias("cost"),
                        F.lit(False).alias("is_integer")),
    ).select(*KEY, "col", "cost", F.lit(0.0).alias("lower"), F.lit(1.0).alias("upper"),
             "is_integer")
    free = F.lit(None).cast("double")

    def bound(step: int, lower, upper):
        return F.struct((3 * F.col("p") + step).alias("row"), lower.alias("lower"),
                        upper.alias("upper"))

    rows = products.select(*KEY, F.inline(F.array(
        bound(0, free, F.lit(0.0)), bound(1, free, F.lit(0.0)), bound(2, F.lit(-1.0), free))))

    def cell(step: int, column: str, value: float):
        return F.struct((3 * F.col("p") + step).alias("row"), F.col(column).alias("col"),
                        F.lit(value).alias("value"))

    nonzeros = products.select(*KEY, F.inline(F.array(
        cell(0, "i", -1.0), cell(0, "y", 1.0), cell(1, "j", -1.0), cell(1, "y", 1.0),
        cell(2, "i", -1.0), cell(2, "j", -1.0), cell(2, "y", 1.0))))
    return columns, rows, nonzeros


def capability_issues(batch: Batch, tasks: DataFrame | None = None,
                      limits: dict[str, int] | None = None) -> DataFrame:
    """Which limits each instance (or each annealing task: key, reads, sweeps) exceeds."""
    limits = {**LIMITS, **(limits or {})}
    profile = matrix_profile(batch)
    n, m = F.col("num_variables"), F.col("quadratic_terms")
    checks = [
        ("exact_variables", n), ("exact_index_bits", n), ("milp_products", m),
        ("milp_columns", n + m), ("bifurcation_variables", n), ("flow_variables", n),
        ("flow_dense_variables", F.when(F.col("advice") == "dense", n)),
    ]
    if tasks is not None:
        profile = profile.join(tasks.select(*KEY, "reads", "sweeps"), KEY)
        checks.append(("annealing_updates", n * F.col("reads") * F.col("sweeps")))
    cells = [
        F.struct(F.lit(name).alias("code"), value.cast("bigint").alias("amount"),
                 F.lit(limits[name]).cast("bigint").alias("limit"))
        for name, value in checks]
    return profile.select(*KEY, F.inline(F.array(*cells))).where("amount > limit").select(
        *KEY, F.lit("error").alias("severity"), "code",
        F.format_string("%d exceeds the limit of %d", "amount", "limit").alias("message"))
