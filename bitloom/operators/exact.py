"""Ground truth by enumeration, in blocks of consecutive assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.schemas import KEY, Batch

# Fixed value: largest instance that is enumerated unless asked otherwise.
MAX_VARIABLES = 24
LOW_BITS = 10
CHUNK_BITS = 6


def _dense_rows(batch: Batch, max_n: int) -> DataFrame:
    """One row per small instance: linear array and row-major n x n pair array.

    Only instances with at most ``max_n`` variables get here, so the arrays are bounded.
    """
    small = batch.instances.where(F.col("num_variables").between(1, max_n)).select(
        *KEY, F.col("num_variables").cast("int").alias("n"), "offset")
    linear = batch.linear.join(small, KEY).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("lin"))
    pairs = batch.quadratic.join(small, KEY).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(
            F.struct((F.col("i") * F.col("n") + F.col("j")).alias("ij"), "v"))).alias("quad"))
    return small.join(linear, KEY, "left").join(pairs, KEY, "left").select(
        *KEY, "n", "offset",
        F.expr("transform(sequence(0L, n - 1L), i -> coalesce(lin[i], 0D))").alias("lin"),
        F.expr("transform(sequence(0L, n * n - 1L), i -> coalesce(quad[i], 0D))").alias("quad"))


def enumerate_blocks(batch: Batch, max_n: int = MAX_VARIABLES, snapshots: int = 1) -> DataFrame:
    """Minimum of every run of consecutive assignments: key, bucket, energy, assignment, ties.

    Variables ``0..low-1`` form a block of ``2^low`` consecutive assignment numbers. All energies
    of a block come from doubling an array once per low variable (adding the fields that the high
    bits induce), so the work per assignment is constant and no row per assignment exists. The
    high bits are spread over tasks. ``bucket`` is the 1-based checkpoint (of ``snapshots``
    equally spaced ones) the assignments fall in.
    """
    k = int(snapshots)
    rows = _dense_rows(batch, max_n).select(
        "*", F.expr(f"least(n, {LOW_BITS})").alias("low"), F.expr("shiftleft(1L, n)").alias("total"),
    ).where(F.col("total") >= k)
    high = F.expr("n - low")
    chunked = rows.withColumn("high", high).withColumn(
        "chunk_bits", F.expr(f"least(high, {CHUNK_BITS})")
    ).withColumn("chunk", F.explode(F.expr("sequence(0L, shiftleft(1L, chunk_bits) - 1L)")))
    spread = chunked.repartition(*KEY, "chunk")
    inside = spread.withColumn("low_energy", F.expr(
        "aggregate(sequence(0, low - 1), array(0D), (e, i) -> concat(e, zip_with(e, "
        "aggregate(slice(sequence(0, low - 1), 1, i), array(0D), "
        "(s, j) -> concat(s, transform(s, a -> a + quad[j * n + i]))), "
        "(x, s) -> x + lin[i] + s)))"))
    blocks = inside.withColumn("h", F.explode(F.expr(
        "sequence(shiftleft(chunk, high - chunk_bits), "
        "shiftleft(chunk + 1L, high - chunk_bits) - 1L)"))).withColumn(
        "base", F.expr("shiftleft(h, low)"))
    bits = "filter(slice(sequence(0, n - 1), low + 1, high), i -> (shiftright(base, i) & 1L) = 1L)"
    energies = blocks.withColumn("on", F.expr(bits)).withColumn("high_energy", F.expr(
        "aggregate(on, 0D, (e, i) -> e + lin[i] + "
        "aggregate(filter(on, j -> j < i), 0D, (s, j) -> s + quad[j * n + i]))")
    ).withColumn("field", F.expr(
        "transform(sequence(0, low - 1), i -> aggregate(on, 0D, (s, j) -> s + quad[i * n + j]))")
    ).withColumn("energies", F.expr(
        "zip_with(low_energy, aggregate(sequence(0, low - 1), array(high_energy), "
        "(e, i) -> concat(e, transform(e, a -> a + field[i]))), (a, b) -> a + b)"))
    # a block may straddle checkpoint targets ceil(b * total / k): cut it there
    segments = energies.withColumn("width", F.expr("shiftleft(1L, low)")).withColumn(
        "b", F.explode(F.expr(
            f"sequence(({k}L * base) DIV total + 1L, ({k}L * (base + width - 1L)) DIV total + 1L)")))
    start = f"greatest(base, ((b - 1L) * total + {k - 1}L) DIV {k}L)"
    stop = f"least(base + width, (b * total + {k - 1}L) DIV {k}L)"
    pieces = segments.withColumn("start", F.expr(start)).withColumn("stop", F.expr(stop)).where(
        "stop > start").withColumn("piece", F.expr(
            "slice(energies, CAST(start - base AS INT) + 1, CAST(stop - start AS INT))"))
    return pieces.withColumn("best", F.array_min("piece")).select(
        *KEY, "n", "offset", "total", F.col("b").alias("bucket"), F.col("best").alias("energy"),
        F.expr("start + array_position(piece, best) - 1L").alias("assignment"),
        F.expr("CAST(size(filter(piece, e -> e = best)) AS BIGINT)").alias("ties"))


def _reduce(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum, lowest assignment and number of optima per group, all in partial aggregates."""
    by_energy = blocks.groupBy(*keys, "energy").agg(
        F.min("assignment").alias("assignment"), F.sum("ties").alias("ties"),
        F.first("total").alias("total"), F.first("offset").alias("offset"))
    return by_energy.groupBy(*keys).agg(
        F.min(F.struct("energy", "assignment", "ties", "total", "offset")).alias("m")
    ).select(*keys, "m.*")


def exact_minimum(batch: Batch, max_n: int = MAX_VARIABLES) -> DataFrame:
    """Minimum energy, lowest optimal assignment, number of optima and states evaluated, status.

    Every instance has a row; one without variables or with more than ``max_n`` has the status
    ``not_enumerated`` and no figures.
    """
    found = _reduce(enumerate_blocks(batch, max_n), KEY).select(
        *KEY, (F.col("energy") + F.col("offset")).alias("energy"), "assignment",
        F.col("ties").alias("optima"), F.col("total").alias("states_evaluated"))
    return batch.instances.select(*KEY).join(found, KEY, "left").withColumn(
        "status", F.when(F.col("states_evaluated").isNull(), "not_enumerated").otherwise("enumerated"))


def exact_checkpoints(batch: Batch, snapshots: int, max_n: int = MAX_VARIABLES) -> DataFrame:
    """Best assignment so far at equal fractions of the enumeration: key, idx, target, ..., status.

    Every instance is accounted for: one that is not enumerated (see ``exact_minimum``) or has fewer
    than ``snapshots`` assignments has one row with a status that says so and no checkpoint.
    """
    buckets = _reduce(enumerate_blocks(batch, max_n, snapshots), [*KEY, "bucket"])
    so_far = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    best = F.min(F.struct("energy", "assignment")).over(so_far)
    curve = buckets.withColumn("best", best).select(
        *KEY, F.col("bucket").alias("idx"),
        F.expr(f"(bucket * total + {snapshots - 1}L) DIV {snapshots}L").alias("target"),
        "total", (F.col("best.energy") + F.col("offset")).alias("energy"),
        F.col("best.assignment").alias("assignment"))
    status = F.when(F.col("idx").isNotNull(), "enumerated").when(
        F.col("num_variables").between(1, max_n), "fewer_assignments_than_checkpoints").otherwise("not_enumerated")
    return batch.instances.select(*KEY, "num_variables").join(curve, KEY, "left").withColumn(
        "status", status).drop("num_variables")
