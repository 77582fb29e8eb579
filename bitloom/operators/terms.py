"""Algebra of quadratic terms: accumulate, expand, index, digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.pairing import pairs_within
from bitloom.schemas import KEY, Batch
from bitloom.session import cut

# Fixed value: coefficients this small are dropped after summing.
TINY = 1e-12


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def accumulate(quadratic: DataFrame) -> DataFrame:
    """Sum repeated and reversed pairs; the partial sums combine before the shuffle."""
    return quadratic.groupBy(
        *KEY, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    ).agg(F.sum("v").alias("v"))


def accumulate_linear(linear: DataFrame) -> DataFrame:
    return linear.groupBy(*KEY, "i").agg(F.sum("v").alias("v"))


def accumulate_offset(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy(*KEY).agg(F.sum("v").alias("offset"))


def fold_diagonal(quadratic: DataFrame, linear: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``x*x = x``: move diagonal pairs into the linear terms; returns (quadratic, linear)."""
    diagonal = quadratic.where("i = j").select(*KEY, "i", "v")
    return (quadratic.where("i <> j"),
            accumulate_linear(linear.select(*KEY, "i", "v").unionByName(diagonal)))


def drop_tiny(terms: DataFrame, tolerance: float = TINY) -> DataFrame:
    """Drop ``abs(v) <= tolerance``; apply after summing. NaN compares as large and stays."""
    return terms.where(F.abs("v") > tolerance)


def canonical(instances: DataFrame, linear: DataFrame, quadratic: DataFrame,
              variables: DataFrame | None = None) -> Batch:
    """Fold, accumulate and drop tiny terms."""
    quadratic, linear = fold_diagonal(quadratic, linear)
    return Batch(instances, drop_tiny(linear), drop_tiny(accumulate(quadratic)), variables)


def square_terms(constraints: DataFrame, members: DataFrame):
    """Expand ``weight * (constant + sum a_i x_i)^2`` for every constraint.

    ``constraints``: key, constraint_id, weight, constant. ``members``: key, constraint_id, i, a
    (repeated ``i`` are summed first). Returns summed (offset, linear, quadratic) tables.
    """
    group = [*KEY, "constraint_id"]
    members = members.groupBy(*group, "i").agg(F.sum("a").alias("a"))
    offset = accumulate_offset(constraints.select(
        *KEY, (F.col("weight") * F.col("constant") * F.col("constant")).alias("v")))
    weighted = members.join(constraints, group)
    linear = accumulate_linear(weighted.select(
        *KEY, "i",
        (F.col("weight") * (F.col("a") * F.col("a") + 2 * F.col("constant") * F.col("a")))
        .alias("v")))
    carried = weighted.select(*group, "i", "a", "weight")
    pairs = pairs_within(carried, group, "i")
    quadratic = accumulate(pairs.select(
        *KEY, F.col("i_a").alias("i"), F.col("i_b").alias("j"),
        (2 * F.col("weight_a") * F.col("a_a") * F.col("a_b")).alias("v")))
    return offset, linear, quadratic


def product_terms(products: DataFrame, left: DataFrame, right: DataFrame):
    """Expand ``weight * (c1 + sum a_i x_i) * (c2 + sum b_j x_j)`` with ``x*x = x``.

    ``products``: key, product_id, weight, c1, c2; ``left``/``right``: key, product_id, i, a.
    Returns summed (offset, linear, quadratic) tables.
    """
    group = [*KEY, "product_id"]
    left = left.groupBy(*group, "i").agg(F.sum("a").alias("a"))
    right = right.groupBy(*group, "i").agg(F.sum("a").alias("a"))
    offset = accumulate_offset(
        products.select(*KEY, (F.col("weight") * F.col("c1") * F.col("c2")).alias("v")))
    singles = union(
        left.join(products, group).select(
            *KEY, "i", (F.col("weight") * F.col("c2") * F.col("a")).alias("v")),
        right.join(products, group).select(
            *KEY, "i", (F.col("weight") * F.col("c1") * F.col("a")).alias("v")))
    both = (
        left.join(products.select(*group, "weight"), group)
        .join(right.select(*group, F.col("i").alias("j"), F.col("a").alias("b")), group)
        .select(*KEY, "i", "j", (F.col("weight") * F.col("a") * F.col("b")).alias("v")))
    quadratic, linear = fold_diagonal(both, singles)
    return offset, linear, accumulate(quadratic)


def bad_indices(batch: Batch) -> DataFrame:
    """Terms whose index is outside ``0 <= i < n``: key, kind, i, j."""
    size = batch.instances.select(*KEY, "num_variables")
    touched = union(
        batch.linear.select(*KEY, F.lit("linear").alias("kind"), "i",
                            F.lit(None).cast("bigint").alias("j")),
        batch.quadratic.select(*KEY, F.lit("quadratic").alias("kind"), "i", "j"))
    n = F.col("num_variables")
    outside = (F.col("i") < 0) | (F.col("i") >= n) | (F.col("j") < 0) | (F.col("j") >= n)
    return touched.join(size, KEY).where(outside).select(*KEY, "kind", "i", "j")


def index_variables(entities: DataFrame, order: list[str], keys: list[str] | None = None,
                    name: str = "i") -> DataFrame:
    """Number the rows 0, 1, ... per instance in ``order``, without one window per instance.

    Rows are range-partitioned and sorted; a row's number is its place inside its partition plus
    the rows of the same instance in earlier partitions. The second pass is over one small row per
    (instance, partition). The sorted rows are written once so that both passes see the same cut.
    """
    keys = keys or KEY
    placed = cut(
        entities.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id().cast("bigint"))
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    runs = placed.groupBy(*keys, "_part").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    before = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    return placed.join(before, [*keys, "_part"]).withColumn(
        name, (F.col("_before") + F.col("_place") - F.col("_first")).cast("bigint")
    ).drop("_part", "_place", "_first", "_rows", "_before")


def variable_names(indexed: DataFrame, prefix: str, *parts: str) -> DataFrame:
    """``variables`` table with names such as ``vertex_3`` or ``vertex_3_color_1``.

    ``parts`` alternate between column names and literal words, starting with a column.
    """
    pieces = [F.lit(prefix)] + [
        F.col(p).cast("string") if n % 2 == 0 else F.lit(p) for n, p in enumerate(parts)]
    return indexed.select(*KEY, "i", F.concat_ws("_", *pieces).alias("name"))


def slack_weights(capacity: DataFrame) -> DataFrame:
    """Weights 1, 2, 4, ... with a clipped last one, whose subset sums are exactly 0..capacity.

    ``capacity``: key, capacity. Returns key, k, weight.
    """
    full = F.expr("transform(sequence(0, length(bin(capacity)) - 1), "
                  "k -> least(shiftleft(1L, k), capacity - shiftleft(1L, k) + 1))")
    return capacity.where("capacity > 0").select(
        *KEY, F.posexplode(full).alias("k", "weight")
    ).select(*KEY, F.col("k").cast("bigint").alias("k"), F.col("weight").cast("bigint"))


def content_digest(batch: Batch) -> DataFrame:
    """Digest of an instance's coefficients, independent of row order: key, digest.

    Terms are hashed in tiles of at most 256 x 256 index pairs, tiles in super-tiles of 256 x 256
    tiles, and so on, so that every group has at most 65,536 members however large the instance.
    Linear terms sit at column -1.
    """
    text = union(
        batch.linear.select(*KEY, "i", F.lit(-1).cast("bigint").alias("j"), "v"),
        batch.quadratic.select(*KEY, "i", "j", "v"),
    ).select(*KEY, F.shiftright("i", 8).alias("i8"), F.shiftright("j", 8).alias("j8"),
             F.struct("i", "j", F.col("v").cast("string").alias("digest")).alias("item"))
    level = text.groupBy(*KEY, "i8", "j8").agg(_digest("item").alias("digest"))
    for _ in range(3):
        level = level.select(
            *KEY, F.shiftright("i8", 8).alias("up_i"), F.shiftright("j8", 8).alias("up_j"),
            F.struct(F.col("i8").alias("i"), F.col("j8").alias("j"), "digest").alias("item"),
        ).groupBy(*KEY, F.col("up_i").alias("i8"), F.col("up_j").alias("j8")).agg(
            _digest("item").alias("digest"))
    top = level.select(*KEY, F.struct(
        F.col("i8").alias("i"), F.col("j8").alias("j"), "digest").alias("item"))
    body = top.groupBy(*KEY).agg(_digest("item").alias("body"))
    head = batch.instances.select(*KEY, "num_variables", "offset")
    return head.join(body, KEY, "left").select(*KEY, F.sha2(F.concat_ws(
        "|", F.col("num_variables").cast("string"), F.col("offset").cast("string"),
        F.coalesce("body", F.lit(""))), 256).alias("digest"))


def _digest(column: str):
    rows = F.transform(F.array_sort(F.collect_list(column)), lambda r: F.concat_ws(
        ",", r["i"].cast("string"), r["j"].cast("string"), r["digest"]))
    return F.sha2(F.concat_ws(";", rows), 256)


def canonical_json(mapping) -> F.Column:
    """JSON text of a string map with its entries in key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping))))


def instance_ids(instances: DataFrame, digests: DataFrame) -> DataFrame:
    """``type-<16 hex>`` from type, seed, parameters and digest; ``seed_<n>`` for random models.

    Returns key, new_id.
    """
    identity = F.to_json(F.struct(
        canonical_json(F.col("parameters")).alias("parameters"), "problem_type",
        F.col("digest").alias("qubo"), "seed"))
    return instances.join(digests, KEY).select(
        *KEY,
        F.when(F.col("problem_type") == "random_qubo", F.concat(F.lit("seed_"), F.col("seed")))
        .otherwise(F.concat("problem_type", F.lit("-"), F.substring(F.sha2(identity, 256), 1, 16)))
        .alias("new_id"))
