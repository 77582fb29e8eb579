"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

The learnt code's tables find most pairs; how many they miss depends on the data. Tables of random
planes, as many as each vector needs, bound the chance that a pair at the threshold is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import column, components, cut, union

CHUNK = 16  # bits of a code that one table indexes
MISSED = 1e-4  # chance that a pair at the threshold shares no key of random planes
MOST = 256  # tables of planes through the mean; vectors that need more also use planes through the origin
SKETCH = 128  # random planes whose signs rule a candidate out before its cosine is taken
UNSEEN = 1e-6  # chance that a pair at the threshold is ruled out so


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are balanced codes.

    Principal directions of the sample, then alternately: codes are the signs of the rotated points,
    and the rotation is the one that brings the points nearest to their codes.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    main = directions[:, ::-1][:, :bits]
    low = centred @ main
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        codes = np.where(low @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(low.T @ codes)
        rotation = u @ v
    return mean, main @ rotation


def _values(batch: pa.RecordBatch, k: int, width: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest entry first, so that nothing over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vector(vector: Column) -> Column:
    """Is the vector neither null nor zero, with finite components only?"""
    return (vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(vector, lambda x: x != 0))


def _sample(vectors: DataFrame, width: int, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, picked by the hash of their id."""
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow()
    flat = picked.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def codes(vectors: DataFrame, width: int, sample_rows: int = 10_000) -> DataFrame:
    """Binary codes of valid vectors (id, v) of one width: id, code (long, up to 64 bits).

    The rotation is learnt from at most ``sample_rows`` vectors, picked by the hash of their id; every
    vector is coded.
    """
    bits = min(width, 64)
    mean, projection = learn_rotation(_unit(_sample(vectors, width, sample_rows)), bits)

    def code(batches):
        places = (np.uint64(1) << np.arange(bits, dtype=np.uint64))
        for batch in batches:
            if batch.num_rows:
                signs = (_unit(_values(batch, 1, width)) - mean) @ projection >= 0
                packed = (signs * places).sum(axis=1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed)], names=["id", "code"])

    return vectors.mapInArrow(code, "id long, code long")


def candidates(coded: DataFrame, bits: int, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, whose codes differ in at most ``radius`` bits and in at most one bit of a chunk.

    A table per 16-bit chunk holds every code; every code asks each table for its own chunk and the
    chunks one bit away. A pair comes from the first table that finds it, so no pair comes twice.
    """
    tables = -(-bits // CHUNK)
    mask = (1 << CHUNK) - 1

    def chunk(x: Column, k: int) -> Column:
        return F.shiftrightunsigned(x, CHUNK * k).bitwiseAND(F.lit(mask).cast("long"))

    stored = coded.select("id", "code", F.posexplode(F.array(*[chunk(F.col("code"), k) for k in range(tables)])).alias("t", "key"))
    flips = F.array(F.lit(0), *[F.lit(1 << k) for k in range(CHUNK)])
    asked = stored.select(F.col("id").alias("a"), F.col("code").alias("code_a"), "t", F.explode(
        F.transform(flips, lambda m: F.col("key").bitwiseXOR(m.cast("long")))).alias("key"))
    joined = asked.join(stored, ["t", "key"]).where("a < id")
    x = F.col("code_a").bitwiseXOR(F.col("code"))
    first = F.lit(True)
    for k in range(tables - 1):
        first = first & ((F.col("t") <= k) | (F.bit_count(chunk(x, k)) > 1))
    return joined.where((F.bit_count(x) <= radius) & first).select("a", F.col("id").alias("b"))


def tables_needed(angle: np.ndarray, bits: int, missed: float) -> np.ndarray:
    """Tables of ``bits`` random planes after which vectors at ``angle`` share no key with chance ``missed``."""
    shared = (1 - np.asarray(angle, float) / np.pi) ** bits
    with np.errstate(divide="ignore"):
        return np.maximum(1, np.ceil(np.log(missed) / np.log1p(-shared)))


def sketch_radius(angle: float, missed: float = UNSEEN) -> int:
    """Most planes of a sketch that part two vectors at ``angle``, but for a chance of ``missed``."""
    p, held = angle / math.pi, 0.0
    for r in range(SKETCH + 1):
        held += math.comb(SKETCH, r) * p ** r * (1 - p) ** (SKETCH - r)
        if held >= 1 - missed:
            return r
    return SKETCH


def plane_keys(vectors: DataFrame, width: int, mean: np.ndarray, bits: int, threshold: float,
               missed: float) -> DataFrame:
    """Keys of valid vectors (id, v) in tables of random planes: id, near, s0, s1 (sketch), t, key.

    Planes through the origin part a pair by its angle. Planes through the mean spread the vectors
    better; they part a pair at distance d, whose larger distance from the mean is a, by an angle of
    at most asin(d / a). A vector takes part in the first tables, as many as its own a asks for, so
    a pair meets in as many as its larger a asks for. Vectors too ``near`` the mean (``MOST`` tables
    are not enough) are also in tables of planes through the origin (t < 0).
    """
    angle, apart = math.acos(threshold), math.sqrt(2 * (1 - threshold))
    plain = int(tables_needed(angle, bits, missed))

    def keys(batches):
        draw = np.random.default_rng(20_250_301)
        sketch, origin, planes = (draw.normal(size=(width, n)) for n in (SKETCH, plain * bits, MOST * bits))
        places = np.int64(1) << np.arange(bits)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                x = _unit(_values(part, 1, width))
                moved = x - mean
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = apart / np.linalg.norm(moved, axis=1)
                needed = tables_needed(np.arcsin(np.where(ratio < 1, ratio, 1.0)), bits, missed)
                near = ~(ratio < 1) | (needed > MOST)
                needed = np.minimum(needed, MOST).astype(np.int64)
                most = int(needed.max())
                found = ((moved @ planes[:, :most * bits] >= 0).reshape(-1, most, bits) * places).sum(axis=2)
                row, t = np.nonzero(np.arange(most) < needed[:, None])
                key = found[row, t]
                at = np.flatnonzero(near)
                if len(at):
                    own = ((x[at] @ origin >= 0).reshape(-1, plain, bits) * places).sum(axis=2)
                    row = np.concatenate([row, np.repeat(at, plain)])
                    t = np.concatenate([t, np.tile(-1 - np.arange(plain), len(at))])
                    key = np.concatenate([key, own.ravel()])
                signs = np.packbits(x @ sketch >= 0, axis=1).view(np.int64)[row]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(near[row]), pa.array(signs[:, 0]), pa.array(signs[:, 1]),
                     pa.array(t.astype(np.int32)), pa.array(key.astype(np.int32))], names=["id", "near", "s0", "s1", "t", "key"])

    return vectors.mapInArrow(keys, "id long, near boolean, s0 long, s1 long, t int, key int")


def plane_candidates(vectors: DataFrame, width: int, threshold: float, missed: float = MISSED,
                     sample_rows: int = 10_000) -> DataFrame:
    """Pairs (a, b), a < b, of valid vectors (id, v) that share a key in a table of random planes.

    A pair whose cosine is at least ``threshold`` is left out with a chance of about ``missed`` at
    most, whatever the vectors' distribution. Keys have about as many values as there are vectors.
    Thresholds so low that keys would not tell pairs apart compare all pairs.
    """
    rows = vectors.count()
    bits = min(max(math.ceil(math.log2(max(rows, 2))), 8), 24)
    if threshold <= 0 or tables_needed(math.acos(min(threshold, 1.0)), bits, missed) > MOST:
        return vectors.select(F.col("id").alias("a")).crossJoin(vectors.select(F.col("id").alias("b"))).where("a < b")
    threshold = min(threshold, 1.0)
    mean = _unit(_sample(vectors, width, sample_rows)).mean(axis=0)
    stored = cut(plane_keys(vectors, width, mean, bits, threshold, missed))
    asked = stored.withColumnsRenamed({"id": "a", "near": "near_a", "s0": "s0_a", "s1": "s1_a"})
    parted = F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_a"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_a")))
    return asked.join(stored, ["t", "key"]).where(
        (F.col("a") < F.col("id")) & (parted <= sketch_radius(math.acos(threshold)))).select(
        "a", F.col("id").alias("b")).distinct()


def tamed(v: Column) -> Column:
    """The vector, divided by its largest entry where squares might leave the range of doubles."""
    top = F.array_max(F.transform(v, F.abs))
    return F.when(top.between(1e-100, 1e100), v).otherwise(F.transform(v, lambda e: e / top))


def cosine(x: Column, y: Column) -> Column:
    """Cosine in double precision of two arrays of doubles."""
    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def embedding_duplicates(table: DataFrame, threshold: float = 0.95, radius: int = 16, sample_rows: int = 10_000,
                         id_column: str = "vec_id", vector_column: str = "embedding", missed: float = MISSED) -> DataFrame:
    """Links, components and the kept vector: id, n_links, component_id, kept, class_id, copies.

    Equal vectors form a class that is searched once; its members are linked with each other and with
    all members of linked classes. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing (class_id null). Only vectors of equal width can link, so widths are
    searched one after the other. A null id is its own component (null). Rows that share an id are one
    node of the graph. A pair at the threshold is missed with a chance of about ``missed`` at most, closer
    pairs more rarely; ``radius`` only bounds what the learnt code proposes. An empty table gives no rows; other columns are not read.
    """
    rows = cut(table.select(column(id_column).cast("long").alias("id"),
                            column(vector_column).cast("array<double>").alias("v")).where("id is not null"))
    classes = cut(rows.where(valid_vector(F.col("v"))).groupBy("v").agg(
        F.min("id").alias("class_id"), F.count("*").alias("copies")).withColumn("width", F.size("v")))
    links = None
    for (width,) in classes.select("width").distinct().orderBy("width").collect():  # vectors have few widths
        reps = classes.where(F.col("width") == width).select(F.col("class_id").alias("id"), "v")
        near = union(candidates(cut(codes(reps, width, sample_rows)), min(width, 64), radius),
                     plane_candidates(reps, width, threshold, missed, sample_rows)).distinct()
        whole = reps.select("id", tamed(F.col("v")).alias("v"))
        pairs = near.join(whole.withColumnsRenamed({"id": "a", "v": "x"}), "a").join(
            whole.withColumnsRenamed({"id": "b", "v": "y"}), "b")
        found = pairs.where(cosine(F.col("x"), F.col("y")) >= threshold).select("a", "b")
        links = found if links is None else union(links, found)
    if links is None:
        return table.select(
            column(id_column).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"),
            column(id_column).cast("long").alias("component_id"), F.lit(True).alias("kept"),
            F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("copies"))
    links = cut(links)
    sizes = classes.select("class_id", "copies")
    ends = union(links.select("a", "b"), links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy("a").agg(
        F.sum("copies").alias("others"))
    label = components(links)
    facts = cut(classes.join(others.withColumnRenamed("a", "class_id"), "class_id", "left").join(
        label.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "v", "class_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class_id").alias("component_id")))
    known = rows.join(facts, "v", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), "class_id",
        F.coalesce("copies", F.lit(0)).alias("copies"))
    unknown = table.where(column(id_column).isNull()).select(
        F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id"),
        F.lit(0).cast("long").alias("copies"))
    return union(known, unknown).select(
        "id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        "class_id", "copies")
