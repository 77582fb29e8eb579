"""Helpers that several operators share: tables, numbering, components, word identities."""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom import session

BATCH_BYTES = 4 << 20  # text that a task turns into arrays at a time
WORDS_KEPT = 400_000  # distinct words whose derived values a task remembers


# Runtime settings: shuffle files go when the query that made them ends (tables between the steps are
# written, so nothing reads them again), and tasks hand text to Python in small batches. Tables that are joined here are
# read as they were written, so Spark's own limit for a broadcast holds.
# Partitions and splits are the session's own here.
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SETTINGS = {name: value for name, value in session.SETTINGS.items() if name not in (PARTITIONS, "spark.sql.files.maxPartitionBytes")} | {
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def prepare(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    if spark.conf.get(PARTITIONS, None) == session.SETTINGS[PARTITIONS]:
        spark.conf.unset(PARTITIONS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and go on from the table."""
    prepare(df.sparkSession)
    return session.written(df)


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where ``df`` has a column of that name (in any case)."""
    taken = {n.lower() for n in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def number_rows(df: DataFrame, groups: list[str], order: list[str], name: str = "rank",
                bucket_rows: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 within every group, as column ``name``.

    A group is cut into hash buckets of about ``bucket_rows`` rows; a bucket is numbered by a window
    and starts where the buckets before it end, so a group of any size is spread over tasks.
    Groups must not be null; rows that agree in ``order`` are numbered in any order.
    """
    buckets = max(1, math.ceil(df.count() / bucket_rows))
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    key = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*key).agg(F.count("*").alias("_n")).select(
        *key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return salted.join(starts, key).withColumn(name, F.col("_start") + place).drop("_bucket", "_start")


def _forest(batches):
    """Minimum label of every node that the edges of this task connect: (a, b) with a < b."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 500_000:
            yield _stars(parent, find)
            parent = {}
    yield _stars(parent, find)


def _stars(parent, find):
    rows = [(find(x), x) for x in list(parent) if find(x) != x]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
        names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id that has an edge: (id, component). ``edges``: a, b (long).

    Distributed union-find: tasks first join up what they hold, then rounds of large-star and
    small-star contraction, each written to the shared folder, go on until the edges form stars.
    Loops, repeated edges and an empty table are fine; null ends are ignored.
    """
    simple = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = cut(simple.mapInArrow(_forest, "a long, b long").distinct())
    for _ in range(rounds):
        ends = union(current.select(F.col("b").alias("u"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")),
                     current.select(F.col("a").alias("u"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))
        unsettled = ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where(
            "leaf > 1 OR (leaf = 1 AND hub = 1)")
        if unsettled.isEmpty():
            return union(
                current.select(F.col("b").alias("id"), F.col("a").alias("component")),
                current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        both = union(current.select(F.col("a").alias("u"), F.col("b").alias("n")),
                     current.select(F.col("b").alias("u"), F.col("a").alias("n")))
        low = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("n > u").join(low, "u").select(F.col("m").alias("a"), F.col("n").alias("b"))
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        current = cut(union(
            large.join(down, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")),
            down.select(F.col("m").alias("a"), "b")).distinct())
    raise RuntimeError(f"components did not settle within {rounds} rounds")


class Words(dict):
    """Number of a word, given on first sight; what is derived from new words is kept by number."""

    def __missing__(self, word):
        number = len(self)
        self[word] = number
        return number


def numbered(words: Words, chunks: list) -> np.ndarray:
    """Numbers of ``chunks``; those from the old ``len(words)`` on are new."""
    return np.fromiter(map(words.__getitem__, chunks), np.int64, len(chunks))


def slices(column_: pa.Array, limit: int = BATCH_BYTES):
    """Row ranges of a string column that hold about ``limit`` bytes (one row at least)."""
    sizes = np.nan_to_num(np.array(pa.compute.binary_length(column_).to_numpy(zero_copy_only=False),
                                   dtype=float))
    start, held = 0, 0.0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0.0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix: shifts and odd multipliers spread every input bit over the word."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def runs(batches, keys: int):
    """Groups of equal leading ``keys`` columns in sorted Arrow batches: lists of column arrays.

    Groups may cross batches. A group must fit a task, so callers bound it by tiles.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        borders = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for low, high in zip(borders, borders[1:], strict=False):
            part = batch.slice(low, high - low)
            if low == 0 and held:
                same = all(held[-1].column(k)[0] == part.column(k)[0] for k in range(keys))
                if same:
                    held.append(part)
                    if high == batch.num_rows:
                        continue
                yield _whole(held)
                held = []
                if same:
                    continue
            if high == batch.num_rows:
                held = [part]
            else:
                yield part.columns
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> list[pa.Array]:
    if len(parts) == 1:
        return parts[0].columns
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0].columns


class Features:
    """Feature numbers of chunks, computed on first sight.

    ``derive(new chunks)`` gives all their numbers in turn and how many each chunk has. ``limit`` bounds the chunks remembered; beyond it everything is forgotten between slices.
    """

    def __init__(self, derive, limit: int = WORDS_KEPT):
        self.derive, self.limit = derive, limit
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.start = Words(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.start) - 1

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts in turn, and how many each text has."""
        if len(self.words) > self.limit:
            self.forget()
        parts = [text.split() for text in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        return self.numbers_of([chunk for p in parts for chunk in p]), sizes

    def numbers_of(self, chunks: list) -> np.ndarray:
        """Numbers of ``chunks``, whose features are there from then on."""
        ids = numbered(self.words, chunks)
        fresh = len(self.words) - len(self)
        if fresh:
            flat, counts = self.derive(list(islice(reversed(self.words), fresh))[::-1])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.start = np.concatenate([self.start, np.cumsum(counts) + self.start[-1]])
        return ids

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Features of the numbered chunks in turn."""
        count = self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(count)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + count, count)]


def listed(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers in the form that ``Features`` takes."""
    return np.array([x for row in rows for x in row], np.int64), np.array([len(row) for row in rows], np.int64)


def gram_numbers(words: list[str], owner: list[int], owners: int, buckets: int,
                 orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """Hash numbers of all character n-grams (orders 1, 2, ... in a row) of words, grouped by owner.

    ``owner`` says, in ascending order, to which of ``owners`` items a word belongs.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    last, item = np.repeat(np.cumsum(lengths), lengths), np.repeat(np.array(owner, np.int64), lengths)
    total, found, items = np.zeros(len(codes), np.uint64), [], []
    for n in orders:
        count = max(0, len(codes) - n + 1)
        total = total[:count] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]
        inside = np.arange(count) + n <= last[:count]
        found.append(mixed(total[inside] + np.uint64(n)) % np.uint64(buckets))
        items.append(item[:count][inside])
    items_, flat = np.concatenate(items), np.concatenate(found).astype(np.int64)
    return flat[np.argsort(items_, kind="stable")], np.bincount(items_, minlength=owners)


# CRC-32 in DuckDB SQL, for SQL twins: a table of the 256 remainders as CTE ``crc``, and an expression over it.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL text expression, where ``crc`` is joined."""
    return f"""xor(list_reduce([4294967295] || list_transform(range(octet_length(encode({text}))),
    lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295)"""


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 1 over all rows in ``order``, as column ``name``.

    Rows are sorted by range over the cluster and written with their places; a place plus the rows of the
    partitions before it is the number. Only the partitions' row counts are brought together.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_start", "_place")
