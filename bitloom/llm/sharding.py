"""Sharding by a k-d tree: weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import column, cut, number_rows, ranked, unused

POSITION_BITS, DIGIT, BINS = 28, 12, 4096
HIGH_DIGITS, LOW_DIGITS = 5, 2  # 60 bits of position and text, 24 bits of row
GROUP_SLACK = 20  # times the usual slack, to keep the copies of one text together
NODES_SENT = 200_000  # splits that may be broadcast: one per open node, bounded by the shard count


def _raw(df: DataFrame, name: str) -> Column:
    """A metadata column: text as it is, anything else as a finite double."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return column(name)
    value = column(name).cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == math.inf), None).otherwise(value)


def _ranked_text(rows: DataFrame, stored: DataFrame, name: str) -> DataFrame:
    """Replace a text column by the rank of its value among all ``stored`` ones (null stays null)."""
    values = ranked(stored.select(name).where(F.col(name).isNotNull()).distinct(), [F.col(name)], "_rank")
    return rows.join(values, name, "left").withColumn(name, F.col("_rank").cast("double")).drop("_rank")


def points(docs: DataFrame, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One point per document: id, size, crc, tie, p (positions, 0 .. 2^28 - 1; null comes first).

    A text dimension's position is the rank of its whole value among the distinct ones.

    Copies of a text take the least of their metadata values, so that they share a position.
    """
    text = column(text_column)
    raw = docs.select(
        column(id_column).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        *[_raw(docs, name).alias(f"r{k}") for k, name in enumerate(dimensions)])
    names = [f"r{k}" for k in range(len(dimensions))]
    shared = raw.groupBy("crc", "size").agg(*[F.min(n).alias(n) for n in names])
    raw = cut(raw.drop(*names).join(shared, ["crc", "size"]))
    texts = [n for n in names if isinstance(raw.schema[n].dataType, T.StringType)]
    stored = raw
    for n in texts:
        raw = _ranked_text(raw, stored, n)
    if texts:
        raw = cut(raw)
    bounds = raw.agg(*[f(f"r{k}").alias(f"{n}{k}") for k in range(len(dimensions))
                       for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << POSITION_BITS) - 1

    def position(k: int) -> Column:
        low, high = bounds[f"lo{k}"], bounds[f"hi{k}"]
        if low is None or not high > low:
            return F.lit(0).cast("long")
        share = (F.col(f"r{k}") - F.lit(low)) / F.lit(high - low)
        return F.coalesce(F.floor(share * top), F.lit(0)).cast("long")

    tie = F.shiftrightunsigned(F.xxhash64("id", "crc", "size"), 64 - DIGIT * LOW_DIGITS)
    return raw.select("id", "size", "crc", tie.alias("tie"),
                      F.array(*[position(k) for k in range(len(dimensions))]).alias("p"))


def _with(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Join rows of the open nodes on ``node``; there are at most as many as shards."""
    small = df.sparkSession.createDataFrame(rows, schema)
    return df.join(F.broadcast(small) if len(rows) <= NODES_SENT else small, "node")


def _key(df: DataFrame) -> DataFrame:
    """Order of a node's rows: position in its dimension, then text, then row."""
    return df.withColumn("high", F.shiftleft(F.element_at("p", F.col("dim") + 1), 32).bitwiseOR(
        F.col("crc")))


def _splits(level: DataFrame, nodes: dict[int, tuple[int, int, float, float]]) -> dict:
    """Split keys (dim, high, low) of nodes: {node: (dim, leaves, weight wanted left, slack)}.

    A weighted median is narrowed digit by digit: a pass sums the weights of 4,096 bins within the
    range known so far and picks the bin in which the wanted weight falls, until a bin border is
    within the slack. Only one row per node comes to the driver.
    """
    open_, found = {n: (0, 0, 0.0) for n in nodes}, {}  # node: (high prefix, low prefix, weight below)
    for step in range(HIGH_DIGITS + LOW_DIGITS):
        if not open_:
            break
        in_high = step < HIGH_DIGITS
        rows = [(n, nodes[n][0], h, low, below, nodes[n][2]) for n, (h, low, below) in open_.items()]
        keyed = _key(_with(level, rows, "node long, dim int, ph long, pl long, below double, want double"))
        if in_high:
            left = DIGIT * (HIGH_DIGITS - step)
            inside = F.shiftrightunsigned("high", left) == F.col("ph")
            digit = F.shiftrightunsigned("high", left - DIGIT).bitwiseAND(F.lit(BINS - 1))
        else:
            left = DIGIT * (HIGH_DIGITS + LOW_DIGITS - step)
            inside = (F.col("high") == F.col("ph")) & (F.shiftrightunsigned("tie", left) == F.col("pl"))
            digit = F.shiftrightunsigned("tie", left - DIGIT).bitwiseAND(F.lit(BINS - 1))
        if step == 0:
            inside = F.lit(True)
        bins = keyed.where(inside).groupBy("node", "below", "want", digit.alias("bin")).agg(
            F.sum("size").cast("double").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        picked = bins.withColumn("after", F.col("below") + upto).where("after >= want").groupBy(
            "node").agg(F.min(F.struct("bin", "after", "w")).alias("b")).select("node", "b.*").collect()
        for row in picked:
            node, (dim, _, want, slack) = row["node"], nodes[row["node"]]
            high, low, _ = open_.pop(node)
            before = row["after"] - row["w"]
            last = step == HIGH_DIGITS + LOW_DIGITS - 1
            if in_high:
                high = high * BINS + row["bin"]
            else:
                low = low * BINS + row["bin"]
            near_before = want - before <= row["after"] - want
            whole_group = step == HIGH_DIGITS - 1  # the bin is one text: rather pass it than split it
            if last or min(want - before, row["after"] - want) <= (GROUP_SLACK if whole_group else 1) * slack:
                up = 0 if near_before else 1
                if in_high:
                    found[node] = (dim, (high + up) << (DIGIT * (HIGH_DIGITS - 1 - step)), 0)
                else:
                    found[node] = (dim, high, (low + up) << (DIGIT * (HIGH_DIGITS + LOW_DIGITS - 1 - step)))
            else:
                open_[node] = (high, low, before)
    return found


def kd_tree(rows: DataFrame, leaves: int, tolerance: float = 0.0005) -> DataFrame:
    """``points`` with their shard (0 .. leaves - 1): every level halves the leaves of its nodes.

    A node goes along its widest dimension (range of positions; the first of equally wide ones) and
    is cut where the left side holds its share of the weight, to within ``tolerance`` of a leaf.
    """
    level = rows.withColumn("node", F.lit(1).cast("long"))
    open_, shard_of = {1: leaves}, {}
    slack, dims = None, None
    while open_:
        stats = level.where("node is not null")
        if dims is None:
            dims = max(1, len(rows.select("p").first()["p"])) if not rows.isEmpty() else 1
        facts = {r["node"]: r for r in stats.groupBy("node").agg(
            F.sum("size").cast("double").alias("w"),
            *[(F.max(F.col("p")[k]) - F.min(F.col("p")[k])).alias(f"d{k}") for k in range(dims)]).collect()}
        if slack is None:
            slack = tolerance * (facts[1]["w"] if 1 in facts else 0.0) / leaves
        nodes = {}
        for node, k in sorted(open_.items()):
            if k == 1:
                shard_of[node] = None
            elif node in facts:
                widths = [facts[node][f"d{j}"] for j in range(dims)]
                nodes[node] = (widths.index(max(widths)), k, facts[node]["w"] * (k // 2) / k, slack)
        splits = _splits(level, nodes)
        table_ = [(n, *splits[n]) for n in splits]
        grown = {}
        for node, k in open_.items():
            if k > 1:
                grown[2 * node], grown[2 * node + 1] = k // 2, k - k // 2
            elif any(v > 1 for v in open_.values()):  # leaves of a shallower level stay on the left
                grown[2 * node] = 1
                table_.append((node, 0, 1 << 62, 0))
        if not table_ or all(k == 1 for k in open_.values()):
            break
        keyed = _key(_with(level, table_, "node long, dim int, bh long, bl long"))
        is_left = (F.col("high") < F.col("bh")) | ((F.col("high") == F.col("bh")) & (F.col("tie") < F.col("bl")))
        level = cut(keyed.select("id", "size", "crc", "tie", "p",
                                 F.when(is_left, 2 * F.col("node")).otherwise(2 * F.col("node") + 1).alias("node")))
        open_ = grown
    order = {n: i for i, n in enumerate(sorted(open_))}
    if len(order) == 1:
        return level.select("id", "size", "crc", F.lit(0).alias("shard"))
    named = _with(level, list(order.items()), "node long, shard int")
    return named.select("id", "size", "crc", "shard")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
                    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shards of near equal bytes whose documents are alike in their metadata.

    The number of shards is given, or follows from ``target_bytes``. Returns one row per document:
    id, size (UTF-8 bytes of the text + 1), crc (CRC-32 of the text), shard, slot (gapless from 0
    in its shard). Every row counts, also with null id, text or metadata (null text: size 1, crc 0;
    null metadata: the lowest position) and repeated rows. Equal texts stay side by side in the
    tree's order; only a group that lies on a border and outweighs a hundredth of a shard is split. Fewer documents
    than shards leave shards empty; an empty table gives no rows. Other columns are not read.
    """
    rows = cut(points(docs, dimensions, id_column, text_column))
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    placed = kd_tree(rows, shards)
    return number_rows(placed, ["shard"], ["crc", "id"], "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder per shard, sorted by slot (ids must be unique).

    The folder column is ``_shard``, with underscores added if the documents have one. Null ids match each
    other; null texts are written as they are; an empty table writes no folder.
    """
    id_, shard, slot = unused(docs, "_id", "_shard", "_slot")
    where = placed.select(F.col("id").alias(id_), F.col("shard").alias(shard), F.col("slot").alias(slot))
    docs.join(where, column(id_column).eqNullSafe(F.col(id_))).repartition(shard).sortWithinPartitions(
        shard, slot).drop(id_, slot).write.partitionBy(shard).parquet(path)
