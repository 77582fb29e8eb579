"""Near-duplicate documents by b-bit MinHash.

Every set of word shingles gets the minima of many hash functions. Bands of whole minima name
buckets of likely neighbours; within a bucket, packed signatures of the minima's low bits give a
collision-corrected estimate by counting bits; what may reach the threshold is confirmed on the full
sets. Equal sets meet first and go on as one class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import WORDS_KEPT, column, components, cut, mixed, runs, slices, union

TILE = 2048  # members of a bucket that meet in one group; larger buckets are tiles against tiles
LOW_BITS = 4
MISSED = 1e-4  # chance that a pair at the threshold shares no band
SLACK = 4.5  # standard deviations that an estimate may lie below the threshold


@dataclass(frozen=True)
class Shape:
    """Words per shingle, threshold ``above / below``, bands and minima per band."""

    words: int
    above: int
    below: int
    bands: int
    rows: int

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> int:
        """Most low-bit mismatches a pair may have to be confirmed."""
        chance = 2.0 ** -LOW_BITS
        equal = chance + (1 - chance) * self.above / self.below
        spread = math.sqrt(equal * (1 - equal) / self.hashes)
        return int(self.hashes * (1 - equal + SLACK * spread))


def shape(words: int, above: int, below: int, hashes: int = 128) -> Shape:
    """The most selective bands of about ``hashes`` minima that miss a pair at the threshold rarely."""
    t = above / below
    fits = [r for r in range(1, 17) if (1 - t ** r) ** (hashes // r) <= MISSED]
    rows = max(fits, default=1)
    return Shape(words, above, below, hashes // rows, rows)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes, size: int, seen: dict) -> np.ndarray:
    """Sorted distinct shingle hashes: ASCII lower case, words between ASCII white space.

    With fewer words than ``size`` the whole sequence is the only shingle; without words there is none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(seen) > WORDS_KEPT:
        seen.clear()
    ids = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    span = min(size, len(ids))
    total = np.full(len(ids) - span + 1, span, np.uint64)
    for k in range(span):
        total = total * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - span + 1 + k]
    return np.unique(mixed(total))


def _minima(hashes: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 1024):
        block = (x[None, start:start + 1024] ^ flips[:, None]) * factors[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, form: Shape, id_column: str, text_column: str) -> DataFrame:
    """Per row: id, n (set size), f1, f2 (fingerprint of the set), sig (packed low bits), bands."""
    def sign(batches):
        random = np.random.default_rng(20_240_229)
        flips = random.integers(0, 1 << 32, form.hashes, np.uint32)
        factors = random.integers(0, 1 << 32, form.hashes, np.uint32) | np.uint32(1)
        width, seen = -(-form.hashes // 16) * 8, _Hashes()
        for batch in batches:
            for low, high in slices(batch.column(1)):
                out = []
                texts = batch.column(1)[low:high].to_pylist()
                for text in texts:
                    found = shingles(text or b"", form.words, seen)
                    if not len(found):
                        out.append((0, 0, 0, None, None))
                        continue
                    lows = _minima(found, flips, factors)
                    f1, f2 = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist()
                    nibbles = ((lows * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.uint8)
                    nibbles = np.concatenate([nibbles, np.zeros(2 * width - len(nibbles), np.uint8)])
                    packed = (nibbles[0::2] | nibbles[1::2] << 4).astype(np.uint8).tobytes()
                    rows = lows.reshape(form.bands, form.rows).astype(np.uint64)
                    key = np.arange(1, form.bands + 1, dtype=np.uint64)
                    for k in range(form.rows):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
                    out.append((len(found), f1, f2, packed, key.view(np.int64)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()),
                     pa.array(cols[4], pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "sig", "bands"])

    return docs.select(column(id_column).cast("long"), column(text_column).cast("binary")).mapInArrow(
        sign, "id long, n long, f1 long, f2 long, sig binary, bands array<long>")


def mismatches(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Low-bit fields that differ: rows of packed 64-bit words, 4 bits a field."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def _packed(column_: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column_.to_pylist()), np.uint64).reshape(len(column_), -1)


def _pairs(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([np.minimum(x, y) for x, y in rows] or [np.zeros(0, np.int64)])
    b = np.concatenate([np.maximum(x, y) for x, y in rows] or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _flushed(found):
    rows, held = [], 0
    for pair in found:
        rows.append(pair)
        held += len(pair[0])
        if held > 20_000:
            yield _pairs(rows)
            rows, held = [], 0
    yield _pairs(rows)


def _sizes_fit(n: np.ndarray, one: int, form: Shape) -> np.ndarray:
    """Could sets of these sizes reach the threshold at all?"""
    return form.below * np.minimum(n, one) >= form.above * np.maximum(n, one)


def _leader_pairs(form: Shape):
    """Pairs of a bucket tile: its first row with all rows near it, then the first of the rest, and so on."""
    def search(columns):
        ids, n = columns[2].to_numpy(), columns[3].to_numpy()
        sig = _packed(columns[4])
        rest = np.arange(len(ids))
        while len(rest) > 1:
            lead, others = rest[0], rest[1:]
            near = _sizes_fit(n[others], n[lead], form) & (mismatches(sig[lead], sig[others]) <= form.floor)
            if near.any():
                yield np.full(near.sum(), ids[lead]), ids[others[near]]
            rest = others[~near]

    def run(batches):
        yield from _flushed(pair for columns in runs(batches, 2) for pair in search(columns))

    return run


def _reaches(x: np.ndarray, y: np.ndarray, form: Shape) -> bool:
    """Are two sorted sets similar enough: below * |A & B| >= above * |A | B|?"""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return form.below * shared >= form.above * (len(x) + len(y) - shared)


def _cross_links(form: Shape):
    """Confirmed links of two tiles between rows that lie in different components so far.

    A pair is looked at in the first bucket that it shares, and not at all once links found here
    have brought its ends together, so that a tile gives fewer links than it has rows.
    """
    def search(columns):
        key, low, high = (columns[k][0].as_py() for k in range(3))
        ids, n, sig = columns[3].to_numpy(), columns[4].to_numpy(), _packed(columns[5])
        label, tile = columns[6].to_numpy().copy(), columns[7].to_numpy()
        bands = columns[8].flatten().to_numpy().reshape(len(ids), form.bands)
        place = int((bands[0] == key).argmax())
        sets = columns[9]
        left = np.flatnonzero(tile == low)
        right = left if low == high else np.flatnonzero(tile == high)
        for i in left:
            near = (_sizes_fit(n[right], n[i], form) & (label[right] != label[i])
                    & ~(bands[right, :place] == bands[i, :place]).any(axis=1)
                    & (mismatches(sig[i], sig[right]) <= form.floor))
            if low == high:
                near &= right > i
            mine = np.frombuffer(sets[i].as_buffer(), np.uint64)
            for j in right[near]:
                if label[i] != label[j] and _reaches(mine, np.frombuffer(sets[j].as_buffer(), np.uint64), form):
                    yield ids[i:i + 1], ids[j:j + 1]
                    label[label == label[j]] = label[i]

    def run(batches):
        yield from _flushed(pair for columns in runs(batches, 3) for pair in search(columns))

    return run


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "id")


def confirmed(pairs: DataFrame, sets: DataFrame, form: Shape) -> DataFrame:
    """Pairs whose full sets reach the threshold: below * |A & B| >= above * |A | B|."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                keep[i] = _reaches(np.frombuffer(xs[i].as_buffer(), np.uint64),
                                   np.frombuffer(ys[i].as_buffer(), np.uint64), form)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, form: Shape, id_column: str, text_column: str) -> DataFrame:
    wanted = docs.select(column(id_column).cast("long").alias("id"), column(text_column).cast("binary").alias("t")).join(
        ids.hint("merge"), "id", "left_semi")

    def build(batches):
        seen = _Hashes()
        for batch in batches:
            for low, high in slices(batch.column(1)):
                sets = [shingles(t or b"", form.words, seen).tobytes() for t in batch.column(1)[low:high].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(sets, pa.binary())], names=["id", "s"])

    return wanted.mapInArrow(build, "id long, s binary")


def near_duplicates(docs: DataFrame, words: int = 5, above: int = 4, below: int = 5, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have Jaccard similarity >= above / below.

    Returns a row per document: id, n_shingles, component_id, kept. Documents without words have an
    empty set, link with nothing and are kept. A null id links with nothing (component null, kept).
    Rows that share an id are one node. An empty table gives no rows; other columns are not read.
    Buckets of any size are searched: first for leaders and their neighbours, then, tile against
    tile, for pairs between components that are still apart. A pair at the threshold shares no band
    with a chance of 1e-4 at most.
    """
    form = shape(words, above, below)
    signed = cut(signatures(docs, form, id_column, text_column))
    some = signed.where("n > 0 AND id IS NOT NULL")
    classes = cut(some.groupBy("f1", "f2", "n").agg(F.min("id").alias("class"),
                                                    F.min_by(F.struct("sig", "bands"), "id").alias("v")))
    reps = classes.select(F.col("class").alias("id"), "n", "v.sig", "v.bands")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = cut(keyed.join(full, "key").select(
        "key", "id", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")).withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")))
    signs = reps.select("id", "n", "sig")
    first = cut(_dealt(members.join(signs, "id").select("key", "tile", "id", "n", "sig"), ["key", "tile"]).mapInArrow(
        _leader_pairs(form), "a long, b long").distinct())
    sets = cut(_sets(docs, members.select("id").distinct(), form, id_column, text_column))
    links = cut(confirmed(first, sets, form).distinct())
    label = components(links)
    labelled = cut(members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")))
    apart = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    tiled = labelled.join(apart.select("key"), "key").join(reps, "id").join(sets, "id").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "id", "n", "sig",
        "component", "tile", "bands", "s")
    second = cut(_dealt(tiled, ["key", "low", "high"]).mapInArrow(_cross_links(form), "a long, b long"))
    more = union(links, second).distinct()
    final = components(more).withColumnRenamed("id", "class")
    named = classes.select("f1", "f2", "n", "class").join(final, "class", "left").select(
        "f1", "f2", "n", F.coalesce("component", "class").alias("component"))
    linked = some.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"])
    rest = signed.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    return union(linked.select("id", "n", "component"), rest).select(
        "id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
