"""Fuzzy line deduplication by MinHash over character shingles.

Equal lines meet by hash. Distinct lines get MinHash bands over their character shingles; lines that
share a band are compared by exact Jaccard similarity; components of similar lines keep the line
that comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import column, components, cut, mixed, prepare, runs, slices, union, unused

SHINGLE = 8  # bytes of UTF-8 text: a shingle is a 64-bit number, exactly
BANDS, ROWS = 12, 4  # a pair at similarity 0.8 shares no band with a chance of 2e-3, at 0.9 of 4e-6
TILE = 2048
LINES = "doc long, k long, line int, h1 long, h2 long, bands array<long>"


def line_key(line: bytes) -> bytes:
    """What is compared: ASCII lower case, white space (ASCII) at the ends dropped and inside one space."""
    return b" ".join(line.lower().split())


def line_shingles(key: bytes) -> np.ndarray:
    """Every 8 bytes of a key as a number; a shorter key is one shingle, an empty one has none."""
    if not key:
        return np.zeros(0, np.uint64)
    padded = key.ljust(SHINGLE, b"\0")
    return np.ndarray((len(padded) - SHINGLE + 1,), "<u8", padded, strides=(1,)).copy()


def line_set(key: bytes) -> np.ndarray:
    """Sorted distinct shingles of a key."""
    values = np.sort(line_shingles(key))
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _batch_shingles(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all keys (none empty) in turn, and where each key's begin."""
    padded = [k.ljust(SHINGLE, b"\0") for k in keys]
    text = b"".join(padded) + b"\0" * SHINGLE
    lengths = np.array([len(k) for k in padded])
    windows = np.ndarray((len(text) - SHINGLE,), "<u8", text, strides=(1,))
    inside = np.ones(len(windows), bool)
    ends = np.cumsum(lengths)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return windows[inside], np.cumsum(lengths - SHINGLE + 1) - (lengths - SHINGLE + 1)


def _signed_lines(batches):
    """Per line that is not blank: document, line number, 128-bit hash of its key, bands."""
    random = np.random.default_rng(77)
    flips = random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
    factors = random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
    for batch in batches:
        for low, high in slices(batch.column(2), 1 << 18):
            docs, rows, numbers, keys = [], [], [], []
            for doc, row, text in zip(*(batch.column(c)[low:high].to_pylist() for c in range(3)), strict=True):
                for k, line in enumerate((text or b"").split(b"\n")):
                    key = line_key(line)
                    if key:
                        docs.append(doc)
                        rows.append(row)
                        numbers.append(k)
                        keys.append(key)
            if not keys:
                continue
            shingles, begin = _batch_shingles(keys)
            x = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
            moved = np.empty_like(x)
            band = np.empty((len(keys), BANDS), np.uint64)
            for b in range(BANDS):
                name = np.full(len(keys), b + 1, np.uint64)
                for r in range(b * ROWS, (b + 1) * ROWS):
                    np.multiply(np.bitwise_xor(x, flips[r], out=moved), factors[r], out=moved)
                    least = np.minimum.reduceat(moved, begin)
                    name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + least)
                band[:, b] = name
            hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), "<i8").reshape(-1, 2)
            offsets = np.arange(0, band.size + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(hashes[:, 0].copy()),
                 pa.array(hashes[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.view(np.int64).ravel()))],
                names=["doc", "k", "line", "h1", "h2", "bands"])


def _near(x: np.ndarray, y: np.ndarray, above: int, below: int) -> bool:
    if below * min(len(x), len(y)) < above * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return below * shared >= above * (len(x) + len(y) - shared)


def _crossing(above: int, below: int):
    """Links between lines of two tiles that lie in different components so far, fewer than lines.

    A pair is compared in the first bucket that it shares; pairs with a bucket's leader already were.
    """
    def search(columns):
        key, lead = columns[0][0].as_py(), columns[7][0].as_py()
        bands = columns[8].flatten().to_numpy().reshape(-1, BANDS)
        place = int((bands[0] == key).argmax())
        low, high = columns[1][0].as_py(), columns[2][0].as_py()
        ids, label, tile = columns[3].to_numpy(), columns[5].to_numpy().copy(), columns[6].to_numpy()
        texts = columns[4].to_pylist()
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = line_set(texts[i])
            return sets[i]

        left = np.flatnonzero(tile == low)
        right = left if low == high else np.flatnonzero(tile == high)
        for i in left:
            if ids[i] == lead:
                continue
            others = right[(label[right] != label[i]) & ((right > i) | (low != high)) & (ids[right] != lead)
                           & ~(bands[right, :place] == bands[i, :place]).any(axis=1)]
            for j in others:
                if label[i] != label[j] and _near(shingles(i), shingles(j), above, below):
                    yield ids[i], ids[j]
                    label[label == label[j]] = label[i]

    return _searching(search, 3)


def _searching(search, keys: int):
    def run(batches):
        a, b = [], []
        for columns in runs(batches, keys):
            for x, y in search(columns):
                a.append(min(x, y))
                b.append(max(x, y))
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _line_texts(batches):
    """Keys of the wanted lines of a document: (id, key)."""
    for batch in batches:
        for low, high in slices(batch.column(0)):
            ids, keys = [], []
            for text, wanted in zip(batch.column(0)[low:high].to_pylist(), batch.column(1)[low:high].to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                for w in wanted:
                    ids.append(w["id"])
                    keys.append(line_key(lines[w["line"]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])


def _without(place: int, names: list[str], outputs: tuple[str, str]):
    """All columns of the documents, without the removed lines in column ``place``; two counts."""
    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(place)):
                texts, lines, gone = [], [], []
                columns = [batch.column(c)[low:high] for c in range(len(names))]
                for text, cuts in zip(columns[place].to_pylist(), batch.column(len(names))[low:high].to_pylist(), strict=True):
                    parts = [] if text is None else text.split("\n")
                    drop = set(cuts or ())
                    lines.append(len(parts))
                    gone.append(len(drop))
                    texts.append(None if text is None else "\n".join([p for k, p in enumerate(parts) if k not in drop]))
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                    names=[*names, *outputs])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, above: int, below: int) -> DataFrame:
    """Pairs (a, b) of line ids whose shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("key").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("key").alias("y")), "b")

    def check(batches):
        for batch in batches:
            xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([_near(line_set(x), line_set(y), above, below)
                             for x, y in zip(xs, ys, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def dedup_lines(docs: DataFrame, above: int = 4, below: int = 5, id_column: str = "doc_id",
                text_column: str = "text", outputs: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """Keep one line of every component of similar lines: the columns of ``docs``, _n_lines, _n_removed.

    ``outputs`` names the two new columns; columns of ``docs`` with these names give way.

    Lines end at a line feed and are compared in lower case with single spaces; similarity is the
    Jaccard similarity of their 8-byte shingles, >= above / below. The line kept is the first by
    document id (null last), then by the text's hash, then by line number. Blank lines are neither
    compared nor removed. Rows that agree in id and text are one document and keep the same lines.
    Null texts stay null. An empty table gives no rows; other columns are passed on as they are.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(*outputs)
    text = column(text_column).cast("string")
    place = F.coalesce(column(id_column).cast("long"), F.lit((1 << 63) - 1))
    row = F.xxhash64(place, text)
    keyed = docs.select(place.alias("doc"), row.alias("k"), text.cast("binary").alias("text"))
    signed = cut(keyed.mapInArrow(_signed_lines, LINES))
    classes = cut(signed.groupBy("h1", "h2").agg(
        F.min(F.struct("doc", "k", "line")).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands")).withColumn(
        "id", F.monotonically_increasing_id()))  # a number of its own per class: 128 bits name a line, fewer might not
    banded = classes.select("id", F.explode("bands").alias("key"))
    full = cut(banded.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lead")).where("m > 1"))
    members = cut(banded.join(full, "key"))
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("first.*", "id").groupBy("doc", "k").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    texts = cut(keyed.join(wanted.hint("merge"), ["doc", "k"]).select("text", "wanted").mapInArrow(
        _line_texts, "id long, key binary").dropDuplicates(["id"]))
    star = members.where("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
    links = cut(confirmed(star, texts, above, below))
    label = components(links)
    labelled = cut(members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")))
    apart = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(
        "x <> y").select("key")
    tiled = labelled.join(apart, "key").join(texts.withColumnRenamed("key", "words"), "id").join(
        classes.select("id", "bands"), "id").withColumn(
        "tiles", F.ceil(F.col("m") / TILE).cast("int")).withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "id",
        "words", "component", "tile", "lead", "bands")
    crossing = tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id").mapInArrow(
        _crossing(above, below), "a long, b long")
    final = components(union(links, cut(crossing.distinct())))
    named = classes.join(final, "id", "left").where(
        "n > 1 OR component IS NOT NULL").select("h1", "h2", "first", F.coalesce("component", "id").alias("component"))
    kept = named.groupBy("component").agg(F.min("first").alias("kept"))
    repeated = cut(named.join(kept, "component").select("h1", "h2", "kept"))
    gone = signed.select("doc", "k", "line", "h1", "h2").join(repeated, ["h1", "h2"]).where(
        F.struct("doc", "k", "line") != F.col("kept")).groupBy("doc", "k").agg(F.collect_set("line").alias("cuts"))
    names = docs.columns
    doc, k, cuts = unused(docs, "__doc", "__k", "__cuts")
    joined = docs.select(*[column(n) for n in names], place.alias(doc), row.alias(k)).join(
        gone.withColumnsRenamed({"doc": doc, "k": k, "cuts": cuts}).hint("merge"), [doc, k], "left")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in outputs]])
    return joined.select(*[column(n) for n in names], cuts).mapInArrow(
        _without(names.index(text_column), names, outputs), schema)
