"""Packing token sequences by column generation for the cutting-stock problem.

Documents become pieces of at most the capacity. Short pieces are bundled by their exact lengths;
the lengths of bundles and of long pieces, rounded up to a unit, form a histogram; a linear program
over patterns (what fits in one sequence) covers it with few sequences, a knapsack by dynamic
programming prices new patterns, and the rounded plan is dealt to bundles and pieces by their rank.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import Features, column, cut, listed, number_rows, slices

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
# How the tokenizer's file splits lower-cased text before it looks at pairs.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CHUNKS_KEPT, _PIECES_KEPT = 700_000, 450_000
_WORD_END = "</w>"
_LINE = 1000  # words encoded as one text
_PLAIN = 0x0300  # below the first combining mark, normalisation leaves text alone


class _Encoder:
    """Ids of chunks between ASCII white space, which no token spans.

    Chunks of plain letters are split as the tokenizer splits them, so that a word is encoded once,
    whatever stands next to it; other chunks are encoded whole. New words are encoded as lines of
    many, which is cheaper than one by one, and told apart by their ids of word ends.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        self.tokenizer, self.split = Tokenizer.from_file(path), regex.compile(_PIECES).findall
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[n for word, n in vocabulary.items() if word.endswith(_WORD_END)]] = True
        self.plain, self.other = Features(self._words), Features(self._apart)

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return listed([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [words[k:k + _LINE] for k in range(0, len(words), _LINE)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
        flat, counts = [], []
        for line, found in zip(lines, encoded, strict=True):
            ids = np.array(found.ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            sizes = np.diff(ends, prepend=0)
            if len(ends) != len(line) or ends[-1] != len(ids):  # words that do not end as expected
                ids, sizes = self._apart(line)
            flat.append(ids)
            counts.append(sizes)
        return np.concatenate(flat), np.concatenate(counts)

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        for part in (self.plain, self.other):
            if len(part) > _PIECES_KEPT:
                part.forget()
        words, counts, whole, places = [], [], [], []
        for place, chunk in enumerate(chunks):
            text = chunk.decode()
            if text.isprintable() and (text.isascii() or ord(max(text)) < _PLAIN) and "<|" not in text:
                low = text.lower()
                if low.isalpha():
                    words.append(low)
                    counts.append(1)
                else:
                    parts = self.split(low)
                    words += parts
                    counts.append(len(parts))
            else:
                whole.append(text)
                places.append(place)
                counts.append(0)
        numbers = self.plain.numbers_of(words)
        flat, sizes = self.plain.of(numbers), self.plain.start[numbers + 1] - self.plain.start[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        lengths = np.diff(ends, prepend=0)
        if whole:
            numbers = self.other.numbers_of(whole)
            sizes = self.other.start[numbers + 1] - self.other.start[numbers]
            flat = np.insert(flat, np.repeat(ends[places], sizes), self.other.of(numbers))
            lengths[places] = sizes
        return flat, lengths


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    """One for all tasks of a worker; it forgets its words when they become too many."""
    return _Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2,
           id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ``ids``, bytes).

    A document is its text's ids and ``end_id``; what exceeds the capacity is cut off in whole
    sequences, and only the rest competes for space. Null and empty texts are the end id alone.
    """

    def encode(batches):
        features, end = Features(_encoder(tokenizer_path), _CHUNKS_KEPT), np.array([end_id], "<u4")
        for batch in batches:
            for low, high in slices(batch.column(1)):
                out = []
                keys = batch.column(0)[low:high].to_pylist()
                chunks, sizes = features.numbers([t or b"" for t in batch.column(1)[low:high].to_pylist()])
                tokens = features.of(chunks).astype("<u4")
                held = np.concatenate([[0], np.cumsum(features.start[chunks + 1] - features.start[chunks])])
                borders = held[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                for key, first, last in zip(keys, borders, borders[1:], strict=False):
                    ids = np.concatenate([tokens[first:last], end])
                    for start in range(0, len(ids), capacity):
                        part = ids[start:start + capacity].tobytes()
                        out.append((key, start, len(part) // 4, zlib.crc32(part), len(ids), part))
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select(column(id_column).cast("long"), column(text_column).cast("binary")).mapInArrow(
        encode, PIECES + ", ids binary" * with_ids)


def _best_pattern(values: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of greatest value that fits ``room``."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        best[space] = best[space - 1]
        fit = np.searchsorted(weights, space, side="right")
        if fit:
            reached = values[:fit] + best[space - weights[:fit]]
            k = int(reached.argmax())
            if reached[k] > best[space] + 1e-12:
                best[space], pick[space] = reached[k], k
    pattern, space = np.zeros(len(weights), np.int64), room
    while space > 0:
        if pick[space] < 0:
            space -= 1
        else:
            pattern[pick[space]] += 1
            space -= weights[pick[space]]
    return best[room], pattern


def column_generation(weights: np.ndarray, demand: np.ndarray, room: int,
                      steps: int = 20_000) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often to use them, so that every demand is met: [(times, pattern)].

    ``weights`` ascend and are at most ``room``. Revised simplex over the patterns' linear program,
    then whole parts of the solution, then what is left by repeatedly filling a sequence with the
    best-fitting remaining items. Work depends on the number of classes and on ``room``, not on the
    demand. ``steps`` bounds the pivots; a plan cut short is still valid, only less tight.
    """
    n = len(weights)
    if not n:
        return []
    patterns = np.diag(room // weights).astype(np.int64)  # columns: basis patterns
    inverse = np.diag(1.0 / np.diag(patterns))
    amount = inverse @ demand
    for _ in range(steps):
        prices = inverse.sum(axis=0)
        value, pattern = _best_pattern(prices, weights, room)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, amount / direction, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        step = ratio[leave]
        amount = np.maximum(amount - step * direction, 0.0)
        amount[leave] = step
        patterns[:, leave] = pattern
    plan, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-amount, kind="stable"):
        item = patterns[:, k]
        used = item > 0
        times = int(min(np.floor(amount[k] + 1e-6), (left[used] // item[used]).min()))
        if times > 0:
            plan.append((times, item.copy()))
            left -= times * item
    while left.any():  # fewer than one pattern's worth per basis column
        space, item = room, np.zeros(n, np.int64)
        for k in range(n - 1, -1, -1):
            take = min(left[k], space // weights[k])
            item[k], space = take, space - take * weights[k]
        used = item > 0
        times = int((left[used] // item[used]).min())
        plan.append((times, item))
        left -= times * item
    return plan


def bundles(histogram: list[tuple[int, int]], capacity: int, unit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces put together by their exact lengths, so that rounding a bundle up to ``unit`` wastes little.

    ``histogram``: (length, pieces). Returns runs (length, low, high, each, class, base): pieces of a
    length with ranks from low to high, ``each`` of them in a bundle of ``class`` units, bundles of a
    class numbered from ``base``. Pieces of one length up to an eighth of the capacity form equal
    bundles of at most that many tokens; those left over from all lengths are bundled together.
    """
    most = max(unit, capacity // 8)
    runs, used, left = [], {}, []

    def number(size: int, count: int) -> tuple[int, int]:
        kind = -(-size // unit)
        used[kind] = used.get(kind, 0) + count
        return kind, used[kind] - count

    for length, count in sorted(histogram):
        each = min(range(1, max(1, min(most // length, unit)) + 1), key=lambda n: (-(n * length) % unit / (n * length), n))
        whole = count // each
        if whole:
            runs.append((length, 0, whole * each, each, *number(each * length, whole)))
        if count > whole * each:
            left.append((length, whole * each, count))
    held, size = [], 0

    def close() -> None:
        kind, base = number(size, 1)
        runs.extend((length, low, high, high - low, kind, base) for length, low, high in held)

    for length, low, high in left:
        while low < high:
            fit = min(high - low, (most - size) // length)
            if not fit:
                close()
                held, size = [], 0
                continue
            held.append((length, low, low + fit))
            size, low = size + fit * length, low + fit
    if held:
        close()
    return runs


def pack(parts: DataFrame, capacity: int = 4096, unit: int = 16) -> DataFrame:
    """Add ``sequence_id`` (gapless from 0) and ``offset`` to pieces with doc_id, start and length.

    Only the length histogram (at most ``capacity`` rows) comes to the driver; the linear program has
    at most ``capacity / unit`` classes of bundles. What goes back has a row per run of a length and
    per class and pattern, however many pieces there are.
    """
    histogram = [(r["length"], r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()]
    runs = bundles(histogram, capacity, unit)
    wanted: dict[int, int] = {}
    for kind, base, count in {(r[4], r[5], (r[2] - r[1]) // r[3]) for r in runs}:
        wanted[kind] = max(wanted.get(kind, 0), base + count)
    found = sorted(wanted.items())
    weights, demand = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
    rows, taken, first = [], dict.fromkeys(weights.tolist(), 0), 0
    for times, pattern in column_generation(weights, demand, capacity // unit):
        place = 0
        for weight, count in zip(weights.tolist(), pattern.tolist(), strict=True):
            if count:
                rows.append((weight, taken[weight], taken[weight] + times * count, first, count, place))
                taken[weight] += times * count
                place += count
        first += times
    plan = parts.sparkSession.createDataFrame(
        rows, "class int, low long, high long, first long, each long, place long")
    held = parts.sparkSession.createDataFrame(
        runs, "length long, _low long, _high long, _each long, class int, _base long")
    # runs are bounded by the capacity, the plan by the number of classes times the number of patterns
    ranked = number_rows(parts, ["length"], ["doc_id", "start"]).join(F.broadcast(held), "length").where(
        "rank >= _low AND rank < _high").withColumn("_bundle", F.expr("_base + (rank - _low) DIV _each")).join(
        F.broadcast(plan), "class").where("_bundle >= low AND _bundle < high")
    placed = ranked.select(
        *parts.columns, "rank",
        (F.col("first") + F.expr("(_bundle - low) DIV each")).alias("sequence_id"),
        (F.col("place") + F.expr("(_bundle - low) % each")).alias("_place"))
    before = Window.partitionBy("sequence_id").orderBy("_place", "length", "rank").rowsBetween(
        Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_place", "rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2,
                   unit: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Sequences of at most ``capacity`` tokens that hold every token of every document once.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null
    and empty texts give one piece with the end id; null and repeated doc_ids are packed like any
    other row; very long texts fill whole sequences; an empty table gives no rows; columns other than
    id and text are not read. ``unit`` trades the size of the linear program against padding.
    """
    return pack(cut(pieces(docs, tokenizer_path, capacity, end_id, id_column, text_column)), capacity, unit)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, unit: int = 16,
              pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of ``capacity`` ids), used.

    Tokens past ``used`` are padding. Sequences are bounded by the capacity, so one row holds one.
    """
    parts = pack(cut(pieces(docs, tokenizer_path, capacity, end_id, with_ids=True)), capacity, unit)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = parts.groupBy("sequence_id").agg(ordered.alias("parts"))

    def fill(batches):
        for batch in batches:
            rows = []
            for group in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in group), "<u4").astype(np.int32)
                rows.append((np.concatenate([ids, np.full(capacity - len(ids), pad_id, np.int32)]), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.int32())], names=["sequence_id", "ids", "used"])

    return grouped.mapInArrow(fill, "sequence_id long, ids array<int>, used int")
