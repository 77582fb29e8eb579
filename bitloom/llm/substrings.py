"""Repeated word windows by recompression.

Rounds rename a document's words: first runs, then pairs, then blocks of neighbouring symbols. A name
is a hash of what it stands for, so it is global without a dictionary, and each choice looks only at
a symbol and its neighbour, so equal passages get equal symbols except near their ends. Every window
is anchored at one of its interior symbols; only windows whose anchor occurs elsewhere can repeat,
and those are compared in full.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import WORDS_KEPT, column, cut, mixed, slices, union

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ANCHORS = "name long, span long, k1 long, k2 long, start int, windows int, shift int"


@dataclass(frozen=True)
class Rounds:
    """How far rounds may go for a window, so that every window holds a whole interior block.

    A run is two equal words, so the run round unsettles at most 2 words at each end of a passage; a
    pair round joins symbols of at most ``longest / 2`` words and unsettles as many.
    """

    window: int
    pairs: int
    longest: int  # words of a symbol after the pair rounds
    margin: int  # words at either end of a window whose symbols may depend on the outside
    block: int  # words that a block has at least


def rounds_for(window: int) -> Rounds:
    """The most rounds that leave room for blocks of at least a quarter of the window."""
    best = Rounds(window, -1, 1, 0, 1)  # tiny windows: words themselves are the symbols
    longest, margin = 2, 2
    for pairs in range(6):
        if pairs:
            margin += longest
            longest *= 2
        # a block starts within ``longest`` words of the margin and overshoots by less than a symbol
        block = (window - 2 * margin - 2 * longest + 2) * 3 // 5
        if block < max(1, window // 4):
            break
        best = Rounds(window, pairs, longest, margin, block)
    return best


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: bytes, seen: dict) -> np.ndarray:
    words = text.split()
    if len(seen) > WORDS_KEPT:
        seen.clear()
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


class Spans:
    """Hashes of any stretch of words from prefix sums (arithmetic modulo 2^64)."""

    def __init__(self, ids: np.ndarray):
        powers = np.full(len(ids), BASE, np.uint64)
        powers[:1] = 1
        back = np.full(len(ids) + 1, INVERSE, np.uint64)
        back[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * np.cumprod(powers), dtype=np.uint64)])
        self.back = np.cumprod(back)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def symbols(ids: np.ndarray, rounds: Rounds) -> np.ndarray:
    """Where the symbols of the last pair round start."""
    starts, names = np.arange(len(ids)), ids
    if rounds.pairs < 0 or len(ids) < 2:
        return starts
    run = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    length = np.diff(run, append=len(ids))
    twins = run[length == 2]
    keep = np.ones(len(ids), bool)
    keep[twins + 1] = False
    names = ids.copy()
    names[twins] = mixed(ids[twins] * BASE + np.uint64(2))
    starts, names = starts[keep], names[keep]
    for k in range(rounds.pairs):
        right = (mixed(names + np.uint64(k + 1)) >> np.uint64(63)).astype(bool)
        first = np.flatnonzero(~right[:-1] & right[1:])
        keep = np.ones(len(names), bool)
        keep[first + 1] = False
        names = names.copy()
        names[first] = mixed(names[first] * BASE + mixed(names[first + 1]))
        starts, names = starts[keep], names[keep]
    return starts


def anchors(ids: np.ndarray, spans: Spans, rounds: Rounds):
    """(name, start, windows, shift) arrays: runs of windows that one block anchors.

    Of the blocks in a window's interior, the one with the least name is its anchor (the leftmost of
    equal ones), which is the same wherever the window occurs. ``shift`` is the block's distance from
    the first of its windows.
    """
    n, w = len(ids), rounds.window
    if n < w:
        return None
    begin = symbols(ids, rounds)
    border = np.append(begin, n)
    last = np.searchsorted(border, begin + rounds.block)
    begin = begin[last < len(border)]
    end = border[last[last < len(border)]]
    names = spans.hash(begin, end)
    windows = np.arange(n - w + 1)
    low = np.searchsorted(begin, windows + rounds.margin)
    high = np.searchsorted(end, windows + w - rounds.margin, side="right")
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    levels = [rank]
    while (1 << len(levels)) <= int((high - low).max()):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    chosen = np.empty(len(windows), np.int64)
    level = np.frexp((high - low).astype(float))[1] - 1
    for k in range(len(levels)):
        at = level == k
        chosen[at] = np.minimum(levels[k][low[at]], levels[k][high[at] - (1 << k)])
    block = order[chosen]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    count = np.diff(first, append=len(windows))
    return names[block[first]], first, count, begin[block[first]] - first


def _anchor_rows(rounds: Rounds):
    def run(batches):
        seen = _Hashes()
        for batch in batches:
            for low, high in slices(batch.column(0)):
                k1, k2 = (batch.column(k)[low:high].to_pylist() for k in (1, 2))
                out = []
                for i, text in enumerate(batch.column(0)[low:high].to_pylist()):
                    ids = word_hashes(text or b"", seen)
                    spans = Spans(ids)
                    found = anchors(ids, spans, rounds)
                    if found is None:
                        continue
                    name, start, count, shift = found
                    span = mixed(spans.hash(start, start + count - 1 + rounds.window) + shift.astype(np.uint64))
                    m = len(name)
                    out.append((name.view(np.int64), span.view(np.int64), np.full(m, k1[i]), np.full(m, k2[i]),
                                start, count, shift))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    kinds = [pa.int64()] * 4 + [pa.int32()] * 3
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)],
                        names=["name", "span", "k1", "k2", "start", "windows", "shift"])

    return run


def _window_rows(rounds: Rounds):
    """Every window of the listed anchor runs: (h1, h2, k1, k2, start, alone)."""
    def run(batches):
        seen = _Hashes()
        for batch in batches:
            for low, high in slices(batch.column(0)):
                out = []
                rows = batch.slice(low, high - low).to_pylist()
                for row in rows:
                    ids = word_hashes(row["text"] or b"", seen)
                    spans, parts = Spans(ids), row["runs"]
                    count = np.array([p["windows"] for p in parts])
                    which = np.repeat(np.arange(len(parts)), count)
                    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    start = np.array([p["start"] for p in parts])[which] + inner
                    place = (np.array([p["shift"] for p in parts])[which] - inner).astype(np.uint64)
                    name = np.array([p["name"] for p in parts], np.int64).view(np.uint64)[which]
                    m = len(start)
                    out.append((mixed(name * BASE + place).view(np.int64),
                                spans.hash(start, start + rounds.window).view(np.int64),
                                np.full(m, row["k1"]), np.full(m, row["k2"]), start,
                                np.array([p["alone"] for p in parts])[which]))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)],
                        names=["h1", "h2", "k1", "k2", "start", "alone"])

    return run


def _keep_rows(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1)):
                ids, texts, copied, cuts = (batch.column(k)[low:high] for k in range(4))
                out = []
                for text, twice, parts in zip(texts.to_pylist(), copied.to_pylist(), cuts.to_pylist(), strict=True):
                    words = (text or b"").split()
                    n = len(words)
                    if twice and n >= window:
                        words = []
                    elif parts:
                        edge = np.zeros(n + 1, np.int64)
                        start = np.array([p["start"] for p in parts])
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + np.array([p["windows"] for p in parts]) - 1 + window, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
                    kept = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                     pa.array(cols[3], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, id_column: str = "doc_id", text_column: str = "text",
                   with_text: bool = True) -> DataFrame:
    """Remove every word that is covered by a window of ``window`` words which also starts elsewhere.

    Words lie between ASCII white space. Returns a row per document: id, n_words, n_removed,
    kept_sha256, kept (the kept words joined by one space; null without ``with_text``). Every row
    counts as a document, also with a null or repeated id; a null text has no words; texts shorter
    than a window lose nothing; of equal texts of at least a window nothing stays. An empty table
    gives no rows; other columns are not read. Windows are compared by two 64-bit hashes.
    """
    rounds = rounds_for(window)
    text = column(text_column).cast("binary")
    rows = docs.select(column(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"),
                       F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("k2"))
    found = cut(rows.select("text", "k1", "k2").mapInArrow(_anchor_rows(rounds), ANCHORS))
    place = F.xxhash64("k1", "k2", "start")
    some = found.groupBy("name").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("name")
    shared = cut(found.join(some, "name"))
    spans = cut(shared.groupBy("name", "span").agg(
        F.min(place).alias("x"), F.max(place).alias("y"),
        F.min(F.struct("k1", "k2", "start", "windows", "shift")).alias("one")).select(
        "name", "span", "one", (F.col("x") == F.col("y")).alias("alone")))
    whole = shared.join(spans.where("NOT alone").select("name", "span"), ["name", "span"]).select(
        "k1", "k2", "start", "windows")
    several = spans.groupBy("name").agg(F.min("span").alias("x"), F.max("span").alias("y")).where("x <> y")
    asked = spans.join(several.select("name"), "name").select("one.*", "name", "alone").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("start", "windows", "shift", "name", "alone")).alias("runs"))
    texts = rows.select("text", "k1", "k2").join(asked.hint("merge"), ["k1", "k2"])
    windows = cut(texts.select("text", "k1", "k2", "runs").mapInArrow(
        _window_rows(rounds), "h1 long, h2 long, k1 long, k2 long, start int, alone boolean"))
    twice = windows.groupBy("h1", "h2").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    single = windows.where("alone").join(twice.select("h1", "h2"), ["h1", "h2"]).select(
        "k1", "k2", "start", F.lit(1).alias("windows"))
    copied = rows.groupBy("k1", "k2").agg((F.count("*") > 1).alias("copied")).where("copied")
    cuts = union(whole, single).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "windows")).alias("cuts"))
    decided = cut(cuts.join(copied, ["k1", "k2"], "full"))
    return rows.join(decided.hint("merge"), ["k1", "k2"], "left").select(
        "id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "cuts").mapInArrow(
        _keep_rows(window, with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
