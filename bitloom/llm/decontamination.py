"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other values has the same
template. Windows of canonical tokens are joined by hash, and a window counts if its slot values map
one to one onto the item's. Exact copies are also compared as they stand, token by token.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import Features, Words, column, cut, mixed, numbered, prepare, slices, unused

WINDOW = 13  # canonical tokens; a shorter item is one window of its own length
LITERALS = 4  # words that a window with slots must hold besides them
HASHES_SENT = 2_000_000  # template windows up to which their hashes (16 MB) go to the tasks

# Scripts written without spaces between words (and the Japanese length mark); a letter is a token.
_DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\u30FC\uFF70"
_LETTER = rf"(?:(?![{_DENSE}])\p{{L}})"
_TOKEN = regex.compile(rf"\p{{N}}+(?:[.,]\p{{N}}+)*|(?:(?=[{_DENSE}])\p{{L}})\p{{M}}*"
                       rf"|{_LETTER}(?:{_LETTER}|\p{{M}})*(?:['’]{_LETTER}+)*|[%$€£°]")
_NUMBER = regex.compile(r"\p{N}")
_BESIDE = ".,;:!?()[]{}\"*-"  # around letters these are never part of a token
_PLAIN_LETTERS = 0x0300  # below it no letter belongs to a script without spaces
_NUMBERS, _UNITS, _NAMES = 1, 2, 3

# Units that a question may swap.
UNITS = frozenset("""
% $ € £ ° mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre
kilometres kilometer kilometers mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons
ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks
month months year years cent cents dollar dollars euro euros percent degree degrees watt watts volt volts
""".split())

# Words whose capital only marks the start of a sentence.
PLAIN = frozenset("""
a an the this that these those it he she they we you i who what which when where why how if in on at of
for from to with by and or but not is are was were do does did can could will would should may each every
all some any no one two three find given let suppose there after before then
""".split())

SLICE = 1 << 20  # bytes of text whose windows are in arrays at a time
VIEWS = 3  # names as slots; names as words (catches copies in another case); no slots at all
EXACT = 2  # the view without slots, in which windows need no words
ROWS = "row long, view int, length int, pos int, hash long, slots array<long>"


def _kind(token: str, low: str) -> int:
    if not token[0].isalpha() and _NUMBER.match(token):
        return _NUMBERS
    if low in UNITS:
        return _UNITS
    return _NAMES if token[0].isupper() and low not in PLAIN else 0


class _Tokens(Features):
    """Canonical tokens of chunks: per view a hash, and what a slot holds."""

    def __init__(self):
        super().__init__(self._derive)

    def forget(self) -> None:
        super().forget()
        self.known = Words()
        self.table = np.zeros((0, 6), np.uint64)

    def _derive(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found, counts = [], []
        for chunk in new:
            text = chunk.decode("utf-8", "replace")
            bare = text.strip(_BESIDE)
            if bare.isalpha() and (bare.isascii() or ord(max(bare)) < _PLAIN_LETTERS):
                found.append(bare)
                counts.append(1)
            else:
                parts = _TOKEN.findall(text)
                found += parts
                counts.append(len(parts))
        ids = numbered(self.known, found)
        self._describe(list(islice(reversed(self.known), len(self.known) - len(self.table)))[::-1])
        return ids, np.array(counts, np.int64)

    def _describe(self, tokens: list[str]) -> None:
        """Rows of the table: a hash per view, the value's hash, and per view whether the token is a slot."""
        if not tokens:
            return
        low = [t.lower() for t in tokens]
        values = np.fromiter(map(xxhash.xxh64_intdigest, low), np.uint64, len(low))
        kinds = np.fromiter(map(_kind, tokens, low), np.int64, len(low))
        rows = np.zeros((len(low), 6), np.uint64)
        rows[:, :3] = np.stack([mixed(values + np.uint64(1))] * 2 + [values], axis=1)
        for view, slots in enumerate((kinds > 0, (kinds == _NUMBERS) | (kinds == _UNITS))):
            rows[slots, view] = mixed(kinds[slots].astype(np.uint64))
            rows[slots, 3 + view] = 1
        self.table = np.concatenate([self.table, rows])


def _windows(hashes: np.ndarray, lengths: list[int], view: int):
    """(length, hashes of all windows of that length), lengths ascending; a window grows from the one a token shorter."""
    total = np.zeros(len(hashes), np.uint64)
    for length in range(1, min(lengths[-1], len(hashes)) + 1):
        total = total[:len(hashes) - length + 1] * np.uint64(0x9E3779B97F4A7C15)
        total += hashes[length - 1:]
        if length in lengths:
            yield length, mixed(total + np.uint64(length * VIEWS + view))


def _window_rows(shapes: list[tuple[int, int]], wanted: np.ndarray | None, whole_only: bool, literals: int = LITERALS):
    """Windows of every row (row, text): all of them, or those whose hash is among ``wanted``.

    ``shapes``: the lengths and views to make windows of.
    ``whole_only`` is for items: a length below ``WINDOW`` applies to items of just that length.
    ``literals``: words that a window with slots holds at least.
    """
    views: dict[int, list[int]] = {}
    for length, view in sorted(shapes):
        views.setdefault(view, []).append(length)
    sieve = None
    if wanted is not None:
        sieve = np.zeros(1 << 22, bool)
        sieve[(wanted >> np.uint64(42)).astype(np.int64)] = True

    def run(batches):
        tokens = _Tokens()
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                keys = batch.column(0)[low:high].to_numpy()
                chunks, sizes = tokens.numbers([t or b"" for t in batch.column(1)[low:high].to_pylist()])
                stream = tokens.of(chunks)
                held = np.concatenate([[0], np.cumsum(tokens.start[chunks + 1] - tokens.start[chunks])])
                border = held[np.concatenate([[0], np.cumsum(sizes)])]
                out = {name: [] for name in ("row", "view", "length", "pos", "hash", "slots")}
                if len(stream):
                    owner = np.repeat(np.arange(len(keys)), np.diff(border))
                    facts = tokens.table[stream]
                    for view, lengths in views.items():
                        literal = np.concatenate([[0], np.cumsum(facts[:, 3 + view] == 0)])
                        for length, hashes in _windows(facts[:, view], lengths, view):
                            good = owner[:len(hashes)] == owner[length - 1:]
                            if whole_only and length < WINDOW:
                                good &= np.diff(border)[owner[:len(good)]] == length
                            if view != EXACT:
                                good &= literal[length:] - literal[:-length] >= literals
                            if sieve is not None:
                                good &= sieve[(hashes >> np.uint64(42)).astype(np.int64)]
                            at = np.flatnonzero(good)
                            if wanted is not None and len(at):
                                place = np.minimum(np.searchsorted(wanted, hashes[at]), len(wanted) - 1)
                                at = at[wanted[place] == hashes[at]]
                            if not len(at):
                                continue
                            out["row"].append(keys[owner[at]])
                            out["view"].append(np.full(len(at), view))
                            out["length"].append(np.full(len(at), length))
                            out["pos"].append(at - border[owner[at]])
                            out["hash"].append(hashes[at].view(np.int64))
                            for i in at:
                                part = facts[i:i + length]
                                out["slots"].append(part[part[:, 3 + view] == 1, 2].view(np.int64))
                if out["row"]:
                    kinds = {"row": pa.int64(), "view": pa.int32(), "length": pa.int32(), "pos": pa.int32(), "hash": pa.int64()}
                    arrays = [pa.array(np.concatenate(out[n])).cast(k) for n, k in kinds.items()]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(out["slots"], pa.list_(pa.int64()))], names=list(out))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               item_column: str = "item_id", item_text_column: str = "text", hashes_sent: int = HASHES_SENT,
               literals: int = LITERALS) -> DataFrame:
    """Which documents hold which benchmark items: row, id, item_id, windows, first, same_values.

    ``row`` is the hash of a document's id and text, ``windows`` counts its windows (13 canonical
    tokens; a shorter item in full) that occur in the item as they stand or with consistent slots, ``first`` is the
    least token position, ``same_values`` says whether a window agrees in its values too. Equal item
    texts count as the item of least id. Windows with fewer than ``literals`` words besides slots,
    and items of fewer tokens than that, only match their exact copies (in any case; a letter of a
    script without spaces is a token). Null texts on either side and items without tokens match nothing; null ids are reported as null. Empty tables give no rows;
    other columns are not read. Template hashes go to the tasks only up to ``hashes_sent``; beyond
    that all document windows are joined by shuffle, with the same result.
    """
    spark = prepare(docs.sparkSession)
    items = benchmark.select(column(item_text_column).cast("string").alias("text"), column(item_column).cast("long").alias("item_id")).where(
        "text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id")).withColumn("row", F.xxhash64("text"))
    items = cut(items)
    plain = items.select("row", F.col("text").cast("binary"))
    shapes = [(n, view) for n in range(1, WINDOW + 1) for view in range(VIEWS) if view == EXACT or n >= literals]
    named = cut(plain.mapInArrow(_window_rows(shapes, None, True, literals), ROWS).withColumnsRenamed(
        {"row": "item", "pos": "item_pos", "slots": "item_slots"}).distinct())
    used = sorted((r["length"], r["view"]) for r in named.select("length", "view").distinct().collect())
    wanted = None
    hashes = named.select("hash").distinct()
    if hashes.count() <= hashes_sent:
        wanted = np.sort(hashes.toArrow().column(0).to_numpy().view(np.uint64))
    keyed = docs.select(column(id_column).cast("long").alias("id"), column(text_column).cast("string").alias("text")).select(
        "id", F.xxhash64("id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    rows = keyed.where("text IS NOT NULL").select("row", "text")
    windows = rows.mapInArrow(_window_rows(used, wanted, False, literals), ROWS)
    both = windows.join(named, ["hash", "view", "length"])
    pairs = F.size(F.array_distinct(F.arrays_zip("slots", "item_slots")))
    consistent = (pairs == F.size(F.array_distinct("slots"))) & (pairs == F.size(F.array_distinct("item_slots")))
    found = both.where(consistent).groupBy("row", "item").agg(
        F.countDistinct("length", "pos").alias("windows"), F.min("pos").alias("first"),
        F.max(F.col("slots") == F.col("item_slots")).alias("same_values"))
    ids = keyed.select("row", "id").distinct()
    return found.join(items.select(F.col("row").alias("item"), "item_id"), "item").join(ids, "row").select(
        "row", "id", "item_id", "windows", "first", "same_values")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are (see ``find_leaks``)."""
    (name,) = unused(docs, "__row")
    leaks = find_leaks(docs, benchmark, id_column, text_column, **options).select(F.col("row").alias(name)).distinct()
    row = F.xxhash64(column(id_column).cast("long"), column(text_column).cast("string"))
    return docs.withColumn(name, row).join(cut(leaks), name, "left_anti").drop(name)
