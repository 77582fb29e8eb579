"""Language identification as a mixture of languages per document.

Character n-gram likelihoods are learnt from every labelled text. A document is a mixture of
languages from which its words are drawn; expectation-maximisation finds the proportions, and the set
of languages grows as long as the likelihood gains more than a further language costs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import Features, column, gram_numbers, slices, unused

BUCKETS = 1 << 16  # n-grams are counted by hash
ORDERS = (1, 2, 3)
LETTERS = re.compile(r"[^\W\d_]+")
COST = 3.0  # log-likelihood per log word that a further language must gain
STEPS = 12


def _grams(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram numbers of the words of every chunk, with their borders; none if it has no letter."""
    words, owner = [], []
    for k, chunk in enumerate(chunks):
        for word in LETTERS.findall(chunk.decode("utf-8", "replace").lower()):
            if not word.isalpha():  # numerals such as superscripts count as word characters, not as letters
                word = "".join(filter(str.isalpha, word))
            if word:
                words.append(f"^{word}$")
                owner.append(k)
    return gram_numbers(words, owner, len(chunks), BUCKETS, ORDERS)


def count_grams(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """N-gram counts of every language over all given documents: lang, gram, n."""
    def count(batches):
        features, totals = Features(_grams), {}
        for batch in batches:
            for low, high in slices(batch.column(0)):
                texts = [t or b"" for t in batch.column(0)[low:high].to_pylist()]
                langs = np.array(batch.column(1)[low:high].to_pylist(), object)
                ids, sizes = features.numbers(texts)
                owner = np.repeat(langs, sizes)
                for lang in set(langs.tolist()):
                    times = np.bincount(ids[owner == lang], minlength=len(features))
                    used = np.flatnonzero(times)
                    weight = np.repeat(times[used], features.start[used + 1] - features.start[used])
                    total = totals.setdefault(lang, np.zeros(BUCKETS))
                    total += np.bincount(features.of(used), weight, BUCKETS)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()),
                 pa.array(total[used].astype(np.int64))], names=["lang", "gram", "n"])

    known = docs.select(column(text_column).cast("binary").alias("text"), column(lang_column).cast("string").alias("lang"))
    return known.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(
        count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of n-grams per language (``languages``, ``logs``: languages x buckets)."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.logs = np.log((counts + smoothing) / (total + smoothing * BUCKETS)).astype(np.float32)
        self.prior = int(total[:, 0].argmax()) if len(languages) else 0


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Only the summed counts come to the driver: languages x 65,536 numbers at most."""
    rows = count_grams(docs, text_column, lang_column).toArrow()
    names = np.array(rows.column("lang").to_pylist(), object)
    languages = sorted(set(names.tolist()))
    counts = np.zeros((len(languages), BUCKETS))
    for k, lang in enumerate(languages):
        of = np.flatnonzero(names == lang)
        counts[k, rows.column("gram").to_numpy()[of]] = rows.column("n").to_numpy()[of]
    return Model(languages, counts)


def _fit(likely: np.ndarray, weight: np.ndarray, begin: np.ndarray, sizes: np.ndarray, start: np.ndarray):
    """Proportions and log-likelihood (relative) of documents whose words follow each other.

    ``likely``: words x languages, ``start``: documents x languages, ``begin`` and ``sizes``: the
    documents' words.
    """
    share, owner = start, np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(weight, begin)[:, None]
    for _ in range(STEPS):
        part = share[owner] * likely
        part *= (weight / np.maximum(part.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(part, begin, axis=0) / total
    mixed_ = (share[owner] * likely).sum(axis=1)
    return share, np.add.reduceat(weight * np.log(np.maximum(mixed_, 1e-30)), begin)


def _mixture(logs: np.ndarray, weight: np.ndarray, sizes: np.ndarray):
    """Best language, its share and the number of languages of documents with at least one word."""
    begin = np.cumsum(sizes) - sizes
    top = logs.max(axis=1, keepdims=True)
    likely = np.exp(logs - top)
    count, width = len(sizes), logs.shape[1]
    alone = np.add.reduceat((logs - top) * weight[:, None], begin, axis=0)
    best = alone.argmax(axis=1)
    score = 1 / np.exp(np.minimum(alone - alone[np.arange(count), best][:, None], 0)).sum(axis=1)
    value, chosen = alone[np.arange(count), best], np.ones(count, np.int64)
    if width == 1:
        return best, score, chosen
    share, _ = _fit(likely, weight, begin, sizes, np.full((count, width), 1 / width, np.float32))
    order = np.argsort(-share, axis=1, kind="stable")
    price = COST * np.log(np.add.reduceat(weight, begin) + 1)
    open_, owner = np.arange(count), np.repeat(np.arange(count), sizes)
    for size in range(2, width + 1):
        inside = np.isin(owner, open_)
        part_sizes = sizes[open_]
        sets = order[open_, :size]
        words = np.take_along_axis(likely[inside], np.repeat(sets, part_sizes, axis=0), axis=1)
        first = np.take_along_axis(share[open_], sets, axis=1) + 1e-3
        shares, reached = _fit(words, weight[inside], np.cumsum(part_sizes) - part_sizes, part_sizes,
                               (first / first.sum(axis=1, keepdims=True)).astype(np.float32))
        better = reached - price[open_] > value[open_]
        won = open_[better]
        if not len(won):
            break
        value[won], chosen[won] = reached[better] - price[won], size
        lead = shares[better].argmax(axis=1)
        best[won] = sets[better, lead]
        score[won] = shares[better, lead]
        open_ = won
    return best, np.clip(score, 0, 1), chosen


def identify(docs: DataFrame, model: Model, columns: list[str] | None = None, text_column: str = "text",
             outputs: tuple[str, str, str] = ("_lang_pred", "_share", "_languages")) -> DataFrame:
    """The documents' ``columns`` (all by default), _lang_pred, _share (of that language), _languages (how many).

    ``und`` with share 0 stands for a null text, a text without a letter, or a model without
    languages. Every row has a result, also with null or repeated ids; whole texts count. An empty
    table gives no rows. ``outputs`` names the new columns; columns of ``docs`` with these names give way.
    """
    gone = {name.lower() for name in outputs}
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in gone]
    last = len(columns)
    languages, logs = model.languages, model.logs / len(ORDERS)

    def run(batches):
        features = Features(_grams)
        scores = np.zeros((0, len(languages)), np.float32)
        limit = max(1 << 18, (8 << 20) // max(1, len(languages)))
        for batch in batches:
            for low, high in slices(batch.column(last), limit):
                texts = [t or b"" for t in batch.column(last)[low:high].to_pylist()]
                known = len(features)
                ids, sizes = features.numbers(texts)
                if len(features) < known or len(scores) > len(features):
                    scores = scores[:0]
                if len(scores) < len(features):
                    fresh = np.arange(len(scores), len(features))
                    count = features.start[fresh + 1] - features.start[fresh]
                    used = fresh[count > 0]
                    sums = np.zeros((len(fresh), len(languages)), np.float32)
                    if len(used) and languages:
                        begin = np.cumsum(count[count > 0]) - count[count > 0]
                        grams = features.of(used)
                        for k in range(len(languages)):
                            sums[count > 0, k] = np.add.reduceat(logs[k, grams], begin)
                    scores = np.concatenate([scores, sums])
                owner = np.repeat(np.arange(len(texts)), sizes)
                real = features.start[ids + 1] > features.start[ids]
                ids, owner = ids[real], owner[real]
                weight = np.ones(len(ids), np.float32)
                if len(ids) > 100_000:  # long texts: words with their counts
                    key, weight = np.unique(owner * len(features) + ids, return_counts=True)
                    owner, ids, weight = key // len(features), key % len(features), weight.astype(np.float32)
                per = np.bincount(owner, minlength=len(texts))
                some = np.flatnonzero(per)
                lang = np.full(len(texts), "und", object)
                score, many = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if len(some) and languages:
                    best, score[some], many[some] = _mixture(scores[ids], weight, per[some])
                    lang[some] = np.array(languages, object)[best]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[low:high] for c in range(last)), pa.array(lang, pa.string()), pa.array(score),
                     pa.array(many, pa.int32())], names=[*columns, *outputs])

    kept = docs.select(*[column(c) for c in columns])
    schema = T.StructType([*kept.schema.fields, T.StructField(outputs[0], T.StringType()),
                           T.StructField(outputs[1], T.DoubleType()), T.StructField(outputs[2], T.IntegerType())])
    return docs.select(*[column(c) for c in columns], column(text_column).cast("binary").alias(unused(docs, "__text")[0])).mapInArrow(run, schema)


def held_out(id_: Column, parts: int, part: int) -> Column:
    """Is the row left out of learning? CRC-32 of the id as text; null ids are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))
