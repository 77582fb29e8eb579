"""Quality classifier: naive Bayes support vectors.

Features are indicators of character n-grams and of n-grams of word shapes. They are scaled by the
log ratio of their counts in the two classes, counted over all labelled documents; a linear
hinge-loss model on the scaled indicators is fitted by dual coordinate descent.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import Features, column, cut, gram_numbers, mixed, slices

BUCKETS = 1 << 16
SAMPLE_ROWS = 8_000  # labelled documents that the hinge-loss fit may use
_RUN = re.compile(r"(.)\1+")


def _shape(chunk: str) -> str:
    """Letters by case, digits as 9, anything else as it is; repeats of a sign shortened to two."""
    signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in chunk)
    return _RUN.sub(lambda m: m[1] if m[1] in "Aa9" else m[1] * 2, signs)


class _Chunks(Features):
    """Character 1- to 3-grams of chunks (case kept, borders marked), and a number for each one's shape."""

    def __init__(self):
        super().__init__(self._derive)

    def forget(self) -> None:
        super().forget()
        self.shape = np.zeros(0, np.uint64)

    def _derive(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        shapes = [zlib.crc32(_shape(t).encode()) for t in texts]
        self.shape = np.concatenate([self.shape, np.array(shapes, np.uint64)])
        return gram_numbers([f" {t} " for t in texts], list(range(len(texts))), len(texts), BUCKETS)


def _indicators(features: _Chunks, ids: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of one document from its chunks in order.

    Shape n-grams also say whether a chunk repeats the one before.
    """
    if not len(ids):
        return np.zeros(0, np.int64)
    shape = features.shape[ids]
    shape[1:] += (ids[1:] == ids[:-1]).astype(np.uint64) << np.uint64(40)
    seen = np.zeros(BUCKETS, bool)
    seen[features.of(np.unique(ids))] = True
    total = np.zeros(len(ids), np.uint64)
    for n in (1, 2, 3):
        if len(ids) < n:
            break
        total = mixed(total[:len(ids) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + shape[n - 1:] + np.uint64(n))
        seen[(total % np.uint64(BUCKETS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def _documents(batch: pa.RecordBatch, k: int, features: _Chunks):
    """(low, high, indicator arrays) of slices of a batch whose texts are column ``k``."""
    for low, high in slices(batch.column(k)):
        ids, sizes = features.numbers([t or b"" for t in batch.column(k)[low:high].to_pylist()])
        ends = np.cumsum(sizes)
        yield low, high, [_indicators(features, ids[e - n:e]) for n, e in zip(sizes, ends, strict=True)]


@dataclass(frozen=True)
class Model:
    """Weights of the indicators, how rows are scaled, and the map from margins to probabilities."""

    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([_margin(self, r) for r in rows])


def _margin(model: Model, row: np.ndarray) -> float:
    if not len(row):
        return model.bias
    return float((model.weights[row] * model.scale[row]).sum() / max(1e-9, np.linalg.norm(model.scale[row])) + model.bias)


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 15,
                 seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias: one dual variable per row, optimised exactly one at a time."""
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / max(1e-9, np.linalg.norm(scale[r])) for r in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    signs = np.where(labels == 1, 1.0, -1.0)
    both = np.array([(labels == 0).sum(), (labels == 1).sum()])
    most = cost * len(rows) / (2.0 * np.maximum(both, 1))[(labels == 1).astype(int)]
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in random.permutation(len(rows)):
            slope = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            moved = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            step = (moved - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = moved
        if largest < 1e-4:
            break
    return weights, bias


def _calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps with smoothed targets."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows (id, text, label 0/1).

    Class counts of the features cover every row; the hinge-loss fit takes at most ``sample_rows``
    rows, those with the least hash of their id. Without rows of both classes the score is the
    smoothed share of label 1.
    """
    rows = labelled.select("id", F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"),
                           F.xxhash64("id", F.lit(11)).alias("draw")).where("label IN (0, 1)")

    edge = rows.select("draw").orderBy("draw").limit(sample_rows).agg(F.max("draw")).first()[0]

    def features_of(batches):
        features, totals = _Chunks(), np.zeros((2, BUCKETS), np.int64)
        documents = np.zeros(2, np.int64)
        for batch in batches:
            for low, high, found in _documents(batch, 1, features):
                labels = batch.column(2)[low:high].to_numpy()
                draws = batch.column(3)[low:high].to_numpy()
                for row, label in zip(found, labels, strict=True):
                    totals[label, row] += 1
                    documents[label] += 1
                picked = np.flatnonzero(draws <= edge)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1] * len(picked), pa.int32()), pa.array(labels[picked], pa.int32()),
                     pa.array(draws[picked], pa.int64()), pa.array([found[i].astype(np.int32) for i in picked], pa.list_(pa.int32()))],
                    names=["feature", "label", "n", "row"])
        for label in (0, 1):
            used = np.flatnonzero(totals[label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, BUCKETS), pa.int32()), pa.array([label] * (len(used) + 1), pa.int32()),
                 pa.array(np.append(totals[label][used], documents[label])), pa.nulls(len(used) + 1, pa.list_(pa.int32()))],
                names=["feature", "label", "n", "row"])

    derived = cut(rows.mapInArrow(features_of, "feature int, label int, n long, row array<int>"))
    counts = derived.where("feature >= 0").groupBy("feature", "label").agg(F.sum("n").alias("n")).toArrow()
    totals, documents = np.zeros((2, BUCKETS)), np.zeros(2)
    for f, label, n in zip(*(counts.column(c).to_pylist() for c in ("feature", "label", "n")), strict=True):
        if f == BUCKETS:
            documents[label] = n
        else:
            totals[label, f] = n
    if documents.min() == 0:
        share = (documents[1] + 1) / (documents.sum() + 2)
        return Model(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    smooth = (totals + 1) / (documents[:, None] + 2)
    scale = np.log(smooth[1] / (1 - smooth[1])) - np.log(smooth[0] / (1 - smooth[0]))
    sample = derived.where("feature = -1").orderBy("n", "label").limit(sample_rows).select("label", "row").toArrow()
    labels = sample.column("label").to_numpy()
    flat = sample.column("row").combine_chunks()
    found = [np.asarray(flat[i].values, dtype=np.int64) for i in range(len(flat))]
    half = np.arange(len(found)) % 4 == 0  # a quarter calibrates what the rest has fitted
    weights, bias = dual_descent([r for r, h in zip(found, half, strict=True) if not h], labels[~half], scale)
    plain = Model(weights, scale, bias, 1.0, 0.0)
    slope, shift = _calibrate(plain.margins([r for r, h in zip(found, half, strict=True) if h]), labels[half])
    return Model(weights, scale, bias, slope, shift)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Probability of label 1 for every document: id, score. Null and empty texts get the bias alone."""
    def run(batches):
        features = _Chunks()
        for batch in batches:
            for low, high, found in _documents(batch, 1, features):
                value = model.slope * model.margins(found) + model.shift
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))), pa.float64())],
                    names=["id", "score"])

    return docs.select(column(id_column).cast("long"), column(text_column).cast("binary")).mapInArrow(
        run, "id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, learn_from, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id",
                  text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Learn from labelled documents for which ``learn_from(id)`` holds, then score every document.

    Rows without text or label teach nothing; repeated label rows count each. Every document row has a
    score, also with a null or repeated id. An empty table gives no rows; columns other than id, text
    and label are not read.
    """
    marks = labels.select(column(id_column).cast("long").alias("id"), column(label_column).alias("label")).where(
        learn_from(F.col("id")) & F.col("label").isNotNull())
    texts = docs.select(column(id_column).cast("long").alias("id"), column(text_column).alias("text")).where(
        learn_from(F.col("id")) & F.col("text").isNotNull())
    return score(docs, learn(texts.join(marks, "id"), sample_rows), id_column, text_column)
