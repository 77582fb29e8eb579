"""Importance resampling towards a target corpus by hashed n-grams, on Arrow kernels.

Texts become words by Arrow's ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``; runs of words are combinations of shifted dictionary indices, of which only distinct ones are
hashed. Bucket counts of both corpora give every bucket a gain; a document's weight is the mean gain of
its n-grams, and Gumbel noise from its id turns weights into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import CRC_TABLE, column, crc_sql, cut, prepare, ranked, slices

# Fixed values of the features, the gains and the draw.
BUCKETS = 10_000
ORDERS = 2  # words of the longest run
SCALE = 1000
PERCENT = 25  # drawn of the documents with enough words
LEAST_WORDS = 20
SEED = 7
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

SLICE = 1 << 20  # bytes of text in arrays at a time


def word_indices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Dictionary index and text number of every word of ``texts`` in turn, and the dictionary. Nulls have none."""
    whole = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower needs arrays that are no slices
    parts = pc.split_pattern_regex(pc.ascii_lower(whole).cast(pa.large_string()), pattern=GAPS)
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(real))
    return (coded.indices.to_numpy().astype(np.int64), owner.filter(real).to_numpy().astype(np.int64),
            coded.dictionary.cast(pa.large_binary()).to_pylist())


def feature_buckets(texts: pa.Array, orders: int = ORDERS, buckets: int = BUCKETS):
    """(bucket, text number) of every run of 1 to ``orders`` words, one order after the other; words per text.

    A run is named by the name of its shorter run and the next word's index; the CRC of a distinct run goes on from the
    CRC of the shorter one, so no text of a run is ever built.
    """
    index, owner, dictionary = word_indices(texts)
    crc = np.fromiter(map(zlib.crc32, dictionary), np.uint32, len(dictionary))
    spaced = [b" " + w for w in dictionary]
    name, hashes = index, crc
    found, owners = [crc[index] % np.uint32(buckets)], [owner]
    for n in range(2, orders + 1):
        starts = np.flatnonzero(owner[n - 1:] == owner[:len(owner) - n + 1]) if len(owner) >= n else np.zeros(0, np.int64)
        pairs = name[starts] * len(dictionary) + index[starts + n - 1]
        distinct, again = np.unique(pairs, return_inverse=True)
        heads, tails = np.divmod(distinct, max(1, len(dictionary)))
        hashes = np.fromiter(map(zlib.crc32, map(spaced.__getitem__, tails.tolist()), hashes[heads].tolist()),
                             np.uint32, len(distinct))
        found.append(hashes[again] % np.uint32(buckets))
        owners.append(owner[starts])
        name = np.zeros(len(index), np.int64)
        name[starts] = again
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def bucket_counts(docs: DataFrame, text_column: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """Occurrences of n-grams per bucket over all texts: (bucket, n). Tasks hand on sums, at most ``buckets`` rows each."""
    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for low, high in slices(batch.column(0), SLICE):
                held += np.bincount(feature_buckets(batch.column(0)[low:high], orders, buckets)[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    return docs.select(column(text_column).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What an n-gram of every bucket is worth: scaled log ratio of smoothed shares, rounded down."""
    size = len(corpus)
    s, t = int(corpus.sum()) + size, int(target.sum()) + size
    return np.array([math.floor(SCALE * math.log((b + 1) * s / ((a + 1) * t)))
                     for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def collected(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts as one array of ``buckets`` numbers, the only thing of a corpus that the driver sees."""
    out = np.zeros(buckets, np.int64)
    rows = counts.toArrow()
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text",
          orders: int = ORDERS) -> DataFrame:
    """A row per document: id, n_words, n_features, weight (mean gain of its features rounded down, 0 without any)."""
    def measure(batches):
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                bucket, owner, n_words = feature_buckets(batch.column(1)[low:high], orders, len(gain))
                order = np.argsort(owner, kind="stable")
                n = np.bincount(owner, minlength=high - low)
                total = np.zeros(high - low, np.int64)
                some = n > 0
                if some.any():
                    total[some] = np.add.reduceat(gain.take(bucket[order]), (np.cumsum(n) - n)[some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=["id", "n_words", "n_features", "weight"])

    return docs.select(column(id_column).cast("long").alias("id"), column(text_column).cast("string").alias("text")).mapInArrow(
        measure, "id long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Scaled Gumbel noise from the first 8 hex digits of sha256('seed:id'), rounded down; a null id is no digits."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             orders: int = ORDERS, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text",
             target_column: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_features, weight, score, rank (null where not drawn).

    ``docs`` are compared with the texts of ``target``. Of the documents with ``least_words`` words or more,
    ``percent`` in a hundred of highest score are drawn and ranked from 1, ties to the smaller id, null ids last.
    Null and empty texts have no features and weight 0; texts count whole. Rows that repeat an id have the same
    noise and a row and a rank each. Empty tables give no rows, an empty target equal counts; other columns are not read.
    """
    prepare(docs.sparkSession)
    gain = gains(collected(bucket_counts(docs, text_column, orders, buckets), buckets),
                 collected(bucket_counts(target, target_column, orders, buckets), buckets))
    scored = cut(weigh(docs, gain, id_column, text_column, orders).withColumn(
        "score", F.col("weight") + noise(F.col("id"), seed)))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    placed = ranked(scored.where(able), [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank")
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def oracle() -> str:
    """The same in DuckDB SQL over ``documents`` and ``benchmark``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def features(name: str, table: str, key: str) -> str:
        return f"""
{name}_w AS (SELECT {key} AS id, list_filter(regexp_split_to_array(coalesce(translate(text, '{upper}', '{lower}'), ''),
    '{GAPS}'), lambda w: w <> '') AS w FROM {table}),
{name}_f AS MATERIALIZED (SELECT id, w[i] AS f FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM {name}_w)
    UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM {name}_w))"""

    return f"""
WITH {CRC_TABLE},{features("d", "documents", "doc_id")},{features("b", "benchmark", "item_id")},
hashed AS MATERIALIZED (SELECT f, {crc_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM d_f UNION SELECT f FROM b_f), crc),
s AS (SELECT bucket, count(*) AS n FROM d_f JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b_f JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor({SCALE} * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d_f) + {BUCKETS})
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b_f) + {BUCKETS}))))::BIGINT AS g FROM s FULL JOIN t USING (bucket)),
means AS (SELECT id, count(*) AS n, sum(g) AS total FROM d_f JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY id),
weighed AS (SELECT d_w.id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || left(sha256('{SEED}:' || coalesce(d_w.id::VARCHAR, '')), 8))::BIGINT AS h FROM d_w LEFT JOIN means USING (id)),
scored AS (SELECT doc_id, n_words, n_features, weight,
    weight + floor(-{SCALE} * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
    FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""
