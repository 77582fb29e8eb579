"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from bitloom.llm.resampling import BUCKETS, GAPS, feature_buckets, resample
from tests.llm.conftest import LONG

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split(GAPS, (text or "").translate(LOWER)) if w]


def buckets(text, orders=2):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % BUCKETS for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def plain(docs, items, percent=25, least=20, seed=7):
    s, t = (Counter(b for text in texts for b in buckets(text)) for texts in ([d[1] for d in docs], items))
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (total_s + BUCKETS) / ((s[b] + 1) * (total_t + BUCKETS))))

    rows = []
    for key, text in docs:
        f = buckets(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return ranks + [(*r, None) for r in rows if r[1] < least]


def sort(rows):
    return sorted(map(tuple, rows), key=str)


COLUMNS = ("id", "n_words", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_features(orders):
    texts = ["A b a B", None, "", "...", "Été d'été\x7f日本 x9", "one", LONG[:3000]]
    for part in (pa.array(texts), pa.array([*texts, "z"])[2:7]):
        bucket, owner, n = feature_buckets(part, orders)
        for k, text in enumerate(part.to_pylist()):
            assert sorted(bucket[owner == k].tolist()) == sorted(buckets(text, orders)) and n[k] == len(words(text))


def test_draw(documents, small, edges):
    rows = [(d, t) for d, t, _ in small] + list(edges) + [(1, small[0][1]), (1, small[0][1]), (None, LONG)]
    items = [t for _, t, _ in small[:5]] + [None, ""]
    found = resample(documents(rows), documents(list(enumerate(items)))).select(*COLUMNS).collect()
    assert sort(found) == sort(plain(rows, items))
    half = resample(documents(rows), documents(list(enumerate(items))), percent=50, least_words=1, seed=8).select(*COLUMNS).collect()
    assert sort(half) == sort(plain(rows, items, 50, 1, 8))


def test_nothing(documents):
    assert resample(documents([]), documents([(1, "a b")])).isEmpty()
    rows = [(1, "a b c"), (2, None), (3, "x " * 30)]
    found = resample(documents(rows), documents([]), percent=100).select(*COLUMNS).collect()
    assert sort(found) == sort(plain(rows, [], 100))
