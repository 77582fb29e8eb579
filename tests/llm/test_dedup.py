"""Near-duplicate documents, lines, windows and vectors against brute force."""

import math
import random

import numpy as np
import pytest

from bitloom.llm.common import components, number_rows
from bitloom.llm.embeddings import embedding_duplicates, learn_rotation
from bitloom.llm.lines import dedup_lines
from bitloom.llm.minhash import mismatches, near_duplicates, shape
from bitloom.llm.substrings import remove_repeats, rounds_for
from tests.llm import brute


def variants(seed, count, base_words=120, changed=3):
    """Copies of a text with a few words replaced, and the text itself."""
    draw = random.Random(seed)
    words = [f"w{draw.randrange(5000)}" for _ in range(base_words)]
    out = [" ".join(words)]
    for _ in range(count):
        copy = list(words)
        for i in draw.sample(range(base_words), changed):
            copy[i] = f"n{draw.randrange(5000)}"
        out.append(" ".join(copy))
    return out


def test_components_and_numbers(spark):
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 300)]
    edges = chain + [(draw.randrange(1000, 2000), draw.randrange(1000, 2000)) for _ in range(500)] + [(7, 7), (5, 6), (None, 4)]
    sets = brute.Sets(range(2000))
    for a, b in edges:
        if a is not None:
            sets.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = {r["id"]: r["component"] for r in components(df).collect()}
    assert found and all(sets.find(k) == v for k, v in found.items())
    assert {k for k in range(301)} <= set(found)
    assert components(df.limit(0)).isEmpty()
    rows = spark.createDataFrame([(i % 3, i // 2) for i in range(100)], "g int, v int")
    numbered = number_rows(rows, ["g"], ["v"], bucket_rows=10).collect()
    for g in range(3):
        assert sorted(r["rank"] for r in numbered if r["g"] == g) == list(range(sum(r["g"] == g for r in numbered)))


def test_signature_estimates():
    form = shape(5, 4, 5)
    assert form.hashes <= 128 and (1 - 0.8 ** form.rows) ** form.bands <= 1e-4
    one = np.array([[0x1, 0xF0]], np.uint64)
    assert mismatches(one[0], np.array([[0x1, 0xF0], [0x2, 0xF0], [0x1, 0x0F], [0x11, 0xF0]], np.uint64)).tolist() == [0, 1, 2, 1]


@pytest.mark.parametrize("words, above, below", [(3, 17, 20), (5, 4, 5)])
def test_near_duplicates(documents, small, edges, words, above, below):
    rows = [(d, t) for d, t, _ in small] + edges
    rows += [(10_000 + i, t) for i, t in enumerate(variants(1, 40))]
    rows += [(11_000 + i, t) for i, t in enumerate(variants(2, 25, changed=5))]
    rows += [(900_005, "ein Text"), (900_007, "EIN  text")]  # a repeated row and a copy in another case
    expected = brute.near_duplicates({d: t for d, t in rows if d is not None}, words, above, below)
    found = near_duplicates(documents(rows), words, above, below).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["id"]], r
            assert r["kept"] == (r["id"] == r["component_id"])
    assert near_duplicates(documents([])).isEmpty()


def test_lines(documents, small, edges):
    shared = "This line stands in many documents and is not quite the same everywhere"
    rows = [(d, t) for d, t, _ in small] + [e for e in edges if e[0] is not None]
    rows += [(20_000 + i, f"own {i} {i * i}\n{shared} {'!' * (i % 3)}\n\n{shared.upper()}\n x ") for i in range(12)]
    expected = brute.unique_lines(dict(rows))
    docs = documents(rows + [(None, shared), (900_005, "ein Text")])
    found = dedup_lines(docs).collect()
    assert len(found) == len(rows) + 2 and found[0].asDict().keys() == {*docs.columns, "_n_lines", "_n_removed"}
    for r in found:
        if r["doc_id"] is None:
            assert r["text"] == "" and r["_n_removed"] == 1  # ids come before the null id
        else:
            assert (r["text"], r["_n_removed"]) == expected[r["doc_id"]]
        assert r["id"] == "x"
    assert dedup_lines(documents([])).isEmpty()


@pytest.mark.parametrize("window", [35, 8, 3])
def test_repeated_windows(documents, small, edges, window):
    draw = random.Random(window)
    passage = " ".join(f"p{draw.randrange(50)}" for _ in range(80))
    rows = [(d, t) for d, t, _ in small[:120]] + edges
    for i in range(30):
        cut = sorted(draw.sample(range(80), 2))
        piece = " ".join(passage.split()[cut[0]:cut[1]])
        noise = " ".join(f"q{draw.randrange(9)}" for _ in range(20))
        rows.append((30_000 + i, f"{noise} {piece} {noise[:15]}"))
    rows += [(31_000, "a " * 90), (31_001, "b " * 36 + "c"), (31_002, "x y " * 50), (31_003, "a a b " * 40), (31_003, "a a b " * 40)]
    expected = brute.without_repeats([t for _, t in rows], window)
    by_id = {}
    for (d, t), e in zip(rows, expected, strict=True):
        by_id.setdefault(d, []).append(e)
    found = remove_repeats(documents(rows), window).collect()
    assert len(found) == len(rows)
    got = {}
    for r in found:
        got.setdefault(r["id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_id.items()}
    assert remove_repeats(documents([]), window).isEmpty()


def test_rounds_leave_room_for_a_block():
    for window in range(1, 200):
        r = rounds_for(window)
        assert r.margin + r.longest - 1 + r.block - 1 + r.longest <= window - r.margin or r.pairs < 0


def test_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(60, 32))
    rows = [base[i % 60] + draw.normal(size=32) * 0.03 * (i % 7) for i in range(400)]
    vectors = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows)]
    vectors += [(1000, vectors[3][1], 1), (1001, vectors[3][1], 1), (1002, None, 1), (1003, [0.0] * 32, 1),
                (1004, [math.nan] * 32, 1), (1005, [None] * 32, 1), (1006, [math.inf] + [0.0] * 31, 1), (1007, [], 1),
                (1008, [x * 2.0 ** 100 for x in vectors[5][1]], 1), (1009, [1.0, 2.0], 1), (1010, [2.0, 4.0], 1), (None, vectors[3][1], 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    links, groups = {v[0]: 0 for v in vectors}, brute.Sets([v[0] for v in vectors if v[0] is not None])
    good = [(i, np.array(v)) for i, v, _ in vectors if v and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for n, (i, x) in enumerate(good):
        for j, y in good[:n]:
            if len(x) == len(y) and x @ y >= 0.95 * np.linalg.norm(x) * np.linalg.norm(y):
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    found = embedding_duplicates(df).collect()
    assert len(found) == len(vectors)
    assert all(r["n_links"] <= links[r["id"]] for r in found)
    assert sum(r["n_links"] for r in found) >= 0.97 * sum(links.values())
    for r in found:
        if r["id"] is None:
            assert r["kept"] and r["n_links"] == 0 and r["component_id"] is None
        else:
            assert r["kept"] == (r["id"] == r["component_id"])
    for i in (1002, 1003, 1004, 1005, 1006, 1007):
        assert next(r for r in found if r["id"] == i)["component_id"] == i
    assert {r["id"]: r["component_id"] for r in found}[1010] == 1009
    assert embedding_duplicates(df.limit(0)).isEmpty()
    assert embedding_duplicates(df.where("vec_id IN (1002, 1003)")).count() == 2


@pytest.mark.parametrize("width, shift", [(64, 0.0), (64, 0.5), (48, 0.85)])
def test_vectors_near_the_threshold(spark, width, shift):
    """Pairs at cosines from 0.95 to 0.97 around a mean of squared norm ``shift``."""
    draw = np.random.default_rng(width)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    mean = unit(draw.normal(size=(1, width))) * math.sqrt(shift)
    x = unit(mean + unit(draw.normal(size=(1500, width))) * math.sqrt(1 - shift))
    aside = draw.normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    near = draw.uniform(0.9501, 0.97, (len(x), 1))
    both = np.stack([x, near * x + np.sqrt(1 - near ** 2) * aside], axis=1).reshape(-1, width)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    expected = (both @ both.T >= 0.95).sum(axis=1) - 1
    found = {r["id"]: r["n_links"] for r in embedding_duplicates(df).collect()}
    assert all(found[i] <= n for i, n in enumerate(expected))
    print("recall", sum(found.values()) / expected.sum())
    assert sum(found.values()) >= 0.999 * expected.sum() and expected.sum() >= 2 * len(x)


def test_rotation_balances_codes():
    points = np.random.default_rng(1).normal(size=(2000, 16)) @ np.diag(np.linspace(0.2, 3, 16))
    mean, projection = learn_rotation(points, 16)
    turned = (points - mean) @ projection
    assert np.allclose(projection.T @ projection, np.eye(16), atol=1e-8)
    assert np.abs((turned >= 0).mean(axis=0) - 0.5).max() < 0.06
    assert turned.std(axis=0).max() / turned.std(axis=0).min() < 3


def test_vectors_of_extreme_scale(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(i, [x * scale for x in base]) for i, scale in enumerate((1.0, 1e-200, 1e200, 1e-300, 1e300))]
    rows += [(10, [-3e200, 1e200, 1e200, 1e200]), (11, [0.0, 0.0, 0.0, 1e-320])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["id"]: (r["n_links"], r["component_id"]) for r in embedding_duplicates(df).collect()}
    assert found == {**{i: (4, 0) for i in range(5)}, 10: (0, 10), 11: (0, 11)}
