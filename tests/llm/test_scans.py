"""License scan, decontamination, classifiers."""

import functools
import re
import zlib

import duckdb
import numpy as np

from bitloom.llm import language, quality
from bitloom.llm.common import gram_numbers
from bitloom.llm.decontamination import decontaminate, find_leaks
from bitloom.llm.licenses import BASE, TEXTS, oracle, scan_licenses
from bitloom.llm.queries import op4_nbsvm_quality, op5_language_mixture
from tests.llm import brute
from tests.llm.conftest import SMALL


def test_licenses(documents, small, edges):
    gpl = next(t for t, label in TEXTS.items() if label == "gpl")
    inserted = gpl.replace("redistribute it", "freely redistribute it", 1)
    rows = [(d, t) for d, t, _ in small] + edges + [
        (40_000, "Under the MIT license, under the mit-license! CC by-NC"), (40_001, f"So: {inserted.title()}."),
        (40_002, gpl[:60]), (40_003, "under the mit"), (40_004, "cc by nc " * 500), (40_004, "cc by nc " * 500)]
    found, spans = scan_licenses(documents(rows))
    rows_found = found.collect()
    assert len(rows_found) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault((d, None if t is None else len(t)), t)
    by_id = {d: t for d, t in rows if d is not None}
    for r in rows_found:
        if r["id"] is None:
            continue
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), by_id[r["id"]] or ""))
        places = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places)), r
        assert r["first_word"] == min((i for i, _ in places), default=None)
        assert r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    named = {r["id"]: r for r in rows_found}
    assert named[40_001]["labels"] == "gpl" and named[40_001]["score"] > 0.8 and named[40_001]["n_base"] == 0
    assert named[40_002]["labels"] == "" and 0 < named[40_002]["score"] < 0.6
    assert named[40_003]["labels"] == "" and named[40_004]["n_base"] == 500
    assert spans.where("id = 40000").count() == 3
    assert scan_licenses(documents([]))[0].isEmpty()


def test_license_words_are_exploded_once(documents):
    found, spans = scan_licenses(documents([(1, "under the MIT license")]))
    for frame in (found, spans):
        assert "explode(" not in frame._jdf.queryExecution().executedPlan().toString()


def test_license_sql_agrees(spark, documents, small):
    rows = [(d, t) for d, t, _ in small] + [(50_000 + i, t[: len(t) * (i % 3 + 3) // 5]) for i, t in enumerate([*BASE, *TEXTS])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = scan_licenses(documents(rows))[0].collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(oracle()).fetchall())


ITEMS = [(1, "A train leaves Boston at 7 am and travels 60 miles per hour towards the town of Salem until it meets another train"),
         (2, "If Anna has 12 apples and gives 12 pears to Bert then how many fruits does Anna have left in the basket"),
         (3, "Short question about five words"), (4, "3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (5, None), (None, "a null id holds this rather long text "
          "of more than thirteen words so that it can be found"),
         (6, "Short question about five words")]


def test_leaks(spark, documents, small, edges):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, row string")
    changed = ITEMS[1][1].replace("12", "30").replace("Anna", "Carla").replace("Bert", "Dan")
    broken = ITEMS[1][1].replace("12", "30", 1).replace("Anna", "Carla", 1)
    rows = [(d, t) for d, t, _ in small[:100]] + edges + [
        (60_000, f"noise before. {ITEMS[0][1]} noise after"), (60_001, f"x y z {changed} more"), (60_002, f"x y z {broken} more"),
        (60_003, ITEMS[0][1].lower().replace("60", "75").replace("miles", "km")), (60_004, ITEMS[2][1]),
        (60_005, "intro " + ITEMS[2][1]), (60_006, "21 22 23 24 25 26 27 28 29 30 31 32 33 34"), (60_007, ITEMS[5][1]), (60_007, ITEMS[5][1])]
    docs = documents(rows)
    found = find_leaks(docs, benchmark)
    pairs = {(r["id"], r["item_id"]) for r in found.collect()}
    assert pairs == {(60_000, 1), (60_001, 2), (60_002, 2), (60_003, 1), (60_004, 3), (60_005, 3), (60_007, None)}
    windows = {r["id"]: r["windows"] for r in found.collect()}
    assert windows[60_002] < windows[60_001] == 10  # windows with both 30 and 12, or both names, do not count
    assert {r["id"]: r["same_values"] for r in found.collect()}[60_001] is False
    other = find_leaks(docs, benchmark, hashes_sent=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, other.collect()))
    left = decontaminate(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(rows) - 8
    assert find_leaks(documents([]), benchmark).isEmpty() and find_leaks(docs, benchmark.limit(0)).isEmpty()
    assert decontaminate(docs, benchmark.limit(0)).count() == len(rows)


def test_exact_copies_of_any_item_leak(spark, documents):
    """Short items, numbers, and passages of scripts without spaces."""
    items = {1: "What is 17 + 25?", 2: "3 4 5 6 7 8 9 10 11 12 13 14 15 16", 3: "Solve x", 4: "中国的首都是哪里", 5: "ประเทศไทย",
             6: "3.5 7.25 | 9 10 | 11 12 | 13 14 | 15 16 | 17 18 Total", 7: "東京タワーの高さは何メートルですか。答えを書いてください", 8: "x", 9: "?!"}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(100 + i, f"before {t} after") for i, t in items.items() if i != 9]
    rows += [(200 + i, f"前{t}後" if i == 7 else f"这是{t}呢" if i == 4 else t.upper()) for i, t in items.items()]
    rows += [(301, "What is 18 + 25?"), (302, "4 5 6 7 8 9 10 11 12 13 14 15 16 17"), (303, "Solve y"), (304, "中国的首都是"),
             (305, "17 25"), (306, "none of this")]
    docs = documents(rows)
    expected = {(base + i, i) for base in (100, 200) for i in items if i != 9} | {(103, 8), (203, 8)}
    expected.add((302, 2))  # it shares 13 numbers in a row with the item
    for sent in (2_000_000, 0):
        found = find_leaks(docs, benchmark, hashes_sent=sent).collect()
        assert {(r["id"], r["item_id"]) for r in found} == expected
        assert all(r["same_values"] for r in found)
    assert {r["doc_id"] for r in decontaminate(docs, benchmark).collect()} >= {209, 301, 303, 304, 305, 306}


def test_leaks_in_the_table(spark, small):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    found = find_leaks(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert {(r["id"], r["item_id"]) for r in found.collect()} == brute.leaks({d: t for d, t, _ in small}, items)


def test_language_table(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = op5_language_mixture(spark, SMALL).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_mixture(documents, edges, small):
    by_lang = {}
    for _, t, lang in small:
        by_lang.setdefault(lang, []).append(" ".join(t.split()[:150]))
    model = language.learn(documents([(i, t, lang) for i, (_, t, lang) in enumerate(small)] + [(None, "x", None), (1, None, "en")]))
    assert model.languages == sorted(by_lang)
    mixed = [(70_000, f"{by_lang['en'][0]} {by_lang['en'][1]} {by_lang['de'][0]}"), (70_001, "1234 ² !! 56"), (70_002, None), (70_002, None)]
    docs = documents(mixed + edges)
    found = language.identify(docs, model)
    assert found.columns == [*docs.columns, "_lang_pred", "_share", "_languages"]
    clashing = docs.select("*", docs["lang"].alias("_lang_pred"))
    assert language.identify(clashing, model).columns == found.columns
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(mixed) + len(edges)
    assert rows[70_000]["_lang_pred"] == "en" and rows[70_000]["_languages"] == 2
    assert 0.5 < rows[70_000]["_share"] < 0.85
    for i in (70_001, 70_002, 900_001, 900_002, 900_003):
        assert (rows[i]["_lang_pred"], rows[i]["_share"]) == ("und", 0.0)
    empty = language.learn(documents([]))
    assert {r["_lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(documents([]), model).isEmpty()


def test_grams_are_all_counted(documents, small):
    docs = documents([(i, t, lang) for i, (_, t, lang) in enumerate(small[:20])])
    found = {(r["lang"], r["gram"]): r["n"] for r in language.count_grams(docs).collect()}
    @functools.cache
    def number(gram):  # of its own order: the last number of the gram as a word
        return int(gram_numbers([gram], [0], 1, language.BUCKETS, tuple(range(1, len(gram) + 1)))[0][-1])

    expected = {}
    for _, text, lang in small[:20]:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"^{word}$"
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    key = (lang, number(padded[i:i + n]))
                    expected[key] = expected.get(key, 0) + 1
    assert found == expected


def test_quality_table(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = op4_nbsvm_quality(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_quality_edges(spark, documents, edges):
    good = [(i, f"Some plain sentence with number {i} in it, and then another one.") for i in range(40)]
    bad = [(100 + i, f"BUY NOW!!! {i} $$$ BUY NOW!!!") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, "x") for i, _ in good] + [(i, 0, "x") for i, _ in bad] + [(3, None, "x"), (None, 1, "x"), (900_001, 1, "x")],
                                   "doc_id long, quality int, text string")
    docs = documents(good + bad + edges + [(500, "BUY NOW!!! $$$"), (501, "A plain sentence, and then another one.")])
    scored = {r["id"]: r["score"] for r in quality.score_quality(docs, labels, lambda i: i.isNotNull()).collect()}
    assert scored[500] < 0.3 < 0.7 < scored[501] and all(0 <= s <= 1 for s in scored.values())
    one = quality.score_quality(docs, labels.where("quality = 1"), lambda i: i.isNotNull()).collect()
    assert len({round(r["score"], 9) for r in one}) == 1 and one[0]["score"] > 0.9
    none = quality.score_quality(docs, labels.limit(0), lambda i: i.isNotNull()).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(documents([]), labels, lambda i: i.isNotNull()).isEmpty()


def test_dual_descent_reaches_the_optimum():
    draw = np.random.default_rng(2)
    rows = [np.unique(draw.integers(0, 12, 5)) for _ in range(60)]
    labels = np.array([int(0 in r or 1 in r) for r in rows])
    scale = np.linspace(0.5, 2, 12)
    w, b = quality.dual_descent(rows, labels, scale, epochs=400)
    x = np.zeros((60, 12))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
    y = np.where(labels == 1, 1.0, -1.0)
    c = (len(rows) / (2.0 * np.array([(labels == 0).sum(), (labels == 1).sum()])))[labels]

    def objective(v):
        return 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))).sum()

    best = objective(np.append(w, b))
    assert all(objective(np.append(w, b) + draw.normal(size=13) * s) >= best - 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_shape_of_a_whole_chunk():
    from bitloom.llm.quality import _shape

    assert _shape("x" * 100 + "9!!!!?") == "a9!!?" and _shape("ab" * 40 + "CD7") == "aA9"
