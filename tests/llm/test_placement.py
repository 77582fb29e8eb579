"""Sharding, packing and the pipeline."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm.packing import column_generation, pack, pack_documents, sequences
from bitloom.llm.queries import tokenizer_path
from bitloom.llm.sharding import shard_documents, write_shards
from tests.llm import brute
from tests.llm.conftest import SMALL


def test_shards(documents, small, edges, tmp_path):
    rows = [(d, t, lang, f"src{d % 7}", len(t)) for d, t, lang in small] + [e for e in edges if e[0] != 900_006]
    rows += [(80_000 + i, f"copy {i % 3} " * 40, None, None, None) for i in range(60)] + [(900_004, "one")]
    docs = documents(rows)
    placed = shard_documents(docs, shards=8)
    found = placed.collect()
    assert len(found) == len(rows)
    sizes = np.zeros(8)
    for s in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))
        sizes[s] = sum(r["size"] for r in found if r["shard"] == s)
    assert sizes.max() <= 1.1 * sizes.mean() and sizes.min() >= 0.9 * sizes.mean()
    text = {d: t for d, t, *_ in rows}
    for r in found:
        if r["id"] is not None:
            raw = (text[r["id"]] or "").encode()
            assert (r["size"], r["crc"]) == (len(raw) + 1, zlib.crc32(raw))
    copies = {}
    for r in found:
        if r["id"] is not None and 80_000 <= r["id"] < 80_060:
            copies.setdefault(r["crc"], set()).add(r["shard"])
    assert len(copies) == 3 and sum(len(s) for s in copies.values()) <= 4  # at most one group lies on a border
    by_target = shard_documents(docs, target_bytes=int(sizes.sum() / 3) + 1).collect()
    assert {r["shard"] for r in by_target} == {0, 1, 2}
    assert shard_documents(documents([]), shards=8).isEmpty()
    few = shard_documents(documents([(1, "a"), (2, None)]), shards=8).collect()
    assert len(few) == 2 and len({r["shard"] for r in few}) == 2
    unique = documents([r for r in rows if r[0] is not None and r[0] < 900_000])
    write_shards(unique, shard_documents(unique, shards=4), str(tmp_path / "shards"))
    again = unique.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert again.count() == unique.count() and again.select("_shard").distinct().count() == 4


@pytest.mark.parametrize("seed", range(4))
def test_column_generation(seed):
    draw = np.random.default_rng(seed)
    weights = np.unique(draw.integers(1, 65, 12))
    demand = draw.integers(1, 400, len(weights))
    plan = column_generation(weights, demand, 64)
    used = sum(times * pattern for times, pattern in plan)
    assert (used == demand).all() and all(pattern @ weights <= 64 and times > 0 for times, pattern in plan)
    bins = sum(times for times, _ in plan)
    assert bins <= np.ceil(weights @ demand / 64) + 1 + sum(demand[weights > 32]) * 0.5 + len(weights)
    assert column_generation(np.zeros(0, np.int64), np.zeros(0, np.int64), 64) == []


def test_packing(documents, small, edges):
    from tokenizers import Tokenizer

    odd = "don't WE'RE 12ab_cd naïve İstanbul ΑΣ ½²Ⅷ z\x1cz\x85z é <|endoftext|> <| a''ll"
    rows = [(d, t) for d, t, _ in small[:80]] + edges + [(90_000, odd), (900_004, "one")]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in rows if d is not None}
    found = pack_documents(documents(rows), tokenizer_path(), capacity=256).collect()
    tokens = {}
    for r in found:
        if r["doc_id"] is not None:
            part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert r["doc_tokens"] == len(ids[r["doc_id"]])
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert all(tokens[d] == len(x) * (2 if d == 900_004 else 1) for d, x in ids.items())
    filled = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 256
    assert sum(filled.values()) >= 0.9 * 256 * len(filled)
    assert pack_documents(documents([]), tokenizer_path()).isEmpty()
    whole = sequences(documents(rows[:30]), tokenizer_path(), capacity=256).collect()
    assert all(len(r["ids"]) == 256 and not any(r["ids"][r["used"]:]) for r in whole)
    assert sum(r["used"] for r in whole) == sum(len(ids[d]) for d, _ in rows[:30])


def test_short_pieces_leave_little_padding(spark):
    """A third of the pieces is empty or a few tokens long, as is every piece of a second table."""
    draw = np.random.default_rng(3)
    short = [1] * 3000 + draw.integers(2, 40, 1000).tolist() + [17] * 1500
    for lengths in (short + draw.integers(41, 4097, 9000).tolist(), short, [1] * 5000, [17] * 1000):
        parts = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long")
        found = pack(parts).collect()
        assert sorted((r["doc_id"], r["length"]) for r in found) == list(enumerate(lengths))
        filled = {}
        for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
            assert filled.get(r["sequence_id"], 0) == r["offset"]
            filled[r["sequence_id"]] = r["offset"] + r["length"]
        assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 4096
        print("fill", len(lengths), sum(lengths) / (4096 * len(filled)), "in", len(filled))
        assert len(filled) <= 1.02 * sum(lengths) / 4096 + 2


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(None, None, None, None, None), (990_001, "", "en", "s", 0), (990_002, "12 !!", "en", "s", 5),
             (990_003, docs.first()["text"], "en", "s", 1), (None, "The and of a the of and", "en", None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, tables[-1], SMALL).write.parquet(path)
        tables.append(spark.read.parquet(path))
    start, spoken, lined, single, clean, packed = (t.collect() for t in tables)
    assert all(t.columns == columns for t in tables[:-1])
    texts = [{r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None} for rows in (start, spoken, lined, single, clean)]
    assert not {990_001, 990_002} & texts[1].keys() and len(texts[1]) >= len(texts[0]) - 8

    lines = brute.unique_lines(texts[1])
    kept = {d: t for d, (t, gone) in lines.items() if not gone or t.split()}
    assert texts[2] == kept and all(r["n_chars"] == len(r["text"]) for r in lined)

    near = brute.near_duplicates(texts[2], 5, 4, 5)
    assert set(texts[3]) == {d for d, (_, component) in near.items() if d == component}

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    assert set(texts[4]) == set(texts[3]) - {d for d, _ in brute.leaks(texts[3], items)}

    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}
    ends = {}
    for r in packed:
        ends[r["doc_id"]] = ends.get(r["doc_id"], 0) + r["length"]
    assert all(ends[r["doc_id"]] == r["doc_tokens"] for r in packed if r["doc_id"] is not None)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.isEmpty() and "sequence_id" in docs.columns


def test_pipeline_tells_documents_of_one_id_apart(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    near = " ".join(f"alpha{i} beta{i % 7}" for i in range(80))
    clean = " ".join(f"gamma{i} delta{i % 5}" for i in range(80))
    rows = [(1, near), (2, near + " end"), (2, clean), (None, near), (None, near), (None, near), (7, "seven"), (7, "seven"), (3, None), (3, None)]
    table = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], docs.schema)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.unique_documents(spark, table, SMALL).collect()), key=str)
    assert kept == sorted([(1, near), (2, clean), (None, near), (None, near), (None, near), (7, "seven"), (3, None)], key=str)
    apart = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows[:6] if (d, t) != (2, clean)], docs.schema)
    assert corpus_pipeline.unique_documents(spark, apart, SMALL).count() == 4  # null ids stay as often as they come


def test_pipeline_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    extra = ["_n_lines", "_n_removed", "_lang_pred", "_share", "_languages", "_node", "__row", "__text"]
    for name in extra:
        docs = docs.withColumn(name, F.lit("mine"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == names
    kept = docs.select(*extra).distinct().collect()
    assert [tuple(r) for r in kept] == [("mine",) * len(extra)]


def test_shards_follow_whole_metadata(spark):
    rows = [(i, f"text {i} " * 20, "en", f"https://{'ab'[i % 2]}.org/a/long/common/path", 10) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = shard_documents(docs, shards=2).collect()
    sides = {s: {r["id"] % 2 for r in placed if r["shard"] == s} for s in (0, 1)}
    assert sorted(map(len, sides.values())) == [1, 1] or sum(len({r["id"] % 2 for r in placed if r["shard"] == s}) for s in (0, 1)) <= 3
    sizes = [sum(r["size"] for r in placed if r["shard"] == s) for s in (0, 1)]
    assert abs(sizes[0] - sizes[1]) < 400


def test_ids_of_words_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    from bitloom.llm import packing
    from bitloom.llm.common import Features

    path = tokenizer_path()
    whole, features = Tokenizer.from_file(path), Features(packing._Encoder(path), 10)
    for text in ["it's DON'T 12,5 ½ a² ªº", "İstanbul a\x1cb x\x85y p\xa0q so\xadft", "a<|b </w> c</w>d", "日本語 café é naïve—ok",
                 "ß ẞ ŉ ​ ﻿x", "", " ", "word " * 2500 + " ".join(f"w{k}x" for k in range(2500))]:
        chunks, _ = features.numbers([text.encode()])
        assert features.of(chunks).tolist() == whole.encode(text, add_special_tokens=False).ids
