"""License scan by diagonal voting, in DataFrame functions only.

All rolling word 3-grams of the documents are joined to the positions of license templates. Hits vote
for diagonals (document position minus template position); neighbouring diagonals are merged, so that
a few inserted or missing words do no harm; spans that cover enough of a template are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.llm.common import column, cut, prepare

GRAM = 3

# The base phrases, whose labels need every word in place.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The opening sentences of public license texts, found also with some words changed.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with "
    "the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
DRIFT = 2  # diagonals this near belong together
COVERED = 0.6  # part of a template's 3-grams that a span must hold
STRETCH = 1.5  # times its template's length that a span may have


def words(text: Column) -> Column:
    """Lower-case (A-Z) words of ASCII letters and digits and anything beyond ASCII."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def template_rows(base: dict[str, str], texts: dict[str, str]) -> list[tuple]:
    """(template, label, is_base, grams, length, tpos, t0, t1, t2) for every 3-gram of every template."""
    rows = []
    for number, (phrase, label, is_base) in enumerate(
            [(p, lab, True) for p, lab in base.items()] + [(p, lab, False) for p, lab in texts.items()]):
        w = phrase.split()
        if len(w) < GRAM:
            raise ValueError(f"a template needs {GRAM} words at least: {phrase}")
        rows += [(number, label, is_base, len(w) - GRAM + 1, len(w), k, *w[k:k + GRAM]) for k in range(len(w) - GRAM + 1)]
    return rows


def templates(spark: SparkSession, base: dict[str, str], texts: dict[str, str]) -> DataFrame:
    def cell(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    rows = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in template_rows(base, texts))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, is_base, grams, length, tpos, t0, t1, t2)")


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, texts: dict[str, str] | None = None,
                  id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their labels, and the verified spans behind them.

    First frame, a row per document row: id, n_words, n_base (places of base phrases), first_word,
    last_word (their least and greatest start; null without any), base_labels, labels (distinct,
    sorted, comma-joined; empty without any), score (largest covered part of a template, 0 to 1).
    Second frame: id, template, label, is_base, start, end (words), covered. A null text has no words; null and
    repeated ids keep a row each, rows that agree in id and text the same one. Templates have three
    words at least and are as few as the caller lists, so Spark may broadcast them by their size. An
    empty table gives no rows; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    known = templates(spark, BASE if base is None else base, TEXTS if texts is None else texts)
    listed = docs.select(column(id_column).cast("long").alias("id"), column(text_column).cast("string").alias("text")).select(
        "id", F.xxhash64("id", "text").alias("k"), words(F.col("text")).alias("w"))
    grams = listed.select("id", "k", F.posexplode(F.arrays_zip(
        F.col("w").alias("w0"), F.slice("w", F.lit(2), F.size("w")).alias("w1"), F.slice("w", F.lit(3), F.size("w")).alias("w2")))).select(
        "id", "k", "pos", "col.*")
    hits = grams.join(known, F.xxhash64("w0", "w1", "w2") == F.xxhash64("t0", "t1", "t2")).where(
        "w0 = t0 AND w1 = t1 AND w2 = t2")
    # written, as several steps below read the few hits, and each would scan all words again
    diagonals = cut(hits.groupBy("id", "k", "template", "label", "is_base", "grams", "length", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high")))
    # "k" stands for id and text, so a null id needs no special care here
    beside = Window.partitionBy("k", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(beside) > DRIFT
    banded = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "band", F.sum("new").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    exact = banded.select("id", "k", "template", "label", "is_base", F.col("diagonal").alias("start"),
                          (F.col("diagonal") + F.col("length")).alias("end"),
                          (F.size("places") / F.col("grams")).alias("covered")).where("is_base AND covered = 1")
    merged = banded.groupBy("id", "k", "template", "label", "is_base", "grams", "length", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("low"),
        F.max("high").alias("high")).select(
        "id", "k", "template", "label", "is_base", F.col("low").alias("start"), (F.col("high") + GRAM).alias("end"),
        (F.size("places") / F.col("grams")).alias("covered"), "length")
    spans = cut(exact.unionByName(merged.where(
        f"NOT is_base AND covered >= {COVERED} AND end - start <= {STRETCH} * length").drop("length")))
    partly = merged.where(f"NOT is_base AND end - start <= {STRETCH} * length")
    best = exact.select("k", "covered").unionByName(partly.select("k", "covered")).groupBy("k").agg(F.max("covered").alias("score"))
    found = spans.groupBy("k").agg(
        F.count_if("is_base").alias("n_base"), F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    facts = best.join(found, "k", "left")
    result = listed.select("id", "k", F.size("w").cast("long").alias("n_words")).join(facts, "k", "left").select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
    return result, spans.drop("k")


def oracle() -> str:
    """The same as SQL text for DuckDB over the table ``documents``."""
    def cell(x) -> str:
        return "'" + x + "'" if isinstance(x, str) else str(x)

    rows = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in template_rows(BASE, TEXTS))
    return f"""
WITH t(template, label, is_base, grams, length, tpos, t0, t1, t2) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, w[i] AS w0, w[i + 1] AS w1, w[i + 2] AS w2, i - 1 AS pos
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) u),
h AS (SELECT doc_id, template, label, is_base, grams, length, pos - tpos AS diagonal, tpos, pos
  FROM g JOIN t ON w0 = t0 AND w1 = t1 AND w2 = t2),
diag AS (SELECT doc_id, template, label, is_base, grams, length, diagonal, list(DISTINCT tpos) AS places,
  min(pos) AS low, max(pos) AS high FROM h GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal)
  <= {DRIFT} THEN 0 ELSE 1 END AS fresh FROM diag),
banded AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal
  ROWS UNBOUNDED PRECEDING) AS band FROM marked),
exact AS (SELECT doc_id, label, is_base, diagonal AS start, len(places) / grams AS covered FROM banded
  WHERE is_base AND len(places) = grams),
merged AS (SELECT doc_id, label, is_base, min(low) AS start, max(high) + {GRAM} AS stop, length,
  len(list_distinct(flatten(list(places)))) / grams AS covered FROM banded
  GROUP BY doc_id, template, label, is_base, grams, length, band),
fuzzy AS (SELECT doc_id, label, is_base, start, covered FROM merged
  WHERE NOT is_base AND stop - start <= {STRETCH} * length),
every AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy),
facts AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word,
  max(start) FILTER (is_base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (covered >= {COVERED})), ',') AS labels,
  max(covered) AS score FROM every GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN facts USING (doc_id)"""
