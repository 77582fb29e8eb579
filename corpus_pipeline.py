"""From raw documents to packed training sequences, stage by stage.

Every stage gets (spark, docs, sf_dir) and works on all that the one before has kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import decontamination, language, lines, minhash, packing
from bitloom.llm.common import column, cut, table, unused
from bitloom.llm.queries import tokenizer_path

LEAST_SHARE = 0.5  # of a document's words that its main language must have


def _columns(docs: DataFrame) -> list:
    return [column(name) for name in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without letters or without a majority language go.

    Null texts have no letters. The model learns from all rows with a language; without any, no row
    has a language, and none stays.
    """
    names = unused(docs, "_lang_pred", "_share", "_languages")
    found = language.identify(docs, language.learn(docs), outputs=tuple(names))
    return found.where((column(names[0]) != "und") & (column(names[1]) >= LEAST_SHARE)).select(*_columns(docs))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of every group of similar lines stays; a document that loses its last line goes."""
    count, removed = unused(docs, "_n_lines", "_n_removed")
    kept = lines.dedup_lines(docs, outputs=(count, removed))
    emptied = (column(removed) > 0) & (F.regexp_replace("text", "[\\x00-\\x20]+", "") == "")
    return kept.where(~F.coalesce(emptied, F.lit(False))).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*_columns(docs))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near duplicates (five words, 0.8) stays, the one of least id.

    A document is its id and text: rows that repeat both are one document, and different texts of one id
    are different documents. A null id is near no other row and stays as often as it comes.
    """
    (node,) = unused(docs, "_node")
    named = docs.withColumn(node, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = cut(minhash.near_duplicates(named, words=5, above=4, below=5, id_column=node))
    groups = found.where("id <> component_id").select("component_id").distinct()
    grouped = found.join(groups, "component_id").select("id", "component_id").distinct()
    members = cut(grouped.join(named.select(column(node).alias("id"), "doc_id").distinct(), "id"))
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    gone = cut(members.join(first, "component_id").where(F.struct("doc_id", "id") != F.col("first")).select(
        F.col("id").alias(node), "doc_id"))
    kept = named.join(gone, [node, "doc_id"], "left_anti").select(*_columns(docs))
    if not found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        once = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
        kept = once.unionByName(kept.where("doc_id IS NULL"))
    return kept


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its own or with other values."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language", known_language), ("lines", unique_lines), ("near_duplicates", unique_documents),
          ("decontamination", no_leaks), ("packing", packed)]

# Trained models, MinHash and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each one's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
