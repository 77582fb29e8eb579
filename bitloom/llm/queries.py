"""The operators as registered queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import conversations, licenses, resampling, urls
from bitloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.embeddings import embedding_duplicates

    return embedding_duplicates(table(spark, folder, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", "kept", "class_id", "copies")


def op2_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))[0].withColumnRenamed("id", "doc_id")


def op3_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.decontamination import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        F.col("id").alias("doc_id"), "item_id", "windows", "first", "same_values")


def op4_nbsvm_quality(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.language import held_out
    from bitloom.llm.quality import score_quality

    scored = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"),
                           lambda id_: ~held_out(id_, 5, 0))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.language import held_out, identify, learn

    docs = table(spark, folder, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return identify(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
        F.col("_share").alias("score"), F.col("_languages").alias("languages"))


def op6_recompression(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, folder, "documents"), with_text=False).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op7_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.lines import dedup_lines

    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.sharding import shard_documents

    return shard_documents(table(spark, folder, "documents"), shards=8).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), words=3, above=17, below=20).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    from bitloom.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_survivor_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repaired(table(spark, folder, "conversations"))


def op13_link_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_license_diagonals, op3_template_leaks, op4_nbsvm_quality, op5_language_mixture,
                              op6_recompression, op7_fuzzy_lines, op8_kd_shards, op9_minhash, op10_packing, op11_importance_resampling, op12_survivor_viterbi,
                              op13_link_propagation)}
ORACLES = {"op2_license_diagonals": licenses.oracle(), "op11_importance_resampling": resampling.oracle(),
           "op12_survivor_viterbi": conversations.oracle(), "op13_link_propagation": urls.oracle()}
