"""The operators' queries, with production parameters, over whole tables; and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_files, bpe, centroids, common, compression_quality, deleted_interpolation, jaccard_join, media_jpeg, oracle, packing, quality_rules, quote_links, secrets, toxicity, vector_codes

#: A public vocabulary by its name; ``public_tokenizers.path`` finds the file on each executor.
TOKENIZER = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = compression_quality.quality_model(docs, labels, common.fold(F.col("_id"), 5) != 0)
    return compression_quality.score(docs, model).select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(common.table(spark, sf_dir, "documents"))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.digests(media_jpeg.encode_column(common.table(spark, sf_dir, "documents")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(common.table(spark, sf_dir, "documents")))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(common.table(spark, sf_dir, "conversations"))


def rendered_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixth operator over replies rendered from the conversations, as these hold no quotations themselves."""
    return quote_links.link_quotes(quote_links.rendered_replies(common.table(spark, sf_dir, "conversations")))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.language_scores(common.table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.bpe_counts(common.table(spark, sf_dir, "documents"), TOKENIZER))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), TOKENIZER)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.toxicity_model(docs, labels, common.fold(F.col("_id"), 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op11_heap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(common.table(spark, sf_dir, "embeddings"))


def op12_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return arrow_files.digests(arrow_files.token_files(docs, TOKENIZER), docs.schema["doc_id"].dataType.simpleString())


def op13_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digests(common.table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_compression_quality": op2_compression_quality,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_progressive_jpeg": op4_progressive_jpeg,
        "op5_secret_scan": op5_secret_scan,
        "op6_quote_links": op6_quote_links,
        "rendered_quote_links": rendered_quote_links,
        "op7_deleted_interpolation": op7_deleted_interpolation,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_toxicity": op10_toxicity,
        "op11_heap_codes": op11_heap_codes,
        "op12_arrow_files": op12_arrow_files,
        "op13_drake_clusters": op13_drake_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
