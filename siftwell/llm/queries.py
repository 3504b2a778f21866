"""The registered queries of this subpackage, thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier, toxicity
from .decontamination import leaked_items
from .html_extract import main_text
from .media import text_videos, video_facts
from .mixing import mix_by_quality
from .near_dedup import near_duplicates
from .oracles import ORACLES as ORACLES
from .prefix_trie import conversation_trie
from .quality_rules import quality_rules
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import document_token_counts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept_bytes"), 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "n_equal")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_by_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken", "epochs", "drawn")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= quality_classifier.THRESHOLD).cast("int"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = text_videos(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    f = video_facts(stored)
    shots = F.format_string("%d frames in %d shots, the longest of %d; clips %s", "facts.n_frames", F.size("facts.clips"), F.array_max("facts.clips.n_frames"), F.sha2(F.to_json("facts.clips"), 256))
    return f.select("doc_id", "n_bytes", F.col("facts.n_samples").alias("payload_bytes"), F.col("facts.samples_sha256").alias("payload_sha256"), "facts.tail_crc32", "media_bytes", "media_sha256", shots.alias("feature"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_source_mixing": op7_source_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_media_columns": op12_media_columns,
    "op13_conversation_trie": op13_conversation_trie,
}

