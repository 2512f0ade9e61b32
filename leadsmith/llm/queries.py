"""The registered queries of this subpackage: one per operator, applied to the
whole table with production parameters, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsmith.llm import quality_mil, toxicity
from leadsmith.llm.bpe import encode_documents
from leadsmith.llm.collocations import collocations
from leadsmith.llm.common import crc_of_id, table
from leadsmith.llm.decontaminate import contamination
from leadsmith.llm.fingerprints import contained_share, edited_pairs, edited_text, sketch_string, with_scaled_sketch
from leadsmith.llm.html_mincut import extract
from leadsmith.llm.license_scan import scan_licenses
from leadsmith.llm.packing import pack_documents
from leadsmith.llm.resampling import importance_resample
from leadsmith.llm.simhash import hex_digits, near_duplicates
from leadsmith.llm.sharding import shard_rows
from leadsmith.llm.suffix_dedup import remove_repeats

#: The rank file and pattern of the encoding query; parameters of the operator.
BPE_RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary of the packing query.
PACK_VOCABULARY = "byte_bpe_50k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def usable_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """Labels outside the held-out fold, as ``(id, label)``."""
    return (labels.where(F.pmod(crc_of_id("doc_id"), F.lit(folds)) != held_out)
            .select(F.col("doc_id").alias("id"), F.col(label).cast("long").alias("label")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, usable_labels(table(spark, sf_dir, "labels"), "toxic", 3, 1))
    return (toxicity.score(docs, model)
            .select("doc_id", (F.pmod(crc_of_id("doc_id"), F.lit(3)) == 1).alias("held_out"), "score", "predicted"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_distance=3)
    return out.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), min_length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents"), sketch=with_scaled_sketch)
    pairs = with_scaled_sketch(pairs.withColumn("edited", edited_text("text", "next_text")), "edited", "edited_sketch")
    none_seen = F.lit(0.0)
    return pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        sketch_string("sketch").alias("fingerprint"),
                        sketch_string("edited_sketch").alias("edited_fingerprint"),
                        contained_share("sketch", "edited_sketch", none_seen).alias("near_edited"),
                        contained_share("sketch", "next_sketch", none_seen).alias("near_next"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_mil.fit(docs, usable_labels(table(spark, sf_dir, "labels"), "quality", 4, 2))
    return (quality_mil.score(docs, model)
            .select("doc_id", (F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2).alias("held_out"),
                    F.col("__score").alias("score"), F.col("__predicted").alias("predicted")))


def bpe_vocabulary() -> tuple[str, str]:
    """Path of the rank file (installed on every worker) and the splitting pattern."""
    import public_tokenizers
    return public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), *bpe_vocabulary())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_toxicity, op3_licenses, op4_simhash, op5_suffix_dedup, op6_fingerprints, op7_quality, op8_bpe,
    op9_html, op10_decontamination, op11_resampling, op12_collocations, op13_packing)}
