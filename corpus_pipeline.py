"""The corpus pipeline: quality filter, near-duplicates, repeated passages,
benchmark passages, byte-level BPE encoding. Every stage calls one operator of
``leadsmith.llm`` and works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsmith.llm import quality_mil
from leadsmith.llm.bpe import encode_documents
from leadsmith.llm.common import row_key, small_batches, stored, table
from leadsmith.llm.decontaminate import contamination
from leadsmith.llm.queries import bpe_vocabulary, usable_labels
from leadsmith.llm.simhash import near_duplicates
from leadsmith.llm.suffix_dedup import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns in one: whatever they are called,
    they meet no column of an operator."""
    small_batches(docs.sparkSession)
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias("__no_text")).alias("__others"))


def _unpacked(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return df.select(*((changed[c] if c in changed else F.col(c) if c in ("doc_id", "text") else
                        F.col("__others").getField(c)).alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with quality 0 predicted go."""
    model = quality_mil.fit(docs, usable_labels(table(spark, sf_dir, "labels"), "quality", 4, 2))
    scored = quality_mil.score(_packed(docs), model, carry=("text", "__others"))
    return _unpacked(scored.where(F.col("__predicted") == 1), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by fingerprints of 3-word shingles that
    differ in at most 3 bits, the one with the smallest id stays. Rows that share
    that id stay together; a group without any id stays whole."""
    found = near_duplicates(docs, shingle_words=3, max_distance=3)
    # Only the keys of the rows to drop are joined.
    gone = (found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key")).distinct())
    packed = _packed(docs).withColumn("__key", row_key("doc_id", "text"))
    return _unpacked(packed.join(gone, (F.col("__key") == F.col("g_key")) & F.col("doc_id").eqNullSafe(F.col("g_id")),
                                 "left_anti"), docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier too are cut out; n_chars
    follows. A document that loses all its text stays, empty."""
    found = remove_repeats(_packed(docs), min_length=100, carry=("__others",), with_text=True)
    changed = {"text": F.when(~F.col("__others.__no_text"), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(F.col("__others.n_chars"))
    return _unpacked(found, docs, **changed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    found = contamination(_packed(docs), table(spark, sf_dir, "benchmark"), carry=("text", "__others"))
    return _unpacked(found.where(~F.col("contaminated")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its text and the digest of their decoding."""
    small_batches(spark)
    path, pattern = bpe_vocabulary()
    return encode_documents(docs, path, pattern, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", encode),
]

#: No SQL: the stages fit a classifier, take 64-bit hashes and merge byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline", name.replace(" ", "_"))
    return docs
