"""The operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.catalog.registry import Registry
from pulsegrid.llm import (
    audit,
    langid,
    merkle,
    minhash,
    packing,
    pstable,
    quality,
    resampling,
    segmentations,
    sql,
    substrings,
    suffixes,
    token_counts,
    toxicity,
)
from pulsegrid.llm.common import bucket_of, read
from pulsegrid.plans.staging import stage

Q = Registry()


@Q.add("op1_sampled_segmentations")
def op1_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, and whether they decode to it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ways = segmentations.encode_samples(docs, decoded=True)
    return ways.select(
        "doc_id",
        "sample",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.xxhash64("decoded").alias("decoded_hash"),
        "log_prob",
        "log_inclusion",
    )


@Q.add("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from labels outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(bucket_of("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", toxicity.is_toxic(F.col("score")).cast("int").alias("predicted")
    )


@Q.add("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents")))


@Q.add("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside strings of 100 bytes that also start earlier."""
    cut = suffixes.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.drop("text")


@Q.add("op5_importance_resampling")
def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document and whether the sample has it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    target = resampling.target_rows(docs, read(spark, sf_dir, "labels"))
    ratio = resampling.log_ratio(resampling.gram_counts(target), resampling.gram_counts(docs))
    return resampling.resample(resampling.weigh(docs, ratio))


@Q.add("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of a label, and their components."""
    return pstable.near_duplicates(read(spark, sf_dir, "embeddings"))


@Q.add("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(bucket_of("doc_id", 4) != 2))
    held_out = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@Q.add("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document under the piece model."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs)
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@Q.add("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document (five words, weighted similarity 0.8)."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@Q.add("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the weighted rules."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    voted = stage(quality.votes(quality.measures(docs)), "quality-votes")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return quality.judge(voted).select("doc_id", *base, "kept", "quality")


@Q.add("op11_substring_dedup", sql.SUBSTRING_DEDUP)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside windows of 13 words that a smaller id also has."""
    cut = substrings.remove_repeated(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@Q.add("op12_filter_audit", sql.FILTER_AUDIT)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove per source, in every order of applying them."""
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@Q.add("op13_merkle_manifest", sql.MERKLE_MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in a tree per language; some rows are verified after tampering."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.coalesce(bucket_of("doc_id", 7) == 0, F.lit(False))
    return merkle.manifest(merkle.document_leaves(docs, tampered)).withColumnRenamed("id", "doc_id")
