"""From documents to packed training sequences, in five stages.

Toxic documents go, documents of bad quality go, one document of each group of near-duplicates
stays, repeated passages are cut out of what is left, and the rest is packed. Each stage works
on all rows of its predecessor; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.catalog.registry import Registry
from pulsegrid.llm import minhash, packing, quality, suffixes, toxicity
from pulsegrid.llm.common import read
from pulsegrid.plans.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows that go to a Python worker at once. Documents are wide: with Spark's 10,000 rows a batch
#: and its copies take more of an executor than the work on them.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half. Learned from all labels."""
    _small_batches(spark)
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), lexicon, to="_score")
    return scored.filter(~toxicity.is_toxic(F.col("_score"))).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules keep. The rules' votes are counted in a first pass and
    decide in the second, which carries the texts along; neither shuffles them."""
    return quality.filter_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Repeated rows are one;
    rows without an id are compared like the others, under a number made of their text that comes
    after all ids below 2^62."""
    _small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    unnamed = F.xxhash64(text).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", unnamed).alias("_id"), F.sha2(text, 256).alias("_sha"))
    once = keyed.dropDuplicates(["_id", "_sha"])
    judged = minhash.near_duplicates(keyed.select("_id", "text"), id="_id")
    kept = judged.filter("kept").select("_id").distinct()
    return once.join(kept, "_id", "left_semi").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also start earlier; n_chars follows the text."""
    _small_batches(spark)
    cut = suffixes.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    _small_batches(spark)
    return packing.pack(packing.pieces(docs.select("doc_id", "text")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeats_stage),
    ("packing", packing_stage),
]

#: Not expressible in SQL: learned lexicon, estimated accuracies, tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


Q = Registry()
Q.add("pipeline", ORACLE_SQL)(run)
