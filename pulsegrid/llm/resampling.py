"""Quality by importance resampling.

Two generative models over hashed word n-grams (one and two words), one of target text and one
of the raw corpus, give each document a log importance weight: the log ratio of its likelihoods
under the two, summed over all its n-grams. Gumbel noise seeded by the row key is added and the
top k keys are a sample without replacement in proportion to the weights. ``weigh`` can temper
the weight of long texts on request (``evidence``); by default it does not.

The raw model counts all documents. The target model counts a bounded sample of at most
``TARGET_DOCS`` labelled good documents, chosen by a hash of the id.

Null and empty texts have no n-grams and weight 0. Equal keys (repeated ids) are ranked by the
range sort, each row on its own. Without target rows all weights are 0, a plain random sample.
An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import mix, ngrams, slices, sorted_sample, texts_of, words
from pulsegrid.plans.ordering import with_position

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
KEEP_SHARE = 0.85
_U = np.uint64


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every one- and two-word gram of the texts and the index of its text."""
    h, bounds = words(texts, lower=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pair = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    two = mix(h[:-1] * _U(3) + h[1:])[pair] if len(h) > 1 else h[:0]
    bucket = np.concatenate([h, two]) >> _U(50)
    return bucket.astype(np.int64), np.concatenate([owner, owner[1:][pair] if len(owner) else owner])


def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """n-grams per bucket over all documents. Each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                total += np.bincount(grams(texts_of(part, text))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    summed = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models per bucket, both smoothed towards the raw model."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    base = (raw + 1.0) / (raw.sum() + BUCKETS)
    t = (target + 200.0 * base * BUCKETS / 1000.0) / (target.sum() + 200.0 * BUCKETS / 1000.0)
    return np.log(t) - np.log(base)


def target_rows(docs: DataFrame, labels: DataFrame, seed: int = 5) -> DataFrame:
    """A bounded sample of the documents labelled good."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = sorted_sample(good.withColumn("_all", F.lit(0)), ["_all"], TARGET_DOCS, seed).select("doc_id")
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")  # at most TARGET_DOCS ids


def weigh(
    docs: DataFrame, ratio: np.ndarray, id: str = "doc_id", text: str = "text", evidence: int | None = None
) -> DataFrame:
    """One row per document: id, n_grams, log_weight. With ``evidence`` a text of more n-grams
    weighs as if it had that many, at the mean log ratio of all of them."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                bucket, owner = grams(texts_of(part, text))
                n = np.bincount(owner, minlength=part.num_rows)
                s = np.bincount(owner, weights=sent.value[bucket], minlength=part.num_rows)
                w = s if evidence is None else s / np.maximum(n, 1) * np.minimum(n, evidence)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id), pa.array(n, pa.int64()), pa.array(w, pa.float64())], [id, "n_grams", "log_weight"]
                )

    return docs.select(id, text).mapInArrow(run, f"{id} {kind}, n_grams long, log_weight double")


def gumbel(id: str = "doc_id", seed: int = 1) -> Column:
    """Standard Gumbel noise that depends on the id and the seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(2.0**52)
    return -F.log(-F.log(u))


def resample(weighed: DataFrame, share: float = KEEP_SHARE, id: str = "doc_id", seed: int = 1) -> DataFrame:
    """Add ``gumbel_key``, its rank from the top (``sample_rank``, from 0) and ``selected``:
    the top ``share`` of all rows, rounded up."""
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(id, seed))
    ranked = with_position(
        keyed.withColumn("_down", -F.col("gumbel_key")), [], ["_down", id], "sample_rank", "_total"
    )
    k = F.ceil(F.col("_total") * F.lit(share))
    return ranked.withColumn("selected", F.col("sample_rank") < k).drop("_down", "_total")
