"""Helpers shared by the document operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of one Arrow batch are worked on in slices of about this many characters, so that
# the arrays of one slice stay small whatever the batch holds. One text is never split.
SLICE_CHARS = 2_000_000


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(c.cast("string").cast("binary")) % n).cast("int")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the length of its texts."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """Texts of a slice; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


# --- 64-bit hashing on arrays -----------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers strictly between 0 and 1 that depend on the keys alone."""
    h = np.zeros(1, np.uint64)
    for k in keys:
        h = mix(h * _U(0x9E3779B97F4A7C15) + np.asarray(k).astype(np.uint64) + _U(0x632BE59BD9B4E019))
    return (h >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[key] = have = out
    return have[:n]


_INV = _U(pow(int(_BASE), -1, 2**64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] = sum of table[data[t]] * base**t for t in [i, j)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for arrays of starts and ends; equal bytes, equal hash."""
    back = powers(len(prefix), _INV)[start]
    return mix((prefix[end] - prefix[start]) * back + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: Sequence[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, in order, and for each text the
    number of words before it (one entry more than texts)."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    if len(start) > len(end):
        end = np.append(end, len(data))
    hashes = span_hash(prefix_hash(data), start, end)
    sizes = np.fromiter((len(x.encode("utf-8", "surrogatepass")) + 1 for x in texts), np.int64, len(texts))
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, bounds


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words inside each text, and their bounds. A text of fewer
    than n words, but at least one, has one window: all of it."""
    count = np.diff(bounds)
    if n == 1 or len(hashes) == 0:
        return hashes, bounds
    h = hashes.copy()
    total = len(h)
    acc = np.zeros(total, np.uint64)
    for k in range(min(n, total)):
        acc[: total - k] += h[k:] * powers(n + 1)[k + 1] if k else h
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.arange(total) - bounds[owner] <= count[owner] - n
    short = np.flatnonzero((count > 0) & (count < n))
    for d in short:
        a, b = bounds[d], bounds[d + 1]
        acc[a] = np.sum(h[a:b] * powers(n + 1)[1 : b - a + 1]) + _U(b - a)
        inside[a] = True
    got = np.bincount(owner[inside], minlength=len(count))
    return mix(acc[inside]), np.concatenate([[0], np.cumsum(got)])


def sorted_sample(df: DataFrame, by: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each value of ``by`` (few values), those with the smallest hashes
    of ``doc_id``. Values are counted first, so that only rows whose hash can be among the n
    smallest (six standard deviations to spare) are sorted at all."""
    from pyspark.sql import Window

    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    h = F.xxhash64("doc_id", F.lit(seed))
    likely = F.lit(float(n + 6 * n**0.5 + 20)) / F.col("_n")
    near = df.withColumn("_h", h).join(F.broadcast(counts), list(by))
    near = near.filter(F.shiftrightunsigned("_h", 11) < likely * F.lit(2.0**53)).drop("_n")
    w = Window.partitionBy(*by).orderBy("_h", "doc_id")
    return near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_h")
