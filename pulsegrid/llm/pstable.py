"""Near-duplicate vectors by p-stable hashing.

Vectors are normalised; on the unit sphere a cosine of 0.98 is a Euclidean distance of 0.2. A
table hashes a vector to ``BITS`` quantised Gaussian projections floor((a.v + b) / width); two
vectors are candidates where all of them agree in one of ``TABLES`` tables, and every candidate
pair is checked by its exact cosine. At the threshold one projection agrees with probability
0.93, so that all tables miss a pair with probability below 1e-5, and closer pairs less.

Equal vectors of a label are one class, found by grouping, and take part once with their
number. Classes of a bucket are cut into blocks of ``BLOCK``; a task gets two blocks and their
vectors, never a bucket, and returns sums per vector and a spanning set of links, not pairs. A
pair that meets in several tables counts in the first of them only.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, link with nothing. Lengths may differ between labels; vectors of different length do
not link. An empty table gives an empty result; repeated rows (equal ids) count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import mix
from pulsegrid.llm.components import components
from pulsegrid.plans.staging import stage

TABLES, BITS, WIDTH = 32, 16, 2.4
BLOCK = 512
THRESHOLD = 0.98
_U = np.uint64
_planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection directions and offsets for vectors of a length; the same everywhere."""
    if dim not in _planes:
        rng = np.random.default_rng(977 + dim)
        _planes[dim] = rng.standard_normal((dim, TABLES * BITS)), rng.random(TABLES * BITS) * WIDTH
    return _planes[dim]


def bucket_ids(unit: np.ndarray) -> np.ndarray:
    """One 64-bit bucket id per row and table."""
    a, b = planes(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, BITS)
    h = np.broadcast_to(np.arange(TABLES, dtype=np.uint64) + _U(1), (len(unit), TABLES))
    for k in range(BITS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + cells[:, :, k])
    return h.view(np.int64)


def usable(embedding: str = "embedding", label: str = "label"):
    """Rows that can link: a label, and finite components that are not all zero."""
    e = F.col(embedding)
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & e.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(e, lambda x: x != 0)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket ids of (rep, key, vector, group) rows, one row per table."""
    for batch in batches:
        vectors = batch.column(2).to_pylist()
        lengths = np.array([len(v) for v in vectors])
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            buckets = bucket_ids(_units([vectors[i] for i in at]))
            names = ["rep", "key", "g"]
            kept = [batch.column(c).take(pa.array(np.repeat(at, TABLES))) for c in (0, 1, 3)]
            table = np.tile(np.arange(TABLES, dtype=np.int32), len(at))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table), pa.array(buckets.ravel())], [*names, "t", "bucket"])


def _pairs(threshold: float):
    """Compare the two blocks of one row (right is null: a block with itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                t, same = row["t"], row["right"] is None
                li, ln, lx = _block(row["left"])
                ri, rn, rx = (li, ln, lx) if same else _block(row["right"])
                i, j = np.nonzero(lx @ rx.T >= threshold - 1e-9)
                # The exact check, one pair at a time.
                keep = np.einsum("ij,ij->i", lx[i], rx[j]) >= threshold
                keep &= i < j if same else True
                i, j = i[keep], j[keep]
                if t and len(i):
                    lk = bucket_ids(lx)[:, :t]
                    rk = lk if same else bucket_ids(rx)[:, :t]
                    first = ~(lk[i] == rk[j]).any(axis=1)
                    i, j = i[first], j[first]
                if len(i):
                    ids, back = np.unique(np.concatenate([li[i], ri[j]]), return_inverse=True)
                    near = np.bincount(back, weights=np.concatenate([rn[j], ln[i]])).astype(np.int64)
                    out.append((ids, near, _least(back[: len(i)], back[len(i) :], ids)))
            if out:
                arrays = [pa.array(np.concatenate([o[k] for o in out])) for k in range(3)]
                yield pa.RecordBatch.from_arrays(arrays, ["rep", "near", "other"])

    return run


def _block(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([r["rep"] for r in rows], np.int64)
    return ids, np.array([r["n"] for r in rows], np.int64), _units([r["embedding"] for r in rows])


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _least(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each position's component, given links between positions of ``ids``
    (sorted)."""
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return ids[low]
        low = new


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Rows with a null id link with nothing. Rows that share an id share its links."""
    rows = vectors.select(
        F.col(id).cast("long").alias("_id"), F.col(embedding).alias("_e"), F.col(label).alias("_l")
    ).withColumn("_ok", usable("_e", "_l") & F.col("_id").isNotNull())
    classes = (
        rows.filter("_ok")
        .groupBy("_l", "_e")
        .agg(F.min("_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("key", F.xxhash64("_l", "_e"))
    )
    classes = stage(classes, "vector-classes")
    size = F.size("_e")
    hashed = classes.select("rep", "key", F.col("_e").alias("e"), F.hash("_l", size).alias("g"))
    hashed = stage(hashed.mapInArrow(_hashed, "rep long, key long, g int, t int, bucket long"), "vector-buckets")
    spot = ["g", "t", "bucket"]
    crowded = hashed.groupBy(*spot).agg(F.count("*").alias("m")).filter("m > 1")
    # Blocks by a hash of the class: any size of bucket, about BLOCK classes in each.
    cut = crowded.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
    placed = hashed.join(cut, spot).withColumn("block", F.pmod(F.hash("key", "rep"), "blocks"))
    member = F.struct("rep", "n", F.col("_e").alias("embedding"))
    filled = (
        placed.join(classes, ["rep", "key"])
        .groupBy(*spot, "_l", "block", "blocks")
        .agg(F.collect_list(member).alias("rows"))
    )
    filled = stage(filled, "vector-blocks")
    alone = filled.filter(F.size("rows") > 1).select("t", F.col("rows").alias("left"), F.lit(None).alias("right"))
    many = filled.filter("blocks > 1")
    left = many.withColumn("with", F.explode(F.expr("sequence(block, blocks - 1)"))).filter("with > block")
    right = many.select(*spot, "_l", F.col("block").alias("with"), F.col("rows").alias("right"))
    across = left.join(right, [*spot, "_l", "with"]).select("t", F.col("rows").alias("left"), "right")
    work = alone.select("t", "left", F.lit(None).cast(filled.schema["rows"].dataType).alias("right")).union(across)
    # Each row is up to two blocks: batches of few rows.
    found = work.repartition(F.hash("left")).mapInArrow(_pairs(threshold), "rep long, near long, other long")
    found = stage(found, "vector-links")
    near = found.groupBy("rep").agg(F.sum("near").alias("near"))
    parts = components(found.filter("rep <> other"), "rep", "other").withColumnRenamed("id", "rep")
    done = classes.join(near, "rep", "left").join(parts, "rep", "left")
    done = done.select(
        F.col("_l").alias("_cl"),
        F.col("_e").alias("_ce"),
        (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    joined = rows.join(done, F.col("_ok") & (F.col("_l") == F.col("_cl")) & (F.col("_e") == F.col("_ce")), "left")
    component = F.coalesce("component_id", "_id")
    return joined.select(
        F.col("_id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"),
    )
