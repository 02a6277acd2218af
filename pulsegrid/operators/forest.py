"""Random forests of regression trees, grown level by level on histograms.

Rows go into bins of their features once and are packed into shares of about ``SHARE_ROWS`` rows.
At each level every share counts, per tree and open node, the weights and label sums of all bins;
these are added up over the shares by a shuffle, which also finds the best split of each node.
Only splits and means of nodes come back to the driver, so that no task holds a whole series and
the number of passes is the depth, whatever the number of trees.

A tree weighs each row by a Poisson(1) draw (a bootstrap) and looks at all features. A node is
split where the variance falls most; thresholds lie halfway between two of the (at most
``BINS``) bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, exp, factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pulsegrid.plans.staging import stage

BINS = 32
SHARE_ROWS = 500_000
#: Nodes of a tree whose histograms are added up in one group.
NODES = 128
#: Rows that are counted at once, and cells of a level in one histogram: what a core's cache holds.
HELD_ROWS = 65_536
COUNTED = 1 << 15
LEAF = 255
_STEPS = 1000
#: Poisson(1) by 16 random bits.
_BELOW = np.cumsum([exp(-1) / factorial(k) for k in range(9)])
_WEIGHTS = np.searchsorted(_BELOW, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def thresholds(values: Sequence[float]) -> np.ndarray:
    """At most ``BINS - 1`` thresholds from sorted quantiles, each between two different ones."""
    distinct, last = np.unique(np.asarray(values, np.float64), return_index=True)
    between = distinct[:-1] / 2 + distinct[1:] / 2
    between = np.where(np.isfinite(between), between, distinct[:-1])
    if len(between) < BINS:
        return between
    # Where a value ends, in shares of all rows; those nearest to equal shares are taken.
    ends = last[1:] / len(values)
    at = np.searchsorted(ends, np.arange(1, BINS) / BINS)
    return between[np.unique(np.minimum(at, len(between) - 1))]


def bin_thresholds(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Thresholds of every feature from its quantiles over all rows."""
    steps = [k / _STEPS for k in range(_STEPS + 1)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, 10 * _STEPS).alias(c) for c in features])
    return [thresholds(q or []) for q in found.first()]


def _binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of thresholds below each value, rows by features."""
    if any(np.isnan(x).any() for x in columns):
        raise ValueError("a feature is null or not a number")
    return np.stack([np.searchsorted(c, x).astype(np.uint8) for x, c in zip(columns, cuts)], axis=1)


def _doubles(rows: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(rows.column(column).cast(pa.float64()))


def _packing(features: Sequence[str], labels: dict[str, str], cuts: Sequence[np.ndarray], center: dict[str, float]):
    """A share's rows to two arrays a label, in an order that depends on the rows only."""

    def run(table: pa.Table) -> pa.Table:
        hashed = np.asarray(table.column("_hash"))
        bins = _binned([_doubles(table, c) for c in features], cuts)
        packed = []
        for k, c in labels.items():
            rows = np.flatnonzero(np.asarray(table.column(c).is_valid()))
            y = _doubles(table, c)[rows]
            order = np.lexsort((y, hashed[rows]))
            packed.append((bins[rows[order]].tobytes(), (y[order] - center[k]).tobytes()))
        return pa.table({
            "label": pa.array(list(labels), pa.string()),
            "share": pa.array([table.column("_share")[0].as_py()] * len(labels), pa.int64()),
            "bins": pa.array([x for x, _ in packed], pa.binary()),
            "y": pa.array([y for _, y in packed], pa.binary()),
        })

    return run


def _placed(bins: np.ndarray, at: np.ndarray, feature: np.ndarray, split: np.ndarray, level: int) -> np.ndarray:
    """Place of each row's node in a level; ``at`` is where a row's bins begin. Below a leaf rows
    keep to the left."""
    leaf = feature == LEAF
    feature, split = np.where(leaf, 0, feature).astype(np.int64), np.where(leaf, LEAF, split).astype(np.uint8)
    node = np.zeros(len(at), np.int64)
    for d in range(level):
        first = (1 << d) - 1
        here = feature[first : 2 * first + 1].take(node)
        here += at
        right = bins.take(here) > split[first : 2 * first + 1].take(node)
        node += node
        node += right
    return node


def _joined(sizes: Sequence[int], nodes: int) -> list[list[int]]:
    """Features that are counted together: few bins make one code, whose histogram is summed up."""
    most, groups = max(BINS, COUNTED // nodes), [[]]
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k]):
        if groups[-1] and prod(sizes[i] for i in [*groups[-1], k]) > most:
            groups.append([])
        groups[-1].append(k)
    return groups


def _histograms(weight, y, bins, codes, sizes, feature, split, opened, level) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label sums by open node and bin of all features, some rows at a time."""
    width, count, at = len(sizes), int(opened.sum()), np.cumsum(opened) - 1
    sums = [np.zeros((2, count * size)) for _, size, _ in codes]
    for first in range(0, len(y), HELD_ROWS):
        rows = np.flatnonzero(weight[first : first + HELD_ROWS] > 0) + first
        node = _placed(bins, rows * width, feature, split, level)
        if count < len(opened):
            inside = opened.take(node)
            rows, node = rows[inside], at.take(node[inside])
        w = weight.take(rows).astype(np.float64)
        wy = w * y.take(rows)
        for (_, size, code), (n, s) in zip(codes, sums):
            place = node * size
            place += code.take(rows)
            n += np.bincount(place, w, count * size)
            s += np.bincount(place, wy, count * size)
    ends, total = np.cumsum(sizes), sum(sizes)
    out = np.empty((count, total), np.float32), np.empty((count, total))
    for (group, _, _), both in zip(codes, sums):
        for to, found in zip(out, both):
            cells = found.reshape(count, *[sizes[k] for k in group])
            for axis, k in enumerate(group, 1):
                to[:, ends[k] - sizes[k] : ends[k]] = cells.sum(axis=tuple({*range(1, cells.ndim)} - {axis}))
    return out


def _counted(sizes: Sequence[int], level: int, feature: dict, split: dict, opened: dict, seed: int):
    """Packed shares to histograms of the open nodes of a level, some nodes of a tree a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, share, packed, y in zip(*[batch.column(c) for c in ("label", "share", "bins", "y")]):
                label, share = label.as_py(), share.as_py()
                bins, y = np.frombuffer(packed.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.float64)
                codes = []
                for group in _joined(sizes, 1 << level):
                    shape = [sizes[k] for k in group]
                    code = np.ravel_multi_index([bins[k :: len(sizes)] for k in group], shape)
                    codes.append((group, prod(shape), code.astype(np.uint16)))
                for tree, (f, t, nodes) in enumerate(zip(feature[label], split[label], opened[label])):
                    if not nodes.any():
                        continue
                    rng = np.random.default_rng([seed, share, tree])
                    weight = _WEIGHTS.take(rng.integers(0, 1 << 16, len(y), np.uint16))
                    n, s = _histograms(weight, y, bins, codes, sizes, f, t, nodes, level)
                    parts = range(0, len(n), NODES)
                    yield pa.RecordBatch.from_pydict({
                        "label": pa.array([label] * len(parts)),
                        "tree": pa.array([tree] * len(parts), pa.int32()),
                        "part": pa.array([a // NODES for a in parts], pa.int32()),
                        "n": pa.array([n[a : a + NODES].tobytes() for a in parts], pa.binary()),
                        "s": pa.array([s[a : a + NODES].tobytes() for a in parts], pa.binary()),
                    })

    return run


def best_splits(n: np.ndarray, s: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, ...]:
    """Per node of histograms (weights, label sums): feature, last bin on the left, weights and
    means of both sides; the feature is ``LEAF`` where no split lowers the variance."""
    nodes, ends = np.arange(len(n)), np.cumsum(sizes)
    whole, summed = n[:, : sizes[0]].sum(axis=1), s[:, : sizes[0]].sum(axis=1)
    base = summed * summed / np.maximum(whole, 1)
    gain = np.zeros(len(n))
    feature, split = np.full(len(n), LEAF, np.uint8), np.zeros(len(n), np.uint8)
    left_n, left_s = whole.copy(), summed.copy()
    for k, (size, end) in enumerate(zip(sizes, ends)):
        if size < 2:
            continue
        ln = np.cumsum(n[:, end - size : end], axis=1)[:, :-1]
        ls = np.cumsum(s[:, end - size : end], axis=1)[:, :-1]
        rn, rs = whole[:, None] - ln, summed[:, None] - ls
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((ln > 0) & (rn > 0), ls * ls / ln + rs * rs / rn - base[:, None], -1.0)
        at = score.argmax(axis=1)
        found = score[nodes, at]
        better = (found > gain) & (found > 1e-12 * base)
        gain[better], feature[better], split[better] = found[better], k, at[better]
        left_n[better], left_s[better] = ln[nodes, at][better], ls[nodes, at][better]
    # Both sides of a leaf have its mean.
    whole_n, whole_s = np.where(feature == LEAF, 2 * whole, whole), np.where(feature == LEAF, 2 * summed, summed)
    ns, sums = np.stack([left_n, whole_n - left_n], axis=1), np.stack([left_s, whole_s - left_s], axis=1)
    return feature, split, ns, sums / np.maximum(ns, 1)


CHOSEN = "label string, tree int, part int, feature binary, split binary, ns binary, means binary"


def _chosen(sizes: Sequence[int]):
    """Histograms of some nodes from all shares to the nodes' splits."""
    total = sum(sizes)

    def run(table: pa.Table) -> pa.Table:
        n = s = 0.0
        for a, b in zip(table.column("n"), table.column("s")):
            n = n + np.frombuffer(a.as_buffer(), np.float32).reshape(-1, total)
            s = s + np.frombuffer(b.as_buffer(), np.float64).reshape(-1, total)
        found = best_splits(n.astype(np.float64), s, sizes)
        out = table.select(["label", "tree", "part"]).slice(0, 1)
        for c, x in zip(("feature", "split", "ns", "means"), found):
            out = out.append_column(c, pa.array([x.tobytes()], pa.binary()))
        return out

    return run


@dataclass
class Forest:
    """Trees as arrays by node, level by level: the children of node k are 2 k + 1 and 2 k + 2."""

    features: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    def predicted(self, rows: pa.RecordBatch) -> np.ndarray:
        """Mean of the trees for each row."""
        bins = _binned([_doubles(rows, c) for c in self.features], self.cuts)
        at, flat = np.arange(len(bins)) * bins.shape[1], bins.ravel()
        depth = (self.value.shape[1] + 1).bit_length() - 2
        out = np.zeros(len(bins))
        for feature, split, value in zip(self.feature, self.split, self.value):
            out += value[(1 << depth) - 1 :].take(_placed(flat, at, feature, split, depth))
        return out / len(self.value)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with their prediction."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("prediction", pa.array(self.predicted(batch)))

        return rows.mapInArrow(run, StructType([*rows.schema, StructField("prediction", DoubleType())]))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row with all trees."""
        trees = [(f.tobytes(), t.tobytes(), v.tobytes()) for f, t, v in zip(self.feature, self.split, self.value)]
        row = (self.features, [c.tolist() for c in self.cuts], trees)
        spark.createDataFrame([row], SAVED).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        row = spark.read.schema(SAVED).parquet(path).first()
        arrays = [
            np.stack([np.frombuffer(tree[k], kind) for tree in row.trees])
            for k, kind in enumerate((np.uint8, np.uint8, np.float64))
        ]
        return cls(row.features, [np.array(c, np.float64) for c in row.thresholds], *arrays)


SAVED = (
    "features array<string>, thresholds array<array<double>>, "
    "trees array<struct<feature: binary, split: binary, value: binary>>"
)


def grow(
    rows: DataFrame, features: Sequence[str], labels: dict[str, str], keys: Sequence[str] = (),
    trees: int = 100, depth: int = 10, seed: int = 42,
) -> dict[str, Forest]:
    """One forest per label (name to column), each from the rows where the label is known.

    Features must be complete (others are an error); ``keys`` and features tell rows apart. A forest does not depend on
    the other labels, and on the order of the rows only as far as the quantile sketch of its
    thresholds does. A tree has places for 2 ** depth leaves, on the driver too, so ``depth`` is
    meant to stay at about 15 or less. Labels without rows have no forest.
    """
    labels = dict(labels)
    known = rows.agg(F.count("*").alias("_n"), *[F.avg(c).alias(k) for k, c in labels.items()]).first()
    center = {k: known[k] for k in labels if known[k] is not None}
    if not center:
        return {}
    labels = {k: labels[k] for k in center}
    cuts = bin_thresholds(rows, features)
    sizes = [len(c) + 1 for c in cuts]
    shares = ceil(known["_n"] / SHARE_ROWS)
    hashed = rows.select(*features, *labels.values(), F.xxhash64(*keys, *features).alias("_hash"))
    keyed = hashed.withColumn("_share", F.pmod("_hash", F.lit(shares)))
    packed = stage(
        keyed.groupBy("_share").applyInArrow(
            _packing(features, labels, cuts, center), "label string, share long, bins binary, y binary"
        ),
        "shares",
        maxRecordsPerFile=1,
    )
    inner = (1 << depth) - 1
    feature = {k: np.full((trees, inner), LEAF, np.uint8) for k in labels}
    split = {k: np.zeros((trees, inner), np.uint8) for k in labels}
    value = {k: np.zeros((trees, 2 * inner + 1)) for k in labels}
    opened = {k: np.ones((trees, 1), bool) for k in labels}
    for level in range(depth):
        first = (1 << level) - 1
        if any(x.any() for x in opened.values()):
            above = [{k: x[:, :first] for k, x in one.items()} for one in (feature, split)]
            counted = packed.mapInArrow(
                _counted(sizes, level, *above, opened, seed), "label string, tree int, part int, n binary, s binary"
            )
            found = counted.groupBy("label", "tree", "part").applyInArrow(_chosen(sizes), CHOSEN).toArrow()
        else:
            found = None
        below = {k: np.zeros((trees, 2 << level), bool) for k in labels}
        for k in labels:
            # What is not split hands its value down.
            value[k][:, 2 * first + 1 : 4 * first + 3] = np.repeat(value[k][:, first : 2 * first + 1], 2, axis=1)
        for row in found.to_pylist() if found else []:
            k, tree = row["label"], row["tree"]
            part = row["part"] * NODES
            nodes = np.flatnonzero(opened[k][tree])[part : part + NODES]
            f, t = (np.frombuffer(row[c], np.uint8) for c in ("feature", "split"))
            ns, means = (np.frombuffer(row[c]).reshape(-1, 2) for c in ("ns", "means"))
            feature[k][tree, first + nodes], split[k][tree, first + nodes] = f, t
            for side in (0, 1):
                at = 2 * nodes + side
                value[k][tree, 2 * first + 1 + at] = means[:, side]
                below[k][tree, at] = (f != LEAF) & (ns[:, side] > 1)
        opened = below
    return {k: Forest(list(features), cuts, feature[k], split[k], value[k] + center[k]) for k in labels}


def errors(rows: DataFrame, forests: dict[str, Forest], labels: dict[str, str]) -> dict[str, tuple[float, float, float]]:
    """Mean absolute and squared error of every forest and the range of its label, over the rows
    where it is known; labels without such rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, one in forests.items():
                part = batch.filter(batch.column(labels[k]).is_valid())
                if part.num_rows:
                    y = _doubles(part, labels[k])
                    off = y - one.predicted(part)
                    sums = [len(y), np.abs(off).sum(), (off * off).sum(), y.min(), y.max()]
                    yield pa.RecordBatch.from_pydict({"label": [k], **{c: [float(x)] for c, x in zip("naqlh", sums)}})

    sums = rows.mapInArrow(run, "label string, n double, a double, q double, l double, h double")
    found = sums.groupBy("label").agg(
        (F.sum("a") / F.sum("n")).alias("mae"), (F.sum("q") / F.sum("n")).alias("mse"), (F.max("h") - F.min("l")).alias("spread")
    )
    return {r.label: (r.mae, r.mse, r.spread) for r in found.collect()}
