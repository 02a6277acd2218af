"""Repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a string of ``WIDTH`` bytes over it also starts earlier (smaller id, or earlier
in the same document). Suffixes are ordered only as far as that depth, by passes from the most
significant digits on; a pass keeps the suffixes whose digits so far occur twice, and groups
that are still equal at full depth are exactly the repeated windows.

Two things keep the passes small.

* The first pass does not take every suffix. Out of the ``WIDTH - CORE + 1`` positions in a
  window, those with the smallest hash of their next ``CORE`` bytes stand for it. The choice
  depends on the window's bytes alone, so equal windows have equal representatives at equal
  offsets, and a window can only repeat where its representative's core does.
* A node is a core with a range of windows around it. If the bytes of the whole range (the
  hull) occurred before, all its windows are repeated and are settled at once. Only nodes whose
  core is shared but whose hull is new are split into narrower ranges with longer cores, until
  the range is one window and core and hull are the same.

Ordering inside a pass is a range partitioning by (core, hull, id, place), so a very frequent
string is spread over tasks, and each task reads its rows in order with constant memory.
Groups cut by a partition's edge are passed on to the next pass, and the last pass settles
groups by aggregation.

Null text counts as empty. A null id comes before all others. In rows that share an id a string
starts earlier only at a smaller position, so identical rows do not remove each other. An empty
table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import mix, prefix_hash, slices, span_hash
from pulsegrid.plans.staging import stage

WIDTH = 100
CORE = 32
HELD = 200_000  # rows of one core that a task holds at once
SLICE = 400_000  # bytes of text worked on at once; a dozen arrays have eight bytes for each


def _sliding(x: np.ndarray, w: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``w`` neighbouring values; len(x) - w + 1 of them. From
    running extremes of blocks of w values, forwards and backwards."""
    op = np.minimum if low else np.maximum
    if w == 1 or len(x) < w:
        return x[: max(0, len(x) - w + 1)]
    n = -(-len(x) // w) * w
    fill = np.iinfo(np.uint64).max if low else 0
    blocks = np.concatenate([x, np.full(n - len(x), fill, np.uint64)]).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def anchors(data: np.ndarray, bounds: np.ndarray, width: int, core: int) -> np.ndarray:
    """Positions that stand for at least one window, over texts laid end to end; ``bounds`` has
    the start of each text and the end."""
    prefix = prefix_hash(data)
    n = len(data)
    if n < width:
        return np.zeros(0, np.int64)
    at = np.arange(n - core + 1)
    h = span_hash(prefix, at, at + core)
    choices = width - core + 1
    least = _sliding(h, choices, True)  # of the window that starts here
    # Windows that leave their text have no representative.
    start = np.arange(len(least))
    end_of = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    least = np.where(start + width <= end_of, least, 0)
    reach = np.concatenate([np.zeros(choices - 1, np.uint64), least, np.zeros(max(0, n - core + 1 - len(least)), np.uint64)])
    best = _sliding(reach, choices, False)[: len(h)]
    return np.flatnonzero(h == best)


def _texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column(column).to_pylist()
    raw = [b"" if r is None else (r.encode() if isinstance(r, str) else r) for r in raw]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), bounds


# A node's place in one number: position of the anchor, and how far before it the windows of the
# node start at least and at most (below 2**12).
def _spot(at: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << 24) | (near.astype(np.int64) << 12) | far.astype(np.int64)


def _unspot(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 24, (spot >> 12) & 0xFFF, spot & 0xFFF


NODE = "doc long, tag int, spot long, core long, hull long"
_NAMES = ["doc", "tag", "spot", "core", "hull"]
_U = np.uint64


def _nodes(part: pa.RecordBatch, row, at, near, far, prefix, bounds, width) -> pa.RecordBatch:
    """Node rows for texts laid end to end. ``row`` is the text of each node; places count from
    the start of the data; nodes without a window inside their text are left out."""
    first = np.maximum(bounds[row], at - far)
    last = np.minimum(at - near, bounds[row + 1] - width)
    some = first <= last
    row, at, near, far, first, last = (x[some] for x in (row, at, near, far, first, last))
    # The core is the same for clipped ranges; hulls are equal only for equal ranges.
    core = mix(span_hash(prefix, at - near, at - far + width) + (near.astype(np.uint64) << _U(12)) + far.astype(np.uint64))
    hull = mix(span_hash(prefix, first, last + width) + ((at - first).astype(np.uint64) << _U(12)) + (at - last).astype(np.uint64))
    own = [part.column(c).to_numpy()[row] for c in ("doc", "tag")]
    cols = [*own, _spot(at - bounds[row], near, far), core.view(np.int64), hull.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _NAMES)


def _first_pass(width: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, bounds = _texts(part, "text")
                at = anchors(data, bounds, width, core)
                if len(at):
                    row = np.searchsorted(bounds, at, "right") - 1
                    near, far = np.zeros(len(at), np.int64), np.full(len(at), width - core)
                    yield _nodes(part, row, at, near, far, prefix_hash(data), bounds, width)

    return run


def _next_pass(width: int, parts: int):
    """Texts with open spots to nodes of ``parts`` narrower ranges each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, bounds = _texts(part, "text")
                spots = part.column("spots")
                row = np.repeat(np.arange(part.num_rows), np.diff(spots.offsets.to_numpy()))
                at, near, far = _unspot(spots.flatten().to_numpy())
                prefix = prefix_hash(data)
                size = far - near + 1
                for k in range(parts):
                    lo, hi = near + size * k // parts, near + size * (k + 1) // parts - 1
                    some = lo <= hi
                    yield _nodes(part, row[some], (at + bounds[row])[some], lo[some], hi[some], prefix, bounds, width)

    return run


def _settle(most: int):
    """One partition in order of (core, hull, doc, spot): mark nodes whose hull came before as
    settled, drop nodes alone with their core, keep the others open. What is at a partition's
    edge stays open, since its group may go on elsewhere. Of a core of more than ``most`` rows
    all but the last are given out before it ends; the first place of the newest hull is kept,
    so that the rest is judged by the same place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # rows of the newest core, which may go on
        begun = False
        given: tuple[int, int, int] | None = None  # hull and first place of the held row, if its core was given out in part

        def decide(rows: pa.RecordBatch, edge: bool) -> tuple[pa.RecordBatch, tuple[int, int, int]]:
            core, hull, doc, spot = (rows.column(c).to_numpy() for c in ("core", "hull", "doc", "spot"))
            new_core = np.ones(len(core), bool)
            new_core[1:] = core[1:] != core[:-1]
            new_hull = new_core.copy()
            new_hull[1:] |= hull[1:] != hull[:-1]
            group = np.cumsum(new_core) - 1
            first = np.maximum.accumulate(np.where(new_hull, np.arange(len(core)), 0))
            first_doc, first_spot = doc[first], spot[first]
            stays = np.bincount(group, weights=new_hull)[group] > 1
            if given is not None:
                on = (first == 0) & (hull[0] == given[0])
                first_doc, first_spot = np.where(on, given[1], first_doc), np.where(on, given[2], first_spot)
            if given is not None or not begun:
                stays |= group == 0
            if edge:
                stays |= group == group[-1]
            settled = (doc != first_doc) | (spot != first_spot)
            keep = pa.array(settled | stays)
            own = [rows.column(c).filter(keep) for c in ("doc", "tag", "spot")]
            out = pa.RecordBatch.from_arrays([*own, pa.array(settled).filter(keep)], ["doc", "tag", "spot", "settled"])
            return out, (int(hull[-1]), int(first_doc[-1]), int(first_spot[-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            core = rows.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1], "left"))
            if cut == 0 and len(core) > most:  # one core fills everything: all but its last row
                cut = len(core) - 1
                out, given = decide(rows.slice(0, cut), True)
                yield out
            elif cut:
                yield decide(rows.slice(0, cut), False)[0]
                given = None
            begun = begun or cut > 0
            held = rows.slice(cut)
        if held is not None:
            yield decide(held, True)[0]

    return run


def _sorted_pass(nodes: DataFrame, most: int) -> DataFrame:
    order = ["core", "hull", "doc", "spot"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_settle(most), "doc long, tag int, spot long, settled boolean")


def _keep(df: DataFrame, name: str) -> DataFrame:
    """Write a pass's result and let go of its shuffle files."""
    out = stage(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    doc = F.coalesce(F.col(id).cast("long"), F.lit(-(2**63)))
    return docs.select(doc.alias("doc"), F.hash(t).alias("tag"), t.alias("text"))


def repeated_windows(
    docs: DataFrame, width: int = WIDTH, core: int = CORE, id: str = "doc_id", text: str = "text", held: int = HELD
) -> DataFrame:
    """Settled nodes of all texts: doc, tag (hash of the text, for ids that repeat) and spots,
    the array of places whose windows all start earlier too."""
    texts = _keyed(docs, id, text)
    marked = [_keep(_sorted_pass(texts.mapInArrow(_first_pass(width, core), NODE), held), "windows")]

    def opened(parts: int) -> DataFrame:
        spots = marked[-1].filter("not settled").groupBy("doc", "tag").agg(F.collect_set("spot").alias("spots"))
        joined = texts.join(spots, ["doc", "tag"])
        return joined.select("doc", "tag", "text", "spots").mapInArrow(_next_pass(width, parts), NODE)

    size = width - core + 1
    while size > 6:
        size = -(-size // 4)
        marked.append(_keep(_sorted_pass(opened(4), held), "windows"))
    # Single windows: all but the earliest of each are repeated.
    leaves = _keep(opened(size), "leaves")
    place = F.struct("doc", F.shiftright("spot", 24).alias("at"))
    firsts = leaves.groupBy("core").agg(F.min(place).alias("first"), F.max(place).alias("newest"))
    # Only windows that occur twice go through the join.
    firsts = firsts.filter(F.col("first") < F.col("newest")).drop("newest")
    late = leaves.join(firsts, "core").filter(place > F.col("first")).select("doc", "tag", "spot")
    settled = late
    for m in marked:
        settled = settled.union(m.filter("settled").select("doc", "tag", "spot"))
    return settled.groupBy("doc", "tag").agg(F.collect_list("spot").alias("spots"))


def spans(spots: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges [start, end) that the windows at the spots of a text of n bytes cover."""
    at, near, far = _unspot(spots)
    start, end = np.maximum(0, at - far), np.minimum(at - near, n - width) + width
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1]


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, core: int = CORE, id: str = "doc_id", text: str = "text", held: int = HELD
) -> DataFrame:
    """One row per document: its columns with ``text`` replaced by what is kept, as text
    (characters cut in half are left out), and n_bytes, n_removed, n_spans and kept_sha256 (of
    the kept bytes). A null text stays null."""
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    names = [c for c in docs.columns if c not in new and c not in ("_doc", "_tag", "_spots")]
    found = repeated_windows(docs, width, core, id, text, held).select(
        F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("spots").alias("_spots")
    )
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        *names,
        F.coalesce(F.col(id).cast("long"), F.lit(-(2**63))).alias("_doc"),
        F.hash(t).alias("_tag"),
    )
    joined = keyed.join(found, ["_doc", "_tag"], "left").select(*names, "_spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x, spots in zip(batch.column(text).to_pylist(), batch.column("_spots")):
                data = (x or "").encode()
                if not spots.is_valid:
                    out.append((x, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                start, end = spans(spots.values.to_numpy(), len(data), width)
                edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                out.append((kept.decode("utf-8", "ignore"), len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest()))
            cols = dict(zip([text, *new], zip(*out)))
            kinds = {text: pa.string(), "kept_sha256": pa.string()}
            arrays = [pa.array(cols[c], kinds.get(c)) if c == text else batch.column(c) for c in names]
            arrays += [pa.array(cols[c], kinds.get(c, pa.int64())) for c in new]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *new])

    fields = [T.StructField(f.name, f.dataType) for f in docs.select(*names).schema.fields]
    fields += [T.StructField(c, T._parse_datatype_string(k)) for c, k in new.items()]
    return joined.mapInArrow(run, T.StructType(fields))
