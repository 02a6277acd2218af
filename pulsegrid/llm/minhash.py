"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its windows of five words: a window's weight is its count
times its inverse document frequency, ln((1 + N) / (1 + n)) + 1 for a window that n of all N
documents have. Every window's n is counted: a part of a task's texts sends each window it has
once, to the task that counts the window's range of hashes, and gets the numbers back; nothing is
kept on the driver or broadcast. Each of ``BANDS * ROWS`` hashes draws one (window, level) of the set
such that two documents draw the same with probability equal to their weighted Jaccard
similarity; ``ROWS`` draws make a band, and documents that share a band are candidates. At a
similarity of 0.8 all bands miss a pair with probability below 1e-4.

Each class of equal texts keeps 16 bits of all its draws as a sketch. A pair at the threshold
has fewer equal draws than ``least_matches`` asks for with probability below 1e-5, so sketches
tell which candidates are worth a look at their sets. Of a set only the sum of its weights and the
windows that other documents have too are kept: no other window can be in common.

Equal texts are one class from the start. Candidates are verified by their exact weighted
Jaccard similarity in steps, so that large groups never become pairs: first each class of a
band bucket against the bucket's smallest class; then, ``ROUNDS`` times, the classes outside
the largest component of a bucket against a member of that component picked by a hash, in
buckets whose classes are not connected yet; at last, what is left of these buckets is cut into
blocks. A task compares the sketches of two blocks at once and returns the classes that have a
likely partner in another component, each pair in the first bucket it shares; only these go,
with their sets, into blocks that are compared exactly, and a task returns links only. What
stays unverified is inside one component and cannot change the result.

Null and empty texts have no window and match nothing but equal texts, null counting as empty;
texts of fewer than five words have one window, all of them. Rows that share an id share its
links. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import mix, ngrams, slices, texts_of, words
from pulsegrid.llm.components import components
from pulsegrid.plans.staging import stage

WINDOW = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 3
ROUNDS = 1
BLOCK, BLOCK_BYTES = 256, 1_000_000
SKETCH_BLOCK = 1024
MARKS = 1 << 24
_POOL = 1 << 15
#: Bytes of two sets that are compared at once, and windows that draw at once; a set is never split.
PAIR_BYTES = 500_000
DRAW_WINDOWS = 75_000
#: Characters whose words are hashed at once; a few arrays have eight bytes for each.
HASHED_CHARS = 400_000
#: Bytes of text whose windows are counted in one range of hashes.
RANGE_BYTES = 8_000_000
_U = np.uint64
_pools: list[tuple[np.ndarray, ...]] = []


def _draws() -> list[tuple[np.ndarray, ...]]:
    """Per hash: multiplier and a pool of (1/r, r, beta, ln c); the same everywhere."""
    if not _pools:
        rng = np.random.default_rng(4242)
        for _ in range(BANDS * ROWS):
            odd = _U(int(rng.integers(0, 2**63)) * 2 + 1)
            r = rng.gamma(2.0, 1.0, _POOL)
            c = np.log(rng.gamma(2.0, 1.0, _POOL))
            beta = rng.random(_POOL)
            _pools.append((odd, *[x.astype(np.float32) for x in (1 / r, r, beta, c)]))
    return _pools


def inverse_frequency(n: np.ndarray, total: int) -> np.ndarray:
    return np.log((1.0 + total) / (1.0 + np.asarray(n, np.float64))) + 1.0


class Weights:
    """Inverse document frequency of the windows in a sorted table, those that several documents
    have; all others are in one document."""

    def __init__(self, windows: np.ndarray, n: np.ndarray, total: int):
        self.windows = windows
        self.idf = inverse_frequency(n, total)
        self.rest = float(inverse_frequency(1, total))

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.windows):
            return np.full(len(h), self.rest)
        at = np.minimum(np.searchsorted(self.windows, h), len(self.windows) - 1)
        return np.where(self.windows[at] == h, self.idf[at], self.rest)


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of each text, in order, and bounds; some texts at a time."""
    part = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // HASHED_CHARS
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    found = [ngrams(*words(texts[a:b]), WINDOW) for a, b in zip(starts, starts[1:])]
    sizes = np.concatenate([np.diff(bounds) for _, bounds in found])
    return np.concatenate([h for h, _ in found]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def window_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of each text, sorted by hash inside a text, their counts, and bounds."""
    h, bounds = windows_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    h, owner = h[at], owner[at]
    return h, tf, np.searchsorted(owner, np.arange(len(texts) + 1))


def weighted_sets(texts: list[str], idf: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of each text, sorted by hash inside a text, their weights, and bounds."""
    h, tf, bounds = window_sets(texts)
    return h, tf * idf.of(h), bounds


def draws(h: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One draw per hash and text; texts without windows must not be passed."""
    n = len(bounds) - 1
    start = bounds[:-1]
    owner = np.repeat(np.arange(n), np.diff(bounds))
    lw = np.log(w).astype(np.float32)
    drawn = np.zeros((BANDS * ROWS, n), np.uint64)
    for k, (odd, inv, r, beta, c) in enumerate(_draws()):
        at = ((h * odd) >> _U(49)).astype(np.int64)
        level = np.floor(lw * inv[at] + beta[at])
        # ln a = ln c - r (level - beta) - r
        a = c[at] - r[at] * (level - beta[at] + np.float32(1))
        least = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == least[owner])
        # Ties: the smaller hash, which comes first.
        first = hit[np.searchsorted(owner[hit], np.arange(n))]
        drawn[k] = mix(h[first] + level[first].astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15))
    return drawn


def banded(drawn: np.ndarray) -> np.ndarray:
    """One key per text and band."""
    keys = np.zeros((BANDS, drawn.shape[1]), np.uint64)
    for k in range(len(drawn)):
        keys[k // ROWS] = mix(keys[k // ROWS] * _U(31) + drawn[k] + _U(k))
    return keys.T.view(np.int64)


def band_keys(h: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return banded(draws(h, w, bounds))


def least_matches(threshold: float, miss: float = 1e-5) -> int:
    """Equal draws that a pair at the threshold has at least, but for a probability of ``miss``."""
    n, below, m = BANDS * ROWS, 0.0, 0
    while True:
        below += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if below > miss:
            return m
        m += 1


def matches(a: np.ndarray, b: np.ndarray, band: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Equal draws of sketches (last axis; the others broadcast), and whether a band before
    ``band`` is equal as a whole."""
    total, earlier = 0, False
    for k in range(BANDS):
        equal = sum((a[..., i] == b[..., i]).astype(np.uint8) for i in range(k * ROWS, (k + 1) * ROWS))
        total = total + equal
        if k < band:
            earlier = earlier | (equal == ROWS)
    return total, earlier


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), BANDS * ROWS)


def _packed(x: np.ndarray, size: int) -> bytes:
    """Bytes of numbers by place, so that the many small ones of a row compress."""
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel()


def _starts(ranges: int) -> np.ndarray:
    """Smallest hash of each range."""
    return np.array([-(-(k << 64) // ranges) for k in range(ranges)], np.uint64)


def _digest(texts: list[str]) -> bytes:
    """Name of a part: equal ones have equal windows, and so equal numbers of documents."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    return hashlib.blake2b(sizes.tobytes() + b"".join(data), digest_size=16).digest()


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and how often they are there."""
    h = np.sort(h)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def _held(text: str, ranges: int):
    """The windows of each part of a task's texts, cut into ranges of hashes, with the number of
    the part's documents that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _starts(ranges)
        for batch in batches:
            for part in slices(batch, text):
                texts = texts_of(part, text)
                h, n = _distinct(window_sets(texts)[0])
                if not len(h):
                    continue
                cut = np.append(np.searchsorted(h, starts), len(h))
                some = np.flatnonzero(np.diff(cut))
                rows = [(slice(cut[k], cut[k + 1]), starts[k]) for k in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(texts)] * len(some), pa.binary()),
                        pa.array(some, pa.int32()),
                        # Differences of sorted hashes are short.
                        pa.array([_packed(np.diff(h[at], prepend=least), 8) for at, least in rows], pa.binary()),
                        pa.array([_packed(n[at], 4) for at, _ in rows], pa.binary()),
                    ],
                    ["part", "range", "windows", "n"],
                )

    return run


def _summed(table: pa.Table, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows of one range: distinct windows, documents that have them, the window of each
    entry and the bounds of the rows. A part that is there twice counts twice."""
    start = _starts(ranges)[table.column("range")[0].as_py()]
    rows = [_unpacked(x, 8) for x in table.column("windows").to_pylist()]
    h = np.concatenate([np.cumsum(x, dtype=np.uint64) + start for x in rows])
    n = np.concatenate([_unpacked(x, 4) for x in table.column("n").to_pylist()])
    windows, place = np.unique(h, return_inverse=True)
    total = np.bincount(place, weights=n, minlength=len(windows)).astype(np.int64)
    return windows, total, place, np.cumsum([0, *map(len, rows)])


def _returned(ranges: int):
    """Rows of one range to the number of documents that have their windows, in their order."""

    def run(table: pa.Table) -> pa.Table:
        _, total, place, bounds = _summed(table, ranges)
        n = total[place]
        return table.select(["part", "range"]).append_column(
            "n", pa.array([_packed(n[a:b], 4) for a, b in zip(bounds, bounds[1:])], pa.binary())
        )

    return run


def _several(ranges: int):
    """Rows of one range to its windows that several documents have."""

    def run(table: pa.Table) -> pa.Table:
        windows, total, _, _ = _summed(table, ranges)
        some = total > 1
        return pa.table({"value": windows[some].view(np.int64), "n": total[some]})

    return run


def window_ranges(docs: DataFrame, text: str) -> tuple[DataFrame, int, int]:
    """Windows of parts of the texts by range of hashes, the number of ranges, and of documents."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    ranges = 1 + (size["bytes"] or 0) // RANGE_BYTES
    # All columns go along, so that batches are the same in the second pass.
    held = docs.mapInArrow(_held(text, ranges), "part binary, range int, windows binary, n binary")
    return held, ranges, size["n"]


def window_weights(docs: DataFrame, text: str = "text") -> Weights:
    """Weights of all windows of a table small enough for one of its windows on the driver;
    ``near_duplicates`` leaves them where they are counted."""
    held, ranges, total = window_ranges(docs, text)
    found = held.groupBy("range").applyInArrow(_several(ranges), "value long, n long").toArrow()
    windows = found.column("value").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(windows)
    return Weights(windows[order], found.column("n").to_numpy()[order], total)


def _contents(id: str, text: str):
    """The parts that ``_held`` cuts, with ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part in slices(batch, text):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(texts_of(part, text))], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    ["part", "rows"],
                )

    return run


SIGNED = "rep long, keys array<long>, sketch binary, value binary"


def _signatures(total: int, id: str, text: str):
    """A part's texts and the numbers of documents that have its windows, to band keys, sketches
    and sets."""

    def signed(part: pa.Table, windows: np.ndarray, counted: np.ndarray, h, tf, bounds) -> Iterator[pa.RecordBatch]:
        n = counted[np.searchsorted(windows, h)]
        w = tf * inverse_frequency(n, total)
        some = np.flatnonzero(np.diff(bounds) > 0)
        if not len(some):
            return
        group = bounds[some] // DRAW_WINDOWS
        for docs in np.split(some, np.flatnonzero(np.diff(group)) + 1):
            # Texts without windows in between add nothing to the bounds.
            at, to = bounds[docs[0]], bounds[docs[-1] + 1]
            tight = np.append(bounds[docs], to) - at
            drawn = draws(h[at:to], w[at:to], tight)
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(len(docs) + 1, dtype=np.int32) * BANDS), pa.array(banded(drawn).ravel())
            )
            bits = np.ascontiguousarray((drawn >> _U(48)).astype("<u2").T)
            sets = []
            for d in docs:
                mine = slice(bounds[d], bounds[d + 1])
                shared = n[mine] > 1
                whole = np.array([w[mine].sum()], "<f8")
                sets.append(b"".join(x.tobytes() for x in (
                    whole, h[mine][shared], n[mine][shared].astype("<u4"), tf[mine][shared].astype("<u4")
                )))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(id).combine_chunks().take(pa.array(docs)),
                    keys,
                    pa.array([x.tobytes() for x in bits], pa.binary()),
                    pa.array(sets, pa.binary()),
                ],
                ["rep", "keys", "sketch", "value"],
            )

    def run(contents: pa.Table, numbers: pa.Table) -> pa.Table:
        empty = pa.table({"rep": pa.array([], pa.int64()), "keys": pa.array([], pa.list_(pa.int64())),
                          "sketch": pa.array([], pa.binary()), "value": pa.array([], pa.binary())})
        found = dict(zip(numbers.column("range").to_pylist(), numbers.column("n").to_pylist()))
        counted = [_unpacked(found[k], 4) for k in sorted(found)]
        counted = np.concatenate(counted) if counted else np.zeros(0, "<u4")
        out = []
        for rows in contents.column("rows").to_pylist():
            part = pa.ipc.open_stream(rows).read_all()
            h, tf, bounds = window_sets(texts_of(part, text))
            windows, _ = _distinct(h)
            if len(windows) != len(counted):
                raise ValueError("the rows came in another order the second time; write the table first")
            out.extend(signed(part, windows, counted, h, tf, bounds))
        return pa.Table.from_batches(out) if out else empty

    return run


def _opened(value: bytes, total: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """A set as ``_signatures`` writes it: sum of all weights, and of the windows that several
    documents have the hashes, inverse document frequencies and counts."""
    k = (len(value) - 8) // 16
    h = np.frombuffer(value, "<u8", k, 8)
    n, tf = np.frombuffer(value, "<u4", 2 * k, 8 + 8 * k).reshape(2, k)
    return float(np.frombuffer(value, "<f8", 1)[0]), h, inverse_frequency(n, total), tf


def weighted_jaccard(h1, w1, h2, w2, whole: float | None = None) -> float:
    """Sum of the smaller over the sum of the larger weights; windows sorted by hash. ``whole`` is
    the sum of all weights of both where windows that are not in common are left out."""
    if not len(h1) or not len(h2):
        return 0.0
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    both = h2[at] == h1
    common = np.minimum(w1[both], w2[at[both]]).sum()
    return float(common / ((w1.sum() + w2.sum() if whole is None else whole) - common))


def _likely(least: int):
    """(a, b, sketch a, sketch b) rows to the pairs with enough equal draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, _ = matches(_sketches(batch.column("sa")), _sketches(batch.column("sb")))
            yield batch.select(["a", "b"]).filter(pa.array(total >= least))

    return run


def _promising(least: int):
    """Blocks of sketches to the classes with a likely partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, keys = batch.column("band").to_pylist(), batch.column("key").to_pylist()
            found: list[tuple[int, int, np.ndarray]] = []
            for k in range(batch.num_rows):
                mine = batch.column("rows")[k].values
                other = batch.column("other")[k]
                other = other.values if other.is_valid else mine
                ca, cb = (np.asarray(x.field("component")) for x in (mine, other))
                if (ca == ca[0]).all() and (cb == ca[0]).all():
                    continue
                sa, sb = _sketches(mine.field("value")), _sketches(other.field("value"))
                total, earlier = matches(sa[:, None, :], sb[None, :, :], bands[k])
                good = (total >= least) & ~np.asarray(earlier) & (ca[:, None] != cb[None, :])
                if good.any():
                    ra, rb = (np.asarray(x.field("rep")) for x in (mine, other))
                    found.append((bands[k], keys[k], np.union1d(ra[good.any(axis=1)], rb[good.any(axis=0)])))
            if found:
                n = [len(x) for _, _, x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([x for x, _, _ in found], n), pa.int32()),
                        pa.array(np.repeat(np.array([x for _, x, _ in found], np.int64), n)),
                        pa.array(np.concatenate([x for _, _, x in found]), pa.int64()),
                    ],
                    ["band", "key", "rep"],
                )

    return run


SPOT = ["band", "key"]


def _block_pairs(members: DataFrame, count: int, size: int) -> DataFrame:
    """Buckets cut into blocks of about ``count`` rows and ``size`` bytes of ``value``: one row
    per block (other null) or two blocks to compare. The largest component of a bucket that
    needs several blocks has its own ones, which are not compared with each other."""
    inner = F.col("component") == F.col("main")

    def blocks(which: Column) -> Column:
        load = F.greatest(F.count_if(which) / count, F.sum(F.when(which, F.octet_length("value"))) / size)
        return F.coalesce(F.ceil(load).cast("int"), F.lit(0))

    cut = members.groupBy(*SPOT).agg(
        blocks(F.lit(True)).alias("all"), blocks(~inner).alias("outer"), blocks(inner).alias("inner")
    )
    one = F.col("all") <= 1
    cut = cut.select(
        *SPOT,
        F.when(one, 1).otherwise(F.greatest("outer", F.lit(1))).alias("outer"),
        F.when(one, 0).otherwise(F.col("inner")).alias("inner"),
    )
    own = inner & (F.col("inner") > 0)
    block = F.when(own, F.col("outer") + F.expr("pmod(hash(rep), greatest(inner, 1))")).otherwise(
        F.expr("pmod(hash(rep), outer)")
    )
    row = F.struct("rep", "component", "value")
    filled = members.join(cut, SPOT).withColumn("block", block)
    filled = stage(filled.groupBy(*SPOT, "block", "outer", "inner").agg(F.collect_list(row).alias("rows")), "blocks")
    left = filled.filter("block < outer")
    none = F.lit(None).cast(filled.schema["rows"].dataType)
    alone = left.filter(F.size("rows") > 1).select(*SPOT, "rows", none.alias("other"))
    ahead = left.filter("block < outer + inner - 1")
    ahead = ahead.withColumn("with", F.explode(F.expr("sequence(block + 1, outer + inner - 1)")))
    behind = filled.filter("block > 0").select(*SPOT, F.col("block").alias("with"), F.col("rows").alias("other"))
    return alone.union(ahead.join(behind, [*SPOT, "with"]).select(*SPOT, "rows", "other"))


def _pair_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose pairs have about ``PAIR_BYTES`` in both sets together."""
    sizes = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in ("va", "vb")]
    part = np.cumsum(sizes[0] + sizes[1]) // PAIR_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def _jaccard(a: bytes, b: bytes, total: int) -> float:
    whole_a, ha, ia, ta = _opened(a, total)
    whole_b, hb, ib, tb = _opened(b, total)
    return weighted_jaccard(ha, ia * ta, hb, ib * tb, whole_a + whole_b)


def _verified(total: int, threshold: float):
    """(a, b, set a, set b) rows to the links among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pair_slices(batch):
                sets = zip(part.column("va").to_pylist(), part.column("vb").to_pylist())
                s = np.array([_jaccard(x, y, total) for x, y in sets])
                keep = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(keep), part.column("b").filter(keep), pa.array(s[s >= threshold])],
                    ["a", "b", "similarity"],
                )

    return run


def _levels(h: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A weighted set as a plain one: the n-th occurrence of a window is a feature of its own.
    Returns the features and the place of their window."""
    at = np.repeat(np.arange(len(h)), tf)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf)
    return mix(h[at] + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), at


def set_similarities(whole: np.ndarray, h: np.ndarray, idf: np.ndarray, tf: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every two sets of a block, given the sums of their weights."""
    f, at = _levels(h, tf.astype(np.int64))
    w, owner = idf[at], owner[at]
    _, at, col, n = np.unique(f, return_index=True, return_inverse=True, return_counts=True)
    shared = n > 1  # what one set has alone adds nothing in common
    place = np.cumsum(shared) - 1
    weight = np.sqrt(w[at[shared]])
    use = np.flatnonzero(shared[col])
    col, owner = place[col[use]], owner[use]
    common = np.zeros((len(whole),) * 2)
    wide = 1 << 14
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for k in range(0, len(weight), wide):
        a, b = np.searchsorted(col, [k, k + wide])
        m = np.zeros((len(whole), min(wide, len(weight) - k)), np.float32)
        m[owner[a:b], col[a:b] - k] = weight[col[a:b]]
        common += m @ m.T
    union = whole[:, None] + whole[None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1e-12), 0.0)


def similarities(texts: list[str], idf: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of every two texts."""
    h, tf, bounds = window_sets(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    w = idf.of(h)
    return set_similarities(np.bincount(owner, tf * w, len(texts)), h, w, tf, owner)


def _across(total: int, threshold: float):
    """Links between sets of different components in one block or two; the largest component's
    own ones are not compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                rows, other = batch.column("rows")[k], batch.column("other")[k]
                blocks = [x.values for x in (rows, other) if x.is_valid]
                own = len(blocks[0])
                part = np.concatenate([np.asarray(x.field("component")) for x in blocks])
                if (part == part[0]).all():
                    continue
                reps = np.concatenate([np.asarray(x.field("rep")) for x in blocks])
                values = [v for x in blocks for v in x.field("value").to_pylist()]
                whole, h, idf, tf = zip(*[_opened(v, total) for v in values])
                owner = np.repeat(np.arange(len(values)), [len(x) for x in h])
                sims = set_similarities(np.array(whole), *map(np.concatenate, (h, idf, tf)), owner)
                i, j = np.nonzero(np.triu(sims >= threshold - 1e-3, 1))
                keep = part[i] != part[j]
                if len(blocks) > 1:
                    keep &= (i < own) & (j >= own)
                for x, y in zip(i[keep], j[keep]):
                    if _jaccard(values[x], values[y], total) >= threshold:
                        found.append((int(reps[x]), int(reps[y])))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def marked(rows: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """``rows`` whose id may be among ``ids``: all that are, and few others as long as there are
    far fewer ids than ``MARKS``. A map of bits, ``MARKS / 8`` bytes whatever the input, is
    broadcast, so that a join on the ids shuffles few of the rows' sets."""
    slot = F.pmod(F.xxhash64(id), F.lit(MARKS))
    bucket, bit = F.shiftright(slot, 15).cast("int"), (slot % (1 << 15)).cast("int")
    bits = (
        ids.select(bucket.alias("_bucket"), bit.cast("long").alias("_bit"))
        .repartition("_bucket")
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    placed = rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0
    return placed.filter(is_set).select(*rows.columns)


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the smallest id with the same text (``rep``); ids must not be null."""
    keyed = docs.select(F.col(id).cast("long").alias(id), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_sha"))
    first = keyed.groupBy("_sha").agg(F.min(id).alias("rep"))
    return keyed.join(first, "_sha").select(id, "rep")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, rep (smallest id with an equal text), component_id (smallest
    id that similar documents lead to), kept (id = component_id). Rows with a null id are not
    compared: null component, kept."""
    known = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias(id), text)
    held, ranges, total = window_ranges(known, text)
    numbers = held.groupBy("range").applyInArrow(_returned(ranges), "part binary, range int, n binary")
    same = stage(classes(known, id, text), "text-classes")
    reps = same.filter(F.col(id) == F.col("rep")).select("rep").distinct()
    # Sets and draws of all documents, then the rows of representatives.
    contents = known.mapInArrow(_contents(id, text), "part binary, rows binary")
    drawn = contents.groupBy("part").cogroup(numbers.groupBy("part")).applyInArrow(_signatures(total, id, text), SIGNED)
    signed = stage(drawn.join(reps, "rep", "left_semi"), "signatures")
    keys = signed.select("rep", F.posexplode("keys").alias(*SPOT))
    crowded = keys.groupBy(*SPOT).agg(F.count("*").alias("m"), F.min("rep").alias("least")).filter("m > 1")
    members = stage(keys.join(crowded.select(*SPOT, "least"), SPOT), "candidates")
    least = least_matches(threshold)

    def sets_for(rep: DataFrame) -> DataFrame:
        rep = stage(rep.select("rep").distinct(), "wanted")
        return stage(marked(signed.select("rep", "value"), rep, "rep").join(rep, "rep", "left_semi"), "candidate-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(signed.select(F.col("rep").alias(side), F.col("sketch").alias(f"s{side}")), side)
        likely = stage(pairs.mapInArrow(_likely(least), "a long, b long"), "likely")
        sets = sets_for(likely.select(F.col("a").alias("rep")).union(likely.select("b")))
        full = likely
        for side in ("a", "b"):
            full = full.join(sets.select(F.col("rep").alias(side), F.col("value").alias(f"v{side}")), side)
        full = full.select("a", "b", "va", "vb")
        return stage(full.mapInArrow(_verified(total, threshold), "a long, b long, similarity double"), "links")

    # First step: against the smallest class of each bucket.
    star = members.filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    tried = stage(star.distinct(), "pairs")
    links = verify(tried).select("a", "b")

    def divided(linked: DataFrame) -> DataFrame:
        """Members of buckets with several components, with their own and the largest one."""
        placed = members.select(*SPOT, "rep").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
        placed = stage(placed.withColumn("component", F.coalesce("component", "rep")), "placed")
        sizes = placed.groupBy(*SPOT, "component").agg(F.count("*").alias("n"))
        largest = sizes.groupBy(*SPOT).agg(
            F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")
        )
        return stage(placed.join(largest.filter("parts > 1").drop("parts"), SPOT), "divided")

    for k in range(ROUNDS):
        left = divided(components(links))
        picked = left.filter("component = main").groupBy(*SPOT).agg(
            F.min_by("rep", F.xxhash64("rep", "key", F.lit(k))).alias("pick")
        )
        pairs = left.filter("component <> main").join(picked, SPOT)
        pairs = pairs.select(F.least("rep", "pick").alias("a"), F.greatest("rep", "pick").alias("b")).distinct()
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = stage(links.union(verify(pairs).select("a", "b")), "links")
        tried = tried.union(pairs)
    # Last step: what is left of the buckets, first by sketches, then by sets.
    left = divided(components(links))
    sketched = left.join(signed.select("rep", F.col("sketch").alias("value")), "rep")
    work = _block_pairs(sketched, SKETCH_BLOCK, BLOCK_BYTES).repartition(F.hash(*SPOT, "rows"))
    near = stage(work.mapInArrow(_promising(least), "band int, key long, rep long").distinct(), "promising")
    left = left.join(near, [*SPOT, "rep"])
    work = _block_pairs(left.join(sets_for(near), "rep"), BLOCK, BLOCK_BYTES).repartition(F.hash("rows"))
    links = links.union(stage(work.mapInArrow(_across(total, threshold), "a long, b long"), "links"))
    final = components(links)
    done = same.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    out = done.select(id, "rep", F.coalesce("component", "rep").alias("component_id"))
    nulls = docs.filter(F.col(id).isNull()).select(
        F.col(id).cast("long").alias(id), F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("component_id")
    )
    whole = out.unionByName(nulls)
    return whole.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
