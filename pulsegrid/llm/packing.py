"""Best-fit packing in bulk-synchronous rounds.

Documents are tokenized and cut into pieces, and the pieces are range-sorted by length and
numbered inside each length by a distributed sort. From then on pieces of one length are
alike but for their rank, and so are gaps of one size: both are kept as runs of consecutive
ranks. A round sweeps the lengths from long to short; the pieces of each length take their
successor, the smallest open gap that holds them. Where more pieces want a gap size than
there are gaps, lower ranks take them and the others look at the next larger size. Each gap
takes one piece a round; then the gaps are updated and the next round begins. Pieces that no
gap holds open sequences. The number of runs depends on the capacity alone, never on the
number of documents, so a sweep matches runs and the pieces learn their places in one join
with the (small) table of matches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.chunks import ByteBpe
from pulsegrid.plans.ordering import with_position
from pulsegrid.plans.staging import stage

CAPACITY = 1024
END_ID = 2

_encoders: dict[tuple[str, str], ByteBpe] = {}


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on request, ids.

    A document's ids end with ``end_id``. Documents of more than ``capacity`` ids are cut into
    pieces of that many; the first one takes the remainder. Null text counts as empty and has
    one piece of one id. Rows with equal or null doc_id are separate documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, ranks)
        if key not in _encoders:
            _encoders[key] = ByteBpe(*key)
        encode, end = _encoders[key].encode, np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text or "") + end
                at, k = 0, 0
                while at < len(data):
                    to = at + ((len(data) - at) % width or width)
                    part = data[at:to]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<u4").astype(np.int32),) if ids else row)
                    at, k = to, k + 1
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if ids else ""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return plain.mapInArrow(run, schema)


def match_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best fit over runs of equal pieces.

    ``counts``: pieces by length. Returns rows (length, first rank, ranks, opener's length,
    opener's first rank, offset): the pieces of those ranks lie in the sequences that the
    pieces of the opener's ranks opened, at the offset, one in each.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)  # ranks placed so far
    placed: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # size -> runs (opener, first rank, ranks)

    def open_sequences(s: int, n: int) -> None:
        placed.append((s, used[s], n, s, used[s], 0))
        if s < capacity:
            gaps.setdefault(capacity - s, []).append((s, used[s], n))
        used[s] += n
        left[s] -= n

    for s in sorted(left, reverse=True):
        if 2 * s > capacity:  # no two of these share a sequence
            open_sequences(s, left[s])
    while any(left.values()):
        moved: dict[int, list[tuple[int, int, int]]] = {}
        sizes = sorted(gaps)
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            for g in sizes[int(np.searchsorted(sizes, s)) :]:
                runs = gaps[g]
                while runs and left[s]:
                    opener, first, n = runs.pop()
                    take = min(n, left[s])
                    if take < n:
                        runs.append((opener, first + take, n - take))
                    placed.append((s, used[s], take, opener, first, capacity - g))
                    if g > s:
                        moved.setdefault(g - s, []).append((opener, first, take))
                    used[s] += take
                    left[s] -= take
                if not left[s]:
                    break
        if not moved and not any(n and any(g >= s and gaps[g] for g in gaps) for s, n in left.items()):
            # Nothing fits: the longest pieces open as many sequences as the rest needs at least.
            need = -(-sum(s * n for s, n in left.items()) // capacity)
            for s in sorted((s for s, n in left.items() if n), reverse=True):
                n = min(need, left[s])
                open_sequences(s, n)
                need -= n
                if not need:
                    break
        for g, runs in moved.items():
            gaps.setdefault(g, []).extend(runs)
        gaps = {g: _joined(runs) for g, runs in gaps.items() if runs}
    return placed


def _joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring runs of one opener as one."""
    out: list[tuple[int, int, int]] = []
    for opener, first, n in sorted(runs):
        if out and out[-1][0] == opener and out[-1][1] + out[-1][2] == first:
            out[-1] = (opener, out[-1][1], out[-1][2] + n)
        else:
            out.append((opener, first, n))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``pieces``.

    Ties in length are ranked by doc_id and piece; repeated rows keep separate places. The
    sequence id is made of the length and rank of the piece that opened the sequence.
    """
    spark = cut.sparkSession
    staged = stage(cut, "pieces")
    # Null ids sort first and repeated ids need an order too: any is right.
    ranked = with_position(staged, ["length"], ["doc_id", "piece"], "_rank")
    counts = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count("*").alias("n")).collect()}
    matches = match_runs(counts, capacity)
    schema = "length long, _first long, _n long, _opener long, _base long, offset long"
    table = F.broadcast(spark.createDataFrame(matches, schema))  # bounded by the capacity
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n"))
    joined = ranked.alias("p").join(table.alias("m"), (F.col("p.length") == F.col("m.length")) & inside)
    sequence = F.shiftleft("_opener", 44) + F.col("_base") + F.col("_rank") - F.col("_first")
    return joined.select(*[F.col(f"p.{c}") for c in cut.columns], sequence.alias("sequence_id"), "offset")
