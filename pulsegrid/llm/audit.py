"""How filters overlap: what each removes in every order of applying them.

Posting lists: the numbers of the rows that fail a filter, ascending, one list per part of the
table, filter and range of ``1 << RANGE`` numbers; two more lists hold the rows with a label. A
range's lists fit in a task whatever the part's size. A filter applied after others removes the
difference between its list and the union of theirs, so the unions of all sets of filters and the
differences of every filter from every set not containing it are worked out per range by
galloping merges, and their sizes are summed over the ranges. All orders follow from these
sizes, since a step's counts depend on the set of earlier filters alone.

Galloping: from its place in a sorted list, a search doubles its step until it has passed the
number wanted and then halves the bracket; runs of a list that no other list interrupts are
taken whole.

Rows are numbered by the operator, so rows that share an id, or have none, are rows of their
own. A null text is an empty one, a null part the empty string. A row fails ``E`` only where an
equal text has a smaller id; a null id is neither smaller nor larger than any. A label counts if
any of the labels' rows of that id has it. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, texts_of
from pulsegrid.plans.staging import stage

FILTERS = "ABCDE"
RANGE = 14
TASK_ROWS = 1 << 16
LABELS = ("good", "toxic")
#: Texts that more than this share of all rows have are looked up in a broadcast table, which so
#: has at most ``1 / HEAVY`` rows.
HEAVY = 1e-4
_EVERY = (1 << len(FILTERS)) - 1
#: (set of earlier filters, filter) in the order in which sizes are kept.
STEPS = [(s, f) for s in range(_EVERY + 1) for f in range(len(FILTERS)) if not s >> f & 1]


# --- sorted lists -------------------------------------------------------------------------


def gallop(ids: Sequence[int], wanted: int, at: int) -> int:
    """First place from ``at`` on whose number is at least ``wanted``."""
    step, n = 1, len(ids)
    while at + step < n and ids[at + step] < wanted:
        at += step
        step <<= 1
    return bisect_left(ids, wanted, at, min(at + step + 1, n))


def union(lists: Sequence[list[int]]) -> list[int]:
    """Numbers of any list, once each."""
    out: list[int] = []
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heads)
    while heads:
        head, k, at = heads[0]
        ids = lists[k]
        if len(heads) == 1:
            out.extend(ids[at:] if not out or out[-1] < head else ids[at + 1 :])
            break
        limit = min(h[0] for h in heads[1:3])
        end = gallop(ids, limit, at) if head < limit else at + 1
        out.extend(ids[at:end] if not out or out[-1] < head else ids[at + 1 : end])
        if end < len(ids):
            heapq.heapreplace(heads, (ids[end], k, end))
        else:
            heapq.heappop(heads)
    return out


def difference(ids: list[int], other: list[int]) -> list[int]:
    """Numbers of ``ids`` that ``other`` does not have."""
    out: list[int] = []
    i = j = 0
    while i < len(ids):
        j = gallop(other, ids[i], j) if j < len(other) else j
        if j >= len(other):
            out.extend(ids[i:])
            break
        if other[j] == ids[i]:
            i += 1
            continue
        end = gallop(ids, other[j], i)
        out.extend(ids[i:end])
        i = end
    return out


def common(ids: list[int], other: list[int]) -> int:
    """How many numbers both lists have."""
    n = i = j = 0
    while i < len(ids) and j < len(other):
        if ids[i] == other[j]:
            n, i, j = n + 1, i + 1, j + 1
        elif ids[i] < other[j]:
            i = gallop(ids, other[j], i)
        else:
            j = gallop(other, ids[i], j)
    return n


def sizes_of(lists: Sequence[list[int]], labelled: Sequence[list[int]]) -> np.ndarray:
    """Per entry of ``STEPS``: rows failing the set before, rows the filter removes after it, and
    how many of these have each label."""
    before = [union([ids for f, ids in enumerate(lists) if s >> f & 1]) for s in range(_EVERY + 1)]
    out = np.zeros((len(STEPS), 2 + len(labelled)), np.int64)
    for k, (s, f) in enumerate(STEPS):
        removed = difference(lists[f], before[s])
        out[k] = [len(before[s]), len(removed), *(common(removed, ids) for ids in labelled)]
    return out


# --- rows to lists ------------------------------------------------------------------------

_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"


def _fails(text: str) -> tuple[int, bytes]:
    """Bits of the filters A to D that a text fails, and its digest."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the bytes 9 to 13 and 32
    upper = len(data) - len(data.translate(None, _UPPER))
    bits = (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * upper > 5 * len(text)) << 2
        | (len(data.translate(None, _SIGNS)) != len(data)) << 3
    )
    return bits, sha256(data).digest()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            bits, digests = zip(*map(_fails, texts_of(part, "text")))
            columns = [part.column("id"), part.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "bits", "sha"])


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: number, part, bits of the filters it fails, labels."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    rows = texts.mapInArrow(_judge, "id long, part string, bits int, sha binary")
    rows = stage(rows.withColumn("number", F.monotonically_increasing_id()), "audit-rows")
    # Texts of several rows; those of very many are few, and need no shuffle of their rows.
    same = rows.groupBy("sha").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    same = stage(same.filter("n > 1"), "audit-texts")
    limit = HEAVY * rows.count()
    heavy = F.broadcast(same.filter(F.col("n") > limit).select("sha", "least"))
    light = same.filter(F.col("n") <= limit).select("sha", "least")
    few = rows.join(heavy, "sha", "left_anti").join(light, "sha", "left")
    whole = rows.join(heavy, "sha").select(*rows.columns, "least").union(few.select(*rows.columns, "least"))
    marks = [F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*marks)
    known = known.select("id", F.col("quality").alias("good"), "toxic")
    named = whole.filter("id is not null").join(known, "id", "left")
    none = [F.lit(None).cast("int").alias(c) for c in LABELS]
    nameless = whole.filter("id is null").select("*", *none)
    marked = named.select(*whole.columns, *LABELS).union(nameless)
    bits = F.col("bits").bitwiseOR(F.when(F.col("id") > F.col("least"), 16).otherwise(0))
    return marked.select(
        "number", "part", bits.alias("bits"), *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in LABELS]
    )


def posting_lists(flagged: DataFrame) -> DataFrame:
    """Per part and range of numbers: rows, and an ascending list per filter and label."""
    listed = lambda which, name: F.sort_array(F.collect_list(F.when(which, F.col("number")))).alias(name)
    failing = [listed(F.col("bits").bitwiseAND(1 << f) != 0, x) for f, x in enumerate(FILTERS)]
    labelled = [listed(F.col(c), c) for c in LABELS]
    ranges = flagged.groupBy("part", F.shiftright("number", RANGE).alias("range"))
    return ranges.agg(F.count("*").alias("n"), *failing, *labelled)


_SIZES = "part string, step int, n long, before long, removed long, good long, toxic long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists to sizes, one row per part of a batch and entry of ``STEPS``."""
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        lists = [batch.column(x) for x in [*FILTERS, *LABELS]]
        for k, (part, n) in enumerate(zip(batch.column("part").to_pylist(), batch.column("n").to_pylist())):
            ids = [c[k].as_py() for c in lists]
            got = sizes_of(ids[: len(FILTERS)], ids[len(FILTERS) :])
            got = np.column_stack([np.full(len(STEPS), n, np.int64), got])
            sums[part] = sums[part] + got if part in sums else got
        for part, got in sums.items():
            columns = [pa.array([part] * len(STEPS)), pa.array(np.arange(len(STEPS)), pa.int32())]
            names = ["part", "step", "n", "before", "removed", *LABELS]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(c)) for c in got.T], names)


def set_sizes(lists: DataFrame) -> DataFrame:
    """Per part, set of earlier filters (bits) and filter: rows of the part, rows failing the set,
    rows the filter removes after it, and labelled ones among them."""
    parts = lists.mapInArrow(_measure, _SIZES)
    sums = [F.sum(c).alias(c) for c in ("n", "before", "removed", *LABELS)]
    return parts.groupBy("part", "step").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    spark = docs.sparkSession
    lists = stage(posting_lists(flags(docs, labels)), "audit-lists")
    # Merging costs far more than reading the lists: tasks by rows, not by bytes.
    tasks = (lists.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS + 1
    sizes = stage(set_sizes(lists.repartition(tasks, "part", "range")), "audit-sizes")
    last = len(FILTERS) - 1
    # What a filter removes after a set, summed over the orders that begin with that set.
    facts = [
        (k, s, f, factorial(s.bit_count()) * factorial(last - s.bit_count())) for k, (s, f) in enumerate(STEPS)
    ]
    named = spark.createDataFrame(facts, "step int, earlier int, filter int, orders long")
    sizes = sizes.join(F.broadcast(named), "step").drop("step")
    alone = F.expr(f"earlier = {_EVERY} - shiftleft(1, filter)")
    totals = sizes.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("earlier") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    orders = [
        ("".join(FILTERS[f] for f in order), step + 1, sum(1 << f for f in order[:step]), order[step])
        for order in permutations(range(len(FILTERS)))
        for step in range(len(FILTERS))
    ]
    plan = spark.createDataFrame(orders, "filter_order string, step int, earlier int, filter int")
    steps = sizes.drop("orders").join(F.broadcast(plan), ["earlier", "filter"]).join(totals, ["part", "filter"])
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.col("before") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )
