"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the corpus's frequent chunks and their lengths, broadcast compactly;
tier two a bounded cache in each Python worker, filled by the library. Chunks are never
shuffled: only each task's summary of its most frequent ones is, at most ``PER_TASK`` rows
whatever the task reads. The table only saves work; the counts are exact with any table.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.chunks import CACHE_ENTRIES, PieceCounter
from pulsegrid.llm.common import tokenizer_path

FREQUENT = 65_536  # chunks in the broadcast table, about 1 MB
PER_TASK = 32_768  # chunks a task reports

_MARK = "▁"
_counters: dict[str, PieceCounter] = {}
_tables: dict[str, dict[str, int]] = {}
_caches: dict[str, dict[str, int]] = {}


def _counter(model: str) -> PieceCounter:
    if model not in _counters:
        _counters[model] = PieceCounter(tokenizer_path(model))
    return _counters[model]


def _summaries(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(text).to_pylist():
                if x and _MARK not in x:
                    counts.update(PieceCounter.split(x))
                    if len(counts) > 16 * PER_TASK:  # keep what is frequent so far
                        counts = Counter(dict(counts.most_common(4 * PER_TASK)))
        top = [(k, n) for k, n in counts.most_common(PER_TASK) if n > 1]
        if top:
            keys, n = zip(*top)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["chunk", "n"])

    return run


def frequent_chunks(docs: DataFrame, text: str = "text", top: int = FREQUENT) -> list[str]:
    """The most frequent chunks over all documents, from per-task summaries."""
    parts = docs.select(text).mapInArrow(_summaries(text), "chunk string, n long")
    ranked = parts.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk")
    return [r.chunk for r in ranked.limit(top).collect() if "\0" not in r.chunk]


def count_tokens(
    docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", top: int = FREQUENT
) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` in place of its text column."""
    keys = frequent_chunks(docs, text, top)
    lengths = _counter(model).lengths(keys) if keys else []
    sc = docs.sparkSession.sparkContext
    version = uuid.uuid4().hex
    table = sc.broadcast((b"\0".join(k.encode() for k in keys), lengths))
    names = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    fields = [f for f in docs.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        if version not in _tables:
            blob, sizes = table.value
            _tables.clear()
            _tables[version] = dict(zip((p.decode() for p in blob.split(b"\0")), sizes))
        frequent, cache = _tables[version], _caches.setdefault(model, {})
        for batch in batches:
            n_bytes, n_tokens = [], []
            for x in batch.column(text).to_pylist():
                x = x or ""
                n_bytes.append(len(x.encode()))
                if _MARK in x:
                    n_tokens.append(counter.whole(x))
                    continue
                keys = counter.split(x)
                got = list(map(frequent.get, keys))
                if None in got:
                    rest = [k for k, n in zip(keys, got) if n is None]
                    missing = [k for k in dict.fromkeys(rest) if k not in cache]
                    if len(cache) + len(missing) > CACHE_ENTRIES:
                        cache.clear()
                        missing = list(dict.fromkeys(rest))
                    cache.update(zip(missing, counter.lengths(missing)))
                    got = [n for n in got if n is not None] + [cache[k] for k in rest]
                n_tokens.append(sum(got))
            kept = [batch.column(c) for c in names]
            new = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(kept + new, names + ["n_bytes", "n_tokens"])

    return docs.select(*names, text).mapInArrow(lookup, schema)
