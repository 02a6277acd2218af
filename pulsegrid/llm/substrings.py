"""Repeated passages across documents by suffix automata of reference shards.

The words of a document that lie in a window of ``WINDOW`` words which also starts in a document
with a smaller id are removed. Documents are streamed through suffix automata of the documents
before them: the matching statistics, the length of the longest string ending at a word that the
automaton knows, reach ``WINDOW`` exactly at the ends of such windows, and the spans they cover
are the maximal ones.

No automaton of all documents would fit a task, and streaming all documents through every shard
would be quadratic. So a document meets only the shards that can hold its windows:

- Passages that many documents share (``HOT`` of all) are few: a corpus whose documents have w
  words on average has at most ``w / HOT`` windows of that kind, and at most ``HOT_WINDOWS`` are
  taken, the most frequent ones. Their automaton, with the least id per window, is broadcast, and
  every document is streamed through it where it lies.
- Every other window has an anchor, the smallest hash of its runs of ``GRAM`` words that are not
  hot themselves (the window itself if all are): equal windows have equal anchors. Anchors that
  one document has alone are dropped. Stretches whose anchors remain go to the shard of the least
  document with that anchor, so all documents with a window meet in one shard, and copies of a
  text as one long stretch; anchors of more than ``CROWD`` entries have shards of their own, so
  that no shard gets all of a large group. A shard streams its stretches in the order of their ids through the
  automaton of those before, then adds them to it.

Hashes only choose where a stretch is sent; words are compared as they are. Windows are judged on
the input. Null and empty texts have no words. Rows without an id are neither smaller nor larger
than others: nothing is removed from them and they remove nothing. Rows that share an id are
not smaller than each other. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import mix, powers, slices, texts_of, words
from pulsegrid.plans.staging import stage

WINDOW, GRAM = 13, 6
HOT, HOT_WINDOWS, HOT_GRAMS = 0.004, 20_000, 100_000
ANCHORS_PER_SHARD, WORDS_PER_SHARD = 500_000, 200_000
#: Entries of an anchor from which on they meet at the anchor's own shard.
CROWD = 200
_U = np.uint64
_NEVER = _U(0xFFFFFFFFFFFFFFFF)


class Automaton:
    """Suffix automaton of several strings of words, which can be added to."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """State of the strings of ``q`` that end after ``p``: ``q`` itself or a copy of it."""
        nxt, link, length = self.next, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], dict(nxt[q]))
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, string: Sequence) -> int:
        """Add a string; returns the state of all of it."""
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in string:
            q = nxt[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, c, nxt[p][c])
            last = new
        return last

    def ends(self, string: Sequence, least: int) -> Iterator[tuple[int, int]]:
        """Places where a match of at least ``least`` words ends, and the state it ends in."""
        nxt, link, length = self.next, self.link, self.length
        state, n = 0, 0
        for i, c in enumerate(string):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state, n = to, n + 1
            if n >= least:
                yield i, state


def spans_of(ends: Iterator[int], width: int) -> list[tuple[int, int]]:
    """Maximal runs of words, first and one past the last, under windows that end at ``ends``."""
    out: list[list[int]] = []
    for end in ends:
        if out and end - width < out[-1][1]:
            out[-1][1] = end + 1
        else:
            out.append([end - width + 1, end + 1])
    return [(a, b) for a, b in out]


# --- fingerprints ---------------------------------------------------------------------------


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places are not to be used."""
    acc = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        acc[: len(hashes) - k] += hashes[k:] * powers(n + 1)[k + 1]
    return mix(acc + _U(n))


def _owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _starts(bounds: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Places where n words of one document start."""
    return np.flatnonzero(np.arange(len(owner)) + n <= bounds[1:][owner])


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _frequent(share: float):
    """Windows (kind 0) and runs (kind 1) that many of a slice's documents have, with the number of
    these; and the slice's documents and words (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = words(texts_of(part, "text"))
                owner = _owners(bounds)
                least = max(3, int(np.ceil(share * part.num_rows)))
                kinds, values, counts = [[2]], [np.array([len(h)])], [np.array([part.num_rows])]
                for kind, n in enumerate((WINDOW, GRAM)):
                    at = _starts(bounds, owner, n)
                    v, d = _runs(h, n)[at], owner[at]
                    order = np.argsort(v, kind="stable")
                    v, d = v[order], d[order]
                    new = np.diff(v, prepend=~v[:1]) != 0
                    first = np.flatnonzero(new)
                    once = new | (np.diff(d, prepend=-1) != 0)
                    seen = np.add.reduceat(once.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                    often = seen >= least
                    kinds.append([kind] * int(often.sum()))
                    values.append(v[first[often]].view(np.int64))
                    counts.append(seen[often])
                columns = [np.concatenate(x) for x in (kinds, values, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2])],
                    ["kind", "value", "n"],
                )

    return run


def _anchors(hot, shards: int):
    """Runs of windows with one anchor, packed per slice and shard of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, grams = hot.value
        wide = WINDOW - GRAM + 1
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = words(texts_of(part, "text"))
                owner = _owners(bounds)
                at = _starts(bounds, owner, WINDOW)
                if not len(at):
                    continue
                value = _runs(h, GRAM)
                value[_member(value, grams)] = _NEVER
                least, span = value, 1
                while span < wide:  # doubling, the last step overlaps
                    step = min(span, wide - span)
                    shifted = np.concatenate([least[step:], np.full(step, _NEVER)])
                    least, span = np.minimum(least, shifted), span + step
                whole = _runs(h, WINDOW)[at]
                anchor, place, doc = least[at], at - bounds[:-1][owner[at]], owner[at]
                anchor = np.where(anchor == _NEVER, whole, anchor)
                cold = ~_member(whole, windows)
                anchor, place, doc = anchor[cold], place[cold], doc[cold]
                if not len(anchor):
                    continue
                new = np.ones(len(anchor), bool)
                new[1:] = (np.diff(anchor) != 0) | (np.diff(doc) != 0) | (np.diff(place) != 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(anchor))).astype("<u4")
                anchor, place, doc = anchor[first], place[first], doc[first]
                shard = ((mix(anchor + _U(1)) >> _U(33)) % _U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                ids = np.asarray(part.column("id"))
                tags = np.asarray(part.column("tag"))
                planes = [anchor, ids[doc], tags[doc], place.astype("<u4"), n]
                planes = [p[order] for p in planes]
                rows = list(zip(cuts, [*cuts[1:], len(order)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[order][cuts], pa.int64()),
                        *[pa.array([p[a:b].tobytes() for a, b in rows], pa.binary()) for p in planes],
                    ],
                    ["shard", *_PLANES],
                )

    return run


_PLANES = {"anchor": np.uint64, "id": np.int64, "tag": np.int64, "place": "<u4", "n": "<u4"}


def _shared(crowd: int):
    """Of a shard's entries those whose anchor several ids have, and what they meet at: the least
    of these ids, so that a copy stays in one stretch, or the anchor itself where many have it, so
    that a group of copies is spread over the shards of its anchors."""

    def run(table: pa.Table) -> pa.Table:
        anchor, id, tag, place, n = (
            np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
            for name, kind in _PLANES.items()
        )
        order = np.lexsort((id, anchor))
        a, d = anchor[order], id[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        size = np.diff(np.append(first, len(a)))
        least, most = d[first], d[first + size - 1]
        keep = np.repeat(least != most, size)
        at = order[keep]
        meets = np.where(size > crowd, a[first].view(np.int64), least)
        columns = [id[at], tag[at], place[at].astype(np.int32), n[at].astype(np.int32), np.repeat(meets, size)[keep]]
        return pa.table([pa.array(c) for c in columns], ["id", "tag", "place", "n", "meets"])

    return run


# --- automata ---------------------------------------------------------------------------------


def _stretches(shards: int):
    """Documents with their shared entries to the stretches that go to each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {"shard": [], "id": [], "tag": [], "place": [], "stretch": []}
                entries = part.column("entries")
                for k, text in enumerate(texts_of(part, "text")):
                    own = text.encode("utf-8", "surrogatepass").split()
                    got = entries[k].values
                    place, n, meets = (np.asarray(got.field(x)) for x in ("place", "n", "meets"))
                    shard = ((mix(meets) >> _U(33)) % _U(shards)).astype(np.int64)
                    order = np.argsort(place, kind="stable")
                    place, end, shard = place[order], (place + n)[order], shard[order]
                    new = np.ones(len(place), bool)
                    new[1:] = (place[1:] != end[:-1]) | (shard[1:] != shard[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(place)) - 1
                    for a, b in zip(first, last):
                        out["shard"].append(int(shard[a]))
                        out["place"].append(int(place[a]))
                        out["stretch"].append(b" ".join(own[place[a] : end[b] + WINDOW - 1]))
                    out["id"] += [part.column("id")[k].as_py()] * len(first)
                    out["tag"] += [part.column("tag")[k].as_py()] * len(first)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(v, t) for v, t in zip(out.values(), types)]
                yield pa.RecordBatch.from_arrays(columns, list(out))

    return run


def _late(table: pa.Table) -> pa.Table:
    """A shard's stretches to the spans that documents of smaller ids have."""
    table = table.sort_by([("id", "ascending"), ("stretch", "ascending")])
    ids, tags, places = (table.column(c).to_pylist() for c in ("id", "tag", "place"))
    stretches = table.column("stretch")
    known, codes = Automaton(), {}
    out: list[tuple[int, int, int, int]] = []
    waiting: list[list[int]] = []  # of the id in hand
    before = None
    for k, id in enumerate(ids):
        string = [codes.setdefault(w, len(codes)) for w in stretches[k].as_py().split(b" ")]
        if k and id != ids[k - 1]:
            for s in waiting:
                known.add(s)
            waiting, before = [], None
        for a, b in spans_of((i for i, _ in known.ends(string, WINDOW)), WINDOW):
            out.append((id, tags[k], places[k] + a, places[k] + b))
        if string != before:  # rows of one id may repeat
            waiting.append(string)
        before = string
    columns = list(zip(*out)) or [[]] * 4
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["id", "tag", "first", "past"])


def _first_holders(hot):
    """Hot windows of a slice, as words, with the least id that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, _ = hot.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                h, bounds = words(texts)
                owner = _owners(bounds)
                at = _starts(bounds, owner, WINDOW)
                value = _runs(h, WINDOW)[at]
                some = _member(value, windows)
                at, value = at[some], value[some]
                ids = np.asarray(part.column("id"))[owner[at]]
                order = np.lexsort((ids, value))
                first = order[np.flatnonzero(np.diff(value[order], prepend=~value[order][:1]) != 0)]
                split: dict[int, list[bytes]] = {}
                found = []
                for k in first:
                    d = int(owner[at[k]])
                    if d not in split:
                        split[d] = texts[d].encode("utf-8", "surrogatepass").split()
                    place = at[k] - bounds[d]
                    found.append(b" ".join(split[d][place : place + WINDOW]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), pa.array(ids[first], pa.int64())], ["window", "least"]
                )

    return run


class _HotPassages:
    """Automaton of the hot windows, which knows the least id of each."""

    def __init__(self, windows: list[tuple[bytes, int]]):
        self.codes: dict[bytes, int] = {}
        self.automaton = Automaton()
        strings = [[self.codes.setdefault(w, len(self.codes)) for w in x.split(b" ")] for x, _ in windows]
        for s in strings:
            self.automaton.add(s)
        # States are final only now: adding a string may split those of others.
        self.least = {state: id for s, (_, id) in zip(strings, windows) for _, state in self.automaton.ends(s, WINDOW)}

    def late(self, own: list[bytes], id: int) -> list[tuple[int, int]]:
        if not self.least:
            return []
        get, least = self.codes.get, self.least
        found = self.automaton.ends(map(get, own), WINDOW)
        return spans_of((i for i, state in found if least[state] < id), WINDOW)


def _cut(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = hot.value
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
                for id, text, spans in zip(
                    part.column("id").to_pylist(), texts_of(part, "text"), part.column("spans").to_pylist()
                ):
                    own = text.encode("utf-8", "surrogatepass").split()
                    found = [(s["first"], s["past"]) for s in spans or ()]
                    if id is not None:
                        found += passages.late(own, id)
                    merged: list[list[int]] = []
                    for a, b in sorted(found):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    kept, end = [], 0
                    for a, b in merged:
                        kept += own[end:a]
                        end = b
                    kept += own[end:]
                    out["n_words"].append(len(own))
                    out["n_removed"].append(len(own) - len(kept))
                    out["spans"].append([{"first": a, "past": b} for a, b in merged])
                    out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                span = pa.struct([("first", pa.int32()), ("past", pa.int32())])
                types = [pa.int64(), pa.int64(), pa.list_(span), pa.string()]
                columns = [pa.array(v, t) for v, t in zip(out.values(), types)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", *out])

    return run


def remove_repeated(
    docs: DataFrame, id: str = "doc_id", text: str = "text", hot: float = HOT, crowd: int = CROWD
) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (maximal removed runs of words: first
    and one past the last), kept (words that stay, joined by single spaces)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    tagged = texts.withColumn("tag", F.xxhash64("text"))
    named = tagged.filter("id is not null and text is not null")

    seen = stage(named.select("text").mapInArrow(_frequent(hot), "kind int, value long, n long"), "hot-counts")
    total = seen.filter("kind = 2").agg(F.sum("n"), F.sum("value")).first()
    rows, n_words = total[0] or 0, total[1] or 0
    often = seen.filter("kind < 2").groupBy("kind", "value").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot * rows)
    # The most frequent ones, a fixed number; the others are found by their anchors.
    taken = [
        often.filter(F.col("kind") == kind).orderBy(F.desc("n"), "value").limit(most).select("value").toArrow()
        for kind, most in enumerate((HOT_WINDOWS, HOT_GRAMS))
    ]
    known = [np.sort(t.column(0).to_numpy().astype(np.int64).view(np.uint64)) for t in taken]
    hot_values = sc.broadcast(known)
    firsts = []
    if len(known[0]):
        held = named.select("id", "text").mapInArrow(_first_holders(hot_values), "window binary, least long")
        firsts = held.groupBy("window").agg(F.min("least").alias("least")).collect()  # HOT_WINDOWS rows
    passages = sc.broadcast(_HotPassages([(bytes(r["window"]), r["least"]) for r in firsts]))

    shards = int(n_words * 2 / (WINDOW - GRAM + 2) / ANCHORS_PER_SHARD) + 1
    packed = named.mapInArrow(
        _anchors(hot_values, shards), "shard long, anchor binary, id binary, tag binary, place binary, n binary"
    )
    shared = packed.groupBy("shard").applyInArrow(_shared(crowd), "id long, tag long, place int, n int, meets long")
    shared = stage(shared, "shared-anchors")
    amount = shared.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
    entries = shared.groupBy("id", "tag").agg(F.collect_set(F.struct("place", "n", "meets")).alias("entries"))
    meeting = named.join(entries, ["id", "tag"]).select("id", "tag", "text", "entries")
    stretches = meeting.mapInArrow(
        _stretches(int(amount / WORDS_PER_SHARD) + 1), "shard long, id long, tag long, place int, stretch binary"
    )
    late = stretches.groupBy("shard").applyInArrow(_late, "id long, tag long, first int, past int")
    spans = stage(late, "late-spans").groupBy("id", "tag").agg(F.collect_set(F.struct("first", "past")).alias("spans"))
    joined = tagged.join(spans, ["id", "tag"], "left").select("id", "text", "spans")
    out = joined.mapInArrow(
        _cut(passages), "id long, n_words long, n_removed long, spans array<struct<first:int,past:int>>, kept string"
    )
    return out.withColumnRenamed("id", id)
