"""Sampled segmentations of texts into pieces, without replacement, and decoding.

A text's lattice holds every way to spell it with the pieces of a sentencepiece model. Since no
piece spans words, the lattice is a chain of word lattices; the probability of a way is the
product of its pieces' probabilities, normalised by a backward pass. Perturbing every complete
way with Gumbel noise and taking the k largest is a sample of k distinct ways without
replacement; an A-star search from the root finds them without listing ways: a node is the set
of ways that share a beginning, its key the largest perturbed value among them, drawn top down.
The best node's way is followed to its end by drawing each piece from its probability, and the
ways that leave it at each piece become new nodes with keys below its own. Noise comes from a
hash of the row key, so a row's result does not depend on partitions or neighbours.

Each way comes with its log probability and its inclusion score: the log probability that it is
among the k ways with the largest values, given the value of the next one.

Scores: a unigram model's pieces have log probabilities; a merge model's have ranks, which
become probabilities by Zipf's law (1 / (rank + 10)). ``smoothing`` raises them to a power.
Characters that no piece spells become byte pieces.

Null and empty texts have one way, the empty one, with log probability 0 and inclusion 0; texts
with fewer than k ways give as many rows as there are. Repeated rows give repeated results. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.common import mix, slices, texts_of, tokenizer_path, uniform

WAYS = 2
SMOOTHING = 0.5
SLICE = 1_000_000  # bytes of text worked on together
PART = 40_000  # characters of new words whose edges are made together
STATES = 3_000_000  # characters of distinct words whose lattices a worker keeps; then it starts anew
_U = np.uint64
_models: dict[tuple[str, float], "Pieces"] = {}
_CHAR = _U(0x9E3779B97F4A7C15)
_BITS = 20


class Pieces:
    """Vocabulary of a model as sorted arrays over code point hashes."""

    def __init__(self, path: str, smoothing: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in normal])
        merges = score.min() <= -1000  # ranks, not log probabilities
        logp = -np.log(np.arange(len(normal)) + 10.0) if merges else score
        logp = logp - np.log(np.exp(logp).sum())
        text = [names[i] for i in normal]
        size = np.array([len(t) for t in text])
        self.longest = int(size.max())
        chars = np.frombuffer("".join(t.ljust(self.longest, "\0") for t in text).encode("utf-32-le"), np.uint32)
        chars = chars.reshape(len(text), self.longest)
        self.begins = np.zeros(1 << _BITS, bool)  # hashes of beginnings of pieces; may be another's
        h = np.zeros(len(text), np.uint64)
        for j in range(self.longest):
            on = size > j
            h[on] = mix(h[on] * _CHAR + chars[on, j].astype(np.uint64) + _U(1))
            self.begins[h[on] >> _U(64 - _BITS)] = True
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array(normal, np.int64)[order]
        # Where pieces start that share the first bits of a hash, and how many at most do.
        shared = self.hash >> _U(64 - _BITS)
        heads = np.flatnonzero(np.diff(shared, prepend=shared[:1] - _U(1)))
        self.slot = np.full(1 << _BITS, -1, np.int32)
        self.slot[shared[heads]] = heads
        self.most = int(np.diff(np.append(heads, len(shared))).max())
        self.logp = smoothing * logp[order]
        self.byte_ids = np.full(256, -1)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.unknown = sp.unk_id()
        self.byte_logp = smoothing * (logp.min() - 10.0)
        # What a piece stands for when decoding.
        spelled = [p.replace("▁", " ").encode() for p in names]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                spelled[i] = bytes([b])
        spelled[self.unknown] = " ⁇ ".encode()
        for i in range(n):
            if sp.is_control(i):
                spelled[i] = b""
        self.spelled = pa.array(spelled, pa.binary())
        self.lattice = Lattice(self)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of pieces; the mark that encoding puts in front goes. Null for null."""
        flat = self.spelled.take(ids.flatten())
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, flat), b"")
        bare = pc.if_else(pc.starts_with(joined, b" "), pc.binary_replace_slice(joined, 0, 1, b""), joined)
        try:
            text = bare.cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8
            text = pa.array([b.decode("utf-8", "replace") for b in bare.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1024, dtype), 0

    def extend(self, new: np.ndarray) -> None:
        if self.n + len(new) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(self.n + len(new), self.data.dtype)])
        self.data[self.n : self.n + len(new)] = new
        self.n += len(new)


class Lattice:
    """All edges of the distinct words met so far, with their conditional probabilities.

    States are the characters of the words laid end to end, each word with an end state of its
    own. ``start`` and ``degree`` of a state give its edges, longest first, in ``to``, ``piece``,
    ``logc`` (log probability given the state), ``leave`` (of taking another edge) and ``cum``
    (running probability inside the state). A word's edges do not depend on other words, so
    what is kept from earlier texts changes no result."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.index: dict[str, int] = {}
        self._columns = {
            name: _Column(kind)
            for name, kind in [
                ("first", np.int64), ("end", np.int64), ("start", np.int64), ("degree", np.int32), ("src", np.int32),
                ("to", np.int32), ("piece", np.int32), ("logc", np.float64), ("leave", np.float64), ("cum", np.float64),
            ]
        }
        self._expose()

    def _expose(self) -> None:
        for name, column in self._columns.items():
            setattr(self, name, column.data)

    def look_up(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each text; new words get their edges."""
        if self._columns["start"].n > STATES:
            self.index = {}
            for column in self._columns.values():
                column.n = 0
        index, known = self.index, len(self.index)
        rows = []
        for t in texts:
            ws = t.replace("▁", " ").split(" ") if t else []
            got = list(map(index.get, ws))
            if None in got:
                for i, g in enumerate(got):
                    if g is None:
                        got[i] = index.setdefault(ws[i], len(index))
            rows.append(np.array(got, np.int64))
        new: list[str] = []
        size = 0
        for w in islice(index, known, None):  # in parts whose arrays fit a processor's cache
            new.append(w)
            size += len(w) + 2
            if size > PART:
                self._add(new)
                new, size = [], 0
        if new:
            self._add(new)
        self._expose()
        return rows

    def _add(self, words: list[str]) -> None:
        pieces = self.pieces
        sizes = np.array([len(w) for w in words]) + 1
        first = np.cumsum(sizes + 1) - sizes - 1
        end = first + sizes
        flat = np.frombuffer(("▁" + "\0▁".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(flat)
        end_of = np.repeat(end, sizes + 1)
        inner = np.ones(n, bool)
        inner[end] = False
        at = np.flatnonzero(inner)
        plus = flat.astype(np.uint64) + _U(1)
        h = np.zeros(len(at), np.uint64)
        found: list[tuple[np.ndarray, ...]] = []
        degree = np.zeros(n, np.int32)
        for length in range(1, pieces.longest + 1):
            h = mix(h * _CHAR + plus[at + (length - 1)])
            slot = (h >> _U(64 - _BITS)).astype(np.int64)
            k = pieces.slot[slot]
            hit = np.flatnonzero(k >= 0)
            k, want = k[hit], h[hit]
            for _ in range(pieces.most - 1):
                other = np.flatnonzero(pieces.hash[k] != want)
                k[other] = np.minimum(k[other] + 1, len(pieces.hash) - 1)
            same = pieces.hash[k] == want
            hit, k = at[hit[same]], k[same]
            found.append((hit, hit + length, pieces.id[k], pieces.logp[k]))
            degree[hit] += 1
            if length == 1:
                single = np.zeros(n, bool)
                single[hit] = True
                lone = np.flatnonzero(inner & ~single)  # spelled by bytes, kept as the code point
                code = flat[lone]
                n_bytes = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
                found.append((lone, lone + 1, -1 - code.astype(np.int64), pieces.byte_logp * n_bytes))
                degree[lone] += 1
            more = np.flatnonzero(pieces.begins[slot] & (at + length < end_of[at]))
            at, h = at[more], h[more]
            if not len(at):
                break
        start = np.cumsum(degree, dtype=np.int64) - degree
        m = int(degree.sum())
        src, to, piece = (np.empty(m, np.int32) for _ in range(3))
        lp = np.empty(m)
        place = start.copy()
        rank = np.empty(m, np.int32)
        for hit, dst, ids, logp in reversed(found):
            e = place[hit]
            src[e], to[e], piece[e], lp[e], rank[e] = hit, dst, ids, logp, e - start[hit]
            place[hit] += 1
        # Backward pass: log of the summed weight of all ways from a state to its word's end.
        back = np.zeros(n)
        depth = (end_of - np.arange(n))[src]
        deepest = int(depth.max())
        by = np.argsort(depth.astype(np.uint16) if deepest < 65536 else depth, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=deepest + 1))])
        for d in range(1, deepest + 1):
            e = by[cut[d] : cut[d + 1]]
            x = lp[e] + back[to[e]]
            new = np.flatnonzero(rank[e] == 0)
            top = np.maximum.reduceat(x, new)
            state = src[e[new]]
            x = np.exp(x - np.repeat(top, degree[state]))
            back[state] = top + np.log(np.add.reduceat(x, new))
        logc = np.minimum(lp + back[to] - back[src], 0.0)
        alone = degree[src] == 1
        logc[alone] = 0.0
        cum = np.exp(logc)
        for r in range(1, int(rank.max()) + 1):
            e = np.flatnonzero(rank == r)
            cum[e] += cum[e - 1]
        cum[(start + degree - 1)[inner]] = 1.0
        with np.errstate(divide="ignore"):
            leave = np.log(-np.expm1(logc))
        states, edges = self._columns["start"].n, self._columns["to"].n
        new_values = {
            "first": first + states, "end": end + states, "start": start + edges, "degree": degree, "src": src + states,
            "to": to + states, "piece": piece, "logc": logc, "leave": leave, "cum": cum,
        }
        for name, values in new_values.items():
            self._columns[name].extend(values)

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state by its conditional probability, u uniform."""
        e = self.start[state]
        on = np.flatnonzero(self.cum[e] < u)
        while len(on):
            e[on] += 1
            on = on[self.cum[e[on]] < u[on]]
        return e


def _below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of the locations, given that they are at most the bounds."""
    with np.errstate(over="ignore", divide="ignore"):
        return location - np.log(np.exp(np.minimum(location - bound, 700.0)) - np.log(u))


def _salted(keys: np.ndarray, *salts: int) -> np.ndarray:
    for s in salts:
        keys = mix(keys * _CHAR + _U(s + 1))
    return keys


class _Node(NamedTuple):
    """Ways that share a beginning and do not go on by the edges ruled out."""

    key: float  # the largest perturbed value among them
    edges: np.ndarray  # of the beginning
    logs: np.ndarray  # log probability before each of these edges and after the last
    out: tuple[int, ...]  # edges ruled out
    word: int  # where it stands: word among all words, and state
    state: int


def sample(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct ways: (pieces, log probability, log inclusion). Pieces
    below 0 stand for a code point spelled by bytes."""
    lattice = pieces.lattice
    rows = lattice.look_up(texts)
    n_words = np.array([len(r) for r in rows], np.int64)
    words = np.concatenate([*rows, np.zeros(0, np.int64)])
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    mixed = mix(keys.astype(np.uint64) + mix(np.array([seed])))
    none = np.zeros(0, np.int64)
    agenda: list[list[_Node]] = [[] for _ in texts]
    ways: list[list[tuple[np.ndarray, float]]] = [[] for _ in texts]
    busy = np.flatnonzero(n_words > 0)
    roots = -np.log(-np.log(uniform(mixed[busy], 999)))
    for d, g in zip(busy.tolist(), roots.tolist()):
        w = int(first_word[d])
        agenda[d].append(_Node(g, none, np.zeros(1), (), w, int(lattice.first[words[w]])))
    for turn in range(k):
        heads = []
        for d in busy.tolist():
            if agenda[d]:
                node = max(agenda[d], key=lambda x: x.key)
                agenda[d] = [x for x in agenda[d] if x is not node]
                heads.append((d, node))
        if not heads:
            break
        docs = np.array([d for d, _ in heads])
        depths = np.array([len(node.edges) for _, node in heads])
        which, rest_u = (uniform(_salted(mixed[docs], turn, s), depths) for s in (77, 78))
        begun = []
        for j, (d, node) in enumerate(heads):
            if node.out:  # one of the other edges of the state, by probability
                node, rest = _turn_off(lattice, node, words, int(first_word[d + 1]), which[j], rest_u[j : j + 1])
                if rest:
                    agenda[d].append(rest)
            begun.append(node)
        edge, word, bounds = _tails(lattice, docs, begun, words, first_word, mixed, turn)
        logc = lattice.logc[edge]
        before = np.empty(len(edge))
        whole = []
        for j, node in enumerate(begun):
            a, b = bounds[j], bounds[j + 1]
            logs = np.concatenate([node.logs, node.logs[-1] + np.cumsum(logc[a:b])])
            edges = np.concatenate([node.edges, edge[a:b]])
            before[a:b] = logs[len(node.edges) : -1]
            whole.append((edges, logs))
            ways[docs[j]].append((edges, float(logs[-1])))
        # Nodes for the ways that leave a new way at each of its own edges. Only the largest
        # can still be reached.
        size = np.diff(bounds)
        since = np.array([len(node.edges) for node in begun])
        at = np.arange(len(edge)) - np.repeat(bounds[:-1] - since, size)
        u = uniform(np.repeat(_salted(mixed[docs], turn, 79), size), at)
        g = _below(before + lattice.leave[edge], np.repeat([node.key for node in begun], size), u)
        wanted = k - turn
        for j, (edges, logs) in enumerate(whole):
            a, b = bounds[j], bounds[j + 1]
            own = g[a:b]
            top = np.argpartition(own, len(own) - wanted)[-wanted:] if len(own) > wanted else np.arange(len(own))
            for i in top.tolist():
                if own[i] > -np.inf:
                    n, e = int(at[a + i]), int(edge[a + i])
                    state = int(lattice.src[e])
                    agenda[docs[j]].append(_Node(float(own[i]), edges[:n], logs[: n + 1], (e,), int(word[a + i]), state))
    result = []
    for d in range(len(texts)):
        if not n_words[d]:
            result.append([(none, 0.0, 0.0)])
            continue
        nxt = max((x.key for x in agenda[d]), default=-np.inf)
        row = []
        for edges, lp in ways[d]:
            x = np.exp(min(lp - nxt, 50.0)) if nxt > -np.inf else np.inf
            row.append((lattice.piece[edges], lp, float(np.log(-np.expm1(-x))) if x > 1e-300 else lp - nxt))
        result.append(row)
    return result


def _turn_off(lattice: Lattice, node: _Node, words, last_word: int, which: float, rest_u) -> tuple[_Node, _Node | None]:
    """Go on from a node by an edge that is not ruled out: the node after it, and the node of
    the ways that take none of these edges (None if there are none)."""
    s, w = node.state, node.word
    a = int(lattice.start[s])
    p = np.exp(lattice.logc[a : a + int(lattice.degree[s])])
    p[[e - a for e in node.out]] = 0.0
    c = np.cumsum(p)
    i = min(int(np.searchsorted(c, which * c[-1], "right")), int(np.flatnonzero(p)[-1]))
    e = a + i
    p[i] = 0.0
    left = p.sum()
    rest = None
    if left > 0:
        g = _below(node.logs[-1:] + np.log(left), np.array([node.key]), rest_u)[0]
        if g > -np.inf:
            rest = node._replace(key=float(g), out=(*node.out, e))
    s = int(lattice.to[e])
    if s == lattice.end[words[w]]:
        w += 1
        s = int(lattice.first[words[w]]) if w < last_word else -1
    logs = np.append(node.logs, node.logs[-1] + lattice.logc[e])
    return _Node(node.key, np.append(node.edges, e), logs, (), w, s), rest


def _tails(lattice: Lattice, docs, nodes: list[_Node], words, first_word, mixed, turn: int):
    """Edges from each node to the end of its text, with their words, and each node's bounds.
    All words of all nodes advance together."""
    word = np.array([n.word for n in nodes])
    count = first_word[docs + 1] - word
    base = np.cumsum(count) - count
    who = np.repeat(np.arange(len(docs)), count)
    w = np.arange(len(who)) - np.repeat(base - word, count)
    s = lattice.first[words[w]]
    open_ = count > 0
    s[base[open_]] = np.array([n.state for n in nodes])[open_]  # the first word from where it is
    end = lattice.end[words[w]]
    salt = np.repeat(_salted(mixed[docs], turn, 76), count) + (w - first_word[docs][who]).astype(np.uint64) * _U(1_000_003)
    live = np.flatnonzero(s < end)
    steps, owners = [], []
    n_edges = np.zeros(len(w), np.int64)
    while len(live):
        e = lattice.draw(s[live], uniform(salt[live], len(steps)))
        steps.append(e)
        owners.append(live)
        n_edges[live] += 1
        s[live] = lattice.to[e]
        live = live[s[live] < end[live]]
    offset = np.cumsum(n_edges) - n_edges
    edge, of = np.empty(n_edges.sum(), np.int64), np.repeat(w, n_edges)
    for t, (e, live) in enumerate(zip(steps, owners)):
        edge[offset[live] + t] = e
    return edge, of, np.concatenate([[0], np.cumsum(np.bincount(who, n_edges, len(docs)))]).astype(np.int64)


def _model(name: str, smoothing: float) -> Pieces:
    if (name, smoothing) not in _models:
        _models[(name, smoothing)] = Pieces(tokenizer_path(name), smoothing)
    return _models[(name, smoothing)]


def _spell(rows: list[np.ndarray], pieces: Pieces) -> pa.ListArray:
    """Lists of piece ids; code points without a piece become byte pieces (or the unknown piece)."""
    ids = np.concatenate([*rows, np.zeros(0, np.int32)])
    n = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids < 0)
    codes, which = np.unique(-1 - ids[odd], return_inverse=True)
    spelled = [pieces.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in codes.tolist()]
    spelled = [b if (b >= 0).all() else np.array([pieces.unknown]) for b in spelled]
    table = np.array([np.pad(b, (0, 4 - len(b))) for b in spelled]).reshape(-1, 4)
    size = np.array([len(b) for b in spelled], np.int64)
    n[odd] = size[which]
    before = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(ids, n)
    for j in range(4):
        some = size[which] > j
        out[before[odd[some]] + j] = table[which[some], j]
    offsets = before[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.astype(np.int32)))


def _keys(ids: pa.Array) -> np.ndarray:
    """Seeds of row keys: numbers as they are, others by a digest of their text; null as -1."""
    if pa.types.is_integer(ids.type):
        return pc.fill_null(ids.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(np.uint64)
    digest = (b"\xff" * 8 if x is None else blake2b(str(x).encode(), digest_size=8).digest() for x in ids.to_pylist())
    return np.frombuffer(b"".join(digest), np.uint64)


def encode_samples(
    docs: DataFrame,
    k: int = WAYS,
    model: str = "piece_bpe_32k.model",
    smoothing: float = SMOOTHING,
    seed: int = 1,
    id: str = "doc_id",
    text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """Up to k rows per document, best perturbed value first: id, sample (0..), ids, log_prob,
    log_inclusion and, on request, the text that ``decode`` gives for ids. A null id is seeded
    like id -1."""
    if id in ("sample", "ids", "log_prob", "log_inclusion", "decoded"):
        raise ValueError(f"name of a result column: {id}")
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model, smoothing)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ways = sample(texts_of(part, text), _keys(part.column(id)), pieces, k, seed)
                n = np.array([len(w) for w in ways])
                flat = [w for ws in ways for w in ws]
                ids = _spell([w[0] for w in flat], pieces)
                columns = [
                    part.column(id).take(pa.array(np.repeat(np.arange(len(n)), n))),
                    pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int32)),
                    ids,
                    pa.array([w[1] for w in flat], pa.float64()),
                    pa.array([w[2] for w in flat], pa.float64()),
                ]
                if decoded:
                    columns.append(pieces.decode(ids))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = T.StructType(
        [
            T.StructField(id, kind),
            T.StructField("sample", T.IntegerType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("log_prob", T.DoubleType()),
            T.StructField("log_inclusion", T.DoubleType()),
            *([T.StructField("decoded", T.StringType())] if decoded else []),
        ]
    )
    return docs.select(id, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its pieces in a new column; null ids give null."""
    if to in encoded.columns:
        raise ValueError(f"column exists already: {to}")
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model, 1.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces.decode(batch.column(ids))], schema.names)

    return encoded.mapInArrow(run, schema)
