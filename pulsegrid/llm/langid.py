"""Language by cross-parsing entropy.

Per language a suffix automaton of labelled text knows every string that occurs in it. A text
is parsed from left to right into the longest strings the automaton knows; a text in the
language needs few of these phrases. A phrase costs the bits (in nats) that name its place in
the language's sample, ln(size), and ``PHRASE`` for its length; a character that the sample does
not have costs the logarithm of the alphabet of all samples where that is more. The cheapest
language wins (ties: the language of more labelled documents, then the smaller name). So a
language with little text has a small automaton whose phrases are cheap but short, and samples
of one length compare by their phrase counts.

Texts are lower-cased letters with single spaces for all else, parsed in stretches of
``STRETCH`` characters that are independent, so that the stretches of many texts advance
together, one character a step, as array operations.

Training text is a bounded sample: documents with letters by a hash of the id, of each at most
``DOC_CHARS`` characters, until a language has ``CHARS`` characters; a language with less has
all it has, and does not shorten the others. Null text and text without a
letter are ``und`` with score 1; without training languages every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import slices

DOC_CHARS, CHARS = 5_000, 40_000
PHRASE = 1.0
STRETCH = 256
UNKNOWN = "und"

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def plain(text: str) -> str:
    """Lower-case letters, single spaces for all else."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Suffix automaton of a code array as a flat table: entry [state + code] holds the next
    state (as an offset into the table), doubled, plus 1 where the string ends and a new phrase
    begins with this character."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.ones(width, np.int32)  # a character that never occurs: a phrase of its own
    for c, t in nxt[0].items():
        root[c] = (t * width << 1) | 1
    root[width - 1] = 0  # padding: no phrase
    table = np.tile(root, (len(nxt), 1))
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            table[s, c] = t * width << 1
    for c, t in nxt[0].items():
        table[0, c] = (t * width << 1) | 1  # at the start every character begins a phrase
    return table.ravel()


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str], order: list[str]):
        self.langs = [x for x in order if samples.get(x)]
        texts = [samples[x][:CHARS] for x in self.langs]
        sizes = [len(t) for t in texts]
        alphabet = sorted(set("".join(texts)) - {" "})
        self.codes = {" ": 0} | {c: i + 1 for i, c in enumerate(alphabet)}
        self.width = len(self.codes) + 2  # the last two: other letters, padding
        self.size = max(sizes, default=0)
        self.phrase = np.log(np.array(sizes, float)) + PHRASE
        # What a character outside the sample costs beyond its phrase.
        self.literal = np.maximum(0.0, np.log(self.width) + PHRASE - self.phrase)
        self.missing = np.ones((len(texts), self.width), bool)
        for k, t in enumerate(texts):
            self.missing[k, [self.codes[c] for c in {*t, " "}]] = False
        enc = lambda s: np.array([self.codes[c] for c in s], np.int32)
        self.tables = [automaton(enc(f"{t} "), self.width) for t in texts]
        self._lut: np.ndarray | None = None

    def lut(self) -> np.ndarray:
        if self._lut is None:
            lut = np.where(letters(), self.width - 2, 0).astype(np.int32)
            for c, i in self.codes.items():
                lut[ord(c)] = i
            self._lut = lut
        return self._lut

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text under each language, and the number of characters parsed."""
        counts, _, size = self.parsed(texts)
        return counts, size

    def parsed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text under each language, their cost, and the number of characters."""
        lut, parts, sizes = self.lut(), [], []
        for t in texts:
            raw = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            code = lut[raw]
            gap = code == 0
            code = code[~(gap & np.concatenate([[True], gap[:-1]]))] if len(code) else code
            parts.append(code)
            sizes.append(len(code))
        size = np.array(sizes, np.int64)
        lanes = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.cumsum(lanes) - lanes
        padded = np.full((int(lanes.sum()), STRETCH), self.width - 1, np.int32)
        flat = padded.ravel()
        for d, code in enumerate(parts):
            at = first[d] * STRETCH
            flat[at : at + len(code)] = code
        steps = np.ascontiguousarray(padded.T)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            n = np.zeros(len(owner), np.int32)
            for row in steps:
                entry = table.take(state + row)
                n += entry & 1
                state = entry >> 1
            np.add.at(counts[:, k], owner, n)
        cost = counts * self.phrase
        whose = np.repeat(np.arange(len(texts)), size)
        for k in np.flatnonzero(self.literal):
            absent = self.missing[k][np.concatenate(parts)] if parts else np.zeros(0, bool)
            cost[:, k] += self.literal[k] * np.bincount(whose[absent], minlength=len(texts))
        return counts, cost, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        _, cost, _ = self.parsed([t or "" for t in texts])
        unit = self.phrase.max(initial=PHRASE)
        has = letters()
        names, scores = [], np.ones(len(texts))
        for d, t in enumerate(texts):
            raw = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            if not self.langs or not has[raw].any():
                names.append(UNKNOWN)
                continue
            c = cost[d]
            best = int(np.argmin(c))
            names.append(self.langs[best])
            # Each further phrase of the largest sample makes the language less likely by a
            # constant factor.
            scores[d] = 1.0 / np.exp(-np.minimum((c - c[best]) / unit, 500) * 0.7).sum()
        return names, scores


def learn(docs: DataFrame, seed: int = 11) -> Model:
    """Model from documents (doc_id, text, lang) that the caller lets it see."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Letters as ``plain`` leaves them, but for the case.
    text = F.trim(F.regexp_replace(F.substring("text", 1, DOC_CHARS), r"[^\p{L}]+", " "))
    # A row's level is the number of leading zeros of its hash: each has half the rows of the
    # level below, so whole levels from the top on hold a sample of about the size asked for.
    h = F.xxhash64("doc_id", F.lit(seed))
    level = F.when(h < 0, 0).when(h == 0, 64).otherwise(64 - F.length(F.bin(h))).cast("int")
    rows = known.select("lang", "doc_id", h.alias("_h"), level.alias("_level"), text.alias("_text"))
    usable = F.col("doc_id").isNotNull() & (F.length("_text") > 0)
    levels = rows.groupBy("lang", "_level").agg(
        F.count("*").alias("n"), F.sum(F.when(usable, F.length("_text") + 1)).alias("chars")
    )
    n: dict[str, int] = {}
    chars: dict[str, int] = {}
    least: dict[str, int] = {}
    for r in sorted(levels.collect(), key=lambda r: -r["_level"]):  # 65 rows a language at most
        n[r["lang"]] = n.get(r["lang"], 0) + r["n"]
        if chars.get(r["lang"], 0) <= CHARS:
            chars[r["lang"]] = chars.get(r["lang"], 0) + (r["chars"] or 0)
            least[r["lang"]] = r["_level"]
    if not least:
        return Model({}, [])
    wanted = docs.sparkSession.createDataFrame(sorted(least.items()), "lang string, _least int")
    w = Window.partitionBy("lang").orderBy("_h", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    picked = (
        rows.filter(usable)
        .join(F.broadcast(wanted), "lang")
        .filter(F.col("_level") >= F.col("_least"))
        .withColumn("_h", F.shiftrightunsigned("_h", 1))
        .withColumn("_before", F.coalesce(F.sum(F.length("_text") + 1).over(w), F.lit(0)))
        .filter(F.col("_before") <= CHARS)
    )
    samples: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["_before"])):
        samples.setdefault(r["lang"], []).append(plain(r["_text"]))
    return Model({k: " ".join(" ".join(v).split()) for k, v in samples.items()}, sorted(n, key=lambda x: (-n[x], x)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score``."""
    names = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    fields = [f for f in docs.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                langs, scores = sent.value.predict(part.column(text).to_pylist())
                kept = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    return docs.select(*names, text).mapInArrow(run, schema)
