"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters of other alphabets, digits and signs that
stand for letters) and matched in one pass by an Aho-Corasick automaton. Entries are whole
words or word beginnings with weights; a hit inside an exception phrase does not count. The
sum of the weights, for itself and per length of the text, gives the score.

The lexicon is learned from labelled rows: at most ``SAMPLE`` per class, chosen by a hash of
the id. Weights are smoothed log ratios of document frequencies in the two classes; phrases
around entries that only harmless texts use (``LEAST_SPARED`` of them at least) become exceptions,
all of them unless the caller limits their number; a word counts from ``LEAST_TEXTS`` toxic texts
and a share of ``LEAST_SHARE`` of them on; a logistic curve over the two
sums, fitted on the same rows, makes the score a probability.

Null and empty texts, and texts without a word, have no hits and get the score of such texts.
Without labels of both classes the lexicon is empty. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import sorted_sample
from pulsegrid.plans.staging import stage

SAMPLE = 20_000  # labelled rows per class
LEAST_PREFIX = 4  # letters of a word beginning
LEAST_RATIO = 2.0  # log ratio from which a word is an entry
LEAST_Z = 2.6  # log ratio in standard errors
LEAST_TEXTS, LEAST_SHARE = 3, 1 / 500  # toxic texts, and their share, that an entry has
LEAST_SPARED = 3  # harmless texts that an exception has

# Letters of other alphabets that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = dict(
    zip(
        "абвгеёзикмнорстухьіјѕԁһѵαβγεικνορτυχωѡɡ013457@",
        "abbreeeukmhopctyxbijsdhvabyeiknoptuxwwgoieasta",
    )
)
_SIGNS = re.compile(r"(?<=[^\W_])[$!|]+(?=[^\W_])")
_SIGN_LETTERS = str.maketrans("$!|", "sil")


class _Fold(dict):
    """str.translate table, filled as characters come up: letters to plain ones, marks and
    invisible characters to nothing, all else to a space."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            kind = unicodedata.category(c)
            if c in LOOK_ALIKES:
                out += LOOK_ALIKES[c]
            elif c.isalpha():
                out += c
            elif kind[0] != "M" and kind != "Cf":
                out += " "
        self[code] = out
        return out


_fold = _Fold()


def fold(text: str) -> str:
    """Words of the folded text, each between single spaces."""
    if "$" in text or "!" in text or "|" in text:
        text = _SIGNS.sub(lambda m: m[0].translate(_SIGN_LETTERS), text)
    return f" {' '.join(text.translate(_fold).split())} "


def features(folded: str) -> set[str]:
    """Words (" word ") and word beginnings (" wor") of a folded text."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update(" " + w[:n] for n in range(LEAST_PREFIX, len(w) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-4.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in self.weights:
            machine.add_word(w, (len(w), w))
        for p in self.exceptions:
            machine.add_word(p, (len(p), None))
        if len(machine):
            machine.make_automaton()
        return machine

    def hits(self, machine, folded: str) -> list[tuple[int, str]]:
        """(position, entry) of the matches outside exception phrases; of the entries that
        begin at one word the longest counts."""
        if not len(machine):
            return []
        best: dict[int, str] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, entry) in machine.iter(folded):
            at = end - n + 1
            if entry is None:
                spared.append((at, end))
            elif len(entry) > len(best.get(at, "")):
                best[at] = entry
        if spared:
            best = {a: e for a, e in best.items() if not any(s <= a < t for s, t in spared)}
        return sorted(best.items())

    def sums(self, machine, folded: str) -> tuple[float, float]:
        """Logarithms of the weight of all hits and of the weight per hundred words."""
        found = self.hits(machine, folded)
        total = sum(self.weights[e] for _, e in found)
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), float(np.log1p(100.0 * total / max(words, 20)))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -40, 40)))


def _counted(wanted: set[str] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found = features(fold(x or ""))
                counts.update(found if wanted is None else found & wanted)
            if len(counts) > 1_000_000:
                yield _pairs(counts)
                counts = Counter()
        yield _pairs(counts)

    return run


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"]
    )


def _frequencies(rows: DataFrame, least: int, wanted=None) -> dict[str, int]:
    parts = rows.select("text").mapInArrow(_counted(wanted), "feature string, n long")
    total = parts.groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r["feature"]: r["n"] for r in total.collect()}


def _choose(n1: dict[str, int], n0: dict[str, int], docs1: int, docs0: int) -> dict[str, float]:
    """Entries with their weights. Strongest first; a word goes where a beginning of it is an
    entry as good, and a beginning counts only what its entries so far do not explain."""

    def rate(a: int, b: int) -> tuple[float, float]:
        ratio = np.log((a + 0.5) / (docs1 + 1)) - np.log((b + 0.5) / (docs0 + 1))
        return float(ratio), float(ratio / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))

    rated = []
    for f, a in n1.items():
        ratio, z = rate(a, n0.get(f, 0))
        if ratio >= LEAST_RATIO and z >= LEAST_Z:
            rated.append((-ratio * a**0.5, len(f), f, ratio))
    chosen: dict[str, float] = {}
    explained: dict[str, tuple[int, int]] = {}
    for _, _, f, ratio in sorted(rated):
        stem = f.rstrip()
        starts = [stem[:n] for n in range(LEAST_PREFIX + 1, len(stem) + 1)]
        if any(s in chosen for s in starts):
            continue
        a, b = explained.get(f, (0, 0))
        left = rate(max(0, n1[f] - a), max(0, n0.get(f, 0) - b))
        if left[0] < LEAST_RATIO or left[1] < LEAST_Z:
            continue
        chosen[f] = ratio
        for s in starts:
            x, y = explained.get(s, (0, 0))
            explained[s] = (x + n1[f], y + n0.get(f, 0))
    return chosen


def learn(
    docs: DataFrame,
    labels: DataFrame,
    seed: int = 7,
    exceptions: int | None = None,
    least_texts: int = LEAST_TEXTS,
    least_share: float = LEAST_SHARE,
) -> Lexicon:
    """Lexicon from the rows of ``labels`` (doc_id, toxic 0/1) that the caller lets it see, with
    all exceptions or the ``exceptions`` most frequent ones. Entries are in ``least_texts`` and
    in a share of ``least_share`` of the toxic texts at least."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sorted_sample(known, ["toxic"], SAMPLE, seed)
    # At most two times SAMPLE ids: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    rows = stage(rows, "toxic-sample")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (size.get(0) and size.get(1)):
        return Lexicon()
    # Copies of a text say nothing new about a word.
    once = stage(rows.dropDuplicates(["text", "toxic"]), "toxic-once")
    kinds = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1 = _frequencies(once.filter("toxic = 1"), max(least_texts, int(kinds[1] * least_share)))
    n0 = _frequencies(once.filter("toxic = 0"), 1, set(n1))
    lexicon = Lexicon(_choose(n1, n0, kinds[1], kinds[0]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            x0, x1, phrases = [], [], []
            for text in batch.column(0).to_pylist():
                folded = fold(text or "")
                a, b = lexicon.sums(machine, folded)
                x0.append(a)
                x1.append(b)
                phrases.append(sorted({p for at, _ in lexicon.hits(machine, folded) for p in around(folded, at)}))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x0), pa.array(x1), pa.array(phrases, pa.list_(pa.string())), batch.column(1)],
                ["x0", "x1", "phrases", "toxic"],
            )

    schema = "x0 double, x1 double, phrases array<string>, toxic int"
    seen = stage(rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measured, schema), "toxic-hits")
    spared = (
        seen.select(F.explode("phrases").alias("p"), "toxic")
        .groupBy("p")
        .agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))
        .filter((F.col("n0") >= LEAST_SPARED) & (F.col("n1") == 0))
        .orderBy(F.desc("n0"), "p")
    )
    if exceptions is not None:
        spared = spared.limit(exceptions)
    lexicon.exceptions = [r["p"] for r in spared.collect()]
    if lexicon.exceptions:
        seen = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measured, schema)
    points = np.array([(r["x0"], r["x1"], r["toxic"]) for r in seen.select("x0", "x1", "toxic").collect()])
    lexicon.curve = _logistic(points[:, :2], points[:, 2])
    return lexicon


def around(folded: str, at: int) -> Iterable[str]:
    """Two-word phrases of the word at a position: with the word before, with the one after."""
    end = folded.find(" ", at + 1)
    after = folded.find(" ", end + 1)
    before = folded.rfind(" ", 0, at)
    if after > 0:
        yield folded[at : after + 1]
    if before >= 0:
        yield folded[before : end + 1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; slopes are never negative."""
    use = [0, 1]
    while True:
        m = np.column_stack([np.ones(len(x)), x[:, use]])
        w = np.zeros(m.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
            g = m.T @ (p - y) + ridge * w
            h = (m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        worst = 1 + int(np.argmin(w[1:])) if len(use) else 0
        if not use or w[worst] >= 0:
            out = [0.0, 0.0, 0.0]
            out[0] = float(w[0])
            for k, c in zip(use, w[1:]):
                out[1 + k] = float(c)
            return tuple(out)
        use.pop(worst - 1)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1) added; other columns stay as they are."""
    if to in docs.columns:
        raise ValueError(f"column exists already: {to}")
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        machine = lex.automaton()
        for batch in batches:
            x = [lex.sums(machine, fold(t or "")) for t in batch.column(text).to_pylist()]
            p = lex.score(np.array(x, float).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def is_toxic(score_column: Column, threshold: float = 0.5) -> Column:
    return score_column >= threshold
