"""Quality rules combined by weak supervision.

Each rule looks at one property of a text and votes good, bad or abstains. How reliable a rule
is follows from how it agrees with the others over the whole corpus: expectation-maximisation
estimates each rule's votes for good texts and for the kinds of bad texts (one kind per defect,
since a text with one defect need not have the others) and the share of each, and every text
gets the posterior probability of being good from its votes. That probability decides, not a
conjunction of rules.

Only built-in column functions see the rows. Votes of all texts are counted by pattern (three
values a rule, so a bounded number of patterns), the estimation runs on those counts, and the
posterior of each pattern is joined back.

Null text has no words. Texts of fewer than ``LEAST_WORDS`` words or with most words in
repeated windows fail outright. An empty table gives an empty result; repeated rows count
each; only ``doc_id`` and the text column are read, other columns are carried on under numbered
names, so that their own may be those of the measures or of columns used on the way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordering import with_computed

LEAST_WORDS = 50
MOST_REPEATED = 0.5
KEEP_FROM = 0.5
ROUNDS = 60
MOST_FALSE = 0.01  # share of good texts that a rule may call bad

# Characters \x20 and \x09-\x0D separate words; spelled out for Java's expressions.
_BREAK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

#: rule -> (measure, bad from, good from). Fixed values. Finding no defect is no praise, so
#: most rules vote bad or abstain; the last three can vote good. None: no such vote.
RULES = {
    "symbols": ("symbols_per_word", 0.10, None),
    "lines": ("dup_line_share", 0.60, None),
    "repeats": ("repeat_share", 0.30, None),
    "capitals": ("capital_share", 0.40, None),
    "exclaims": ("exclaims_per_word", 0.20, None),
    "length": ("word_length_off", 8.0, None),
    "variety": ("kinds_missing", 0.50, None),
    "sentences": ("sentence_share", None, 0.50),
    "substance": ("n_words", None, 100),
}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Sorted by (hash, position), equal windows are
    neighbours; the positions found are sorted again and their windows' lengths added up
    without counting overlaps twice."""

    def of(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)),
        )
        return _let(windows, found)

    def found(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(twice, _let(keyed, covered)).otherwise(F.lit(0))

    def covered(s: Column) -> Column:
        n = F.size(s)
        pairs = F.zip_with(
            F.slice(s, F.lit(1), n - 1),
            F.slice(s, F.lit(2), n - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return _let(F.sort_array(F.array_distinct(F.flatten(pairs))), total)

    def total(at: Column) -> Column:
        n = F.size(at)
        steps = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x) + 3

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, of))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and
    what the rules look at. Columns of the same names are replaced, the text is dropped, all
    others are carried on."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    names += [m for m, _, _ in RULES.values() if m != "n_words"]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(t, _BREAK), lambda w: w != "")
    bare = F.regexp_replace(t, _BREAK, "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(_WORD))
    first = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length("_bare").cast("long"),
        "n_symbols": (F.char_length("_bare") - F.char_length(F.translate("_bare", "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")).cast("long"),
        "_n_lines": F.size("_lines").cast("double"),
        "_kinds": F.size(F.array_distinct("_words")).cast("double"),
        "_letters": F.char_length(F.regexp_replace("_bare", r"[^\p{L}]+", "")).cast("double"),
        "_capitals": F.char_length(F.regexp_replace("_bare", r"[^\p{Lu}]+", "")).cast("double"),
        "_ended": F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("double"),
        "_exclaims": (F.char_length("_bare") - F.char_length(F.translate("_bare", "!", ""))).cast("double"),
    }
    kept = [c for c in docs.columns if c != text and c not in names]
    carried = [F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(kept)]
    cut = with_computed(
        docs.select(*carried, t.alias(text)),
        {"_words": words, "_bare": bare, "_lines": lines},
    ).drop(text)
    out = with_computed(cut, first).drop("_words", "_bare", "_lines")
    n = F.col("n_words").cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns(
        {
            "symbols_per_word": ratio(F.col("n_symbols").cast("double"), n),
            "dup_line_share": ratio(F.col("n_dup_lines").cast("double"), F.col("_n_lines")),
            "repeat_share": ratio(F.col("n_repeat_words").cast("double"), n),
            "capital_share": ratio(F.col("_capitals"), F.col("_letters")),
            "exclaims_per_word": ratio(F.col("_exclaims"), n),
            "word_length_off": F.abs(ratio(F.col("word_chars").cast("double"), n) - 6.0),
            # Long texts have fewer kinds of words: what falls short of n ** 0.75.
            "kinds_missing": 1.0 - ratio(F.col("_kinds"), F.pow(F.greatest(n, F.lit(1.0)), 0.75)),
            "sentence_share": ratio(F.col("_ended"), F.col("_n_lines")),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    done = out.withColumn("base_failed", failed)
    return done.select(*[F.col(f"_carried{i}").alias(c) for i, c in enumerate(kept)], *names)


def votes(measured: DataFrame) -> DataFrame:
    """Add ``pattern``, one character a rule: + good, - bad, 0 abstains. Texts without a word
    get abstentions only."""
    marks = []
    for measure, bad, good in RULES.values():
        v = F.when(F.col("n_words") == 0, "0")
        if bad is not None:
            v = v.when(F.col(measure) >= bad, "-")
        if good is not None:
            v = v.when(F.col(measure) >= good, "+")
        marks.append(v.otherwise("0"))
    return measured.withColumn("pattern", F.concat(*marks))


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior probability of good for each vote pattern.

    A text is good or has one main defect; given which, votes are independent. Every class has
    a probability of each vote of each rule, learned with pseudo-counts that say a rule is
    right more often than not, which also fixes what the classes mean."""
    patterns = list(counts)
    if not patterns:
        return {}
    rules = list(RULES.values())
    kinds = [j for j, (_, bad, _) in enumerate(rules) if bad is not None]
    # Start: a vote of bad makes the defects that were voted for likely, whatever others say.
    post: dict[str, list[float]] = {}
    for p in patterns:
        voted = [j for j in kinds if p[j] == "-"]
        good = 0.05 if voted else 0.95
        share = {j: (1 - good) / len(voted or kinds) for j in (voted or kinds)}
        post[p] = [good] + [share.get(j, 0.0) for j in kinds]
    total = sum(counts.values())
    # Pseudo-counts in proportion to the corpus, so that they mean the same at any size.
    unit = 0.001 * total
    for _ in range(rounds):
        weights, like = [], []
        for c in range(len(kinds) + 1):
            mass = sum(counts[p] * post[p][c] for p in patterns)
            weights.append(math.log((mass + unit) / (total + unit * (len(kinds) + 1))))
            row = []
            for j in range(len(rules)):
                right = c > 0 and kinds[c - 1] == j  # the rule of this defect
                t = {"-": unit if right else 0.2 * unit, "0": 0.2 * unit if right else unit, "+": 0.5 * unit}
                if c == 0:
                    t = {"-": 0.2 * unit, "0": 2 * unit, "+": 2 * unit}
                for p in patterns:
                    t[p[j]] += counts[p] * post[p][c]
                s = sum(t.values())
                if c == 0 and t["-"] > MOST_FALSE * s:
                    scale = (1 - MOST_FALSE) * s / (s - t["-"])
                    t = {"-": MOST_FALSE * s, "0": t["0"] * scale, "+": t["+"] * scale}
                row.append({k: math.log(v / s) for k, v in t.items()})
            like.append(row)
        moved = 0.0
        for p in patterns:
            logs = [w + sum(r[j][p[j]] for j in range(len(rules))) for w, r in zip(weights, like)]
            top = max(logs)
            odds = [math.exp(x - top) for x in logs]
            new = [x / sum(odds) for x in odds]
            moved = max(moved, abs(new[0] - post[p][0]))
            post[p] = new
        if moved < 1e-9:
            break
    return {p: x[0] for p, x in post.items()}


def judge(voted: DataFrame) -> DataFrame:
    """Add ``quality`` (posterior) and ``kept`` to voted rows, in place of columns of these
    names; drops the pattern."""
    spark = voted.sparkSession
    # At most three to the number of rules rows.
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    post = estimate(counts)
    table = spark.createDataFrame(list(post.items()), "pattern string, quality double")
    joined = voted.drop("quality", "kept").join(F.broadcast(table), "pattern", "left")
    kept = ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)
    return joined.withColumn("kept", kept).drop("pattern")


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns.

    Two scans and no shuffle of texts: the first counts vote patterns, the second computes each
    row's pattern again and keeps it by the pattern's posterior."""
    numbered = [F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*numbered, F.col(f"`{text}`").alias("text"))
    patterns = votes(measures(rows.select("text"))).groupBy("pattern").agg(F.count("*").alias("n"))
    counts = {r["pattern"]: r["n"] for r in patterns.collect()}
    good = [p for p, q in estimate(counts).items() if q >= KEEP_FROM]
    kept = votes(measures(rows)).filter(~F.col("base_failed") & F.col("pattern").isin(good))
    return kept.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(docs.columns)])
