"""Document operators against brute force on small tables, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pulsegrid.llm import (
    common,
    components,
    langid,
    minhash,
    packing,
    pstable,
    quality,
    queries,
    resampling,
    segmentations,
    suffixes,
    token_counts,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long, repeated and tied rows."""
    long = " ".join(f"word{i % 700} tail" for i in range(9000))
    texts = [None, "", " \n\t ", "a", "a", "x  y   z \n \n q ", "é☃ ▁mark", long, long, "<|endoftext|> <s>", "a\0b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def collected(df):
    return [r.asDict() for r in df.collect()]


# --- token counts, packing -------------------------------------------------------------


def test_token_counts_equal_the_library(spark, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    texts = ["  two  spaces ", "one\n\n two", "   ", " ", "tab\tx ", "ßpecial ﬁ x y"]
    both = odd.union(docs_of(spark, texts))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in both.collect())
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(both).collect())
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


def test_pieces_equal_the_library_and_packing_is_gapless(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    texts = ["a \n b", "x\n \ny", "it's  we'll　wide", "числа 12 и буквы", " lead", "trail "]
    both = odd.union(docs_of(spark, [f"{t} {i}" for i, t in enumerate(texts)]).selectExpr("doc_id + 100", "text"))
    rows = collected(packing.pack(packing.pieces(both)))
    want = {}
    for r in both.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids[: len(ids) % 1024 or 1024].tobytes()))] = ids
    for r in rows:
        match = [v for k, v in want.items() if k[0] == r["doc_id"]]
        assert any(zlib.crc32(v[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for v in match)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert total == sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in both.collect())
    assert len(by) == -(-total // 1024)
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_match_runs_places_every_piece_once():
    rng = random.Random(3)
    for capacity in (10, 64, 1024):
        counts = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(5000))
        placed = packing.match_runs(counts, capacity)
        for s, n in counts.items():
            ranks = sorted(x for r in placed if r[0] == s for x in range(r[1], r[1] + r[2]))
            assert ranks == list(range(n))
        sequences = sum(r[2] for r in placed if r[0] == r[3] and r[1] == r[4] and r[5] == 0)
        assert sequences <= -(-sum(s * n for s, n in counts.items()) // capacity) * 1.05 + 1
    assert packing.match_runs({}, 10) == []


# --- repeated strings ------------------------------------------------------------------


def brute_repeats(rows, width):
    seen, out = {}, {}
    for d, t in sorted(rows):
        b = t.encode()
        covered = [False] * len(b)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                covered[i : i + width] = [True] * width
            seen.setdefault(w, d)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        runs = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out[d] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width,core", [(12, 5), (40, 9), (100, 32)])
def test_repeats_equal_brute_force(spark, width, core):
    rng = random.Random(width)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(0, 260))) for _ in range(25)]
    texts = base + [rng.choice(base)[: rng.randrange(200)] + rng.choice(base)[rng.randrange(100) :] for _ in range(60)]
    texts += ["ab" * 150, "b" * 200, "", base[3], base[3], base[4] + "x" + base[4]]
    got = collected(suffixes.remove_repeats(docs_of(spark, texts), width, core))
    want = brute_repeats(list(enumerate(texts)), width)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def peak_mb(run):
    """Most that Python and numpy hold while ``run`` goes on."""
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_of_texts_is_worked_on_in_small_parts():
    """2 MB of texts: same nodes as text by text, in little memory."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(500), pa.int64()), "tag": pa.array([0] * 500, pa.int32()), "text": texts})
    first = suffixes._first_pass(100, 32)
    rows = lambda found: sorted(map(str, (r for b in found for r in b.to_pylist())))
    few = batch.slice(90, 30)  # texts before and after the first cut
    assert set(rows(b for i in range(30) for b in first(iter([few.slice(i, 1)])))) <= set(rows(first(iter([batch]))))
    assert peak_mb(lambda: [None for _ in first(iter([batch]))]) < 120


def test_repeats_on_odd_rows(spark, odd, empty):
    got = collected(suffixes.remove_repeats(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_bytes"] == 0 and by[8]["n_removed"] == by[8]["n_bytes"] > 0
    assert suffixes.remove_repeats(empty).count() == 0
    more = odd.selectExpr("*", "1 AS core", "2 AS spots", "3 AS tag", "4 AS n_bytes")
    assert set(suffixes.remove_repeats(more).columns) >= {"core", "spots", "tag", "n_bytes"}


def test_a_core_given_out_in_parts_loses_no_node():
    rng = random.Random(6)
    for trial in range(200):
        nodes = {(rng.randrange(3), rng.randrange(2), rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(2, 40))}
        rows = [(*r, i) for i, r in enumerate(sorted(nodes))]  # core, hull, doc, spot, tag
        size = rng.randrange(1, 4)
        batches = [
            pa.RecordBatch.from_pydict({k: pa.array([r[c] for r in rows[i : i + size]], pa.int64()) for k, c in
                                        (("doc", 2), ("tag", 4), ("spot", 3), ("core", 0), ("hull", 1))})
            for i in range(0, len(rows), size)
        ]
        out = [tuple(r.values()) for b in suffixes._settle(3)(iter(batches)) for r in b.to_pylist()]
        firsts = {}
        for core, hull, doc, spot, _ in rows:
            firsts.setdefault((core, hull), (doc, spot))
        late = {i: (d, s) != firsts[c, h] for c, h, d, s, i in rows}
        must = {(d, i, s, late[i]) for c, _, d, s, i in rows if late[i] or sum(x[0] == c for x in firsts) > 1}
        assert must <= set(out), trial
        assert len(out) == len(set(out)) <= len(rows)


def test_repeats_with_a_core_given_out_in_parts(spark):
    rng = random.Random(9)
    hot = "".join(rng.choice("abcdefgh") for _ in range(60))
    word = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    texts = [word(rng.randrange(30)) + hot + word(rng.randrange(30)) for _ in range(40)] + [hot] * 40
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        got = collected(suffixes.remove_repeats(docs_of(spark, texts), 40, 9, held=5))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute_repeats(list(enumerate(texts)), 40)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


# --- near-duplicates -------------------------------------------------------------------


def closed(ids, links):
    part = {i: i for i in ids}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 540)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    want = closed({x for ab in links for x in ab}, links)
    have = {r["id"]: r["component"] for r in got.collect()}
    assert all(have.get(i, i) == c for i, c in want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.choice([1.0, 2.0, 5.5], 400)
    a, b = h[:340], h[60:]
    sim = minhash.weighted_jaccard(a, w[:340], b, w[60:])
    same = [
        (minhash.band_keys(mix_a := minhash.mix(a + np.uint64(k)), w[:340], np.array([0, 340]))
         == minhash.band_keys(minhash.mix(b + np.uint64(k)), w[60:], np.array([0, 340]))).mean()
        for k in range(60)
    ]
    assert abs(np.mean(same) - sim**minhash.ROWS) < 0.05


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(rng.randrange(60, 200))] for _ in range(12)]
    texts = []
    for b in base * 8:
        b = list(b)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            b[rng.randrange(len(b))] = word()
        texts.append(" ".join(b))
    texts += ["", None, "one two", "one two"]
    docs = docs_of(spark, texts).coalesce(1)
    # Frequencies counted by hand; few texts, so that every window of two texts is a frequent one.
    held = Counter()
    for t in texts:
        own = (t or "").split()
        held.update({tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else ())
    values = {g: minhash.ngrams(*common.words([" ".join(g)]), 5)[0][0] for g in held}
    table = sorted((values[g], n) for g, n in held.items() if n > 1)
    idf = minhash.Weights(np.array([v for v, _ in table]), np.array([n for _, n in table]), len(texts))
    measured = minhash.window_weights(docs)
    assert (measured.windows == idf.windows).all() and np.allclose(measured.idf, idf.idf) and measured.rest == idf.rest
    assert np.isclose(idf.rest, np.log((1 + len(texts)) / 2) + 1)
    h, w, bounds = minhash.weighted_sets([t or "" for t in texts], idf)
    cut = lambda i: slice(bounds[i], bounds[i + 1])
    links, sims = [], minhash.similarities([t or "" for t in texts], idf)
    for i in range(len(texts)):
        for j in range(i):
            s = minhash.weighted_jaccard(h[cut(i)], w[cut(i)], h[cut(j)], w[cut(j)])
            assert abs(s - sims[i, j]) < 1e-4
            if s >= 0.8 or (texts[i] or "") == (texts[j] or ""):
                links.append((i, j))
    want = closed(range(len(texts)), links)
    got = collected(minhash.near_duplicates(docs))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_rare_windows_weigh_by_their_own_frequency(spark):
    """Windows of one to five of 3,000 documents, in several ranges and parts of tasks."""
    own = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    body = own("body", 85)
    texts = [" ".join([*body, *own(k, 10)]) for k in "ab"]
    few = [" ".join(own(f"few{k}", 7)) for k in range(2, 6)]
    texts += [" ".join([t, f"end{k}", f"{i}"]) for k, t in enumerate(few, 2) for i in range(k)]
    texts += [" ".join(own(k, 6)) for k in range(3000 - len(texts))]
    held = Counter(g for t in texts for g in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    value = lambda g: minhash.ngrams(*common.words([" ".join(g)]), 5)[0]
    docs = docs_of(spark, texts).repartition(3).localCheckpoint()
    idf = minhash.window_weights(docs)
    assert set(held.values()) == {1, 2, 3, 4, 5} and len(idf.windows) == sum(n > 1 for n in held.values())
    for g in {n: g for g, n in held.items()}.values():
        assert np.isclose(idf.of(value(g))[0], np.log(3001 / (1 + held[g])) + 1)
    # 81 of 101 windows in common are 0.802 by number, but rarer ones are not in common: 0.794.
    a, b = (Counter({g: np.log(3001 / (1 + held[g])) + 1 for g in zip(*[t.split()[k:] for k in range(5)])}) for t in texts[:2])
    assert 0.79 < sum((a & b).values()) / sum((a | b).values()) < 0.8 < len(a & b) / len(a | b)
    got = {r["doc_id"]: r["component_id"] for r in collected(minhash.near_duplicates(docs))}
    assert (got[0], got[1]) == (0, 1)


def test_windows_are_hashed_a_few_texts_at_a_time():
    """The same windows as from all texts at once, in little memory."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, n)) for n in [*rng.integers(0, 900, 400), 90_000, 0, 3]] + ["", " "]
    assert sum(map(len, texts)) > 4 * minhash.HASHED_CHARS
    at_once, h = minhash.ngrams(*common.words(texts), 5), minhash.windows_of(texts)
    assert all(np.array_equal(x, y) for x, y in zip(at_once, h))
    assert [len(x) for x in minhash.windows_of([])] == [0, 1]
    assert peak_mb(lambda: minhash.window_sets(texts)) < 70


def test_counts_of_windows_in_ranges():
    """What the ranges of two parts return is what all documents have."""
    from pulsegrid.llm.minhash import _held, _opened, _returned, _signatures, _contents, _unpacked

    texts = ["a b c d e f g", "a b c d e x", None, "q", "a b c d e f g a b c d e"]
    parts = [pa.RecordBatch.from_pydict({"doc_id": pa.array(i, pa.int64()), "text": pa.array([texts[k] for k in i], pa.string())})
             for i in ([0, 1, 2], [3, 4])]
    rows = pa.Table.from_batches([b for p in parts for b in _held("text", 7)(iter([p]))])
    numbers = pa.concat_tables(
        [_returned(7)(rows.filter(pc.equal(rows["range"], k))) for k in pc.unique(rows["range"]).to_pylist()]
    )
    docs = [set(zip(*[(t or "").split()[k:] for k in range(5)])) or ({tuple((t or "").split())} if t else set()) for t in texts]
    held = Counter(g for d in docs for g in d)
    for p in parts:
        for c in _contents("doc_id", "text")(iter([p])):
            mine = numbers.filter(pc.equal(numbers["part"], c.column("part")[0]))
            out = _signatures(5, "doc_id", "text")(pa.Table.from_batches([c]), mine)
            for r in out.to_pylist():
                words = (texts[r["rep"]] or "").split()
                tf = Counter(zip(*[words[k:] for k in range(5)])) or Counter([tuple(words)])
                whole, h, idf, n = _opened(r["value"], 5)
                assert np.isclose(whole, sum(c * (np.log(6 / (1 + held[g])) + 1) for g, c in tf.items()))
                want = sorted((int(minhash.ngrams(*common.words([" ".join(g)]), 5)[0][0]), c, held[g]) for g, c in tf.items() if held[g] > 1)
                assert [(int(x), int(c)) for x, c in zip(h, n)] == [(x, c) for x, c, _ in want]
                assert np.allclose(idf, [np.log(6 / (1 + m)) + 1 for _, _, m in want])
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (_unpacked(minhash._packed(x, 8), 8) == x).all()


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    got = collected(minhash.near_duplicates(odd))
    assert len(got) == odd.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {
        0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10
    }
    assert minhash.near_duplicates(empty).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base, base[:10] * 3, base[5:25] + rng.normal(0, 0.08, (20, 16)), np.repeat(base[:1], 600, 0) + rng.normal(0, 0.03, (600, 16))])
    label = [i % 2 for i in range(len(x) - 600)] + [0] * 600
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0)]
    rows += [(n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    want = closed(range(len(rows)), list(zip(*np.nonzero(near))))
    got = collected(pstable.near_duplicates(df))
    assert {r["vec_id"]: r["component_id"] for r in got} == want
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate([*near.sum(1).tolist(), *[0] * 7]))
    assert pstable.near_duplicates(df.limit(0)).count() == 0


# --- scores ----------------------------------------------------------------------------


def test_quality_measures_equal_brute_force(spark, odd):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c#", "<d>"]) + rng.choice(["", "\n", "\t"]) for _ in range(rng.randrange(90))) for _ in range(80)]
    docs = odd.union(docs_of(spark, texts).selectExpr("doc_id + 100", "text")).filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {}
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[r["doc_id"]] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(hit))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in quality.measures(docs).collect()}
    assert got == want


def test_quality_verdicts(spark, empty):
    rng = random.Random(6)
    good = [". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9)) for _ in range(14)) + "." for _ in range(90)]
    bad = [" | ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)) for _ in range(12)]
    docs = docs_of(spark, good + bad + [None, "short text"])
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(quality.votes(quality.measures(docs))).collect()}
    assert all(judged[i] for i in range(90)) and not any(judged[i] for i in range(90, 104))
    kept = quality.filter_documents(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(90)) and kept.columns == docs.columns
    assert quality.filter_documents(empty).count() == 0 and quality.estimate({}) == {}


def test_quality_carries_columns_of_any_name(spark):
    names = ["pattern", "quality", "n_words", "_words", "_text", "_whole", "whole", "_row", "kept", "a.b"]
    text = ". ".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(14)) + "."
    rows = [(i, None if i == 7 else text, *[f"{n}-{i}" for n in names]) for i in range(20)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    got = quality.filter_documents(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] != 7)
    judged = quality.judge(quality.votes(quality.measures(docs))).collect()
    assert len(judged) == 20 and all(0 <= r["quality"] <= 1 and r["_words"] == f"_words-{r['doc_id']}" for r in judged)


def naive_score(text, lexicon):
    folded = toxicity.fold(text or "")
    spared = {
        (s, s + len(p) - 1) for p in lexicon.exceptions for s in range(len(folded)) if folded[s : s + len(p)] == p
    }
    total = 0.0
    for at in range(len(folded)):
        here = [e for e in lexicon.weights if folded[at : at + len(e)] == e]
        if here and not any(s <= at < t for s, t in spared):
            total += lexicon.weights[max(here, key=len)]
    n = max(20, len(folded.split()))
    a, b, c = lexicon.curve
    return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(100 * total / n))))


def test_toxicity_equals_a_naive_scan(spark, odd):
    """The matched weight of each text against a scan of every entry at every place."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioumnr") for _ in range(5))
    texts = [" ".join(rng.choice(["grunkle", "Grunkles", "gr4nkle", "street", word()]) for _ in range(30)) for _ in range(60)]
    texts += [" ".join([*(word() for _ in range(20)), "grunkle", "lane", word()]) for _ in range(6)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(174)]
    docs = docs_of(spark, texts)
    lexicon = toxicity.learn(docs, spark.createDataFrame([(i, int(i < 60)) for i in range(240)], "doc_id long, toxic int"))
    assert lexicon.weights and lexicon.exceptions
    for r in toxicity.score(docs.union(odd), lexicon).collect():
        assert abs(r["score"] - naive_score(r["text"], lexicon)) < 1e-9


def test_toxicity(spark, odd):
    assert toxicity.fold("ІD1ОT!! stup1d$$$ é") == " idiot stupid e "
    rng = random.Random(7)
    plain = lambda n: " ".join("".join(rng.choice("aeioumnr") for _ in range(6)) for _ in range(n))
    texts = [f"{plain(20)} grunkle {plain(10)} GRUNKLES {plain(9)}" for _ in range(40)] + [plain(40) for _ in range(160)]
    texts += [f"{plain(20)} grunkle street {plain(20)}" for _ in range(12)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(len(texts))], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert any(e.strip().startswith("grunk") for e in lexicon.weights)
    more = docs_of(spark, [f"{plain(20)} ɡrunkle gr​unkle {plain(9)}", plain(30), f"{plain(9)} grunkle street {plain(30)}", None, ""])
    got = [r["score"] for r in toxicity.score(more, lexicon).orderBy("doc_id").collect()]
    assert got[0] >= 0.5 and max(got[1:]) < 0.5
    assert toxicity.score(odd, lexicon).count() == odd.count()
    assert toxicity.learn(docs, labels.limit(0)).weights == {}


def test_toxic_phrases_of_long_texts_count(spark):
    import itertools

    many = ["".join(x) for x in itertools.islice(itertools.product("abcdefghij", repeat=4), 1300)]
    toxic = [" ".join(f"{w} vile" for w in many) + " zz vile"] + ["you are vile"] * 40
    toxic = [f"{t} {'abcdefghijk'[i % 11]}{'lmnop'[i % 5]}" for i, t in enumerate(toxic)]
    harmless = [f"zz vile garden {w}" for w in many[:5]] + [f"sunny day {w} {v}" for w, v in zip(many[:600], many[600:])]
    labels = [(i, int(i < len(toxic))) for i in range(len(toxic) + len(harmless))]
    docs, labels = docs_of(spark, toxic + harmless), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.learn(docs, labels).exceptions
    assert any("vile garden" in p for p in found) and not any("zz vile" in p for p in found)
    assert toxicity.learn(docs, labels, exceptions=0).exceptions == []


def test_language_model_counts_phrases():
    text = "the cat sat on the mat and the dog ran"
    model = langid.Model({"en": text, "xx": "zzz qqq www kkk jjj zqz wkw jzj qkq zwz"}, ["en", "xx"])
    rng = random.Random(2)
    for _ in range(40):
        t = langid.plain("".join(rng.choice("the catsonmdgr z") for _ in range(50)))
        counts, _ = model.phrases([t])
        own, i, n = f"{text[: model.size]} ", 0, 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in own and t[i : i + k] in own:
                k += 1
            i, n = i + k, n + 1
        assert counts[0, 0] == n
    names, scores = model.predict([None, "", "12 !?", "the cat sat"])
    assert names == ["und", "und", "und", "en"] and all(0 <= s <= 1 for s in scores)


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in common.read(spark, sf_dir, "documents").collect()}
    got = queries.op7_language_id(spark, sf_dir).filter("held_out").collect()
    assert got and sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.97 * len(got)


def test_a_poor_language_does_not_shorten_the_others(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    poor = [(-1, "Zyx wvut qponm lkjih gfedcb", "poor"), (-2, "ok", "tiny"), (-3, " 12 !?", "blank")]
    seen = docs.filter(common.bucket_of("doc_id", 4) != 2).union(spark.createDataFrame(poor, docs.schema))
    model = langid.learn(seen)
    assert {"poor", "tiny"} < set(model.langs) and "blank" not in model.langs
    held = docs.filter(common.bucket_of("doc_id", 4) == 2).collect()
    names, _ = model.predict([r["text"] for r in held])
    assert sum(x == r["lang"] for x, r in zip(names, held)) >= 0.97 * len(held)
    assert model.predict(["zyx wvut qponm lkjih"])[0] == ["poor"]


def test_language_samples_are_topped_up(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, word(), "aa") for i in range(9000)] + [(i, "", "aa") for i in range(9000, 9600)]
    rows += [(i, " ".join(word() for _ in range(40)), "bb") for i in range(10_000, 10_400)]
    rows += [(i, word(), "cc") for i in range(20_000, 20_100)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    sizes = np.exp(model.phrase - langid.PHRASE).round().astype(int).tolist()
    assert sizes == [langid.CHARS, langid.CHARS, 599]


def test_resampling(spark, empty):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["sun", "moon", "star", "sky"]) for _ in range(60)) for _ in range(80)]
    junk = [" ".join(rng.choice(["buy", "now", "win", "$$"]) for _ in range(60)) for _ in range(20)]
    docs = docs_of(spark, good + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 80, 2)], "doc_id long, quality int")
    target = resampling.target_rows(docs, labels)
    ratio = resampling.log_ratio(resampling.gram_counts(target), resampling.gram_counts(docs))
    got = resampling.resample(resampling.weigh(docs, ratio), 0.5).collect()
    assert sum(r["selected"] for r in got) == 50 and sorted(r["sample_rank"] for r in got) == list(range(100))
    assert not any(r["selected"] for r in got if r["doc_id"] >= 80)
    keys = sorted((-r["gumbel_key"], r["sample_rank"]) for r in got)
    assert [k[1] for k in keys] == list(range(100))
    assert resampling.resample(resampling.weigh(empty, ratio)).count() == 0


def test_resampling_equals_plain_python(spark, odd):
    """Models, weights, keys and sample against plain loops; long, blank, null and tied rows."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Sun", "moon", "star", "buy", "now", "é"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    docs = docs_of(spark, texts).selectExpr("doc_id + 100 as doc_id", "text").union(odd)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]

    def buckets(t):
        hashes, _ = common.words([t], lower=True)
        h = [int(x) for x in hashes]
        pairs = [int(common.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
        return [x >> 50 for x in h + pairs]

    labels = spark.createDataFrame([(i, 1) for i in range(100, 130)], "doc_id long, quality int")
    raw, want = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i is not None and 100 <= i < 130:
            want.update(buckets(t))
    target = resampling.gram_counts(resampling.target_rows(docs, labels))
    total = resampling.gram_counts(docs)
    assert {i: n for i, n in enumerate(total) if n} == raw and {i: n for i, n in enumerate(target) if n} == want
    ratio = resampling.log_ratio(target, total)
    b, n_raw, n_want = resampling.BUCKETS, sum(raw.values()), sum(want.values())
    for i in list(raw)[:50] + [0, 1]:
        base = (raw[i] + 1) / (n_raw + b)
        model = (want[i] + 0.2 * b * base) / (n_want + 0.2 * b)
        assert abs(ratio[i] - np.log(model / base)) < 1e-9
    weighed = resampling.weigh(docs, ratio)
    expect = sorted((str(i), len(g), round(sum(ratio[x] for x in g), 6)) for i, t in rows for g in [buckets(t)])
    assert sorted((str(r["doc_id"]), r["n_grams"], round(r["log_weight"], 6)) for r in weighed.collect()) == expect
    got = resampling.resample(weighed, 0.4).collect()
    by_key = sorted(got, key=lambda r: (-r["gumbel_key"], r["sample_rank"]))
    assert [r["sample_rank"] for r in by_key] == list(range(len(rows)))
    assert sum(r["selected"] for r in got) == -(-len(rows) * 4 // 10)
    tempered = resampling.weigh(docs, ratio, evidence=64).filter("n_grams > 64").collect()
    whole = {r["doc_id"]: r for r in weighed.collect()}
    assert tempered and all(
        abs(r["log_weight"] - whole[r["doc_id"]]["log_weight"] * 64 / r["n_grams"]) < 1e-6 for r in tempered
    )


# --- segmentations ---------------------------------------------------------------------


def test_sampling_without_replacement():
    pieces = segmentations._model("piece_bpe_32k.model", 0.5)
    n, count, logp = 1500, Counter(), {}
    for seed in range(n):
        ways = segmentations.sample(["abc"], np.array([seed], np.uint64), pieces, 2, 3)[0]
        assert len({tuple(w[0]) for w in ways}) == len(ways) == 2
        for w in ways:
            count[tuple(w[0])] += 1
            logp[tuple(w[0])] = w[1]
    p = {k: np.exp(v) for k, v in logp.items()}
    assert abs(sum(p.values()) - 1) < 1e-3
    for k, c in count.items():
        want = p[k] + sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)
        assert abs(c / n - want) < 0.05


def test_segmentations_decode(spark, odd, empty):
    encoded = segmentations.encode_samples(odd, 3)
    back = segmentations.decode(encoded).join(odd.dropDuplicates(), "doc_id").collect()
    assert back and all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in back)
    assert all(r["log_inclusion"] <= 0 and r["log_prob"] <= 1e-9 for r in back)
    again = {(r["doc_id"], r["sample"]): r["ids"] for r in segmentations.encode_samples(odd.repartition(3), 3).collect()}
    assert all(again[(r["doc_id"], r["sample"])] == r["ids"] for r in back)
    assert segmentations.encode_samples(empty).count() == 0


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "null AS source", "length(text) AS n_chars")
    docs = docs.selectExpr("doc_id", "text", "lang", "cast(source AS string) AS source", "cast(n_chars AS long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS, name


def test_pipeline_tells_documents_apart_by_rare_windows(spark):
    """Alike in 0.802 of their windows, but in less than 0.8 once rare windows weigh more."""
    import corpus_pipeline

    own = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    texts = [" ".join([*own("body", 85), *own(k, 10)]) for k in "ab"] + [" ".join(own(k, 6)) for k in range(2998)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate([*texts, texts[0]])], DOCS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.doc_id for r in kept} == set(range(3000))


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = {r["doc_id"] for r in rows}
    assert 100 < len(docs) <= 200
    assert len(rows) == len({(r["doc_id"], r["piece"]) for r in rows})
