"""Substring dedup, filter audit and Merkle manifest against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pulsegrid.llm import audit, common, merkle, substrings
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- substring dedup ----------------------------------------------------------------------


def cut_by_hand(rows, width=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, own in split:
        for k in range(len(own) - width + 1 if i is not None else 0):
            w = tuple(own[k : k + width])
            least[w] = min(i, least.get(w, i))
    out = Counter()
    for i, own in split:
        gone = set()
        for k in range(len(own) - width + 1 if i is not None else 0):
            if least[tuple(own[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(w for k, w in enumerate(own) if k not in gone)
        out[(i, len(own), len(gone), kept.decode())] += 1
    return out


def cut_rows(docs, **kw):
    got = substrings.remove_repeated(docs, **kw).collect()
    assert all(sum(s["past"] - s["first"] for s in r["spans"]) == r["n_removed"] for r in got)
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got)


def passages(seed, n=120, vocabulary=40):
    """Texts that share passages, whole or in part, next to words of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(shared) if rng.random() < 0.9 else shared[0]
            a = rng.randrange(len(p))
            own += p[a:] if rng.random() < 0.5 else p
            own += [f"u{i}x{k}" for k in range(rng.randrange(0, 9))]
        rows.append((rng.randrange(-50, 400), rng.choice([" ", "\n", "\t ", "  "]).join(own)))
    return rows


@pytest.mark.parametrize("hot", [0.004, 0.2, 2.0])
def test_substrings_equal_brute_force(spark, hot):
    rows = passages(int(hot * 1000)) + [(None, "a b " * 20), (None, "a b " * 20), (7, "a b " * 20), (7, "a b " * 20)]
    rows += [(9, "a b " * 20), (9, "c " + "a b " * 20), (11, None), (12, ""), (13, " \n "), (14, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cut_rows(docs, hot=hot) == cut_by_hand(rows)


@pytest.mark.parametrize("crowd", [2, 200])
def test_substrings_over_many_shards(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "ANCHORS_PER_SHARD", 40)
    monkeypatch.setattr(substrings, "WORDS_PER_SHARD", 150)
    rows = passages(5, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert cut_rows(docs, hot=0.1, crowd=crowd) == cut_by_hand(rows)


def test_substrings_of_hot_copies_long_texts_and_other_columns(spark, empty):
    long = " ".join(f"n{i % 977} m{i % 31}" for i in range(12_000))
    rows = [(i, "same words in every text of this group " * 4) for i in range(300)] + [(1000, long), (1001, long)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, kept string")
    assert cut_rows(docs) == cut_by_hand(rows)
    assert substrings.remove_repeated(empty).collect() == []


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(3)
    known, strings = substrings.Automaton(), []
    for _ in range(40):
        s = [rng.randrange(3) for _ in range(rng.randrange(0, 12))]
        known.add(s)
        strings.append(s)
        probe = [rng.randrange(3) for _ in range(30)]
        subs = {tuple(x[a:b]) for x in strings for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
        want = [i for i in range(30) if i >= 3 and tuple(probe[i - 3 : i + 1]) in subs]
        assert [i for i, _ in known.ends(probe, 4)] == want


# --- filter audit ---------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    texts = defaultdict(list)
    for i, _, t in rows:
        if i is not None:
            texts[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, source, t in rows:
        t = t or ""
        own = t.encode().split()
        fails = {
            "A": len(own) < 50,
            "B": 100 * len(set(own)) < 65 * len(own),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j < i for j in texts[t]),
        }
        parts[source or ""].append((i, {f for f in fails if fails[f]}))
    out = []
    for part, docs in parts.items():
        shapley = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                earlier = set(order[:k])
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                redundant = sum(f in d[1] and bool(d[1] & earlier) for d in docs)
                alone = sum(d[1] == {f} for d in docs)
                lost = [sum(d[0] is not None and d[0] in s for d in gone) for s in (good, toxic)]
                steps.append((part, "".join(order), k + 1, len(left), len(gone), redundant, alone, *lost, f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audit_rows(docs, labels):
    return sorted(tuple(r[c] for c in COLUMNS) for r in audit.audit(docs, labels).collect())


def audit_fixture(spark, n=400):
    rng = random.Random(8)
    plain = [" ".join(f"word{rng.randrange(400)}" for _ in range(60)) for _ in range(20)]
    make = [
        lambda: rng.choice(plain),
        lambda: "SHOUT " * rng.randrange(1, 60),
        lambda: f"{rng.choice(plain)} 5 % | {rng.random()}",
        lambda: " ".join(f"x{rng.randrange(9)}" for _ in range(70)),
        lambda: None,
        lambda: "",
    ]
    rows = [(i if rng.random() < 0.95 else None, rng.choice(["a", "a", "b", "", None]), rng.choice(make)()) for i in range(n)]
    rows += rows[:5]
    labels = [(rng.randrange(n), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(n)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 3, "y") for r in rows], "doc_id long, source string, text string, part int, bits string")
    return rows, labels, docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("heavy", [1e-4, 0.05])
def test_audit_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(audit, "HEAVY", heavy)
    monkeypatch.setattr(audit, "RANGE", 5)
    rows, labels, docs, marks = audit_fixture(spark)
    assert audit_rows(docs, marks) == audit_by_hand(rows, labels)


def test_audit_of_no_rows_and_no_labels(spark, empty):
    rows, labels, docs, marks = audit_fixture(spark, 30)
    assert audit_rows(docs, marks.limit(0)) == audit_by_hand(rows, [])
    assert audit_rows(empty, marks) == []


def test_merges_of_sorted_lists():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(1, 6))]
        a, b = lists[0], lists[-1]
        assert audit.union(lists) == sorted(set().union(*lists))
        assert audit.difference(a, b) == sorted(set(a) - set(b))
        assert audit.common(a, b) == len(set(a) & set(b))
        if a:
            x, at = rng.randrange(70), rng.randrange(len(a))
            assert audit.gallop(a, x, at) == max(at, next((i for i, v in enumerate(a) if v >= x), len(a)))


# --- Merkle manifest ------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(level, ways):
    """Root over a level; ``ways`` gets the (side, sibling) steps of each leaf."""
    under = [[i] for i in range(len(level))]
    while len(level) > 1:
        up, below = [], []
        for k in range(0, len(level), 2):
            pair = level[k : k + 2]
            for i in under[k]:
                ways[i].append(("R", pair[1]) if len(pair) == 2 else ("N", ""))
            for i in under[k + 1] if len(pair) == 2 else []:
                ways[i].append(("L", pair[0]))
            up.append(H(*pair))
            below.append([i for u in under[k : k + 2] for i in u])
        level, under = up, below
    return level[0]


def manifest_by_hand(rows):
    def leaf(r, more=0):
        doc_id, text, lang, source, n = r
        n = n if n is None else n + more
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        ways = [[] for _ in own]
        trees.append((own, ways, grow([leaf(r) for r in own], ways)))
    tops = [[] for _ in trees]
    root = grow([t[2] for t in trees], tops) if trees else None
    out = Counter()
    for (own, ways, subroot), top in zip(trees, tops):
        for r, way in zip(own, ways):
            steps = way + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf(r, 1 if tampered else 0)
            for side, s in steps:
                at = H(at) if side == "N" else H(at, s) if side == "R" else H(s, at)
            out[(r[0], leaf(r), subroot, root, H(*[s for _, s in steps]), at, at == root)] += 1
    return out


def manifest_fixture(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((
                rng.choice([None, rng.randrange(-99, 9999), rng.randrange(9999)]), rng.choice([None, "", "é☃", "a:b", "text"]),
                lang, rng.choice([None, "s"]), rng.choice([None, 0, 5]),
            ))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_brute_force(spark, levels):
    sizes = {None: 3, "": 1, "en": 37, "ünï": 2, "Z": 8, "z": 5} if levels < 10 else {"en": 2100, "de": 1, "fr": 1024, None: 5}
    rows = manifest_fixture(levels, sizes)
    rows += rows[:3]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS pos", "'x' AS leaf", "2 AS tree").repartition(3)
    tampered = F.coalesce(common.bucket_of("doc_id", 7) == 0, F.lit(False))
    got = merkle.manifest(merkle.document_leaves(docs, tampered), levels).collect()
    columns = "id leaf subroot root proof_sha256 folded_root verified".split()
    assert Counter(tuple(r[c] for c in columns) for r in got) == manifest_by_hand(rows)


def test_manifest_of_one_row_and_of_none(spark, empty):
    one = [(4, "x" * 200_000, "en", None, None)]
    docs = spark.createDataFrame(one, DOCS)
    (r,) = merkle.manifest(merkle.document_leaves(docs)).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == H() and r["verified"]
    assert merkle.manifest(merkle.document_leaves(empty)).collect() == []


def test_queue_sweeps_give_the_ways_to_the_root():
    for n in range(1, 70):
        leaves = [H(str(i)) for i in range(n)]
        ways = [[] for _ in leaves]
        root = grow(leaves, ways)
        nodes = merkle.upward(leaves, merkle.height(n))
        assert nodes[-1] == [root]
        paths = merkle.downward(nodes, ())
        assert [[(s[0], s[1:]) for s in p] for p in paths] == ways
        assert all(merkle.fold(x, p) == root for x, p in zip(leaves, paths))
