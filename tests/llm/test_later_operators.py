"""Operators 11 to 13 against brute force and on edge cases; texts that must not be swapped."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import audit, codes, ngramjoin, simhash, substrings

rnd = random.Random(11)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Operator 11

def lloyd(rows, parts=8, entries=16, rounds=6):
    """Every part against every entry in every round, in whole Python numbers."""
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, rows[k][1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(kept[k][1], p) for k in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        got = [[min((far(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
        if r < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut(v, p) for (_, v, _), g in zip(kept, got) if g[p][1] == j]
                    if own:
                        books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    errors = [sum(d for d, _ in g) for g in got]
    by = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in g), e, by[label], digest) for (i, _, label), g, e in zip(kept, got, errors)), key=repr)


VEC = "vec_id long, vector array<float>, label int, code string, vec int"


@pytest.mark.parametrize("n", [1, 9, 16, 120])
def test_codes_are_those_of_full_rescans(spark, n):
    rows = [(i * 3 % n, [float(np.float32(rnd.choice([rnd.gauss(0, 0.3), 0.25, -0.1]))) for _ in range(16)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += rows[: n // 4] + [(None, [0.5] * 16, None)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], VEC).repartition(3)
    got = codes.compressed(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows)


def test_codes_drop_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    good = [(10 + i, [rnd.gauss(0, 1) for _ in range(8)], None) for i in range(20)]
    bad = [(0, None, 1), (1, [nan] * 8, 1), (2, [inf] + [0.0] * 7, 1), (3, [None] + [0.0] * 7, 1), (4, [], 1), (5, [1.0] * 7, 1), (30, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, "", 0) for r in good + bad], VEC)
    assert sorted(r.vec_id for r in codes.compressed(df).collect()) == [i for i, _, _ in good]
    assert codes.compressed(df.limit(0)).count() == codes.compressed(df.where("label = 1 AND vec_id < 5")).count() == 0
    huge = spark.createDataFrame([(i, [3e38] * 8, 1, "", 0) for i in range(3)], VEC)
    assert {(r.error, r.code) for r in codes.compressed(huge).collect()} == {(0, "00" * 8)}


@pytest.mark.parametrize("dropped", [0, 4])
def test_codes_where_batches_hold_no_vector(spark, dropped):
    """Batches of four rows: the sums of each round would come alone in one, and a first one may have only dropped rows."""
    own = random.Random(4)
    good = [(10 + i, [float(np.float32(own.gauss(0, 0.3))) for _ in range(16)], i % 3) for i in range(24)]
    bad = [(i, None, 1) for i in range(dropped)]
    df = spark.createDataFrame([(*r, "", 0) for r in bad + good], VEC).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = codes.compressed(df)
        assert sorted(map(tuple, got.collect()), key=repr) == lloyd(good)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unmoved_entries_are_not_compared_again():
    gen = np.random.default_rng(3)
    vecs = gen.integers(-500, 500, (400, 2, 4))
    books = vecs[:16].transpose(1, 0, 2).copy()
    state = np.zeros((400, 2), np.int64), np.zeros((400, 2), np.int64)
    full = codes.assign(vecs, *state, books, np.ones((2, 16), bool))
    assert full == 400 * 2 * 16
    moved = np.zeros((2, 16), bool)
    moved[0, 3] = moved[1, 0] = True
    books[0, 3] += 7
    books[1, 0] = books[1, 5]  # a tie of entries: the lower index takes all
    less = codes.assign(vecs, *state, books, moved)
    for p in range(2):
        d = codes.distances(vecs[:, p], books[p])
        assert (state[0][:, p] == d.argmin(axis=1)).all() and (state[1][:, p] == d.min(axis=1)).all()
    assert less < full / 4


# Operator 12

def shingle_set(text, k=4):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts, percent):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            links += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))], links


def families():
    """Families of edited texts with similarities on both sides of the limit, a passage in many, and odd texts."""
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocab) for _ in range(40))
    texts = [None, "", " \t\n", "One", "one", "a b c", "A B C", "a b c d", "x " * 500, "x " * 700, "é ñ ß É", "é ñ ß é"]
    for size in (12, 40, 130, 600):
        for _ in range(4):
            base = [rnd.choice(vocab) for _ in range(size)]
            for e in range(12):
                w = list(base)
                for _ in range(max(1, size * e // 700)):
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
                texts.append(" ".join(w) + (" " + passage if e % 4 == 3 else ""))
    return texts


@pytest.mark.parametrize("block", [4096, 5])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    if block < 100:
        monkeypatch.setattr(ngramjoin, "MEMBERS", 300)
    texts = families()
    want, links = components(texts, 85)
    assert links > 200
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(5)
    got = ngramjoin.similar_documents(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == want


def test_trees_miss_nothing_and_follow_few_boxes():
    gen = np.random.default_rng(1)
    sets = [np.unique(gen.integers(0, 1 << 63, rnd.choice([70, 300, 320, 350]), np.uint64)) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[gen.random(len(s)) > 0.05], gen.integers(0, 1 << 63, 8, np.uint64)])) for s in sets[:100]]
    n, nodes = np.array([len(s) for s in sets]), np.arange(len(sets))
    pairs = {(j, i) for i, j in itertools.combinations(range(len(sets)), 2) if ngramjoin.reach(np.int64(len(np.intersect1d(sets[i], sets[j]))), n[i], n[j], 85)}
    assert len(pairs) > 20
    points, two = [ngramjoin.point(s) for s in sets], np.full(len(sets), 2)
    found = ngramjoin.candidates(nodes, nodes, n, np.zeros(len(sets), np.int64), points, two)
    assert pairs <= {tuple(p) for p in found.tolist()} and len(found) < 3 * len(pairs) + 50
    joined = {frozenset(p) for p in ngramjoin.stars(nodes, sets)}
    root = list(range(len(sets)))
    for a, b in joined:
        assert (max(a, b), min(a, b)) in pairs
    for edges in (joined, pairs):
        root = list(range(len(sets)))
        for a, b in edges:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        groups = sorted(sorted(i for i in range(len(sets)) if root[i] == r) for r in set(root))
        first = groups if edges is joined else first
    assert groups == first
    sides = np.array([i % 2 for i in range(len(sets))])
    half = ngramjoin.candidates(nodes, nodes, n, np.zeros(len(sets), np.int64), points, sides)
    assert {p for p in pairs if (p[0] + p[1]) % 2} <= {tuple(p) for p in half.tolist()}
    assert all((a + b) % 2 for a, b in half.tolist())


def test_prefixes_hold_a_member_in_common():
    for n in range(1, 400):
        assert ngramjoin.prefix(n) == n - -(-85 * n // 100) + 1


def test_join_edges(spark):
    rows = [(None, "p q r s t u", 1), (None, "p q r s t u", 1), (3, "p q r s t u", 1), (3, "p q r s t u", 1), (None, "only null", 1), (7, None, 1), (7, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = collections.Counter(map(tuple, ngramjoin.similar_documents(df).collect()))
    assert got == {(None, 3, 3): 2, (3, 3, 3): 2, (None, 1, None): 1, (7, 0, 7): 2}
    assert ngramjoin.similar_documents(df.limit(0)).count() == 0
    long = " ".join(f"t{i}" for i in range(60_000))
    got = ngramjoin.similar_documents(spark.createDataFrame([(1, long), (2, long + " end"), (3, "t1 " * 9)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 59_997, 1), (2, 59_998, 1), (3, 1, 3)]


# Operator 13

def audited(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, s in rows:
        t, f = t or "", set()
        w = words(t)
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        f |= {"D"} if set(t) & set("#$%&*|") else set()
        f |= {"E"} if t in first and (i is None or first[t] < i) else set()
        fails.append((s or "", f, i in good, i in toxic))
    out = []
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        shapley = collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [x for x in own if f in x[1] and not x[1] & set(order[:k])]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), k + 1, sum(not x[1] & set(order[: k + 1]) for x in own), len(gone),
                              sum(f in x[1] and bool(x[1] & set(order[:k])) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 16, 64])
def test_audit_counts_every_order(spark, monkeypatch, size):
    monkeypatch.setattr(audit, "MOST", size)  # a crowded sketch clears fewer texts; counts stay the same
    monkeypatch.setattr(audit, "LEAST", size)
    monkeypatch.setattr(audit, "BLOCK", 32)
    plain = " ".join(f"v{i}" for i in range(60))
    texts = [None, "", "A", plain, plain.upper(), plain + " #", "x " * 80, "É " * 70, plain + "\x85end", "a b " * 60]
    rows = [(i, rnd.choice(texts) if i % 3 else plain + f" n{i}", rnd.choice([None, "", "web", "book"])) for i in range(150)]
    rows += [(None, plain, "web"), (None, "never else " * 40, None), (None, "never else " * 40, None), rows[5], rows[7]]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mask int").repartition(7)
    got = audit.interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert audit.interactions(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_sketch_clears_unique_texts_and_never_a_repeat(spark):
    texts = [f"text {i}" for i in range(5000)] + [f"text {i}" for i in range(0, 5000, 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    size, bits = audit.repeated_counters(df)
    h = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in texts], np.uint64).view(np.int64)
    at = audit.cells(h, size)
    unsure = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
    twice = np.array([int(t.split()[1]) % 50 == 0 for t in texts])
    assert unsure[twice].all() and unsure[~twice].mean() < 0.01


# Texts that must not be swapped

def test_substring_dedup_keeps_rows_whose_short_hashes_agree(spark):
    seen, pair = {}, None
    for i in itertools.count():
        h = xxhash.xxh64_intdigest(f"t{i}", 42) & 0x7FFFFFFF
        if h in seen:
            pair = f"t{seen[h]}", f"t{i}"
            break
        seen[h] = i
    shared = " ".join(f"s{i}" for i in range(30))
    texts = [" ".join(f"{c}{i}" for i in range(33)) + " " + shared for c in "abcde"]
    rows = [(None, t) for t in (*texts, *pair)] + [(4, texts[0] + " own"), (4, texts[1] + " other"), ((1 << 63) - 1, texts[2])]
    out = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    assert set(pair) < set(got[None]) and len(got[None]) == 7
    # Ids come first, then null ids; the words of each text that are its own are kept once.
    every = " ".join(t for v in got.values() for t in v).split()
    assert collections.Counter(every).most_common(1)[0][1] == 1
    assert set(every) == {w for _, t in rows for w in t.split()}
    assert len(got[4]) == 2 and len(got[(1 << 63) - 1]) == 1


@pytest.mark.parametrize("stage", [simhash.one_of_each, substrings.without_repeats])
def test_stages_leave_columns_of_any_name(spark, stage):
    names = ["_row", "_text", "_node", "_fp", "_bands", "row", "id", "node", "fp", "bands", "n", "at", "h", "doc", "part", "none", "h0", "key", "a.b", "text ", "n_chars"]
    rows = [(i, " ".join(f"{c}{k}" for k in range(40)), *[f"{i}{n}" for n in names[:-1]], i) for i, c in enumerate("abab")]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = stage(df)
    assert got.columns == df.columns
    for r in got.collect():
        assert tuple(r)[2:-1] == rows[r.doc_id][2:-1]
        assert r.n_chars == (r.doc_id if stage is simhash.one_of_each else len(r.text))


@pytest.mark.parametrize("most", [8192, 3])
def test_near_dedup_of_cut_shards(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SETS", most)
    gen = random.Random(2)
    base = [" ".join(gen.choice([f"w{i}" for i in range(90)]) for _ in range(60)) for _ in range(4)]
    texts = [re.sub(r"^(\S+ ){%d}" % (i % 3), f"n{i} ", b) for b in base for i in range(15)]
    sets = [shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    got = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(root)


def test_keys_of_the_same_sets_travel_once(spark):
    rows = [(k, node, node, 100, (k + node) % 5, 30) for k in range(5) for node in (1, 2)] + [(9, node, node, 100, 1, 30) for node in (1, 2, 3)]
    held = spark.createDataFrame(rows, "key long, node long, comp long, n long, place int, band int")
    got = sorted((r.node, r.place) for r in ngramjoin._blocks(held, 85).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 1)]
    text = "Año nuevo\n\t" * 50
    assert ngramjoin.unzipped(ngramjoin.zipped(text)) == text and len(ngramjoin.zipped(text)) < 100 and ngramjoin.unzipped(ngramjoin.zipped(None)) == ""
