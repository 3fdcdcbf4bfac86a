"""The training-data operators against brute force, on edge cases and small tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, langid, licenses, packing, quality, simhash, substrings, topk, toxicity, warc
from pulsegrid.llm.common import scratch
from pulsegrid.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, band int, score double"
rnd = random.Random(5)
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h i j k l", "x " * 3000, PASSAGE, "before " + PASSAGE + " after", PASSAGE, "é ñ ß 日本語 " * 9,
    "Licensed under the MIT License.", "released undr the mit lisense", "Apache License, Version 2.0", "under CC BY-NC 4.0", "9 1 ?!\n9 1 ?!",
    *[" ".join(rnd.choice("ab cd ef gh ij kl mn op qr".split()) for _ in range(rnd.randint(1, 80))) for _ in range(25)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), 1, 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, "no id " + PASSAGE, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(SQL[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_warc_chains_reject_magic_in_payloads(spark):
    parts = ["WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é", "x" * 150, "WARC/1.", "\r\n\r\n"]
    rows = [(i, f"u{i}", "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))) for i in range(400)] + [(400, None, None)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = scratch(spark, "test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, compression="none")
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    try:
        for size in ("3000", "100m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            got = {r.record_id: (r.type, bytes(r.payload)) for r in warc.read_warc(spark, path).collect()}
            assert len(got) == len(rows)
            for i, _, h in rows:
                assert got[f"<urn:page:{i}>"] == (("response", (h or "").encode()) if first[h or ""] == i else ("revisit", b""))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_topk_ties_and_bad_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(40, None), (41, [None, 1.0]), (42, [float("nan"), 1.0]), (43, [float("inf"), 0.0]), (44, [])]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(q, F.col("vec_id") % 10 == 0, 3).orderBy("query_id", "rank").collect()
    want = []
    for a in range(0, 40, 10):
        s = sorted((-(1024 * (a % 3) * 1024 * (b % 3) + 1024 * 1024), b) for b in range(40) if b != a)[:3]
        want += [(a, k + 1, b, -x) for k, (x, b) in enumerate(s)]
    assert [tuple(r) for r in got] == want
    assert topk.top_k(q.limit(0), F.lit(True)).count() == 0


def test_language_id(spark, docs):
    rows = [(i, ["the cat and the dog", "le chat et la souris"][i % 2] + f" {i}", ["en", "fr"][i % 2]) for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "the dog"), (2, "la souris et le"), (3, "123 !"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(test, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "fr", "und", "und"] and got[4].rejected and 0 < got[1].score <= 1
    assert langid.keep_known(docs).columns == docs.columns
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(test, none, ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("radius", [0, 4])
def test_links_are_those_of_all_pairs(spark, radius):
    base = [rnd.getrandbits(64) for _ in range(30)] + [0]
    fps = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(12)} | {0})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), radius)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = collections.defaultdict(set), collections.defaultdict(set)
    for f in fps:
        groups[0][root(f)].add(f)
        groups[1][got.get(signed(f), signed(f))].add(f)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_bk_tree_links_match_pairs():
    items = np.array([rnd.getrandbits(12) for _ in range(400)], np.int64)
    links = simhash.shard_links(items, 1)
    parent = {int(x): int(x) for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 1:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {a: b for a, b in links} == {x: root(x) for x in parent if root(x) != x}


def test_near_duplicates_edges(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    assert got[0].fp == got[1].fp == got[2].fp == 0 and got[2].component_id == 0
    assert got[6].component_id == got[8].component_id == 6
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id = 6").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingle_set(text):
    w = words(text)
    return {" ".join(w[i : i + 5]).lower() for i in range(max(1, len(w) - 4))} if w else set()


def one_by_pairs(texts):
    """Numbers of the texts that come first among those that pairs at 0.8 or more reach."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i for i in range(len(texts)) if root(i) == i}


def near_copies():
    texts = []
    for n in [8, 9, 14, 30, 60, 120, 250]:
        for _ in range(6):
            w = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(w))
            for cut in (1, n // 25, n // 12, n // 8, n // 5):  # words off the end: similarities from 0.75 to 0.99
                texts.append(" ".join(w[: n - cut]))
            for _ in range(3):
                texts.append(" ".join(x if rnd.random() > 0.02 else "changed" for x in w))
    return texts


def test_one_of_each_links_jaccard(spark):
    texts = near_copies()
    near = [len(a & b) / len(a | b) for a, b in itertools.combinations(map(shingle_set, texts), 2) if a & b]
    assert sum(0.8 <= x < 0.95 for x in near) > 100 and sum(0.7 <= x < 0.8 for x in near) > 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == one_by_pairs(texts)


def test_one_of_each_keeps_one_row_a_group(spark):
    plain = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    near = plain[0] + " more"
    rows = [
        (None, plain[1]), (None, plain[2]), (None, plain[2] + " more"),  # without an id: alone, and a group
        (1, plain[0]), (1, near), (1, plain[3]),  # one id with near copies, and with another text
        (2, plain[4]), (3, plain[3]), (3, plain[5]), (2, plain[5] + " more"), (None, plain[4]), (4, None), (None, ""), (5, plain[6]), (5, plain[6]),
    ]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 8 and {(None, plain[1]), (1, plain[3]), (2, plain[4]), (2, plain[5] + " more"), (4, None), (5, plain[6])} < set(kept)
    assert sum(t in (plain[0], near) for _, t in kept) == 1 and sum(t in (plain[2], plain[2] + " more") for _, t in kept) == 1


def test_toxicity(spark):
    bad = ["you idiot", "what a stupid loser", "stupid idiot here"]
    rows = [(i, f"{bad[i % 3] if i % 4 == 0 else 'nice words and calm talk'} number {chr(97 + i % 26)} {chr(97 + i // 26)} stupidly plain", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    test = spark.createDataFrame([(1, "a stupid idiot"), (2, "calm talk"), (3, None), (4, "a $tup1d 1d10t")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(test, model, ["doc_id"]).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 0, 0, 1] and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(test, toxicity.fit(docs.limit(0), docs.limit(0)), ["doc_id"]).count() == 4


def test_toxicity_symbols_at_ends_and_spelled_runs(spark):
    bad = ["you idiot", "what a stupid loser", "worthless idiot here", "stupid dumb ass"]
    rows = [(i, f"{bad[i // 4 % 4] if i % 4 == 0 else 'nice words and calm talk of class and as is'} number {chr(97 + i % 26)} {chr(97 + i // 26)} stupidly plain", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    want = {
        "worthle$$ talk": ["worthless"], "worthle55": ["worthless"], "so idio7": ["idiot"], "idi07": ["idiot"], "dumb a55": ["ass"],
        "-idi0t-": ["idiot"], "_idi0t_": ["idiot"], "*idi0t*": ["idiot"], "(idi0t)": ["idiot"], "idio+": ["idiot"], "1d10t!": ["idiot"],
        "i d  i o t": ["idiot"], "i, d / i, o, t": ["idiot"], "s t u p i d i d i o t": ["stupid", "idiot"], "calm s t u p i d  i d i o t": ["stupid", "idiot"],
        "idiot!": [], "(idiot": [], "calm talk!": [], "c l a s s": [], "1 2 3 4": [],
    }
    restorer = toxicity.Restorer(model.grams, model.common)
    found = {t: [w for w in restorer.restored(t, model.weights) if w in model.weights] for t in want}
    assert found == want
    assert any("stupig" in r for r in restorer._readings("stupi6", False))  # 6 stands for g alone
    test = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(test, model, ["doc_id"]).collect()}
    assert [got[i] for i, t in enumerate(want)] == [int(bool(found[t]) or "idiot" in t or "dumb" in t) for t in want]


def test_licenses(spark, docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[10].base_labels == "mit" and got[10].first_word == 1 and got[10].n_base == 1 and got[10].score == 1.0
    assert got[11].base_labels == "" and got[11].labels == "mit" and got[11].spans[0].edits == 2
    assert got[12].base_labels == "apache-2" and "cc-by-nc" in got[13].base_labels
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].score == 0.0


def test_bpe_matches_the_library(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        assert ids[i] == lib.encode_ordinary(t or "") and back[i] == (t or "").encode()


def test_bpe_long_words_fold_alike(monkeypatch):
    c = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for n in [2, 3, 40, 200, 900]:
        for letters in (b"a", b"ab", b"etaoin\xc3\xa9"):
            word = bytes(rnd.choice(letters) for _ in range(n))
            monkeypatch.setattr(bpe, "LONG", 1 << 30)
            want = bpe.fold(word, c.ranks)
            monkeypatch.setattr(bpe, "LONG", 1)
            assert bpe.fold(word, c.ranks) == want


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing._tokenizer(path)
    rows = packing.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, 64).collect()
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = [*tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    total = sum(r.length for r in rows)
    assert max(ends.values()) <= 64 and len(ends) <= 1.05 * total / 64 + 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_ids_match_the_library():
    memory = packing._Ids(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["'", "s", "T", "re", " ", "é", "É", "1", "²", "\x85", "\xa0", "\x1c", "\n", "<|endoftext|>", "ß", "µ", "İ", "Σ", "word", "日"]
    for _ in range(2000):
        text = "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 25)))
        assert packing.token_ids(text, memory).tolist() == memory.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece(seed):
    r = random.Random(seed)
    hist = {n: r.randint(1, 50) for n in r.sample(range(1, 129), 60)}
    used = collections.Counter()
    for length, first, _, n, m, _ in packing.plan(hist, 128):
        assert first == used[length]
        used[length] += n * m
    assert used == collections.Counter(hist)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = quality.assess(docs, labels).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(TEXTS):
        w, t = words(t), t or ""
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w)) and (not r.base_failed or not r.kept)
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_binomial_tail(spark):
    from math import comb

    for k, n in ((0, 10), (3, 50), (20, 200), (200, 200)):
        p = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.05)).first()[0]
        assert abs(p - sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))) < 1e-9


@pytest.mark.parametrize("group", [20_000, 1])
def test_substrings(spark, docs, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc: r for r in substrings.dedup(one).collect()}
    seen = set()
    for i, t in enumerate(TEXTS):
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if x in seen else set()
            seen.add(x)
        if gone:
            assert got[i].n_removed == len(gone)
            assert got[i].kept_sha256 == hashlib.sha256(" ".join(v for k, v in enumerate(w) if k not in gone).encode()).hexdigest()
        else:
            assert i not in got
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_base32(spark):
    for x in ("", "abc", "é"):
        want = base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
        assert spark.range(1).select(warc.base32_sha1(F.lit(x).cast("binary"))).first()[0] == want


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_simhash_is_the_plain_count():
    import xxhash

    for t in TEXTS:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_language_id_rejects_foreign_text(spark):
    en, fr = "the cat and the dog went down to the river with a friend of mine", "le chat et la souris sont dans la maison avec le chien de mon ami"
    rows = [(i, " ".join(rnd.sample((en, fr)[i % 2].split(), 12)), ["en", "fr"][i % 2]) for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(1, "это совсем другой язык " * 20), (2, "这是另一种语言" * 40), (3, en * 5), (4, fr * 5), (5, en * 5)]
    extra = spark.createDataFrame([(*r, "x", 1.0) for r in test], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.predict(extra, model, ["doc_id"]).collect()}
    assert [got[i].rejected for i in range(1, 6)] == [True, True, False, False, False] and got[3].score == got[5].score


@pytest.mark.parametrize("per", [1, 256])
def test_language_id_in_several_passes(spark, monkeypatch, per):
    monkeypatch.setattr(langid, "PER_PASS", per)
    rows = [(i, f"{'abcdefgh'[i % 4] * 3} {'abcdefgh'[i % 4 + 4] * 4} ", "wxyz"[i % 4]) for i in range(80)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, ["doc_id", "lang"]).collect()
    assert len(got) == 80 and all(r.lang == r.lang_pred for r in got)


def test_long_texts_take_time_in_proportion():
    import time

    notices, restorer = licenses.Notices(licenses.NOTICES), toxicity.Restorer(toxicity.log_model(np.ones(28**3, np.int64)))
    start = time.time()
    for t in ("a" * 1_000_000, "a1" * 100_000, "x@" + "b" * 1_000_000, "a " * 300_000, "aaab" * 100_000, "a" + " " * 1_000_000 + "b"):
        toxicity._features(t, restorer, {"idiot": 3.0})
    assert len(licenses.scan_text("released under the mit license " * 100_000, notices)[-1]) == 100_000
    assert time.time() - start < 60


def test_neighbouring_notices_are_both_found():
    spans = licenses.scan_text("Released undr the mit lisense. Released under the MIT license", licenses.Notices(licenses.NOTICES))[-1]
    assert [(s["first_word"], s["end_word"], s["edits"]) for s in spans] == [(0, 5, 2), (5, 10, 0)]


def test_fuzzy_notices_against_all_places():
    """Every notice within its edits at any place is found: dynamic programming over the whole text."""

    def best(text, p):
        row = list(range(len(p) + 1))
        low = row[-1]
        for ch in text:
            new = [0]
            for j, q in enumerate(p):
                new.append(min(row[j] + (ch != q), row[j + 1] + 1, new[j] + 1))
            row, low = new, min(low, new[-1])
        return low

    notices = licenses.Notices(licenses.NOTICES)
    for phrase, label in licenses.NOTICES.items():
        for _ in range(6):
            x = list(phrase)
            for _ in range(rnd.randint(0, 2)):
                x[rnd.randrange(1, len(x) - 1)] = rnd.choice("abcxyz")
            text = "words before " + "".join(x) + " words after"
            assert best(text, phrase) <= 2 and label in licenses.scan_text(text, notices)[5].split(",")
    for text in ("all rights", "general public library", "the quick brown fox jumps"):
        assert licenses.scan_text(text, notices)[5] == "" and all(best(text, p) > max(2, len(p) // licenses.CHARS_PER_EDIT) for p in licenses.NOTICES)


def test_topk_prunes_blocks_of_neighbours():
    r = np.random.default_rng(1)
    centres = r.normal(0, 400, (40, 16))
    vecs = np.floor(centres[r.integers(0, 40, 8000)] + r.normal(0, 8, (8000, 16))).astype(np.int64)
    ids = np.arange(8000)
    blocks = topk.blocks_of(ids, vecs, vecs[:64])
    q = vecs[:50]
    kth = topk.first_kth(ids[:50], q, ids[:2048], vecs[:2048], 10)
    (row, found, score), scored = topk.search_blocks(ids[:50], q, blocks, 10, kth)
    assert scored < 0.5 * 50 * len(blocks)
    for i in range(50):
        s = vecs @ q[i]
        want = sorted((-int(s[j]), j) for j in range(8000) if j != i)[:10]
        assert sorted((-int(b), int(a)) for a, b in zip(found[row == i], score[row == i], strict=True)) == want


def test_topk_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 64)
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(60)]
    q = topk.quantised(spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<float>"))
    few = sorted(map(tuple, topk.top_k(q, F.col("vec_id") % 10 == 0, 3).collect()))
    monkeypatch.setattr(topk, "QUERY_BYTES", 1 << 20)
    assert few == sorted(map(tuple, topk.top_k(q, F.col("vec_id") % 10 == 0, 3).collect())) and len(few) == 18


def test_patterns_place_most_tokens():
    r = np.random.default_rng(2)
    for median in (60, 200):
        lengths = np.clip(np.exp(r.normal(np.log(median), 0.8, 60_000)).astype(int), 1, 1024)
        counts = np.bincount(lengths, minlength=1025)
        total, left = int(lengths.sum()), counts.astype(np.int64)
        list(packing.fitted(left, 1024))
        assert (left * np.arange(1025)).sum() < 0.4 * total
        runs = packing.plan({int(k): int(counts[k]) for k in np.nonzero(counts)[0]}, 1024)
        assert max(x[2] + x[3] for x in runs) <= 1.01 * total / 1024 + 1


def test_plan_is_near_the_least_on_small_cases():
    for _ in range(20):
        pieces = [rnd.randint(1, 12) for _ in range(rnd.randint(1, 7))]

        def fits(bins, rest):
            if not rest:
                return True
            return any(fits([*bins[:i], b - rest[0], *bins[i + 1 :]], rest[1:]) for i, b in enumerate(bins) if b >= rest[0])

        least = next(n for n in range(1, 8) if fits([12] * n, sorted(pieces, reverse=True)))
        assert max(x[2] + x[3] for x in packing.plan(dict(collections.Counter(pieces)), 12)) <= least + 1


def test_other_tokenizers_are_asked_for_whole_texts():
    memory = packing._Ids(public_tokenizers.path("word_bpe_49k.json"))
    assert memory.known
    memory.known = False
    assert packing.token_ids("Don't  stop", memory).tolist() == memory.encoded("Don't  stop").tolist()


def test_quality_certifies_the_joint_verdict(spark):
    """Two rules that each reject 4 % of the good texts reject 8 % together: only the surer one may act."""
    names = [*quality.RULES]
    rows = []
    for i in range(12_000):
        good, x = i % 3 != 0, rnd.random()
        scores = dict.fromkeys(names, 0.0)
        scores["symbol_ratio"] = 0.5 if (x < 0.02 if good else x < 0.5) else 0.0
        scores["dup_line_ratio"] = 0.8 if (0.02 < x < 0.07 if good else x > 0.4) else 0.0
        rows.append((i, False, 1, *scores.values(), int(good)))
    cols = "doc_id long, base_failed boolean, band int, " + ", ".join(f"{n} double" for n in names) + ", quality int"
    df = spark.createDataFrame(rows, cols)
    got = quality.thresholds(df.drop("quality"), df.select("doc_id", "quality")).collect()
    assert len(got) == 1 and got[0].cut_symbol_ratio == 0.5 and got[0].cut_dup_line_ratio is None


@pytest.mark.parametrize("n, k", [(10**6, 49_000), (10**9, 49_990_000), (500, 40)])
def test_binomial_tail_at_every_size(spark, n, k):
    from math import erf, sqrt

    p = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), 0.05)).first()[0]
    normal = 0.5 * (1 + erf((k + 0.5 - n * 0.05) / sqrt(2 * n * 0.05 * 0.95)))
    assert abs(p - normal) < 0.01


def test_stages_keep_rows_without_ids(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    null = docs.where("doc_id IS NULL")
    assert quality.keep_good(docs, labels).where("doc_id IS NULL").count() == null.count()
    docs = docs.withColumn("text", F.expr("CASE WHEN doc_id IS NULL THEN array_join(transform(sequence(1, 40), i -> concat('own', i)), ' ') ELSE text END"))
    for stage in (simhash.one_of_each, substrings.without_repeats):
        assert stage(docs).where("doc_id IS NULL").count() == 1 and stage(docs.limit(0)).count() == 0
    assert langid.keep_known(docs.limit(0)).count() == 0


def test_one_digest_over_many_pages_and_repeated_ids(spark, monkeypatch):
    for most in (0, 100):
        monkeypatch.setattr(warc, "DIGESTS", most)
        path = scratch(spark, "test")
        warc.write_warc(spark.createDataFrame([(i // 2, None, "same") for i in range(20)] + [(50, "u", "other")], "page_id long, url string, html string"), path)
        got = collections.Counter(r.type for r in warc.read_warc(spark, path).collect())
        assert got == {"response": 3, "revisit": 18}
