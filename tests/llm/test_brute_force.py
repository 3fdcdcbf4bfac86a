"""Language ID, toxicity and licenses against plain recomputation; empty tables, ties, repeated rows and clashing names."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, langid, licenses, topk, toxicity, warc
from pulsegrid.llm.common import scratch

rnd = random.Random(21)


def samples():
    en, fr = "the cat and the dog sat with some friends".split(), "le chat et la souris avec des amis".split()
    return [(i, " ".join(rnd.choice([en, fr][i % 2]) for _ in range(12)), ["en", "fr"][i % 2]) for i in range(60)]


def test_predictions_are_the_nearest_centroids(spark):
    model = langid.fit(spark.createDataFrame(samples(), "doc_id long, text string, lang string"))
    idf, langs, centres, least = model.block(0)
    texts = ["the dog and le chat", "amis", "Zażółć gęślą jaźń", "日本語", "a", "1 2", "", None, "the dog and le chat", "x" * 5000]
    df = spark.createDataFrame([(i, t, "?", 0.5, True) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double, rejected boolean")
    got = {r.doc_id: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        counts = np.zeros(langid.DIMS, np.int64)
        letters = langid._add_counts(t, counts) if t else 0
        if not letters:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        x = [math.log1p(c) * float(w) for c, w in zip(counts.tolist(), idf.tolist())]
        norm = math.sqrt(sum(v * v for v in x))
        cosines = [sum(a * b for a, b in zip(x, c.tolist())) / norm for c in centres]
        best = max(range(len(langs)), key=lambda j: (cosines[j], -j))
        assert abs(got[i].score - min(1.0, max(0.0, cosines[best]))) < 1e-5
        near = [langs[j] for j in range(len(langs)) if cosines[j] > cosines[best] - 1e-5]
        assert got[i].lang_pred in near
        limits = [least[j] for j in range(len(langs)) if langs[j] == got[i].lang_pred]
        if abs(got[i].score - limits[0] * min(1.0, letters / langid.FULL_LETTERS)) > 1e-5:
            assert got[i].rejected == (got[i].score < limits[0] * min(1.0, letters / langid.FULL_LETTERS))
    assert got[0][1:] == got[8][1:]


def test_learning_counts_repeated_rows_and_leaves_null_ids_out_of_nothing(spark):
    rows = samples()
    df = spark.createDataFrame([*rows, *rows[:9], (None, "der hund und die katze " * 3, "de")], "doc_id long, text string, lang string")
    assert {r.lang for r in langid.fit(df).table.collect()} >= {"en", "fr"}
    same = [(i, "ab ab", lang) for i, lang in enumerate(["xx", "aa"] * 10)]
    tie = langid.fit(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "ab ab")], "doc_id long, text string"), tie, ["doc_id"]).first()
    assert got.lang_pred == "aa"  # of languages that are equally near, the first


def test_decoding_is_the_best_of_all_readings():
    counts = np.zeros(toxicity.N**3, np.int64)
    text = ("stupid idiot loser worthless ass hello bottle class isolate " * 5).encode()
    c = np.concatenate([[0], toxicity._CODE[np.frombuffer(text, np.uint8)], [0]])
    counts += np.bincount(c[:-2] * toxicity.N**2 + c[1:-1] * toxicity.N + c[2:], minlength=toxicity.N**3)
    model = toxicity.log_model(counts)

    def value(readings):
        a = b = 0
        s = -sum(cost for _, cost in readings)
        for ch in "".join(x for x, _ in readings) + "\0":
            k = 0 if ch == "\0" else ord(ch) - 96
            s += model[a, b, k]
            a, b = b, k
        return s

    for token in ["1d10t", "$tup1d", "l0$er", "a55", "cl4ss", "b0tt|e", "heeello", "i$0l@te", "|", "w0rth13$$", "*d*"]:
        best = max(value(list(r)) for r in itertools.product(*toxicity._lattice(token)))
        said = toxicity.decode(token, model.tolist())
        reached = [r for r in itertools.product(*toxicity._lattice(token)) if "".join(x for x, _ in r) == said]
        assert reached and max(value(list(r)) for r in reached) == pytest.approx(best), token


def test_segments_are_the_likeliest_cuts():
    common = {w: -math.log(k + 2) for k, w in enumerate(["stupid", "idiot", "id", "so", "s", "you", "yo"])}
    cost = lambda w: common.get(w, -toxicity.UNKNOWN_COST * len(w) - toxicity.RARE_COST)
    for run in ["stupididiot", "yousoid", "sxid", "q", "idid"]:
        cuts = [c for n in range(len(run)) for c in itertools.combinations(range(1, len(run)), n)]
        best = max(sum(cost(run[a:b]) for a, b in itertools.pairwise([0, *c, len(run)])) for c in cuts)
        got = toxicity.segmented(run, common)
        assert "".join(got) == run and sum(map(cost, got)) == pytest.approx(best)


def test_scores_are_those_of_the_features(spark):
    bad = ["you idiot", "what a stupid loser"]
    rows = [(i, f"{bad[i % 2] if i % 4 == 0 else 'calm words'} number {chr(97 + i % 26)}{chr(97 + i // 26)}", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    texts = ["a stupid idiot", "calm", None, "", "a stupid idiot", "IDIOT", "x " * 20_000 + "idi0t"]
    df = spark.createDataFrame([(i, t, 7.0, 3) for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted int")
    got = {r.doc_id: r for r in toxicity.score(df, model, ["doc_id"]).collect()}
    restorer = toxicity.Restorer(model.grams, model.common)
    for i, t in enumerate(texts):
        x = toxicity._features(t or "", restorer, model.weights)
        want = 1 / (1 + math.exp(-max(-30, min(30, model.coefs[0] + sum(a * b for a, b in zip(x, model.coefs[1:]))))))
        assert got[i].score == pytest.approx(want) and got[i].predicted == (want >= 0.5)
    assert got[0][1:] == got[4][1:] and got[2][1:] == got[3][1:]
    assert toxicity.score(df.limit(0), model, ["doc_id"]).count() == 0


def test_base_places_of_all_windows(spark):
    vocab = "under the mit license apache version 2 cc by nc MIT Licence".split()
    texts = [None, "", "  ", *(rnd.choice(["", "-", " "]).join([]) + rnd.choice([" ", ", ", "\n", "/"]).join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for _ in range(150))]
    texts += ["é under the mit license É", "under_the_mit_license", "underéthe mit license", "cc-by-nc cc by nc"]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, spans int")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), first, last)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_empty_tables_and_null_ids(spark):
    path, docs = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, path, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.quantised(vectors), F.col("vec_id") % 10 == 0, 3).count() == 0
    pages = spark.createDataFrame([(None, "u", "same"), (None, None, "same"), (3, None, "same"), (4, "v", None)], "page_id long, url string, html string")
    folder = scratch(spark, "test")
    warc.write_warc(pages, folder)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == 4 and sorted(r.type for r in got).count("response") >= 2
    folder = scratch(spark, "test")
    warc.write_warc(pages.limit(0), folder)
    assert warc.read_warc(spark, folder).count() == 0
