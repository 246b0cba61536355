"""BPE, fingerprints, toxicity, language and licences."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausemill.llm import bpe, fingerprints, language_id, licences, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "Hello, World! it's 5 o'clock", "<|endoftext|>a<|startoftext|> b<|endoftext", "ΑΣ ΟΔΟΣ İı ẞ", "é" * 300, "x" * 3000, "a\u0085b\u001fc d", "ﬁ ½ 漢字 한글 👩‍👩‍👧", "don't DON'T we'LL", "Hello, World! it's 5 o'clock"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "null key", "clash", 1)], "doc_id long, text string, ids string, n_tokens int")


def test_bpe_equals_library(spark, odd):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    rows = bpe.encode_documents(odd, PATH).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        text = "null key" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(bytes(r.ids), "<u4")) == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_documents(odd.limit(0), PATH).collect() == []


def test_bpe_heap_equals_array():
    model = bpe.WordBPE(open(PATH, encoding="utf-8").read())
    draw = random.Random(4)
    for _ in range(60):
        word = "".join(draw.choice("theranidsol") for _ in range(draw.randint(1, bpe.LONG)))
        parts = [model.inner[b] for b in word.encode()]
        assert model._merged_long(list(parts)) == model.merged(list(parts))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def test_fingerprints_estimate_generalised_jaccard(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = {i: " ".join(draw.choice(words) for _ in range(draw.randint(0, 300))) for i in range(60)}
    texts |= {60: None, 61: "", 62: "one Two", 63: "ONE two", 64: "a b c d e " * 400}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, n_chars string")
    rows = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    assert set(rows) == set(texts)
    errors, order = [], sorted(texts)
    for at, k in enumerate(order):
        own, following = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        new = own[: len(own) - half] + following[:half]
        assert rows[k].n_chars == len(own) and rows[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = shingles(own), shingles(new)
        errors.append(rows[k].near_edited - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.06
    assert rows[62].fingerprint == rows[63].fingerprint and rows[62].near_next == 1.0
    assert rows[60].fingerprint == rows[61].fingerprint == "0" * 4 * fingerprints.SAMPLES and rows[61].near_next == 0.0


def test_fingerprint_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "z"), (1, None)], "doc_id long, text string")
    assert len(fingerprints.fingerprint_documents(df).collect()) == 4
    assert [r.near_next for r in fingerprints.fingerprint_documents(df.limit(1)).collect()] == [1.0]
    assert fingerprints.fingerprint_documents(df.limit(0)).collect() == []


def test_toxicity_learns_and_shares_grams(spark):
    draw = random.Random(5)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        w = [draw.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            w[draw.randrange(40)] = draw.choice(["stupidity", "idiotic", "worthless"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "word1 " * 20 + "stupidityy"), (None, "word2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, _, y in labels if got[i].held_out and got[i].predicted != y]
    assert sum(got[i].held_out for i, _, _ in labels) > 40 and len(wrong) <= 2
    assert got[1002].predicted == 1 and got[1000].score == got[1001].score and got[None].held_out is False
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.score < 0.5}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score_documents(docs, none).collect()] == [0]


@pytest.mark.parametrize("join", ["/", "_", "\u200b", ".", "\u3002"])
def test_toxic_words_in_the_middle_of_long_tokens(join):
    draw = random.Random(5)
    plain = [f"word{i}" for i in range(60)]
    texts = [" ".join(draw.choice(plain) for _ in range(20)) + (" worthless" if i % 4 == 0 else "") for i in range(200)]
    model = toxicity.train(texts, [int(i % 4 == 0) for i in range(200)]).scorer()
    words = [plain[i % 60] for i in range(20)]
    assert model.score(join.join([*words, "worthless", *words])) > 0.5 > model.score(join.join(words + words))


def test_long_tokens_lose_no_gram():
    token = "".join(chr(0x4E00 + i) for i in range(1000))
    for cut in (token, token[:61], token[:80], token[:81]):
        marked, pieces = f"<{cut}>", [t[1:] for t in toxicity.tokens(cut)]
        assert {marked[i : i + n] for n in toxicity.SIZES for i in range(len(marked) - n + 1)} == {p[i : i + n] for p in pieces for n in toxicity.SIZES for i in range(len(p) - n + 1)}
        assert sum(map(len, pieces)) < 1.5 * len(marked)
    assert toxicity.tokens("-" * 99) == ["-" * 99] and toxicity.bags(["-" * 99])[1].tolist() == [0]


def test_bags_share_what_words_share():
    words = ["stupid", "stupidd", "Ab", "a", "...", "é漢字x", "stupid!"]
    found, counts = toxicity.bags(words)
    cut = np.split(found, np.cumsum(counts)[:-1])
    bag = dict(zip(words, map(Counter, map(np.ndarray.tolist, cut))))
    for w, x in zip(words, cut):
        n = len(w.strip(toxicity.EDGE)) + 2
        assert len(x) == (sum(max(0, n - k + 1) for k in toxicity.SIZES) + 1 if n > 2 else 0)
    assert bag["stupid"] == bag["stupid!"]
    grams = lambda w: {f"<{w}>"[i : i + k] for k in toxicity.SIZES for i in range(len(w) + 3 - k)}
    assert sum((bag["stupid"] & bag["stupidd"]).values()) == len(grams("stupid") & grams("stupidd"))


def test_scores_equal_plain_python(spark):
    """Scores recomputed from the table of weights, word by word and passage by passage."""
    draw = random.Random(3)
    weights = np.random.default_rng(1).normal(0, 3, toxicity.BUCKETS)
    model = toxicity.Model(weights, -1.5)

    def part(word):
        found, counts = toxicity.bags([word])
        return float(np.mean(model.weights[found].astype(np.float64))) if counts[0] else 0.0

    texts = ["", None, "one", "... !"] + [" ".join(f"w{draw.randrange(300)}" for _ in range(n)) for n in (1, 20, 23, 24, 25, 35, 36, 37, 48, 700)]
    for text in texts:
        words = (text or "").lower().split()
        cuts, rest = [], words
        while len(rest) >= 24 + 12:
            cuts.append(rest[:24])
            rest = rest[24:]
        cuts += [rest] if rest else []
        z = [-1.5 + sum(map(part, c)) / len(c) for c in cuts] or [-1.5]
        pooled = np.log(np.sum(np.exp(2.0 * np.asarray(z)))) / 2.0
        assert abs(model.scorer().score(text or "") - 1 / (1 + np.exp(-pooled))) < 1e-6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: round(r.score, 9) for r in toxicity.score_texts(df, model).collect()} == {i: round(model.scorer().score(t or ""), 9) for i, t in enumerate(texts)}


def test_long_texts_are_judged_by_their_passages():
    draw = random.Random(5)
    plain = [f"word{i}" for i in range(60)]
    texts = [" ".join(draw.choice(plain) for _ in range(40)) + (" worthless idiotic" if i % 4 == 0 else "") for i in range(300)]
    model = toxicity.train(texts, [int(i % 4 == 0) for i in range(300)]).scorer()
    long = [draw.choice(plain) for _ in range(20_000)]
    assert model.score(" ".join(long)) < 0.5 < model.score(" ".join([*long[:9000], "worthless", "idiotic", *long[9000:]]))


def test_late_declarations_count(spark):
    late = "x" * 6000
    pages = [(1, f"<!-- {late} <html lang=fr> --><html lang='de'>"), (2, f"<style>{late}</style><meta http-equiv=content-language content='de'>"), (3, f"<html><script>{late} '<html lang=fr>'</script>"), (4, "<html lang=de>"), (5, None)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert {r.page_id: r.d for r in df.select("page_id", language_id.declared_language(F.col("html")).alias("d")).collect()} == {1: "de", 2: "de", 3: None, 4: "de", 5: None}


def test_language_evidence(spark):
    texts = {"en": "the cat sat on the mat with this and that for the house", "de": "der hund und die katze mit dem haus auf der strasse nicht", "fr": "le chat est dans la maison avec les enfants pour une"}
    docs = spark.createDataFrame([(i * 3 + k, (t + " ") * 3, g) for i in range(5) for k, (g, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    pages = [(1, "https://a.example.de/x", f"<html lang='de'><p>{texts['de']}</p></html>"), (2, "http://a.example.de/y", "<html lang='de-AT'></html>"), (3, None, None), (4, "http://b.org", f"<html lang=xx><script>var the = 'the the';</script>{texts['en']}"), (5, "http://a.example.de/z", f"<p>{texts['fr']}"), (1, "https://a.example.de/x", f"<html lang='de'><p>{texts['de']}</p></html>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, language string")
    rows = sorted(language_id.identify_languages(df, docs).collect())
    got = {r.page_id: r for r in rows}
    assert len(rows) == 6 and [got[i].language for i in (1, 2, 4, 5)] == ["de", "de", "en", "fr"]
    assert got[2].text_language is None and got[2].declared == "de" and got[3].host is None and got[3].language
    assert language_id.identify_languages(df.limit(0), docs).collect() == []
    assert {r.language for r in language_id.identify_languages(df, docs.limit(0)).collect()} == {None}


def test_licences(spark):
    rows = [(1, "prose\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "er kommt mit dem zug"), (6, None), (7, ""), (8, "you need a driving license to rent a car"), (2, "Released under the MIT License."), (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    got = licences.scan_licences(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, probability int")).collect()
    assert sorted((r.doc_id, r.licence) for r in got) == sorted([(1, "apache"), (2, "mit"), (2, "mit"), (3, "gpl"), (4, "cc-by-nc"), (5, "none"), (6, "none"), (7, "none"), (8, "none"), (9, next(r.licence for r in got if r.doc_id == 9))])
    assert next(list(r.families) for r in got if r.doc_id == 9) == ["cc-by-nc", "mit"]
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licence_paragraphs_that_wrap(spark):
    mit = licences.PASSAGES["mit"][0]
    words = mit.split()
    wrapped = "Intro ends here.\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + ".\nOther text."
    rows = [(1, wrapped), (2, "GNU Affero General Public License v3"), (3, "Licensed under the Eclipse Public License 2.0"), (4, "Licensed under the Sleepycat License."), (5, "SPDX-License-Identifier: LGPL-2.1-or-later"), (6, "This is free and unencumbered software released into the public domain."), (7, "Copyright 2020 Foo Inc. All rights reserved."), (8, "Licensed under CC BY 4.0."), (9, "Use is governed by the Reciprocal Public License.")]
    got = {r.doc_id: r.licence for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "agpl", 3: "epl", 4: "none", 5: "lgpl", 6: "unlicense", 7: "proprietary", 8: "cc-by", 9: "none"}


def test_licences_in_unseen_frames_and_unknown_ones(spark):
    """Statements in frames, and licences, that the training has not seen; and probabilities recomputed in plain Python."""
    unseen = licences.statements(licences.UNSEEN_FRAMES, licences.UNSEEN_UNKNOWN)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(unseen)], "doc_id long, text string")
    found = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    known = [(i, f) for i, (_, f) in enumerate(unseen) if f != "none"]
    assert sum(found[i].licence == f for i, f in known) >= 0.97 * len(known)
    assert all(found[i].licence == "none" for i, (_, f) in enumerate(unseen) if f == "none")
    families, weights, biases, temperature = licences.trained()
    for i, (text, _) in list(enumerate(unseen))[::17]:
        own = [weights[g] for g in licences._features(text) if g in weights]
        z = (np.sum(own, 0) / max(1.0, len(own) ** 0.5) + np.asarray(biases)) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if found[i].paragraphs:
            assert abs(found[i].probability - p.max()) < 1e-5
