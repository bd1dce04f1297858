"""Language mixtures and the classifier against plain Python, and both on awkward rows; token files on awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, quality_classifier, separator_scan

MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def grams(word):
    """Buckets of the 1- to 4-grams of a word with its borders."""
    text, out = "\x1f" + word + "\x1f", []
    for k in (1, 2, 3, 4):
        for i in range(len(text) - k + 1):
            if k == 1 and text[i] == "\x1f":
                continue
            h = k
            for c in text[i : i + k]:
                h = (h * GOLDEN + ord(c)) & MASK
            out.append(mixed(h) % language_id.BUCKETS)
    return out


def learned(rows):
    """Log-probabilities by language from (text, lang) rows."""
    counts = {}
    for text, lang in rows:
        if text is None or lang is None:
            continue
        own = counts.setdefault(lang, {})
        for w in text.lower().split():
            for g in grams(w):
                own[g] = own.get(g, 0) + 1
    out = {}
    for lang, own in counts.items():
        total = language_id.SMOOTH * language_id.BUCKETS + sum(own.values())
        out[lang] = lambda g, own=own, total=total: math.log((own.get(g, 0) + language_id.SMOOTH) / total)
    return out


def em(like, counts, share):
    """Proportions and log-likelihood after ROUNDS rounds, word by word."""
    for _ in range(language_id.ROUNDS):
        new = [0.0] * len(share)
        for row, n in zip(like, counts, strict=True):
            whole = max(sum(p * s for p, s in zip(row, share, strict=True)), 1e-300)
            for k, p in enumerate(row):
                new[k] += n * p * share[k] / whole
        share = [x / sum(counts) for x in new]
    return share, sum(n * math.log(max(sum(p * s for p, s in zip(row, share, strict=True)), 1e-300)) for row, n in zip(like, counts, strict=True))


def mixture(text, model):
    """Language proportions of one text, the weakest language dropped while that costs less than its price."""
    words = {}
    for w in text.lower().split():
        words[w] = words.get(w, 0) + 1
    names = sorted(model)
    like = []
    for w in words:
        g = grams(w)
        score = [sum(model[k](x) for x in g) / len(g) for k in names]
        like.append([math.exp(s - max(score)) for s in score])
    counts = list(words.values())
    open_ = [1] * len(names)
    share, fit = em(like, counts, [1 / len(names)] * len(names))
    price = language_id.PENALTY * math.log(max(sum(counts), 2))
    while sum(open_) > 1:
        weakest = min((k for k in range(len(names)) if open_[k]), key=lambda k: (share[k], k))
        tried = [0 if k == weakest else o for k, o in enumerate(open_)]
        new, new_fit = em(like, counts, [o / sum(tried) for o in tried])
        if fit - new_fit >= price:
            break
        share, fit, open_ = new, new_fit, tried
    return dict(zip(names, share, strict=True))


def prose(letters, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


LETTERS = {"aa": "aeilnst", "bb": "oubdgmr", "cc": "éèàçxyz"}
TEACH = [(prose(LETTERS[k], 60, 10 * i + j), k) for i in range(12) for j, k in enumerate(LETTERS)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [*TEACH, *TEACH[:3], (None, "aa"), ("never", None), ("", "bb")]
    return rows, language_id.train(spark.createDataFrame(rows, "text string, lang string"))


def test_ngram_counts_by_brute_force(model):
    rows, got = model
    want = learned(rows)
    assert sorted(got) == sorted(want)
    assert all(got[k][g] == pytest.approx(want[k](g), abs=1e-12) for k in want for g in range(0, language_id.BUCKETS, 37))


def test_mixtures_by_brute_force(model):
    rows, got = model
    plain, table = learned(rows), np.stack([got[k] for k in sorted(got)])
    texts = [prose(LETTERS["aa"], 30, 1), prose(LETTERS["bb"], 8, 2) + " " + prose(LETTERS["cc"], 24, 3), " ".join(prose(LETTERS[k], 40, 4) for k in LETTERS), "x", "the same same same", prose("abcdeé", 25, 5), prose(LETTERS["cc"], 3, 6)]
    shares = language_id.mixtures([*texts, ""], table)
    for text, row in zip(texts, shares, strict=False):
        want = mixture(text, plain)
        assert row == pytest.approx([want[k] for k in sorted(want)], abs=1e-9), text[:40]
    assert not shares[-1].any()
    assert (shares[2] > 0.2).all() and shares[0].tolist() == [1.0, 0.0, 0.0]  # three languages stay, or one


def test_languages_of_awkward_rows(spark, model):
    _, held = model
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, prose(LETTERS["bb"], 20, 7)), (4, prose(LETTERS["bb"], 20, 7)), (None, prose(LETTERS["aa"], 20, 8)), (5, prose(LETTERS["cc"], 120_000, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("lang", "p", "score")})
    got = df.select("doc_id", language_id.predict(F.col("text"), spark, held).alias("out")).collect()
    found = {(r["doc_id"], r["out"]["lang"]) for r in got}
    assert len(got) == 7 and found == {(1, "und"), (2, "und"), (3, "und"), (4, "bb"), (None, "aa"), (5, "cc")}
    nothing = language_id.train(df.limit(0).select("text", "lang"))
    assert nothing == {} and {r["out"]["lang"] for r in df.select(language_id.predict(F.col("text"), spark, nothing).alias("out")).collect()} == {"und"}
    assert df.limit(0).select(language_id.predict(F.col("text"), spark, held)).count() == 0
    twin = {"zz": held["aa"], "bb": held["aa"]}  # equal in everything: what is kept is one of them, and the same on every run
    picks = {r["out"]["lang"] for r in df.where("doc_id is null").unionAll(df.where("doc_id is null")).select(language_id.predict(F.col("text"), spark, twin).alias("out")).collect()}
    assert len(picks) == 1 and picks <= {"bb", "zz"}


def plain_ftrl(rows, epochs):
    """FTRL-proximal, one row and one feature at a time."""
    q = quality_classifier
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == q.DIM else q.L1
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else (math.copysign(l1, v) - v) / ((q.BETA + math.sqrt(n.get(k, 0.0))) / q.ALPHA + q.L2)

    for _ in range(epochs):
        for found, label in rows:
            x = {**{int(k): q.SCALE / math.sqrt(max(1, len(found))) for k in found}, q.DIM: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-min(30, max(-30, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g, had = (p - label) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / q.ALPHA * w[k]
                n[k] = had + g * g
    return {k: weight(k) for k in z}


def test_the_learner_row_by_row():
    r = random.Random(4)
    rows = [(np.array(sorted(r.sample(range(400), r.randint(0, 30))), dtype=np.int64), r.randint(0, 1)) for _ in range(120)]
    got, want = quality_classifier.ftrl(rows, 3), plain_ftrl(rows, 3)
    assert np.flatnonzero(got).tolist() == sorted(k for k, w in want.items() if w)
    assert all(got[k] == pytest.approx(w, abs=1e-10) for k, w in want.items())


def test_features_and_scores_by_brute_force(spark):
    texts = ["One two, three! one two", "", None, "x", "##$ 12 ÄÖ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r["i"]: r["f"] for r in df.select("i", quality_classifier.features(F.col("text")).alias("f")).collect()}
    # distinct words, pairs and shapes: "one" and "two" share one
    assert [len(found[i]) for i in range(5)] == [5 + 4 + 4, 0, 0, 2, 3 + 2 + 3] and all(found[i] == sorted(set(found[i])) for i in found)
    weights = np.random.default_rng(1).standard_normal(quality_classifier.DIM + 1)
    scores = {r["i"]: r["s"] for r in df.select("i", quality_classifier.score(F.col("text"), spark, weights).alias("s")).collect()}
    for i, f in found.items():
        dot = sum(weights[k] for k in f) * quality_classifier.SCALE / math.sqrt(max(1, len(f))) + weights[-1]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-12)


def test_averaged_learners_tell_the_classes_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SHARD_ROWS", 20)
    docs = spark.createDataFrame([(i, ("good fine " if i % 2 else "bad ##### ") + prose("abcdef", 20, i)) for i in range(90)], "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, label int")
    got = quality_classifier.train(docs, labels)
    # five learners of 18 rows or so, averaged: the model still tells the classes apart
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality_classifier.score(F.col("text"), spark, got).alias("s")).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_the_classifier_on_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "good words"), (1, "good words"), (2, None), (3, ""), (None, "bad words"), (4, prose("abc", 120_000, 3))], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("label", "order", "y")})
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None)], "doc_id long, label int")
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, 0)], "doc_id long, label int")  # of labels that differ the greater counts
    for labels, low, high in ((none, 0.5, 0.5), (one, 0.99, 1.0), (both, 0.0, 1.0)):
        w = quality_classifier.train(docs.select("doc_id", "text"), labels)
        got = [r["s"] for r in docs.select(quality_classifier.score(F.col("text"), spark, w).alias("s")).collect()]
        assert len(got) == 6 and all(low <= s <= high for s in got)
    assert quality_classifier.train(docs.limit(0).select("doc_id", "text"), both) is not None


def test_token_files_of_awkward_rows(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "c"), (4, "word " * 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("file", "doc_no", "start", "n_tokens")}).repartition(2)
    held = separator_scan.write_tokens(docs, f"file://{tmp_path}/t").collect()
    found = {(r["file"], r["doc_no"]): r["n_tokens"] for r in separator_scan.scan(spark, f"file://{tmp_path}/t", block=1000).collect()}
    counts = sorted((str(r["doc_id"]), found[r["file"], r["doc_no"]]) for r in held)
    assert [c for c in counts if c[0] != "4"] == [("1", 2), ("1", 2), ("2", 0), ("3", 0), ("None", 1)] and len(found) == 6
    assert counts[-2][1] >= 150_000
    separator_scan.write_tokens(docs.limit(0), f"file://{tmp_path}/none").collect()
    assert separator_scan.scan(spark, f"file://{tmp_path}/none").count() == 0


def test_token_counts_as_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=separator_scan.MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in separator_scan.op4_separator_scan(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: len(library.encode(t or "", num_threads=1)) for i, t in texts.items()}
