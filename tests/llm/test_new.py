"""Whitening, word-level BPE and lexical search against plain numpy, the public library and plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical_search as search
from tidemark.llm import whitening, word_pairs

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")


def plain(rows):
    """Integer vectors of the rows that stay, mean, eigenvalues and eigenvectors of the distinct ones."""
    x = np.floor(256 * np.array(rows, dtype=np.float32).astype(float))
    u = np.unique(x, axis=0)
    centred = u - u.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(u))
    return x, u, value[::-1], vector[:, ::-1]


def check_whitening(got, rows, k):
    x, u, value, vector = plain(rows)
    n, total = len(u), u.sum(axis=0)
    want = (x - u.mean(axis=0)) @ vector[:, :k] / np.sqrt(value[:k])
    got = sorted(((r["vec_id"], r["component"]), r) for r in got)
    white = np.array([r["whitened"] for _, r in got]).reshape(len(rows), k)
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9
    assert [r["deviation"] for (_, c), r in got if c == 1] == [int(d) for d in ((n * x - total) ** 2).sum(axis=1)]
    assert {r["n"] for _, r in got} == {n}
    assert np.allclose([r["explained"] for _, r in got[:k]], value[:k] / value.sum(), rtol=1e-9)
    assert all(r["identity_error"] < 1e-10 for _, r in got)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id")
    rows = [r["embedding"] for r in df.collect()]
    check_whitening(whitening.components_of(df.select("vec_id", "embedding")).collect(), rows, 4)


def test_whitening_restarts_beyond_the_basis(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 60)) * np.linspace(3, 1, 60)
    rows = np.round(x, 3).tolist()
    w = whitening.fit(vectors(spark, rows), k=3, block=4, basis=12)
    _, _, value, vector = plain(rows)
    assert w.passes > 4 and np.allclose(w.values, value[:3], rtol=1e-10)
    assert np.abs(np.abs((w.basis * vector[:, :3]).sum(axis=0)) - 1).max() < 1e-10
    assert (w.residuals <= whitening.TOLERANCE * value[0]).all()


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    good = np.round(rng.standard_normal((40, 6)), 2)
    good[:, 5] = 0.5  # a direction without spread
    rows = [*good.tolist(), *good[:7].tolist(), *good[:1].tolist() * 50]
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [float("-inf")] * 6]
    df = spark.createDataFrame([*((i, v, "x") for i, v in enumerate(rows)), *((900 + i, v, "x") for i, v in enumerate(bad))], "vec_id long, embedding array<float>, w string")
    check_whitening(whitening.components_of(df).collect(), rows, 4)
    held = whitening.whiten(df, "embedding", whitening.fit(df, k=9), out="white")  # five directions have spread
    assert held.columns == ["vec_id", "embedding", "w", "white"] and {len(r["white"]["white"]) for r in held.collect()} == {5}


def test_whitening_of_few_rows_and_short_vectors(spark):
    assert whitening.components_of(vectors(spark, [])).count() == 0
    assert whitening.components_of(vectors(spark, [[1.0, 2.0], [1.0, 2.0], None])).count() == 0
    check_whitening(whitening.components_of(vectors(spark, [[1.0, 2.0], [3.0], [0.5, -1.0], [0.5, -1.0, 0.0]])).collect(), [[1, 2, 0], [3, 0, 0], [0.5, -1, 0], [0.5, -1, 0]], 2)
    null_id = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 5.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"] for r in whitening.components_of(null_id).collect()} == {None, 1}


def test_whitening_beyond_64_bits(spark):
    got = whitening.components_of(spark.createDataFrame([(0, [1e12, 0.0]), (1, [-1e12, 3.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")).where("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] is None for r in got} == {0: True, 1: True, 2: False}
    assert next(r["deviation"] for r in got if r["vec_id"] == 2) == 768**2


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_pairs.MODEL)


@pytest.fixture(scope="module")
def model():
    with open(word_pairs.MODEL, "rb") as f:
        return word_pairs.load(f.read())


def same_ids(model, public, texts):
    ids, counts = word_pairs.encode_texts(model, texts)
    ends = np.cumsum(counts)
    for text, end, n, want in zip(texts, ends, counts, public.encode_batch(texts, add_special_tokens=False), strict=True):
        got = ids[end - n : end]
        assert got.tolist() == want.ids, text[:80]
        assert model.decode(got.astype(np.int64)).decode() == public.decode(want.ids, skip_special_tokens=False)


def test_every_character_as_the_library(model, public):
    same_ids(model, public, [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000])


def test_random_texts_as_the_library(model, public):
    r = random.Random(1)
    letters = [*"abcdefghijklmnopqrstuvwxyzAB'''' \n\t.,!?-<|>0123456789éİßΣσ中文̈́", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'re", "\xa0", "the", "ing", "aaaa", "!!!!"]
    same_ids(model, public, ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(20_000)])


def test_long_words_and_apostrophes_as_the_library(model, public):
    same_ids(model, public, ["a" * 5000, "!" * 3000, "ab" * 3000, "xyz" * 999 + " " + "'" * 50, "'s", "'", "'l", "l'l", "it'", "'<|endoftext|>s", "'S'Ll'D", "", " ", "<|endoftext|>", "<|EndOfText|>", "'ſ"])


def test_merges_that_may_not_run_at_once(model, monkeypatch):
    # with the leftmost alone each time the result is the same, as joint symbols never rank lower
    texts = ["banana " * 30, "aaaaaaa!!!!!!", "mississippi"]
    want = word_pairs.encode_texts(model, texts)[0].tolist()
    monkeypatch.setattr(model, "at_once", np.zeros_like(model.at_once))
    assert word_pairs.encode_texts(model, texts)[0].tolist() == want


def test_words_of_one_hash(model, monkeypatch):
    texts = ["one two three two one", "two"]
    want = word_pairs.encode_texts(model, texts)[0].tolist()
    monkeypatch.setattr(word_pairs.Words, "hash_spans", lambda self, start, end: np.zeros(len(start), np.uint64))
    assert word_pairs.encode_texts(model, texts)[0].tolist() == want


def test_encoding_of_rows(spark, public):
    rows = [(1, "Hello World's"), (1, "Hello World's"), (2, None), (3, ""), (None, " \n "), (4, "long text é <|endoftext|> " * 40_000), (5, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("x", F.lit(2))
    got = word_pairs.encoded(docs).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = public.encode(text or "", add_special_tokens=False).ids
        mine = [r for r in got if r["doc_id"] == doc_id]
        assert mine and all(np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == public.decode(want, skip_special_tokens=False) for r in mine)
    assert word_pairs.encoded(docs.limit(0)).count() == 0


def test_query_as_the_library(spark, public):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in word_pairs.op12_word_pairs(spark, SF).collect():
        ids = public.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def ranked(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) by plain Python."""
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for d, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("q", "score", "rank", "item_id")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("q", "doc_id")})
    index = search.build_index(d.repartition(3))
    return sorted((tuple(r) for r in search.search(index, i, **more).collect()), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé中Z09") for _ in range(r.randint(1, 12))) for _ in range(300)]
    return [(i, r.choice([" ", "\n", "-", "_"]).join(r.choice(vocabulary[: r.randint(2, 300)]) for _ in range(r.randint(0, 60)))) for i in range(n)], vocabulary


def test_search_by_brute_force(spark, monkeypatch):
    docs, vocabulary = corpus(400, 11)
    docs += [(1000 - i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (None, None), (5000, None), (5001, ""), (5002, "--- !!"), (5003, " ".join(vocabulary) * 200)]
    r = random.Random(2)
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(40)]
    items += [(3, items[3][1]), (90, docs[7][1]), (91, None), (92, ""), (93, "?!"), (94, "nowhere-to-be-found"), (None, vocabulary[0])]
    want = ranked(docs, items)
    assert searched(spark, docs, items) == want
    monkeypatch.setattr(search, "SHARD_BYTES", 3000)  # many shards
    monkeypatch.setattr(search, "BLOCK_CHARS", 500)  # many blocks
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, k=3) == ranked(docs, items, 3)


def test_search_when_hashes_are_equal(spark):
    docs, vocabulary = corpus(60, 13)
    short = [v for v in vocabulary if len(v.encode()) <= 8]  # told apart by their first eight bytes
    chunk = next(w for _, _, w in search.text_chunks(pa.array([" ".join(short)]), outside=search.OUTSIDE))
    key, head = search._identity(chunk)
    keys, heads, number = search._numbered(key & 3, head)
    assert len(keys) == len(set(short)) and ((keys[number] == key & 3) & (heads[number] == head)).all()
    sought, where = search._found(keys, heads, key & 3, head)
    assert sorted(sought) == list(range(len(key))) and (heads[where] == head[sought]).all()


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []


def test_ties_go_to_the_least_ids():
    score, ids = np.array([5, 5, 5, 9, 0, 5]), np.array([7, 3, 9, 8, 1, 0])
    best = search.best_places(score, ids, np.array([True, True, True, True, True, False]), 3)
    assert sorted(best.tolist()) == [1, 3, 5]


def test_a_large_row_of_the_index_is_read_alone(spark, monkeypatch):
    import pyarrow.parquet as pq

    from tidemark.llm import _common

    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    docs, vocabulary = corpus(400, 5)
    try:
        monkeypatch.setattr(search, "SHARD_BYTES", 3000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        monkeypatch.setattr(_common, "BATCH_BYTES", 2000, raising=False)  # of a shard's 8 bytes a key and more
        index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
        files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in index.shards.inputFiles()]
        groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
        assert len(groups) > 8 and set(groups) == {1}

        def rows(batches):
            yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

        assert {r["n"] for r in index.shards.mapInArrow(rows, "n long").collect()} == {1}
        assert sorted((tuple(r) for r in search.search(index, spark.createDataFrame([(1, vocabulary[0])], "item_id long, text string")).collect()), key=str) == ranked(docs, [(1, vocabulary[0])])
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
