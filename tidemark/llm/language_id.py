"""Operator 2: language identification by multilingual mixture inference.

Each learned language has a character n-gram model: smoothed relative frequencies
of hashed 1- to 4-grams of a word with its borders.  A word's likelihood under a
language is the geometric mean over the word's n-grams, so that overlapping
n-grams of one word count as one piece of evidence.  A document is a mixture: its
language proportions come from expectation-maximisation over its distinct words,
all documents of a batch at once.  The language set is chosen by penalised
likelihood: while dropping the weakest language costs less than PENALTY * ln(words)
of log-likelihood, it is dropped and the mixture is fitted again.

Counts come from every training row.  A partition sends one row for each language
that it saw, a vector of BUCKETS counts, and vectors are summed element-wise, so
the model's size is languages * BUCKETS whatever the corpus.

Edge cases: null texts and texts without a letter are ``und`` with score 0; with
nothing learned every text is ``und``; null languages teach nothing; equal shares
go to the language first in order; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import GOLDEN, batch_udf, mix64, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Added to each count.
SMOOTH = 0.5
ROUNDS = 12
PENALTY = 1.0
#: Words of a text handled at once; a batch of texts may hold more, a text's words are never dropped.
BATCH_CHARS = 4_000_000
_BORDER = 0x1F


def _words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words of all texts, and (text, word, count) as index arrays with a bound for each text."""
    index: dict[str, int] = {}
    word_ids, counts, bounds = [], [], [0]
    for t in texts:
        own: dict[str, int] = {}
        for w in t.lower().split():
            own[w] = own.get(w, 0) + 1
        for w, n in own.items():
            word_ids.append(index.setdefault(w, len(index)))
            counts.append(n)
        bounds.append(len(word_ids))
    return list(index), np.array([word_ids, counts], dtype=np.int64).reshape(2, -1), np.array(bounds)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word with its borders, one word after another, and their numbers."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "".join(f"\x1f{w}\x1f" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    keys, owners = [], []
    owner = np.repeat(np.arange(len(words)), sizes)
    for k in ORDERS:
        n = len(code) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            h = h * GOLDEN + code[j : j + n]
        whole = left[:n] >= k
        if k == 1:
            whole = whole & (code != _BORDER)
        keys.append((mix64(h[whole]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:n][whole])
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.bincount(owners, minlength=len(words))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    i, total = 0, 0
    for j, t in enumerate(texts):
        if total and total + len(t) > BATCH_CHARS:
            yield i, j
            i, total = j, 0
        total += len(t)
    yield i, len(texts)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in _groups(texts):
            words, (ids, counts), bounds = _words(texts[i:j])
            grams, sizes = _grams(words)
            ends = np.cumsum(sizes)
            lang_of = np.repeat(np.arange(j - i), np.diff(bounds))
            for lang in set(langs[i:j]):
                mine = np.array([x == lang for x in langs[i:j]])[lang_of] if len(lang_of) else np.zeros(0, bool)
                weight = np.bincount(ids[mine], weights=counts[mine], minlength=len(words))
                found = np.bincount(grams, weights=np.repeat(weight, sizes), minlength=BUCKETS) if len(ends) else np.zeros(BUCKETS)
                held[lang] = held.get(lang, 0) + found
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.astype(np.int64).tolist() for v in held.values()], pa.list_(pa.int64()))], names=["lang", "counts"])


def train(rows: DataFrame) -> dict[str, np.ndarray]:
    """Log-probabilities by language from (text, lang) rows, all of which count."""
    parts = rows.select("text", "lang").where("text is not null and lang is not null").mapInArrow(_count_partition, "lang string, counts array<bigint>")
    flat = parts.select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    by_lang = flat.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))  # BUCKETS entries a language
    for r in by_lang.collect():
        counts = np.full(BUCKETS, SMOOTH)
        counts[r["b"]] += r["n"]
        out[r["lang"]] = np.log(counts / counts.sum())
    return out


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total, some = np.zeros((len(bounds) - 1, values.shape[1])), np.diff(bounds) > 0
    if some.any():
        total[some] = np.add.reduceat(values, bounds[:-1][some], axis=0)
    return total


def _fit(like: np.ndarray, counts: np.ndarray, bounds: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text by EM over its open languages."""
    share = open_ / np.maximum(open_.sum(axis=1, keepdims=True), 1)
    total = np.maximum(_sum_by(counts[:, None], bounds), 1e-12)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for _ in range(ROUNDS):
        joint = like * share[owner]
        joint *= (counts / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        share = _sum_by(joint, bounds) / total
    fit = np.log(np.maximum((like * share[owner]).sum(axis=1), 1e-300)) * counts
    return share, _sum_by(fit[:, None], bounds)[:, 0]


def mixtures(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Language proportions of each text; model: log-probabilities, a row for each language."""
    words, (ids, counts), bounds = _words(texts)
    n_langs = len(model)
    if not words:
        return np.zeros((len(texts), n_langs))
    grams, sizes = _grams(words)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    score = np.stack([np.add.reduceat(row[grams], at) for row in model], axis=1) / sizes[:, None]
    score = np.exp(score - score.max(axis=1, keepdims=True))
    like, weight = score[ids], counts.astype(np.float64)
    open_ = np.ones((len(texts), n_langs))
    share, fit = _fit(like, weight, bounds, open_)
    price = PENALTY * np.log(np.maximum(np.diff(np.concatenate([[0], np.cumsum(weight)])[bounds]), 2.0))
    live = np.arange(len(texts))
    while n_langs > 1 and len(live):
        live = live[open_[live].sum(axis=1) > 1]
        if not len(live):
            break
        # the weakest open language of each live text goes, if that costs less than its price
        weakest = np.where(open_[live] > 0, share[live], np.inf).argmin(axis=1)
        tried = open_[live].copy()
        tried[np.arange(len(live)), weakest] = 0
        size = np.diff(bounds)[live]
        ends = np.cumsum(size)
        rows = np.arange(int(ends[-1])) + np.repeat(bounds[:-1][live] - (ends - size), size)
        new_share, new_fit = _fit(like[rows], weight[rows], np.concatenate([[0], ends]), tried)
        better = fit[live] - new_fit < price[live]
        share[live[better]], fit[live[better]], open_[live[better]] = new_share[better], new_fit[better], tried[better]
        live = live[better]
    return share


PREDICTION = "struct<lang:string,score:double,langs:array<string>,shares:array<double>>"


def predict(text: Column, spark: SparkSession, model: dict[str, np.ndarray]) -> Column:
    """struct(lang, score, langs, shares): the main language, its share, and all that the text holds, by share."""
    names = sorted(model)
    held = spark.sparkContext.broadcast((names, np.stack([model[k] for k in names]) if names else np.zeros((0, BUCKETS))))  # languages * BUCKETS numbers

    def of(column: pa.Array) -> pa.Array:
        langs, table_ = held.value
        texts = pc.fill_null(column, "").to_pylist()
        out = []
        for i, j in _groups(texts):
            shares = mixtures(texts[i:j], table_) if langs else None
            for k, t in enumerate(texts[i:j]):
                if shares is None or not any(map(str.isalpha, t)):
                    out.append({"lang": "und", "score": 0.0, "langs": [], "shares": []})
                    continue
                row = shares[k]
                order = sorted(range(len(langs)), key=lambda x: (-row[x], x))
                in_ = [x for x in order if row[x] > 0]
                out.append({"lang": langs[order[0]], "score": float(min(1.0, max(0.0, row[order[0]]))), "langs": [langs[x] for x in in_], "shares": [float(row[x]) for x in in_]})
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
        return pa.array(out, kind)

    return batch_udf(of, PREDICTION)(text)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)
    model = train(docs.where(~F.col("held_out")))
    out = docs.select("doc_id", "held_out", predict(F.col("text"), spark, model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.langs", "p.shares")
