"""Operator 13: ranked lexical search over document-sharded postings.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII,
A-Z lower-cased.  One pass counts documents and terms (N and L); a second cuts the
documents into shards of about SHARD_BYTES of text, wherever they lie, and writes each
as one row of compressed sparse rows: sorted term keys, offsets, and for each posting
the document's place in the shard and its impact, an integer that needs only N, L, the
document's length and the term's occurrences.  The index holds all terms of all
documents and serves any number of searches.

A search takes its items in blocks of bounded text.  A first pass over the keys alone
sums document frequencies of the block's terms; a second scores: for each item, term
after term, weight times impact is added to a dense accumulator over the shard, and the
k best are taken by a partition, those that tie with the last by ascending doc_id, so a
shard's choice is right whatever the others hold.  The shards' choices are merged by rank.

A term is known by a 64-bit hash of its bytes and its first eight bytes.

Edge cases: null and empty texts, and texts of separators alone, are in no shard and
count neither in N nor anywhere; an item without terms, or with no document above 0, has
no rows; null doc_ids rank first among equal scores; repeated documents are documents
each, repeated items are ranked each; texts of any length are taken whole; other columns
stay out; no documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Words, batch_bytes, batch_rows, cut, drop_cut, list_array, table, text_chunks

#: Bytes of text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 6_000_000
#: Characters of items that are searched at once.
BLOCK_CHARS = 4_000_000
K = 10
#: Fixed values of the score.
SATURATION, SLOPE, UNIT = 8, 75, 1_000_000_000

OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SHARD = "docs array<bigint>, keys array<bigint>, heads array<bigint>, first array<int>, place array<int>, impact array<int>"


@dataclass
class Index:
    """shards: a row each; documents and terms: N and L, of documents that have a term."""

    shards: DataFrame
    documents: int
    terms: int


def _identity(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first eight bytes of each word."""
    padded = np.concatenate([w.raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(w.raw) + 1,), "<u8", padded, strides=(1,))[w.start]
    spare = np.uint64(8) * (np.uint64(8) - np.minimum(w.end - w.start, 8).astype(np.uint64))
    return w.hashes().view(np.int64), ((eight << spare) >> spare).view(np.int64)


def _numbered(key: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, head) in order, and the number of each element's."""
    keys, one, number = np.unique(key, return_index=True, return_inverse=True)
    heads = head[one]
    if (heads[number] == head).all():
        return keys, heads, number
    order = np.lexsort((head, key))  # different terms of one hash
    fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (head[order][1:] != head[order][:-1]))
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    one = order[fresh]
    return key[one], head[one], number


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term's occurrences in a document of so many terms are worth, in parts of UNIT / 1000."""
    norm = (100 - SLOPE) + SLOPE * length * documents // terms
    return UNIT * tf // (1000 * tf + SATURATION * norm)


def _shard(parts: list[tuple], documents: int, terms: int) -> pa.RecordBatch:
    """One row from (ids, term counts, keys, heads) of runs of documents."""
    ids = pa.concat_arrays([p[0] for p in parts])
    length, key, head = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    keys, heads, number = _numbered(key, head)
    pair = np.sort(number * len(ids) + np.repeat(np.arange(len(ids)), length))
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    tf = np.diff(np.append(at, len(pair)))
    term, place = np.divmod(pair[at], len(ids))
    first = np.searchsorted(term, np.arange(len(keys) + 1))
    worth = impacts(tf, length[place], documents, terms)
    whole = lambda a, kind: list_array(a.astype(kind), np.array([len(a)]))
    docs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([docs, whole(keys, np.int64), whole(heads, np.int64), whole(first, np.int32), whole(place, np.int32), whole(worth, np.int32)], names=["docs", "keys", "heads", "first", "place", "impact"])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, in the shared folder."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    batch_rows(rows.sparkSession)
    batch_bytes(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for _, _, w in text_chunks(b.column(0), outside=OUTSIDE):
                n, total = n + int((w.counts() > 0).sum()), total + len(w.start)
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    held = rows.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    documents, terms = held[0] or 0, held[1] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            ids = b.column(0)
            for i, j, w in text_chunks(b.column(1), lower=True, outside=OUTSIDE):
                if size and size + len(w.raw) > SHARD_BYTES:
                    yield _shard(parts, documents, terms)
                    parts, size = [], 0
                counts = w.counts()
                if len(w.start):
                    has = np.flatnonzero(counts)
                    parts.append((ids.slice(i, j - i).take(pa.array(has)), counts[has], *_identity(w)))
                    size += len(w.raw)
        if parts:
            yield _shard(parts, documents, terms)

    return Index(cut(rows.mapInArrow(build, SHARD), "postings", alone=True), documents, terms)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def _found(keys: np.ndarray, heads: np.ndarray, key: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms sought a shard has, and where."""
    sought, where = [], []
    at, after = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
    left = np.flatnonzero(at < after)
    while len(left):
        same = heads[at[left]] == head[left]
        sought.append(left[same])
        where.append(at[left[same]])
        left = left[~same]
        at[left] += 1
        left = left[at[left] < after[left]]
    return (np.concatenate(sought), np.concatenate(where)) if sought else (np.zeros(0, np.int64),) * 2


def _flat(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _frequencies(index: Index, key: np.ndarray, head: np.ndarray) -> np.ndarray:
    """How many documents hold each term sought."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(key), dtype=np.int64)
        for b in batches:
            for r in range(b.num_rows):
                sought, where = _found(_flat(b.column(0), r), _flat(b.column(1), r), key, head)
                first = _flat(b.column(2), r)
                total[sought] += first[where + 1] - first[where]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["t", "n"])

    out = np.zeros(len(key), dtype=np.int64)
    for r in index.shards.select("keys", "heads", "first").mapInArrow(of, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # the block's terms at most
        out[r["t"]] = r["n"]
    return out


def best_places(score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of those that tie with the last, the least ids, unknown ones first."""
    some = np.flatnonzero(score > 0)
    if len(some) <= k:
        return some
    value = score[some]
    last = value[np.argpartition(value, len(value) - k)[len(value) - k]]
    above, tied = some[value > last], some[value == last]
    tied = tied[np.lexsort((ids[tied], known[tied]))][: k - len(above)]
    return np.concatenate([above, tied])


def _block(index: Index, items: list, k: int) -> DataFrame:
    """(q, doc_id, score): at least the k best documents of each item (q, text), some more from other shards."""
    chunks = [(i, w) for i, _, w in text_chunks(pa.array([r["text"] for r in items], pa.string()), lower=True, outside=OUTSIDE)]
    owner = np.concatenate([i + w.owner() for i, w in chunks])
    key, head = (np.concatenate(x) for x in zip(*[_identity(w) for _, w in chunks], strict=True))
    key, head, number = _numbered(key, head)
    weights = np.array([weight(index.documents, int(n)) if n else 0 for n in _frequencies(index, key, head)], dtype=np.int64)
    pair, often = np.unique(owner * max(1, len(key)) + number, return_counts=True)
    who, term = np.divmod(pair, max(1, len(key)))
    bounds = np.searchsorted(who, np.arange(len(items) + 1))
    gain = weights[term] * often
    q = np.array([r["q"] for r in items], dtype=np.int64)
    spark = index.shards.sparkSession
    sent = spark.sparkContext.broadcast((key, head, bounds, term, gain, q))  # at most BLOCK_CHARS of items

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, bounds, term, gain, q = sent.value
        for b in batches:
            for r in range(b.num_rows):
                docs, keys, heads, first, place, impact = (b.column(c) for c in range(6))
                ids, first, place, impact = docs[r].values, _flat(first, r), _flat(place, r), _flat(impact, r).astype(np.int64)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                begin = end = np.zeros(len(key), dtype=np.int64)
                sought, where = _found(_flat(keys, r), _flat(heads, r), key, head)
                begin, end = begin.copy(), end.copy()
                begin[sought], end[sought] = first[where], first[where + 1]
                here = np.zeros(len(key), dtype=bool)
                here[sought] = True
                total = np.zeros(len(number), dtype=np.int64)
                got_q, got_d, got_s = [], [], []
                for i in range(len(q)):
                    mine = slice(bounds[i], bounds[i + 1])
                    t, g = term[mine], gain[mine]
                    go = here[t] & (g > 0)
                    if not go.any():
                        continue
                    total[:] = 0
                    for x, v in zip(t[go], g[go], strict=True):
                        total[place[begin[x] : end[x]]] += v * impact[begin[x] : end[x]]
                    best = best_places(total, number, known, k)
                    got_q.append(np.full(len(best), q[i]))
                    got_d.append(best)
                    got_s.append(total[best])
                if got_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got_q)), ids.take(pa.array(np.concatenate(got_d))), pa.array(np.concatenate(got_s))], names=["q", "doc_id", "score"])

    return index.shards.mapInArrow(of, "q long, doc_id long, score long")


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = items.sparkSession
    kind = dict(items.dtypes)[item_id]
    asked = cut(items.select(F.monotonically_increasing_id().alias("q"), items[item_id].alias("item_id"), items[text].alias("text")).where(F.length("text") > 0), "items")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    if not index.terms or not blocks:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = [_block(index, part, k) for n in range(blocks) if (part := asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n).select("q", "text").collect())]  # a block of items
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def drop_index(index: Index) -> None:
    drop_cut(index.shards)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
