"""Operator 3: SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type (BPE) model merges, again and again, the adjacent pair whose joint
piece has the best score, leftmost first.  Under merge-dropout each candidate that
enters this agenda is skipped with probability ``dropout``.  Here a keyed hash of
(seed, document, ordinal of the chunk, where the pair lies) makes that decision, so
it is a pure function: the same whenever it is asked, on any executor and in any
retry.  The document's key is a hash of its text, so each occurrence of a word, in
one document or in many, has draws of its own.

No piece crosses from a non-space to a space, or holds a line break beside another
character, so texts are cut there first; chunks are merged in numpy, one merge step
for all rows at a time, at dropout 0 only the distinct ones of a batch.  Chunks of
more than LONG characters take a heap agenda with the same decisions.

Decoding joins the pieces' bytes and is exact: a literal U+2581 and characters
outside the vocabulary are spelt as byte pieces, and the added first space goes.

Edge cases: null and empty texts have no pieces (null decodes to empty); texts of
any length are encoded whole; equal texts are encoded alike; repeated rows give
repeated rows; other columns stay out; no rows give no rows.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import GOLDEN, batch_udf, mix64, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
#: None: each occurrence of a chunk has its own draws.  A number: that many at most for equal chunks.
STREAMS = None
SEED = 20_240_607
LONG = 96
#: Characters of text handled at once; a longer text is handled alone.
CHUNK_CHARS = 500_000
_NONE = np.int32(2**31 - 1)
_MASK = (1 << 64) - 1
RESULT = "struct<ids:array<int>,lossless:boolean>"


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class Pieces:
    """A merge-type model as arrays: code point -> symbol, pair of symbols -> merged symbol and rank, symbol -> bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and m.trainer_spec.byte_fallback):
            raise ValueError("a merge-type model with identity normalisation, dummy prefix and byte pieces is needed")
        pieces = [p.piece for p in m.pieces]
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in normal):
            raise ValueError("a piece crosses a chunk border")
        self.n = len(pieces)
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.data = [b""] * self.n
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.data[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == 1:
                self.data[i] = p.piece.replace("▁", " ").encode()
        # a symbol is a piece, or n + code point for a character that is none
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.n
        for p, i in normal.items():
            if len(p) == 1 and p != "▁":
                self.symbol[ord(p)] = i
        self.symbol[0x20] = normal["▁"]
        of = lambda s: normal.get(s, None if len(s) > 1 else int(self.symbol[ord(s)]))
        order = sorted(normal.values(), key=lambda i: (-m.pieces[i].score, i))
        rank = {i: r for r, i in enumerate(order)}
        self.by_rank = np.array(order, dtype=np.int32)
        pairs: dict[int, int] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = of(p[:k]), of(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank[i]
        self.pairs = pairs
        self._bits = max(10, (4 * len(pairs)).bit_length())
        size = 1 << self._bits
        self._keys, self._ranks = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        self._probes = 0
        keys, ranks = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # linear probing, all keys a step at a time
            free = self._keys[slot[left]] == -1
            self._keys[slot[left[free]]] = keys[left[free]]
            placed = self._keys[slot[left]] == keys[left]
            self._ranks[slot[left[placed]]] = ranks[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & (size - 1)
            self._probes += 1
        lengths = np.array([len(d) for d in self.data], dtype=np.int64)
        self.size, self.at = lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.data), dtype=np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b make, or _NONE."""
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE, dtype=np.int32)
        left = np.arange(len(keys))
        for _ in range(self._probes):
            held = self._keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = self._ranks[slot[left[same]]]
            left = left[~same & (held != -1)]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self._bits) - 1)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes, without the first space."""
        size = self.size[ids]
        total = int(size.sum())
        ends = np.cumsum(size)
        where = np.arange(total) + np.repeat(self.at[ids] - (ends - size), size)
        raw = self.bytes[where].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


@lru_cache(maxsize=4)
def load(model: bytes) -> Pieces:
    return Pieces(model)


def _dropped(key: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, limit: int) -> np.ndarray:
    place = (low.astype(np.uint64) << np.uint64(42)) ^ (mid.astype(np.uint64) << np.uint64(21)) ^ high.astype(np.uint64)
    return mix64(key ^ (place * GOLDEN)) < np.uint64(limit)


def merge_heap(p: Pieces, symbols: list[int], key: int, limit: int) -> list[int]:
    """One chunk by a heap agenda."""
    n = len(symbols)
    sym, prev, nxt = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    end = list(range(1, n + 1))
    alive, agenda = [True] * n, []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (r := p.pairs.get((sym[i] << 32) | sym[j])) is not None:
            place = ((i << 42) ^ (j << 21) ^ end[j]) & _MASK
            if not limit or _mix(key ^ ((place * int(GOLDEN)) & _MASK)) >= limit:
                heapq.heappush(agenda, (r, i, sym[i], sym[j], j))

    for i in range(n - 1):
        offer(i)
    while agenda:
        r, i, a, b, j = heapq.heappop(agenda)
        if not (alive[i] and nxt[i] == j and alive[j] and sym[i] == a and sym[j] == b):
            continue
        sym[i], end[i], nxt[i], alive[j] = int(p.by_rank[r]), end[j], nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
            offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [sym[i] for i in range(n) if alive[i]]


def merge_rows(p: Pieces, sym: np.ndarray, length: np.ndarray, key: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Many chunks at once: columns of symbols, padded with -1.  Returns the columns after all merges and their lengths."""
    width, rows = sym.shape
    out, out_length = np.full((width, rows), -1, dtype=np.int32), np.array(length)
    here = np.arange(rows)
    start = np.minimum(np.arange(width + 1, dtype=np.int32)[:, None], length[None, :].astype(np.int32))

    def rank_at(c: np.ndarray, r: np.ndarray) -> np.ndarray:
        got = p.ranks(sym[c, r], sym[c + 1, r])
        if limit:
            held = np.flatnonzero(got < _NONE)
            ch, rh = c[held], r[held]
            got[held[_dropped(key[rh], start[ch, rh], start[ch + 1, rh], start[ch + 2, rh], limit)]] = _NONE
        return got

    rank = np.full((width, rows), _NONE, dtype=np.int32)
    c, r = np.nonzero(np.arange(width)[:, None] < length[None, :] - 1)
    rank[c, r] = rank_at(c, r)
    while True:
        top = rank.min(axis=0)
        going = top < _NONE
        if not going.all():
            done = ~going
            out[: len(sym), here[done]], out_length[here[done]] = sym[:, done], length[done]
            here, length, key, top = here[going], length[going], key[going], top[going]
            if not len(here):
                return out, out_length
            wide = int(length.max())
            sym, rank, start = sym[:wide, going], rank[:wide, going], start[: wide + 1, going]
        best = np.zeros(len(here), dtype=np.int64)
        for j in range(len(rank) - 1, -1, -1):
            best[rank[j] == top] = j
        line = np.arange(len(here))
        sym[best, line] = p.by_rank[top]
        for j in range(1, len(sym)):
            moved = best < j
            if j + 1 < len(sym):
                np.copyto(sym[j], sym[j + 1], where=moved)
                np.copyto(rank[j], rank[j + 1], where=moved)
            np.copyto(start[j], start[j + 1], where=moved)
        length = length - 1
        sym[length, line], rank[length, line] = -1, _NONE
        rank[np.maximum(length - 1, 0), line] = _NONE
        rank[best, line] = _NONE
        for at in (best, best - 1):
            ok = np.flatnonzero((at >= 0) & (at < length - 1))
            rank[at[ok], ok] = rank_at(at[ok], ok)


def _spell(p: Pieces, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are no piece, as byte pieces."""
    odd = tokens >= p.n
    if not odd.any():
        return tokens, lengths
    code = np.where(odd, tokens - p.n, 0)
    size = np.where(odd, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.repeat(np.arange(len(tokens)), size)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    n, c = size[at], code[at]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
    byte = np.where(n == 1, c, np.where(nth == 0, lead | (c >> (6 * (n - 1))), 0x80 | ((c >> (6 * (n - 1 - nth))) & 0x3F)))
    return np.where(odd[at], p.byte_id[byte & 0xFF], tokens[at]).astype(np.int32), np.bincount(owner, weights=size, minlength=len(lengths)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes of many ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def encode_texts(p: Pieces, texts: list[str], dropout: float, seed: int, streams: int | None = STREAMS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each has."""
    limit = min(int(dropout * 2.0**64), _MASK) if dropout else 0
    joined = "".join(" " + t for t in texts if t)
    if not joined:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    space, line = code == 0x20, code == 10
    cut = np.zeros(len(code), dtype=bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[at[:-1][sizes > 0]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(code)))
    # hash of each chunk, by position within it
    power = np.full(int(length.max()), 0x5851F42D4C957F2D, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    within = np.arange(len(code)) - np.repeat(start, length)
    chunk = mix64(np.add.reduceat((code + np.uint32(1)) * power[within], start) + length.astype(np.uint64))
    first = np.searchsorted(start, at)
    counts = np.diff(first)
    ordinal = (np.arange(len(chunk)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    if limit and streams != 1:
        full = np.zeros(len(chunk) + 1, dtype=np.uint64)
        np.cumsum(mix64(chunk + ordinal * GOLDEN), out=full[1:])
        document = np.repeat(mix64(full[first[1:]] - full[first[:-1]] + np.uint64(seed)), counts)
    if limit and streams is None:
        key = mix64(document + mix64(ordinal * GOLDEN + np.uint64(seed)))
        one = which = np.arange(len(chunk))
    else:
        stream = ((document >> np.uint64(33)) + ordinal) % np.uint64(streams) if limit and streams != 1 else np.zeros(len(chunk), dtype=np.uint64)
        key = mix64(chunk + mix64(stream * GOLDEN + np.uint64(seed)))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(length[one], kind="stable")
    symbol = p.symbol[code]
    tokens: list[np.ndarray] = []
    sizes_by_rank = np.zeros(len(one), dtype=np.int64)
    i = 0
    while i < len(order):
        width = int(length[one[order[i]]])
        if width > LONG:
            k = one[order[i]]
            got = np.array(merge_heap(p, symbol[start[k] : start[k] + width].tolist(), int(key[k]), limit), dtype=np.int32)
            tokens.append(got)
            sizes_by_rank[i] = len(got)
            i += 1
            continue
        j = min(int(np.searchsorted(length[one[order]], width + width // 8 + 1, "right")), i + 400_000 // (width + 4) + 1, int(np.searchsorted(length[one[order]], LONG, "right")))
        rows = one[order[i:j]]
        wide = int(length[rows].max())
        grid = np.minimum(start[rows][None, :] + np.arange(wide)[:, None], len(code) - 1)
        sym = np.where(np.arange(wide)[:, None] < length[rows][None, :], symbol[grid], np.int32(-1))
        got, size = merge_rows(p, sym, length[rows], key[rows], limit)
        tokens.append(got.T[np.arange(wide)[None, :] < size[:, None]])
        sizes_by_rank[i:j] = size
        i = j
    flat, size = _spell(p, np.concatenate(tokens), sizes_by_rank)
    begin = np.cumsum(size) - size
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    mine = place[which]
    ids = flat[_ranges(begin[mine], size[mine])]
    per_chunk = np.concatenate([[0], np.cumsum(size[mine])])
    return ids, per_chunk[first[1:]] - per_chunk[first[:-1]]


def _groups(texts: list[str]) -> list[tuple[int, int]]:
    out, i, total = [], 0, 0
    for j, t in enumerate(texts):
        if total and total + len(t) > CHUNK_CHARS:
            out.append((i, j))
            i, total = j, 0
        total += len(t)
    return [*out, (i, len(texts))]


def _model(spark: SparkSession, path: str) -> bytes:
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encode(text: Column, spark: SparkSession, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, streams: int | None = STREAMS) -> Column:
    """struct(ids, lossless): pieces of a text, and whether decoding them gives it back."""
    held = spark.sparkContext.broadcast(_model(spark, model))  # one model file

    def of(column: pa.Array) -> pa.Array:
        p = load(held.value)
        texts = pc.fill_null(column, "").to_pylist()
        ids, counts, same = [], [], []
        for i, j in _groups(texts):
            got, n = encode_texts(p, texts[i:j], dropout, seed, streams)
            ends = np.cumsum(n)
            for k, t in enumerate(texts[i:j]):
                same.append(p.decode(got[ends[k] - n[k] : ends[k]]) == t.encode())
            ids.append(got)
            counts.append(n)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())), pa.array(same, pa.bool_())], names=["ids", "lossless"])

    return batch_udf(of, RESULT, lean=True)(text)


def decode(ids: Column, spark: SparkSession, model: str = MODEL) -> Column:
    """The text of a list of piece ids."""
    held = spark.sparkContext.broadcast(_model(spark, model))

    def of(column: pa.Array) -> pa.Array:
        p = load(held.value)
        return pa.array([p.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return batch_udf(of, "string")(ids)


def encoded(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, streams: int | None = STREAMS) -> DataFrame:
    """(doc_id, n_pieces, lossless, ids) of documents."""
    x = docs.select("doc_id", encode(docs["text"], docs.sparkSession, model, dropout, seed, streams).alias("x"))
    return x.select("doc_id", F.size("x.ids").cast("long").alias("n_pieces"), "x.lossless", "x.ids")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
