"""Operator 12: BPE encoding with word ends, and decoding, in batched merge rounds.

A text is cut at the special tokens' strings, composed (NFC), lower-cased and cut into
words by classes of characters, all texts of a batch at once on one flat array of code
points.  The bytes of the distinct words of a batch are symbols in one flat array.  A
merge round finds the rank of every neighbouring pair that is new by binary search over
the sorted pair keys, takes each word's lowest rank, and merges it in all words at a
time; words with no pair left go out of the array.  A round merges every occurrence of
the lowest rank in a word where no pair with the joint symbol has a lower rank, else the
leftmost alone: that is what merging one by one, lowest rank and leftmost first, does.

Ids are packed as little-endian unsigned 32-bit integers, as token files hold them.
Decoding joins the tokens' strings, word ends and all, with one space.

Edge cases: null and empty texts, and texts of white space alone, have no ids and decode
to an empty text; texts and words of any length are encoded whole; equal texts are
encoded alike; repeated rows give repeated rows, null doc_ids stay; other columns stay
out; no rows give no rows.  Classes and small forms of characters are
read from the tokenizers library's own tables; composition (NFC) knows Unicode 15.1.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Words, batch_udf, table
from .pieces import _groups, _model, _ranges

MODEL = "/opt/tokenizers/word_bpe_49k.json"
WORD_END = "</w>"
RESULT = "struct<ids:binary,n_tokens:bigint>"
_NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The steps that a model file has to name, and what an apostrophe at the start of a run takes with it.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, by the tables of the tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            for part in re.findall("[\0-\ud7ff]+|[\ue000-\U0010ffff]+", found):
                out[ord(part[0]) : ord(part[-1]) + 1] = kind
    return out


@lru_cache(maxsize=1)
def _odd_lower() -> tuple[re.Pattern, dict[int, str]]:
    """Characters whose small form in that library isn't what str.lower makes of them within a text: sigma, which has one small form there, and newer ones."""
    from tokenizers import normalizers

    every = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x110000))]
    small = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    odd = {ord(c): s for c, s in zip(every, small, strict=True) if c.lower() != s or c == "Σ"}
    return re.compile("[" + re.escape("".join(map(chr, odd))) + "]"), odd


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class WordPairs:
    """A model file as arrays: byte -> symbol (inside and at the end of a word), sorted pair keys -> rank, rank -> joint symbol, symbol -> string."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        m, added = spec["model"], spec["added_tokens"]
        steps = tuple([s["type"] for s in spec[k][v]] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if m["type"] != "BPE" or m["end_of_word_suffix"] != WORD_END or any(m[k] for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or steps != STEPS or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": PATTERN}:
            raise ValueError("a word-level BPE model with NFC, lower case, the known pattern and word ends is needed")
        if spec["decoder"] or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("a decoder, or added tokens that take in their surroundings, are not supported")
        vocab = m["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(longest) + ")") if longest else None
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + WORD_END] for c in letters], dtype=np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in m["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.joint = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        least = np.full(max(vocab.values()) + 1, _NONE, dtype=np.int32)
        for side in (left, right):
            np.minimum.at(least, side, np.arange(len(pairs), dtype=np.int32))
        self.at_once = least[self.joint] > np.arange(len(pairs))
        names = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), b"")
        names |= {i: t.encode() for t, i in (vocab | self.special).items()}
        self.size = np.array([len(names[i]) + 1 for i in range(len(names))], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(names[i] + b" " for i in range(len(names))), dtype=np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs (a, b), or _NONE, by binary search."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of many words, one after another, after all merges, and how many each word has."""
        word, out, owner = np.repeat(np.arange(len(length)), length), [], []
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            many = np.diff(np.append(first, len(sym)))
            going = np.repeat(best < _NONE, many)
            if not going.all():
                out.append(sym[~going])
                owner.append(word[~going])
                sym, word, rank, many, best = sym[going], word[going], rank[going], many[best < _NONE], best[best < _NONE]
                if not len(sym):
                    break
            mine = np.repeat(best, many)
            hit = np.flatnonzero(rank == mine)
            # of hits that overlap every second one merges; where not all may merge at once, the leftmost
            fresh = np.append(True, np.diff(hit) != 1)
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            take = (np.arange(len(hit)) - run) % 2 == 0
            take &= self.at_once[mine[hit]] | np.append(True, word[hit[1:]] != word[hit[:-1]])
            hit = hit[take]
            sym[hit] = self.joint[mine[hit]]
            left = np.ones(len(sym), dtype=bool)
            left[hit + 1] = False
            sym, word, rank = sym[left], word[left], rank[left]
            at = hit - np.arange(len(hit))
            changed = np.concatenate([at, at[at > 0] - 1])
            more = changed < len(sym) - 1
            rank[changed] = _NONE
            changed = changed[more]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.ranks(sym[changed], sym[changed + 1])
        if not out:
            return np.zeros(0, np.int64), np.zeros(len(length), np.int64)
        flat, owner = np.concatenate(out), np.concatenate(owner)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(length))

    def segments(self, text: str) -> list[tuple[str, int]]:
        """(normalised text, -1) and (string, id) of special tokens, in order."""
        parts = self.cut.split(text) if self.cut and "<" in text else [text]
        return [(p, self.special[p]) if k % 2 else (_normal(p), -1) for k, p in enumerate(parts) if p]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, joined by one space."""
        return self.bytes[_ranges(self.at[ids], self.size[ids])].tobytes()[:-1]


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    pattern, odd = _odd_lower()
    return (text.translate(odd) if pattern.search(text) else text).lower()


@lru_cache(maxsize=2)
def load(data: bytes) -> WordPairs:
    return WordPairs(data)


def _words(code: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of each word; edge: where texts or segments begin, with the end."""
    n, kind = len(code), _classes()[code]
    start = np.ones(n, dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start[edge[edge < n]] = True
    # an apostrophe alone before a letter run that begins with a suffix takes the suffix with it
    begins = np.append(start, True)
    end = np.full(n + 1, False)
    end[edge] = True
    mark = np.flatnonzero(begins[:-1] & begins[1:] & (code == 0x27))
    mark = mark[~end[mark + 1]]
    held = np.concatenate([code, np.zeros(3, dtype=code.dtype)])
    for suffix in SUFFIXES:
        size = len(suffix)
        same = mark[mark + size < n]
        for k, c in enumerate(suffix):
            same = same[held[same + 1 + k] == ord(c)]
        for k in range(1, size):
            same = same[~start[same + 1 + k]]
        start[same + 1] = False
        after = same + 1 + size
        start[after[after < n]] = True
        mark = np.setdiff1d(mark, same, assume_unique=True)
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    real = kind[first] != SPACE
    return first[real], last[real]


def _same_words(raw: np.ndarray, at: np.ndarray, size: np.ndarray, one: np.ndarray, which: np.ndarray) -> bool:
    """Whether each word has the bytes of the one that stands for it."""
    to = one[which]
    return bool((size == size[to]).all() and (raw[_ranges(at, size)] == raw[_ranges(at[to], size)]).all())


def encode_texts(p: WordPairs, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each has."""
    parts = [(s, i, k) for k, t in enumerate(texts) if t for s, i in p.segments(t)]
    joined = "".join(s for s, _, _ in parts)
    if not joined:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    edge = np.cumsum([0, *(len(s) for s, _, _ in parts)])
    special, owner = np.array([i for _, i, _ in parts]), np.array([k for _, _, k in parts])
    first, last = _words(code, edge)
    part = np.searchsorted(edge, first, "right") - 1
    keep = (special[part] < 0) | (first == edge[part])  # a special token is one word
    first, last, part = first[keep], last[keep], part[keep]
    named = special[part] >= 0
    last = np.where(named, edge[part + 1], last)
    where = np.zeros(len(code) + 1, dtype=np.int64)
    np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=where[1:])
    raw = np.frombuffer(joined.encode(), dtype=np.uint8)
    at, size = where[first], where[last] - where[first]
    _, one, which = np.unique(Words(raw, np.array([0, len(raw)])).hash_spans(at, at + size), return_index=True, return_inverse=True)
    if not _same_words(raw, at, size, one, which):
        one = which = np.arange(len(at))
    of = raw[_ranges(at[one], size[one])]
    ends = np.cumsum(size[one])
    sym = p.inner[of]
    sym[ends - 1] = p.last[of[ends - 1]]
    flat, count = p.merge(sym, size[one])
    begin = np.cumsum(count) - count
    # special tokens stand behind the words' symbols
    begin, count = np.where(named, len(flat) + np.cumsum(named) - 1, begin[which]), np.where(named, 1, count[which])
    flat = np.concatenate([flat, special[part[named]]])
    return flat[_ranges(begin, count)].astype("<u4"), np.bincount(owner[part], weights=count, minlength=len(texts)).astype(np.int64)


def encode(text: Column, spark: SparkSession, model: str = MODEL) -> Column:
    """struct(ids, n_tokens) of a text; ids packed as little-endian unsigned 32-bit integers."""
    held = spark.sparkContext.broadcast(_model(spark, model))  # one model file

    def of(column: pa.Array) -> pa.Array:
        p, texts, ids, counts = load(held.value), pc.fill_null(column, "").to_pylist(), [], [np.zeros(0, np.int64)]
        for i, j in _groups(texts):
            got, n = encode_texts(p, texts[i:j])
            ids.append(got.tobytes())
            counts.append(n)
        n = np.concatenate(counts)
        offsets = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(ids))])
        return pa.StructArray.from_arrays([packed, pa.array(n)], names=["ids", "n_tokens"])

    return batch_udf(of, RESULT)(text)


def decode(ids: Column, spark: SparkSession, model: str = MODEL) -> Column:
    """The text of packed ids; null and no ids give an empty text."""
    held = spark.sparkContext.broadcast(_model(spark, model))

    def of(column: pa.Array) -> pa.Array:
        p = load(held.value)
        return pa.array([p.decode(np.frombuffer(x or b"", dtype="<u4")).decode() for x in column.to_pylist()], pa.string())

    return batch_udf(of, "string")(ids)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of documents."""
    spark = docs.sparkSession
    x = docs.select("doc_id", encode(docs["text"], spark, model).alias("x")).select("doc_id", "x.n_tokens", "x.ids")
    return x.withColumn("decoded", decode(F.col("ids"), spark, model))


def op12_word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
