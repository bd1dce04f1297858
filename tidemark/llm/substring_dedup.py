"""Operator 10: repeated substrings by prefix-partitioned suffix trees.

Suffixes are dealt into groups by a prefix, groups of one have no inner node and are
dropped, and every other group grows its subtree.

Prefixes.  Two equal windows of WINDOW words hold equal prefixes of PREFIX words at
the same places, so a window's suffix is dealt by the prefix of least hash among its
own, its anchor (winnowing: equal windows choose equal anchors).  Neighbouring windows
mostly share an anchor and travel as one row, the words from the first window's start
to the last one's end.  A prefix with more than LEAVES rows is lengthened to the whole
window, so no group outgrows LEAVES rows: below a prefix of that length lies one node,
which keeps its first leaf only, merged before and after the shuffle.

Trees.  A task gets its groups one after another, sorted, and holds one batch of whole
groups.  Nodes are found level by level: the words of 2k from a place on are the nodes
of k words there and k words on (prefix doubling), down to WINDOW words.  A node met
twice at that depth is a deep inner node, a repeat; all leaves below it but the first
go.  Words are compared by 64 bits each.  Nothing below that depth changes what is
removed, and neighbouring windows make up the maximal repeats, returned as ``spans``.

Documents of equal word sequences are one document in all this: all but the first
repeat it from start to end.

Edge cases: null and wordless texts keep nothing and lose nothing; texts below
WINDOW words have no window; equal windows are ordered by (doc_id, text hash,
start), a null doc_id last, and only a strictly earlier one counts, so repeated
rows are treated alike and don't remove each other; other columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import GOLDEN, batch_udf, cut, cut_counted, list_array, mix64, table, text_chunks, windows

WINDOW = 20
PREFIX = 8
#: Rows of a group at most; a prefix with more is lengthened.
LEAVES = 20_000
#: Lengthened prefixes broadcast at most (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_LONG = 1_000_000
#: Partitions that share the rows of a lengthened prefix.
SALTS = 64
_LAST_ID = (1 << 63) - 1


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the hash of each one's anchor prefix, and where that stands."""
    n = len(hashes)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    start = np.flatnonzero(left >= window)
    if not len(start):
        return start, np.zeros(0, np.uint64), start
    grams, _ = windows(hashes, first, prefix)
    span = window - prefix + 1
    least, width = grams, 1
    while width * 2 <= span:
        least = np.minimum(least[: n - width], least[width:]) if len(least) == n else np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    least = least[start]
    at = start.copy()
    for k in range(span - 1, -1, -1):
        same = grams[start + k] == least
        at[same] = start[same] + k
    return start, least, at


def _sequence(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word counts and a hash of the whole word sequence of each text."""
    hashes, counts = w.hashes(), w.counts()
    ordinal = (np.arange(len(hashes)) - np.repeat(w.first[:-1], counts)).astype(np.uint64)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix64(hashes + mix64(ordinal + GOLDEN)), out=total[1:])
    return hashes, counts, mix64(total[w.first[1:]] - total[w.first[:-1]] + counts.astype(np.uint64) * GOLDEN)


def sequences(text: Column) -> Column:
    """struct(n, node): number of words, and a hash that equal word sequences share."""

    def of(column: pa.Array) -> pa.Array:
        parts = [_sequence(w)[1:] for _, _, w in text_chunks(column)]
        n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        node = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(node.view(np.int64))], names=["n", "node"])

    return batch_udf(of, "struct<n:bigint,node:bigint>")(text)


def anchors(text: Column, window: int, prefix: int) -> Column:
    """struct(node, prefixes): the word sequence's hash and the prefixes at its anchors."""

    def of(column: pa.Array) -> pa.Array:
        nodes, found, counts = [], [], []
        for _, _, w in text_chunks(column):
            hashes, _, node = _sequence(w)
            _, least, at = _anchors(hashes, w.first, window, prefix)
            at, one = np.unique(at, return_index=True)
            nodes.append(node)
            found.append(least[one])
            counts.append(np.diff(np.searchsorted(at, w.first)))
        if not nodes:
            return pa.array([], pa.struct([("node", pa.int64()), ("prefixes", pa.list_(pa.int64()))]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), list_array(np.concatenate(found).view(np.int64), np.concatenate(counts))], names=["node", "prefixes"])

    return batch_udf(of, "struct<node:bigint,prefixes:array<bigint>>")(text)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and bounds of a list column, null as empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _under(w, i: int, j: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indices of the windows whose anchor's prefix is listed for their text."""
    start, least, _ = found
    prefixes, bounds = lists
    edge = np.searchsorted(start, w.first)
    keep = np.zeros(len(start), dtype=bool)
    for k in np.flatnonzero(np.diff(bounds[i : j + 1])) + i:
        a, b = edge[k - i], edge[k - i + 1]
        keep[a:b] = np.isin(least[a:b].view(np.int64), prefixes[bounds[k] : bounds[k + 1]])
    return np.flatnonzero(keep)


LEAF = pa.struct([("key", pa.int64()), ("h2", pa.int64()), ("pos", pa.int32()), ("words", pa.list_(pa.int64()))])


def leaves_below(text: Column, short: Column, long: Column, window: int, prefix: int) -> Column:
    """array of (key, h2, pos, words): what a text hands to the subtrees.

    Below a prefix of ``short``: key is the prefix, words are those of the windows with one
    anchor.  Below one of ``long``: (key, h2) is the lengthened prefix, the whole window.
    """

    def of(texts: pa.Array, shorts: pa.Array, longs: pa.Array) -> pa.Array:
        short_lists, long_lists = _lists(shorts), _lists(longs)
        parts, counts = [], []
        for i, j, w in text_chunks(texts):
            hashes = w.hashes()
            start, least, at = found = _anchors(hashes, w.first, window, prefix)
            mine = _under(w, i, j, found, short_lists)
            lead = np.ones(len(mine), dtype=bool)
            lead[1:] = at[mine[1:]] != at[mine[:-1]]
            run = np.flatnonzero(lead)
            size = np.diff(np.append(run, len(mine)))
            begin, total = start[mine[run]], size + window - 1
            first = np.cumsum(total) - total
            words = hashes[np.repeat(begin - first, total) + np.arange(total.sum())]
            whole = _under(w, i, j, found, long_lists)
            place = start[whole]
            key, h2 = least[mine[run]], np.zeros(len(run), np.uint64)
            if len(place):
                key = np.concatenate([key, windows(hashes, w.first, window)[0][place]])
                h2 = np.concatenate([h2, windows(mix64(hashes ^ GOLDEN), w.first, window)[0][place]])
            place = np.concatenate([begin, place])
            owner = np.searchsorted(w.first, place, "right") - 1
            order = np.argsort(owner, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(total) - total, total.sum()).astype(np.int32)), pa.array(words.view(np.int64)))
            lists = pa.concat_arrays([lists, pa.nulls(len(whole), lists.type)])
            rows = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(h2.view(np.int64)), pa.array((place - w.first[owner]).astype(np.int32)), lists], fields=list(LEAF))
            parts.append(rows.take(pa.array(order)))
            counts.append(np.bincount(owner, minlength=j - i))
        if not parts:
            return pa.array([], pa.list_(LEAF))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)), pa.concat_arrays(parts))

    return batch_udf(of, "array<struct<key:bigint,h2:bigint,pos:int,words:array<bigint>>>")(text, short, long)


def _nodes(words: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, node): the node at depth ``window`` of each place with so many words before its row's end."""
    node = np.unique(words, return_inverse=True)[1]
    place, depth = np.arange(len(words)), 1

    def down(node: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        # places still long enough, and their nodes ``step`` words on joined to their own
        far = np.flatnonzero(end - np.arange(len(end)) >= depth)
        pair = node[far] * (int(node.max(initial=0)) + 1) + node[far + step]
        out = np.zeros(len(node), dtype=np.int64)
        out[far] = np.unique(pair, return_inverse=True)[1]
        return far, out

    while depth * 2 <= window:
        place, node = down(node, depth, depth * 2)
        depth *= 2
    if depth < window:
        place, node = down(node, window - depth, window)
    return place, node[place]


FOUND = "key bigint, h2 bigint, d bigint, th bigint, pos int, n int"
_FOUND = pa.schema([(c, pa.int64()) for c in ("key", "h2", "d", "th")] + [("pos", pa.int32()), ("n", pa.int32())])


def _grow(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Subtrees of whole groups: runs (d, th, pos, n) of n windows that are not their node's first leaf."""
    d, th, pos = (rows[c].to_numpy() for c in ("d", "th", "pos"))
    words = rows["words"].combine_chunks()
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().to_numpy(zero_copy_only=False)
    stop = np.cumsum(size)
    place, node = _nodes(flat, np.repeat(stop, size), window)
    row = np.searchsorted(stop, place, "right")
    at = pos[row] + place - (stop - size)[row]
    order = np.lexsort((at, th[row], d[row], node))
    node, row, at = node[order], row[order], at[order]
    head = np.ones(len(node), dtype=bool)
    head[1:] = node[1:] != node[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    gone = (d[row] != d[row[first]]) | (th[row] != th[row[first]]) | (at != at[first])
    row, at = row[gone], at[gone]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    begin = np.ones(len(row), dtype=bool)
    begin[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(begin)
    n = np.diff(np.append(begin, len(row))).astype(np.int32)
    none = pa.nulls(len(n), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(d[row[begin]]), pa.array(th[row[begin]]), pa.array(at[begin].astype(np.int32)), pa.array(n)], schema=_FOUND)


def _subtrees(window: int) -> Callable:
    """Rows sorted by (key, h2, d, th, pos) to runs that go, and to the first leaf of each lengthened prefix (n = 0)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            is_short = pc.is_valid(rows["words"])
            lone = rows.filter(pc.invert(is_short))
            if lone.num_rows:
                key, h2 = lone["key"].to_numpy(), lone["h2"].to_numpy()
                head = np.append(True, (key[1:] != key[:-1]) | (h2[1:] != h2[:-1]))
                lone = lone.select(["key", "h2", "d", "th", "pos"]).filter(pa.array(head))
                yield from lone.append_column("n", pa.array(np.zeros(lone.num_rows, np.int32))).cast(_FOUND).to_batches()
            rows = rows.filter(is_short)
            if rows.num_rows:
                # a repeated row adds nothing
                same = np.zeros(rows.num_rows, dtype=bool)
                same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in (rows[name].to_numpy() for name in ("key", "d", "th", "pos"))])
                rows = rows.filter(pa.array(~same))
                key = rows["key"].to_numpy()
                last = int(np.searchsorted(key, key[-1]))
                if held and (last or held[0]["key"][0].as_py() != int(key[0])):
                    yield _grow(pa.concat_tables([*held, rows.slice(0, last)]), window)
                    held = []
                elif last:
                    yield _grow(rows.slice(0, last), window)
                held.append(rows.slice(last))
        if held:
            yield _grow(pa.concat_tables(held), window)

    return of


RESULT = "struct<n_words:bigint,n_removed:bigint,kept:string,kept_sha256:string,spans:array<struct<start:int,end:int>>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def removed(text: Column, copy: Column, gone: Column, long: Column, firsts: Column, window: int, prefix: int, with_text: bool) -> Column:
    """struct(n_words, n_removed, kept, kept_sha256, spans) of a text.

    The runs of ``gone`` go, and the windows below the prefixes of ``long`` but for those at ``firsts``.
    """

    def of(texts: pa.Array, copies: pa.Array, runs: pa.Array, longs: pa.Array, first_lists: pa.Array) -> pa.Array:
        run_size = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        run_at = np.append(0, np.cumsum(run_size)).astype(np.int64)
        run_pos, run_n = (runs.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "n"))
        long_lists = _lists(longs)
        first_flat, first_bounds = _lists(first_lists)
        whole = pc.fill_null(copies, False).to_numpy(zero_copy_only=False)
        n_words, n_removed, kept, digest, begins, ends, counts = [], [], [], [], [], [], []
        for i, j, w in text_chunks(texts):
            below, edge = np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
            if long_lists[1][j] > long_lists[1][i]:
                found = _anchors(w.hashes(), w.first, window, prefix)
                below = found[0][_under(w, i, j, found, long_lists)]
                edge = np.searchsorted(below, w.first)
            raw = w.raw.tobytes()
            for k in range(i, j):
                a, n = w.first[k - i], int(w.first[k - i + 1] - w.first[k - i])
                steps = np.zeros(n + 1, dtype=np.int64)
                if whole[k] and n >= window:
                    steps[0] = 1
                else:
                    mine = below[edge[k - i] : edge[k - i + 1]] - a
                    mine = mine[~np.isin(mine, first_flat[first_bounds[k] : first_bounds[k + 1]])]
                    part = slice(run_at[k], run_at[k + 1])
                    np.add.at(steps, mine, 1)
                    np.add.at(steps, mine + window, -1)
                    np.add.at(steps, run_pos[part], 1)
                    np.add.at(steps, run_pos[part] + run_n[part] + window - 1, -1)
                drop = np.cumsum(steps)[:n] > 0
                lost = int(drop.sum())
                words = [] if lost == n else raw[w.at[k - i] : w.at[k - i + 1]].split()
                words = [x for x, x_drop in zip(words, drop.tolist(), strict=True) if not x_drop] if words and lost else words
                out = b" ".join(words)
                turns = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                n_words.append(n)
                n_removed.append(lost)
                kept.append(out.decode() if with_text else None)
                digest.append(hashlib.sha256(out).hexdigest())
                begins.append(turns[::2])
                ends.append(turns[1::2])
                counts.append(len(turns) // 2)
        flat = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (begins, ends)]
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(_SPAN)))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string()), spans], names=["n_words", "n_removed", "kept", "kept_sha256", "spans"])

    return batch_udf(of, RESULT)(text, copy, gone, long, firsts)


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, with_text: bool = True, leaves: int = LEAVES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256, spans), a row for each row of docs (doc_id, text).

    spans: the repeats taken out, as (start, end) in words, end exclusive.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    light = cut(rows.select("d", "th", sequences(F.col("text")).alias("x")).select("d", "th", "x.*"), "sequences")
    reps = cut(light.where(F.col("n") >= window).groupBy("node").agg(F.min(F.struct("d", "th")).alias("rep")), "reps")
    own = reps.select("node", "rep.*")
    # suffixes by the prefix at their anchors, once for equal sequences; groups of one are dropped
    heavy = rows.select(anchors(F.col("text"), window, prefix).alias("x")).select("x.*").where(F.size("prefixes") > 0)
    suffixes = cut(heavy.groupBy("node").agg(F.first("prefixes").alias("prefixes")), "suffixes").select("node", F.explode("prefixes").alias("p"))
    groups = cut(suffixes.groupBy("p").agg(F.count("*").alias("leaves")).where("leaves > 1"), "groups")
    lengthened, many = cut_counted(groups.where(F.col("leaves") > leaves).select("p"), "lengthened")
    lengthened = F.broadcast(lengthened) if many <= BROADCAST_LONG else lengthened
    hot = suffixes.join(lengthened, "p", "left_semi").select("node", "p", F.lit(True).alias("hot"))
    cold = suffixes.join(lengthened, "p", "left_anti").join(groups.where(F.col("leaves") <= leaves).select("p"), "p", "left_semi")
    inner = hot.unionByName(cold.select("node", "p", F.lit(False).alias("hot"))).groupBy("node")
    inner = inner.agg(F.collect_set(F.when(~F.col("hot"), F.col("p"))).alias("short"), F.collect_set(F.when(F.col("hot"), F.col("p"))).alias("long"))
    inner = cut(inner.join(own, "node").select("d", "th", "short", "long"), "prefixes")
    # the subtrees, group by group
    below = rows.join(inner, ["d", "th"]).select("d", "th", F.explode(leaves_below(F.col("text"), F.col("short"), F.col("long"), window, prefix)).alias("x")).select("d", "th", "x.*")
    salt = F.when(F.col("words").isNull(), F.pmod("th", F.lit(SALTS))).otherwise(F.lit(0))
    dealt = below.repartition("key", salt).sortWithinPartitions("key", "h2", "d", "th", "pos")
    found = cut(dealt.select("key", "h2", "d", "th", "pos", "words").mapInArrow(_subtrees(window), FOUND), "subtrees")
    gone = found.where("n > 0").groupBy("d", "th").agg(F.collect_list(F.struct("pos", "n")).alias("gone"))
    firsts = found.where("n = 0").groupBy("key", "h2").agg(F.min(F.struct("d", "th", "pos")).alias("f"))
    firsts = firsts.select("f.*").groupBy("d", "th").agg(F.collect_set("pos").alias("firsts"))
    info = inner.where(F.size("long") > 0).select("d", "th", "long").join(gone, ["d", "th"], "full").join(firsts, ["d", "th"], "left").withColumn("copy", F.lit(False))
    copies = light.where(F.col("n") >= window).join(own.select("node", F.col("d").alias("rd"), F.col("th").alias("rt")), "node").where((F.col("d") != F.col("rd")) | (F.col("th") != F.col("rt")))
    copies = copies.select("d", "th").distinct().withColumn("copy", F.lit(True))
    joined = rows.join(info.unionByName(copies, allowMissingColumns=True), ["d", "th"], "left")
    out = joined.select("doc_id", removed(F.col("text"), F.col("copy"), F.col("gone"), F.col("long"), F.col("firsts"), window, prefix, with_text).alias("x"))
    return out.select("doc_id", "x.*")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
