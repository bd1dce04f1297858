"""Operator 6: exact Jaccard metric-space join on word shingles.

Two sets link when 100 * |A and B| >= link * |A or B| (85 unless said otherwise), so
their symmetric difference has at most (100 - link) / link of the smaller set's elements.

Level one.  Whole documents can't be pivots of all documents: unrelated documents are
at distance 1 from every pivot and would stand in every pivot's window.  So level one
deals the shingle universe by hash into m parts (m by size class; a set also stands in
the next class where its window of partner sizes reaches into that class).  A set lies
in the cell of each of its P non-empty parts' contents.  A pair that links differs in at
most K parts, K from the bound above, so it shares ``need`` = P - K cells or more.  A set
for which that leaves none is *short*: short sets lie in a cell of their own, and if
there are any they are joined with all others by prefixes of their shingles.  Cells of
up to LEAF members are compared directly, after pairs that share too few cells are left
out.

Regions.  A pair that shares no small cell shares ``need`` crowded ones, so documents
with that many crowded parts go on.  Each crowded cell, but for the most crowded ones
that a pair can do without, has a pivot: its member with the fewest parts of its own,
which is the nearest to what the cell has in common.  The cells of one pivot are its
region, to which those of pivots that lie in one of its cells are added; a document stands
in the region of every pivot of its cells, so that each linked pair meets.  In a region documents are held by their difference D from the pivot, and by
their signed distance from where a link with the pivot begins, s = (100 + link) |D| -
(100 - link) n.  Two documents link exactly if s(a) + s(b) <= 2 (100 + link) |D(a) and
D(b)|.  So all that link without common differences link with the document of least s:
one edge each joins them.

Windows.  Any other link needs common differences: the region is joined once more, on
the differences in place of the sets, rarest first.  A document stands at as many of
its rarest differences as the bound lets the partner lack, and in the bands of s, the
distance from the pivot, which the triangle inequality leaves for a partner whose first
common difference is that one; only pairs of different components are compared.

Equal sets are one node throughout (64 bits; a second hash tells sets of equal nodes
apart, which then get nodes of their own).  Every link between different sets is checked
on their 64-bit shingle hashes.

Edge cases: a null or wordless text has an empty set and links with nothing; up to
three words are one shingle; repeated rows and equal texts share a node; a null
doc_id counts only where its component has no other; no rows give no rows; other
columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import GOLDEN, batch_udf, cut, cut_counted, drop_cut, list_array, mix64, table, text_chunks, windows
from .components import components

SHINGLE = 4
LINK, OF = 85, 100
LEAF = 32
#: Node lists up to this long are broadcast to pick the sets to verify; longer ones are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: A part is dealt out by holder, over SALTS groups, when OFTEN sets of one Arrow batch (BATCH_ROWS texts) hold it; any other part is held by fewer of each batch.
OFTEN, SALTS = 4, 64
#: Parts that very many sets hold, up to which they are broadcast to their holders; more are joined by shuffle.
BROADCAST_PARTS = 300_000
#: Values in all pivots' sets up to which they are broadcast to their regions; more are joined by shuffle.
BROADCAST_VALUES = 2_000_000
NODE_TYPE = "struct<n:bigint,node:bigint,twin:bigint>"
SET_TYPE = "struct<n:bigint,node:bigint,twin:bigint,shingles:array<bigint>>"
PART_TYPE = "struct<n:bigint,node:bigint,twin:bigint,classes:array<struct<need:int,parts:array<bigint>>>>"
#: The cell of all short sets; its low bits are no size class.
SHORT = 63


def _chunk_sets(w, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after another, and their numbers."""
    hashes, first = w.hashes(), w.first
    grams, whole = windows(hashes, first, k)
    out, counts = [], np.zeros(len(first) - 1, dtype=np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            found = np.unique(grams[a : b - k + 1])
        elif b > a:
            found = windows(hashes[a:b], np.array([0, b - a]), int(b - a))[0][:1]
        else:
            continue
        counts[i] = len(found)
        out.append(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    at = np.concatenate([[0], np.cumsum(counts)])
    return total[at[1:]] - total[at[:-1]]


def _nodes(shingles: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Number of shingles, node and second hash of each set."""
    extra = counts.astype(np.uint64) * GOLDEN
    node, twin = (mix64(_sums(mix64(shingles * odd + GOLDEN), counts) + extra).view(np.int64) for odd in (np.uint64(1), np.uint64(0x9FB21C651E98DF25)))
    return [pa.array(counts), pa.array(node), pa.array(twin)]


def _batch(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [_chunk_sets(w, k) for _, _, w in text_chunks(text, lower=True)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def sets(text: Column, k: int = SHINGLE) -> Column:
    """struct(n, node, twin, shingles): a text's shingle set; node and twin are the same for equal sets."""

    def of(t: pa.Array) -> pa.Array:
        shingles, counts = _batch(t, k)
        return pa.StructArray.from_arrays([*_nodes(shingles, counts), list_array(shingles.view(np.int64), counts)], names=["n", "node", "twin", "shingles"])

    return batch_udf(of, SET_TYPE, once=True, lean=True)(text)


def nodes(text: Column, k: int = SHINGLE) -> Column:
    """struct(n, node, twin) of a text."""

    def of(t: pa.Array) -> pa.Array:
        found = [pa.StructArray.from_arrays(_nodes(s, c), names=["n", "node", "twin"]) for s, c in (_chunk_sets(w, k) for _, _, w in text_chunks(t, lower=True))]
        return pa.concat_arrays(found) if found else pa.array([], pa.struct([(c, pa.int64()) for c in ("n", "node", "twin")]))

    return batch_udf(of, NODE_TYPE, once=True, lean=True)(text)


def _schemes(n: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """The size class of each set, and whether it also stands in the next."""
    own = np.maximum(5, np.floor(np.log2(np.maximum(n, 1) + 0.5)).astype(np.int64))
    return own, n * OF >= (1 << (own + 1)) * link


def _eighths(link: int) -> int:
    """Parts of a size class, in eighths of its least size: so many that its largest sets have a third more non-empty parts than a link may change."""
    for e in range(4, 65):
        if e / 8 * (1 - np.exp(-16 / e)) >= 1.35 * 2 * (OF - link) / link:
            return e
    raise ValueError(f"link {link}: parts can't tell sets this far apart")


def _parts_of(shingles: np.ndarray, counts: np.ndarray, scheme: np.ndarray, eighths: int) -> tuple[np.ndarray, np.ndarray]:
    """Contents of each set's non-empty parts as keys with the scheme in the lowest bits, and their numbers."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(owner):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    m = np.maximum(64, (eighths << scheme) >> 3).astype(np.uint64)
    part = mix64(shingles ^ GOLDEN) % m[owner]
    key = (owner.astype(np.uint64) << np.uint64(32)) | part
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    content = np.add.reduceat(mix64(shingles[order] * GOLDEN + np.uint64(7)), start)
    owner, part = (key[start] >> np.uint64(32)).astype(np.int64), key[start] & np.uint64(0xFFFFFFFF)
    sig = mix64(content + mix64(part + GOLDEN))
    return (sig << np.uint64(6)) | scheme[owner].astype(np.uint64), np.bincount(owner, minlength=len(counts))


def _dealt(shingles: np.ndarray, counts: np.ndarray, link: int, eighths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set, need, parts (one run) and number of parts of each set in each of its size classes, by set; the part SHORT where a set is short."""
    own, more = _schemes(counts, link)
    some = counts > 0
    which = np.concatenate([np.flatnonzero(some), np.flatnonzero(some & more)])
    scheme = np.concatenate([own[some], own[some & more] + 1])
    order = np.argsort(which, kind="stable")
    which, scheme = which[order], scheme[order]
    at = np.cumsum(counts) - counts
    size = counts[which]
    rows = np.arange(int(size.sum())) + np.repeat(at[which] - (np.cumsum(size) - size), size)
    keys, lengths = _parts_of(shingles[rows], size, scheme, eighths)
    need = lengths - size * (OF - link) // link
    short = need < 1
    keys = np.insert(keys, np.cumsum(lengths)[short], np.uint64(SHORT))
    return which, np.maximum(need, 1), keys.view(np.int64), lengths + short


def parts(text: Column, k: int = SHINGLE, link: int = LINK) -> Column:
    """struct(n, node, twin, classes): a text's cells in its size class and perhaps the next, and how many of them a linked set shares; the cell SHORT if that is none."""
    eighths = _eighths(link)

    def of_chunk(shingles: np.ndarray, counts: np.ndarray) -> pa.Array:
        which, need, keys, lengths = _dealt(shingles, counts, link, eighths)
        both = pa.StructArray.from_arrays([pa.array(need, pa.int32()), list_array(keys, lengths)], names=["need", "parts"])
        bounds = np.searchsorted(which, np.arange(len(counts) + 1))
        return pa.StructArray.from_arrays([*_nodes(shingles, counts), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), both)], names=["n", "node", "twin", "classes"])

    def of(t: pa.Array) -> pa.Array:
        chunks = [of_chunk(*_chunk_sets(w, k)) for _, _, w in text_chunks(t, lower=True)]
        return pa.concat_arrays(chunks) if chunks else of_chunk(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    return batch_udf(of, PART_TYPE, once=True, lean=True)(text)


class _Nodes:
    """Rows of docs once for each different set, and the nodes of all rows."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, k: int):
        self.docs, self.doc_id, self.text = docs, doc_id, text
        raw = cut(docs.select(docs[doc_id].alias("doc_id"), nodes(docs[text], k).alias("x")).select("doc_id", "x.*"), "nodes")
        self.clash, self.clashes = cut_counted(raw.where("n > 0").groupBy("node").agg(F.min("twin").alias("lo"), F.max("twin").alias("hi")).where("lo <> hi").select(F.col("node").alias("clash")), "clash")
        self.light = self.apart(raw)
        self.first = self.light.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
        copies = self.light.join(self.first.where("rows > 1"), "node").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("copy_id"), F.col("node").alias("copy_node")).distinct()
        copies, n = cut_counted(copies, "copies")
        self.copies = F.broadcast(copies) if n <= BROADCAST_NODES else copies

    def apart(self, df: DataFrame) -> DataFrame:
        """df with nodes of their own for different sets of one hash."""
        if self.clashes:
            clash = F.broadcast(self.clash) if self.clashes <= BROADCAST_NODES else self.clash
            df = df.join(clash, F.col("node") == F.col("clash"), "left").withColumn("node", F.when(F.col("clash").isNotNull(), F.xxhash64("node", "twin")).otherwise(F.col("node"))).drop("clash")
        return df.drop("twin")

    def once(self, of: Column) -> DataFrame:
        """of, a struct with n and node, for the rows of docs but those whose set a row of lesser doc_id has."""
        rows = self.docs.select(self.docs[self.doc_id].alias("doc_id"), of.alias("x")).select("doc_id", "x.*").where("n > 0")
        return self.apart(rows).join(self.copies, (F.col("node") == F.col("copy_node")) & F.col("doc_id").eqNullSafe(F.col("copy_id")), "left_anti").drop("doc_id")


class _Verifier:
    """The sets of the nodes that have candidates, and the exact test on pairs of them."""

    def __init__(self, held: _Nodes, wanted: DataFrame, k: int, link: int):
        self.link = link
        wanted, n = cut_counted(wanted.select("node").distinct(), "wanted")
        found = held.once(sets(held.docs[held.text], k)).join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, "node", "left_semi")
        self.sets = cut(found.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("s")), "sets")
        drop_cut(wanted)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        a = self.sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        b = self.sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        near = (F.col("na") * OF >= F.col("nb") * self.link) & (F.col("nb") * OF >= F.col("na") * self.link)
        both = pairs.join(a, "a").join(b, "b").where(near).withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return cut(both.where(F.col("common") * OF >= (F.col("na") + F.col("nb") - F.col("common")) * self.link).select("a", "b"), "links")


def _regions(verifier: _Verifier, members: DataFrame) -> DataFrame:
    """(r, node, n, d, s): the members (r, node) of each region with their differences from its pivot r and signed distances."""
    link = verifier.link
    pivots = cut(members.select(F.col("r").alias("node")).distinct().join(verifier.sets, "node").select(F.col("node").alias("p"), F.col("s").alias("ps")), "pivots")
    values = pivots.agg(F.sum(F.size("ps"))).first()[0] or 0
    both = members.join(verifier.sets, "node").join(F.broadcast(pivots) if values <= BROADCAST_VALUES else pivots, F.col("r") == F.col("p"))
    held = both.select("r", "node", "n", F.size("ps").alias("nr"), F.concat(F.array_except("s", "ps"), F.array_except("ps", "s")).alias("d"))
    return cut(held.withColumn("s", (OF + link) * F.size("d").cast("long") - (OF - link) * F.col("n")), "regions")


def _stars(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each region's member of least s, as (r, at, low); and edges (a, b) of all that link with it without common differences."""
    centre = cut(regions.groupBy("r").agg(F.min(F.struct("s", "node")).alias("c")).select("r", F.col("c.node").alias("at"), F.col("c.s").alias("low")), "centres")
    edges = regions.select("r", "node", "s").join(centre, "r").where((F.col("s") + F.col("low") <= 0) & (F.col("node") != F.col("at"))).select(F.col("at").alias("a"), F.col("node").alias("b"))
    return centre, edges


def _windows(regions: DataFrame, centre: DataFrame, comps: DataFrame, link: int) -> DataFrame:
    """(a, b): pairs of one region, of different components, that can link by common differences."""
    q = OF + link
    own = regions.select("r", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = own.join(own.groupBy("r").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("r"), "r", "left_semi")
    own = cut(own.join(centre.select("r", "low"), "r"), "open")
    rows = cut(regions.where(F.size("d") > 0).join(own, ["r", "node"]).withColumn("nd", F.size("d")), "differences")
    flat = rows.select("r", "node", "comp", F.explode("d").alias("e"))
    shared = flat.groupBy("r", "e").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").drop("x", "y")
    # differences that no member of another component has come first and only count
    ranked = flat.join(shared, ["r", "e"]).groupBy("r", "node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    ranked = cut(rows.drop("d").join(ranked, ["r", "node"]), "ranked")
    # the last ones, as many as any partner must share but for one, can't be the first that is shared
    ahead = F.size("es") + 1 - F.ceil(F.greatest(F.col("low") + F.col("s"), F.lit(1)) / (2 * q)).cast("int")
    at = ranked.withColumn("alone", F.col("nd") - F.size("es")).select("*", F.posexplode(F.slice("es", F.lit(1), F.greatest(ahead, F.lit(0)))).alias("i", "x")).withColumn("left", (F.col("nd") - F.col("alone") - F.col("i")).cast("long"))
    # left: differences from this one on, the most that may be common
    at = at.withColumn("most", 2 * q * F.col("left") - F.col("s"))
    width = F.greatest(F.lit(1), (OF - link) * F.col("nr"))
    near = at.where(F.col("left") * q >= F.greatest(F.col("s"), F.lit(1))).withColumn("least", F.greatest(F.col("s"), 1 - F.col("s"))).where("most >= least")
    near = near.withColumn("band", F.explode(F.sequence(F.floor(F.col("least") / width), F.floor(F.col("most") / width))))
    far = at.withColumn("band", F.floor(F.col("s") / width))
    one = lambda df, t: df.select("r", F.col("x.e").alias("e"), "band", *[F.col(c).alias(c + t) for c in ("node", "n", "s", "most", "comp")])
    met = (F.col("s_a") <= F.col("s_b")) & (F.col("s_b") <= F.col("most_a")) & (F.col("s_a") <= F.col("most_b")) & (F.col("s_a") + F.col("s_b") > 0) & (F.col("comp_a") != F.col("comp_b"))
    size = (F.col("n_a") * OF >= F.col("n_b") * link) & (F.col("n_b") * OF >= F.col("n_a") * link)
    both = one(near, "_a").join(one(far, "_b"), ["r", "e", "band"]).where(met & size)
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _short_pairs(held: _Nodes, short: DataFrame, k: int, link: int) -> DataFrame:
    """(a, b): the short sets, by node, with all sets that share one of the first shingles, n - ceil(n * link / 100) + 1 of each in one order."""
    prefix = lambda c: F.slice(F.array_sort(c), F.lit(1), (F.col("n") - F.ceil(F.col("n") * link / OF) + 1).cast("int"))
    every = held.once(sets(held.docs[held.text], k)).select("node", F.explode(prefix(F.col("shingles"))).alias("e"))
    own = every.join(short, "node", "left_semi").select(F.col("node").alias("a"), "e")
    return own.join(every.withColumnRenamed("node", "b"), "e").where("a <> b").select("a", "b").distinct()


def _often(texts: DataFrame, k: int, link: int) -> DataFrame:
    """(often): every part that OFTEN sets or more of one Arrow batch hold.  texts has one column."""
    eighths = _eighths(link)

    def of(column: pa.Array) -> pa.Array:
        held = []
        for _, _, w in text_chunks(column, lower=True):
            shingles, counts = _chunk_sets(w, k)
            one = np.zeros(len(counts), dtype=bool)  # of copies that lie together one counts
            one[np.unique(_nodes(shingles, counts)[1].to_numpy(), return_index=True)[1]] = True
            held.append(_dealt(shingles[np.repeat(one, counts)], counts[one], link, eighths)[2])
        part, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
        found = part[n >= OFTEN]
        return list_array(found, np.append(len(found), np.zeros(max(len(column) - 1, 0), np.int64))[: len(column)])  # all beside the first row

    # the kind of function that parts are made with, so that a task's Python worker serves both
    return texts.select(F.explode(batch_udf(of, "array<bigint>", lean=True)(texts[texts.columns[0]])).alias("often")).distinct()


def _held_parts(heavy: DataFrame, often: DataFrame) -> DataFrame:
    """(node, need, part, members, cell): parts that different sets hold, with the number and a hash of their holders.

    The holders of a part meet in one group, but for parts that very many hold: these are
    dealt out by holder, and counted where they lie.
    """
    often, n = cut_counted(often, "often")
    rows = heavy.select("node", F.explode("classes").alias("c")).select("node", "c.need", F.explode("c.parts").alias("part"))
    rows = rows.join(F.broadcast(often) if n <= BROADCAST_PARTS else often, F.col("part") == F.col("often"), "left")
    rows = rows.select("node", "need", "part", F.when(F.col("often").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.lit(SALTS))).cast("int").alias("salt"))
    by = Window.partitionBy("part", "salt")
    stats = {"members": F.count("*"), "least": F.min("node"), "most": F.max("node"), "every": F.bit_xor(F.xxhash64("node"))}
    apart, cell = (F.col("least") != F.col("most")) | (F.col("part") == SHORT), F.xxhash64("members", "least", "most", "every", F.col("part").bitwiseAND(63).cast("int"))
    spread = rows.withColumns({k: v.over(by) for k, v in stats.items()}).where(apart | (F.col("salt") >= 0))
    held = cut(spread.select("node", "need", "part", "salt", "members", F.when(F.col("salt") < 0, cell).alias("cell")), "parts")
    few = held.where("salt < 0").drop("salt")
    if not n:
        return few
    many = held.where("salt >= 0").select("node", "need", "part")
    counted, n = cut_counted(many.groupBy("part").agg(*[v.alias(k) for k, v in stats.items()]).where(apart).select("part", "members", cell.alias("cell")), "counted")
    return few.unionByName(many.join(F.broadcast(counted) if n <= BROADCAST_PARTS else counted, "part"))


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, link: int = LINK, held: _Nodes | None = None) -> DataFrame:
    """(doc_id, node, n_shingles, component_id), a row for each row of docs; held: their nodes, if known."""
    held = held or _Nodes(docs, doc_id, text, k)
    light = held.light
    heavy = held.once(parts(docs[text], k, link))
    held_parts = _held_parts(heavy, _often(docs.select(docs[text]), k, link))
    cells = held_parts.withColumn("scheme", F.col("part").bitwiseAND(63).cast("int"))
    # parts with the same members are one cell
    every = cut(cells.groupBy("scheme", "cell", "members", "node", "need").agg(F.countDistinct("part").alias("parts")), "cells")
    drop_cut(held_parts)
    cells, short = every.where(F.col("scheme") != SHORT), every.where(F.col("scheme") == SHORT).select("node")
    # met: parts in crowded cells; lack: by how many these are fewer than what a linked set shares at least
    met = F.coalesce(F.sum(F.when(F.col("members") > LEAF, F.col("parts"))), F.lit(0))
    needs = cut(cells.groupBy("node", "scheme", "need").agg(met.alias("met"), F.sum("parts").alias("shared")).where("shared >= need").drop("shared"), "needs")
    small = cells.where(F.col("members") <= LEAF).join(needs, ["node", "scheme", "need"]).select("cell", "scheme", "node", "parts", "need", "met")
    a, b = small.withColumnsRenamed({"node": "a", "need": "need_a", "met": "met_a"}), small.select("cell", *[F.col(c).alias(f"{c}_b") for c in ("need", "met")], F.col("node").alias("b"))
    pairs = a.join(b, "cell").where("a < b").groupBy("a", "b", "scheme", "need_a", "need_b", "met_a", "met_b").agg(F.sum("parts").alias("shared"))
    pairs = pairs.where(F.col("shared") + F.least("met_a", "met_b") >= F.greatest("need_a", "need_b")).select("a", "b")
    pairs = cut((pairs if short.isEmpty() else pairs.unionByName(_short_pairs(held, short, k, link))).distinct(), "pairs")
    crowded = cells.where(F.col("members") > LEAF).join(needs.where("met >= need"), ["node", "scheme", "need"])
    # the most crowded cells go: a pair shares ``need`` parts, the rarest of which stays
    over = Window.partitionBy("node", "scheme").orderBy(F.desc("members"), F.desc("cell"))
    crowded = cut(crowded.withColumn("upto", F.sum("parts").over(over)).where("upto >= need").select("node", "cell", (F.col("need") - F.col("met")).alias("lack")), "crowd")
    pivot = crowded.groupBy("cell").agg(F.min(F.struct("lack", "node")).alias("p"))
    # a pivot hands its cells to the best pivot of its own cells, if that is another, and that one does so once more
    held_by = cut(crowded.join(pivot, "cell").groupBy("node").agg(F.min("p").alias("up")).where("up.node <> node").select(F.col("node").alias("low"), "up"), "pivots")
    for _ in range(2):
        pivot = pivot.join(held_by, F.col("p.node") == F.col("low"), "left").select("cell", F.coalesce("up", "p").alias("p"))
    members = cut(crowded.join(pivot, "cell").select(F.col("p.node").alias("r"), "node").distinct(), "members")
    for done in (every, needs):
        drop_cut(done)
    verifier = _Verifier(held, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")), k, link)
    regions = _regions(verifier, members)
    centre, edges = _stars(regions)
    comps = components(edges.unionByName(verifier.links(pairs)))
    more = verifier.links(cut(_windows(regions, centre, comps, link), "candidates"))
    comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    for done in (regions, verifier.sets, pairs, members, crowded):
        drop_cut(done)
    labelled = held.first.select("node", "first").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
    ids = labelled.join(best, "comp").select("node", "component_id")
    full = light.where("n > 0").join(ids, "node")
    empty = light.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, k: int = 5, link: int = 80) -> DataFrame:
    """The rows of docs without those that link to a row that stays: of each component the least doc_id, one row of it."""
    columns = docs.columns
    held = _Nodes(docs, "doc_id", "text", k)
    linked = link_components(docs, k=k, link=link, held=held)
    stays = linked.where("n_shingles > 0").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("d"), F.col("node").alias("nd")).agg(F.count("*").alias("rows"))
    stays, n = cut_counted(stays, "stays")
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs["doc_id"].alias("id"), nodes(docs["text"], k).alias("x")).select("row", "id", "x.*")
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("nd"))
    marked = held.apart(rows).join(F.broadcast(stays) if n <= BROADCAST_NODES else stays, same, "left")
    out = marked.where("n = 0 or rows = 1").select("row.*")
    if stays.where("rows > 1").isEmpty():
        return out
    # repeated rows of one doc_id and set: the first as text stays
    again = marked.where("n > 0 and rows > 1").withColumn("copy", F.row_number().over(Window.partitionBy("d", "nd").orderBy(F.to_json("row"))))
    return out.unionByName(again.where("copy = 1").select("row.*"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
