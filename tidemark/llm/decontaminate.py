"""Operator 9: benchmark decontamination, in DataFrame functions only.

Benchmark windows of 13 normalised words (shorter items are one window) become a
broadcast hash set.  Each document's words are hashed once; hashes of 13-word
windows come from sums of powers of two (1, 2, 4, 8 words), not from 13 words
each.  Windows whose hash is in the set are gathered by document, as (place, length,
hash); for the few documents that have any, the words themselves are compared with the
set's before a hit counts, and only then do the items that hold a window come in.
Texts are not shuffled while the gathered places stay within BROADCAST_HITS.

Edge cases: null and wordless texts have no words and no hits; benchmark items
that are null or wordless are no window; repeated document rows each get their
own, equal, result; a document word inside any occurrence counts once; an empty
benchmark leaves every document clean; other columns pass through untouched, but for
those named w, hits, item_ids, n_words, n_hit or contaminated, which are replaced in
what find_hits and judged return (remove_contaminated keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, drop_cut, table

WINDOW = 13
#: One row a distinct benchmark window; more than this many rows are joined by shuffle, not broadcast.
BROADCAST_WINDOWS = 500_000
#: Gathered places up to this many are broadcast to their documents; more are joined by shuffle.
BROADCAST_HITS = 500_000
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]++, its characters one by one: Java finds these in one table, but asks range after range for each character of a text.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)) + "]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Normalised words of a text; null gives none."""
    whole = F.coalesce(text, F.lit(""))
    # lower() is the same and faster where every character is ASCII
    lower = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _pair(a: Column, b: Column, offset: int) -> Column:
    """Hash of a[i] with b[i + offset]; the last ones, which lack a partner, are cut off later."""
    return F.zip_with(a, F.slice(b, F.lit(1 + offset), F.greatest(F.size(b) - offset, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def _hash_windows(df: DataFrame, words_column: str, lengths: list[int]) -> DataFrame:
    """Adds column h<k>, the hashes of the k-word windows by start, for each k."""
    df = df.withColumn("p1", F.transform(words_column, lambda w: F.xxhash64(w)))
    for p in (2, 4, 8):
        if max(lengths) >= p:
            df = df.withColumn(f"p{p}", _pair(F.col(f"p{p // 2}"), F.col(f"p{p // 2}"), p // 2))
    for k in lengths:
        bits = [p for p in (8, 4, 2, 1) if k & p]
        df = df.withColumn(f"h{k}", F.col(f"p{bits[0]}"))
        done = bits[0]
        for p in bits[1:]:
            df = df.withColumn(f"h{k}", _pair(F.col(f"h{k}"), F.col(f"p{p}"), done))
            done += p
        df = df.withColumn(f"h{k}", F.slice(f"h{k}", F.lit(1), F.greatest(F.size(words_column) - (k - 1), F.lit(0))))
    return df


def benchmark_windows(items: DataFrame, lengths: list[int], item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(h, k, gram, items): each distinct window with its hash and the items that hold it."""
    w = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("k", F.least(F.size("w"), F.lit(WINDOW)))
    w = _hash_windows(w, "w", lengths)
    rows = [w.where(F.col("k") == k).select("item", "w", "k", F.posexplode_outer(f"h{k}").alias("pos", "h")) for k in lengths]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("h is not null").groupBy("h", "k", F.slice("w", F.col("pos") + 1, F.col("k")).alias("gram")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _lengths(items: DataFrame, text: str) -> list[int]:
    found = items.select(F.least(F.size(words(F.col(text))), F.lit(WINDOW)).alias("k")).where("k > 0").distinct().collect()  # 13 rows at most
    return sorted({r["k"] for r in found} or {WINDOW}, reverse=True)


def _small(places: DataFrame) -> DataFrame:
    """places, marked for broadcast where the hits in all its rows are few."""
    return F.broadcast(places) if (places.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_HITS else places


def find_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with columns w (its words), hits (array of pos, k; verified; null if none) and item_ids (sorted strings)."""
    columns = [c for c in docs.columns if c not in ("w", "hits", "item_ids")]
    packed = docs.select(docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"), F.struct(*[docs[c] for c in columns]).alias("row"))
    lengths = _lengths(items, item_text)
    grams = cut(benchmark_windows(items, lengths, item_id, item_text), "windows")
    few = grams.count() <= BROADCAST_WINDOWS
    small = lambda df: F.broadcast(df) if few else df
    scan = _hash_windows(packed.select("id", "th", words(F.col("text")).alias("w")), "w", lengths).select("id", "th", *[f"h{k}" for k in lengths])
    # outer: for the inner kind Spark infers a filter on the array and repeats the whole chain of hashes in it
    if len(lengths) == 1:
        flat = scan.select("id", "th", F.posexplode_outer(f"h{lengths[0]}").alias("pos", "h")).withColumn("k", F.lit(lengths[0]))
    else:
        tag = lambda k: F.transform(f"h{k}", lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.lit(k).alias("k")))
        flat = scan.select("id", "th", F.explode_outer(F.concat(*[tag(k) for k in lengths])).alias("x")).select("id", "th", "x.*")
    met = flat.join(small(grams.select("h", "k").distinct()), ["h", "k"], "left_semi")
    met = cut(met.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "k", "h")).alias("hits")), "met")
    same = lambda at: packed["id"].eqNullSafe(at["d"]) & (packed["th"] == at["dh"])
    at = _small(met.select(F.col("id").alias("d"), F.col("th").alias("dh"), "hits"))
    own = packed.select("id", "th", "text").join(at, same(at)).dropDuplicates(["id", "th"]).select("id", "th", words(F.col("text")).alias("w"), "hits")
    own = own.select("id", "th", "w", F.explode("hits").alias("x")).select("id", "th", "x.*", F.slice("w", F.col("x.pos") + 1, F.col("x.k")).alias("gram"))
    names = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda i: i.cast("string"))))
    good = own.join(small(grams), ["h", "k", "gram"]).groupBy("id", "th").agg(F.collect_set(F.struct("pos", "k")).alias("hits"), names.alias("item_ids"))
    good = cut(good.select(F.col("id").alias("d"), F.col("th").alias("dh"), "hits", "item_ids"), "hits")
    drop_cut(met)
    at = _small(good)
    return packed.join(at, same(at), "left").select("row.*", words(F.col("text")).alias("w"), "hits", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def hit_positions(hits: Column) -> Column:
    """Indexes of the words inside any hit."""
    spread = F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["k"] - 1)))
    return F.coalesce(F.array_distinct(spread), F.array().cast("array<int>"))


def judged(found: DataFrame) -> DataFrame:
    """Adds n_words, n_hit and contaminated to what find_hits gives."""
    out = found.withColumns({"n_words": F.size("w").cast("long"), "n_hit": F.size(hit_positions(F.col("hits"))).cast("long")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, columns as they were."""
    packed = docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return judged(find_hits(packed, items)).where(~F.col("contaminated")).select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(find_hits(docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
