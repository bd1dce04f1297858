"""Operator 1: quality rules with adaptive thresholds.

Fixed cutoffs are replaced by fences drawn from quantile sketches.  A sketch is a
log-linear histogram of an integer measure (exact below 64, then 32 buckets to
each doubling: 3 % relative error).  Sketches merge by adding counts, so the
per-partition partial counts, the sketch of a (lang, source) group, of a language
and of the whole corpus are all sums of the same rows, whatever the partitioning.

A language's sketch is merged with the corpus's at the weight of ``prior`` documents,
a group's with its language's, so a group's own documents count the more the more
there are, without a step.

Word length has a spread in any corpus: its fences stand FENCE interquartile ranges
outside the quartiles.  Texts shorter than their group's median vary more; their
fences widen with the square root of the ratio.

Symbols, repeated lines and repeated words are absent from most texts, so their
quartiles are 0 and say nothing.  Their fences come from two sketches each, of the
documents inside and outside the fences of word length (the corpus's sketch of the
latter is merged with that of the former, so a few documents outside prove nothing).
What is LIFT times more frequent outside than inside, from some value on, and is found
in a share of SHARE of the documents outside at least, marks bad texts: the least such
value is a fence.  Another stands FENCE interquartile ranges of the non-zero values
inside, which have merged sketches of their own, above their upper quartile.  An interquartile range counts as one bucket of the
sketch at least, its resolution.

Edge cases: a null or empty text has no words and zero measures and is base_failed;
texts that are base_failed are not counted in any sketch; null lang or source is a
group of its own; repeated rows are judged alike and each counts; columns named like
the measures or thresholds don't clash (rows travel packed); no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import GOLDEN, batch_udf, cut, cut_counted, drop_cut, mix64, per_text, table, text_chunks, windows

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURE_TYPE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint>"
#: measure -> (numerator, denominator), in thousandths.
SPREAD = {"word_len": ("word_chars", "n_words")}
COUNTS = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
MEASURES = SPREAD | COUNTS
#: A fence stands this many spreads outside the quartiles.
FENCE = 4
#: How much more frequent a value has to be outside the fences of word length than inside, and in which share of the documents outside.
LIFT, SHARE = 4, 0.1
#: Documents for which the sketch above counts when it is merged with a group's.
PRIOR = 100
#: Documents of value 0 from which the corpus's sketch of non-zero values starts: a value that a single text has is not yet usual.
ZEROS = 4
#: Parts into which a document's weight is divided, so that merged sketches are sums of integers.
SCALE = 10_000
#: Threshold tables up to this many groups are broadcast; larger ones are joined by shuffle.
BROADCAST_GROUPS = 20_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which elements occur twice or more."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def _chunk_measures(w) -> list[np.ndarray]:
    counts = w.counts()
    hashes = w.hashes()
    five, whole = windows(hashes, w.first, 5)
    owner = w.owner()
    at = np.flatnonzero(whole)
    twice = at[_repeated(mix64(five[at] + owner[at].astype(np.uint64) * GOLDEN))]
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(5):
        covered[twice + k] = True
    breaks = np.flatnonzero(w.raw == 10)
    start = np.unique(np.concatenate([w.at[:-1], breaks + 1]))
    start = start[start < len(w.raw)]
    end = np.append(start[1:], len(w.raw))
    end = np.where(w.raw[end - 1] == 10, end - 1, end) if len(start) else end[:0]
    worded = np.zeros(len(w.raw) + 1, dtype=np.int64)
    np.cumsum(w.inside, out=worded[1:])
    has = worded[end] > worded[start] if len(start) else np.zeros(0, dtype=bool)
    start, end = start[has], end[has]
    doc = np.searchsorted(w.at, start, "right") - 1
    key = mix64(w.hash_spans(start, end) + doc.astype(np.uint64) * GOLDEN)
    n = len(counts)
    lines = np.bincount(doc, minlength=n)
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=n)
    return [counts, per_text(w.inside & ((w.raw & 0xC0) != 0x80), w.at), per_text(_SYMBOL[w.raw], w.at), lines - distinct, per_text(covered, w.first), lines]


def _measure(text: pa.Array) -> pa.Array:
    parts = [_chunk_measures(w) for _, _, w in text_chunks(text)]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[*BASE, "n_lines"])


def measures(docs: DataFrame, text: str = "text") -> Column:
    """The base measures of a text column, as one struct."""
    return batch_udf(_measure, MEASURE_TYPE, once=True, lean=True)(docs[text])


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (F.lit(100) * m["n_repeat_words"] > F.lit(20) * m["n_words"])


def _value(m: Column, name: str) -> Column:
    num, den = MEASURES[name]
    return F.when(m[den] > 0, F.lit(1000) * m[num] / m[den]).otherwise(0).cast("long")


def _shift(v: Column) -> Column:
    """Low bits that a bucket leaves out."""
    return F.when(v < 64, 0).otherwise(F.greatest(F.lit(0), F.length(F.conv(v.cast("string"), 10, 2)) - 6)).cast("int")


def _bucket(v: Column) -> Column:
    """Index of the log-linear bucket of a non-negative integer."""
    return F.when(v < 64, v.cast("int")).otherwise(_shift(v) * 32 + F.floor(v / F.pow(F.lit(2), _shift(v))).cast("int"))


def _bucket_floor(b: Column) -> Column:
    shift = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b.cast("long")).otherwise(((b - shift * 32) * F.pow(F.lit(2), shift)).cast("long"))


def _width(v: Column) -> Column:
    """Width of the bucket in which v lies."""
    return F.pow(F.lit(2.0), _shift(v.cast("long")))


def sketches(rows: DataFrame, values: list[tuple[str, Column]], keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(keys, measure, bucket, n): mergeable sketches of integer values by keys."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), _bucket(v).alias("bucket")) for k, v in values])
    return rows.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def _merged(sketch: DataFrame, keys: list[str], above: DataFrame | None, prior: int, groups: DataFrame | None = None) -> DataFrame:
    """(keys, measure, bucket, w): sketches by keys, merged with those above, whose keys are among these; groups: those wanted, the sketch's own if none."""
    own = sketch.groupBy(*keys, "measure", "bucket").agg((F.sum("n") * SCALE).alias("w"))
    if above is None:
        return own
    held = [c for c in above.columns if c not in ("measure", "bucket", "w")]
    total = F.sum("w").over(Window.partitionBy(*held, "measure"))
    share = above.select(*[F.col(c).alias(f"p_{c}") for c in held], F.col("measure").alias("p_measure"), "bucket", (prior * F.floor(F.col("w") * F.lit(float(SCALE)) / total)).alias("w"))
    groups = (sketch if groups is None else groups).select(*keys, "measure").distinct()
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"p_{k}")), held, F.col("measure") == F.col("p_measure"))
    return own.unionByName(groups.join(share, same).select(*own.columns)).groupBy(*keys, "measure", "bucket").agg(F.sum("w").alias("w"))


def _levels(sketch: DataFrame, corpus: DataFrame, prior: int, groups: DataFrame) -> DataFrame:
    """Sketches of the groups, merged with their languages' and the corpus's."""
    return _merged(sketch, ["lang", "source"], _merged(sketch, ["lang"], corpus, prior, groups), prior, groups)


def _quantile(q: int, upto: str, total: str) -> Column:
    """Aggregate: the least bucket by which q hundredths of the weight are reached."""
    return F.min(F.when(F.col(upto) * 100 >= F.col(total) * q, _bucket_floor(F.col("bucket")))).cast("double")


def spread_fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(t_lang, t_source, t_word_len): mid, low and high of word length, and size, the median length in words, of each group."""
    by = Window.partitionBy("lang", "source", "measure")
    ranked = _levels(sketch, _merged(sketch, [], None, prior), prior, sketch).withColumn("upto", F.sum("w").over(by.orderBy("bucket"))).withColumn("total", F.sum("w").over(by))
    read = ranked.groupBy("lang", "source", "measure").agg(*[_quantile(q, "upto", "total").alias(f"q{q}") for q in (25, 50, 75)])
    of = lambda k, q: F.max(F.when(F.col("measure") == k, F.col(q)))
    wide = read.groupBy("lang", "source").agg(*[of("word_len", f"q{q}").alias(f"q{q}") for q in (25, 50, 75)], of("n_words", "q50").alias("size"))
    reach = FENCE * F.greatest(F.col("q75") - F.col("q25"), _width(F.col("q50")))
    fence = F.struct(F.col("q50").alias("mid"), (F.col("q25") - reach).alias("low"), (F.col("q75") + reach).alias("high"), F.greatest(F.lit(1.0), F.col("size")).alias("size"))
    return wide.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), fence.alias("t_word_len"))


def within_spread(m: Column, t: Column) -> Column:
    """Whether a text's word length lies within its group's fences."""
    v, wider = _value(m, "word_len"), F.sqrt(F.greatest(F.lit(1.0), t["size"] / F.greatest(m["n_words"], F.lit(1))))
    return (v <= t["mid"] + (t["high"] - t["mid"]) * wider) & (v >= t["mid"] + (t["low"] - t["mid"]) * wider)


def _sided(side: Column) -> Column:
    return F.concat(side, F.col("measure"))


def count_levels(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, measure, bucket, w): merged sketches of each count of documents inside (i) and outside (o) and of its values above 0 inside (t), a letter before the measure; sketch has a key inside.

    All three are merged in one go: each step that they share would be planned, dealt
    and compiled three times else.
    """
    sides = F.when(~F.col("inside"), F.array(F.lit("o"))).when(F.col("bucket") > 0, F.array(F.lit("i"), F.lit("t"))).otherwise(F.array(F.lit("i")))
    sided = sketch.withColumn("side", F.explode(sides)).select("lang", "source", _sided(F.col("side")).alias("measure"), "bucket", "n")
    groups = sketch.select("lang", "source", "measure").distinct().select("lang", "source", F.explode(F.array(*[_sided(F.lit(x)) for x in "iot"])).alias("measure"))
    own = _merged(sided, [], None, prior)
    first, rest = F.substring("measure", 1, 1), F.expr("substring(measure, 2)")
    core = own.where(first == "i")
    above = core.withColumn("w", prior * F.floor(F.col("w") * F.lit(float(SCALE)) / F.sum("w").over(Window.partitionBy("measure")))).withColumn("measure", F.concat(F.lit("o"), rest))
    # rows of literals: createDataFrame has executors start Python workers of a second kind, with a parent that stays
    zeros = F.array(*[F.struct(F.lit(f"t{k}").alias("measure"), F.lit(0).alias("bucket"), F.lit(ZEROS * SCALE).cast("long").alias("w")) for k in COUNTS])
    nothing = own.sparkSession.range(0, 1, 1, 1).select(F.explode(zeros).alias("z")).select("z.*")
    corpus = own.unionByName(above).unionByName(nothing).groupBy("measure", "bucket").agg(F.sum("w").alias("w"))
    return _levels(sided, corpus, prior, groups)


def count_fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(t_lang, t_source, t_symbols, ...): marks (values from it on are more frequent outside) and high of each count; sketch has a key inside."""
    keys = ["lang", "source", "measure"]
    levels = count_levels(sketch, prior).select("lang", "source", F.substring("measure", 1, 1).alias("side"), F.expr("substring(measure, 2)").alias("measure"), "bucket", "w")
    of = lambda side, kind: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("w").cast(kind))), F.lit(0).cast(kind)).alias(side)
    every = levels.groupBy(*keys, "bucket").agg(of("i", "double"), of("o", "double"), of("t", "long"))
    by = Window.partitionBy(*keys)
    down, real = by.orderBy(F.desc("bucket")), F.col("bucket") > 0
    ranked = every.withColumns({"all_i": F.sum("i").over(by), "all_o": F.sum("o").over(by), "total": F.sum("t").over(by), "from_i": F.sum("i").over(down), "from_o": F.sum("o").over(down), "upto": F.sum("t").over(by.orderBy("bucket"))})
    marks = real & (F.col("from_o") >= F.lit(SHARE) * F.col("all_o")) & (F.col("from_o") * F.col("all_i") >= F.lit(float(LIFT)) * F.col("from_i") * F.col("all_o"))
    read = ranked.groupBy(*keys).agg(F.min(F.when(marks, _bucket_floor(F.col("bucket")))).cast("double").alias("marks"), _quantile(25, "upto", "total").alias("q25"), _quantile(75, "upto", "total").alias("q75"))
    high = F.col("q75") + FENCE * F.greatest(F.col("q75") - F.col("q25"), _width(F.col("q75")))
    fence = F.struct("marks", high.alias("high"))
    wide = read.groupBy("lang", "source").agg(*[F.first(F.when(F.col("measure") == k, fence), ignorenulls=True).alias(f"t_{k}") for k in COUNTS])
    return wide.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"t_{k}" for k in COUNTS])


def within_counts(m: Column, t: dict[str, Column]) -> Column:
    """Whether no count reaches a fence of its group."""
    reached = [F.coalesce(_value(m, k) >= t[k]["marks"], F.lit(False)) | F.coalesce(_value(m, k) > t[k]["high"], F.lit(False)) for k in COUNTS]
    return ~reduce(lambda a, b: a | b, reached)


def _small(limits: DataFrame, what: str) -> DataFrame:
    limits, groups = cut_counted(limits, what)
    return F.broadcast(limits) if groups <= BROADCAST_GROUPS else limits


def _joined(rows: DataFrame, limits: DataFrame) -> DataFrame:
    same = rows["lang"].eqNullSafe(F.col("t_lang")) & rows["source"].eqNullSafe(F.col("t_source"))
    return rows.join(limits, same, "left").drop("t_lang", "t_source")


def thresholds(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row a (lang, source) with the fences of all measures; measured: (lang, source, m)."""
    rows = measured.where(~base_failed(F.col("m"))).select("lang", "source", "m")
    first = cut(sketches(rows, [("word_len", _value(F.col("m"), "word_len")), ("n_words", F.col("m")["n_words"])]), "sketches")
    spread = _small(spread_fences(first, prior), "thresholds")
    placed = _joined(rows, spread).withColumn("inside", F.coalesce(within_spread(F.col("m"), F.col("t_word_len")), F.lit(True)))
    second = cut(sketches(placed, [(k, _value(F.col("m"), k)) for k in COUNTS], ("lang", "source", "inside")), "sketches")
    counts = count_fences(second, prior)
    both = spread.join(counts.select(F.col("t_lang").alias("c_lang"), F.col("t_source").alias("c_source"), *[f"t_{k}" for k in COUNTS]), F.col("t_lang").eqNullSafe(F.col("c_lang")) & F.col("t_source").eqNullSafe(F.col("c_source")), "left").drop("c_lang", "c_source")
    out = _small(both, "thresholds")
    for used in (first, second, spread):
        drop_cut(used)
    return out


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured (with lang, source and m) with base_failed and kept, by join with the fences of each row's group."""
    joined, m = _joined(measured, limits), F.col("m")
    good = within_spread(m, F.col("t_word_len")) & within_counts(m, {k: F.col(f"t_{k}") for k in COUNTS})
    return joined.withColumns({"base_failed": base_failed(m), "kept": ~base_failed(m) & F.coalesce(good, F.lit(True))}).drop(*[f"t_{k}" for k in MEASURES])


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, columns as they were."""
    columns = docs.columns
    light = cut(docs.select(docs[lang].alias("lang"), docs[source].alias("source"), measures(docs, text).alias("m")), "measures")
    limits = thresholds(light)
    drop_cut(light)
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs[lang].alias("lang"), docs[source].alias("source"), measures(docs, text).alias("m"))
    return judge(whole, limits).where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = cut(docs.select("doc_id", "lang", "source", measures(docs).alias("m")), "measures")
    return judge(measured, thresholds(measured)).select("doc_id", *[F.col("m")[c].alias(c) for c in BASE], "base_failed", "kept")
