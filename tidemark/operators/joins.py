"""Joins over time: lag panels, as-of, forward windows, nearest followers, prescriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import over


def lag_panel(x: DataFrame, y: DataFrame, keys: list[str], max_lag: int, t: str = "t", v: str = "v") -> DataFrame:
    """(keys, t, h, x, y) with y = y_{t + h} for h = 0 .. max_lag, of the months for which all of these are present.

    One equi-join: each y is sent to the months that it can serve, not met by range.
    """
    ahead = y.select(*keys, F.col(t).alias("at"), F.col(v).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("h"))
    ahead = ahead.select(*keys, (F.col("at") - F.col("h")).alias(t), F.col("h").cast("int").alias("h"), "y")
    joined = x.select(*keys, t, F.col(v).alias("x")).join(ahead, [*keys, t])
    n = F.count("*").over(Window.partitionBy(*keys, t))
    return joined.withColumn("n", n).where(F.col("n") == max_lag + 1).drop("n")


def balanced_panel(df: DataFrame, series: str, max_lag: int, excluded: tuple[int, int] | None = None, t: str = "t") -> DataFrame:
    """Months t at which every series is present at every lag -max_lag .. max_lag, outside the excluded months."""
    wide = df.select(series).distinct().count()
    months = df.groupBy(t).agg(F.countDistinct(series).alias("n")).where(F.col("n") == wide).select(t)
    w = Window.orderBy(t).rangeBetween(-max_lag, max_lag)
    out = months.withColumn("n", F.count("*").over(w)).where(F.col("n") == 2 * max_lag + 1).select(t)
    return out.where(~F.col(t).between(*excluded)) if excluded else out


def asof(left: DataFrame, right: DataFrame, keys: list[str], t: str, v: str, exact: bool = True) -> DataFrame:
    """left with column v: right's value at the last time not later than (exact False: earlier than) left's.

    One shuffle: both sides in one column order, right's rows first on equal times, and the last value carried.
    Repeated times on the right: the greatest value.  Before the first: null.
    """
    names = left.columns
    one = right.groupBy(*keys, t).agg(F.max(v).alias("_v"))
    facts = one.select(*[F.col(k) for k in keys], F.col(t), "_v", F.lit(0 if exact else 2).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"_{c}") for c in names])
    asks = left.select(*[F.col(k) for k in keys], F.col(t), F.lit(None).cast(right.schema[v].dataType).alias("_v"), F.lit(1).alias("_side"), *[F.col(c).alias(f"_{c}") for c in names])
    w = over(keys, t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = facts.unionByName(asks).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*[F.col(f"_{c}").alias(c) for c in names], F.col("_last").alias(v))


def score_signals(signals: DataFrame, events: DataFrame, keys: list[str], width: int, end: int, t: str = "t") -> DataFrame:
    """(keys, t, outcome, event): TP with the first event in (t, t + width], else CENSORED if the window passes end, else FA."""
    e = events.select(*keys, F.col(t).alias("event"))
    joined = signals.select(*keys, t).join(e, keys, "left") if keys else signals.select(t).join(F.broadcast(e))
    first = joined.groupBy(*keys, t).agg(F.min(F.when((F.col("event") > F.col(t)) & (F.col("event") <= F.col(t) + width), F.col("event"))).alias("event"))
    outcome = F.when(F.col("event").isNotNull(), "TP").when(F.col(t) + width > end, "CENSORED").otherwise("FA")
    return first.withColumn("outcome", outcome)


def missed_events(signals: DataFrame, events: DataFrame, keys: list[str], width: int, start: int, end: int, t: str = "t") -> DataFrame:
    """Events in start .. end without a signal in the width months before them; those whose window begins before start are left out."""
    s = signals.select(*keys, F.explode(F.sequence(F.col(t) + 1, F.col(t) + width)).alias(t)).distinct()
    return events.where(F.col(t).between(start + width, end)).join(s, [*keys, t], "left_anti")


def nearest_followers(leads: DataFrame, follows: DataFrame, keys: list[str], low: int, high: int, t: str = "t") -> DataFrame:
    """(keys, lead, follow, lag): each lead's nearest follower at lag low .. high; of leads that share one, the nearest keeps it."""
    lead = leads.select(*keys, F.col(t).alias("lead"))
    reach = follows.select(*keys, F.col(t).alias("follow"))
    found = lead.join(reach, keys).where((F.col("follow") - F.col("lead")).between(low, high))
    best = found.groupBy(*keys, "lead").agg(F.min("follow").alias("follow")).withColumn("lag", F.col("follow") - F.col("lead"))
    rank = F.row_number().over(Window.partitionBy(*keys, "follow").orderBy("lag", "lead"))
    return best.withColumn("rank", rank).where("rank = 1").drop("rank")


def match_events(a: DataFrame, b: DataFrame, keys: list[str], within: int, t: str = "t") -> DataFrame:
    """One-to-one pairs of two event lists by increasing distance, greedily, at most within apart; per key, by a fold."""
    pairs = a.select(*keys, F.col(t).alias("a")).join(b.select(*keys, F.col(t).alias("b")), keys).withColumn("d", F.abs(F.col("a") - F.col("b"))).where(F.col("d") <= within)
    lists = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "a", "b"))).alias("p"))
    used = lambda acc, x: F.exists(acc, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
    kind = "array<struct<d:bigint,a:bigint,b:bigint>>"
    picked = F.aggregate(F.col("p").cast(kind), F.array().cast(kind), lambda acc, x: F.when(used(acc, x), acc).otherwise(F.array_append(acc, x)))
    return lists.select(*keys, F.explode(picked).alias("x")).select(*keys, "x.a", "x.b", "x.d")


def forward_return(df: DataFrame, keys: list[str], horizon: int, t: str = "t", v: str = "v", keep: bool = False) -> DataFrame:
    """v_{t + horizon} / v_t - 1 where both months are present; exact zeros are left out.  keep: all rows of df, zeros too, null without both prices."""
    later = df.select(*keys, (F.col(t) - horizon).alias(t), F.col(v).alias("later"))
    if keep:
        return df.join(later, [*keys, t], "left").withColumn("ret", F.col("later") / F.nullif(F.col(v), F.lit(0.0)) - 1).select(*keys, t, "ret")
    out = df.join(later, [*keys, t]).where(F.col(v) != 0).withColumn("ret", F.col("later") / F.col(v) - 1).where("ret <> 0")
    return out.select(*keys, t, "ret")


def prescription_hits(moves: DataFrame, wanted: DataFrame, pair: str, state: str, move: str) -> DataFrame:
    """(pair, n, hits, unmatched, zeros, missing): how often a move has the sign that its pair and state prescribe; n counts moves other than zero with a prescription, the rest is counted apart: moves without one, zeros and nulls among those with one."""
    joined = moves.join(F.broadcast(wanted.select(F.col(pair), F.col(state), F.col("sign").alias("_sign"))), [pair, state], "left")
    named, m = F.col("_sign").isNotNull(), F.col(move)
    count = lambda c: F.count(F.when(c, 1))
    counts = {"n": named & (m != 0), "hits": named & (m != 0) & (F.signum(m) == F.col("_sign")), "unmatched": ~named, "zeros": named & (m == 0), "missing": named & m.isNull()}
    return joined.groupBy(pair).agg(*[count(c).alias(k) for k, c in counts.items()])


def lead_pairs(panel: DataFrame, series: str, max_lag: int, t: str = "t", v: str = "v") -> DataFrame:
    """(a, b, h, r): correlation of series a at t with series b at t + h, for a < b and |h| <= max_lag."""
    from .stats import correlation

    a = panel.select(F.col(series).alias("a"), t, F.col(v).alias("x"))
    b = panel.select(F.col(series).alias("b"), F.col(t).alias("at"), F.col(v).alias("y"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("h")).withColumn(t, F.col("at") - F.col("h"))
    joined = a.join(b.drop("at"), t).where("a < b")
    return joined.groupBy("a", "b", "h").agg(correlation("x", "y").alias("r"))


def greedy_spacing(df: DataFrame, keys: list[str], gap: int, t: str = "t") -> DataFrame:
    """Times at least gap apart, taken greedily from the first; per key, by a fold over its times."""
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(t)).alias("ts"))
    far = lambda a, x: (F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= gap)
    kept = F.aggregate("ts", F.array().cast("array<bigint>"), lambda a, x: F.when(far(a, x), F.array_append(a, x.cast("bigint"))).otherwise(a))
    return lists.select(*keys, F.explode(kept).alias(t))


def merged_target(points: DataFrame, ranges: DataFrame, t: str = "t") -> DataFrame:
    """(t, v): a point series, overridden by the middle of a range (lower, upper) on equal dates."""
    both = points.select(t, F.col("v").alias("p")).join(ranges.select(t, ((F.col("lower") + F.col("upper")) / 2).alias("mid")), t, "full")
    return both.select(t, F.coalesce("mid", "p").alias("v"))


def deflated(nominal: DataFrame, index: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """v of nominal over v of index on common months; a zero index gives null."""
    return nominal.join(index.select(t, F.col("v").alias("i")), t).select(*keys, t, (F.col("v") / F.nullif(F.col("i"), F.lit(0.0))).alias("v"))


def aligned_routes(a: DataFrame, b: DataFrame, t: str = "t") -> DataFrame:
    """(t, a, b) of two routes over their common span; dates in only one of them are an error."""
    span = a.agg(F.min(t).alias("a0"), F.max(t).alias("a1")).join(b.agg(F.min(t).alias("b0"), F.max(t).alias("b1")))
    span = span.select(F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))  # one row
    inside = lambda df, name: df.join(F.broadcast(span), F.col(t).between(F.col("lo"), F.col("hi"))).select(t, F.col("v").alias(name))
    both = inside(a, "a").join(inside(b, "b"), t, "full")
    gap = F.col("a").isNull() | F.col("b").isNull()
    return both.select(t, F.when(gap, F.raise_error(F.lit("the routes differ in dates")).cast("double")).otherwise(F.col("a")).alias("a"), "b")
