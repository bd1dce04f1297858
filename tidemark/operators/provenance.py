"""What each value was made from: sets of source periods carried through windows, and audits of them.

A set of periods is carried as its number, ends and digest (exclusive or of hashes), so
sets merge as windows slide and can be asked for exact equality, not for their ends
alone.  The audit sees what a value carries.  A constant taken from the whole sample
carries nothing; leaks of that kind pass it, and only a comparison of scores shows them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import over


def digest_of_range(low: Column, high: Column) -> Column:
    """Digest of the periods low .. high; 0 if there are none."""
    every = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.xxhash64(x)))


def sources_over(df: DataFrame, keys: list[str], i: str, name: str, low: int, high: int, there: Column | None = None, known: Column | None = None) -> DataFrame:
    """df with the set name of the periods i within low .. high of each row's for which there holds, and name_known, the greatest of known among them (i if not given)."""
    w = over(keys, i).rangeBetween(low, high)
    at = F.col(i) if there is None else F.when(there, F.col(i))
    last = F.col(i) if known is None else known
    last = last if there is None else F.when(there, last)
    return df.withColumns({f"{name}_n": F.count(at).over(w), f"{name}_min": F.min(at).over(w), f"{name}_max": F.max(at).over(w), f"{name}_digest": F.coalesce(F.bit_xor(F.when(at.isNotNull(), F.xxhash64(at.cast("long")))).over(w), F.lit(0)), f"{name}_known": F.max(last).over(w)})


def is_range(name: str, low: Column, high: Column) -> Column:
    """Whether a carried set is exactly low .. high."""
    size = F.greatest(high - low + 1, F.lit(0))
    ends = F.when(size == 0, F.lit(True)).otherwise((F.col(f"{name}_min") == low) & (F.col(f"{name}_max") == high))
    return (F.col(f"{name}_n") == size) & ends & (F.col(f"{name}_digest") == digest_of_range(low.cast("long"), high.cast("long")))


@dataclass(frozen=True)
class Leak:
    """A way of looking ahead: months by which the ensemble reaches beyond the origin, whole-sample constants, volatility of the future."""

    name: str
    offset: int = 0
    whole_reference: bool = False
    whole_centre: bool = False
    future: bool = False


def leaks(horizon: int) -> list[Leak]:
    """None, and the five usual ones."""
    return [Leak("L0"), Leak("L1", offset=1), Leak("L2", offset=horizon - 1), Leak("L3", whole_reference=True), Leak("L4", whole_centre=True), Leak("L5", future=True)]


def measured(df: DataFrame, keys: list[str], t: str, v: str, horizon: int, window: int) -> DataFrame:
    """(keys, t, i, annual, vol): place of each month from 0, log change over horizon places, volatility of the last window changes; both in per cent."""
    w = over(keys, t)
    rows = df.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "step": F.log(F.col(v) / F.lag(v).over(w)), "annual": 100 * F.log(F.col(v) / F.lag(v, horizon).over(w))})
    near = w.rowsBetween(-(window - 1), 0)
    vol = F.when(F.count("step").over(near) == window, F.sqrt(F.lit(12.0)) * F.stddev_samp("step").over(near) * 100)
    return rows.withColumn("vol", vol).select(*keys, t, "i", "annual", "vol")


def information_set(points: DataFrame, keys: list[str], horizon: int, window: int, leak: Leak) -> DataFrame:
    """points with what the forecast of each origin i is made of under a leak: sets of the ensemble, of the recent and of the reference volatilities, and when the outcome is known."""
    there = F.col("annual").isNotNull()
    df = sources_over(points, keys, "i", "ensemble", -(2**31), leak.offset, there)
    shift = horizon if leak.future else 0
    df = sources_over(df, keys, "i", "recent", shift - window + 1, shift)
    df = sources_over(df, keys, "i", "reference", -(2**31), 0, F.col("vol").isNotNull())
    return sources_over(df, keys, "i", "outcome", horizon, horizon, there)


def audit(sets: DataFrame, horizon: int, window: int) -> DataFrame:
    """sets with failed, the checks that an origin fails, in order; a forecast without a look ahead fails none.

    The ensemble has to hold exactly the annual changes known from horizon to the
    origin, recent volatility exactly the last window months, reference volatility
    those from window to the origin, and the outcome is known horizon months later.
    """
    i = F.col("i")
    checks = {
        "ensemble": is_range("ensemble", F.lit(horizon).cast("long"), i),
        "ensemble sources": F.coalesce(F.col("ensemble_known") <= i, F.lit(True)),
        "recent": is_range("recent", i - window + 1, i),
        "recent sources": F.coalesce(F.col("recent_known") <= i, F.lit(True)),
        "reference": is_range("reference", F.lit(window).cast("long"), i),
        "outcome": is_range("outcome", i + horizon, i + horizon),
    }
    return sets.withColumn("failed", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()])))


def _crps(x: str, y: str) -> Column:
    """Aggregate of ranked rows (x, its rank r from 1, number n, outcome y): mean |x - y| less half the mean distance of two members."""
    return F.avg(F.abs(F.col(x) - F.col(y))) - F.sum((2 * F.col("r") - F.col("n") - 1) * F.col(x)) / F.first("n") / F.first("n")


def leaked_scores(points: DataFrame, keys: list[str], horizon: int, window: int, leak: Leak) -> DataFrame:
    """(keys, i, base, price): scores of the ensemble of annual changes and of the same scaled by recent over reference volatility, for origins with an outcome and both volatilities.

    A series has a row a month, so its pairs of months are bounded by the calendar.
    """
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    at = over(keys, "i")
    recent = F.lead("vol", horizon).over(at) if leak.future else F.col("vol")
    reference = F.avg("vol").over(own) if leak.whole_reference else F.avg("vol").over(at.rowsBetween(Window.unboundedPreceding, 0))
    origins = points.withColumns({"y": F.lead("annual", horizon).over(at), "scale": recent / reference, "whole": F.avg("annual").over(own)}).where("y is not null and scale is not null")
    members = points.where("annual is not null").select(*keys, F.col("i").alias("j"), F.col("annual").alias("x"))
    pairs = origins.select(*keys, "i", "y", "scale", "whole").join(members, keys) if keys else origins.select("i", "y", "scale", "whole").crossJoin(members)
    each = Window.partitionBy(*keys, "i")
    pairs = pairs.where(F.col("j") <= F.col("i") + leak.offset).withColumns({"r": F.row_number().over(each.orderBy("x", "j")), "n": F.count("*").over(each), "mean": F.avg("x").over(each)})
    centre = F.col("whole") if leak.whole_centre else F.col("mean")
    pairs = pairs.withColumns({"b": F.col("x") + centre - F.col("mean"), "p": centre + F.col("scale") * (F.col("x") - centre)})
    return pairs.groupBy(*keys, "i").agg(_crps("b", "y").alias("base"), _crps("p", "y").alias("price"))


def leak_report(points: DataFrame, keys: list[str], horizon: int, window: int, least: int) -> DataFrame:
    """(keys, leak, origins, caught, first_origin, failed, base_gain, delta) for no leak and five: how many origins, from place least on, the audit catches, the first of them and what it fails there; by how much the leak improves the ensemble's score, and what scaling gains under it."""
    honest = leaked_scores(points, keys, horizon, window, Leak("L0")).where(F.col("i") >= least).select(*keys, "i", F.col("base").alias("honest"))
    out = None
    for leak in leaks(horizon):
        seen = audit(information_set(points, keys, horizon, window, leak), horizon, window).select(*keys, "i", "failed")
        scores = leaked_scores(points, keys, horizon, window, leak).join(honest, [*keys, "i"]).join(seen, [*keys, "i"])
        bad = F.size("failed") > 0
        one = scores.groupBy(*keys).agg(F.count("*").alias("origins"), F.sum(bad.cast("long")).alias("caught"), F.min(F.when(bad, F.col("i"))).alias("first_origin"), F.min_by(F.array_join("failed", ","), F.when(bad, F.col("i"))).alias("failed"), F.avg(F.col("honest") - F.col("base")).alias("base_gain"), F.avg(F.col("base") - F.col("price")).alias("delta"))
        one = one.withColumn("leak", F.lit(leak.name))
        out = one if out is None else out.unionByName(one)
    return out
