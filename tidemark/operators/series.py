"""Operators over long series: frames with keys, a time column and a value column.

Unless said otherwise keys is the list of key columns (may be empty), t the time
column (a month index or a date) and v the value column.  Null values are left out
by observed(), which each operator expects to have been applied.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(keys: list[str], *order: str | Column) -> WindowSpec:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return w.orderBy(*order) if order else w


def observed(df: DataFrame, v: str = "v") -> DataFrame:
    return df.where(F.col(v).isNotNull())


def between(df: DataFrame, t: str, low, high) -> DataFrame:
    return df.where(F.col(t).between(low, high))


def bounds(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """First and last observed point of each series."""
    return observed(df, v).groupBy(*keys).agg(F.min(t).alias("first_t"), F.min_by(v, t).alias("first_v"), F.max(t).alias("last_t"), F.max_by(v, t).alias("last_v"))


def resample(df: DataFrame, keys: list[str], bucket: Column, at: str, v: str) -> DataFrame:
    """Mean, last value, day count and any-negative flag of each bucket (t)."""
    rows = df.withColumn("t", bucket)
    return rows.groupBy(*keys, "t").agg(F.avg(v).alias("mean"), F.max_by(v, at).alias("last"), F.countDistinct(F.to_date(at)).alias("days"), F.max(F.col(v) < 0).alias("any_negative"))


def quarter_mean(df: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """Quarterly means of a monthly series, of whole quarters only."""
    return df.groupBy(*keys, F.floor(F.col(t) / 3).cast("bigint").alias("q")).agg(F.avg(v).alias("v"), F.count(v).alias("n")).where("n = 3").drop("n")


def log_change(df: DataFrame, keys: list[str], lag: int, t: str = "t", v: str = "v") -> DataFrame:
    """100 ln(v_t / v_{t - lag}) by calendar: both months must be present and positive."""
    earlier = df.select(*keys, (F.col(t) + lag).alias(t), F.col(v).alias("earlier"))
    joined = df.join(earlier, [*keys, t]).where((F.col(v) > 0) & (F.col("earlier") > 0))
    return joined.withColumn("change", 100 * F.log(F.col(v) / F.col("earlier"))).drop("earlier")


def positional_change(df: DataFrame, keys: list[str], lag: int, t: str = "t", v: str = "v") -> DataFrame:
    """v minus the value lag rows before, whatever the calendar."""
    return df.withColumn("change", F.col(v) - F.lag(v, lag).over(over(keys, t)))


def trailing_mean(df: DataFrame, keys: list[str], k: int, t: str = "t", v: str = "v") -> DataFrame:
    """Mean over the last k months, null unless all are present."""
    w = over(keys, t).rangeBetween(-(k - 1), 0)
    return df.withColumn("mean", F.when(F.count(v).over(w) == k, F.avg(v).over(w)))


def centred_mean(df: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """Mean of a month and its two neighbours, null unless both are present."""
    w = over(keys, t).rangeBetween(-1, 1)
    return df.withColumn("smooth", F.when(F.count(v).over(w) == 3, F.avg(v).over(w)))


def median_of_sorted(a: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def sliding(df: DataFrame, keys: list[str], day: str, v: str, days: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], stretch: int | None = None) -> DataFrame:
    """(keys, day, out): of(values, first, last) of the observed values of the last ``days`` days up to each day, whose places are first .. last - 1.

    A series is cut into stretches of days, and the days before a stretch that its
    windows reach into go along with it, so a long series has many tasks and none
    holds more than a stretch and a window.  Days are whole numbers.
    """
    stretch = stretch or 4 * max(days, 1)
    kinds = dict(df.dtypes)
    place = lambda c: F.floor(c / stretch).cast("long")
    rows = df.select(*keys, F.col(day).cast("long").alias("_day"), F.col(v).cast("double").alias("_v"))
    rows = rows.where("_day is not null").withColumn("_stretch", F.explode(F.sequence(place(F.col("_day")), place(F.col("_day") + days))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        at, value = part["_day"].to_numpy(), part["_v"].to_numpy(dtype=float)
        own = np.unique(at[at // stretch == part["_stretch"].iloc[0]])
        order = np.argsort(at, kind="stable")
        order = order[~np.isnan(value[order])]
        at, value = at[order], value[order]
        out = pd.DataFrame({day: own, "out": of(value, np.searchsorted(at, own - days, "left"), np.searchsorted(at, own, "right"))})
        for i, k in enumerate(keys):
            out.insert(i, k, part[k].iloc[0])
        return out

    return rows.groupBy(*keys, "_stretch").applyInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + f"{day} long, out double").withColumn(day, F.col(day).cast(kinds[day]))


def rolling_mad(df: DataFrame, keys: list[str], day: str, v: str, days: int, at_least: int) -> DataFrame:
    """Column mad: median absolute deviation over the last ``days`` calendar days, null below at_least points or at zero scale."""

    def of(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.full(len(first), np.nan)
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            if b - a >= max(at_least, 1):
                held = x[a:b]
                out[i] = np.median(np.abs(held - np.median(held)))
        return out

    found = sliding(df, keys, day, v, days, of).select(*keys, day, F.when(~F.isnan("out") & (F.col("out") != 0), F.col("out")).alias("mad"))
    return df.join(found, [*keys, day], "left")


def trailing_quantile(df: DataFrame, keys: list[str], day: str, v: str, days: int, q: float, at_least: int) -> DataFrame:
    """(keys, day, out): linear quantile of the values of the last ``days`` days, by a sorted window that slides; null below at_least of them."""

    def of(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out, held, a, b = np.full(len(first), np.nan), [], 0, 0
        for i in range(len(first)):
            for y in x[b : last[i]].tolist():
                insort(held, y)
            for y in x[a : first[i]].tolist():
                del held[bisect_left(held, y)]
            a, b = first[i], last[i]
            if len(held) >= max(at_least, 1):
                at = (len(held) - 1) * q
                low = int(at)
                out[i] = held[low] + (held[min(low + 1, len(held) - 1)] - held[low]) * (at - low)
        return out

    return sliding(df, keys, day, v, days, of).withColumn("out", F.when(~F.isnan("out"), F.col("out")))


def policy_phase(df: DataFrame, keys: list[str], day: str, v: str, back: int = 183, days: int = 3653, q: float = 0.4, at_least: int = 60) -> DataFrame:
    """(keys, day, phase): -1 where v is above what was known ``back`` days before, 1 where it is below; where they are equal, 1 if it is at most the quantile q of the last ``days`` days, else -1, null with fewer than at_least of these; null without a value back then.

    One row a day; a day's value holds until the next.
    """
    rows = df.where(F.col(v).isNotNull()).select(*keys, day, v)
    w = over(keys, F.col("_at"), F.col("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.select(*keys, F.col(day).alias("_at"), F.lit(0).alias("_asks"), F.col(v).alias("_known"), F.lit(None).cast(dict(df.dtypes)[day]).alias(day), F.lit(None).cast("double").alias(v)).unionByName(rows.select(*keys, (F.col(day) - back).cast(dict(df.dtypes)[day]).alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("_known"), day, F.col(v).cast("double").alias(v)))
    asked = both.withColumn("before", F.last("_known", ignorenulls=True).over(w)).where("_asks = 1")
    tie = asked.join(trailing_quantile(rows, keys, day, v, days, q, at_least), [*keys, day], "left")
    change = F.when(F.col(v) > F.col("before"), -1.0).when(F.col(v) < F.col("before"), 1.0).when(F.col("before").isNull() | F.col("out").isNull(), None)
    return tie.select(*keys, day, change.when(F.col(v) <= F.col("out"), 1.0).otherwise(-1.0).alias("phase"))


def extrema(df: DataFrame, keys: list[str], half: int, t: str = "t", v: str = "v", kind: str = "max") -> DataFrame:
    """Local maxima (kind "min": minima) among the months present in t - half .. t + half, half + 2 of them at least, not all alike; of a plateau, the first, then none within half."""
    w = over(keys, t).rangeBetween(-half, half)
    x = F.col(v) if kind == "max" else -F.col(v)
    found = df.where(F.col(v).isNotNull()).withColumns({"top": F.max(x).over(w), "low": F.min(x).over(w), "n": F.count(v).over(w)}).where((x == F.col("top")) & (x > F.col("low")) & (F.col("n") >= half + 2))
    # a greedy pass in time order; a key's extrema are few
    times = found.groupBy(*keys).agg(F.array_sort(F.collect_list(t)).alias("ts"))
    kept = F.aggregate("ts", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > half), F.array_append(a, x)).otherwise(a))
    return times.select(*keys, F.explode(kept).alias(t))


def islands(df: DataFrame, keys: list[str], gap: int, t: str = "t") -> DataFrame:
    """Episodes: points at most gap missing months apart."""
    before = F.lag(t).over(over(keys, t))
    marked = df.withColumn("new", F.coalesce((F.col(t) - before - 1 > gap).cast("int"), F.lit(1)))
    numbered = marked.withColumn("episode", F.sum("new").over(over(keys, t)))
    return numbered.groupBy(*keys, "episode").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def spells(df: DataFrame, keys: list[str], day: str, state: str) -> DataFrame:
    """Runs of one state with lengths in calendar days; the last run ends a day after its last date."""
    w = over(keys, day)
    marked = df.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int")))
    runs = marked.withColumn("run", F.sum("new").over(w)).groupBy(*keys, "run").agg(F.min(day).alias("start"), F.max(day).alias("last"), F.first(state).alias(state))
    end = F.coalesce(F.lead("start").over(over(keys, "start")), F.date_add("last", 1))
    return runs.withColumn("days", F.datediff(end, "start")).drop("last")


def run_starts(df: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """First month of each run of two or more falls in a row."""
    w = over(keys, t)
    step = lambda k: F.lag(v, k).over(w)
    near = F.col(t) - F.lag(t, 2).over(w) == 2
    now = F.coalesce(near & (F.col(v) < step(1)) & (step(1) < step(2)), F.lit(False))
    return df.withColumn("two", now).withColumn("before", F.coalesce(F.lag("two").over(w), F.lit(False))).where("two and not before").select(*keys, F.col(t))


def largest_drawdown(df: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """The peak p and trough q > p of greatest fall, the first on ties."""
    so_far = over(keys, t).rowsBetween(Window.unboundedPreceding, -1)
    peak = F.max(F.struct(F.col(v).alias("v"), (-F.col(t)).alias("nt"))).over(so_far)
    falls = df.withColumn("peak", peak).where("peak is not null").withColumn("fall", F.col("peak.v") - F.col(v))
    best = F.max(F.struct("fall", (-F.col(t)).alias("nq"), F.col("peak.nt").alias("np")))
    return falls.groupBy(*keys).agg(best.alias("b")).where("b is not null").select(*keys, (-F.col("b.np")).alias("peak_t"), (-F.col("b.nq")).alias("trough_t"), F.col("b.fall").alias("fall"))


def average_rank(v: str | Column, keys: list[str]) -> Column:
    """Rank from 1, ties sharing their mean."""
    col = F.col(v) if isinstance(v, str) else v
    ties = Window.partitionBy(*keys, col) if keys else Window.partitionBy(col)
    return F.rank().over(over(keys, col)) + (F.count("*").over(ties) - 1) / 2


def rolling_volatility(df: DataFrame, keys: list[str], rows: int, t: str = "t", r: str = "r") -> DataFrame:
    """Annualised sample volatility of the last rows monthly log returns, in percent."""
    w = over(keys, t).rowsBetween(-(rows - 1), 0)
    return df.withColumn("vol", F.when(F.count(r).over(w) == rows, F.sqrt(F.lit(12.0)) * F.stddev_samp(r).over(w) * 100))


def hysteresis(df: DataFrame, keys: list[str], t: str, x: str, high: Column | float, low: Column | float) -> DataFrame:
    """Column state in -1, 0, 1 with memory: entered at |x| >= high, left at |x| < low; a null x has a null state and keeps the memory.

    Two latches: one set at x >= high and reset at x < low, one mirrored; state is their difference.
    """
    hi, lo = (c if isinstance(c, Column) else F.lit(c) for c in (high, low))
    w = over(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    up = F.when(F.col(x) >= hi, 1).when(F.col(x) < lo, 0)
    down = F.when(F.col(x) <= -hi, 1).when(F.col(x) > -lo, 0)
    latch = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0))
    return df.withColumn("state", F.when(F.col(x).isNotNull(), (latch(up) - latch(down)).cast("int")))


def reversal_delays(df: DataFrame, keys: list[str], day: str, base: str, test: str) -> DataFrame:
    """(keys, start, sign, last_delay, first_delay): by how many days test gives up a sign later than base, for each reversal of base.

    An episode is a run of base of one sign, null and 0 left out; each but a key's last
    ends in a reversal.  last_delay counts from the day after base last holds the sign to
    the day after test last holds it before the reversal; first_delay from the first day
    within the episode, after its start, on which base doesn't hold it to the first on
    which test doesn't, the day of the reversal standing for none.
    """
    w = over(keys, day)
    signed = F.when(F.col(base) != 0, F.col(base))
    before = F.last(signed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumns({"new": F.when(signed.isNotNull() & ~signed.eqNullSafe(before), 1).otherwise(0), "next_day": F.lead(day).over(w), "i": F.row_number().over(w)})
    rows = rows.withColumn("episode", F.sum("new").over(w)).where("episode > 0")
    own = Window.partitionBy(*keys, "episode").orderBy("i")
    rows = rows.withColumn("sign", F.first(base).over(own)).withColumn("later", F.row_number().over(own) > 1)
    holds, tests = F.col(base).eqNullSafe(F.col("sign")), F.col(test).eqNullSafe(F.col("sign"))
    after = lambda c: F.max(F.when(c, F.struct("i", "next_day")))["next_day"]
    lost = lambda c: F.min(F.when(F.col("later") & ~c, F.col(day)))
    out = rows.groupBy(*keys, "episode").agg(F.min(day).alias("start"), F.first("sign").alias("sign"), after(holds).alias("b"), after(holds | tests).alias("t"), lost(holds).alias("lb"), lost(tests).alias("lt"), after(F.lit(True)).alias("turn")).where("turn is not null")
    return out.select(*keys, "start", "sign", F.datediff("t", "b").alias("last_delay"), F.datediff(F.coalesce("lt", "turn"), F.coalesce("lb", "turn")).alias("first_delay"))


def splice(longer: DataFrame, shorter: DataFrame, t: str = "t", v: str = "v") -> DataFrame:
    """shorter, led by longer moved by the mean difference on their common months."""
    b = shorter.select(F.col(t), F.col(v).alias("b"))
    offset = longer.join(b, t).agg(F.avg(F.col("b") - F.col(v)).alias("offset"))  # one row
    moved = longer.join(F.broadcast(offset)).select(F.col(t), (F.col(v) + F.col("offset")).alias(v))
    return moved.join(shorter.select(t), t, "left_anti").unionByName(shorter.select(t, v))


def longest_run(df: DataFrame, keys: list[str], flag: Column, t: str = "t") -> DataFrame:
    """Longest run of rows, in order of t, for which flag holds; the first on ties."""
    numbered = df.withColumn("i", F.row_number().over(over(keys, t))).where(flag)
    grouped = numbered.withColumn("g", F.col("i") - F.row_number().over(over(keys, t))).groupBy(*keys, "g").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("end"))
    rank = F.row_number().over(over(keys, F.desc("n"), F.asc("start")))
    return grouped.withColumn("rank", rank).where("rank = 1").drop("rank", "g")
