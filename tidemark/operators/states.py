"""Classifiers, composites and configuration grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import over


def mode(df: DataFrame, keys: list[str], v: str, tie_order: list[str]) -> DataFrame:
    """Most frequent value, ties by a declared order."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in tie_order]), F.col(v)).cast("int"), F.lit(0))
    counted = df.groupBy(*keys, v).agg(F.count("*").alias("n")).withColumn("place", F.when(place == 0, len(tie_order) + 1).otherwise(place))
    rank = F.row_number().over(over(keys, F.desc("n"), F.asc("place"), F.asc(v)))
    return counted.withColumn("rank", rank).where("rank = 1").select(*keys, v)


def distribution(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Count and share of each state."""
    counted = df.groupBy(*keys, state).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))))


def axis(parts: DataFrame, keys: list[str], part: str, c: str, weights: DataFrame, cutoff: float = 0.6, full: float = 1.0) -> DataFrame:
    """Weighted mean of the parts present, null where their weight is under cutoff of the full weight."""
    rows = parts.where(F.col(c).isNotNull()).join(F.broadcast(weights), part)
    share = F.sum("weight") / full
    return rows.groupBy(*keys).agg(share.alias("share"), F.when(share >= cutoff, F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias("score"))


#: Names of the sign pairs (a positive, b positive).
QUADRANTS = {(True, False): "I", (True, True): "II", (False, False): "III", (False, True): "IV"}


def quadrant(a: Column, b: Column, theta_a: Column | float, theta_b: Column | float, shape: Column | None = None, both: bool = False, names: dict = QUADRANTS) -> Column:
    """State of two scores: ANOMALY without both, CENTER where either is small (both: where both are), else named by their signs.

    shape: a reading that must agree with the name; where it is null or another, the state is CENTER.
    """
    small_a, small_b = F.abs(a) < theta_a, F.abs(b) < theta_b
    named = F.when(a > 0, F.when(b > 0, names[True, True]).otherwise(names[True, False])).otherwise(F.when(b > 0, names[False, True]).otherwise(names[False, False]))
    out = F.when(a.isNull() | b.isNull(), "ANOMALY").when(small_a & small_b if both else small_a | small_b, "CENTER")
    return (out.when(~shape.eqNullSafe(named), "CENTER") if shape is not None else out).otherwise(named)


def curve_shape(short: Column, long: Column, parallel: float, twist: bool = False) -> Column:
    """Shape of a curve's move: PARALLEL under a tolerance, where twist is asked for TWIST if its ends move apart, else falling and flatter I, falling and steeper II, rising and flatter III, rising and steeper IV; null without both."""
    rising, flatter = (short + long) / 2 > 0, long < short
    named = F.when(~rising & flatter, "I").when(~rising & (long > short), "II").when(rising & flatter, "III").otherwise("IV")
    out = F.when(short.isNull() | long.isNull(), None).when(F.abs(long - short) < parallel, "PARALLEL")
    return (out.when(short * long < 0, "TWIST") if twist else out).otherwise(named)


def theta_grid(scores: DataFrame, a: str, b: str, qs: list[float], target: float) -> DataFrame:
    """(q, theta_a, theta_b, centre_share, chosen) for thresholds at quantiles q of |score|; chosen: nearest to the target share, least q on ties."""
    at = [F.percentile(F.abs(c), F.array(*[F.lit(x) for x in qs])) for c in (a, b)]
    limits = scores.agg(at[0].alias("ta"), at[1].alias("tb")).select(F.posexplode(F.arrays_zip("ta", "tb")).alias("i", "z")).select(F.get(F.array(*[F.lit(x) for x in qs]), F.col("i")).alias("q"), F.col("z.ta").alias("theta_a"), F.col("z.tb").alias("theta_b"))
    state = quadrant(F.col(a), F.col(b), F.col("theta_a"), F.col("theta_b"))
    cells = scores.join(F.broadcast(limits)).groupBy("q", "theta_a", "theta_b").agg(F.avg(F.when(state == "CENTER", 1.0).otherwise(0.0)).alias("centre_share"))
    rank = F.row_number().over(Window.orderBy(F.abs(F.col("centre_share") - target), "q"))
    return cells.withColumn("chosen", rank == 1)


def coherence(df: DataFrame, a: str, b: str, names: tuple[str, ...] = tuple(QUADRANTS.values())) -> DataFrame:
    """(n, observed, expected, lift): share of the rows with two named states on which they agree, against independence; null without such rows."""
    both = df.where(F.col(a).isin(*names) & F.col(b).isin(*names))
    n = both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    pa = both.groupBy(F.col(a).alias("s")).agg(F.count("*").alias("na"))
    pb = both.groupBy(F.col(b).alias("s")).agg(F.count("*").alias("nb"))
    product = pa.join(pb, "s").agg(F.sum(F.col("na") * F.col("nb")).alias("p"))
    out = n.join(F.broadcast(product)).withColumn("expected", F.when(F.col("n") > 0, F.coalesce("p", F.lit(0)) / (F.col("n") * F.col("n"))))
    return out.select("n", "observed", "expected", (F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0))).alias("lift"))


def standardised(df: DataFrame, panel: str, low: int, high: int, at_least: int = 24, t: str = "t", v: str = "v") -> DataFrame:
    """Column z: v by its panel's mean and sample deviation over the reference months; panels with too few of these go."""
    base = df.where(F.col(t).between(low, high)).groupBy(panel).agg(F.avg(v).alias("mu"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))
    return df.join(base.where((F.col("n") >= at_least) & (F.col("sd") > 0)).drop("n"), panel).withColumn("z", (F.col(v) - F.col("mu")) / F.col("sd")).drop("mu", "sd")


def composite_balanced(z: DataFrame, panel: str, t: str = "t") -> DataFrame:
    """Mean over panels of the months that all panels have."""
    k = z.select(panel).distinct().agg(F.count("*").alias("k"))
    by = z.groupBy(t).agg(F.avg("z").alias("c"), F.countDistinct(panel).alias("n"))
    return by.join(F.broadcast(k)).where("n = k").select(t, "c")


def composite_chain(z: DataFrame, panel: str, t: str = "t") -> DataFrame:
    """Chain-linked composite: increments are means over the panels present in both months, from 0."""
    before = z.select(panel, (F.col(t) + 1).alias(t), F.col("z").alias("b"))
    steps = z.join(before, [panel, t]).groupBy(t).agg(F.avg(F.col("z") - F.col("b")).alias("step"))
    return steps.withColumn("c", F.sum("step").over(Window.orderBy(t).rowsBetween(Window.unboundedPreceding, 0))).select(t, "c")


def composite_members(df: DataFrame, panel: str, t: str = "t") -> DataFrame:
    """Months at which the set of panels present differs from the month before, with the set."""
    by = df.groupBy(t).agg(F.array_join(F.array_sort(F.collect_set(panel)), "|").alias("members"))
    before = F.lag("members").over(Window.orderBy(t))
    return by.withColumn("before", before).where("before is null or before <> members").drop("before")


def definition_grid(points: DataFrame, configs: DataFrame, axes: list[str], hit: Column) -> DataFrame:
    """Hits of every configuration, and by every axis: broadcast configurations against the points, then grouping sets."""
    cells = points.join(F.broadcast(configs)).groupBy(*axes).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.count("*").alias("n"))
    sets = [[F.col(a) for a in axes], *[[F.col(a)] for a in axes], []]
    marks = [F.grouping(a).cast("bigint").alias(f"all_{a}") for a in axes]
    return cells.groupingSets(sets, *[F.col(a) for a in axes]).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), *marks)
