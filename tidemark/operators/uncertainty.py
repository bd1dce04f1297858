"""How far estimates can be trusted: parts of a score's gain, noise of composites, resampled episodes, power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import keyed_random
from .series import over


def scale_decomposition(points: DataFrame, keys: list[str], horizon: int, least: int) -> DataFrame:
    """(keys, n, median_scale, level, synchronisation, interaction, actual): what scaling an ensemble gains in score, by its level alone, by its changes alone, and by both together beyond that.

    points: (keys, i, annual, vol) as provenance.measured gives them.  An origin's
    ensemble is sorted once: with c its mean, D half its members' mean distance and y
    the outcome, the score at width s is mean |c + s (x - c) - y| - s D, so the three
    widths are three sums over the same rows.  Level: the median of the scales; changes:
    scale over that median.
    """
    at, own = over(keys, "i"), Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    origins = points.withColumns({"y": F.lead("annual", horizon).over(at), "scale": F.col("vol") / F.avg("vol").over(so_far)}).where("y is not null and scale is not null").where(F.col("i") >= least)
    origins = origins.withColumn("mid", F.percentile("scale", F.lit(0.5)).over(own)).select(*keys, "i", "y", "scale", "mid")
    members = points.where("annual is not null").select(*keys, F.col("i").alias("j"), F.col("annual").alias("x"))
    each = Window.partitionBy(*keys, "i")
    rows = (origins.join(members, keys) if keys else origins.crossJoin(members)).where("j <= i")  # months of a series: bounded by the calendar
    rows = rows.withColumns({"r": F.row_number().over(each.orderBy("x", "j")), "n": F.count("*").over(each), "c": F.avg("x").over(each)})
    widths = {"base": F.lit(1.0), "actual": F.col("scale"), "level": F.col("mid"), "changes": F.col("scale") / F.col("mid")}
    far = {k: F.avg(F.abs(F.col("c") + s * (F.col("x") - F.col("c")) - F.col("y"))).alias(f"far_{k}") for k, s in widths.items()}
    half = (F.sum((2 * F.col("r") - F.col("n") - 1) * F.col("x")) / F.first("n") / F.first("n")).alias("half")
    scored = rows.groupBy(*keys, "i").agg(*far.values(), half, F.first("scale").alias("scale"), F.first("mid").alias("mid"))
    score = {k: F.col(f"far_{k}") - s * F.col("half") for k, s in widths.items()}
    gains = scored.select(*keys, "mid", *[(score["base"] - score[k]).alias(k) for k in ("actual", "level", "changes")])
    return gains.groupBy(*keys).agg(F.count("*").alias("n"), F.first("mid").alias("median_scale"), F.avg("level").alias("level"), F.avg("changes").alias("synchronisation"), F.avg(F.col("actual") - F.col("level") - F.col("changes")).alias("interaction"), F.avg("actual").alias("actual"))


def attenuation(z: DataFrame, panel: str, other: DataFrame, split: int, t: str = "t", v: str = "z", y: str = "y") -> DataFrame:
    """(regime, n, mean_k, var_noise, var_c, lambda, beta, beta_corr, r, r_corr) before and from quarter split on: slope and correlation of other's y on a composite's quarters, put right for the composite's noise.

    z: values by panel and month, offsets off.  A month's noise is the panels' sample
    variance over their number, where there are two or more; a quarter's is the ninth of
    the sum of its three months', if all have one; lambda is one less its mean share of
    the composite's variance.  other: (q, y) by quarter.
    """
    months = z.groupBy(t).agg(F.avg(v).alias("c"), F.var_samp(v).alias("s2"), F.count(v).alias("k"))
    months = months.withColumns({"noise": F.when(F.col("k") >= 2, F.col("s2") / F.col("k")), "q": F.floor(F.col(t) / 3).cast("bigint")})
    quarters = months.groupBy("q").agg(F.avg("c").alias("c"), F.count("c").alias("m"), F.when(F.count("noise") == 3, F.sum("noise") / 9).alias("noise"), F.avg("k").alias("k")).where("m = 3")
    rows = quarters.join(other, "q").withColumn("regime", F.when(F.col("q") < split, "pre").otherwise("post"))
    by = rows.groupBy("regime").agg(F.count("*").alias("n"), F.avg("k").alias("mean_k"), F.avg("noise").alias("var_noise"), F.var_samp("c").alias("var_c"), F.regr_slope(F.col(y), F.col("c")).alias("beta"), F.corr("c", y).alias("r"))
    out = by.withColumn("lambda", 1 - F.col("var_noise") / F.nullif(F.col("var_c"), F.lit(0.0)))
    real = F.when(F.col("lambda") > 0, F.col("lambda"))
    return out.withColumns({"beta_corr": F.col("beta") / real, "r_corr": F.col("r") / F.sqrt(real)})


def _draws(units: DataFrame, keys: list[str], reps: int, stream: str, order: str) -> DataFrame:
    """(keys, rep, units' columns): reps samples with repeats of each group's units, of its own size, by keyed draws."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    numbered = units.withColumns({"_at": F.row_number().over(own.orderBy(order)) - 1, "_n": F.count("*").over(own)})
    slots = numbered.select(*keys, F.col("_at").alias("_slot"), "_n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    picked = slots.withColumn("_at", keyed_random(F.col("_n"), F.lit(stream), *[F.col(k) for k in keys], F.col("rep"), F.col("_slot")).cast("int"))
    return picked.drop("_n").join(numbered.drop("_n"), [*keys, "_at"]).drop("_at")


def _ordered(draws: DataFrame, by: list[str], v: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return draws.withColumns({"_r": F.row_number().over(w.orderBy(v, "_slot")), "_m": F.count("*").over(w)})


def lag_bootstrap(lags: DataFrame, keys: list[str], unit: str, v: str, reps: int, stream: str) -> DataFrame:
    """(keys, n, median, low, high, least, most): upper median of a group's lags and, over reps samples of its units, the bounds of 90 per cent of the medians and the mean extremes; bounds are null for one unit."""
    upper = F.max(F.when(F.col("_r") == F.floor(F.col("_m") / 2) + 1, F.col(v)))
    point = _ordered(lags.withColumn("_slot", F.col(unit)), keys, v).groupBy(*keys).agg(F.count("*").alias("n"), upper.alias("median"))
    reps_of = _ordered(_draws(lags, keys, reps, stream, unit), [*keys, "rep"], v).groupBy(*keys, "rep").agg(upper.alias("m"), F.min(v).alias("a"), F.max(v).alias("z"))
    ranked = reps_of.withColumn("_i", F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("m", "rep")) - 1)
    at = lambda p: F.max(F.when(F.col("_i") == int(p * (reps - 1)), F.col("m")))
    bounds = ranked.groupBy(*keys).agg(at(0.05).alias("low"), at(0.95).alias("high"), F.avg("a").alias("least"), F.avg("z").alias("most"))
    both = point.join(bounds, keys) if keys else point.crossJoin(bounds)  # a row each
    return both.select(*keys, "n", "median", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("low", "high", "least", "most")])


def identifiable(low: Column, high: Column, sigma: Column | float) -> Column:
    """Whether an interval is narrower than one standard deviation; null without bounds."""
    return high - low < sigma


def _normal(*key: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers that depend on the key alone."""
    u = [(keyed_random(2**32, *key, F.lit(i)) + 0.5) / 2.0**32 for i in (0, 1)]
    size, turn = F.sqrt(-2 * F.log(u[0])), 2 * F.pi() * u[1]
    return size * F.cos(turn), size * F.sin(turn)


def ratio_power(design: DataFrame, n: str, rho: str, ratios: list[float], sims: int, boots: int, stream: str, size_at_most: float = 0.1, power_at_least: float = 0.8) -> DataFrame:
    """(ratio, power, size, informative, detectable): how often pairs of normal numbers with a true ratio of standard deviations are found to have one below 1, and the ratio nearest to 1 that is found often enough.

    design: one row with the number of pairs n and their correlation rho.  A sample
    counts if its ratio and the upper bound of 90 per cent of its resampled ratios are
    below 1.  Ratios of a sample drawn at another true ratio are these times that ratio,
    so each sample and resample is drawn once, and is only its sums of squares.
    The power at 1 is the size; where it is above size_at_most nothing is detectable.
    """
    one = design.select(F.col(n).cast("int").alias("n"), F.col(rho).alias("rho"))
    sims_of = one.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).repartition("sim")
    pairs = sims_of.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    z, e = _normal(F.lit(stream), F.col("sim"), F.col("i"))
    pairs = pairs.withColumns({"x": z, "e": e}).withColumn("y", F.col("rho") * F.col("x") + F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("rho") * F.col("rho"))) * F.col("e")).select("sim", "i", "n", "x", "y")
    ratio = F.stddev_samp("y") / F.nullif(F.stddev_samp("x"), F.lit(0.0))
    point = pairs.groupBy("sim").agg(ratio.alias("point"))
    slots = sims_of.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    slots = slots.select("sim", "boot", keyed_random(F.col("n"), F.lit(stream + "-b"), F.col("sim"), F.col("boot"), F.col("slot")).cast("int").alias("i"))
    drawn = slots.join(pairs, ["sim", "i"]).groupBy("sim", "boot").agg(ratio.alias("b")).where("b is not null")
    w = Window.partitionBy("sim")
    ranked = drawn.withColumns({"_i": F.row_number().over(w.orderBy("b", "boot")) - 1, "_n": F.count("*").over(w)})
    upper = ranked.where(F.col("_i") == F.floor(0.95 * (F.col("_n") - 1))).select("sim", F.col("b").alias("upper"))
    tried = point.join(upper, "sim", "left").withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    hit = (F.col("ratio") * F.col("point") < 1) & (F.col("ratio") * F.col("upper") < 1)
    power = tried.groupBy("ratio").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("power"))
    every = Window.partitionBy(F.lit(1))  # a row a ratio
    out = power.withColumn("size", F.max(F.when(F.col("ratio") == 1, F.col("power"))).over(every)).withColumn("informative", F.col("size") <= size_at_most)
    found = F.max(F.when((F.col("ratio") < 1) & (F.col("power") >= power_at_least), F.col("ratio"))).over(every)
    return out.withColumn("detectable", F.when(F.col("informative"), found))
