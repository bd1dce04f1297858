"""Statistics as aggregates and joins: correlation, regression, breaks, AUC, CRPS, resampling, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import keyed_random
from .joins import lag_panel
from .series import average_rank, over


def correlation(x: str | Column, y: str | Column, at_least: int = 3) -> Column:
    """Pearson correlation; null below at_least pairs or for a constant side."""
    scale = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(F.count(x) >= at_least, F.covar_samp(x, y) / F.nullif(scale, F.lit(0.0)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ranked = df.withColumns({"rx": average_rank(x, keys), "ry": average_rank(y, keys)})
    return ranked.groupBy(*keys).agg(correlation("rx", "ry").alias("rho"))


def cross_correlation(x: DataFrame, y: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """(keys, h, r, n) over the balanced panel of lags 0 .. max_lag."""
    return lag_panel(x, y, keys, max_lag).groupBy(*keys, "h").agg(correlation("x", "y").alias("r"), F.count("*").alias("n"))


def peak_lag(ccf: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """The lag of greatest correlation in the expected direction, the least on ties."""
    rank = F.row_number().over(over(keys, F.desc(F.col("r") * sign), F.asc("h")))
    return ccf.where("r is not null").withColumn("rank", rank).where("rank = 1").drop("rank")


def ols(x: str, y: str) -> list[Column]:
    """Aggregates beta, alpha, ssr, tau (where the line meets zero) and n."""
    slope = F.regr_slope(y, x)
    icept = F.regr_intercept(y, x)
    return [slope.alias("beta"), icept.alias("alpha"), (F.regr_syy(y, x) - slope * F.regr_sxy(y, x)).alias("ssr"), (-icept / F.nullif(slope, F.lit(0.0))).alias("tau"), F.regr_count(y, x).alias("n")]


def fixed_split(df: DataFrame, keys: list[str], after: Column, x: str, y: str) -> DataFrame:
    """Change of correlation and slope at a date, and the parts of ln R: ln beta + ln sd x - ln sd y."""
    rows = df.withColumn("post", after.cast("int"))
    by = rows.groupBy(*keys, "post").agg(correlation(x, y).alias("r"), F.regr_slope(y, x).alias("b"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"))
    pick = lambda c, p: F.max(F.when(F.col("post") == p, F.col(c)))
    ln = lambda c: F.log(F.nullif(F.abs(pick(c, 1)), F.lit(0.0))) - F.log(F.nullif(F.abs(pick(c, 0)), F.lit(0.0)))
    out = [(pick("r", 1) - pick("r", 0)).alias("dr"), (pick("b", 1) - pick("b", 0)).alias("dbeta"), ln("r").alias("ln_r"), ln("b").alias("ln_b"), ln("sx").alias("ln_sx"), ln("sy").alias("ln_sy")]
    return by.groupBy(*keys).agg(*out)


def _segment_ssr(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    dx = sxx - sx * sx / n
    return syy - sy * sy / n - F.coalesce((sxy - sx * sy / n) * (sxy - sx * sy / n) / F.nullif(dx, F.lit(0.0)), F.lit(0.0))


_MOMENTS = ("sx", "sy", "sxx", "sxy", "syy")


def _prefix_sums(df: DataFrame, keys: list[str], t: str, x: str, y: str) -> DataFrame:
    w = over(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    terms = {"sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y), "syy": F.col(y) * F.col(y)}
    return df.withColumns({k: F.sum(c).over(w) for k, c in terms.items()} | {"i": F.row_number().over(over(keys, t)).cast("bigint")})


def sup_f(df: DataFrame, keys: list[str], t: str, x: str, y: str, trim: float = 0.15) -> DataFrame:
    """One break in a regression of y on x: where F is greatest, the last old month, the first new one and F; at least trim of the rows on either side."""
    sums = _prefix_sums(df, keys, t, x, y).withColumn("new_t", F.lead(t).over(over(keys, t)))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    total = {f"t_{m}": F.max_by(m, "i").over(whole) for m in _MOMENTS} | {"n": F.max("i").over(whole)}
    rows = sums.withColumns(total).withColumn("least", F.greatest(F.lit(3), F.floor(F.col("n") * trim)).cast("bigint"))
    rows = rows.where((F.col("i") >= F.col("least")) & (F.col("n") - F.col("i") >= F.col("least")))
    one = _segment_ssr(F.col("n"), *[F.col(f"t_{m}") for m in _MOMENTS])
    two = _segment_ssr(F.col("i"), *[F.col(m) for m in _MOMENTS]) + _segment_ssr(F.col("n") - F.col("i"), *[F.col(f"t_{m}") - F.col(m) for m in _MOMENTS])
    scored = rows.withColumns({"one": one, "two": two}).withColumn("f", (F.col("one") - F.col("two")) / 2 / F.nullif(F.col("two") / (F.col("n") - 4), F.lit(0.0)))
    rank = F.row_number().over(over(keys, F.desc("f"), F.asc(t)))
    return scored.where("f is not null").withColumn("rank", rank).where("rank = 1").select(*keys, F.col(t).alias("break_t"), "new_t", "f", "n")


def breaks_bic(df: DataFrame, keys: list[str], t: str, x: str, y: str, least: int, most: int) -> DataFrame:
    """Partitions of 0 .. most breaks of least residual sum, with BIC: a dynamic programme of ``most`` joins over segments of at least ``least`` rows."""
    sums = _prefix_sums(df, keys, t, x, y).select(*keys, "i", *_MOMENTS)
    start = sums.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("a"), *[F.lit(0.0).alias(f"a_{m}") for m in _MOMENTS])
    ends = sums.select(*keys, F.col("i").alias("b"), *[F.col(m).alias(f"b_{m}") for m in _MOMENTS])
    begins = sums.select(*keys, F.col("i").alias("a"), *[F.col(m).alias(f"a_{m}") for m in _MOMENTS]).unionByName(start) if keys else sums.select(F.col("i").alias("a"), *[F.col(m).alias(f"a_{m}") for m in _MOMENTS]).unionByName(start)
    n = F.col("b") - F.col("a")
    pairs = begins.join(ends, keys) if keys else begins.crossJoin(ends)
    segments = pairs.where(n >= least).withColumn("ssr", _segment_ssr(n, *[F.col(f"b_{m}") - F.col(f"a_{m}") for m in _MOMENTS])).select(*keys, "a", "b", "ssr")
    last = sums.groupBy(*keys).agg(F.max("i").alias("n"))
    state = segments.where("a = 0").select(*keys, "b", "ssr", F.array().cast("array<bigint>").alias("at"))
    out = None
    for m in range(most + 1):
        done = state.join(last, keys) if keys else state.crossJoin(F.broadcast(last))
        row = done.where("b = n").select(*keys, F.lit(m).alias("m"), "ssr", "at", "n")
        out = row if out is None else out.unionByName(row)
        if m < most:
            step = state.select(*keys, F.col("b").alias("a"), F.col("ssr").alias("before"), F.col("at").alias("path")).join(segments, [*keys, "a"])
            best = F.min(F.struct((F.col("before") + F.col("ssr")).alias("ssr"), F.array_append("path", F.col("a")).alias("at")))
            state = step.groupBy(*keys, "b").agg(best.alias("s")).select(*keys, "b", "s.ssr", "s.at")
    bic = F.col("n") * F.log(F.greatest(F.col("ssr"), F.lit(1e-300)) / F.col("n")) + (3 * F.col("m") + 2) * F.log("n")
    return out.withColumn("bic", bic)


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by ranks; null without both classes."""
    ranked = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("rk", average_rank(score, keys))
    n1, n0 = F.sum(F.col(label).cast("bigint")), F.sum(1 - F.col(label).cast("bigint"))
    top = F.sum(F.when(F.col(label) == 1, F.col("rk"))) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*keys).agg((top / F.nullif(n1 * n0, F.lit(0))).alias("auc"), n1.alias("n1"), n0.alias("n0"))


def youden(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Threshold of greatest tpr - fpr for score <= threshold, over midpoints of neighbouring scores (a single score is its own); the least on ties; no row without both classes."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by = known.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("q"))
    below = over(keys, "s").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    rows = by.withColumns({"next": F.lead("s").over(over(keys, "s")), "bp": F.sum("p").over(below), "bq": F.sum("q").over(below), "tp": F.sum("p").over(whole), "tq": F.sum("q").over(whole), "scores": F.count("*").over(whole)})
    rows = rows.where("(next is not null or scores = 1) and tp > 0 and tq > 0")
    rows = rows.withColumns({"threshold": (F.col("s") + F.coalesce("next", "s")) / 2, "j": F.round(F.col("bp") / F.col("tp") - F.col("bq") / F.col("tq"), 12)})
    rank = F.row_number().over(over(keys, F.desc("j"), F.asc("threshold")))
    return rows.withColumn("rank", rank).where("rank = 1").select(*keys, "threshold", "j")


def crps(ensemble: DataFrame, keys: list[str], x: str, outcome: str) -> DataFrame:
    """(keys, m, crps) of an empirical ensemble of x against an outcome that is the same on all its rows."""
    i = F.row_number().over(over(keys, x))
    m = F.count("*").over(Window.partitionBy(*keys))
    rows = ensemble.withColumns({"i": i, "m": m})
    spread = F.sum((2 * F.col("i") - F.col("m") - 1) * F.col(x)) / (F.max("m") * F.max("m"))
    return rows.groupBy(*keys).agg(F.max("m").cast("bigint").alias("m"), (F.avg(F.abs(F.col(x) - F.col(outcome))) - spread).alias("crps"))


def expanding_ensembles(returns: DataFrame, horizon: int, warm_up: int, t: str = "t", r: str = "r") -> DataFrame:
    """(origin, x, outcome): the returns known at each origin, and the one that its horizon will bring.  A range join: n^2 / 2 rows of one series."""
    origins = returns.select((F.col(t) - horizon).alias("origin"), F.col(r).alias("outcome"))
    known = returns.select(F.col(t).alias("known"), F.col(r).alias("x"))
    # months meet in equal decades, so the range join is dealt by keys and not crossed whole
    width = 64
    high = known.agg(F.max("known").alias("h"), F.min("known").alias("l"))
    dealt = known.join(F.broadcast(high)).withColumn("k", F.explode(F.sequence(F.floor(F.col("known") / width), F.floor(F.col("h") / width))))
    asked = origins.withColumn("k", F.floor(F.col("origin") / width))
    joined = asked.join(dealt, "k").where("known <= origin")
    n = F.count("*").over(Window.partitionBy("origin"))
    return joined.withColumn("m", n).where(F.col("m") >= warm_up).select("origin", "x", "outcome")


def scaled_about(x: Column, centre: Column, scale: Column) -> Column:
    """x with its distance from the centre multiplied by scale."""
    return centre + scale * (x - centre)


def sample_acf(df: DataFrame, max_lag: int, t: str = "t", v: str = "v") -> DataFrame:
    """(h, rho) for h = 0 .. max_lag, of deviations from the whole mean over the whole variance."""
    mean = df.agg(F.avg(v).alias("mu"))
    rows = df.join(F.broadcast(mean)).select(F.col(t), (F.col(v) - F.col("mu")).alias("d"))
    ahead = rows.select(F.col("d").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("h"), F.col(t).alias("at")).select((F.col("at") - F.col("h")).alias(t), "h", "e")
    pairs = rows.join(ahead, t).groupBy("h").agg(F.sum(F.col("d") * F.col("e")).alias("c"))
    c0 = pairs.where("h = 0").select(F.col("c").alias("c0"))
    return pairs.join(F.broadcast(c0)).select("h", (F.col("c") / F.nullif(F.col("c0"), F.lit(0.0))).alias("rho"))


def effective_size(acf: DataFrame, n: int | Column) -> DataFrame:
    """(tau, n_eff): lag pairs (1,2), (3,4) ... are added while their sum is positive."""
    pairs = acf.where("h > 0").groupBy(F.floor((F.col("h") - 1) / 2).alias("pair")).agg(F.sum("rho").alias("s"))
    open_ = F.min(F.when(F.col("s") > 0, 1).otherwise(0)).over(Window.orderBy("pair").rowsBetween(Window.unboundedPreceding, 0))
    tau = (1 + 2 * F.coalesce(F.sum(F.when(F.col("open") == 1, F.col("s"))), F.lit(0.0))).alias("tau")
    count = n if isinstance(n, Column) else F.lit(n)
    return pairs.withColumn("open", open_).agg(tau).select("tau", (count / F.greatest(F.col("tau"), F.lit(1.0))).alias("n_eff"))


def verdict(mean: Column, half_width: Column) -> Column:
    """better, worse or unknown as the interval lies above, below or across zero."""
    return F.when(mean - half_width > 0, "better").when(mean + half_width < 0, "worse").otherwise("unknown")


def block_starts(spark, n: int, block: int, reps: int, stream: str, circular: bool) -> DataFrame:
    """(rep, i, row): the rows that each replicate draws, in order; a circular block wraps, a plain one starts early enough to fit."""
    blocks = -(-n // block)
    top = n if circular else n - block + 1
    grid = spark.range(reps * blocks).select(F.floor(F.col("id") / blocks).alias("rep"), (F.col("id") % blocks).alias("b"))
    drawn = grid.withColumn("start", keyed_random(top, F.lit(stream), F.col("rep"), F.col("b")))
    rows = drawn.select("rep", "b", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: (F.col("start") + k) % n)).alias("k", "row"))
    return rows.withColumn("i", F.col("b") * block + F.col("k")).where(F.col("i") < n).select("rep", "i", "row")


def bootstrap_mean(df: DataFrame, block: int, reps: int, stream: str, circular: bool, t: str = "t", v: str = "v") -> DataFrame:
    """(rep, mean): replicate means of a series under the block bootstrap."""
    n = df.count()
    numbered = df.withColumn("row", F.row_number().over(Window.orderBy(t)).cast("bigint") - 1).select("row", F.col(v).alias("v"))
    return block_starts(df.sparkSession, n, block, reps, stream, circular).join(F.broadcast(numbered), "row").groupBy("rep").agg(F.avg("v").alias("mean"))


def cluster_bootstrap(clusters: DataFrame, reps: int, stream: str, order: str, total: str, count: str) -> DataFrame:
    """(rep, rate): sum of totals over sum of counts of clusters drawn with replacement."""
    n = clusters.count()
    numbered = clusters.withColumn("row", F.row_number().over(Window.orderBy(order)).cast("bigint") - 1).select("row", F.col(total).alias("s"), F.col(count).alias("c"))
    draws = clusters.sparkSession.range(reps * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("i"))
    drawn = draws.withColumn("row", keyed_random(n, F.lit(stream), F.col("rep"), F.col("i")))
    return drawn.join(F.broadcast(numbered), "row").groupBy("rep").agg((F.sum("s") / F.sum("c")).alias("rate"))


def tail_share(draws: DataFrame, value: str, observed: Column | float, two_sided: bool = True) -> DataFrame:
    """(p): (1 + draws at least as far out) / (1 + draws)."""
    bar = observed if isinstance(observed, Column) else F.lit(observed)
    out = F.abs(value) >= F.abs(bar) if two_sided else F.col(value) >= bar
    return draws.agg(((1 + F.sum(F.when(out, 1).otherwise(0))) / (1 + F.count("*"))).alias("p"))


def exact_permutation(df: DataFrame, k: int, unit: str, v: str, one: str, two_sided: bool = True) -> DataFrame:
    """(observed, labellings, p) of the difference in means over all ways to pick k of the units, which are few: each way is a row.

    Picks grow by one unit at a time, each later in order than the last, so k of n units
    make n over k rows and no more, spread over the tasks after the second pick; p counts
    differences as large but for 1e-9, in size or (two_sided false) with their sign.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(v).cast("double").alias("x")))), lambda z: z["x"])
    held = df.agg(ordered.alias("xs"), (F.avg(F.when(F.col(one), F.col(v))) - F.avg(F.when(~F.col(one), F.col(v)))).alias("observed"))  # one row
    picks = held.select("xs", "observed", F.lit(-1).alias("at"), F.lit(0.0).alias("total"))
    for left in range(k, 0, -1):
        later = F.filter(F.sequence(F.lit(0), F.size("xs") - left), lambda i: i > F.col("at"))
        picks = picks.select("xs", "observed", "total", F.explode(later).alias("at")).withColumn("total", F.col("total") + F.get("xs", F.col("at")))
        picks = picks.repartition(F.xxhash64("at", "total")) if left == k - 1 else picks
    whole = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)
    diff = F.col("total") / k - (whole - F.col("total")) / F.nullif(F.size("xs") - k, F.lit(0))
    far = F.abs(diff) >= F.abs(F.col("observed")) - 1e-9 if two_sided else diff >= F.col("observed") - 1e-9
    hit = F.when(far, 1.0).otherwise(0.0)
    return picks.groupBy("observed").agg(F.count("*").alias("labellings"), F.avg(hit).alias("p"))


def holm(df: DataFrame, keys: list[str], p: str, name: str, m: int | None = None) -> DataFrame:
    """Column adjusted: step-down p-values for a family of m (None: the number of p-values); ties by name, null stays null."""
    rows = df.where(F.col(p).isNotNull())
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    rn, size = F.row_number().over(over(keys, p, name)), (F.lit(m) if m else F.count("*").over(whole))
    stepped = rows.withColumn("_step", F.least(F.lit(1.0), (size - rn + 1) * F.col(p)))
    done = stepped.withColumn("adjusted", F.max("_step").over(over(keys, p, name).rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def permutation_rank_p(pairs: DataFrame, reps: int, stream: str, unit: str, a: str, b: str) -> DataFrame:
    """(rho, p): Spearman correlation of a and b, and the share of keyed permutations of b with one as large."""
    ranked = pairs.select(unit, average_rank(a, []).alias("ra"), average_rank(b, []).alias("rb"))
    place = F.row_number().over(Window.orderBy(unit))
    own = ranked.withColumn("i", place)
    draws = own.select("i", "rb").join(F.broadcast(pairs.sparkSession.range(reps).withColumnRenamed("id", "rep")))
    order = F.row_number().over(Window.partitionBy("rep").orderBy(F.md5(F.concat_ws(":", F.lit(stream), F.col("rep").cast("string"), F.col("i").cast("string")))))
    shuffled = draws.select("rep", "rb", order.alias("i")).join(F.broadcast(own.select("i", "ra")), "i").groupBy("rep").agg(correlation("ra", "rb").alias("r"))
    seen = own.agg(correlation("ra", "rb").alias("rho"))
    return shuffled.join(F.broadcast(seen)).groupBy("rho").agg(((1 + F.sum(F.when(F.col("r") >= F.col("rho") - 1e-12, 1).otherwise(0))) / (1 + F.count("*"))).alias("p"))


def max_lag_null(x: DataFrame, y: DataFrame, max_lag: int, sign: int, block: int, reps: int, stream: str) -> DataFrame:
    """(r, h, p): the peak of the cross-correlation and its share under block-resampled x, the lag searched anew each time."""
    panel = lag_panel(x, y, [], max_lag)
    rows = panel.select("t").distinct().withColumn("row", F.row_number().over(Window.orderBy("t")).cast("bigint") - 1)
    n = rows.count()
    drawn = block_starts(panel.sparkSession, n, block, reps, stream, True)
    source = panel.where("h = 0").select("t", F.col("x").alias("sx")).join(rows, "t").select("row", "sx")
    fake = drawn.join(F.broadcast(source), "row").select("rep", F.col("i").alias("row"), "sx")
    met = panel.join(rows, "t").select("row", "h", "y").join(fake, "row").groupBy("rep", "h").agg((sign * correlation("sx", "y")).alias("r"))
    tops = met.groupBy("rep").agg(F.max("r").alias("top"))
    best = peak_lag(panel.groupBy("h").agg(correlation("x", "y").alias("r")), [], sign)
    both = tops.join(F.broadcast(best.select("r", "h")))
    return both.groupBy("r", "h").agg(((1 + F.sum(F.when(F.col("top") >= sign * F.col("r"), 1).otherwise(0))) / (1 + F.count("*"))).alias("p"))


def rolling_correlation(x: DataFrame, y: DataFrame, max_lag: int, window: int, at_least: int) -> DataFrame:
    """(start, h, r): the cross-correlation over each window of months; a row is sent to the windows that hold it."""
    panel = lag_panel(x, y, [], max_lag).withColumn("start", F.explode(F.sequence(F.col("t") - (window - 1), F.col("t"))))
    months = x.select(F.col("t").alias("start"))
    return panel.join(months, "start").groupBy("start", "h").agg(correlation("x", "y").alias("r"), F.count("*").alias("n")).where(F.col("n") >= at_least).drop("n")


def out_of_sample(df: DataFrame, keys: list[str], t: str, x: str, y: str, share: float = 0.8) -> DataFrame:
    """(hit_rate, rmse) on the last rows of a line fitted to the first share of them."""
    place = F.percent_rank().over(over(keys, t))
    rows = df.withColumn("train", place < share)
    fit = rows.where("train").groupBy(*keys).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    test = rows.where("not train")
    test = (test.join(fit, keys) if keys else test.join(F.broadcast(fit))).withColumn("e", F.col("a") + F.col("b") * F.col(x))
    return test.groupBy(*keys).agg(F.avg((F.signum("e") == F.signum(y)).cast("double")).alias("hit_rate"), F.sqrt(F.avg((F.col("e") - F.col(y)) * (F.col("e") - F.col(y)))).alias("rmse"))


#: Panels whose effects are solved in one step.
MAX_PANELS = 2000


def two_way_effects(z: DataFrame, panel: str, t: str = "t", v: str = "z") -> DataFrame:
    """(panel, b) of v = c_t + b_panel with sum b = 0, unbalanced: normal equations from co-occurrence sums, one row a pair of panels, solved on the driver: more than MAX_PANELS are an error."""
    import numpy as np

    if (n := z.select(panel).distinct().count()) > MAX_PANELS:
        raise ValueError(f"{n} panels; at most {MAX_PANELS} are solved at once")

    months = z.groupBy(t).agg(F.count("*").alias("n"), F.avg(v).alias("m"))
    rows = z.join(months, t)
    own = rows.groupBy(panel).agg(F.sum(F.col(v) - F.col("m")).alias("r")).orderBy(panel).collect()
    other = rows.select(F.col(panel).alias("q"), t)
    cross = rows.join(other, t).groupBy(panel, "q").agg(F.sum(1 / F.col("n")).alias("w"), F.sum(F.when(F.col(panel) == F.col("q"), 1).otherwise(0)).alias("d")).collect()
    names = [r[panel] for r in own]
    at = {k: i for i, k in enumerate(names)}
    a = np.zeros((len(names) + 1, len(names)))
    for r in cross:
        a[at[r[panel]], at[r["q"]]] += r["d"] - r["w"]
    a[-1, :] = 1.0
    b = np.linalg.lstsq(a, np.array([r["r"] for r in own] + [0.0]), rcond=None)[0] if names else []
    return z.sparkSession.createDataFrame([(k, float(x)) for k, x in zip(names, b)], f"{panel} string, b double")
