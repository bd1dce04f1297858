"""Queries of score parts, noise, resampled lags, power and policy phases, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as W
from ..operators import states as C
from ..operators import uncertainty as U
from .base import MK, m, mk, read, shaped, sql
from .base import M as MONTHS
from .leak_queries import _POINTS, HORIZON, LEAST, points

QUERIES: dict = {}
ORACLES: dict = {}
_RNG = "CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


_SCORE = lambda s: f"avg(abs(c + {s} * (x - c) - y)) - any_value({s}) * (sum((2 * r - n - 1) * x) / any_value(n) / any_value(n))"


@q(
    [
        *_POINTS,
        f"og AS (SELECT *, quantile_cont(sc, 0.5) OVER (PARTITION BY k) mid FROM (SELECT k, i, lead(annual, {HORIZON}) OVER (PARTITION BY k ORDER BY i) y, vol / avg(vol) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) sc FROM p) WHERE y IS NOT NULL AND sc IS NOT NULL AND i >= {LEAST})",
        "pr AS (SELECT o.*, z.annual x, row_number() OVER (PARTITION BY o.k, o.i ORDER BY z.annual, z.i) r, count(*) OVER e n, avg(z.annual) OVER e c FROM og o JOIN p z ON z.k = o.k AND z.annual IS NOT NULL AND z.i <= o.i WINDOW e AS (PARTITION BY o.k, o.i))",
        f"cs AS (SELECT k, i, any_value(mid) mid, {_SCORE('1.0')} b, {_SCORE('sc')} a, {_SCORE('mid')} l, {_SCORE('(sc / mid)')} s FROM pr GROUP BY k, i)",
    ],
    "SELECT k, count(*) n, any_value(mid) median_scale, avg(b - l) level, avg(b - s) synchronisation, avg((b - a) - (b - l) - (b - s)) interaction, avg(b - a) actual FROM cs GROUP BY k",
    k="string", n="bigint", median_scale="double", level="double", synchronisation="double", interaction="double", actual="double",
)
def scale_decomposition(spark, d):
    return U.scale_decomposition(points(spark, d), ["k"], HORIZON, LEAST)


_Z = "z AS (SELECT k, t, (v - mu) / sd z FROM mk JOIN (SELECT k k2, avg(v) mu, stddev_samp(v) sd FROM mk WHERE t BETWEEN 23904 AND 23999 GROUP BY 1 HAVING count(*) >= 24 AND stddev_samp(v) > 0) ON k = k2)"
SPLIT = 7984


@q(
    [
        MONTHS, MK, _Z, "o AS (SELECT k, t, z - avg(z) OVER (PARTITION BY k) z FROM z)",
        "mo AS (SELECT t, avg(z) c, CASE WHEN count(z) >= 2 THEN var_samp(z) / count(z) END noise, count(z) kk FROM o GROUP BY t)",
        "qu AS (SELECT t // 3 q, avg(c) c, CASE WHEN count(noise) = 3 THEN sum(noise) / 9 END noise, avg(kk) kk FROM mo GROUP BY 1 HAVING count(c) = 3)",
        "yq AS (SELECT t // 3 q, avg(v) / 1000000 y FROM m GROUP BY 1 HAVING count(v) = 3)",
        f"re AS (SELECT CASE WHEN q < {SPLIT} THEN 'pre' ELSE 'post' END regime, * FROM qu JOIN yq USING (q))",
        "st AS (SELECT regime, count(*) n, avg(kk) mean_k, avg(noise) var_noise, var_samp(c) var_c, regr_slope(y, c) beta, corr(y, c) r FROM re GROUP BY 1)",
    ],
    "SELECT regime, n, mean_k, var_noise, var_c, la, beta, beta / CASE WHEN la > 0 THEN la END beta_corr, r, r / sqrt(CASE WHEN la > 0 THEN la END) r_corr FROM (SELECT *, 1 - var_noise / var_c la FROM st)",
    regime="string", n="bigint", mean_k="double", var_noise="double", var_c="double", la="double", beta="double", beta_corr="double", r="double", r_corr="double",
)
def attenuation(spark, d):
    z = C.standardised(mk(spark, d), "k", 23904, 23999).select("k", "t", (F.col("z") - F.avg("z").over(Window.partitionBy("k"))).alias("z"))
    y = W.quarter_mean(m(spark, d), []).select("q", (F.col("v") / 1000000).alias("y"))
    return U.attenuation(z, "k", y, SPLIT).withColumnRenamed("lambda", "la")


REPS = 200
_LAGS = "lg AS (SELECT u, i, lag FROM (SELECT user_id % 7 u, event_id i, date_diff('day', lag(CAST(ts AS DATE)) OVER w, CAST(ts AS DATE)) lag FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE lag IS NOT NULL)"


@q(
    [
        _LAGS, "nu AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY i) - 1 at_, count(*) OVER (PARTITION BY u) n FROM lg)",
        f"dr AS (SELECT a.u, rep, a.at_ slot, {_RNG.format(key=chr(39) + 'lags:' + chr(39) + ' || a.u || ' + chr(39) + ':' + chr(39) + ' || rep || ' + chr(39) + ':' + chr(39) + ' || a.at_')} % n at_ FROM nu a, generate_series(0, {REPS - 1}) g(rep))",
        "pk AS (SELECT dr.u, rep, slot, nu.lag, row_number() OVER (PARTITION BY dr.u, rep ORDER BY nu.lag, slot) r, n FROM dr JOIN nu USING (u, at_))",
        "rp AS (SELECT u, rep, max(CASE WHEN r = n // 2 + 1 THEN lag END) md, min(lag) a, max(lag) z FROM pk GROUP BY 1, 2)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY md, rep) - 1 i FROM rp)",
        f"bo AS (SELECT u, max(md) FILTER (WHERE i = {int(0.05 * (REPS - 1))}) low, max(md) FILTER (WHERE i = {int(0.95 * (REPS - 1))}) high, avg(a) least, avg(z) most FROM rk GROUP BY u)",
        "po AS (SELECT u, max(n) n, max(CASE WHEN r = n // 2 + 1 THEN lag END) md, stddev_samp(lag) sg FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY lag, i) r FROM nu) GROUP BY u)",
    ],
    "SELECT u, n, md AS median, CASE WHEN n > 1 THEN low END low, CASE WHEN n > 1 THEN high END high, CASE WHEN n > 1 THEN least END least_, CASE WHEN n > 1 THEN most END most_, CASE WHEN n > 1 THEN high - low < sg END known FROM po JOIN bo USING (u)",
    u="bigint", n="bigint", median="double", low="double", high="double", least_="double", most_="double", known="boolean",
)
def lag_bootstrap(spark, d):
    day = F.to_date("ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lags = read(spark, d, "events").where("event_type = 'error'").withColumn("lag", F.datediff(day, F.lag(day).over(w)).cast("double")).where("lag is not null").select((F.col("user_id") % 7).alias("u"), F.col("event_id").alias("i"), "lag")
    out = U.lag_bootstrap(lags, ["u"], "i", "lag", REPS, "lags").join(lags.groupBy("u").agg(F.stddev_samp("lag").alias("sg")), "u")
    return out.withColumn("known", U.identifiable(F.col("low"), F.col("high"), F.col("sg"))).withColumnsRenamed({"least": "least_", "most": "most_"})


RATIOS, SIMS, BOOTS = [round(0.2 + 0.1 * i, 1) for i in range(9)], 100, 60
_U = lambda i: f"({_RNG.format(key=chr(39) + 'pw:' + chr(39) + ' || sim || ' + chr(39) + ':' + chr(39) + ' || i || ' + chr(39) + f':{i}' + chr(39))} + 0.5) / 4294967296.0::DOUBLE"
_BOOT = _RNG.format(key="'pw-b:' || sim || ':' || boot || ':' || slot")


@q(
    [
        "cu AS (SELECT c_nationkey u, avg(CAST(c_acctbal AS DOUBLE)) a, CAST(count(*) AS DOUBLE) b FROM customer GROUP BY 1)", "ds AS (SELECT count(*) n, corr(a, b) rho FROM cu)",
        f"un AS (SELECT sim, i, n, rho, {_U(0)} u0, {_U(1)} u1 FROM ds, generate_series(0, {SIMS - 1}) g(sim), generate_series(0, (SELECT n FROM ds) - 1) h(i))",
        "pa AS (SELECT sim, i, n, x, rho * x + sqrt(greatest(0, 1 - rho * rho)) * e y FROM (SELECT *, sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) x, sqrt(-2 * ln(u0)) * sin(2 * pi() * u1) e FROM un))",
        "po AS (SELECT sim, stddev_samp(y) / stddev_samp(x) p FROM pa GROUP BY sim)",
        f"bo AS (SELECT sim, boot, stddev_samp(y) / nullif(stddev_samp(x), 0) b FROM (SELECT sim, boot, {_BOOT} % n i FROM ds, generate_series(0, {SIMS - 1}) g(sim), generate_series(0, {BOOTS - 1}) k(boot), generate_series(0, (SELECT n FROM ds) - 1) h(slot)) JOIN pa USING (sim, i) GROUP BY 1, 2)",
        "up AS (SELECT sim, b FROM (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY b, boot) - 1 i, count(*) OVER (PARTITION BY sim) n FROM bo WHERE b IS NOT NULL) WHERE i = floor(0.95 * (n - 1)))",
        f"pw AS (SELECT ratio, avg(CASE WHEN ratio * p < 1 AND ratio * b < 1 THEN 1.0 ELSE 0.0 END) AS power FROM po LEFT JOIN up USING (sim), (SELECT unnest({RATIOS}::DOUBLE[]) ratio) GROUP BY ratio)",
    ],
    "SELECT ratio, power, size, size <= 0.1 informative, CASE WHEN size <= 0.1 THEN (SELECT max(ratio) FROM pw WHERE ratio < 1 AND power >= 0.8) END detectable FROM pw, (SELECT power size FROM pw WHERE ratio = 1)",
    ratio="double", power="double", size="double", informative="boolean", detectable="double",
)
def ratio_power(spark, d):
    units = read(spark, d, "customer").groupBy("c_nationkey").agg(F.avg(F.col("c_acctbal").cast("double")).alias("a"), F.count("*").cast("double").alias("b"))
    return U.ratio_power(units.agg(F.count("*").alias("n"), F.corr("a", "b").alias("rho")), "n", "rho", RATIOS, SIMS, BOOTS, "pw")


@q(
    [
        "dl AS (SELECT c_mktsegment k, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) n, CAST(count(*) AS DOUBLE) v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
        "be AS (SELECT a.k, a.n, a.v, b.v before FROM dl a ASOF LEFT JOIN dl b ON a.k = b.k AND a.n - 183 >= b.n)",
        "qt AS (SELECT k, n, quantile_cont(v, 0.4) OVER w qv, count(v) OVER w c FROM dl WINDOW w AS (PARTITION BY k ORDER BY n RANGE BETWEEN 3653 PRECEDING AND CURRENT ROW))",
    ],
    "SELECT k, n, CASE WHEN before IS NULL THEN NULL WHEN v > before THEN -1 WHEN v < before THEN 1 WHEN c < 60 THEN NULL WHEN v <= qv THEN 1 ELSE -1 END phase FROM be JOIN qt USING (k, n)",
    k="string", n="bigint", phase="double",
)
def policy_phase(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return W.policy_phase(o.groupBy(F.col("c_mktsegment").alias("k"), day.alias("n")).agg(F.count("*").cast("double").alias("v")), ["k"], "n", "v")
