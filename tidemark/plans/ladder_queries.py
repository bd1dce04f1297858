"""Queries of ladders, confidence flags, cluster means and false alarms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ladders as L
from .base import MK, m, mk, read, shaped, sql
from .base import M as MONTHS

QUERIES: dict = {}
ORACLES: dict = {}

STEPS: L.Steps = [(None, 0.9, -1.0), (0.9, 1.0, -0.5), (1.0, 1.1, 0.5), (1.1, None, 1.0)]
#: Each segment's months as ratios to its mean.
RATIO = "r AS (SELECT k, t, round(v / avg(v) OVER (PARTITION BY k), 6) v FROM mk)"
STEP = "CASE WHEN v <= 0.9 THEN -1.0 WHEN v <= 1.0 THEN -0.5 WHEN v <= 1.1 THEN 0.5 WHEN v > 1.1 THEN 1.0 END"


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


def ratio(spark: SparkSession, d: str) -> DataFrame:
    mean = F.avg("v").over(Window.partitionBy("k"))
    return mk(spark, d).select("k", "t", F.round(F.col("v") / mean, 6).alias("v"))


@q([MK, RATIO], f"SELECT k, t, {STEP} step FROM r", k="string", t="bigint", step="double")
def ladder_steps(spark, d):
    return ratio(spark, d).withColumn("step", L.ladder_step(F.col("v"), STEPS))


@q([MK, RATIO, "x AS (SELECT *, lag(v, 3) OVER (PARTITION BY k ORDER BY t) b FROM r)"], f"SELECT k, t, 0.6 * sign(v - b) + 0.4 * {STEP} contribution FROM x WHERE b IS NOT NULL", k="string", t="bigint", contribution="double")
def ladder_contributions(spark, d):
    return L.ladder_contribution(ratio(spark, d), ["k"], "t", "v", STEPS)


@q([MK, RATIO], "SELECT a.k, a.t, 0.6 * sign(a.v - b.v) + 0.4 * sign(a.v - 1.0) contribution FROM r a JOIN r b ON a.k = b.k AND a.t = b.t + 3", k="string", t="bigint", contribution="double")
def level_contributions(spark, d):
    return L.level_contribution(ratio(spark, d), ["k"], "t", "v", 1.0)


_STATE = "CASE WHEN v > 1.05 THEN 'II' WHEN v < 0.95 THEN 'III' ELSE 'CENTER' END"
_VOTE = "CASE WHEN b IS NULL THEN NULL WHEN abs(v - b) < 0.02 THEN 'PARALLEL' WHEN abs(v - b) < 0.04 THEN 'TWIST' WHEN abs(v - b) < 0.06 THEN 'NOAGREE' WHEN v > b THEN 'II' ELSE 'III' END"
_N = "CASE WHEN abs(v - b) > 0.1 THEN 3 ELSE 2 END"


@q(
    [MK, RATIO, "x AS (SELECT *, lag(v, 1) OVER (PARTITION BY k ORDER BY t) b FROM r)", f"y AS (SELECT k, t, {_STATE} s, {_VOTE} w, {_N} n FROM x)"],
    "SELECT k, t, CASE WHEN s = 'CENTER' THEN 'NO_STATE' WHEN w IS NULL OR w = 'PARALLEL' THEN 'NO_INFO' WHEN w = 'TWIST' THEN 'TWIST' WHEN w = 'NOAGREE' OR w <> s THEN 'CONTRADICTS' WHEN n = 3 THEN 'STRONG' ELSE 'WEAK' END flag FROM y",
    k="string", t="bigint", flag="string",
)
def confidence_flags(spark, d):
    x = ratio(spark, d).withColumn("b", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    return x.withColumn("flag", L.confidence(F.expr(_STATE), F.expr(_VOTE), F.expr(_N)))


@q("", "SELECT r_name k, avg(b) mean, count(*) units FROM (SELECT c_nationkey n, CAST(avg(CAST(c_acctbal AS DOUBLE)) AS DOUBLE) b FROM customer GROUP BY 1) JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", k="string", mean="double", units="bigint")
def cluster_balance(spark, d):
    units = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("b"))
    placed = units.join(read(spark, d, "nation"), "n_nationkey").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return L.cluster_means(placed.withColumnRenamed("r_name", "k"), "k", "b")


@q([MONTHS, MK, "f AS (SELECT t FROM m WHERE v < (SELECT avg(v) FROM m))"], "SELECT k, count(f.t) flagged, count(*) periods FROM mk LEFT JOIN f ON mk.t = f.t GROUP BY k", k="string", flagged="bigint", periods="bigint")
def flagged_periods(spark, d):
    months = m(spark, d)
    flags = months.crossJoin(F.broadcast(months.agg(F.avg("v").alias("mean")))).where("v < mean")  # one row
    return L.flagged(mk(spark, d), ["k"], "t", flags)


@q([MK, RATIO], "SELECT k, t, NOT EXISTS (SELECT 1 FROM r p WHERE p.k = s.k AND p.v > 1.12 AND p.t BETWEEN s.t - 2 AND s.t + 4) is_false FROM r s WHERE s.v < 0.95", k="string", t="bigint", is_false="boolean")
def false_alarm_months(spark, d):
    x = ratio(spark, d)
    return L.false_alarms(x.where("v < 0.95").select("k", "t"), x.where("v > 1.12").select("k", "t"), ["k"], "t", -2, 4).withColumnRenamed("false", "is_false")
