"""Queries of orders across episodes, with their SQL.  An episode is a year, a link a nation, a block its region; a link turns in the month of its greatest revenue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import order as R
from .base import MK, MN, mk, mn, read, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}
LAG = 6


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


_LEADS = [
    MK,
    f"lp AS (SELECT x.k a, y.k b, h, covar_samp(x.v, y.v) / nullif(stddev_samp(x.v) * stddev_samp(y.v), 0) r FROM mk x JOIN mk y ON x.k < y.k, generate_series(-{LAG}, {LAG}) g(h) WHERE y.t = x.t + h GROUP BY 1, 2, 3)",
    "be AS (SELECT a, b, h, r FROM lp WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY r DESC, h) = 1)",
    "le AS (SELECT a i, b j, h ld, r FROM be UNION ALL SELECT b, a, -h, r FROM be)",
]
_TURNS = [MN, "tu AS (SELECT t // 12 y, k, n_nationkey nk, n_regionkey g, t FROM (SELECT *, row_number() OVER (PARTITION BY k, t // 12 ORDER BY v DESC, t) rn FROM mn) JOIN nation ON n_name = k WHERE rn = 1)"]


def _rank(keys: str, v: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2"


def turns(spark, d):
    year = F.floor(F.col("t") / 12).cast("bigint")
    top = mn(spark, d).withColumn("y", year).withColumn("rn", F.row_number().over(Window.partitionBy("k", "y").orderBy(F.desc("v"), "t"))).where("rn = 1")
    return top.join(read(spark, d, "nation").select(F.col("n_name").alias("k"), F.col("n_nationkey").cast("string").alias("nk"), F.col("n_regionkey").cast("bigint").alias("g")), "k").select("y", "k", "nk", "g", "t")


@q(_LEADS, "SELECT i, j, ld AS lead_months, r, (SELECT avg(ld) FROM le z WHERE z.i = le.i) score FROM le", i="string", j="string", lead_months="bigint", r="double", score="double")
def lead_matrix(spark, d):
    leads = R.peak_leads(mk(spark, d), "k", LAG)
    return leads.join(R.lead_scores(leads), "i").withColumnRenamed("lead", "lead_months")


@q(_LEADS, "SELECT count(*) triples, count(*) FILTER (WHERE z.ld < 0) violations, count(*) FILTER (WHERE z.ld < 0) / nullif(count(*), 0) rate FROM le x JOIN le y ON x.j = y.i AND x.i <> y.j JOIN le z ON z.i = x.i AND z.j = y.j WHERE x.ld > 0 AND y.ld > 0", triples="bigint", violations="bigint", rate="double")
def lead_transitivity(spark, d):
    return R.transitivity(R.peak_leads(mk(spark, d), "k", LAG))


@q([*_TURNS, f"pa AS (SELECT x.y a, z.y b, {_rank('x.y, z.y', 'x.t')} ra, {_rank('x.y, z.y', 'z.t')} rb FROM tu x JOIN tu z ON x.k = z.k AND x.y < z.y)"], "SELECT a, b, count(*) n, covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) rho FROM pa GROUP BY 1, 2 HAVING count(*) >= 4", a="bigint", b="bigint", n="bigint", rho="double")
def episode_agreement(spark, d):
    return R.agreement(turns(spark, d), "y", "k", "t")


@q([*_TURNS, f"ra AS (SELECT k, 1 + ({_rank('y', 't')} - 1) * 24.0::DOUBLE / greatest(count(*) OVER (PARTITION BY y) - 1, 1) w FROM tu)"], "SELECT k, quantile_cont(w, 0.5) AS median, count(*) episodes, max(w) - min(w) spread FROM ra GROUP BY k", k="string", median="double", episodes="bigint", spread="double")
def median_link_ranks(spark, d):
    return R.median_ranks(turns(spark, d), "y", "k", "t", 25)


@q([*_TURNS, "md AS (SELECT y, g, quantile_cont(t, 0.5) m FROM tu GROUP BY 1, 2)", f"rk AS (SELECT *, {_rank('y', 'm')} rm, {_rank('y', 'g')} rp, lag(m) OVER (PARTITION BY y ORDER BY g) > m late FROM md)"], "SELECT y, count(*) blocks, covar_samp(rm, rp) / nullif(stddev_samp(rm) * stddev_samp(rp), 0) rho, NOT bool_or(coalesce(late, false)) exact FROM rk GROUP BY y HAVING count(*) >= 4", y="bigint", blocks="bigint", rho="double", exact="boolean")
def block_order(spark, d):
    declared = read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("g"), F.col("r_regionkey").alias("place"))
    return R.block_order(turns(spark, d), "y", "g", "t", declared, "place")


@q(_TURNS, "SELECT y, f flow_t, s stock_t, s - f months_ahead, f < s is_first FROM (SELECT y, max(t) FILTER (WHERE nk = 6) f, max(t) FILTER (WHERE nk = 7) s FROM tu GROUP BY y) WHERE s IS NOT NULL", y="bigint", flow_t="bigint", stock_t="bigint", months_ahead="bigint", is_first="boolean")
def flow_before_stock(spark, d):
    return R.precedence(turns(spark, d), "y", "nk", "t", "6", "7").withColumnsRenamed({"lead": "months_ahead", "first": "is_first"})
