"""Queries of formulas and their liveness, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as R
from .base import MK, mk, read, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}

FORMULAS = {
    "share": "100 * {orders} / ({orders} + {customers})",
    "spread": "max({monthly[*]}) - min({monthly[*]})",
    "middle": "mean({monthly[*]}) / 7",
    "width": "sd({monthly[*]}) / 1000",
    "root": "round(sqrt({orders}), 2)",
    "zero": "0 * {orders} + {customers}",
    "steps": "floor({orders} / 1000) + ceil({customers} / 1000)",
    "normal": "Phi(log({orders} / {customers}) - 2)",
    "months": "len({monthly[*]})",
    "together": "corr({monthly[*]}, {monthly[*]})",
    "power": "({orders} / {customers}) ** 2 - exp(-abs({customers}) / 100)",
    "most": "max({orders}, {customers}, 10)",
}
PLACES = {n: 1 for n in FORMULAS} | {"share": 3, "root": 2, "power": 3, "normal": 4}


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


_SHIFT = "1.3::DOUBLE + 0.7::DOUBLE * sin(3.1::DOUBLE * {i} + 1.0::DOUBLE)"
_DATA = [
    MK,
    "oc AS (SELECT c_mktsegment k, CAST(count(*) AS DOUBLE) o, CAST(count(DISTINCT o_custkey) AS DOUBLE) c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)",
    "vs AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t) - 1 i FROM mk)",
    f"al AS (SELECT oc.k, field, o + CASE WHEN field = 'orders' THEN {_SHIFT.format(i='0')} ELSE 0 END o, c + CASE WHEN field = 'customers' THEN {_SHIFT.format(i='0')} ELSE 0 END c FROM oc, (SELECT unnest(['', 'orders', 'customers', 'monthly']) field))",
    f"ms AS (SELECT k, field, max(v) - min(v) spread, avg(v) middle, stddev_samp(v) width, count(v) AS months FROM (SELECT k, field, v + CASE WHEN field = 'monthly' THEN {_SHIFT.format(i='i')} ELSE 0 END v FROM vs, (SELECT unnest(['', 'orders', 'customers', 'monthly']) field)) GROUP BY 1, 2)",
]
# the normal distribution function by its series: z + z ** 3 / 3 + z ** 5 / (3 * 5) + ...
_PHI = "(SELECT 0.5 + s / sqrt(2 * pi()) * exp(-{z} * {z} / 2) FROM (SELECT list_sum(list_transform(generate_series(0, 60), lambda n: pow({z}, 2 * n + 1) / list_product(list_transform(generate_series(0, n), lambda j: CAST(2 * j + 1 AS DOUBLE))))) s))"
_ALL = {
    "share": "100 * o / (o + c)", "spread": "spread", "middle": "middle / 7", "width": "width / 1000", "root": "round(sqrt(o), 2)", "zero": "0 * o + c",
    "steps": "floor(o / 1000) + ceil(c / 1000)", "normal": _PHI.format(z="(ln(o / c) - 2)"), "months": "CAST(months AS DOUBLE)", "together": "1.0::DOUBLE",
    "power": "pow(o / c, 2) - exp(-abs(c) / 100)", "most": "greatest(o, c, 10)",
}
_VALUES = "va AS (SELECT k, field, " + ", ".join(f"{x} AS {n}" for n, x in _ALL.items()) + " FROM al JOIN ms USING (k, field))"


def _fields(spark, d):
    x = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = x.groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))
    lists = mk(spark, d).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda z: z["v"]).alias("monthly"))  # a number a month
    return counts.join(lists, "k")


@q([*_DATA, _VALUES], "SELECT k, " + ", ".join(FORMULAS) + " FROM va WHERE field = ''", k="string", **dict.fromkeys(FORMULAS, "double"))
def formula_values(spark, d):
    return R.evaluate(_fields(spark, d), FORMULAS)


_READS = "CASE formula " + " ".join(f"WHEN '{n}' THEN field IN ({', '.join(repr(f) for f, _ in R.fields(t))})" for n, t in FORMULAS.items()) + " END"
_MOVED = " UNION ALL ".join(f"SELECT a.k, a.field, '{n}' formula, abs(a.{n} - b.{n}) > 0.5::DOUBLE * pow(10.0::DOUBLE, -{PLACES[n]}) moved FROM va a JOIN va b ON a.k = b.k AND b.field = '' WHERE a.field <> ''" for n in FORMULAS)


@q([*_DATA, _VALUES], f"SELECT *, reads AND NOT moved dead FROM (SELECT *, {_READS} reads FROM ({_MOVED}))", k="string", field="string", formula="string", reads="boolean", moved="boolean", dead="boolean")
def formula_liveness(spark, d):
    return R.liveness(_fields(spark, d), ["k"], FORMULAS, PLACES)
