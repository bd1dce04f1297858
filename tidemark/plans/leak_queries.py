"""Queries of provenance and leaks, with their SQL: sets of sources are lists there, compared member by member."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as P
from .base import MK, mk, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}
HORIZON, WINDOW, LEAST = 12, 12, 24


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


_POINTS = [
    MK,
    "s0 AS (SELECT k, t, v, CAST(row_number() OVER w - 1 AS BIGINT) i, ln(v / lag(v) OVER w) step FROM mk WINDOW w AS (PARTITION BY k ORDER BY t))",
    f"p AS (SELECT k, t, i, 100 * ln(v / lag(v, {HORIZON}) OVER w) annual, CASE WHEN count(step) OVER n = {WINDOW} THEN sqrt(12.0) * stddev_samp(step) OVER n * 100 END vol FROM s0 WINDOW w AS (PARTITION BY k ORDER BY t), n AS (PARTITION BY k ORDER BY t ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))",
]
_LEAKS = f"lk(leak, off, wref, wcen, fut) AS (VALUES ('L0', 0, false, false, false), ('L1', 1, false, false, false), ('L2', {HORIZON - 1}, false, false, false), ('L3', 0, true, false, false), ('L4', 0, false, true, false), ('L5', 0, false, false, true))"
_OWN = "(SELECT list(z.i ORDER BY z.i) FROM p z WHERE z.k = o.k AND {})"
_SETS = [
    _LEAKS,
    f"st AS (SELECT o.k, o.i, leak, coalesce({_OWN.format('z.annual IS NOT NULL AND z.i <= o.i + off')}, []) en, coalesce({_OWN.format(f'z.i BETWEEN o.i + CASE WHEN fut THEN {HORIZON} ELSE 0 END - {WINDOW - 1} AND o.i + CASE WHEN fut THEN {HORIZON} ELSE 0 END')}, []) re, coalesce({_OWN.format('z.vol IS NOT NULL AND z.i <= o.i')}, []) rf, coalesce({_OWN.format(f'z.annual IS NOT NULL AND z.i = o.i + {HORIZON}')}, []) ou FROM p o, lk)",
    f"au AS (SELECT k, i, leak, concat_ws(',', CASE WHEN en <> generate_series({HORIZON}, i) THEN 'ensemble' END, CASE WHEN list_max(en) > i THEN 'ensemble sources' END, CASE WHEN re <> generate_series(i - {WINDOW - 1}, i) THEN 'recent' END, CASE WHEN list_max(re) > i THEN 'recent sources' END, CASE WHEN rf <> generate_series({WINDOW}, i) THEN 'reference' END, CASE WHEN ou <> [i + {HORIZON}] THEN 'outcome' END) failed FROM st)",
]
_SCORES = [
    f"og AS (SELECT p.*, leak, off, wcen, lead(annual, {HORIZON}) OVER w y, CASE WHEN fut THEN lead(vol, {HORIZON}) OVER w ELSE vol END / CASE WHEN wref THEN avg(vol) OVER o ELSE avg(vol) OVER (w ROWS UNBOUNDED PRECEDING) END sc, avg(annual) OVER o whole FROM p, lk WINDOW w AS (PARTITION BY k, leak ORDER BY i), o AS (PARTITION BY k, leak))",
    "pr AS (SELECT g.k, g.leak, g.i, y, sc, CASE WHEN wcen THEN whole ELSE avg(z.annual) OVER e END ce, avg(z.annual) OVER e mean, z.annual x, row_number() OVER (PARTITION BY g.k, g.leak, g.i ORDER BY z.annual, z.i) r, count(*) OVER e n FROM og g JOIN p z ON z.k = g.k AND z.annual IS NOT NULL AND z.i <= g.i + off WHERE y IS NOT NULL AND sc IS NOT NULL WINDOW e AS (PARTITION BY g.k, g.leak, g.i))",
    f"cs AS (SELECT k, leak, i, avg(abs(b - y)) - sum((2 * r - n - 1) * b) / any_value(n) / any_value(n) base, avg(abs(c - y)) - sum((2 * r - n - 1) * c) / any_value(n) / any_value(n) price FROM (SELECT *, x + ce - mean b, ce + sc * (x - ce) c FROM pr) WHERE i >= {LEAST} GROUP BY 1, 2, 3)",
]


def points(spark, d):
    return P.measured(mk(spark, d), ["k"], "t", "v", HORIZON, WINDOW)


@q([*_POINTS, *_SETS], "SELECT k, leak, i, failed FROM au", k="string", leak="string", i="bigint", failed="string")
def information_audit(spark, d):
    """All origins under all leaks; those too near the ends fail for want of months."""
    p, out = points(spark, d), None
    for leak in P.leaks(HORIZON):
        one = P.audit(P.information_set(p, ["k"], HORIZON, WINDOW, leak), HORIZON, WINDOW).select("k", F.lit(leak.name).alias("leak"), "i", F.array_join("failed", ",").alias("failed"))
        out = one if out is None else out.unionByName(one)
    return out


@q(
    [*_POINTS, *_SETS, *_SCORES],
    "SELECT k, leak, count(*) origins, count(*) FILTER (WHERE failed <> '') caught, min(i) FILTER (WHERE failed <> '') first_origin, arg_min(failed, i) FILTER (WHERE failed <> '') failed, avg(h.base - s.base) base_gain, avg(s.base - s.price) delta FROM cs s JOIN (SELECT k, i, base FROM cs WHERE leak = 'L0') h USING (k, i) JOIN au USING (k, leak, i) GROUP BY k, leak",
    k="string", leak="string", origins="bigint", caught="bigint", first_origin="bigint", failed="string", base_gain="double", delta="double",
)
def leak_report(spark, d):
    return P.leak_report(points(spark, d), ["k"], HORIZON, WINDOW, LEAST)
