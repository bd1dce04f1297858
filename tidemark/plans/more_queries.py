"""Queries of the state, composite, grid, vintage, audit and page operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import html as H
from ..operators import quality as Q
from ..operators import states as C
from ..operators import vintage as V
from ..operators.stats import correlation
from .base import MK, MN, M, m, mk, mn, read, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}


def q(ctes, body: str | None, **kinds: str):
    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(build(spark, sf_dir), **kinds)

        QUERIES[build.__name__] = run
        if body:
            ORACLES[build.__name__] = sql(ctes, body, **kinds)
        return build

    return add


@q("", "SELECT user_id u, event_type k, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY user_id) share FROM events GROUP BY 1, 2", u="bigint", k="string", n="bigint", share="double")
def state_distribution(spark, d):
    return C.distribution(read(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_type").alias("k")), ["u"], "k")


_WEIGHTS = [("BUILDING", 0.3), ("MACHINERY", 0.2), ("FURNITURE", 0.15), ("HOUSEHOLD", 0.15), ("AUTOMOBILE", 0.2)]
_Z = "z AS (SELECT k, t, (v - mu) / sd z FROM mk JOIN (SELECT k k2, avg(v) mu, stddev_samp(v) sd FROM mk WHERE t BETWEEN 23950 AND 23990 GROUP BY 1 HAVING count(*) >= 24 AND stddev_samp(v) > 0) ON k = k2)"


def _z(spark, d):
    return C.standardised(mk(spark, d), "k", 23950, 23990)


@q([MK, _Z, "w(k, w) AS (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in _WEIGHTS) + ")", "y AS (SELECT k, t, z FROM z WHERE NOT (t % 3 = 0 AND k IN ('BUILDING', 'MACHINERY')))"], "SELECT t, sum(w) share, CASE WHEN sum(w) >= 0.6 THEN sum(w * z) / sum(w) END score FROM y JOIN w USING (k) GROUP BY t", t="bigint", share="double", score="double")
def weighted_axis_cutoff(spark, d):
    rows = _z(spark, d).where("not (t % 3 = 0 and k in ('BUILDING', 'MACHINERY'))")
    return C.axis(rows, ["t"], "k", "z", spark.createDataFrame(_WEIGHTS, "k string, weight double"))


_AX = "ax AS (SELECT a.t, a.z a, b.z b FROM z a JOIN z b ON a.t = b.t AND a.k = 'BUILDING' AND b.k = 'MACHINERY')"


def _axes(spark, d):
    z = _z(spark, d)
    return z.where("k = 'BUILDING'").select("t", F.col("z").alias("a")).join(z.where("k = 'MACHINERY'").select("t", F.col("z").alias("b")), "t")


_QUAD = "CASE WHEN a IS NULL OR b IS NULL THEN 'ANOMALY' WHEN abs(a) < {x} OR abs(b) < {y} THEN 'CENTER' WHEN a > 0 AND b <= 0 THEN 'I' WHEN a > 0 THEN 'II' WHEN b <= 0 THEN 'III' ELSE 'IV' END"
_SHAPE = "CASE WHEN abs(b - a) < 0.3 THEN 'PARALLEL' WHEN (a + b) / 2 <= 0 AND b < a THEN 'I' WHEN (a + b) / 2 <= 0 AND b > a THEN 'II' WHEN (a + b) / 2 > 0 AND b < a THEN 'III' ELSE 'IV' END"


@q([MK, _Z, _AX], "SELECT t, " + _QUAD.format(x="0.5", y="0.6") + " s FROM ax", t="bigint", s="string")
def quadrant_states(spark, d):
    return _axes(spark, d).withColumn("s", C.quadrant(F.col("a"), F.col("b"), 0.5, 0.6))


@q([MK, _Z, _AX], "SELECT t, " + _SHAPE + " s FROM ax", t="bigint", s="string")
def curve_shapes(spark, d):
    return _axes(spark, d).withColumn("s", C.curve_shape(F.col("a"), F.col("b"), 0.3))


_QS = [0.2, 0.3, 0.4, 0.5, 0.6]


@q([MK, _Z, _AX, "th AS (" + " UNION ALL ".join(f"SELECT {x} q, quantile_cont(abs(a), {x}) ta, quantile_cont(abs(b), {x}) tb FROM ax" for x in _QS) + ")", "ce AS (SELECT q, ta, tb, avg(CASE WHEN " + _QUAD.format(x="ta", y="tb") + " = 'CENTER' THEN 1.0 ELSE 0.0 END) cs FROM ax, th GROUP BY 1, 2, 3)"], "SELECT q, ta theta_a, tb theta_b, cs centre_share, row_number() OVER (ORDER BY abs(cs - 0.2), q) = 1 chosen FROM ce", q="double", theta_a="double", theta_b="double", centre_share="double", chosen="boolean")
def theta_grid_calibration(spark, d):
    return C.theta_grid(_axes(spark, d), "a", "b", _QS, 0.2)


@q([MK, _Z, _AX, "s AS (SELECT * FROM (SELECT " + _QUAD.format(x="0.2", y="0.2") + " qa, " + _SHAPE + " sb FROM ax) WHERE qa IN ('I', 'II', 'III', 'IV') AND sb IN ('I', 'II', 'III', 'IV'))"], "SELECT n, o observed, CASE WHEN n > 0 THEN e / (n * n) END expected, o / nullif(e / (n * n), 0) lift FROM (SELECT count(*) n, avg(CASE WHEN qa = sb THEN 1.0 ELSE 0.0 END) o FROM s), (SELECT coalesce(CAST(sum(x.n * y.n) AS DOUBLE), 0) e FROM (SELECT qa k, count(*) n FROM s GROUP BY 1) x JOIN (SELECT sb k, count(*) n FROM s GROUP BY 1) y USING (k))", n="bigint", observed="double", expected="double", lift="double")
def coherence_lift(spark, d):
    x = _axes(spark, d)
    return C.coherence(x.select(C.quadrant(F.col("a"), F.col("b"), 0.2, 0.2).alias("qa"), C.curve_shape(F.col("a"), F.col("b"), 0.3).alias("sb")), "qa", "sb")


_LATE = "zl AS (SELECT * FROM z WHERE NOT (k = 'FURNITURE' AND t < 23960))"


def _late(spark, d):
    return _z(spark, d).where("not (k = 'FURNITURE' and t < 23960)")


@q([MK, _Z, _LATE], "SELECT t, avg(z) c FROM zl GROUP BY t HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM zl)", t="bigint", c="double")
def composite_balanced(spark, d):
    return C.composite_balanced(_late(spark, d), "k")


@q([MK, _Z, _LATE], "SELECT t, sum(s) OVER (ORDER BY t) c FROM (SELECT a.t, avg(a.z - b.z) s FROM zl a JOIN zl b ON a.k = b.k AND a.t = b.t + 1 GROUP BY 1)", t="bigint", c="double")
def composite_chain(spark, d):
    return C.composite_chain(_late(spark, d), "k")


@q([MK, _Z, _LATE], "SELECT t, members FROM (SELECT t, m members, lag(m) OVER (ORDER BY t) b FROM (SELECT t, string_agg(DISTINCT k, '|' ORDER BY k) m FROM zl GROUP BY t)) WHERE b IS NULL OR b <> members", t="bigint", members="string")
def composition_changes(spark, d):
    return C.composite_members(_late(spark, d), "k")


_CELLS = [(w, x) for w in (0.2, 0.5, 1.0) for x in (-1, 1)]


@q([MK, _Z, "cf(w, x) AS (VALUES " + ", ".join(f"({w}::DOUBLE, {x})" for w, x in _CELLS) + ")", "ce AS (SELECT w, x, sum(CASE WHEN z * x > w THEN 1 ELSE 0 END) hits, count(*) n FROM z, cf GROUP BY 1, 2)"], "SELECT w, x, sum(hits) hits, sum(n) n, grouping(w) all_w, grouping(x) all_x FROM ce GROUP BY GROUPING SETS ((w, x), (w), (x), ())", w="double", x="int", hits="bigint", n="bigint", all_w="bigint", all_x="bigint")
def grid_sensitivity(spark, d):
    return C.definition_grid(_z(spark, d), spark.createDataFrame(_CELLS, "w double, x int"), ["w", "x"], F.col("z") * F.col("x") > F.col("w"))


_VT = "vt AS (SELECT obs, vintage, CAST(sum(s) OVER (PARTITION BY obs ORDER BY vintage) AS DOUBLE) v FROM (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) obs, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) vintage, sum(CAST(l_extendedprice AS DECIMAL(18,2))) s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))"


def _vintages(spark, d):
    x = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = x.groupBy(S.month_index(F.col("o_orderdate")).alias("obs"), S.month_index(F.col("l_shipdate")).alias("vintage")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    return by.select("obs", "vintage", F.sum("s").over(Window.partitionBy("obs").orderBy("vintage")).cast("double").alias("v"))


@q([_VT], "SELECT obs, arg_max(v, vintage) v, max(vintage) vintage FROM vt WHERE vintage <= 23990 GROUP BY obs", obs="bigint", v="double", vintage="bigint")
def vintage_as_of(spark, d):
    return V.as_of(_vintages(spark, d), [], 23990)


@q([_VT], "SELECT obs, arg_min(v, vintage) v, min(vintage) vintage FROM vt GROUP BY obs", obs="bigint", v="double", vintage="bigint")
def first_publication(spark, d):
    return V.first_published(_vintages(spark, d), [])


@q([_VT], "SELECT vintage, obs, v, b before FROM (SELECT *, lead(v) OVER (PARTITION BY vintage ORDER BY obs DESC) b, row_number() OVER (PARTITION BY vintage ORDER BY obs DESC) rn FROM vt) WHERE rn = 1", vintage="bigint", obs="bigint", v="double", before="double")
def vintage_edge(spark, d):
    return V.edge(_vintages(spark, d), [])


@q([_VT], "SELECT obs, min(vintage) seen, min(vintage) - obs lag FROM vt WHERE v > 1000000 GROUP BY obs", obs="bigint", seen="bigint", lag="bigint")
def recognition_lag(spark, d):
    return V.recognition_lag(_vintages(spark, d), [], F.col("v") > 1000000)


@q([_VT], "SELECT vintage // 12 AS year, min(vintage) vintage FROM vt GROUP BY 1", year="bigint", vintage="bigint")
def first_vintage_of_year(spark, d):
    return V.first_vintage_of_year(_vintages(spark, d), F.floor(F.col("vintage") / 12))


@q([MN], "SELECT k, t FROM (SELECT k, unnest(generate_series(min(t), max(t))) t FROM mn GROUP BY k) WHERE (k, t) NOT IN (SELECT (k, t) FROM mn)", k="string", t="bigint")
def calendar_holes(spark, d):
    return Q.holes(mn(spark, d), ["k"])


@q("", "SELECT o_custkey c, CAST(o_orderdate AS DATE) AS dy, count(*) n FROM orders GROUP BY 1, 2 HAVING count(*) > 1", c="bigint", dy="date", n="bigint")
def duplicate_dates(spark, d):
    return Q.duplicates(read(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("dy")), ["c", "dy"])


@q([MN], "SELECT k, count(v) n, count(v) >= 70 enough, min(t) <= 23945 early, max(t) >= 24018 fresh, count(v) = count(*) complete, count(DISTINCT CASE WHEN rn <= 12 THEN v END) > 1 moving FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v IS NULL, t DESC) rn FROM mn) GROUP BY k", k="string", n="bigint", enough="boolean", early="boolean", fresh="boolean", complete="boolean", moving="boolean")
def series_quality(spark, d):
    return Q.series_checks(mn(spark, d), ["k"], "t", "v", 70, 23945, 24018)


@q([M], "SELECT a.t origin, b.t source FROM m a JOIN m b ON b.t BETWEEN a.t - 2 AND a.t + 1 WHERE b.t > a.t", origin="bigint", source="bigint")
def leaked_sources(spark, d):
    x = m(spark, d).select("t")
    reach = x.select(F.col("t").alias("source"), F.explode(F.sequence(F.col("t") - 1, F.col("t") + 2)).alias("origin"))
    points = x.select(F.col("t").alias("origin")).join(reach, "origin").withColumn("available", F.col("source"))
    return Q.late_sources(points, "origin", "source", "available")


@q(["pr AS (SELECT o_orderkey k, CAST(floor(CAST(o_totalprice AS DOUBLE)) + o_orderkey % 3 AS BIGINT) p, CAST(o_totalprice AS DOUBLE) x, o_orderkey % 2 = 0 two FROM orders)"], "SELECT k, abs(CASE WHEN two THEN p + CAST(0.25 AS DOUBLE) ELSE p END - x) <= CASE WHEN two THEN 0.005::DOUBLE ELSE 0.5::DOUBLE END + 1e-12::DOUBLE ok FROM pr", k="bigint", ok="boolean")
def printed_numbers(spark, d):
    """Totals printed without places or with two, some of them off."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("x"))
    whole = (F.floor("x") + F.col("k") % 3).cast("bigint").cast("string")
    return o.select("k", Q.printed_matches(F.when(F.col("k") % 2 == 0, F.concat(whole, F.lit(".25"))).otherwise(whole), F.col("x")).alias("ok"))


@q("", "SELECT page_id p, len(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1, 'i')) links, len(regexp_extract_all(html, '<p[\\s>]', 0, 'i')) paragraphs FROM pages", p="bigint", links="bigint", paragraphs="bigint")
def html_counts(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("p"), F.size(H.links(F.col("html"))).alias("links"), H.tag_count(F.col("html"), "p").alias("paragraphs"))


@q("", "SELECT h, count(*) n FROM (SELECT unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1, 'i')) h FROM pages) WHERE h NOT IN (SELECT url FROM pages) GROUP BY h", h="string", n="bigint")
def html_links_broken(spark, d):
    pages = read(spark, d, "pages")
    found = pages.select(F.explode(H.links(F.col("html"))).alias("h"))
    return Q.broken_references(found, pages, "h", "url").groupBy("h").agg(F.count("*").alias("n"))


@q("", "SELECT doc_id d, len(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?')) n FROM documents WHERE text IS NOT NULL", d="bigint", n="bigint")
def number_tokens(spark, d):
    return read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("d"), F.size(H.number_tokens(F.col("text"))).alias("n"))


@q("", None, p="bigint", words="bigint", double_words="bigint", double_spaces="bigint", stray_tags="bigint", space_before_mark="bigint", control_bytes="bigint", brace_balance="bigint")
def page_defects(spark, d):
    x = H.defects(read(spark, d, "pages"), "html").withColumn("words", F.size(F.split(H.visible_text(F.col("html")), " ")))
    return x.withColumnRenamed("page_id", "p")


@q([MK, "w AS (SELECT t, k, v, row_number() OVER (PARTITION BY k ORDER BY abs(v - mu) DESC, t) rk FROM (SELECT *, avg(v) OVER (PARTITION BY k) mu FROM mk))", "b AS (SELECT t, v b FROM mk WHERE k = 'BUILDING')"], "SELECT k, covar_samp(v, b) / nullif(stddev_samp(v) * stddev_samp(b), 0) r FROM w JOIN b USING (t) WHERE rk > 2 GROUP BY k", k="string", r="double")
def leverage_trim(spark, d):
    x = mk(spark, d)
    whole = Window.partitionBy("k")
    far = F.row_number().over(whole.orderBy(F.desc(F.abs(F.col("v") - F.col("mu"))), "t"))
    trimmed = x.withColumn("mu", F.avg("v").over(whole)).withColumn("rank", far).where("rank > 2")
    return trimmed.join(x.where("k = 'BUILDING'").select("t", F.col("v").alias("b")), "t").groupBy("k").agg(correlation("v", "b").alias("r"))
