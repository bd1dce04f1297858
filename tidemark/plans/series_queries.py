"""Queries of the series, join and statistics operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import series as W
from ..operators import stats as T
from .base import MK, MN, M, m, mk, mn, read, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None, **kinds: str):
    """Registers a builder under its name, with its columns shaped and its SQL."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(build(spark, sf_dir), **kinds)

        QUERIES[build.__name__] = run
        if oracle:
            ORACLES[build.__name__] = oracle
        return build

    return add


def q(ctes, body: str, **kinds: str):
    return query(sql(ctes, body, **kinds), **kinds)


# --- scalars -------------------------------------------------------------

#: Masks of a number's text, by order key modulo their number: as it is, with commas, words for none, letters behind, a percent sign, an exponent, white space, no digits before the point.
_NUMBERS = [("CAST(x AS STRING)", "CAST(x AS VARCHAR)", "x"), ("format_number(x, 2)", "format('{:,.2f}', x)", "x"), ("'NA'", "'NA'", "NULL"), ("concat(k, 'd')", "k || 'd'", "NULL"), ("concat(k, 'F')", "k || 'F'", "NULL"), ("concat(k, '%')", "k || '%'", "NULL"), ("concat(' -', k, 'e1 ')", "' -' || k || 'e1 '", "-10.0::DOUBLE * k"), ("concat('.', k % 1000 + 1000)", "'.' || (k % 1000 + 1000)", "TRY_CAST('.' || (k % 1000 + 1000) AS DOUBLE)"), ("concat(k, '.')", "k || '.'", "CAST(k AS DOUBLE)"), ("'-'", "'-'", "NULL")]


@q(["o AS (SELECT o_orderkey k, CAST(o_totalprice AS DOUBLE) x FROM orders)"], f"SELECT k, CASE k % {len(_NUMBERS)} " + " ".join(f"WHEN {i} THEN {v}" for i, (_, _, v) in enumerate(_NUMBERS)) + " END v FROM o", k="bigint", v="double")
def lenient_cast(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("x"))
    text = F.expr(f"CASE k % {len(_NUMBERS)} " + " ".join(f"WHEN {i} THEN {t}" for i, (t, _, _) in enumerate(_NUMBERS)) + " END")
    return o.select("k", S.lenient_double(text).alias("v"))


#: Masks of a date's text and what they give, by order key modulo their number.
_DATES = [("yyyy-MM-dd", "o"), ("MM/dd/yyyy", "o"), ("dd-MMM-yyyy", "o"), ("d MMM yyyy", "o"), ("yyyy-MM", "m"), ("yyyyMMdd", "o"), ("yyyy:MM:dd", "o"), ("yyyy:MM", "m"), ("yyyy'M'MM", "m"), ("yyyyMM", "m"), ("MMM-yy", "m"), ("'no date' yyyy", "NULL"), ("yyyy", "NULL"), ("yyyy-13-dd", "NULL")]


@q(["o AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) o, CAST(date_trunc('month', o_orderdate) AS DATE) m FROM orders)"], f"SELECT k, CAST(CASE k % {len(_DATES)} " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(_DATES)) + " END AS DATE) v FROM o", k="bigint", v="date")
def lenient_date(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("o"))
    text = F.coalesce(*[F.when(F.col("k") % len(_DATES) == i, F.date_format("o", mask)) for i, (mask, _) in enumerate(_DATES)])
    return o.select("k", S.lenient_date(text).alias("v"))


@q("", "SELECT o_orderkey k, CAST(o_orderdate AS DATE) - 9000 v, CAST(date_trunc('month', o_orderdate) AS DATE) w FROM orders", k="bigint", v="date", w="date")
def epoch_and_decimal_dates(spark, d):
    """Dates as seconds since 1970, some before it, and as numbers YYYY.MM."""
    day = F.to_date("o_orderdate")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ((F.unix_date(day) - 9000).cast("long") * 86400 + F.col("o_orderkey") % 86400).alias("s"), (F.year(day) + F.month(day) / 100).alias("x"))
    return o.select("k", S.epoch_date(F.col("s")).alias("v"), S.decimal_month(F.col("x")).alias("w"))


@q("", "SELECT DISTINCT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) qi, CAST(date_trunc('month', o_orderdate) AS DATE) mo, least(CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH + INTERVAL 30 DAY AS DATE), last_day(CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH AS DATE))) av, CAST(date_trunc('month', o_orderdate) AS DATE) <= DATE '1997-06-30' AND last_day(CAST(o_orderdate AS DATE)) >= DATE '1997-03-01' hit FROM orders", qi="bigint", mo="date", av="date", hit="boolean")
def calendar_functions(spark, d):
    o = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("o"))
    return o.select(S.quarter_index(F.col("o")).alias("qi"), S.month_date(S.month_index(F.col("o"))).alias("mo"), S.available_date(F.col("o"), 2, 31).alias("av"), S.overlaps(F.trunc("o", "MM"), F.last_day("o"), "1997-03-01", "1997-06-30").alias("hit")).distinct()


@q(MK, "SELECT k, sha256(string_agg(CAST(t AS VARCHAR) || ',' || printf('%.6f', v), chr(10) ORDER BY t)) digest FROM mk GROUP BY k", k="string", digest="string")
def series_digests(spark, d):
    return mk(spark, d).groupBy("k").agg(S.series_digest(F.col("t"), F.col("v")).alias("digest"))


@q("", "SELECT user_id u, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) k FROM events GROUP BY 1", u="bigint", k="double")
def json_path_mean(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("u")).agg(F.avg(F.get_json_object("props", "$.k").cast("double")).alias("k"))


# --- projections and aggregates ---------------------------------------------


@q(MN, "SELECT k, min(t) first_t, arg_min(v, t) first_v, max(t) last_t, arg_max(v, t) last_v FROM mn WHERE t BETWEEN 23946 AND 24000 GROUP BY k", k="string", first_t="bigint", first_v="double", last_t="bigint", last_v="double")
def series_bounds(spark, d):
    return W.bounds(W.between(mn(spark, d), "t", 23946, 24000), ["k"], "t", "v")


@q("", "SELECT event_type k, CAST(date_trunc('week', ts) AS DATE) t, avg(value) mean, arg_max(value, ts) last, count(DISTINCT CAST(ts AS DATE)) AS days, bool_or(value < 0) any_negative FROM events GROUP BY 1, 2", k="string", t="date", mean="double", last="double", days="bigint", any_negative="boolean")
def resample_weeks(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("k"), "ts", "value")
    return W.resample(e, ["k"], F.to_date(F.date_trunc("week", "ts")), "ts", "value")


@q(MN, "SELECT k, t // 3 q, avg(v) v FROM mn GROUP BY 1, 2 HAVING count(*) = 3", k="string", q="bigint", v="double")
def quarter_mean_complete(spark, d):
    return W.quarter_mean(mn(spark, d), ["k"])


@q("", "SELECT c_nationkey k, avg(c_acctbal) mean, stddev_samp(c_acctbal) sd, stddev_pop(c_acctbal) sp, quantile_cont(c_acctbal, 0.05) p05, quantile_cont(c_acctbal, 0.5) p50, mad(c_acctbal) mad, list_sort(list(c_acctbal))[CAST(floor(0.9 * (count(*) - 1)) AS INT) + 1] p90 FROM customer GROUP BY 1", k="bigint", mean="double", sd="double", sp="double", p05="double", p50="double", mad="double", p90="double")
def spread_statistics(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    base = c.groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.stddev_pop("x").alias("sp"), F.percentile("x", F.lit(0.05)).alias("p05"), F.median("x").alias("p50"), F.array_sort(F.collect_list("x")).alias("a"))
    base = base.withColumn("p90", F.get("a", F.floor(F.lit(0.9) * (F.size("a") - 1)).cast("int")))
    return base.withColumn("mad", W.median_of_sorted(F.array_sort(F.transform("a", lambda x: F.abs(x - F.col("p50"))))))


@q("", "SELECT u, event_type k FROM (SELECT user_id u, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END) rn FROM events GROUP BY 1, 2) WHERE rn = 1", u="bigint", k="string")
def mode_with_tie_order(spark, d):
    from ..operators.states import mode

    return mode(read(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_type").alias("k")), ["u"], "k", ["purchase", "signup", "click", "view", "error"])


# --- windows ------------------------------------------------------------------


@q(MN, "SELECT a.k, a.t, 100 * ln(a.v / b.v) change FROM mn a JOIN mn b ON a.k = b.k AND b.t = a.t - 12 WHERE a.v > 0 AND b.v > 0", k="string", t="bigint", change="double")
def yoy_log_change(spark, d):
    return W.log_change(mn(spark, d), ["k"], 12)


@q(MN, "SELECT k, t, v - lag(v, 3) OVER (PARTITION BY k ORDER BY t) change FROM mn", k="string", t="bigint", change="double")
def positional_change(spark, d):
    return W.positional_change(mn(spark, d), ["k"], 3)


@q(MN, "SELECT k, t, CASE WHEN count(v) OVER w = 6 THEN avg(v) OVER w END mean, CASE WHEN count(v) OVER c = 3 THEN avg(v) OVER c END smooth FROM mn WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), c AS (PARTITION BY k ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)", k="string", t="bigint", mean="double", smooth="double")
def moving_means(spark, d):
    return W.centred_mean(W.trailing_mean(mn(spark, d), ["k"], 6), ["k"])


_DAILY = "dl AS (SELECT c_mktsegment k, CAST(o_orderdate AS DATE) AS day, CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@q([_DAILY, "r AS (SELECT k, day, v, v - lag(v, 5) OVER (PARTITION BY k ORDER BY day) raw FROM dl)", "s AS (SELECT *, mad(raw) OVER w sc, count(raw) OVER w n FROM r WHERE raw IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY day RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND CURRENT ROW))"], "SELECT k, day, greatest(-3, least(3, raw / (1.4826 * nullif(sc, 0)))) / 3 speed FROM s WHERE n >= 20 AND sc > 0", k="string", day="date", speed="double")
def rolling_mad_speed(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    dl = o.groupBy(F.col("c_mktsegment").alias("k"), F.to_date("o_orderdate").alias("day")).agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    raw = W.positional_change(dl, ["k"], 5, "day", "v").where("change is not null").withColumn("n", F.datediff("day", F.lit("1990-01-01").cast("date")))
    scaled = W.rolling_mad(raw, ["k"], "n", "change", 180, 20).where("mad is not null")
    return scaled.withColumn("speed", S.norm_speed(F.col("change"), F.col("mad")))


@q([MK, "c AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) rn FROM (SELECT k, t, v, max(v) OVER w mx, min(v) OVER w mi, count(*) OVER w n FROM mk WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE v = mx AND v > mi AND n >= 6)"], "WITH RECURSIVE g AS (SELECT k, t, rn, t kept FROM c WHERE rn = 1 UNION ALL SELECT c.k, c.t, c.rn, CASE WHEN c.t - g.kept > 4 THEN c.t ELSE g.kept END FROM g JOIN c ON c.k = g.k AND c.rn = g.rn + 1) SELECT DISTINCT k, kept t FROM g", k="string", t="bigint")
def local_maxima(spark, d):
    return W.extrema(mk(spark, d), ["k"], 4)


_LOW = "p AS (SELECT k, t FROM (SELECT k, t, v, quantile_cont(v, 0.4) OVER (PARTITION BY k) q FROM mn) WHERE v < q)"


def _low_points(spark, d):
    x = mn(spark, d)
    bar = x.groupBy("k").agg(F.percentile("v", F.lit(0.4)).alias("q"))
    return x.join(bar, "k").where("v < q").select("k", "t")


@q([MN, _LOW], "SELECT k, min(t) \"start\", max(t) \"end\", count(*) n FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t) e FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t) - 1 <= 1 THEN 0 ELSE 1 END new FROM p)) GROUP BY k, e".replace('"start"', "a").replace('"end"', "b"), k="string", a="bigint", b="bigint", n="bigint")
def episodes_gap_one(spark, d):
    return W.islands(_low_points(spark, d), ["k"], 1).withColumnsRenamed({"start": "a", "end": "b"})


_ST = "st AS (SELECT user_id u, CAST(ts AS DATE) AS day, CAST(sign(avg(value) - 50) AS INT) s FROM events GROUP BY 1, 2)"


def _states(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("day")).agg(F.signum(F.avg("value") - 50).cast("int").alias("s"))


@q([_ST], "SELECT u, a, s, CAST(coalesce(lead(a) OVER (PARTITION BY u ORDER BY a), b + 1) - a AS BIGINT) AS days FROM (SELECT u, min(day) a, max(day) b, any_value(s) s FROM (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY day) run FROM (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER (PARTITION BY u ORDER BY day) AND row_number() OVER (PARTITION BY u ORDER BY day) > 1 THEN 0 ELSE 1 END new FROM st)) GROUP BY u, run)", u="bigint", a="date", s="int", days="bigint")
def spells_calendar_days(spark, d):
    return W.spells(_states(spark, d), ["u"], "day", "s").withColumnRenamed("start", "a")


@q(MN, "SELECT k, t FROM (SELECT *, lag(two) OVER (PARTITION BY k ORDER BY t) bf FROM (SELECT k, t, coalesce(t - lag(t, 2) OVER w = 2 AND v < lag(v) OVER w AND lag(v) OVER w < lag(v, 2) OVER w, false) two FROM mn WINDOW w AS (PARTITION BY k ORDER BY t))) WHERE two AND NOT coalesce(bf, false)", k="string", t="bigint")
def two_falls_in_a_row(spark, d):
    return W.run_starts(mn(spark, d), ["k"])


@q(MK, "SELECT k, pt peak_t, t trough_t, fall FROM (SELECT k, p.t pt, q.t t, p.v - q.v fall, row_number() OVER (PARTITION BY p.k ORDER BY p.v - q.v DESC, q.t, p.t) rn FROM mk p JOIN mk q USING (k) WHERE p.t < q.t) WHERE rn = 1", k="string", peak_t="bigint", trough_t="bigint", fall="double")
def largest_drawdown(spark, d):
    return W.largest_drawdown(mk(spark, d), ["k"])


@q(MN, "SELECT k, t, rank() OVER (PARTITION BY k ORDER BY b) + (count(*) OVER (PARTITION BY k, b) - 1) / 2.0 rk FROM (SELECT k, t, floor(v / 100000) b FROM mn)", k="string", t="bigint", rk="double")
def average_ranks(spark, d):
    x = mn(spark, d).withColumn("b", F.floor(F.col("v") / 100000))
    return x.withColumn("rk", W.average_rank("b", ["k"]))


@q("", "SELECT u, i, CASE WHEN x IS NOT NULL THEN s END s FROM (SELECT user_id u, event_id i, x, CAST(coalesce(last_value(CASE WHEN x >= 1 THEN 1 WHEN x < 0.5 THEN 0 END IGNORE NULLS) OVER w, 0) - coalesce(last_value(CASE WHEN x <= -1 THEN 1 WHEN x > -0.5 THEN 0 END IGNORE NULLS) OVER w, 0) AS INT) s FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE (value - 50) / 25 END x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))", u="bigint", i="bigint", s="int")
def hysteresis_states(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("i"), F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") != "error", (F.col("value") - 50) / 25).alias("x"))
    return W.hysteresis(e, ["u"], "o", "x", 1.0, 0.5).withColumnRenamed("state", "s")


_REV = ["e AS (SELECT *, lag(s, 2) OVER w test, lead(day) OVER w nd, row_number() OVER w i, CASE WHEN s <> 0 THEN s END sg FROM st WINDOW w AS (PARTITION BY u ORDER BY day))", "f AS (SELECT *, sum(CASE WHEN sg IS NOT NULL AND sg IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY day) ep FROM (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY u ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pv FROM e))", "g AS (SELECT *, first_value(s) OVER (PARTITION BY u, ep ORDER BY day) v, row_number() OVER (PARTITION BY u, ep ORDER BY day) > 1 later FROM f WHERE ep > 0)", "h AS (SELECT u, ep, min(day) a, any_value(v) sign, max(CASE WHEN s = v THEN i END) ie, max(i) il FROM g GROUP BY 1, 2)", "r AS (SELECT h.u, h.a, h.sign, (SELECT nd FROM g WHERE g.u = h.u AND g.i = ie) base_end, (SELECT nd FROM g WHERE g.u = h.u AND g.i = il) turn, (SELECT max_by(nd, i) FROM g WHERE g.u = h.u AND g.ep = h.ep AND i > ie AND test = h.sign) test_end, (SELECT min(day) FROM g WHERE g.u = h.u AND g.ep = h.ep AND later AND s IS DISTINCT FROM h.sign) base_lost, (SELECT min(day) FROM g WHERE g.u = h.u AND g.ep = h.ep AND later AND test IS DISTINCT FROM h.sign) test_lost FROM h)"]


@q([_ST, *_REV], "SELECT u, a, sign, coalesce(test_end, base_end) - base_end last_delay, coalesce(test_lost, turn) - coalesce(base_lost, turn) first_delay FROM r WHERE turn IS NOT NULL", u="bigint", a="date", sign="int", last_delay="bigint", first_delay="bigint")
def reversal_delays(spark, d):
    x = _states(spark, d)
    x = x.withColumn("test", F.lag("s", 2).over(W.over(["u"], "day")))
    return W.reversal_delays(x, ["u"], "day", "s", "test").withColumnRenamed("start", "a")


@q([MK, "l AS (SELECT t, v FROM mk WHERE k = 'BUILDING')", "s AS (SELECT t, v FROM mk WHERE k = 'MACHINERY' AND t >= 23960)", "o AS (SELECT avg(s.v - l.v) d FROM l JOIN s USING (t))"], "SELECT l.t, l.v + o.d v FROM l, o WHERE l.t NOT IN (SELECT t FROM s) UNION ALL SELECT t, v FROM s", t="bigint", v="double")
def splice_offset(spark, d):
    x = mk(spark, d)
    return W.splice(x.where("k = 'BUILDING'").select("t", "v"), x.where("k = 'MACHINERY' and t >= 23960").select("t", "v"))


@q([MN, "f AS (SELECT k, t, v < avg(v) OVER (PARTITION BY k) low FROM mn)"], "SELECT k, n, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, a) rk FROM (SELECT k, count(*) n, min(t) a, max(t) b FROM (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY t) g FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) i FROM f) WHERE low) GROUP BY k, g)) WHERE rk = 1", k="string", n="bigint", a="bigint", b="bigint")
def longest_low_run(spark, d):
    x = mn(spark, d)
    mean = x.groupBy("k").agg(F.avg("v").alias("mu"))
    return W.longest_run(x.join(mean, "k"), ["k"], F.col("v") < F.col("mu")).withColumnsRenamed({"start": "a", "end": "b"})


# --- joins ----------------------------------------------------------------------


@q("", "SELECT q.o_orderkey o, f.v FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) d FROM orders WHERE o_orderstatus = 'O') q ASOF LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) d, max(o_totalprice) v FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2) f ON q.o_custkey = f.o_custkey AND q.d >= f.d", o="bigint", v="double")
def asof_last_known(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderstatus")
    left = o.where("o_orderstatus = 'O'").select("o_orderkey", "c", "day")
    right = o.where("o_orderstatus <> 'O'").select("c", "day", F.col("o_totalprice").alias("v"))
    return J.asof(left, right, ["c"], "day", "v").select(F.col("o_orderkey").alias("o"), "v")


@q([M, "p AS (SELECT CAST(make_date(CAST(t // 12 AS INT), CAST(t % 12 + 1 AS INT), 1) + INTERVAL 2 MONTH + INTERVAL 14 DAY AS DATE) av, v FROM m)", "q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) d FROM orders)"], "SELECT q.d AS day, p.v FROM q ASOF LEFT JOIN p ON q.d >= p.av", day="date", v="double")
def asof_published(spark, d):
    published = m(spark, d).select(S.available_date(S.month_date(F.col("t")), 2, 15).alias("day"), "v")
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return J.asof(days, published, [], "day", "v")


_SIG = ["sg AS (SELECT DISTINCT user_id u, CAST(date_diff('hour', TIMESTAMP '2020-01-01', ts) AS BIGINT) t FROM events WHERE event_type = 'error')", "ev AS (SELECT DISTINCT user_id u, CAST(date_diff('hour', TIMESTAMP '2020-01-01', ts) AS BIGINT) t FROM events WHERE event_type = 'purchase')", "e AS (SELECT min(t) mn, max(t) mx FROM (SELECT t FROM sg UNION ALL SELECT t FROM ev))"]


def _hours(spark, d, kind):
    at = F.floor((F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))) - F.unix_timestamp(F.lit("2020-01-01 00:00:00").cast("timestamp"))) / 3600).cast("bigint")
    return read(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("u"), at.alias("t")).distinct()


@q(_SIG, "SELECT u, t, CASE WHEN ev IS NOT NULL THEN 'TP' WHEN t + 48 > mx THEN 'CENSORED' ELSE 'FA' END outcome, ev FROM (SELECT s.u, s.t, min(x.t) ev FROM sg s LEFT JOIN ev x ON x.u = s.u AND x.t > s.t AND x.t <= s.t + 48 GROUP BY 1, 2), e", u="bigint", t="bigint", outcome="string", ev="bigint")
def forward_window_score(spark, d):
    s, e = _hours(spark, d, "error"), _hours(spark, d, "purchase")
    end = s.unionByName(e).agg(F.max("t").alias("t")).first()["t"]
    return J.score_signals(s, e, ["u"], 48, end or 0).withColumnRenamed("event", "ev")


@q(_SIG, "SELECT u, t FROM ev x, e WHERE t <= mx AND t - 48 >= mn AND NOT EXISTS (SELECT 1 FROM sg s WHERE s.u = x.u AND s.t BETWEEN x.t - 48 AND x.t - 1)", u="bigint", t="bigint")
def missed_events(spark, d):
    s, e = _hours(spark, d, "error"), _hours(spark, d, "purchase")
    whole = s.unionByName(e).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return J.missed_events(s, e, ["u"], 48, whole["a"] or 0, whole["b"] or 0)


@q(_SIG, "SELECT u, lead, follow, lag FROM (SELECT *, row_number() OVER (PARTITION BY u, follow ORDER BY lag, lead) rk FROM (SELECT s.u, s.t lead, min(x.t) follow, min(x.t) - s.t lag FROM sg s JOIN ev x ON x.u = s.u AND x.t - s.t BETWEEN 0 AND 36 GROUP BY 1, 2)) WHERE rk = 1", u="bigint", lead="bigint", follow="bigint", lag="bigint")
def nearest_followers(spark, d):
    return J.nearest_followers(_hours(spark, d, "error"), _hours(spark, d, "purchase"), ["u"], 0, 36)


@q(MK, "SELECT a.k, a.t, b.v / a.v - 1 ret FROM mk a JOIN mk b ON a.k = b.k AND b.t = a.t + 3 WHERE a.v <> 0 AND b.v <> a.v", k="string", t="bigint", ret="double")
def forward_returns(spark, d):
    return J.forward_return(mk(spark, d), ["k"], 3)


_WANTED = [("BUILDING", 0, 1), ("BUILDING", 1, -1), ("MACHINERY", 0, -1), ("MACHINERY", 2, 1), ("FURNITURE", 1, 1), ("FURNITURE", 2, 1)]


@q([MK, "w(k, s, sign) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _WANTED) + ")", "f AS (SELECT a.k, a.t % 4 s, b.v / a.v - 1 ret FROM mk a JOIN mk b ON a.k = b.k AND b.t = a.t + 3 WHERE a.v <> 0 AND b.v <> a.v UNION ALL SELECT a.k, a.t % 4, NULL FROM mk a WHERE NOT EXISTS (SELECT 1 FROM mk b WHERE b.k = a.k AND b.t = a.t + 3))"], "SELECT f.k, count(*) FILTER (WHERE w.sign IS NOT NULL AND ret <> 0) n, count(*) FILTER (WHERE sign(f.ret) = w.sign) hits, count(*) FILTER (WHERE w.sign IS NULL) unmatched, count(*) FILTER (WHERE w.sign IS NOT NULL AND ret = 0) zeros, count(*) FILTER (WHERE w.sign IS NOT NULL AND ret IS NULL) AS missing FROM f LEFT JOIN w ON w.k = f.k AND w.s = f.s GROUP BY 1", k="string", n="bigint", hits="bigint", unmatched="bigint", zeros="bigint", missing="bigint")
def prescription_hits(spark, d):
    moves = J.forward_return(mk(spark, d), ["k"], 3, keep=True).withColumn("s", (F.col("t") % 4).cast("int"))
    return J.prescription_hits(moves, spark.createDataFrame(_WANTED, "k string, s int, sign int"), "k", "s", "ret")


# --- statistics -------------------------------------------------------------------

_CCF = ["x AS (SELECT t, v FROM mk WHERE k = 'BUILDING')", "y AS (SELECT t, v FROM mk WHERE k = 'MACHINERY')", "pn AS (SELECT * FROM (SELECT x.t, h.h, x.v x, y.v y, count(*) OVER (PARTITION BY x.t) n FROM x, generate_series(0, 12) h(h), y WHERE y.t = x.t + h.h) WHERE n = 13)", "cc AS (SELECT h, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) r, count(*) n FROM pn GROUP BY h)"]


def _two(spark, d):
    x = mk(spark, d)
    return x.where("k = 'BUILDING'").select("t", "v"), x.where("k = 'MACHINERY'").select("t", "v")


@q([MK, *_CCF], "SELECT * FROM cc", h="int", r="double", n="bigint")
def ccf_balanced(spark, d):
    return T.cross_correlation(*_two(spark, d), [], 12)


@q([MK, *_CCF], "SELECT * FROM cc ORDER BY r DESC, h LIMIT 1", h="int", r="double", n="bigint")
def ccf_peak(spark, d):
    return T.peak_lag(T.cross_correlation(*_two(spark, d), [], 12), [])


@q([MK], "SELECT a.k a, b.k b, h, CASE WHEN count(*) >= 3 THEN covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0) END r FROM mk a, mk b, generate_series(-6, 6) g(h) WHERE a.k < b.k AND b.t = a.t + h GROUP BY 1, 2, 3", a="string", b="string", h="int", r="double")
def lead_matrix(spark, d):
    return J.lead_pairs(mk(spark, d), "k", 6)


@q("", "SELECT k, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) r, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) rho FROM (SELECT l_returnflag k, l_quantity x, l_extendedprice y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 ry FROM lineitem) GROUP BY 1", k="string", r="double", rho="double")
def pearson_spearman(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return T.spearman(x, ["k"], "x", "y").join(x.groupBy("k").agg(T.correlation("x", "y").alias("r")), "k")


_XY = "xy AS (SELECT b.k, b.t, (a.v - 23000) / 1e6 x, b.v / 1e6 y FROM mk a JOIN mk b ON a.t = b.t AND a.k = 'BUILDING' AND b.k <> 'BUILDING')"


def _regression(spark, d):
    x = mk(spark, d)
    return x.where("k <> 'BUILDING'").join(x.where("k = 'BUILDING'").select("t", F.col("v").alias("b")), "t").select("k", "t", ((F.col("b") - 23000) / 1e6).alias("x"), (F.col("v") / 1e6).alias("y"))


@q([MK, _XY], "SELECT k, regr_slope(y, x) beta, regr_intercept(y, x) alpha, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) ssr, -regr_intercept(y, x) / nullif(regr_slope(y, x), 0) tau, regr_count(y, x) n FROM xy GROUP BY k", k="string", beta="double", alpha="double", ssr="double", tau="double", n="bigint")
def ols_zero_crossing(spark, d):
    return _regression(spark, d).groupBy("k").agg(*T.ols("x", "y"))


@q([MK, _XY, "s AS (SELECT k, t >= 23985 post, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) r, regr_slope(y, x) b, stddev_samp(x) sx, stddev_samp(y) sy FROM xy GROUP BY 1, 2)"], "SELECT k, p.r - q.r dr, p.b - q.b dbeta, ln(abs(p.r)) - ln(abs(q.r)) ln_r, ln(abs(p.b)) - ln(abs(q.b)) ln_b, ln(p.sx) - ln(q.sx) ln_sx, ln(p.sy) - ln(q.sy) ln_sy FROM s p JOIN s q USING (k) WHERE p.post AND NOT q.post", k="string", dr="double", dbeta="double", ln_r="double", ln_b="double", ln_sx="double", ln_sy="double")
def fixed_split_parts(spark, d):
    return T.fixed_split(_regression(spark, d), ["k"], F.col("t") >= 23985, "x", "y")


@q([MK, _XY, "n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) i, count(*) OVER (PARTITION BY k) n, lead(t) OVER (PARTITION BY k ORDER BY t) nt FROM xy)", "b AS (SELECT DISTINCT k, i b, t bt, nt, n FROM n WHERE i >= greatest(3, floor(n * 0.15)) AND n - i >= greatest(3, floor(n * 0.15)))", "f AS (SELECT n.k, b.bt, any_value(b.nt) nt, any_value(b.n) n, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) one, regr_syy(y, x) FILTER (i <= b) - regr_slope(y, x) FILTER (i <= b) * regr_sxy(y, x) FILTER (i <= b) + regr_syy(y, x) FILTER (i > b) - regr_slope(y, x) FILTER (i > b) * regr_sxy(y, x) FILTER (i > b) two FROM n JOIN b ON n.k = b.k GROUP BY 1, 2)"], "SELECT k, bt break_t, nt new_t, round((one - two) / 2 / (two / (n - 4)), 4) f, n FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY (one - two) / 2 / (two / (n - 4)) DESC, bt) = 1", k="string", break_t="bigint", new_t="bigint", f="double", n="bigint")
def sup_f_break(spark, d):
    return T.sup_f(_regression(spark, d), ["k"], "t", "x", "y").withColumn("f", F.round("f", 4))


_LAB = "dl AS (SELECT lang k, n_chars s, quality y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL)"


def _labelled(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("lang").alias("k"), F.col("n_chars").alias("s"), F.col("quality").alias("y"))
    return x.where("y is not null and k is not null")


@q([_LAB], "SELECT a.k, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) auc, (SELECT count(*) FROM dl z WHERE z.k = a.k AND y = 1) n1, (SELECT count(*) FROM dl z WHERE z.k = a.k AND y = 0) n0 FROM dl a JOIN dl b ON a.k = b.k AND a.y = 1 AND b.y = 0 GROUP BY a.k", k="string", auc="double", n1="bigint", n0="bigint")
def auc_by_ranks(spark, d):
    return T.auc(_labelled(spark, d), ["k"], "s", "y").where("auc is not null")


@q([_LAB, "sc AS (SELECT DISTINCT k, s FROM dl)", "th AS (SELECT k, (s + nx) / 2.0 t FROM (SELECT k, s, lead(s) OVER (PARTITION BY k ORDER BY s) nx, count(*) OVER (PARTITION BY k) n FROM (SELECT k, CAST(s AS DOUBLE) s FROM sc)) WHERE nx IS NOT NULL UNION ALL SELECT k, max(s) FROM sc GROUP BY k HAVING count(*) = 1)", "js AS (SELECT th.k, t, round(CAST(sum(CASE WHEN y = 1 AND s <= t THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) - CAST(sum(CASE WHEN y = 0 AND s <= t THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN y = 0 THEN 1 ELSE 0 END), 12) j FROM th JOIN dl ON dl.k = th.k GROUP BY 1, 2 HAVING sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) > 0)"], "SELECT k, t threshold, j FROM js QUALIFY row_number() OVER (PARTITION BY k ORDER BY j DESC, t) = 1", k="string", threshold="double", j="double")
def youden_threshold(spark, d):
    return T.youden(_labelled(spark, d), ["k"], "s", "y")


_RET = ["re AS (SELECT a.t, 100 * ln(a.v / b.v) r FROM m a JOIN m b ON b.t = a.t - 12)", "en AS (SELECT o.t - 12 origin, o.r outcome, x.r x FROM re o JOIN re x ON x.t <= o.t - 12)", "en2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY origin) m, row_number() OVER (PARTITION BY origin ORDER BY x) i FROM en) WHERE m >= 12)", "cr AS (SELECT origin, max(m) m, avg(abs(x - outcome)) - sum((2 * i - m - 1) * x) / (max(m) * max(m)) crps FROM en2 GROUP BY origin)"]


def _ensembles(spark, d):
    r = W.log_change(m(spark, d), [], 12).select("t", F.col("change").alias("r"))
    return T.expanding_ensembles(r, 12, 12)


@q([M, *_RET], "SELECT * FROM cr", origin="bigint", m="bigint", crps="double")
def crps_expanding(spark, d):
    return T.crps(_ensembles(spark, d), ["origin"], "x", "outcome")


_VOL = ["mo AS (SELECT a.t, ln(a.v / b.v) r FROM m a JOIN m b ON b.t = a.t - 1)", "vo AS (SELECT t, CASE WHEN count(r) OVER w = 12 THEN sqrt(12) * stddev_samp(r) OVER w * 100 END vol FROM mo WINDOW w AS (ORDER BY t ROWS 11 PRECEDING))", "sc AS (SELECT t, vol / avg(vol) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) a FROM vo WHERE vol IS NOT NULL)", "ce AS (SELECT origin, avg(x) c FROM en2 GROUP BY origin)", "e3 AS (SELECT origin, outcome, i, m, c + a * (x - c) x FROM en2 JOIN ce USING (origin) JOIN sc ON sc.t = origin)", "pr AS (SELECT origin, avg(abs(x - outcome)) - sum((2 * i - m - 1) * x) / (max(m) * max(m)) price FROM e3 GROUP BY origin)"]


def crps_deltas(spark, d):
    """CRPS of the expanding ensemble less that of the same ensemble with its width scaled by recent against usual volatility."""
    levels = m(spark, d)
    monthly = W.log_change(levels, [], 1).select("t", (F.col("change") / 100).alias("r"))
    vol = W.rolling_volatility(monthly, [], 12).where("vol is not null")
    scale = vol.withColumn("a", F.col("vol") / F.avg("vol").over(W.over([], "t").rowsBetween(Window.unboundedPreceding, 0))).select(F.col("t").alias("origin"), "a")
    base = _ensembles(spark, d)
    centre = base.groupBy("origin").agg(F.avg("x").alias("c"))
    moved = base.join(centre, "origin").join(scale, "origin").withColumn("x", T.scaled_about(F.col("x"), F.col("c"), F.col("a")))
    price = T.crps(moved, ["origin"], "x", "outcome").select("origin", F.col("crps").alias("price"))
    return T.crps(base, ["origin"], "x", "outcome").join(price, "origin").withColumn("delta", F.col("crps") - F.col("price"))


@q([M, *_RET, *_VOL], "SELECT origin, m, crps, price, crps - price delta FROM cr JOIN pr USING (origin)", origin="bigint", m="bigint", crps="double", price="double", delta="double")
def crps_price_vs_baseline(spark, d):
    return crps_deltas(spark, d)


_ACF = ["de AS (SELECT origin t, crps - price v FROM cr JOIN pr USING (origin))", "dm AS (SELECT t, v - (SELECT avg(v) FROM de) d FROM de)", "ac AS (SELECT h, sum(a.d * b.d) / (SELECT sum(d * d) FROM dm) rho FROM dm a, dm b, generate_series(0, 12) g(h) WHERE b.t = a.t + h GROUP BY h)", "pa AS (SELECT (h - 1) // 2 p, sum(rho) s FROM ac WHERE h > 0 GROUP BY 1)", "op AS (SELECT p, s, min(CASE WHEN s > 0 THEN 1 ELSE 0 END) OVER (ORDER BY p) o FROM pa)", "ta AS (SELECT 1 + 2 * coalesce(sum(s) FILTER (o = 1), 0) tau FROM op)"]


@q([M, *_RET, *_VOL, *_ACF], "SELECT * FROM ac", h="int", rho="double")
def acf_of_deltas(spark, d):
    return T.sample_acf(crps_deltas(spark, d).select(F.col("origin").alias("t"), F.col("delta").alias("v")), 12)


@q([M, *_RET, *_VOL, *_ACF], "SELECT mean, tau, n_eff, hw, CASE WHEN mean - hw > 0 THEN 'better' WHEN mean + hw < 0 THEN 'worse' ELSE 'unknown' END verdict FROM (SELECT mean, tau, n / greatest(tau, 1) n_eff, 1.96 * sd / sqrt(n / greatest(tau, 1)) hw FROM ta, (SELECT avg(v) mean, stddev_samp(v) sd, count(*) n FROM de))", mean="double", tau="double", n_eff="double", hw="double", verdict="string")
def overlap_adjusted_verdict(spark, d):
    x = crps_deltas(spark, d).select(F.col("origin").alias("t"), F.col("delta").alias("v"))
    base = x.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))
    size = T.effective_size(T.sample_acf(x, 12), 1)
    out = base.join(F.broadcast(size)).withColumn("n_eff", F.col("n") * F.col("n_eff")).withColumn("hw", 1.96 * F.col("sd") / F.sqrt("n_eff"))
    return out.withColumn("verdict", T.verdict(F.col("mean"), F.col("hw")))


_RNG = "CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) % {n}"


def _boot_sql(circular: bool) -> list[str]:
    start = _RNG.format(key="'boot:' || g.rep || ':' || b.b", n="n" if circular else "(n - 5)")
    return [M, "nu AS (SELECT row_number() OVER (ORDER BY t) - 1 rw, v FROM m)", "c AS (SELECT count(*) n FROM m)", f"s AS (SELECT g.rep, b.b, {start} st, n FROM c, generate_series(0, 199) g(rep), generate_series(0, CAST(ceil((SELECT n FROM c) / 6.0) AS BIGINT) - 1) b(b))", "dr AS (SELECT rep, (st + k.k) % n rw FROM s, generate_series(0, 5) k(k) WHERE b * 6 + k.k < n)"]


@q(_boot_sql(True), "SELECT rep, avg(v) mean FROM dr JOIN nu USING (rw) GROUP BY rep", rep="bigint", mean="double")
def block_bootstrap_circular(spark, d):
    return T.bootstrap_mean(m(spark, d), 6, 200, "boot", True)


@q(_boot_sql(False), "SELECT rep, avg(v) mean FROM dr JOIN nu USING (rw) GROUP BY rep", rep="bigint", mean="double")
def block_bootstrap_moving(spark, d):
    return T.bootstrap_mean(m(spark, d), 6, 200, "boot", False)


@q(["cl AS (SELECT c_nationkey o, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) s, count(*) c FROM customer GROUP BY 1)", "nu AS (SELECT row_number() OVER (ORDER BY o) - 1 rw, s, c FROM cl)", "dr AS (SELECT rep, " + _RNG.format(key="'cl:' || rep || ':' || i", n="(SELECT count(*) FROM cl)") + " rw FROM generate_series(0, 99) g(rep), generate_series(0, (SELECT count(*) FROM cl) - 1) h(i))"], "SELECT rep, CAST(sum(s) AS DOUBLE) / sum(c) rate FROM dr JOIN nu USING (rw) GROUP BY rep", rep="bigint", rate="double")
def cluster_bootstrap(spark, d):
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("o")).agg(F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("s"), F.count("*").alias("c"))
    return T.cluster_bootstrap(c, 100, "cl", "o", "s", "c")


_PV = ["va AS (SELECT n_nationkey u, avg(c_acctbal) v, n_regionkey = 1 one FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)", "nu AS (SELECT row_number() OVER (ORDER BY u) b, CAST(v AS DOUBLE) v, one FROM va)", "n AS (SELECT count(*) n, count(*) FILTER (one) k, sum(v) s FROM nu)", "pk(b, i, t) AS (SELECT b, 1, v FROM nu UNION ALL SELECT nu.b, i + 1, t + nu.v FROM pk JOIN nu ON nu.b > pk.b, n WHERE i < n.k)", "st AS (SELECT t / k - (s - t) / (n - k) d FROM pk, n WHERE i = k)"]


@q(["RECURSIVE " + _PV[0], *_PV[1:]], "SELECT observed, count(*) labellings, avg(CASE WHEN abs(d) >= abs(observed) - 1e-9 THEN 1.0 ELSE 0.0 END) p FROM st, (SELECT avg(v) FILTER (one) - avg(v) FILTER (NOT one) observed FROM nu) GROUP BY observed", observed="double", labellings="bigint", p="double")
def permutation_exact(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.groupBy(F.col("n_nationkey").alias("u"), (F.col("n_regionkey") == 1).alias("one")).agg(F.avg("c_acctbal").alias("v"))
    return T.exact_permutation(v, v.where("one").count(), "u", "v", "one")


#: A nation's p: its share of customers in debt, in tenths of them all, null where its key is divisible by 7.
_PS = "pv AS (SELECT n_name AS name, CASE WHEN n_nationkey % 7 <> 0 THEN CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) / 10 END p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey)"


@q([_PS], "SELECT name, p, CASE WHEN p IS NOT NULL THEN max(least(1, (30 - rn + 1) * p)) OVER (ORDER BY p NULLS LAST, name ROWS UNBOUNDED PRECEDING) END adjusted FROM (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, name) rn FROM pv)", name="string", p="double", adjusted="double")
def holm_declared_family(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    share = F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).cast("double") / F.count("*") / 10
    p = c.groupBy(F.col("n_name").alias("name"), "n_nationkey").agg(share.alias("p")).select("name", F.when(F.col("n_nationkey") % 7 != 0, F.col("p")).alias("p"))
    return T.holm(p, [], "p", "name", 30)


@query(None, k="string", m="int", ssr="double", bic="double", n="bigint")
def breaks_by_bic(spark, d):
    return T.breaks_bic(_regression(spark, d), ["k"], "t", "x", "y", 12, 2)



@q([MK, *_CCF], "SELECT \"start\" start_t, h, r FROM (SELECT s.t \"start\", h, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) r, count(*) n FROM pn, x s(t, v2) WHERE pn.t BETWEEN s.t AND s.t + 35 GROUP BY 1, 2) WHERE n >= 30".replace('"start" start_t', "st start_t").replace('s.t "start"', "s.t st"), start_t="bigint", h="int", r="double")
def rolling_ccf(spark, d):
    return T.rolling_correlation(*_two(spark, d), 12, 36, 30).withColumnRenamed("start", "start_t")


@q([MK, _XY, "p AS (SELECT *, percent_rank() OVER (PARTITION BY k ORDER BY t) < 0.8 tr FROM xy)", "f AS (SELECT k, regr_slope(y, x) b, regr_intercept(y, x) a FROM p WHERE tr GROUP BY k)"], "SELECT k, avg(CASE WHEN sign(a + b * x) = sign(y) THEN 1.0 ELSE 0.0 END) hit_rate, sqrt(avg((a + b * x - y) * (a + b * x - y))) rmse FROM p JOIN f USING (k) WHERE NOT tr GROUP BY k", k="string", hit_rate="double", rmse="double")
def out_of_sample_rmse(spark, d):
    return T.out_of_sample(_regression(spark, d), ["k"], "t", "x", "y")


@q([MK, "i AS (SELECT t, v i FROM mk WHERE k = 'BUILDING')"], "SELECT k, t, mk.v / nullif(i, 0) v FROM mk JOIN i USING (t)", k="string", t="bigint", v="double")
def deflated_series(spark, d):
    x = mk(spark, d)
    return J.deflated(x, x.where("k = 'BUILDING'").select("t", "v"), ["k"])


@query(None, k="string", b="double")
def two_way_panel_effects(spark, d):
    x = mk(spark, d).where("not (k = 'FURNITURE' and t < 23960)").withColumn("z", F.col("v") / 1e6)
    return T.two_way_effects(x, "k")


@query(None, r="double", h="int", p="double")
def peak_lag_null(spark, d):
    return T.max_lag_null(*_two(spark, d), 6, 1, 6, 99, "null")


@query(None, rho="double", p="double")
def permutation_rank(spark, d):
    x, y = _two(spark, d)
    return T.permutation_rank_p(x.select("t", F.col("v").alias("a")).join(y.select("t", F.col("v").alias("b")), "t"), 199, "perm", "t", "a", "b")


_FALLS = "st AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) rn FROM (SELECT *, lag(two) OVER (PARTITION BY k ORDER BY t) bf FROM (SELECT k, t, coalesce(t - lag(t, 2) OVER w = 2 AND v < lag(v) OVER w AND lag(v) OVER w < lag(v, 2) OVER w, false) two FROM mn WINDOW w AS (PARTITION BY k ORDER BY t))) WHERE two AND NOT coalesce(bf, false))"


@q([MN, _FALLS], "WITH RECURSIVE g AS (SELECT k, rn, t kept FROM st WHERE rn = 1 UNION ALL SELECT st.k, st.rn, CASE WHEN st.t - g.kept >= 6 THEN st.t ELSE g.kept END FROM g JOIN st ON st.k = g.k AND st.rn = g.rn + 1) SELECT DISTINCT k, kept t FROM g", k="string", t="bigint")
def spaced_starts(spark, d):
    return J.greedy_spacing(W.run_starts(mn(spark, d), ["k"]), ["k"], 6)


_MATCH = [x.replace("'error'", "'signup'") for x in _SIG[:2]] + ["pr AS (SELECT a.u, a.t a, b.t b, abs(a.t - b.t) d, row_number() OVER (PARTITION BY a.u ORDER BY abs(a.t - b.t), a.t, b.t) rn FROM sg a JOIN ev b ON a.u = b.u AND abs(a.t - b.t) <= 12)"]


@q(_MATCH, "WITH RECURSIVE g AS (SELECT u, rn, a, b, d, true took, [a] ua, [b] ub FROM pr WHERE rn = 1 UNION ALL SELECT z.u, z.rn, z.a, z.b, z.d, z.ok, CASE WHEN z.ok THEN list_append(z.ua, z.a) ELSE z.ua END, CASE WHEN z.ok THEN list_append(z.ub, z.b) ELSE z.ub END FROM (SELECT p.*, g.ua, g.ub, NOT list_contains(g.ua, p.a) AND NOT list_contains(g.ub, p.b) ok FROM g JOIN pr p ON p.u = g.u AND p.rn = g.rn + 1) z) SELECT u, a, b, d FROM g WHERE took", u="bigint", a="bigint", b="bigint", d="bigint")
def matched_events(spark, d):
    return J.match_events(_hours(spark, d, "signup"), _hours(spark, d, "purchase"), ["u"], 12)
