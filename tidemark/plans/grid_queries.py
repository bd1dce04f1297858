"""Queries of the definition grids at their size, with their SQL.

Days of orders by status are the series.  A segment's part is its mean of 28 days over
its mean of all days, in thousandths off one, null without an order in ten days; axes
are weighted means of parts by the six weightings D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grids as G
from ..operators import states as C
from .base import read, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}

SEGMENTS = {"A": "AUTOMOBILE", "B": "BUILDING", "F": "FURNITURE", "H": "HOUSEHOLD", "M": "MACHINERY"}
_A, _B = {"A": 0.5, "B": 0.3, "F": 0.2}, {"H": 0.6, "M": 0.4}
WEIGHTS = {
    "D0": (_A, _B), "D1": (_A, {"H": 0.6}), "D2": ({"A": 0.5, "B": 0.3}, _B), "D3": ({"A": 0.5, "B": 0.3}, {"H": 0.6}),
    "D4": ({"A": 0.5, "B": 0.3, "M": 0.1}, {"H": 0.6, "F": 0.1}), "D5": ({"A": 0.5, "B": 0.3, "M": 0.3}, {"H": 0.6, "F": 0.1}),
}
CUTOFF, TOLERANCE = 0.6, 30
QS = [round(0.02 * i, 4) for i in range(46)]
KAPPAS = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]
RULE_QS = QS[:31]
PAIRS = [(1, 2), (3, 4), (1, 3), (2, 4), (1, 4), (2, 3), (1,), (2,), (3,), (4,)]
AT_LEAST, EARLY, LATE, CALIBRATION, SPELL = 4, "1994-12", "1995-01", "1996-06-30", 12.0
LOW, HIGH, DAYS, TARGET = 0.15, 0.25, 20.0, 0.2


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(k, dy, A, B, F, H, M): parts of each status and day."""
    orders = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    of = lambda name: F.sum(F.when(F.col("c_mktsegment") == name, F.col("o_totalprice").cast("decimal(18,2)")))
    days = orders.groupBy(F.col("o_orderstatus").alias("k"), F.to_date("o_orderdate").alias("dy")).agg(*[of(name).alias(s) for s, name in SEGMENTS.items()])
    own = Window.partitionBy("k")
    at = own.orderBy(F.unix_date("dy"))
    part = lambda s: F.when(F.count(s).over(at.rangeBetween(-9, 0)) > 0, F.round(1000.0 * (F.sum(s).over(at.rangeBetween(-27, 0)).cast("double") * F.count(s).over(own) / (F.count(s).over(at.rangeBetween(-27, 0)) * F.sum(s).over(own).cast("double")) - 1)))
    return days.select("k", "dy", *[part(s).alias(s) for s in SEGMENTS])


def axis(weights: dict[str, float]) -> Column:
    num = sum((F.coalesce(w * F.col(s), F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(s).isNull(), 0.0).otherwise(w) for s, w in weights.items()), F.lit(0.0))
    return F.when(den >= CUTOFF, F.round(num / den, 3))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(k, dy, a, b) of weighting D4."""
    return parts(spark, d).select("k", "dy", axis(WEIGHTS["D4"][0]).alias("a"), axis(WEIGHTS["D4"][1]).alias("b"))


def shapes(df: DataFrame) -> dict[str, Column]:
    at = Window.partitionBy("k").orderBy("dy")
    move = lambda s, w: F.col(s) - F.lag(s, w).over(at)
    of = lambda w, t, twist=False: C.curve_shape(move("A", w), move("M", w), t, twist)
    return {"s5": of(5, TOLERANCE), "s10": of(10, TOLERANCE), "s30": of(30, TOLERANCE), "n10": of(10, 0), "t10": of(10, TOLERANCE, True)}


def ruled(spark: SparkSession, d: str) -> DataFrame:
    """(k, dy, d, a, b, s5, s10, s30, n10) of all weightings."""
    df = parts(spark, d)
    coded = {c: G.shape_code(x) for c, x in shapes(df).items()}
    axes = F.array(*[F.struct(F.lit(name).alias("d"), axis(a).alias("a"), axis(b).alias("b")) for name, (a, b) in WEIGHTS.items()])
    return df.withColumns(coded).select("k", "dy", F.explode(axes).alias("x"), "s5", "s10", "s30", "n10").select("k", "dy", "x.*", "s5", "s10", "s30", "n10")


def _sql_parts() -> str:
    sums = ", ".join(f"sum(CASE WHEN c_mktsegment = '{n}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) {s}" for s, n in SEGMENTS.items())
    part = lambda s: f"CASE WHEN count({s}) OVER w10 > 0 THEN round(1000.0::DOUBLE * (CAST(sum({s}) OVER w28 AS DOUBLE) * count({s}) OVER o / (count({s}) OVER w28 * CAST(sum({s}) OVER o AS DOUBLE)) - 1)) END {s}"
    over = "o AS (PARTITION BY k), " + ", ".join(f"w{n} AS (PARTITION BY k ORDER BY dy RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)" for n in (10, 28))
    return f"dp AS (SELECT o_orderstatus k, CAST(o_orderdate AS DATE) dy, {sums} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), pa AS (SELECT k, dy, {', '.join(map(part, SEGMENTS))} FROM dp WINDOW {over})"


def _sql_axis(weights: dict[str, float]) -> str:
    num = "0.0::DOUBLE + " + " + ".join(f"coalesce({w}::DOUBLE * {s}, 0)" for s, w in weights.items())
    den = "0.0::DOUBLE + " + " + ".join(f"CASE WHEN {s} IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for s, w in weights.items())
    return f"CASE WHEN {den} >= {CUTOFF}::DOUBLE THEN round(({num}) / ({den}), 3) END"


def _sql_shape(w: int, tolerance: int, twist: bool = False, names: tuple = (1, 2, 3, 4, 6, 7)) -> str:
    s, g = f"(A - lag(A, {w}) OVER y)", f"(M - lag(M, {w}) OVER y)"
    one, two, three, four, flat, apart = names
    turn = f"WHEN {s} * {g} < 0 THEN {apart} " if twist else ""
    return f"CASE WHEN {s} IS NULL OR {g} IS NULL THEN NULL WHEN abs({g} - {s}) < {tolerance} THEN {flat} {turn}WHEN NOT ({s} + {g}) / 2 > 0 AND {g} < {s} THEN {one} WHEN NOT ({s} + {g}) / 2 > 0 AND {g} > {s} THEN {two} WHEN ({s} + {g}) / 2 > 0 AND {g} < {s} THEN {three} ELSE {four} END"


PARTS = _sql_parts()
_QUAD = "CASE WHEN {a} > 0 THEN CASE WHEN {b} > 0 THEN 2 ELSE 1 END ELSE CASE WHEN {b} > 0 THEN 4 ELSE 3 END END"
_LATCH = "CASE WHEN v IS NOT NULL THEN CAST(coalesce(last_value(CASE WHEN v >= th THEN 1 WHEN v < {lo} THEN 0 END IGNORE NULLS) OVER w, 0) - coalesce(last_value(CASE WHEN v <= -th THEN 1 WHEN v > -({lo}) THEN 0 END IGNORE NULLS) OVER w, 0) AS INT) END"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE st = {i}) n_{s.lower()}" for i, s in enumerate(G.STATES))
_SUMMARY = lambda v, n: f"round(coalesce(quantile_cont({v}, 0.5), 0), 6) {n}_median, round(coalesce(quantile_cont({v}, 0.25), 0), 6) {n}_q25, round(coalesce(quantile_cont({v}, 0.75), 0), 6) {n}_q75, coalesce(max({v}), 0) {n}_max"


def _pairs_sql() -> str:
    return " + ".join(f"CAST(count(*) FILTER (WHERE st IN ({', '.join(map(str, p))})) >= {AT_LEAST} AS INT)" for p in PAIRS)


def _runs(rows: str, cell: str) -> str:
    """Runs of st by cell: (cell, st, n days)."""
    return f"SELECT {cell}, st, coalesce(lead(a) OVER (PARTITION BY {cell} ORDER BY a), z + 1) - a n FROM (SELECT {cell}, g, any_value(st) st, min(dy) a, max(dy) z FROM (SELECT *, sum(CASE WHEN st IS DISTINCT FROM before OR first THEN 1 ELSE 0 END) OVER (PARTITION BY {cell} ORDER BY dy) g FROM (SELECT {cell}, dy, st, lag(st) OVER (PARTITION BY {cell} ORDER BY dy) before, row_number() OVER (PARTITION BY {cell} ORDER BY dy) = 1 first FROM {rows})) GROUP BY {cell}, g)"


def _hysteresis_ctes(kappas: list[float]) -> list[str]:
    cell = "k, q, kappa"
    return [
        PARTS,
        f"sc AS (SELECT k, dy, {_sql_axis(WEIGHTS['D4'][0])} a, {_sql_axis(WEIGHTS['D4'][1])} b FROM pa)",
        f"th AS (SELECT k, unnest({QS}::DOUBLE[]) q, unnest(quantile_cont(abs(a), {QS}::DOUBLE[])) ta, unnest(quantile_cont(abs(b), {QS}::DOUBLE[])) tb FROM sc GROUP BY k)",
        f"ce AS (SELECT k, q, kappa, round(ta, 6) ta, round(tb, 6) tb FROM th, (SELECT unnest({kappas}::DOUBLE[]) kappa))",
        "lo AS (SELECT ce.k, q, kappa, dy, 'a' ax, a v, ta th FROM ce JOIN sc USING (k) UNION ALL SELECT ce.k, q, kappa, dy, 'b', b, tb FROM ce JOIN sc USING (k))",
        f"hy AS (SELECT k, q, kappa, ax, dy, {_LATCH.format(lo='kappa * th')} s, {_LATCH.format(lo='th')} s1 FROM lo WINDOW w AS (PARTITION BY k, q, kappa, ax ORDER BY dy ROWS UNBOUNDED PRECEDING))",
        f"z0 AS (SELECT {cell}, dy, max(s) FILTER (WHERE ax = 'a') sa, max(s) FILTER (WHERE ax = 'b') sb, bool_or(coalesce(s, 0) <> coalesce(s1, 0)) held FROM hy GROUP BY {cell}, dy)",
        f"z AS (SELECT *, CASE WHEN sa IS NULL OR sb IS NULL THEN 5 WHEN sa = 0 OR sb = 0 THEN 0 ELSE {_QUAD.format(a='sa', b='sb')} END st FROM z0)",
        f"mo AS (SELECT {cell}, year(dy) * 12 + month(dy) - 1 mm, arg_max(st, dy) st FROM z GROUP BY ALL)",
        f"ms AS (SELECT {cell}, count(*) FILTER (WHERE st = 0) / count(*) center_share, count(*) FILTER (WHERE st BETWEEN 1 AND 4) / count(*) quad_share, {_COUNTS}, {_pairs_sql()} pairs_ok, count(*) FILTER (WHERE st BETWEEN 1 AND 4 AND mm <= {_month(EARLY)}) early_quad, count(*) FILTER (WHERE st BETWEEN 1 AND 4 AND mm >= {_month(LATE)}) late_quad FROM mo GROUP BY ALL)",
        f"ds AS (SELECT {cell}, count(*) FILTER (WHERE st = 0) / count(*) daily_center_share, count(*) FILTER (WHERE st BETWEEN 1 AND 4) / count(*) daily_quad_share, avg(CAST(held AS INT)) held_share FROM z GROUP BY {cell})",
        f"ru AS ({_runs('z', cell)})",
        f"rs AS (SELECT {cell}, count(*) FILTER (WHERE st BETWEEN 1 AND 4) n_spells, coalesce(avg(n) FILTER (WHERE st BETWEEN 1 AND 4), 0) spell_mean, coalesce(median(n) FILTER (WHERE st BETWEEN 1 AND 4), 0) spell_median FROM ru GROUP BY {cell})",
        f"e0 AS (SELECT *, lead(dy) OVER w nd, row_number() OVER w i, last_value(CASE WHEN s1 <> 0 THEN s1 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pv FROM hy WINDOW w AS (PARTITION BY {cell}, ax ORDER BY dy))",
        f"e1 AS (SELECT *, sum(CASE WHEN s1 <> 0 AND s1 IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY {cell}, ax ORDER BY dy) ep FROM e0)",
        f"e2 AS (SELECT *, max(ep) OVER (PARTITION BY {cell}, ax) last_ep, first_value(s1) OVER (PARTITION BY {cell}, ax, ep ORDER BY dy) v, row_number() OVER (PARTITION BY {cell}, ax, ep ORDER BY dy) > 1 later FROM e1)",
        f"e3 AS (SELECT {cell}, ax, ep, arg_max(nd, i) turn, arg_max(nd, i) FILTER (WHERE s1 = v) bl, arg_max(nd, i) FILTER (WHERE s1 = v OR s = v) tl, min(dy) FILTER (WHERE later AND s1 IS DISTINCT FROM v) bf, min(dy) FILTER (WHERE later AND s IS DISTINCT FROM v) tf FROM e2 WHERE ep > 0 AND ep < last_ep GROUP BY {cell}, ax, ep)",
        f"de AS (SELECT {cell}, count(*) delay_n, {_SUMMARY('tl - bl', 'delay')}, {_SUMMARY('coalesce(tf, turn) - coalesce(bf, turn)', 'hold')} FROM e3 GROUP BY {cell})",
        "gr AS (SELECT ce.k, ce.q, ce.kappa, ta theta_a, tb theta_b, ms.* EXCLUDE (k, q, kappa), daily_center_share, daily_quad_share, held_share, n_spells, spell_mean, spell_median, coalesce(delay_n, 0) delay_n, " + ", ".join(f"coalesce({n}_{x}, 0) {n}_{x}" for n in ("delay", "hold") for x in ("median", "q25", "q75", "max")) + " FROM ce JOIN ms USING (k, q, kappa) JOIN ds USING (k, q, kappa) JOIN rs USING (k, q, kappa) LEFT JOIN de USING (k, q, kappa))",
    ]


def _month(text: str) -> int:
    return int(text[:4]) * 12 + int(text[5:7]) - 1


def q(ctes: list[str], body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


_HYSTERESIS = {"k": "string"} | {n: {"long": "bigint"}.get(t, t) for n, t in (x.split() for x in G._HYSTERESIS.split(", "))}


def _grid(spark: SparkSession, d: str, kappas: list[float] = KAPPAS) -> DataFrame:
    return G.hysteresis_grid(scores(spark, d), ["k"], "dy", "a", "b", QS, kappas, PAIRS, AT_LEAST, EARLY, LATE)


@q(_hysteresis_ctes(KAPPAS), "SELECT * FROM gr", **_HYSTERESIS)
def hysteresis_grid(spark, d):
    return _grid(spark, d)


_REQ = f"SELECT *, center_share BETWEEN {LOW}::DOUBLE AND {HIGH}::DOUBLE req_a, spell_mean >= {DAYS} req_b FROM gr"
_RANKED = f"SELECT *, CASE WHEN solved THEN 'solution' ELSE 'support' END kind, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN solved THEN req_a AND req_b WHEN partly THEN req_a ELSE true END DESC, CASE WHEN solved THEN 0 ELSE -spell_mean END, kappa DESC, abs(center_share - {TARGET}::DOUBLE), q) rank FROM (SELECT *, max(req_a AND req_b) OVER (PARTITION BY k) solved, max(req_a) OVER (PARTITION BY k) partly FROM rq)"


@q([*_hysteresis_ctes(KAPPAS), f"rq AS ({_REQ})"], f"SELECT k, q, kappa, req_a, req_b, kind, rank FROM ({_RANKED})", k="string", q="double", kappa="double", req_a="boolean", req_b="boolean", kind="string", rank="bigint")
def hysteresis_choice(spark, d):
    return G.choose(_grid(spark, d), ["k"], LOW, HIGH, DAYS, TARGET)


@q(_hysteresis_ctes([0.0]), f"SELECT k, q, center_share, n_spells, spell_mean, w AS within, w AND row_number() OVER (PARTITION BY k ORDER BY w DESC, spell_mean DESC, q) = 1 best, {DAYS} - spell_mean short FROM (SELECT *, center_share BETWEEN {LOW}::DOUBLE AND {HIGH}::DOUBLE w FROM gr)", k="string", q="double", center_share="double", n_spells="bigint", spell_mean="double", within="boolean", best="boolean", short="double")
def hysteresis_limit(spark, d):
    return G.limit_of_memory(_grid(spark, d, [0.0]), ["k"], LOW, HIGH, DAYS)


_SHAPES = ", ".join(f"coalesce({_sql_shape(w, t)}, 9) {n}" for n, w, t in (("s5", 5, TOLERANCE), ("s10", 10, TOLERANCE), ("s30", 30, TOLERANCE), ("n10", 10, 0)))
_VOTE = "CASE WHEN CAST(s5 <> 9 AS INT) + CAST(s10 <> 9 AS INT) + CAST(s30 <> 9 AS INT) < 2 THEN 9 WHEN s5 <> 9 AND (s5 = s10 OR s5 = s30) THEN s5 WHEN s10 <> 9 AND s10 = s30 THEN s10 ELSE 8 END"
_OK = "CASE a_ WHEN 'A0' THEN s10 = nm WHEN 'A1' THEN vt = nm WHEN 'A2' THEN s5 = nm OR s10 = nm OR s30 = nm WHEN 'A5' THEN n10 = nm ELSE true END"
_STATE = "CASE WHEN a IS NULL OR b IS NULL OR ta IS NULL OR tb IS NULL THEN 5 WHEN CASE WHEN bc = 'AND' THEN abs(a) < ta AND abs(b) < tb ELSE abs(a) < ta OR abs(b) < tb END OR NOT ok THEN 0 ELSE nm END"


def _names(values, name: str) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{v}'" for v in values) + f"]) {name})"


def _rule_ctes() -> list[str]:
    weighed = " UNION ALL ".join(f"SELECT k, dy, '{n}' d, {_sql_axis(a)} a, {_sql_axis(b)} b, s5, s10, s30, n10 FROM sh" for n, (a, b) in WEIGHTS.items())
    cell = "k, d, a_, bc, bq"
    by_rule = lambda v: f"SELECT {cell if v == 'st' else 'k'}, 'C_M' c, mm, arg_max({v}, dy) v FROM {{0}} GROUP BY ALL UNION ALL SELECT {cell if v == 'st' else 'k'}, c, mm, arg_min({v}, {v} - 100 * n) v FROM (SELECT {cell if v == 'st' else 'k'}, c, mm, {v}, count(*) n FROM (SELECT *, 'C_D' c FROM {{0}} UNION ALL SELECT *, 'C_W' FROM {{0}} WHERE week_end) GROUP BY ALL) GROUP BY ALL"
    lifts = lambda w: f"l{w} AS (SELECT {cell}, c, n_eq / n / (pr / n / n) lift FROM (SELECT {cell}, c, count(*) n, sum(eq) n_eq FROM (SELECT m.*, CAST(m.v = s.v AS INT) eq FROM mo m JOIN sm s ON s.k = m.k AND s.c = m.c AND s.mm = m.mm AND s.w = {w} WHERE m.v BETWEEN 1 AND 4 AND s.v BETWEEN 1 AND 4) GROUP BY ALL) JOIN (SELECT {cell}, c, sum(x * y) pr FROM (SELECT {cell}, c, s, sum(CAST(mv = s AS INT)) x, sum(CAST(sv = s AS INT)) y FROM (SELECT m.*, m.v mv, s.v sv FROM mo m JOIN sm s ON s.k = m.k AND s.c = m.c AND s.mm = m.mm AND s.w = {w} WHERE m.v BETWEEN 1 AND 4 AND s.v BETWEEN 1 AND 4), (SELECT unnest([1, 2, 3, 4]) s) GROUP BY ALL) GROUP BY ALL) USING ({cell}, c) WHERE pr > 0)"
    return [
        PARTS,
        f"sh AS (SELECT *, {_SHAPES} FROM pa WINDOW y AS (PARTITION BY k ORDER BY dy))",
        f"ru AS (SELECT *, {_QUAD.format(a='a', b='b')} nm, {_VOTE} vt FROM ({weighed}))",
        f"al AS (SELECT *, {_OK} ok FROM ru, {_names(G.A_LEVELS, 'a_')})",
        f"tq AS (SELECT k, d, unnest({RULE_QS}::DOUBLE[]) q, unnest(quantile_cont(abs(a), {RULE_QS}::DOUBLE[])) ta, unnest(quantile_cont(abs(b), {RULE_QS}::DOUBLE[])) tb FROM ru WHERE dy <= DATE '{CALIBRATION}' GROUP BY k, d HAVING count(a) > 0 AND count(b) > 0)",
        f"cd AS (SELECT k, d, a_, bc, q, ta, tb, dy, {_STATE} st FROM (SELECT al.*, q, round(ta, 6) ta, round(tb, 6) tb, bc FROM al JOIN tq USING (k, d), {_names(G.B_LEVELS, 'bc')} WHERE dy <= DATE '{CALIBRATION}'))",
        f"cr AS ({_runs('cd', 'k, d, a_, bc, q')})",
        "cl AS (SELECT k, d, a_, bc, q, avg(n) every, coalesce(avg(n) FILTER (WHERE st BETWEEN 1 AND 4), 0) named FROM cr GROUP BY ALL)",
        "cc AS (SELECT k, d, a_, bc, q, ta, tb, avg(CAST(st = 0 AS INT)) centre FROM cd GROUP BY ALL)",
        f"ca AS (SELECT *, round(abs(centre - {TARGET}::DOUBLE), 9) off FROM cc JOIN cl USING (k, d, a_, bc, q))",
        " , ".join(
            [
                f"ch AS (SELECT k, d, a_, bc, bq, q, ta, tb, bad FROM (SELECT *, row_number() OVER (PARTITION BY k, d, a_, bc, bq ORDER BY o1, o2) rn FROM (SELECT *, 'Bq_B' bq, CASE WHEN every >= {SPELL} THEN 0 ELSE 1 END o1, CASE WHEN every >= {SPELL} THEN q ELSE -q END o2, every < {SPELL} bad FROM ca UNION ALL SELECT *, 'Bq_BQUAD', CASE WHEN named >= {SPELL} THEN 0 ELSE 1 END, CASE WHEN named >= {SPELL} THEN q ELSE -q END, named < {SPELL} FROM ca UNION ALL SELECT *, 'Bq_A20', abs(q - {TARGET}::DOUBLE), q, false FROM ca UNION ALL SELECT *, 'Bq_JOINT', off, q, abs(centre - {TARGET}::DOUBLE) > 0.05::DOUBLE FROM ca)) WHERE rn = 1)",
                f"ev AS (SELECT kd.k, kd.d, a_, bc, bq, ch.q, ch.ta, ch.tb, coalesce(bad, true) bad FROM (SELECT DISTINCT k, d FROM ru) kd CROSS JOIN {_names(G.A_LEVELS, 'a_')} CROSS JOIN {_names(G.B_LEVELS, 'bc')} CROSS JOIN {_names(G.Q_LEVELS, 'bq')} LEFT JOIN ch USING (k, d, a_, bc, bq))",
                f"dl AS (SELECT {cell}, dy, mm, week_end, {_STATE} st FROM (SELECT al.*, bc, bq, ta, tb, year(dy) * 12 + month(dy) - 1 mm, date_trunc('week', dy) IS DISTINCT FROM date_trunc('week', lead(dy) OVER (PARTITION BY k, d, a_, bc, bq ORDER BY dy)) week_end FROM al JOIN ev USING (k, d, a_)))",
                f"m0 AS ({by_rule('st').format('dl')})",
                f"mo AS (SELECT {cell}, c, mm, coalesce(v, 5) v FROM (SELECT DISTINCT {cell}, mm FROM dl) CROSS JOIN {_names(G.C_LEVELS, 'c')} LEFT JOIN m0 USING ({cell}, c, mm))",
                "sd AS (SELECT k, dy, s10, s30, year(dy) * 12 + month(dy) - 1 mm, date_trunc('week', dy) IS DISTINCT FROM date_trunc('week', lead(dy) OVER (PARTITION BY k ORDER BY dy)) week_end FROM sh)",
                f"sm AS (SELECT 10 w, * FROM ({by_rule('s10').format('sd')}) UNION ALL SELECT 30, * FROM ({by_rule('s30').format('sd')}))",
                lifts(10), lifts(30),
                f"rr AS ({_runs('dl', cell)})",
                f"rs AS (SELECT {cell}, count(*) FILTER (WHERE st BETWEEN 1 AND 4) n_spells, coalesce(avg(n) FILTER (WHERE st BETWEEN 1 AND 4), 0) spell_mean, coalesce(median(n) FILTER (WHERE st BETWEEN 1 AND 4), 0) spell_median, avg(n) spell_all FROM rr GROUP BY {cell})",
                f"ad AS (SELECT {cell}, count(DISTINCT mm) FILTER (WHERE st = 3) iii_any_day FROM dl GROUP BY {cell})",
                f"ms AS (SELECT {cell}, c, count(*) FILTER (WHERE st = 0) / count(*) center_share, count(*) FILTER (WHERE st BETWEEN 1 AND 4) / count(*) quad_share, {_COUNTS}, {_pairs_sql()} pairs_ok FROM (SELECT *, v st FROM mo) GROUP BY ALL)",
                f"gr AS (SELECT ev.k, ev.d, ev.a_ a, ev.bc, ev.bq, ms.c, ev.q, ta theta_a, tb theta_b, bad no_admissible, ms.* EXCLUDE (k, d, a_, bc, bq, c), iii_any_day, n_spells, spell_mean, spell_median, spell_all, CASE WHEN quad_share > 0 THEN least(n_i, n_ii, n_iii, n_iv) / (n_i + n_ii + n_iii + n_iv) ELSE 0 END smallest_share, l10.lift lift10, l30.lift lift30 FROM ev JOIN ms USING ({cell}) JOIN rs USING ({cell}) JOIN ad USING ({cell}) LEFT JOIN l10 USING ({cell}, c) LEFT JOIN l30 USING ({cell}, c))",
            ]
        ),
    ]


_RULES = {"k": "string"} | {n: {"long": "bigint"}.get(t, t) for n, t in (x.split() for x in G._RULES.split(", "))}
S1, S3, S4 = 0.2, 0.05, 5


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return G.rule_grid(ruled(spark, d), ["k"], "dy", list(WEIGHTS), RULE_QS, PAIRS, AT_LEAST, CALIBRATION, SPELL, TARGET)


@q(_rule_ctes(), "SELECT * FROM gr", **_RULES)
def rule_grid(spark, d):
    return _rules(spark, d)


_MEETS = f"SELECT *, CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) + CAST(s4 AS INT) met, concat_ws('|', a, bq, bc, c, d) cell FROM (SELECT *, quad_share >= {S1}::DOUBLE s1, spell_mean >= {SPELL} s2, n_i > 0 AND n_ii > 0 AND n_iii > 0 AND n_iv > 0 AND smallest_share >= {S3}::DOUBLE s3, pairs_ok >= {S4} s4 FROM gr)"


@q([*_rule_ctes(), f"mt AS ({_MEETS})"], "SELECT k, cell, s1, s2, s3, s4, met, row_number() OVER (PARTITION BY k ORDER BY met DESC, pairs_ok DESC, quad_share DESC, cell) rank FROM mt", k="string", cell="string", s1="boolean", s2="boolean", s3="boolean", s4="boolean", met="int", rank="bigint")
def rule_ranking(spark, d):
    return G.rank_rules(G.scored(_rules(spark, d), S1, SPELL, S3, S4), ["k"])


_REMOVED = ", ".join(f"('{n}', '{a}', {s}::DOUBLE)" for n, a, s in G.REMOVALS)


@q(
    [
        PARTS,
        f"sh AS (SELECT *, {_SHAPES} FROM pa WINDOW y AS (PARTITION BY k ORDER BY dy))",
        f"ru AS (SELECT *, {_QUAD.format(a='a', b='b')} nm, {_VOTE} vt, 'OR' bc FROM (SELECT k, dy, {_sql_axis(WEIGHTS['D0'][0])} a, {_sql_axis(WEIGHTS['D0'][1])} b, s5, s10, s30, n10 FROM sh))",
        "th AS (SELECT k, round(quantile_cont(abs(a), 0.3), 6) xa, round(quantile_cont(abs(b), 0.3), 6) xb FROM ru GROUP BY k HAVING count(a) > 0 AND count(b) > 0)",
        f"dl AS (SELECT k, removed, dy, {_STATE} st FROM (SELECT *, share * xa ta, share * xb tb, {_OK} ok FROM ru JOIN th USING (k), (VALUES {_REMOVED}) z(removed, a_, share)))",
        f"rr AS ({_runs('dl', 'k, removed')})",
        "mo AS (SELECT k, removed, arg_max(st, dy) st FROM dl GROUP BY k, removed, year(dy) * 12 + month(dy))",
    ],
    "SELECT *, (SELECT coalesce(avg(n), 0) FROM rr WHERE rr.k = x.k AND rr.removed = x.removed AND st BETWEEN 1 AND 4) spell_mean FROM (SELECT k, removed, count(*) AS months, count(*) FILTER (WHERE st BETWEEN 1 AND 4) named, count(*) FILTER (WHERE st = 3) iii FROM mo GROUP BY k, removed) x",
    k="string", removed="string", months="bigint", named="bigint", iii="bigint", spell_mean="double",
)
def silence_budget(spark, d):
    x = ruled(spark, d).where("d = 'D0'")
    at = lambda c: F.round(F.percentile(F.abs(c), F.lit(0.3)), 6)
    theta = x.groupBy("k").agg(at("a").alias("theta_a"), at("b").alias("theta_b")).where("theta_a is not null and theta_b is not null")
    return G.silence_budget(x, ["k"], "dy", theta)


_NAMES = ("'I'", "'II'", "'III'", "'IV'", "'PARALLEL'", "'TWIST'")


@q(
    [PARTS, f"sh AS (SELECT k, dy, {_sql_shape(5, TOLERANCE, True, _NAMES)} s5, {_sql_shape(10, TOLERANCE, True, _NAMES)} s10, {_sql_shape(30, TOLERANCE, True, _NAMES)} s30 FROM pa WINDOW y AS (PARTITION BY k ORDER BY dy))"],
    "SELECT k, dy, s5, s10, s30, CASE WHEN CAST(s5 IS NOT NULL AS INT) + CAST(s10 IS NOT NULL AS INT) + CAST(s30 IS NOT NULL AS INT) < 2 THEN NULL WHEN s5 = s10 OR s5 = s30 THEN s5 WHEN s10 = s30 THEN s10 ELSE 'NOAGREE' END vote FROM sh",
    k="string", dy="date", s5="string", s10="string", s30="string", vote="string",
)
def curve_votes(spark, d):
    df, at = parts(spark, d), Window.partitionBy("k").orderBy("dy")
    move = lambda s, w: F.col(s) - F.lag(s, w).over(at)
    df = df.withColumns({f"s{w}": C.curve_shape(move("A", w), move("M", w), TOLERANCE, twist=True) for w in (5, 10, 30)})
    return df.withColumn("vote", G.shape_vote([F.col("s5"), F.col("s10"), F.col("s30")]))
