"""Small fixtures with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import grids, joins, order, provenance, quality, series, states, stats, vintage


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_crps_by_hand(spark):
    pairs = [(v, n) for v, n in zip((-30, -20, -10, 0, 10, 20, 30), (5, 10, 15, 25, 20, 15, 10))]
    wide = spark.createDataFrame([(1, float(v), -20.0) for v, n in pairs for _ in range(n)], "g int, x double, o double")
    narrow = spark.createDataFrame([(1, float(v), -20.0) for v, n in ((0, 70), (10, 30)) for _ in range(n)], "g int, x double, o double")
    assert stats.crps(wide, ["g"], "x", "o").first()["crps"] == pytest.approx(14.90)
    assert stats.crps(narrow, ["g"], "x", "o").first()["crps"] == pytest.approx(20.90)


def test_cross_correlation_finds_a_known_lead(spark):
    noise = [math.sin(i * i) for i in range(80)]
    x = spark.createDataFrame([(i, noise[i]) for i in range(80)], "t long, v double")
    y = spark.createDataFrame([(i + 5, noise[i]) for i in range(80)], "t long, v double")
    best = stats.peak_lag(stats.cross_correlation(x, y, [], 10), []).first()
    assert best["h"] == 5 and best["r"] == pytest.approx(1.0)


def test_break_is_found_where_it_is(spark):
    data = [(i, float(i % 7), (1.0 if i < 30 else 3.0) * (i % 7) + 0.01 * math.sin(i)) for i in range(60)]
    df = spark.createDataFrame(data, "t long, x double, y double")
    assert stats.sup_f(df, [], "t", "x", "y").first()["break_t"] in (28, 29)
    best = min(stats.breaks_bic(df, [], "t", "x", "y", 10, 2).collect(), key=lambda r: r["bic"])
    assert best["m"] == 1 and abs(best["at"][0] - 30) <= 1


def test_hysteresis_branches_and_nulls(spark):
    path = [0.0, 0.6, 1.2, None, 0.7, 0.4, -0.6, -1.0, -0.7, None, -0.4, 1.0, -1.0]
    df = spark.createDataFrame(list(enumerate(path)), "t int, x double")
    got = [r["state"] for r in series.hysteresis(df, [], "t", "x", 1.0, 0.5).orderBy("t").collect()]
    assert got == [0, 0, 1, None, 1, 0, 0, -1, -1, None, 0, 1, -1]


def test_signals_score_all_outcomes(spark):
    s = spark.createDataFrame([(10,), (30,), (58,)], "t long")
    e = spark.createDataFrame([(12,), (45,)], "t long")
    assert rows(joins.score_signals(s, e, [], 6, 60), "t", "outcome") == [(10, "TP"), (30, "FA"), (58, "CENSORED")]
    assert rows(joins.missed_events(s, e, [], 6, 0, 60), "t") == [(45,)]
    # an event whose window begins before the data, one after them
    more = e.unionByName(spark.createDataFrame([(3,), (99,)], "t long"))
    assert rows(joins.missed_events(s, more, [], 6, 0, 60), "t") == [(45,)] and rows(joins.missed_events(s, more, [], 6, -5, 99), "t") == [(3,), (45,), (99,)]


def test_asof_takes_equal_times_only_where_exact(spark):
    left = spark.createDataFrame([(1, 5), (1, 4), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 50.0), (1, 3, 30.0)], "k int, t int, v double")
    assert rows(joins.asof(left, right, ["k"], "t", "v").where("v is not null"), "k", "t", "v") == [(1, 4, 30.0), (1, 5, 50.0)]
    assert rows(joins.asof(left, right, ["k"], "t", "v", exact=False).where("v is not null"), "k", "t", "v") == [(1, 4, 30.0), (1, 5, 30.0)]


def test_matching_is_one_to_one(spark):
    a = spark.createDataFrame([(1, 10), (1, 12)], "k int, t long")
    b = spark.createDataFrame([(1, 11), (1, 30)], "k int, t long")
    assert rows(joins.match_events(a, b, ["k"], 12), "a", "b") == [(10, 11)]


def test_degenerate_inputs_give_null(spark):
    flat = spark.createDataFrame([(1, 1.0, 2.0)] * 5, "g int, x double, y double")
    assert flat.groupBy("g").agg(stats.correlation("x", "y").alias("r")).first()["r"] is None
    empty = spark.createDataFrame([], "t long, v double")
    assert series.islands(empty, [], 1).count() == 0 and series.largest_drawdown(empty, []).count() == 0


def test_vintage_matrix_years(spark):
    wide = spark.createDataFrame([("1999:Q4", 1.0, 2.0)], "obs string, ROUTPUT65Q4 double, ROUTPUT00Q1 double")
    assert rows(vintage.matrix_long(wide, "obs", "ROUTPUT"), "vintage", "v") == [(1965 * 4 + 3, 1.0), (2000 * 4, 2.0)]


def test_mode_and_holes(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "u int, s string")
    assert rows(states.mode(df, ["u"], "s", ["b", "a", "c"]), "u", "s") == [(1, "b"), (2, "c")]
    t = spark.createDataFrame([(1,), (4,)], "t long").withColumn("k", F.lit("x"))
    assert rows(quality.holes(t, ["k"]), "t") == [(2,), (3,)]


def test_quadrants_and_shapes_by_hand(spark):
    cases = [(1.0, -1.0, "I"), (1.0, 1.0, "II"), (-1.0, -1.0, "III"), (-1.0, 1.0, "IV"), (0.1, 1.0, "CENTER"), (1.0, 0.1, "CENTER"), (None, 1.0, "ANOMALY"), (0.0, None, "ANOMALY")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a double, b double")
    state = lambda **k: [r["s"] for r in df.select("i", states.quadrant(F.col("a"), F.col("b"), 0.5, 0.5, **k).alias("s")).orderBy("i").collect()]
    assert state() == [c[2] for c in cases]
    assert state(both=True)[4:6] == ["II", "II"]
    assert state(shape=F.when(F.col("i") == 0, "I").when(F.col("i") == 1, "III")) == ["I", "CENTER", "CENTER", "CENTER", "CENTER", "CENTER", "ANOMALY", "ANOMALY"]
    moves = [(-0.1, -0.5, "I"), (-0.5, -0.1, "II"), (0.5, 0.1, "III"), (0.1, 0.5, "IV"), (0.1, 0.3, "PARALLEL"), (0.1, 0.4, "IV"), (-0.5, 0.3, "II"), (None, 0.1, None)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(moves)], "i int, a double, b double").select("i", states.curve_shape(F.col("a"), F.col("b"), 0.25).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [m[2] for m in moves]


def test_coherence_counts_named_states_only(spark):
    pairs = [("I", "I"), ("I", "II"), ("II", "II"), ("CENTER", "I"), ("I", "PARALLEL"), (None, "I")]
    got = states.coherence(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert got["n"] == 3 and got["observed"] == pytest.approx(2 / 3) and got["expected"] == pytest.approx((2 * 1 + 1 * 2) / 9) and got["lift"] == pytest.approx(1.5)
    assert states.coherence(spark.createDataFrame(pairs[3:], "a string, b string"), "a", "b").first()[:2] == (0, None)


def test_reversal_delays_by_hand(spark):
    # base holds 1 on days 0..2, lets go on 3 and 4, turns on 5; test lets go on 4 only; the third run has no reversal
    base = [1, 1, 1, 0, None, -1, 0, -1, 1, 1]
    test = [0, 1, 1, 1, 0, 1, -1, -1, -1, 1]
    days = [f"2020-01-{d:02d}" for d in (1, 2, 3, 6, 7, 8, 9, 10, 13, 14)]
    df = spark.createDataFrame(list(zip(days, base, test)), "day string, b int, t int").withColumn("day", F.to_date("day"))
    got = series.reversal_delays(df, [], "day", "b", "t").orderBy("start").collect()
    # run 1: last held by base on the 3rd (next day the 6th), by test on the 6th (next the 7th); first lost by base on the 6th, by test on the 7th
    # run 2: base last on the 10th, test too; base lost on the 9th, test not before the turn on the 13th
    assert [(str(r["start"]), r["sign"], r["last_delay"], r["first_delay"]) for r in got] == [("2020-01-01", 1, 1, 1), ("2020-01-08", -1, 0, 4)]


def test_youden_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0), (4.0, 1), (5.0, 0), (None, 1)], "s double, y int")
    got = stats.youden(df, [], "s", "y").first()
    assert got["threshold"] == 2.5 and got["j"] == pytest.approx(2 / 3)
    assert tuple(stats.youden(spark.createDataFrame([(7.0, 1), (7.0, 0)], "s double, y int"), [], "s", "y").first()) == (7.0, 0.0)
    assert stats.youden(df.where("y = 1"), [], "s", "y").count() == 0


def test_extrema_by_hand(spark):
    path = {0: 1.0, 1: 3.0, 2: 3.0, 3: 0.0, 4: 0.0, 7: 2.0, 8: 2.0, 9: 2.0, 10: 2.0, 11: 2.0, 12: 5.0, 13: 1.0}
    df = spark.createDataFrame(list(path.items()), "t long, v double")
    # of the window of 12 four months are there, of that of 13 three
    assert rows(series.extrema(df, [], 2), "t") == [(1,), (12,)]
    assert rows(series.extrema(df, [], 2, kind="min"), "t") == [(3,), (10,)]


def test_lenient_dates_of_annual_and_serial_cells(spark):
    from tidemark.functions import scalars

    df = spark.createDataFrame([("2020",), ("43831",), ("Feb-68",), ("31-Dec-1999",), (" 7/4/1999 ",)], "x string")
    one = lambda **k: [str(r[0]) for r in df.select(scalars.lenient_date(F.col("x"), **k)).collect()]
    assert one() == ["None", "None", "1968-02-01", "1999-12-31", "1999-07-04"]
    assert one(annual=True)[:2] == ["2020-01-01", "None"] and one(serial=True)[1] == "2020-01-01"


def test_exact_permutation_by_hand(spark):
    got = stats.exact_permutation(spark.createDataFrame([(1, 1.0, True), (2, 2.0, False), (3, 6.0, True), (4, 3.0, False)], "u int, v double, one boolean"), 2, "u", "v", "one").first()
    # sums of two: 3 7 4 8 5 9 of 12; differences -3 1 -2 2 -1 3, observed 1
    assert tuple(got) == (1.0, 6, 1.0)


def test_three_of_five_leaks_are_caught(spark):
    rows = [("a", t, math.exp(0.01 * t + 0.2 * math.sin(t * t))) for t in range(70)] + [("b", t, math.exp(0.02 * t + 0.1 * math.cos(3 * t * t))) for t in range(50)]
    points = provenance.measured(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 12, 12)
    got = {(r["k"], r["leak"]): r for r in provenance.leak_report(points, ["k"], 12, 12, 24).collect()}
    for k, n in (("a", 70), ("b", 50)):
        assert [leak for leak in ("L0", "L1", "L2", "L3", "L4", "L5") if got[k, leak]["caught"]] == ["L1", "L2", "L5"]
        assert all(got[k, leak]["origins"] == n - 12 - 24 and got[k, leak]["first_origin"] == 24 for leak in ("L1", "L2", "L5"))
        assert abs(got[k, "L0"]["base_gain"]) + abs(got[k, "L3"]["base_gain"]) < 1e-9 < abs(got[k, "L2"]["base_gain"]) and abs(got[k, "L3"]["delta"] - got[k, "L0"]["delta"]) > 1e-9
    assert got["a", "L1"]["failed"] == "ensemble,ensemble sources" and got["a", "L5"]["failed"] == "recent,recent sources"


def test_sets_with_the_same_ends_and_number_are_told_apart(spark):
    df = spark.createDataFrame([(i, i != 3) for i in range(8)], "i long, there boolean")
    df = provenance.sources_over(df.withColumn("k", F.lit(0)), ["k"], "i", "s", -3, 0, F.col("there"))
    whole = {r["i"]: r["ok"] for r in df.select("i", provenance.is_range("s", F.col("i") - 3, F.col("i")).alias("ok")).collect()}
    assert whole == {0: False, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}


def hysteresis(xs, high, low):
    """Signs with memory, one by one."""
    out, s = [], 0
    for x in xs:
        if x is not None:
            if x >= high:
                s = 1
            elif x <= -high:
                s = -1
            elif s * x < low:
                s = 0
        out.append(0 if x is None else s)
    return out


def test_cells_of_the_grid_by_brute_force():
    import numpy as np

    r = random.Random(3)
    xs = [None if r.random() < 0.1 else round(r.uniform(-1, 1), 3) for _ in range(300)]
    v = np.array([np.nan if x is None else x for x in xs])
    high, low = np.array([0.2, 0.5, 0.5, 0.9]), np.array([0.2, 0.1, 0.0, 0.45])
    got = np.where(np.isnan(v)[:, None], 0, grids.latched(v, high, low))
    assert [got[:, c].tolist() for c in range(4)] == [hysteresis(xs, h, l_) for h, l_ in zip(high, low, strict=True)]
    kind, size = grids.runs(np.array([1, 1, 0, 2, 2, 2]), np.array([3, 5, 6, 9, 10, 20]))
    assert kind.tolist() == [1, 0, 2] and size.tolist() == [3, 3, 12]
    shapes = [np.array(x) for x in ([1, 1, 9, 9, 6, 2], [1, 2, 9, 3, 6, 3], [3, 1, 4, 3, 2, 4])]
    assert grids.vote(shapes).tolist() == [1, 1, 9, 3, 6, 8]
    assert grids.modal(np.array([3, 1, 1, 3, 2]), np.array([5, 5, 5, 5, 7]), np.array([5, 6, 7])).tolist() == [1, 5, 2]


def test_joins_and_shares_without_a_query(spark):
    panel = spark.createDataFrame([(k, t) for k, absent in (("a", 4), ("b", 9)) for t in range(14) if t != absent], "k string, t int")
    assert {r["t"] for r in joins.balanced_panel(panel, "k", 1).collect()} == {1, 2, 6, 7, 11, 12}
    assert {r["t"] for r in joins.balanced_panel(panel, "k", 1, excluded=(5, 11)).collect()} == {1, 2, 12}
    points, ranges = spark.createDataFrame([(1, 5.0), (2, 6.0)], "t int, v double"), spark.createDataFrame([(2, 1.0, 2.0), (3, 4.0, 4.5)], "t int, lower double, upper double")
    assert sorted(tuple(r) for r in joins.merged_target(points, ranges).collect()) == [(1, 5.0), (2, 1.5), (3, 4.25)]
    a, b = (spark.createDataFrame([(t, float(t * f)) for t in ts], "t int, v double") for f, ts in ((1, (1, 2, 3, 4)), (2, (2, 3, 4, 5))))
    assert sorted(tuple(r) for r in joins.aligned_routes(a, b).select("t", "a", "b").collect()) == [(2, 2.0, 4.0), (3, 3.0, 6.0), (4, 4.0, 8.0)]
    with pytest.raises(Exception):
        joins.aligned_routes(a, b.where("t <> 3")).collect()
    draws = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 2.0)], "x double")
    assert stats.tail_share(draws, "x", 2.0).first()["p"] == 3 / 5 and stats.tail_share(draws, "x", 2.0, two_sided=False).first()["p"] == 2 / 5


def test_windows_cut_into_stretches_are_whole(spark):
    import numpy as np

    r = random.Random(8)
    days = sorted(r.sample(range(-500, 1500), 400))
    values = [None if r.random() < 0.1 else float(r.randint(0, 9)) for _ in days]
    df = spark.createDataFrame([(0, d, v) for d, v in zip(days, values, strict=True)] + [(0, days[7], 5.0)], "k int, n long, v double")
    rows = [*zip(days, values, strict=True), (days[7], 5.0)]
    held = {d: [v for e, v in rows if v is not None and d - 90 <= e <= d] for d in days}
    mads = {d: float(np.median(np.abs(np.array(x) - np.median(x)))) for d, x in held.items() if len(x) >= 10}
    got = series.rolling_mad(df, ["k"], "n", "v", 90, 10).collect()
    assert len(got) == 401 and all(r["mad"] == (mads.get(r["n"]) or None) for r in got)
    quantiles = {d: float(np.quantile(x, 0.4)) for d, x in held.items() if len(x) >= 10}
    for stretch in (7, 360, 5000):
        out = series.sliding(df, ["k"], "n", "v", 90, lambda x, a, b: b - a, stretch)
        assert {r["n"]: r["out"] for r in out.collect()} == {d: len(x) for d, x in held.items()}
    found = {r["n"]: r["out"] for r in series.trailing_quantile(df, ["k"], "n", "v", 90, 0.4, 10).collect()}
    assert all(found[d] == (pytest.approx(quantiles[d]) if d in quantiles else None) for d in days)


def test_policy_phase_by_hand(spark):
    df = spark.createDataFrame([(0, 2.0), (10, 2.0), (20, 3.0), (30, 1.0), (40, 1.0)], "n long, v double").withColumn("k", F.lit("a"))
    got = {r["n"]: r["phase"] for r in series.policy_phase(df, ["k"], "n", "v", back=10, days=100, q=0.4, at_least=2).collect()}
    assert got == {0: None, 10: 1.0, 20: -1.0, 30: 1.0, 40: 1.0}
    few = {r["n"]: r["phase"] for r in series.policy_phase(df, ["k"], "n", "v", back=10, days=100, q=0.4, at_least=3).collect()}
    assert few[10] is None and few[20] == -1.0


def test_numbers_with_letters_behind_are_none(spark):
    texts = {"12d": None, "5f": None, "5F": None, "1e3": 1000.0, " -1,234.5 ": -1234.5, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "NaN": None, "0x10": None, "1 2": None, "+7": 7.0, "1e": None, "": None}
    from tidemark.functions import scalars

    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", scalars.lenient_double(F.col("x")).alias("v")).collect()
    assert {r["x"]: r["v"] for r in got} == texts


def test_one_sided_permutation_and_frozen_series(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 2.0, False), (3, 6.0, True), (4, 3.0, False)], "u int, v double, one boolean")
    assert stats.exact_permutation(df, 2, "u", "v", "one", two_sided=False).first()["p"] == pytest.approx(sum(d >= 1 for d in (-3, 1, -2, 2, -1, 3)) / 6)
    frozen = spark.createDataFrame([("a", t, float(min(t, 5))) for t in range(20)] + [("b", t, float(t)) for t in range(20)], "k string, t int, v double")
    assert {r["k"]: r["moving"] for r in quality.series_checks(frozen, ["k"], "t", "v", 1, 5, 5).collect()} == {"a": False, "b": True}


def test_orders_of_links_and_episodes(spark):
    leads = spark.createDataFrame([("a", "b", 2), ("b", "a", -2), ("b", "c", 1), ("c", "b", -1), ("a", "c", -3), ("c", "a", 3)], "i string, j string, lead long")
    r = order.transitivity(leads).first()
    assert (r["triples"], r["violations"], r["rate"]) == (3, 3, 1.0)  # a before b before c before a, from each of them on
    assert {r["i"]: r["score"] for r in order.lead_scores(leads).collect()} == {"a": -0.5, "b": -0.5, "c": 1.0}
    turns = spark.createDataFrame([(e, k, k[0], t) for e, ts in ((1, (1, 2, 3, 4)), (2, (4, 3, 2, 1)), (3, (1, 1, 5))) for k, t in zip(("a1", "b1", "c1", "d1"), ts, strict=False)], "e int, k string, g string, t long")
    assert [(r["a"], r["b"], r["n"], round(r["rho"], 6)) for r in order.agreement(turns, "e", "k", "t").collect()] == [(1, 2, 4, -1.0)]
    assert {r["k"]: (r["median"], r["episodes"], r["spread"]) for r in order.median_ranks(turns, "e", "k", "t", 4).collect()}["c1"] == (3.0, 3, 2.0)
    declared = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "g string, p int")
    assert {r["e"]: (r["blocks"], round(r["rho"], 6), r["exact"]) for r in order.block_order(turns, "e", "g", "t", declared, "p").collect()} == {1: (4, 1.0, True), 2: (4, -1.0, False)}
    assert {r["e"]: (r["lead"], r["first"]) for r in order.precedence(turns, "e", "k", "t", "b1", "c1").collect()} == {1: (1, True), 2: (-1, False), 3: (4, True)}
