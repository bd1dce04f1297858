"""Ladders, flags, cluster means and false alarms on small fixtures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ladders as L

STEPS = [(None, -0.2, -1.0), (-0.2, None, 1.0)]


def test_ladder_intervals_are_open_below_and_closed_above(spark):
    df = spark.createDataFrame([(1, -0.2), (2, -0.19), (3, None), (4, 5.0)], "t long, v double")
    got = {r["t"]: r["s"] for r in df.select("t", L.ladder_step(F.col("v"), STEPS).alias("s")).collect()}
    assert got == {1: -1.0, 2: 1.0, 3: None, 4: 1.0}
    gap = df.select("t", L.ladder_step(F.col("v"), [(0.0, 1.0, 2.0)]).alias("s")).collect()
    assert all(r["s"] is None for r in gap)


def test_a_rejected_or_empty_ladder_raises(spark):
    with pytest.raises(L.RejectedLadderError, match="too deep"):
        L.ladder_step(F.col("v"), STEPS, rejected="too deep")
    L.ladder_step(F.col("v"), STEPS, rejected="too deep", allow_rejected=True)
    with pytest.raises(ValueError, match="steps"):
        L.ladder_step(F.col("v"), [])


def test_contributions_lag_by_position_or_by_calendar(spark):
    # month 13 is missing: three points before 15 is 11, three months before is 12
    rows = [(10, 0.0), (11, 1.0), (12, 3.0), (14, 2.0), (15, 2.0), (16, None)]
    df = spark.createDataFrame([("a", t, v) for t, v in rows], "k string, t long, v double")
    got = {r["t"]: round(r["contribution"], 9) for r in L.ladder_contribution(df, ["k"], "t", "v", STEPS).collect()}
    assert got == {14: 1.0, 15: 1.0}
    got = {r["t"]: round(r["contribution"], 9) for r in L.level_contribution(df, ["k"], "t", "v", 2.0).collect()}
    assert got == {14: 0.6, 15: -0.6}


def test_confidence_flags(spark):
    rows = [("CENTER", "I", 3, "NO_STATE"), ("ANOMALY", None, 0, "NO_STATE"), ("I", None, 1, "NO_INFO"), ("I", "PARALLEL", 3, "NO_INFO"), ("I", "TWIST", 3, "TWIST"), ("I", "NOAGREE", 3, "CONTRADICTS"), ("I", "II", 3, "CONTRADICTS"), ("I", "I", 3, "STRONG"), ("I", "I", 2, "WEAK")]
    df = spark.createDataFrame(rows, "state string, vote string, n int, want string")
    assert all(r["flag"] == r["want"] for r in df.withColumn("flag", L.confidence(F.col("state"), F.col("vote"), F.col("n"))).collect())


def test_cluster_means_leave_out_failed_null_and_nan(spark):
    rows = [("a", "x", 1.0, "ok"), ("b", "x", 3.0, "ok"), ("c", "x", 9.0, "short"), ("d", "y", None, "ok"), ("e", "z", float("nan"), "ok"), ("f", "z", 4.0, "ok")]
    df = spark.createDataFrame(rows, "unit string, k string, v double, status string")
    got = {r["k"]: (r["mean"], r["units"]) for r in L.cluster_means(df, "k", "v", "status").collect()}
    assert got == {"x": (2.0, 2), "z": (4.0, 1)}
    members = spark.createDataFrame([("b",), ("f",)], "unit string")
    got = {r["k"]: r["mean"] for r in L.cluster_means(df, "k", "v", "status", members=members).collect()}
    assert got == {"x": 3.0, "z": 4.0}


def test_flagged_periods_and_false_alarms(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, t long")
    flags = spark.createDataFrame([(1,), (1,), (2,)], "t long")
    assert {r["k"]: (r["flagged"], r["periods"]) for r in L.flagged(df, ["k"], "t", flags).collect()} == {"a": (2, 2), "b": (0, 1)}
    signals = spark.createDataFrame([("a", 100), ("a", 76), ("a", 75), ("a", 112), ("a", 113), ("b", 100)], "k string, t long")
    got = {(r["k"], r["t"]): r["false"] for r in L.false_alarms(signals, spark.createDataFrame([("a", 100)], "k string, t long"), ["k"], "t").collect()}
    assert got == {("a", 100): False, ("a", 76): False, ("a", 75): True, ("a", 112): False, ("a", 113): True, ("b", 100): True}
