"""Ladders of levels, what a level contributes, confidence flags, cluster means and false alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import over

Steps = list[tuple[float | None, float | None, float]]


class RejectedLadderError(ValueError):
    """A ladder marked as rejected was used without leave."""


def ladder_step(value: Column, steps: Steps, rejected: str | None = None, allow_rejected: bool = False) -> Column:
    """The step of the first interval (low, high] that holds the value, an open end being None.

    rejected: why the ladder was turned down; then it raises unless allow_rejected.  A
    ladder without steps raises; a null, or a value in no interval, has a null step.
    """
    if rejected is not None and not allow_rejected:
        raise RejectedLadderError(f"rejected ladder: {rejected or 'no reason given'}")
    if not steps:
        raise ValueError("a ladder needs steps")
    found = [F.when((F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value <= high) & value.isNotNull(), F.lit(float(step))) for low, high, step in steps]
    return F.coalesce(*found)


def ladder_contribution(df: DataFrame, keys: list[str], t: str, v: str, steps: Steps, lag: int = 3, **guard) -> DataFrame:
    """contribution = 0.6 sign of the change over ``lag`` present points + 0.4 step; the first ``lag`` points have none."""
    before = F.lag(v, lag).over(over(keys, F.asc(t)))
    moved = df.where(F.col(v).isNotNull()).withColumn("before", before).where("before IS NOT NULL")
    out = 0.6 * F.signum(F.col(v) - F.col("before")) + 0.4 * ladder_step(F.col(v), steps, **guard)
    return moved.select(*keys, t, out.alias("contribution"))


def level_contribution(df: DataFrame, keys: list[str], t: str, v: str, threshold: float, lag: int = 3) -> DataFrame:
    """contribution = 0.6 sign of the change since ``lag`` calendar months ago + 0.4 sign of the level over the threshold."""
    rows = df.where(F.col(v).isNotNull())
    earlier = rows.select(*keys, (F.col(t) + lag).alias(t), F.col(v).alias("before"))
    out = 0.6 * F.signum(F.col(v) - F.col("before")) + 0.4 * F.signum(F.col(v) - threshold)
    return rows.join(earlier, [*keys, t]).select(*keys, t, out.alias("contribution"))


def confidence(state: Column, vote: Column, n: Column, full: int = 3) -> Column:
    """Six-value flag of a state by the vote of n readings, all ``full`` of them making it strong."""
    # Names of states, votes and flags.
    agreed = F.when(n == full, "STRONG").otherwise("WEAK")
    return (
        F.when(state.isin("CENTER", "ANOMALY"), "NO_STATE")
        .when(vote.isNull() | (vote == "PARALLEL"), "NO_INFO")
        .when(vote == "TWIST", "TWIST")
        .when((vote == "NOAGREE") | ~vote.eqNullSafe(state), "CONTRADICTS")
        .otherwise(agreed)
    )


def cluster_means(df: DataFrame, cluster: str, stat: str, status: str | None = None, ok: str = "ok", members: DataFrame | None = None) -> DataFrame:
    """Mean of a statistic over the units of each cluster, those with another status, null or NaN left out.

    members: a frame of the units that count, joined on the columns it shares with df.
    """
    rows = df.where(F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double")))
    rows = rows if status is None else rows.where(F.col(status) == ok)
    if members is not None:
        rows = rows.join(members, [c for c in members.columns if c in df.columns], "left_semi")
    return rows.groupBy(cluster).agg(F.avg(stat).alias("mean"), F.count("*").alias("units"))


def flagged(df: DataFrame, keys: list[str], t: str, flags: DataFrame) -> DataFrame:
    """Number of each key's periods that stand in ``flags`` (t); a key with none has 0."""
    marked = df.join(flags.select(t).distinct().withColumn("flag", F.lit(1)), t, "left")
    return marked.groupBy(*keys).agg(F.count("flag").alias("flagged"), F.count("*").alias("periods"))


def false_alarms(signals: DataFrame, targets: DataFrame, keys: list[str], t: str, low: int = -12, high: int = 24) -> DataFrame:
    """Signals (keys, t) with ``false``: no target lies from t + low to t + high, both included.

    One ordered pass: the last target up to t + high tells, however many there are.
    """
    both = signals.select(*keys, (F.col(t) + high).alias("at"), F.col(t).alias("signal"), F.lit(None).cast("long").alias("target"))
    both = both.unionByName(targets.select(*keys, F.col(t).alias("at"), F.lit(None).cast("long").alias("signal"), F.col(t).cast("long").alias("target")))
    last = F.max("target").over(over(keys, F.asc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("last", last).where("signal IS NOT NULL").select(*keys, F.col("signal").alias(t), (F.coalesce(F.col("last") < F.col("signal") + low, F.lit(True))).alias("false"))
