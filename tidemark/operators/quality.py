"""Audits of series and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import over


def holes(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Months missing between a series' first and last."""
    span = df.groupBy(*keys).agg(F.min(t).alias("a"), F.max(t).alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias(t))
    return span.join(df.select(*keys, t), [*keys, t], "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def series_checks(df: DataFrame, keys: list[str], t: str, v: str, at_least: int, starts_by, fresh_from, last: int = 12) -> DataFrame:
    """Rules on each series: enough points, early start, recent end, no null, not frozen over its last observed points."""
    place = F.row_number().over(over(keys, F.col(v).isNull(), F.desc(t)))
    recent = F.when(F.col("_place") <= last, F.col(v))
    return df.withColumn("_place", place).groupBy(*keys).agg(
        F.count(v).alias("n"), (F.count(v) >= at_least).alias("enough"), (F.min(t) <= starts_by).alias("early"), (F.max(t) >= fresh_from).alias("fresh"),
        (F.count(v) == F.count("*")).alias("complete"), (F.countDistinct(recent) > 1).alias("moving"),
    )


def late_sources(points: DataFrame, origin: str, source: str, available: str) -> DataFrame:
    """Information-set audit: rows of (origin, source, available) that weren't known at their origin; must be empty."""
    return points.where((F.col(available) > F.col(origin)) | (F.col(source) > F.col(origin)))


def printed_matches(printed: Column, expected: Column) -> Column:
    """Whether a printed number is the expected one to half a unit of its last place."""
    places = F.length(F.regexp_extract(printed, r"\.(\d+)$", 1))
    return F.abs(printed.try_cast("double") - expected) <= F.lit(0.5) * F.pow(F.lit(10.0), -places) + 1e-12


def broken_references(links: DataFrame, registry: DataFrame, href: str, slug: str) -> DataFrame:
    return links.join(registry.select(F.col(slug).alias(href)), href, "left_anti")
