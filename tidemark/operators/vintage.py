"""Bitemporal series: (keys, obs, vintage, v), one row each time that a figure is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, keys: list[str], when: Column | int) -> DataFrame:
    """Each observation as it was known at a vintage."""
    return df.where(F.col("vintage") <= when).groupBy(*keys, "obs").agg(F.max_by("v", "vintage").alias("v"), F.max("vintage").alias("vintage"))


def first_published(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "obs").agg(F.min_by("v", "vintage").alias("v"), F.min("vintage").alias("vintage"))


def edge(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last two observations of each vintage: (vintage, obs, v, before)."""
    w = Window.partitionBy(*keys, "vintage").orderBy(F.desc("obs"))
    rows = df.withColumns({"rank": F.row_number().over(w), "before": F.lead("v").over(w)})
    return rows.where("rank = 1").select(*keys, "vintage", "obs", "v", "before")


def recognition_lag(df: DataFrame, keys: list[str], event: Column) -> DataFrame:
    """(obs, seen, lag): the first vintage in which an observation shows an event."""
    return df.where(event).groupBy(*keys, "obs").agg(F.min("vintage").alias("seen")).withColumn("lag", F.col("seen") - F.col("obs"))


def first_vintage_of_year(df: DataFrame, year: Column) -> DataFrame:
    return df.groupBy(year.alias("year")).agg(F.min("vintage").alias("vintage"))


def matrix_long(wide: DataFrame, row: str, prefix: str) -> DataFrame:
    """A vintage matrix (a row an observation, columns <prefix>yyQq) as (obs, vintage, v); two-digit years from 40 on are 19yy."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot([row], names, "name", "v")
    code = F.regexp_extract("name", r"(\d\d)Q([1-4])$", 1).cast("int")
    year = F.when(code >= 40, 1900 + code).otherwise(2000 + code)
    quarter = F.regexp_extract("name", r"(\d\d)Q([1-4])$", 2).cast("int")
    obs = F.split(row, ":Q")
    return long.select((F.get(obs, 0).cast("int") * 4 + F.get(obs, 1).cast("int") - 1).alias("obs"), (year * 4 + quarter - 1).alias("vintage"), F.col("v").cast("double").alias("v"))
