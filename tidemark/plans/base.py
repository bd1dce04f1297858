"""Base series over the supplied tables, and the same as SQL for comparison.

m: monthly order revenue (t month index, v).  mk: the same by customer segment.
mn: the same by nation.  Sums are taken as decimals, so they don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import month_index


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(month_index(F.col("o_orderdate")).alias("t")).agg(exact_sum("o_totalprice").alias("v"))


def _by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def mk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_customer(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("k"), month_index(F.col("o_orderdate")).alias("t")).agg(exact_sum("o_totalprice").alias("v"))


def mn(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _by_customer(spark, sf_dir).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.col("n_name").alias("k"), month_index(F.col("o_orderdate")).alias("t")).agg(exact_sum("o_totalprice").alias("v"))


_T = "CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT)"
_V = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
M = f"m AS (SELECT {_T} t, {_V} v FROM orders GROUP BY 1)"
MK = f"mk AS (SELECT c_mktsegment k, {_T} t, {_V} v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
MN = f"mn AS (SELECT n_name k, {_T} t, {_V} v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def shaped(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns in the given types; doubles to six places, without negative zeros."""
    out = [(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) if k == "double" else F.col(c).cast(k).alias(c) for c, k in kinds.items()]
    return df.select(*out)


def sql(ctes: list[str] | str, body: str, **kinds: str) -> str:
    """WITH ctes SELECT the columns FROM (body), shaped alike."""
    ctes = ", ".join([ctes] if isinstance(ctes, str) else ctes)
    out = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" if k == "double" else f"CAST({c} AS {'VARCHAR' if k == 'string' else k.upper()}) AS {c}" for c, k in kinds.items())
    return f"{'WITH ' + ctes if ctes else ''} SELECT {out} FROM ({body}) q_"
