"""Queries that write the supplied tables as landed responses to the shared folder and read them by their shapes, with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_date
from ..sources import landed, sinks, spreadsheet
from ..sources.shared import write_bytes, write_texts
from .base import MK, MN, m, mk, mn, read, shaped, sql
from .base import M as MONTHS

QUERIES: dict = {}
ORACLES: dict = {}


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


_LONG = {"series_id": "string", "obs_date": "date", "value": "double"}
_DAY = "make_date(CAST(t // 12 AS BIGINT), CAST(t % 12 + 1 AS BIGINT), 1)"
period = lambda: F.date_format(month_date(F.col("t")), "yyyy-MM")


def _packed(df: DataFrame, by: list[str], row: Column) -> DataFrame:
    """A list of the rows of each group, in order of time; a series has a row a month."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", row.alias("r")))).alias("rs")).withColumn("rs", F.col("rs.r"))


@q([MK], f"SELECT k series_id, {_DAY} obs_date, v AS value FROM mk", **_LONG)
def landed_docs(spark, d):
    docs = mk(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", period().alias("p"), "v"))).alias("z"))
    doc = F.struct(F.col("k").alias("series_code"), F.col("z.p").alias("period"), F.col("z.v").alias("value"))
    return landed.docs_json(spark, write_texts(docs.select(F.to_json(F.struct(F.struct(F.array(doc).alias("docs")).alias("series")))), "docs"))


@q([MN], f"SELECT k series_id, upper(k) title, {_DAY} obs_date, v AS value FROM mn", series_id="string", title="string", obs_date="date", value="double")
def landed_coded_rows(spark, d):
    row = F.struct(F.col("k").alias("SeriesCode"), F.upper("k").alias("LineDescription"), F.date_format(month_date(F.col("t")), "yyyy'M'MM").alias("TimePeriod"), F.format_number("v", 2).alias("DataValue"))
    packed = _packed(mn(spark, d), ["k"], row)
    results = F.when(F.length("k") % 2 == 0, F.to_json(F.struct(F.struct(F.struct(F.col("rs").alias("Data")).alias("Results")).alias("BEAAPI")))).otherwise(F.to_json(F.struct(F.struct(F.array(F.struct(F.col("rs").alias("Data"))).alias("Results")).alias("BEAAPI"))))
    return landed.coded_rows_json(spark, write_texts(packed.select(results), "coded"))


@q([MONTHS], "SELECT 'revenue' series_id, make_date(CAST(t // 12 AS BIGINT), 1, 1) obs_date, sum(CAST(v AS DECIMAL(38,2))) AS value FROM m GROUP BY t // 12", **_LONG)
def landed_meta_rows(spark, d):
    years = m(spark, d).groupBy(F.floor(F.col("t") / 12).cast("string").alias("date")).agg(F.sum(F.col("v").cast("decimal(38,2)")).cast("string").alias("value"))
    body = years.agg(F.to_json(F.collect_list(F.struct("date", "value"))).alias("rows"))  # a row a year
    return landed.meta_rows_json(spark, write_texts(body.select(F.concat(F.lit('[{"page": 1}, '), "rows", F.lit("]"))), "meta"), "revenue")


@q([MK], f"SELECT k || '.' || substr(k, 1, 1) series_id, {_DAY} obs_date, v AS value FROM mk", **_LONG)
def landed_nested_rows(spark, d):
    row = F.struct(period().alias("period"), F.col("v").cast("string").alias("value"), F.col("k").alias("area"), F.substring("k", 1, 1).alias("unit"))
    packed = _packed(mk(spark, d), ["k"], row)
    return landed.nested_rows_json(spark, write_texts(packed.select(F.to_json(F.struct(F.struct(F.col("rs").alias("data")).alias("response")))), "nested"), ["area", "unit"])


@q("", "SELECT 'orders' series_id, CAST(o_orderdate AS DATE) obs_date, max(o_totalprice) AS value FROM orders GROUP BY 2", **_LONG)
def landed_candles(spark, d):
    """Pages of a year and the first week of the next, so neighbours overlap; later pages give the days that an earlier one has another value."""
    days = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max(F.col("o_totalprice").cast("double")).alias("v"))
    year = F.year("day")
    pages = F.array_compact(F.array(year, F.when(F.dayofyear("day") <= 7, year - 1)))
    placed = days.select("day", "v", F.explode(pages).alias("page")).withColumn("least", F.min("page").over(Window.partitionBy("day")))
    ms = (F.unix_date("day").cast("long") * 86_400_000).cast("string")
    shown = F.when(F.col("page") == F.col("least"), F.col("v")).otherwise(F.col("v") + 1).cast("string")
    rows = placed.groupBy("page").agg(F.to_json(F.array_sort(F.collect_list(F.array(ms, F.lit("o"), F.lit("h"), F.lit("l"), shown)))).alias("text"))
    # a file a page, named in order of the pages
    return landed.candles_json(spark, write_texts(rows.repartitionByRange(16, "page").sortWithinPartitions("page").select("text"), "candles"), "orders")


@q("", "SELECT c_mktsegment file, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_name) - 1 AS INT) place, n_name id, CAST(count(*) AS VARCHAR) popularity FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name", file="string", place="int", id="string", popularity="string")
def landed_passports(spark, d):
    x = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").cast("string").alias("popularity"))
    lists = x.groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("id"), "popularity", F.col("c_mktsegment").alias("units")))).alias("seriess"))
    found = landed.passport_json(spark, write_texts(lists.select(F.to_json(F.struct("seriess"))), "passports"), ["id", "popularity", "units"])
    return found.withColumn("file", F.col("units"))


def _workbook(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by segment and month as an .xls workbook of two sheets, years by months and months by years, read back."""
    rows = mk(spark, d).select("k", F.floor(F.col("t") / 12).cast("int").alias("y"), (F.col("t") % 12 + 1).cast("int").alias("mo"), "v").orderBy("k", "y", "mo").collect()  # segments x months
    years = sorted({r["y"] for r in rows})
    at = {(r["k"], r["y"], r["mo"]): r["v"] for r in rows}
    names = ["Jan.", "Feb", "Mar", "April", "May", "June", "July", "Aug.", "Sept", "Oct", "Nov", "Dec"]
    first = sorted({r["k"] for r in rows})[0]
    wide = [["Table 2"], ["Year", *names]] + [[y, *[at.get((first, y, mo)) for mo in range(1, 13)]] for y in years]
    long: list[list] = [["Table 3, ряд"]]
    for k in sorted({r["k"] for r in rows}):
        long += [[k], [None, *years], *[[name, *[at.get((k, y, mo)) for y in years]] for mo, name in enumerate(names, 1)]]
    return spreadsheet.sheets(spark, write_bytes(spark, "workbook", sinks.legacy_workbook({"years": wide, "blocks": long}, limit=64)))


@q([MK], f"SELECT 'first' series_id, {_DAY} obs_date, v AS value FROM mk WHERE k = (SELECT min(k) FROM mk)", **_LONG)
def legacy_year_rows(spark, d):
    return spreadsheet.year_rows(_workbook(spark, d), "years", "first")


@q([MK], f"SELECT k series_id, {_DAY} obs_date, v AS value FROM mk", **_LONG)
def legacy_month_blocks(spark, d):
    return spreadsheet.month_blocks(_workbook(spark, d), "blocks", "none")
