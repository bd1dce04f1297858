"""Readers of landed responses, by shape: every upstream comes as files in one of these.

All give long rows (series_id string, obs_date date, value double), nulls kept, or
the columns named.  Paths are anything Spark reads.  Shapes and the upstreams that
come in them:

observations_json  date/value objects in a list (rates, reserve-bank and price APIs)
wide_csv           a date column and one column a series (surveys, curves, indexes)
vintage_csv        DATE and one column <ID>_<YYYYMMDD> a vintage
sdmx_csv           one row an observation, with dimension columns
epoch_json         parallel lists of epoch seconds or pairs of epoch milliseconds
header_rows_json   a list of lists whose first row names the columns
jsonstat           JSON-stat 2.0 of which only time varies
period_json        rows with a year and a period code (M01..M12, Q01..Q04, A01)
zip_csv            raw rows of CSV files inside ZIP files
passport_json      descriptions of series; search results in their order
vintage_dates_json dates at which a series was published
coded_rows_json    rows of many series under nested objects, each with its code
meta_rows_json     a list of a description and the rows
docs_json          documents with parallel lists of periods and values
nested_rows_json   rows under response.data
candles_json       pages of lists, which overlap
variables_json     an object of named descriptions
announcements_html dated sentences of a page
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONTHS, epoch_date, lenient_date, lenient_double


def _long(df: DataFrame, series: Column, date: Column, value: Column) -> DataFrame:
    return df.select(series.cast("string").alias("series_id"), date.alias("obs_date"), value.alias("value"))


def _whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return raw.select("file", F.from_json("value", schema).alias("j"))


def observations_json(spark: SparkSession, path: str, list_field: str = "observations", date: str = "date", value: str = "value", series: Column | None = None) -> DataFrame:
    """{list_field: [{date, value}]}; the series is the file's name unless given."""
    rows = _whole_json(spark, path, f"{list_field} array<struct<{date}:string,{value}:string>>").select("file", F.explode(F.col("j")[list_field]).alias("x"))
    return _long(rows, series if series is not None else F.regexp_replace("file", r"\.[^.]*$", ""), lenient_date(F.col("x")[date]), lenient_double(F.col("x")[value]))


def wide_csv(spark: SparkSession, path: str, date: str, sep: str = ",", prefix: str = "") -> DataFrame:
    """One column a series; rows whose date doesn't parse are left out, what isn't a number is null, blank headers are skipped."""
    df = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c for c in df.columns if c != date and c.strip() and not c.startswith("_c")]
    rows = df.unpivot([date], names, "series_id", "raw")
    return _long(rows, F.concat(F.lit(prefix), "series_id"), lenient_date(F.col(date)), lenient_double(F.col("raw"))).where("obs_date is not null")


def vintage_csv(spark: SparkSession, path: str, date: str = "DATE") -> DataFrame:
    """(series_id, obs_date, vintage_date, value) of columns named <ID>_<YYYYMMDD>; any other column is an error."""
    df = spark.read.csv(path, header=True)
    names = [c for c in df.columns if c != date]
    wrong = [c for c in names if not (c[-8:].isdigit() and c[-9:-8] == "_")]
    if wrong:
        raise ValueError(f"not vintage columns: {wrong[:3]}")
    rows = df.unpivot([date], names, "name", "raw")
    return rows.select(F.regexp_replace("name", r"_\d{8}$", "").alias("series_id"), lenient_date(F.col(date)).alias("obs_date"), F.to_date(F.substring("name", -8, 8), "yyyyMMdd").alias("vintage_date"), lenient_double(F.col("raw")).alias("value"))


def sdmx_csv(spark: SparkSession, path: str, dims: list[str], time: str = "TIME_PERIOD", value: str = "OBS_VALUE") -> DataFrame:
    df = spark.read.csv(path, header=True)
    return _long(df, F.concat_ws(".", *dims), lenient_date(F.col(time), annual=True), lenient_double(F.col(value)))


def epoch_pairs_json(spark: SparkSession, path: str, field: str, series: str) -> DataFrame:
    """{field: [[epoch ms, value], ...]}; of a UTC day the last point counts, and pages that overlap count once."""
    rows = _whole_json(spark, path, f"{field} array<array<double>>").select(F.explode(F.col("j")[field]).alias("x")).select(F.col("x")[0].alias("ms"), F.col("x")[1].alias("v"))
    by = rows.groupBy(epoch_date(F.floor(F.col("ms") / 1000)).alias("day")).agg(F.max_by("v", "ms").alias("v"))
    return _long(by, F.lit(series), F.col("day"), F.col("v"))


def epoch_lists_json(spark: SparkSession, path: str, times: str, values: str, series: str) -> DataFrame:
    """Parallel lists of epoch seconds and values."""
    rows = _whole_json(spark, path, f"{times} array<bigint>, {values} array<double>").select(F.explode(F.arrays_zip(F.col("j")[times].alias("t"), F.col("j")[values].alias("v"))).alias("x"))
    return _long(rows, F.lit(series), epoch_date(F.col("x")["t"]), F.col("x")["v"])


def header_rows_json(spark: SparkSession, path: str, keys: list[str], time: str, value: str) -> DataFrame:
    """[[names], [row], ...]: series of the key columns; a repeated (series, time) is an error at run time."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("a"))
    rows = raw.select(F.get("a", 0).alias("names"), F.explode(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))).alias("r"))
    cell = lambda name: F.try_element_at("r", F.array_position("names", name).cast("int"))
    out = _long(rows, F.concat_ws(".", *[cell(k) for k in keys]), lenient_date(cell(time), annual=True), lenient_double(cell(value)))
    counted = out.groupBy("series_id", "obs_date").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return counted.select("series_id", "obs_date", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.lit("repeated series and date")).cast("double")).alias("value"))


def jsonstat(spark: SparkSession, path: str, series: str) -> DataFrame:
    """JSON-stat of which every dimension but time has size 1."""
    schema = "id array<string>, size array<int>, value map<string,double>, dimension struct<time:struct<category:struct<index:map<string,int>>>>"
    j = _whole_json(spark, path, schema)
    others = F.size(F.filter(F.arrays_zip(F.col("j.id").alias("i"), F.col("j.size").alias("s")), lambda x: (x["i"] != "time") & (x["s"] != 1)))
    rows = j.select(F.explode("j.dimension.time.category.index").alias("period", "at"), F.col("j.value").alias("v"), others.alias("n"))
    value = F.when(F.col("n") == 0, F.try_element_at("v", F.col("at").cast("string"))).otherwise(F.raise_error(F.lit("another dimension varies")).cast("double"))
    return _long(rows, F.lit(series), lenient_date(F.regexp_replace("period", r"^(\d{4})-(\d{2})$", "$1$2"), annual=True), value)


def period_json(spark: SparkSession, path: str) -> DataFrame:
    """{Results: {series: [{seriesID, data: [{year, period, value}]}]}} with period codes; M13 and S codes are left out."""
    schema = "Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>"
    s = _whole_json(spark, path, schema).select(F.explode("j.Results.series").alias("s")).select("s.seriesID", F.explode("s.data").alias("x"))
    kind, n, year = F.substring("x.period", 1, 1), F.substring("x.period", 2, 2).try_cast("int"), F.col("x.year").try_cast("int")
    month = F.when((kind == "M") & n.between(1, 12), n).when((kind == "Q") & n.between(1, 4), n * 3 - 2).when(kind == "A", 1)
    return _long(s.where(month.isNotNull()), F.col("seriesID"), F.make_date(year, month, F.lit(1)), lenient_double(F.col("x.value")))


def traced(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, modified) of landed files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def _zip_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    rows = list(csv.reader(io.TextIOWrapper(z.open(name), encoding="utf-8-sig", errors="replace")))
                    for i in range(0, len(rows), 5000):
                        part = rows[i : i + 5000]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([name] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], names=["path", "member", "row_no", "cells"])


def zip_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, row_no, cells) of CSV files inside ZIP files; a file is one row of work."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_zip_rows, "path string, member string, row_no long, cells array<string>")


def passport_json(spark: SparkSession, path: str, fields: list[str], list_field: str = "seriess") -> DataFrame:
    """(file, place, fields): the descriptions in {list_field: [{...}]}, in their order from 0; fields that are absent are null, and so is an empty answer's absence of rows."""
    row = ",".join(f"{f}:string" for f in fields)
    j = _whole_json(spark, path, f"{list_field} array<struct<{row}>>")
    return j.select("file", F.posexplode(F.col("j")[list_field]).alias("place", "x")).select("file", "place", *[F.col("x")[f].alias(f) for f in fields])


def vintage_dates_json(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, vintage_date) of {vintage_dates: [...]}; the series is the file's name, and one without vintages has no rows."""
    j = _whole_json(spark, path, "vintage_dates array<string>")
    return j.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("series_id"), F.explode("j.vintage_dates").alias("d")).select("series_id", lenient_date(F.col("d")).alias("vintage_date"))


def coded_rows_json(spark: SparkSession, path: str, outer: str = "BEAAPI", code: str = "SeriesCode", title: str = "LineDescription", date: str = "TimePeriod", value: str = "DataValue") -> DataFrame:
    """(series_id, title, obs_date, value) of {outer: {Results: {Data: [...]}}}, Results perhaps a list of one; an Error in place of data is an error.  Rows whose date doesn't parse are left out."""
    rows = f"Data:array<struct<{code}:string,{title}:string,{date}:string,{value}:string>>,Error:string"
    raw = spark.read.text(path, wholetext=True).select("value")
    j = raw.select(F.from_json("value", f"{outer} struct<Results:struct<{rows}>,Error:string>")[outer].alias("one"), F.from_json("value", f"{outer} struct<Results:array<struct<{rows}>>>")[outer].alias("many"))
    wrong = F.coalesce("one.Error", "one.Results.Error", F.get("many.Results", F.lit(0))["Error"])
    data = F.coalesce("one.Results.Data", F.get("many.Results", F.lit(0))["Data"])
    x = j.select(F.explode(F.when(wrong.isNull(), data).otherwise(F.raise_error(F.concat(F.lit("the answer is an error: "), wrong)).cast(f"array<struct<{code}:string,{title}:string,{date}:string,{value}:string>>"))).alias("x"))
    out = x.select(F.col("x")[code].alias("series_id"), F.col("x")[title].alias("title"), lenient_date(F.col("x")[date], annual=True).alias("obs_date"), lenient_double(F.col("x")[value]).alias("value"))
    return out.where("obs_date is not null")


def meta_rows_json(spark: SparkSession, path: str, series: str) -> DataFrame:
    """[{description}, [{date: year, value}]]; a second part that is absent or null has no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
    x = raw.select(F.explode(F.from_json(F.try_element_at("a", F.lit(2)), "array<struct<date:string,value:string>>")).alias("x"))
    return _long(x, F.lit(series), lenient_date(F.col("x.date"), annual=True), lenient_double(F.col("x.value")))


def docs_json(spark: SparkSession, path: str) -> DataFrame:
    """{series: {docs: [{series_code, period: [...], value: [...]}]}}: the lists side by side as far as the shorter goes; periods that don't parse are left out."""
    schema = "series struct<docs:array<struct<series_code:string,period:array<string>,value:array<string>>>>"
    d = _whole_json(spark, path, schema).select(F.explode("j.series.docs").alias("d"))
    both = F.slice(F.arrays_zip(F.col("d.period").alias("p"), F.col("d.value").alias("v")), F.lit(1), F.least(F.size("d.period"), F.size("d.value")))
    x = d.select(F.coalesce("d.series_code", F.lit("?")).alias("code"), F.explode(both).alias("x"))
    return _long(x, F.col("code"), lenient_date(F.col("x.p"), annual=True), lenient_double(F.col("x.v"))).where("obs_date is not null")


def nested_rows_json(spark: SparkSession, path: str, keys: list[str], date: str = "period", value: str = "value") -> DataFrame:
    """{response: {data: [{period, value, keys}]}}: series of the key fields."""
    row = ",".join(f"{f}:string" for f in (date, value, *keys))
    x = _whole_json(spark, path, f"response struct<data:array<struct<{row}>>>").select(F.explode("j.response.data").alias("x"))
    return _long(x, F.concat_ws(".", *[F.col("x")[k] for k in keys]), lenient_date(F.col("x")[date], annual=True), lenient_double(F.col("x")[value]))


def candles_json(spark: SparkSession, path: str, series: str, at: int = 0, close: int = 4) -> DataFrame:
    """Pages [[open time in ms, ..., close, ...], ...], a file each: of a day that stands on several pages, or twice on one, the first in order of file and place counts."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "array<array<string>>").alias("a"))
    x = raw.select("file", F.posexplode("a").alias("place", "k")).select("file", "place", epoch_date(F.floor(F.get("k", F.lit(at)).cast("double") / 1000)).alias("day"), F.get("k", F.lit(close)).alias("v"))
    first = x.groupBy("day").agg(F.min_by("v", F.struct("file", "place")).alias("v"))
    return _long(first, F.lit(series), F.col("day"), lenient_double(F.col("v")))


def variables_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, label) of {variables: {name: {label}}}."""
    return _whole_json(spark, path, "variables map<string,struct<label:string>>").select(F.explode("j.variables").alias("name", "x")).select("name", F.col("x.label").alias("label"))


#: How a page announces a turning point.
ANNOUNCEMENT = r"(?i)([A-Z][a-z]+)\s+(\d{1,2}),\s*(\d{4})\s*\|\s*(?:Determination of the|Announcement of)\s+([A-Z][a-z]+)\s+(\d{4})\s+(?:business cycle\s+)?(peak|trough)"


def announcements_html(spark: SparkSession, path: str, pattern: str = ANNOUNCEMENT, at_least: int = 6, most: int = 36) -> DataFrame:
    """(kind, turn, announced, lag): months from a turning point to the day a page names it, the earliest day if it does so more than once.

    Fewer than at_least of a kind, or a lag outside 0 .. most, mean that another page came: an error.
    """
    text = F.regexp_replace("value", r"(?is)<(script|style).*?</\1>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", "|"), "&nbsp;|&#160;|[ \t\r\n]+", " ")
    text = F.regexp_replace(text, r"(\| ?)+", "|")
    found = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("s"))
    part = lambda i: F.regexp_extract("s", pattern, i)
    month = lambda i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(i), 1, 3))), F.lit(0)).cast("int")
    number = lambda i: part(i).cast("int")
    rows = found.select(F.lower(part(6)).alias("kind"), F.make_date(number(5), month(4), F.lit(1)).alias("turn"), F.make_date(number(3), month(1), number(2)).alias("announced"))
    first = rows.where("turn is not null and announced is not null").groupBy("kind", "turn").agg(F.min("announced").alias("announced"))
    lag = ((F.year("announced") - F.year("turn")) * 12 + F.month("announced") - F.month("turn")).cast("int")
    out = first.withColumn("lag", lag).withColumn("n", F.count("*").over(Window.partitionBy("kind")))  # a page's sentences
    wrong = (F.col("n") < at_least) | ~F.col("lag").between(0, most)
    return out.withColumn("lag", F.when(~wrong, F.col("lag")).otherwise(F.raise_error(F.lit("not the page of announcements")).cast("int"))).drop("n")
