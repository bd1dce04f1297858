"""Spreadsheet cells of landed files, read in the tasks: .xlsx (ZIP and SpreadsheetML) and .xls, told apart by their first bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONTHS, lenient_date, lenient_double
from . import legacy

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    """(sheet, row number from 0, cells as text) of an .xlsx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"), 1):
            title, target = sheet.get("name"), targets.get(sheet.get(_LINK), f"worksheets/sheet{k}.xml")
            part = target[1:] if target.startswith("/") else f"xl/{target}"
            if part not in names:
                continue
            for i, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{_NS}row")):
                cells: list = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find(f"{_NS}v")
                    kind = c.get("t")
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else None if v is None else (shared[int(v.text)] if int(v.text) < len(shared) else "") if kind == "s" else v.text
                yield title, int(row.get("r", i + 1)) - 1, cells


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    """Rows of a workbook of either kind; a page in its place, or anything else, is an error."""
    if content[:2] == b"PK":
        return sheet_rows(content)
    if content[:8] == legacy.MAGIC:
        return legacy.sheet_rows(content)
    if content[:512].lstrip().startswith(b"<"):
        raise ValueError(f"a page of {len(content)} bytes came in place of a workbook")
    raise ValueError(f"no workbook: it begins with {content[:8]!r}")


def _rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = list(workbook_rows(content))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.list_(pa.string()))], names=["path", "sheet", "row_no", "cells"])


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells): raw rows of .xlsx and .xls files; anything else is an error of its task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_rows, "path string, sheet string, row_no long, cells array<string>")


def melt(raw: DataFrame, sheet: str, header_row: int, date_col: int = 0) -> DataFrame:
    """(series_id, obs_date, value) of a sheet with a header row and a date column; rows whose date doesn't parse are left out."""
    own = raw.where(F.col("sheet") == sheet)
    head = own.where(F.col("row_no") == header_row).select("path", F.posexplode("cells").alias("at", "series_id")).where(F.length(F.trim("series_id")) > 0).where(F.col("at") != date_col)
    body = own.where(F.col("row_no") > header_row).select("path", lenient_date(F.get("cells", F.lit(date_col)), serial=True).alias("obs_date"), F.posexplode("cells").alias("at", "raw")).where("obs_date is not null")
    return body.join(F.broadcast(head), ["path", "at"]).select("series_id", "obs_date", lenient_double(F.col("raw")).alias("value"))


def transposed(raw: DataFrame, sheet: str, header_row: int, name_col: int = 0) -> DataFrame:
    """As melt(), of a sheet with dates in columns and one row a series."""
    own = raw.where(F.col("sheet") == sheet)
    head = own.where(F.col("row_no") == header_row).select("path", F.posexplode("cells").alias("at", "d")).select("path", "at", lenient_date(F.col("d"), serial=True).alias("obs_date")).where("obs_date is not null")
    body = own.where(F.col("row_no") > header_row).select("path", F.get("cells", F.lit(name_col)).alias("series_id"), F.posexplode("cells").alias("at", "raw"))
    return body.join(F.broadcast(head), ["path", "at"]).select("series_id", "obs_date", lenient_double(F.col("raw")).alias("value"))


def _month(cell: Column) -> Column:
    """Number of the month that a cell names, by its first three letters."""
    name = F.lower(F.substring(F.trim(cell), 1, 3))
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0)).cast("int")


def _year(cell: Column) -> Column:
    n = lenient_double(cell)
    return F.when((n > 1900) & (n < 2200), F.floor(n).cast("int"))


def _unique(df: DataFrame) -> DataFrame:
    """df, or an error if a series has a month twice."""
    by = df.groupBy("series_id", "obs_date").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return by.select("series_id", "obs_date", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.lit("a month stands twice")).cast("double")).alias("value"))


def year_rows(raw: DataFrame, sheet: str, series: str) -> DataFrame:
    """(series_id, obs_date, value) of a sheet of years by months: the first row that names six months or more heads it, rows whose first cell is a year follow."""
    own = raw.where(F.col("sheet") == sheet)
    cells = own.select("path", "row_no", F.posexplode("cells").alias("at", "cell"))
    months = cells.withColumn("m", _month(F.col("cell"))).where("m is not null")
    heads = months.groupBy("path", "row_no").agg(F.count("*").alias("n")).where("n >= 6").groupBy("path").agg(F.min("row_no").alias("head"))
    at = months.join(heads, "path").where("row_no = head").select("path", "at", "m", "head")
    years = own.select("path", F.col("row_no").alias("row"), _year(F.get("cells", F.lit(0))).alias("y")).where("y is not null")
    body = cells.withColumnRenamed("row_no", "row").join(years, ["path", "row"]).join(F.broadcast(at), ["path", "at"]).where("row > head")  # a workbook's head
    return _unique(body.select(F.lit(series).alias("series_id"), F.make_date("y", "m", F.lit(1)).alias("obs_date"), lenient_double(F.col("cell")).alias("value")).where("value is not null"))


def month_blocks(raw: DataFrame, sheet: str, series: str) -> DataFrame:
    """(series_id, obs_date, value) of blocks of months by years, one below another.

    A row of three years or more beside its first cell heads what follows, until the next
    one; rows whose first cell is a month have its values; any other text, but one that
    begins with table, names the series from there on.
    """
    own = raw.where(F.col("sheet") == sheet)
    years = F.transform("cells", lambda c, i: F.when(i > 0, _year(c)))
    month = _month(F.get("cells", F.lit(0)))
    texts = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: (F.length(c) > 0) & lenient_double(c).isNull())
    label = F.regexp_replace(F.get(texts, F.lit(0)), r"\s+", " ")
    rows = own.withColumns({"years": years, "m": month})
    rows = rows.withColumn("head", F.when(F.size(F.filter("years", lambda y: y.isNotNull())) >= 3, F.col("years")))
    rows = rows.withColumn("name", F.when(F.col("head").isNull() & F.col("m").isNull() & ~F.lower(label).startswith("table"), F.substring(label, 1, 60)))
    so_far = Window.partitionBy("path", "sheet").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)  # a sheet's rows
    placed = rows.withColumns({"by": F.last("head", ignorenulls=True).over(so_far), "series_id": F.coalesce(F.last("name", ignorenulls=True).over(so_far), F.lit(series))})
    body = placed.where("head is null and m is not null and by is not null").select("series_id", "m", F.explode(F.arrays_zip(F.col("by").alias("y"), F.col("cells").alias("c"))).alias("x"))
    return _unique(body.where("x.y is not null").select("series_id", F.make_date("x.y", "m", F.lit(1)).alias("obs_date"), lenient_double(F.col("x.c")).alias("value")).where("value is not null"))
