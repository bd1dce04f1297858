"""Landed responses of each shape."""

import datetime as dt
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed, legacy, sinks, spreadsheet

D = dt.date


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted((r["series_id"], r["obs_date"], r["value"]) for r in df.collect())


def test_json_shapes(spark, tmp_path):
    p = put(tmp_path / "GDP.json", json.dumps({"observations": [{"date": "2020-01-01", "value": "1,5"}, {"date": "2020-02-01", "value": "."}]}))
    assert sorted((r["series_id"], r["obs_date"], r["value"]) for r in landed.observations_json(spark, p).collect()) == [("GDP", D(2020, 1, 1), 15.0), ("GDP", D(2020, 2, 1), None)]
    p = put(tmp_path / "c.json", json.dumps({"prices": [[0, 1.0], [3600000, 2.0], [86400000, 3.0]]}))
    assert rows(landed.epoch_pairs_json(spark, p, "prices", "btc")) == [("btc", D(1970, 1, 1), 2.0), ("btc", D(1970, 1, 2), 3.0)]
    p = put(tmp_path / "l.json", json.dumps({"timestamp": [-86400, 0], "close": [1.5, 2.5]}))
    assert rows(landed.epoch_lists_json(spark, p, "timestamp", "close", "x")) == [("x", D(1969, 12, 31), 1.5), ("x", D(1970, 1, 1), 2.5)]
    p = put(tmp_path / "h.json", json.dumps([["time", "cat", "v"], ["2020-05-01", "A", "1"], ["2020-06-01", "A", "2"]]))
    assert rows(landed.header_rows_json(spark, p, ["cat"], "time", "v")) == [("A", D(2020, 5, 1), 1.0), ("A", D(2020, 6, 1), 2.0)]
    p = put(tmp_path / "h2.json", json.dumps([["time", "cat", "v"], ["2020-05-01", "A", "1"], ["2020-05-01", "A", "2"]]))
    with pytest.raises(Exception, match="repeated"):
        landed.header_rows_json(spark, p, ["cat"], "time", "v").collect()
    p = put(tmp_path / "s.json", json.dumps({"id": ["geo", "time"], "size": [1, 2], "value": {"0": 1.0, "1": 2.0}, "dimension": {"time": {"category": {"index": {"2020-01": 0, "2020-02": 1}}}}}))
    assert rows(landed.jsonstat(spark, p, "cpi")) == [("cpi", D(2020, 1, 1), 1.0), ("cpi", D(2020, 2, 1), 2.0)]
    p = put(tmp_path / "b.json", json.dumps({"Results": {"series": [{"seriesID": "L", "data": [{"year": "2020", "period": "M13", "value": "9"}, {"year": "2020", "period": "Q02", "value": "3"}]}]}}))
    assert rows(landed.period_json(spark, p)) == [("L", D(2020, 4, 1), 3.0)]


def test_csv_shapes(spark, tmp_path):
    p = put(tmp_path / "w.csv", "Date,1 Mo,10 Yr\n01/02/2020,1.5,N/A\njunk,1,2\n")
    assert sorted(r["series_id"] for r in landed.wide_csv(spark, p, "Date").collect()) == ["1 Mo", "10 Yr"]
    p = put(tmp_path / "v.csv", "DATE,GDP_20200130,GDP_20200227\n2019-10-01,1.0,1.1\n")
    got = landed.vintage_csv(spark, p).orderBy("vintage_date").collect()
    assert [(r["vintage_date"], r["value"]) for r in got] == [(D(2020, 1, 30), 1.0), (D(2020, 2, 27), 1.1)]
    with pytest.raises(ValueError, match="vintage"):
        landed.vintage_csv(spark, put(tmp_path / "x.csv", "DATE,GDP\n2019-10-01,1.0\n"))
    p = put(tmp_path / "s.csv", "FREQ,REF,TIME_PERIOD,OBS_VALUE\nM,US,2020-03-01,2.5\n")
    assert rows(landed.sdmx_csv(spark, p, ["FREQ", "REF"])) == [("M.US", D(2020, 3, 1), 2.5)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "x,y\n1,2\n")
    assert [r["cells"] for r in landed.zip_csv(spark, str(tmp_path / "z.zip")).orderBy("row_no").collect()] == [["x", "y"], ["1", "2"]]
    assert landed.traced(spark, str(tmp_path / "z.zip")).first()["bytes"] > 0


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Data" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>date</t></si><si><t>ads</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>43831</v></c><c r="C2"><v>1.25</v></c></row></sheetData></worksheet>')
    raw = spreadsheet.sheets(spark, str(tmp_path / "a.xlsx"))
    assert rows(spreadsheet.melt(raw, "Data", 0)) == [("ads", D(2020, 1, 1), 1.25)]


def test_a_workbook_in_another_order(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {link}><sheets><sheet name="Second" sheetId="2" r:id="r2"/><sheet name="First" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for k in (1, 2):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>{k}</v></c><c r="B1" t="s"><v>7</v></c></row></sheetData></worksheet>')
    assert {r["sheet"]: r["cells"] for r in spreadsheet.sheets(spark, str(tmp_path / "b.xlsx")).collect()} == {"Second": ["2", ""], "First": ["1", ""]}


def test_legacy_workbooks_byte_by_byte():
    sheets = {"Year": [["Year", "Jan.", "Feb"], [1995, 1.5, None, -3]], "ряд": [["ряд" * 40, "x" * 100, "é"], [None, 0.25]]}
    want = [("Year", 0, ["Year", "Jan.", "Feb"]), ("Year", 1, ["1995", "1.5", None, "-3"]), ("ряд", 0, ["ряд" * 40, "x" * 100, "é"]), ("ряд", 1, [None, "0.25"])]
    for limit in (16, 33, 64, 65, 200, 8224):  # strings are cut at other places each time, wide and narrow ones
        assert list(legacy.sheet_rows(sinks.legacy_workbook(sheets, limit))) == want
    big = {"s": [[i * 1.25, i, f"t{i}"] for i in range(3000)]}  # beyond the small sectors
    assert list(legacy.sheet_rows(sinks.legacy_workbook(big)))[2999] == ("s", 2999, ["3748.75", "2999", "t2999"])
    assert [legacy.packed_number(v) for v in (6 << 2 | 2, 6 << 2 | 3, (-5 << 2 | 2) & 0xFFFFFFFF, 0x3FF80000, 0x3FF80001)] == [6.0, 0.06, -5.0, 1.5, 0.015]
    # records of other kinds: many packed numbers, a text in its cell, a formula's number and its text
    cell = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    book = cell(legacy.BOF, bytes(16))
    body = cell(legacy.BOF, bytes(16)) + cell(legacy.MANY_RK, struct.pack("<HHHIHIH", 0, 1, 0, 2 << 2 | 2, 0, 3 << 2 | 2, 2)) + cell(legacy.LABEL, struct.pack("<HHHHB", 1, 0, 0, 2, 0) + b"ab")
    body += cell(legacy.FORMULA, struct.pack("<HHHdHII", 2, 0, 0, 2.5, 0, 0, 0)) + cell(legacy.FORMULA, struct.pack("<HHH", 2, 1, 0) + bytes(6) + b"\xff\xff" + bytes(10)) + cell(legacy.TEXT, struct.pack("<HB", 1, 1) + "ю".encode("utf-16-le"))
    name = struct.pack("<HBB", 0, 1, 0) + b"S"
    book += cell(legacy.SHEET, struct.pack("<I", len(book) + 4 + 4 + len(name)) + name)
    assert list(legacy.sheet_rows(sinks.compound_file("Workbook", book + body))) == [("S", 0, [None, "2", "3"]), ("S", 1, ["ab"]), ("S", 2, ["2.5", "ю"])]


def test_broken_workbooks_are_errors():
    with pytest.raises(ValueError, match="page"):
        spreadsheet.workbook_rows(b"  <!DOCTYPE html><html>")
    with pytest.raises(ValueError, match="no workbook"):
        spreadsheet.workbook_rows(b"a,b\n1,2")
    with pytest.raises(KeyError):
        list(spreadsheet.workbook_rows(sinks.compound_file("Other", b"x")))
    data = bytearray(sinks.legacy_workbook({"s": [[float(i)] for i in range(3000)]}))
    data[512 + 4 * 5 : 512 + 4 * 6] = struct.pack("<I", 4)  # a chain in a circle
    with pytest.raises(ValueError, match="chain"):
        list(legacy.sheet_rows(bytes(data)))


def test_more_json_shapes(spark, tmp_path):
    p = put(tmp_path / "bea.json", json.dumps({"BEAAPI": {"Results": {"Error": "no such table"}}}))
    with pytest.raises(Exception, match="no such table"):
        landed.coded_rows_json(spark, p).collect()
    p = put(tmp_path / "wb.json", json.dumps([{"page": 1}, None]))
    assert rows(landed.meta_rows_json(spark, p, "x")) == []
    p = put(tmp_path / "VD.json", json.dumps({"vintage_dates": ["2020-01-30", "2020-02-27"]}))
    assert sorted(tuple(r) for r in landed.vintage_dates_json(spark, p).collect()) == [("VD", D(2020, 1, 30)), ("VD", D(2020, 2, 27))]
    p = put(tmp_path / "no.json", "{}")
    assert landed.vintage_dates_json(spark, p).count() == 0 and landed.passport_json(spark, p, ["id"]).count() == 0
    p = put(tmp_path / "var.json", json.dumps({"variables": {"cat": {"label": "Category"}, "for": {}}}))
    assert sorted(tuple(r) for r in landed.variables_json(spark, p).collect()) == [("cat", "Category"), ("for", None)]
    p = put(tmp_path / "docs.json", json.dumps({"series": {"docs": [{"series_code": "A", "period": ["2020-01", "2020-02", "bad"], "value": [1, "NA", 3, 4]}]}}))
    assert rows(landed.docs_json(spark, p)) == [("A", D(2020, 1, 1), 1.0), ("A", D(2020, 2, 1), None)]


def test_announcements(spark, tmp_path):
    lines = "".join(f"<li>March 1, {1981 + i}</li><li>Determination of the June {1980 + i} {kind}</li>" for i in range(6) for kind in ("peak", "trough"))
    again = "<p>May 1, 1981 | Announcement of June 1980 business cycle peak</p>"
    got = landed.announcements_html(spark, put(tmp_path / "n.html", f"<html><script>June 1, 1990</script><ul>{lines}</ul>{again}</html>")).collect()
    assert len(got) == 12 and {r["lag"] for r in got} == {9} and min(r["announced"] for r in got) == D(1981, 3, 1)
    with pytest.raises(Exception, match="not the page"):
        landed.announcements_html(spark, put(tmp_path / "few.html", "March 1, 1981 | Determination of the June 1980 peak")).collect()


def test_pinned_artefacts_notice_a_change(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "t int, v double")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("v is null").count() == 1
    one = df.where("t = 1")
    sinks.pin(one, str(tmp_path / "p"), "t", "v")
    assert sinks.read_pinned(spark, str(tmp_path / "p"), "t", "v").count() == 1
    one.withColumn("v", F.lit(3.0)).write.mode("overwrite").parquet(str(tmp_path / "p/data"))
    with pytest.raises(ValueError):
        sinks.read_pinned(spark, str(tmp_path / "p"), "t", "v")
