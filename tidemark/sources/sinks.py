"""Sinks: long series as CSV, result rows as JSON without NaN, pinned artefacts with a digest, small .xls workbooks."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite, series_digest
from . import legacy


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """NaN and infinities become null."""
    df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").json(path)


def pin(df: DataFrame, path: str, t: str, v: str) -> str:
    """Writes a series as Parquet and its digest beside it; returns the digest."""
    digest = df.agg(series_digest(F.col(t), F.col(v)).alias("d")).first()["d"]
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(digest,)], "digest string").write.mode("overwrite").json(f"{path}/digest")
    return digest


def read_pinned(spark: SparkSession, path: str, t: str, v: str) -> DataFrame:
    """A pinned series; a digest that no longer fits is an error."""
    df = spark.read.parquet(f"{path}/data")
    want = spark.read.schema("digest string").json(f"{path}/digest").first()["digest"]
    if df.agg(series_digest(F.col(t), F.col(v)).alias("d")).first()["d"] != want:
        raise ValueError(f"{path}: the data isn't what was pinned")
    return df


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _shared_strings(texts: list[str], limit: int) -> bytes:
    """The record of shared strings, cut at limit bytes, within strings where it comes so."""
    parts, here = [], bytearray(struct.pack("<II", len(texts), len(texts)))
    for text in texts:
        wide = any(ord(c) > 255 for c in text)
        size, data = 2 if wide else 1, text.encode("utf-16-le" if wide else "latin-1")
        if len(here) + 4 > limit:
            parts, here = [*parts, here], bytearray()
        here += struct.pack("<HB", len(data) // size, wide)
        while data:
            room = (limit - len(here)) // size * size
            here += data[:room]
            data = data[room:]
            if data:
                parts, here = [*parts, here], bytearray([wide])
    parts.append(here)
    return b"".join(_record(legacy.CONTINUE if i else legacy.STRINGS, bytes(p)) for i, p in enumerate(parts))


def legacy_workbook(sheets: dict[str, list[list]], limit: int = 8224) -> bytes:
    """An .xls file of few rows: texts as shared strings, whole numbers packed, others as doubles, None as no cell."""
    texts = sorted({c for rows in sheets.values() for r in rows for c in r if isinstance(c, str)})
    place = {t: i for i, t in enumerate(texts)}
    bodies = []
    for rows in sheets.values():
        out = [_record(legacy.BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))]
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if isinstance(v, str):
                    out.append(_record(legacy.LABEL_SHARED, struct.pack("<HHHI", r, c, 0, place[v])))
                elif isinstance(v, int) and abs(v) < 1 << 29:
                    out.append(_record(legacy.RK, struct.pack("<HHHI", r, c, 0, (v << 2 | 2) & 0xFFFFFFFF)))
                elif v is not None:
                    out.append(_record(legacy.NUMBER, struct.pack("<HHHd", r, c, 0, v)))
        bodies.append(b"".join([*out, _record(legacy.EOF, b"")]))
    strings = _shared_strings(texts, limit) + _record(legacy.EOF, b"")
    head = _record(legacy.BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    entry = lambda name, at: _record(legacy.SHEET, struct.pack("<IHBB", at, 0, len(name), 1) + name.encode("utf-16-le"))
    at = len(head) + sum(len(entry(n, 0)) for n in sheets) + len(strings)
    globals_ = head
    for name, body in zip(sheets, bodies, strict=True):
        globals_ += entry(name, at)
        at += len(body)
    return compound_file("Workbook", globals_ + strings + b"".join(bodies))


def compound_file(name: str, data: bytes) -> bytes:
    """A compound file of one stream; one of under 4096 bytes lies in the root's stream of small sectors."""
    free, end, table = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
    small = len(data) < 4096
    padded = lambda b, n: b + bytes(-len(b) % n)
    body = padded(padded(data, 64) if small else data, 512)
    minis = struct.pack(f"<{-(-len(data) // 64)}I", *range(1, -(-len(data) // 64)), end) if small else b""
    mini_table = minis + b"\xff" * (-len(minis) % 512)
    n, m = len(body) // 512, len(mini_table) // 512
    tables = 1
    while tables * 128 < n + m + 1 + tables:
        tables += 1
    chain = lambda start, count: [*range(start + 1, start + count), end] if count else []
    # tables, directory, table of small sectors, body
    links = [table] * tables + [end] + chain(tables + 1, m) + chain(tables + 1 + m, n)
    links += [free] * (tables * 128 - len(links))
    first = tables + 1 + m

    def entry(title: str, kind: int, child: int, start: int, size: int) -> bytes:
        text = title.encode("utf-16-le") + b"\0\0" if title else b""
        return text.ljust(64, b"\0") + struct.pack("<HBBIII", len(text), kind, 1, free, free, child) + bytes(36) + struct.pack("<IQ", start, size)

    inner = padded(data, 64)
    directory = entry("Root Entry", 5, 1, first if small else end, len(inner) if small else 0) + entry(name, 2, free, 0 if small else first, len(data)) + entry("", 0, free, 0, 0) * 2
    head = legacy.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, tables, tables, 0, 4096, tables + 1 if m else end, m, end, 0)
    head = head + struct.pack("<109I", *range(tables), *[free] * (109 - tables))
    return head + struct.pack(f"<{len(links)}I", *links) + directory + mini_table + body
