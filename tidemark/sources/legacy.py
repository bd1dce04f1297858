"""Cells of .xls workbooks: compound files and BIFF8 records, as their public specifications lay them down.

A compound file is a small file system of sectors chained through an allocation table;
short streams lie in sectors of 64 bytes inside the root's stream.  The stream Workbook
is a run of records; a record that is longer than a record may be goes on in CONTINUE
records, and a string that such a border cuts says there anew how wide its characters are.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

#: Fixed values of the formats.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
CHAIN_END = 0xFFFFFFFA
CONTINUE, SHEET, STRINGS, BOF, EOF = 0x3C, 0x85, 0xFC, 0x809, 0x0A
NUMBER, LABEL_SHARED, RK, MANY_RK, LABEL, FORMULA, TEXT, BOOLEAN = 0x203, 0xFD, 0x27E, 0xBD, 0x204, 0x06, 0x207, 0x205
#: Where the header has its fields: sector shifts, number and places of the tables.
HEADER = {"shift": (30, "<H"), "mini_shift": (32, "<H"), "tables": (44, "<I"), "directory": (48, "<I"), "cutoff": (56, "<I"), "mini_table": (60, "<I"), "more": (68, "<I")}


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        head = {k: struct.unpack_from(kind, data, at)[0] for k, (at, kind) in HEADER.items()}
        self.size, self.mini = 1 << head["shift"], 1 << head["mini_shift"]
        self.data, self.cutoff = data, head["cutoff"]
        listed = self._numbers(data[76:512])
        more = head["more"]
        for _ in range(len(data) // self.size):
            if more >= CHAIN_END:
                break
            block = self._numbers(self._sector(more))
            listed, more = np.concatenate([listed, block[:-1]]), int(block[-1])
        used = listed[listed < CHAIN_END][: head["tables"]]
        self.table = np.concatenate([self._numbers(self._sector(int(i))) for i in used])
        self.entries = dict(self._directory(b"".join(map(self._sector, self._chain(self.table, head["directory"])))))
        self.mini_table = self._numbers(b"".join(map(self._sector, self._chain(self.table, head["mini_table"]))))

    @staticmethod
    def _numbers(data: bytes) -> np.ndarray:
        return np.frombuffer(data[: len(data) // 4 * 4], dtype="<u4")

    def _sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size]

    @staticmethod
    def _chain(table: np.ndarray, start: int) -> Iterator[int]:
        at, left = start, len(table)
        while at < CHAIN_END:
            if at >= len(table) or left < 0:
                raise ValueError("a sector chain leaves its table or runs in a circle")
            yield at
            at, left = int(table[at]), left - 1

    @staticmethod
    def _directory(data: bytes) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """(name, (kind, first sector, length)) of each entry; the root's name is its kind's."""
        for at in range(0, len(data) - 127, 128):
            length, kind = struct.unpack_from("<HB", data, at + 64)
            if kind:
                start, size = struct.unpack_from("<IQ", data, at + 116)
                yield "/" if kind == 5 else data[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), (kind, start, size)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise KeyError(f"no stream {name}; there are {sorted(self.entries)}")
        _, start, size = self.entries[name]
        if name == "/" or size >= self.cutoff:
            return b"".join(map(self._sector, self._chain(self.table, start)))[:size]
        inner = self.stream("/")
        return b"".join(inner[i * self.mini : (i + 1) * self.mini] for i in self._chain(self.mini_table, start))[:size]


def records(stream: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(place, kind, parts) of each record, with the parts that go on in CONTINUE records."""
    at, held = 0, None
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + size]
        if kind == CONTINUE and held:
            held[2].append(body)
        else:
            if held:
                yield held
            held = (at, kind, [body])
        at += 4 + size
    if held:
        yield held


class _Parts:
    """Parts of one record read as one run of bytes, with the borders between them in mind."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.data, self.at = b"".join(parts), at
        self.ends = np.cumsum([len(p) for p in parts]).tolist()

    def number(self, kind: str) -> int:
        self.at += struct.calcsize(kind)
        return struct.unpack_from(kind, self.data, self.at - struct.calcsize(kind))[0]

    def text(self, count: int, wide: int) -> str:
        out = []
        while count:
            border = self.ends[min(bisect_right(self.ends, self.at), len(self.ends) - 1)]
            take = min(count, (border - self.at) >> wide)
            out.append(self.data[self.at : self.at + (take << wide)].decode("utf-16-le" if wide else "latin-1", "replace"))
            self.at += take << wide
            count -= take
            if count:  # a border cuts the string
                if self.at >= len(self.data):
                    break
                wide = self.number("<B") & 1
        return "".join(out)

    def string(self) -> str:
        """One entry of the shared strings: text, then what says how it looks, which is passed over."""
        count, flags = self.number("<H"), self.number("<B")
        looks = 4 * self.number("<H") if flags & 8 else 0
        looks += self.number("<I") if flags & 4 else 0
        found = self.text(count, flags & 1)
        self.at += looks
        return found


def _shared(parts: list[bytes]) -> list[str]:
    at, out = _Parts(parts, 8), []
    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        if at.at + 3 > len(at.data):
            break
        out.append(at.string())
    return out


def packed_number(v: int) -> float:
    """A number in 30 bits: an integer or the upper bits of a double, either perhaps in hundredths."""
    x = float((v >> 2) - ((v >> 31) << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return x / 100 if v & 1 else x


def _shown(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _cells(kind: int, parts: list[bytes], shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of a record of cells."""
    d = parts[0]
    row, col = struct.unpack_from("<HH", d, 0)
    if kind == NUMBER:
        yield row, col, _shown(struct.unpack_from("<d", d, 6)[0])
    elif kind == FORMULA and d[12:14] != b"\xff\xff":  # else no number, but a text that follows, a truth value or an error
        yield row, col, _shown(struct.unpack_from("<d", d, 6)[0])
    elif kind == RK:
        yield row, col, _shown(packed_number(struct.unpack_from("<I", d, 6)[0]))
    elif kind == MANY_RK:
        for k in range((len(d) - 6) // 6):
            yield row, col + k, _shown(packed_number(struct.unpack_from("<I", d, 6 + 6 * k)[0]))
    elif kind == LABEL_SHARED:
        at = struct.unpack_from("<I", d, 6)[0]
        yield row, col, shared[at] if at < len(shared) else ""
    elif kind == LABEL:
        yield row, col, _Parts(parts, 9).text(struct.unpack_from("<H", d, 6)[0], d[8] & 1)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    """(sheet, row number from 0, cells as text) of an .xls file of BIFF8."""
    titles, shared, held, name, row, formula = {}, [], {}, None, {}, None
    for place, kind, parts in records(Compound(content).stream("Workbook")):
        if kind == SHEET:
            start, _, size, wide = struct.unpack_from("<IHBB", parts[0], 0)
            titles[start] = _Parts(parts, 8).text(size, wide & 1)
            held[titles[start]] = {}
        elif kind == STRINGS:
            shared = _shared(parts)
        elif kind == BOF:
            name = titles.get(place)
        elif name is not None and kind in (NUMBER, LABEL_SHARED, RK, MANY_RK, LABEL, FORMULA):
            for r, c, text in _cells(kind, parts, shared):
                held[name].setdefault(r, {})[c] = text
            formula = struct.unpack_from("<HH", parts[0], 0) if kind == FORMULA else None
        elif name is not None and kind == TEXT and formula:
            held[name].setdefault(formula[0], {})[formula[1]] = _Parts(parts, 3).text(struct.unpack_from("<H", parts[0], 0)[0], parts[0][2] & 1)
    for title, rows in held.items():
        for r, row in sorted(rows.items()):
            yield title, r, [row.get(c) for c in range(max(row) + 1)]
