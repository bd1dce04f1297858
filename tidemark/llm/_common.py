"""Shared helpers: checkpoint folder, byte-level tokenisation and hashing in numpy.

Texts are handled as UTF-8 bytes of whole Arrow batches.  A word is a maximal run
of bytes outside ``[\\x20\\x09-\\x0D]``; multi-byte characters never contain those
bytes, so byte runs and code point runs are the same words.  Word hashes are
64-bit polynomial hashes over a random byte table, the same in every process.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer document is handled alone.
CHUNK_BYTES = 500_000
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch of rows that are large themselves, until which it takes another row.
BATCH_BYTES = 4_000_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 65536)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Words:
    """The words of a run of texts, as arrays.

    raw: bytes; at: byte offset of each text, with the end; first: index of each
    text's first word, with the total; start, end: byte range of each word.  outside:
    which bytes are in no word.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACE):
        self.raw, self.at = raw, at
        n = len(raw)
        inside = ~outside[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, at)
        self.inside = inside
        self._sums: np.ndarray | None = None

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        power, inverse = _power_tables(len(self.raw) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.raw) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.raw] * power[: len(self.raw)], out=self._sums[1:])
        return mix64((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64) * GOLDEN)

    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and which of these lie within one text."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    whole = np.zeros(n, dtype=bool)
    if n >= k:
        acc = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            acc = mix64(acc * GOLDEN + hashes[j : n - k + 1 + j]) if j % 4 == 3 else acc * GOLDEN + hashes[j : n - k + 1 + j]
        out[: n - k + 1] = mix64(acc + np.uint64(k))
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        whole = left >= k
    return out, whole


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags between neighbouring bounds."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def text_chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, outside: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, n)
        part = raw[at[i] : at[j]]
        yield i, j, Words(LOWER[part] if lower else part, at[i : j + 1] - at[i], outside)
        i = j


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def give_back() -> None:
    """Return to the system what Arrow and malloc hold unused."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def batch_udf(of: Callable, kind: str, once: bool = False, lean: bool = False) -> Callable:
    """arrow_udf over batches of at most BATCH_ROWS rows, as texts may be long.

    once: filters on what it returns stay above it; else Spark works it out twice, for
    the filter and for the rows that pass, with two Python workers a task.
    lean: a batch's memory goes back when it is done; else workers hold it while later
    stages run in the JVM alone.
    """
    batch_rows(SparkSession.active())

    @wraps(of)
    def then_less(*columns):
        out = of(*columns)
        give_back()
        return out

    made = F.arrow_udf(then_less if lean else of, kind)
    return made.asNondeterministic() if once else made


def batch_rows(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS rows, where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def batch_bytes(spark: SparkSession) -> None:
    """Let the session's Arrow batches end at BATCH_BYTES, where they end later; a larger row is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut", alone: bool = False) -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage ends here, and lost executors cost nothing before it.

    alone: each row is a row group; else Parquet's writer holds a hundred rows before
    it looks at their size, and the reader as many, whatever a row takes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    (df.write.option("parquet.block.row.count.limit", "1") if alone else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, what: str = "cut") -> tuple[DataFrame, int]:
    """cut(), and the number of rows, counted while writing."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")), what)
    return out, seen.get["rows"] or 0


def cut_marked(df: DataFrame, columns: list[str], what: str = "cut") -> tuple[DataFrame, tuple]:
    """cut(), and (rows, xor of their hashes) as counted while writing."""
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("mark"))
    out = cut(marked, what)
    got = seen.get
    return out, (got["rows"] or 0, got["mark"])


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a frame made by cut() that no later step reads; other files stay."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tidemark/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
