"""Operator 4: token counts by a separator scan of flat, unindexed token files.

A token file is little-endian ids of one width, documents one after another, each
closed by the end-of-document id; nothing says where documents begin.  Files are
read in blocks of a fixed number of ids, one Spark partition each, through a Python
data source; a block is compared with the end id in numpy.  A block knows where its
own documents end but not what came before it, so each reports its separators and
its last one, and a prefix scan over the blocks of a file (running counts, and the
last separator so far) gives every document its number, start and length.

Edge cases: an empty file has no documents; two end ids in a row close an empty
document; ids after the last end id are a document that isn't closed (closed is
false); a file whose size isn't a multiple of the width is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ._common import cut, fresh_path, table
from .pieces import MODEL, _groups, _model, encode_texts, load

#: Ids of a block.
BLOCK = 8_000_000
SEPARATOR = 2
WIDTH = 2


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Block(InputPartition):
    def __init__(self, path: str, number: int, start: int, size: int):
        self.path, self.number, self.start, self.size = path, number, start, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width, self.separator, self.block = options["path"], int(options.get("width", WIDTH)), int(options["separator"]), int(options.get("block", BLOCK))

    def partitions(self) -> list[_Block]:
        system, path = _open(self.path)
        out = []
        for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
            if f.extension != "tokens":
                continue
            if f.size % self.width:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole number of ids")
            n = f.size // self.width
            out += [_Block(f.path, k, k * self.block, min(self.block, n - k * self.block)) for k in range(-(-n // self.block))]
        return out or [_Block("", 0, 0, 0)]

    def read(self, block: _Block) -> Iterator[tuple]:
        if not block.size:
            return
        system, _ = _open(self.path)
        with system.open_input_file(block.path) as f:
            raw = f.read_at(block.size * self.width, block.start * self.width)
        found = np.flatnonzero(np.frombuffer(raw, dtype=f"<u{self.width}") == self.separator) + block.start
        yield block.path.rpartition("/")[2], block.number, block.start, block.size, found.tolist()


class TokenBlocks(DataSource):
    """spark.read.format("token_blocks").option("separator", id).load(folder): separators of each block of the *.tokens files."""

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return "file string, block bigint, start bigint, size bigint, found array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) of each document of the token files in a folder."""
    spark.dataSource.register(TokenBlocks)
    blocks = spark.read.format("token_blocks").options(separator=separator, width=width, block=block).load(folder)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # blocks carry counts, not ids, into the scan
    carried = blocks.select("file", "block", "start", "size", F.size("found").alias("n"), F.try_element_at("found", F.lit(-1)).alias("last"))
    carry = carried.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before"))
    both = blocks.join(carry, ["file", "block"])
    starts = F.concat(F.array("end_before"), F.slice("found", F.lit(1), F.greatest(F.size("found") - 1, F.lit(0))))
    docs = F.zip_with(starts, F.col("found"), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n_tokens")))
    closed = both.where(F.size("found") > 0).select("file", "docs_before", F.posexplode(docs).alias("i", "d")).select("file", (F.col("docs_before") + F.col("i")).alias("doc_no"), "d.start", "d.n_tokens", F.lit(True).alias("closed"))
    ends = carried.groupBy("file").agg(F.max(F.col("start") + F.col("size")).alias("size"), F.coalesce(F.max("last"), F.lit(-1)).alias("end"), F.sum("n").alias("doc_no"))
    rest = ends.where(F.col("size") > F.col("end") + 1).select("file", F.col("doc_no").cast("long").alias("doc_no"), (F.col("end") + 1).alias("start"), (F.col("size") - F.col("end") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def write_tokens(docs: DataFrame, folder: str, model: str = MODEL, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Writes the pieces of (doc_id, text) as token files, one a partition; returns (file, doc_no, doc_id).

    A file appears under its name in one rename, when it is whole; a repeated task
    writes the same bytes to the same name.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(_model(spark, model))  # one model file
    system, path = _open(folder)
    system.create_dir(path, recursive=True)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, target, p = f"part-{task.partitionId():06d}.tokens", _open(folder), load(held.value)
        draft = f"{target[1]}/_{name}.{task.taskAttemptId()}"
        ids = []
        with target[0].open_output_stream(draft) as out:
            for batch in batches:
                texts = pc.fill_null(batch.column(1), "").to_pylist()
                for i, j in _groups(texts):
                    got, counts = encode_texts(p, texts[i:j], 0.0, 0, 1)
                    closed = np.full(len(got) + j - i, separator, dtype=f"<u{width}")
                    keep = np.ones(len(closed), dtype=bool)
                    keep[np.cumsum(counts + 1) - 1] = False
                    closed[keep] = got
                    out.write(closed.tobytes())
                ids.append(batch.column(0))
        target[0].move(draft, f"{target[1]}/{name}")
        first = 0
        for column in ids:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(column), pa.string()), pa.array(np.arange(first, first + len(column))), column], names=["file", "doc_no", "doc_id"])
            first += len(column)

    return docs.select("doc_id", "text").mapInArrow(of, "file string, doc_no bigint, doc_id bigint")


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    written = cut(write_tokens(table(spark, sf_dir, "documents"), folder), "manifest")
    return scan(spark, folder).join(written, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens")
