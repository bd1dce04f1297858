"""Operator 11: embedding whitening by matrix-free block subspace iteration.

Entries become integers (floor of SCALE times the entry), so sums and deviations are
exact.  The fit list is each distinct integer vector once: n of them, with sums S.
Principal components of their covariance V come from block subspace iteration: one
Spark pass computes V Q = X'(X Q) / n on centred rows for a block Q, without V ever
being formed; a QR step and a Rayleigh-Ritz step follow on the driver, on matrices of
d rows and at most BASIS columns.  Blocks of earlier passes stay in the basis, with
their products, until it holds BASIS columns; then the leading Ritz vectors stay.  It
ends when the residuals |V y - e y| of all k components are at most TOLERANCE times
the largest eigenvalue, or the basis is the whole space.  Plain iteration, which keeps
the last block alone, gains a factor e[block+1] / e[k] a pass: with neighbouring
eigenvalues half a per cent apart that is thousands of passes.

A vector whose covariance has eigenvalue 0 in a direction has no component there, so
there may be fewer than k.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped;
shorter vectors count as filled up with zeros; entries beyond the range of long are cut
to it; a deviation beyond the range of long is null; repeated rows are transformed each
and counted once in the fit; null ids stay; no rows, or one distinct vector, have no
components (the query then has no rows); other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ._common import cut, drop_cut, table

SCALE = 256
#: Components asked for.
K = 4
#: Columns of a block, and of the basis that the driver holds.
BLOCK, BASIS = 16, 128
#: Residuals that certify a component, as a share of the largest eigenvalue.
TOLERANCE = 1e-12
MAX_PASSES = 500


@dataclass
class Whitening:
    """n: vectors fitted; sums: their exact sums; basis: d x k components; values: their eigenvalues; trace: of V; residuals: |V y - e y|."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector, real), F.lit(False))


def levels(vector: Column, scale: int = SCALE) -> Column:
    """The integers of a vector's entries."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def _filled(x: Column, size: int) -> Column:
    return F.when(F.size(x) < size, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x)))).otherwise(x)


def fit_list(df: DataFrame, vector: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(x) each distinct integer vector once, written to the shared folder; and the number of dimensions."""
    seen = Observation()
    x = df.where(usable(df[vector])).select(levels(df[vector], scale).alias("x"))
    distinct = cut(x.distinct().observe(seen, F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")), "vectors")
    least, most = seen.get["least"] or 0, seen.get["most"] or 0
    if least == most:
        return distinct, most
    even = cut(distinct.select(_filled(F.col("x"), most).alias("x")).distinct(), "vectors")
    drop_cut(distinct)
    return even, most


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of integers, filled up with zeros."""
    flat, length = pc.list_flatten(column).to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (length == size).all():
        return flat.reshape(len(length), size)
    out = np.zeros((len(length), size), dtype=np.int64)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int], list[int]]:
    """Number of vectors, and exact sums and sums of squares of each dimension."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(size, dtype=object), np.zeros(size, dtype=object)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), size)
                x = x if np.abs(x.astype(np.float64)).max(initial=0) ** 2 * len(x) < 2.0**62 else x.astype(object)
                n, s, q = n + len(x), s + x.sum(axis=0).astype(object), q + (x * x).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(size)), "n": [n] * size, "s": [str(v) for v in s], "q": [str(v) for v in q]})

    parts = fit.mapInArrow(of, "i long, n long, s string, q string")
    total = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "sq"]).orderBy("i").collect()  # a row a dimension
    return (total[0]["n"] if total else 0), [int(r["s"]) for r in total], [int(r["q"]) for r in total]


def _summed(fit: DataFrame, part, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all batches of the matrix part(batch's rows), added up entry by entry across tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(shape), False
        for b in batches:
            if b.num_rows:
                total, any_rows = total + part(b.column(0)), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(shape)
    for r in fit.mapInArrow(of, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # d x block rows
        out.flat[r["i"]] = r["v"]
    return out


def _times(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """V q, in one pass over the centred rows."""

    def part(column: pa.Array) -> np.ndarray:
        x = _matrix(column, len(mean)) - mean
        return x.T @ (x @ q)

    return _summed(fit, part, q.shape) / n


def _new_directions(z: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """An orthonormal basis of what z adds to the span of basis; columns of rounding alone go."""
    for _ in range(2):
        z = z - basis @ (basis.T @ z)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    u = u[:, s > 1e-13 * scale]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def fit(df: DataFrame, vector: str = "embedding", k: int = K, block: int = BLOCK, basis: int = BASIS, tolerance: float = TOLERANCE, scale: int = SCALE) -> Whitening:
    """The k leading components of the covariance of df's distinct vectors."""
    vectors, size = fit_list(df, vector, scale)
    out = fit_vectors(vectors, size, k, block, basis, tolerance)
    drop_cut(vectors)
    return out


def fit_vectors(vectors: DataFrame, size: int, k: int = K, block: int = BLOCK, basis: int = BASIS, tolerance: float = TOLERANCE) -> Whitening:
    n, sums, squares = _sums(vectors, size)
    spread = sum(n * q - s * s for s, q in zip(sums, squares, strict=True))
    if not n or not spread:
        return Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    trace, mean = spread / (n * n), np.array([s / n for s in sums])
    width = min(max(block, k), size)
    limit = max(basis, 2 * width + k)
    have = np.linalg.qr(np.random.default_rng(20240607).standard_normal((size, width)))[0]
    made, passes = _times(vectors, mean, n, have), 1
    while True:
        ritz = have.T @ made
        value, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        y, vy = have @ turn, made @ turn
        rest = vy - y * value
        size_of = np.linalg.norm(rest[:, :k], axis=0)
        if have.shape[1] == size or (size_of <= tolerance * value[0]).all():
            break
        if passes >= MAX_PASSES:
            raise RuntimeError(f"residuals {size_of} after {passes} passes")
        if have.shape[1] + width > limit:
            have, made = y[:, : k + width], vy[:, : k + width]
        q = _new_directions(rest[:, :width], have, value[0])
        if not q.shape[1]:
            break
        have, made, passes = np.hstack([have, q]), np.hstack([made, _times(vectors, mean, n, q)]), passes + 1
    real = value[:k] > size * np.finfo(float).eps * value[0] * 16
    y = y[:, :k][:, real]
    return Whitening(n, sums, y / np.linalg.norm(y, axis=0), value[:k][real], trace, size_of[real], passes)


def _project(x: np.ndarray, w: Whitening) -> np.ndarray:
    return ((x - w.mean) @ w.basis) / np.sqrt(w.values)


def whitened(vector: Column, w: Whitening, scale: int = SCALE) -> Column:
    """struct(deviation, white): sum of squares of n x - S, and the projections on the components over the roots of their eigenvalues."""
    size = len(w.sums)

    def of(column: pa.Array) -> pa.Array:
        x = _matrix(column, size)
        far = ((x - w.mean) ** 2).sum(axis=1) * float(w.n) ** 2
        with np.errstate(over="ignore"):  # sums that fit are right modulo 2 ** 64
            whole = (x.view(np.uint64) * np.uint64(w.n) - np.array([s % 2**64 for s in w.sums], dtype=np.uint64)) if size else x.view(np.uint64)
            deviation = (whole * whole).sum(axis=1, dtype=np.uint64).view(np.int64)
        white = _project(x, w)
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
        return pa.StructArray.from_arrays([pa.array(deviation, mask=far >= 2.0**63 * (1 - 1e-9)), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["deviation", "white"])

    return F.arrow_udf(of, "struct<deviation:bigint,white:array<double>>")(levels(vector, scale))


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the fitted vectors, whitened, minus the identity."""
    k = len(w.values)

    def part(column: pa.Array) -> np.ndarray:
        y = _project(_matrix(column, len(w.sums)), w)  # an image of centred rows
        return y.T @ y

    return float(np.abs(_summed(vectors, part, (k, k)) / w.n - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, vector: str, w: Whitening, out: str = "w", scale: int = SCALE) -> DataFrame:
    """df's rows with a usable vector, and struct(deviation, white) as column out."""
    return df.where(usable(df[vector])).withColumn(out, whitened(df[vector], w, scale))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def components_of(rows: DataFrame) -> DataFrame:
    """A row for each (vec_id, embedding) that is usable and each component, as the query returns them."""
    vectors, size = fit_list(rows, "embedding")
    w = fit_vectors(vectors, size)
    error = identity_error(vectors, w)
    drop_cut(vectors)
    share = F.array(*[F.lit(float(v / w.trace)) for v in w.values]) if len(w.values) else F.array().cast("array<double>")
    long = whiten(rows, "embedding", w).select("vec_id", "w.deviation", F.posexplode("w.white").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
