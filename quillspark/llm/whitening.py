"""Whitening of integer vectors by Chebyshev-filtered subspace iteration.

The covariance V of all vectors is never made: Spark multiplies it with a narrow matrix Q in one
pass over blocks of vectors, each task adding up its centred X'(XQ), and the d rows of the result
are summed by row.  A polynomial of V, built by the three-term recurrence, damps the spectrum
below the block's smallest Ritz value; QR and Rayleigh-Ritz follow, until every component's
residual certifies it.  The driver holds matrices of d rows and the block's width alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Vectors of a block at most; residuals, as shares of the largest eigenvalue, that certify, and that do where rounding allows no less.
BLOCK_ROWS, CERTAIN, ENOUGH = 1024, 1e-13, 1e-9
#: Greatest degree of the filter, and how much more it may raise the first component than the damped ones.
DEGREE, RAISE = 24, 1e11


@dataclass
class Whitening:
    """Components as columns of ``basis`` by falling ``eigenvalues``; ``sums`` are exact."""

    n: int
    sums: list[int]
    basis: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = field(default=0.0)


def quantised(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift of each entry, as longs; null for a vector that is null, empty or
    holds a null, a non-finite entry or one that exceeds 2^52 after scaling."""
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    fits = F.forall(scaled, lambda c: c.isNotNull() & (F.abs(c) < F.lit(2.0**52)) & ~F.isnan(c))
    return F.when(fits & (F.size(scaled) > 0), F.transform(scaled, lambda c: F.floor(c).cast("long") + F.lit(shift)))


def blocks_of(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """A written table of blocks (dims, ids, entries) of the non-null vectors, of one length each.

    ``entries`` holds little-endian 64-bit integers, row after row.  Ids may be null or repeated;
    other columns aren't read.
    """
    slim = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<long>").alias("x"))
    schema = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("ids", T.ArrayType(slim.schema["id"].dataType)), T.StructField("entries", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("x")], np.int64)
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                for s in range(0, len(rows), BLOCK_ROWS):
                    part = batch.take(pa.array(rows[s : s + BLOCK_ROWS]))
                    entries = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([part.column("id").to_pylist()], pa.list_(part.column("id").type)), pa.array([entries], pa.binary())], names=schema.names)

    return materialise(slim.where("x is not null").mapInArrow(run, schema), "blocks")


def _each(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and entries (rows by dims) of each block."""
    for batch in batches:
        for ids, raw in zip(batch.column("ids"), batch.column("entries"), strict=True):
            yield ids.values, np.frombuffer(raw.as_py(), "<i8").reshape(-1, dims)


def _centre(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x minus the mean: whole parts as integers, so no digits are lost to a large mean."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(float) - np.array([s % n / n for s in sums])


def _summed(blocks: DataFrame, dims: int, rows: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a (rows, width) matrix of each."""
    schema = "row int, v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for _, x in _each(batches, dims):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "v"])

    parts = blocks.select("ids", "entries").mapInArrow(run, schema).groupBy("row").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v"))
    out = np.zeros((rows, width))
    for r in parts.collect():
        out[r["row"]] = r["v"]
    return out


def _exact_sums(blocks: DataFrame, dims: int) -> list[int]:
    """The sum of each dimension: 64-bit in a block of entries below 2^53, decimals beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for _, x in _each(batches, dims):
            total = [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["row", "v"])

    parts = blocks.select("ids", "entries").mapInArrow(run, "row int, v decimal(38,0)").groupBy("row").agg(F.sum("v").alias("v"))
    found = {r["row"]: int(r["v"]) for r in parts.collect()}
    return [found[k] for k in range(dims)]


def fit(blocks: DataFrame, components: int = 8, seed: int = 7) -> Whitening | None:
    """The leading components of the covariance (divisor n) of the vectors of ``blocks_of``.

    Only vectors of the most frequent length take part, the longer one if two are as frequent.
    None for an empty table.  Components of no variance are left out, so there may be fewer than
    ``components``, and none where all vectors are equal.  Equal eigenvalues give some basis of
    their space.  Repeated vectors count as often as they come.
    """
    sizes = blocks.groupBy("dims").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not sizes:
        return None
    dims, n = sizes[0]["dims"], sizes[0]["n"]
    mine = blocks.where(F.col("dims") == dims)
    sums, passes = _exact_sums(mine, dims), 2

    def times(q: np.ndarray) -> np.ndarray:
        """The covariance times q: one pass over all vectors."""
        nonlocal passes
        passes += 1

        def product(x: np.ndarray) -> np.ndarray:
            c = _centre(x, sums, n)
            return c.T @ (c @ q)

        return _summed(mine, dims, dims, q.shape[1], product) / n

    trace = float(_summed(mine, dims, 1, 1, lambda x: np.array([[np.sum(_centre(x, sums, n) ** 2)]]))[0, 0] / n)
    rng = np.random.default_rng(seed)
    width = min(dims, 4 * components)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    wanted, before = min(components, dims), np.inf
    while True:
        # Rayleigh-Ritz: the best vectors within the block, and how far each is from an eigenvector.
        w = times(q)
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        residuals = np.linalg.norm(w - q * values, axis=0)[:wanted]
        worst = float(residuals.max() / max(values[0], np.finfo(float).tiny))
        if worst <= CERTAIN or trace == 0 or (worst <= ENOUGH and worst > before / 2) or (width == dims and worst >= before):
            break
        if worst > before / 10 and width < dims:
            # A flat spectrum: a wider block converges in fewer passes, at the latest when it spans all.
            more = rng.standard_normal((dims, min(dims - width, width)))
            q, width = np.linalg.qr(np.c_[q, more])[0], width + more.shape[1]
            before = np.inf
            continue
        before = worst
        if width == dims:
            continue
        # The filter: T_m((2V - cut) / cut) Q, where [0, cut] is the spectrum to be damped.
        cut = max(values[-1], 1e-9 * values[0])
        degree = int(min(DEGREE, max(1.0, np.arccosh(RAISE) / np.arccosh(max(2 * values[0] / cut - 1, 1 + 1e-9)))))
        last, now = q, w * (2 / cut) - q
        for _ in range(degree - 1):
            last, now = now, 2 * (times(now) * (2 / cut) - now) - last
        q = np.linalg.qr(now)[0]
    held = np.flatnonzero(values[:wanted] > 1e-12 * trace) if trace > 0 else np.zeros(0, int)
    model = Whitening(n, sums, q[:, held], values[held], trace, residuals[held], passes)
    if len(held):
        k = len(held)

        def moments(x: np.ndarray) -> np.ndarray:
            z = _projected(model, x)
            return np.c_[z.T @ z, z.sum(0)]

        got = _summed(mine, dims, k, k + 1, moments) / n
        model.identity_error = float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())
        model.passes += 1
    return model


def _projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    return _centre(x, model.sums, model.n) @ model.basis / np.sqrt(model.eigenvalues)


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Each row's sum of (n x - S)^2, exact; null where it exceeds a long."""
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    c = x - whole
    if ((int(np.abs(c).max(initial=0)) + 1) * n) ** 2 * x.shape[1] < 2**63:
        return np.sum((n * c - np.array(rest, np.int64)) ** 2, axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in c.tolist()]
    return [e if e < 2**63 else None for e in exact]


def project(blocks: DataFrame, model: Whitening | None) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) of every vector of
    the model's length and every component, numbered from 1.  No model gives no rows."""
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    if model is None:
        return blocks.sparkSession.createDataFrame([], schema)
    dims, k = len(model.sums), len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if k else model.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _each(batches, dims):
            m = len(x)
            columns = [
                ids.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array(_deviations(x, model.sums, model.n), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(_projected(model, x).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.where(F.col("dims") == dims).select("ids", "entries").mapInArrow(run, schema)
