"""Embedding whitening: principal components by block Lanczos without a covariance matrix, in distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import tidy, written

COMPONENTS = 4
#: Columns of a block, and blocks after which the basis is cut down to its best vectors (the driver holds 2 * BLOCK * KEEP vectors).
BLOCK, KEEP = 12, 24
#: A component has converged when its residual is under TOLERANCE times the largest eigenvalue.
TOLERANCE = 1e-14
SCALE = 256
_MOST = 1 << 63


@dataclass
class Fit:
    """Of the fit list: n vectors with sums per dimension, the trace of their covariance, and its leading eigenpairs
    (values falling, one column a component)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def quantised(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x = floor(256 c) as longs, of rows without a null vector and null or non-finite entries. Values beyond a
    long become the nearest one."""
    v = F.col(vector)
    good = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.when(F.abs(c.cast("double")) < 2.0**55, F.floor(c.cast("double") * SCALE).cast("long")).when(c > 0, F.lit(_MOST - 1)).otherwise(F.lit(-_MOST))
    return embeddings.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id"), F.transform(v, held).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A batch of vectors of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as longs where they fit and as Python's integers elsewhere."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if most < _MOST:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    if d.dtype != object and len(d) and float(np.abs(d).max()) ** 2 * d.shape[1] < _MOST:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in map(int, row)) for row in d]


def _batched(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (fn(b) for b in batches if b.num_rows)

    return df.mapInArrow(tidy(run), schema)


class Centred:
    """The covariance of the vectors in fitted (column x) as an operator on blocks of vectors: X'(X v) over centred rows."""

    def __init__(self, fitted: DataFrame, n: int, sums: list[int]):
        self.fitted, self.n, self.sums, self.passes = fitted, n, sums, 0

    def sum_over(self, fn: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Sum of fn(centred rows) over all vectors. A task adds up its own; rows of their sums are added by Spark, so that the driver gets one matrix."""
        dims, n, sums = len(self.sums), self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, low = np.zeros(shape), np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    part = fn(_deviations(_matrix(batch.column(0), dims), n, sums).astype(np.float64) / n)
                    new = total + part  # and what rounding lost of it
                    low += np.where(np.abs(total) >= np.abs(part), (total - new) + part, (part - new) + total)
                    total = new
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array((total + low).tolist(), pa.list_(pa.float64()))], names=["row", "part"])

        parts = self.fitted.select("x").mapInArrow(tidy(run), "row long, part array<double>")
        rows = parts.groupBy("row").agg(F.array(*[F.sum(F.col("part")[j]) for j in range(shape[1])]).alias("total")).collect()
        out = np.zeros(shape)
        for r in rows:
            out[r.row] = r.total
        self.passes += 1
        return out

    def times(self, block: np.ndarray) -> np.ndarray:
        return self.sum_over(lambda rows: rows.T @ (rows @ block), block.shape) / self.n


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that are orthogonal to basis and span block. Where a column of block has nothing left of its own
    (breakdown), a random direction takes its place; fewer columns come back only when the space is full."""
    dims, out = len(block), np.zeros((len(block), 0))
    room = dims - basis.shape[1]
    for j in range(min(block.shape[1], room)):
        v, floor = block[:, j], 1e-10 * scale
        for _ in range(8):
            norm = np.linalg.norm(v)
            if norm <= floor:
                v, floor = rng.standard_normal(dims), 1e-6
                continue
            v = v / norm
            for _ in range(3):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left * norm <= floor or left < 1e-12:
                v, floor = rng.standard_normal(dims), 1e-6
                continue
            out = np.column_stack([out, v / left])
            break
    return out


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, keep: int = KEEP, tolerance: float = TOLERANCE, most: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, vectors and residuals of a symmetric operator that is known by its products only.

    Each step multiplies one block and makes the result orthogonal to all vectors so far, thrice over. The basis is judged by
    the residuals of its wanted Ritz pairs, which must hold in two steps on end, so that a pair which the start has missed can
    come forth; or come no lower in four steps, at the level of rounding. A basis that spans the space is exact. One of keep
    blocks is cut down to its leading Ritz vectors and goes on with the next block.
    """
    rng = np.random.default_rng(20)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    fresh, held, worst = _orthogonal(rng.standard_normal((dims, min(block, dims))), basis, 1.0, rng), 0, []
    values = vectors = residuals = np.zeros(0)
    for _ in range(most):
        product = times(fresh)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product])
        projected = basis.T @ image
        theta, rotation = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, ritz, moved = theta[order], basis @ rotation[:, order], image @ rotation[:, order]
        k = min(wanted, len(theta))
        largest = max(float(np.abs(theta).max()), 1e-300)
        values, vectors, residuals = theta[:k], ritz[:, :k], np.linalg.norm(moved[:, :k] - ritz[:, :k] * theta[:k], axis=0)
        worst.append(float(residuals.max()) / largest)
        held = held + 1 if worst[-1] <= tolerance else 0
        stuck = len(worst) > 4 and worst[-1] < 1e-11 and min(worst[-4:]) > 0.5 * min(worst[:-4])
        if basis.shape[1] == dims or held == 2 or stuck:
            break
        fresh = _orthogonal(product - basis @ (basis.T @ product), basis, largest, rng)
        if basis.shape[1] >= block * keep:
            stay = block * keep // 2
            basis, image = ritz[:, :stay], moved[:, :stay]
    return values, vectors / np.linalg.norm(vectors, axis=0), residuals


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[Fit, DataFrame]:
    """Fit of the distinct vectors of x (column x), and the table of these."""
    fitted = written(x.select("x").distinct(), "fit-list")
    exact = F.col("v").cast("decimal(38,0)")
    by_dim = fitted.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(exact).alias("s")).orderBy("d").collect()
    n, sums = fitted.count(), [int(r.s) for r in by_dim]
    if n < 2 or not sums:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)), np.zeros(0), 0), fitted
    operator = Centred(fitted, n, sums)
    # the trace from the deviations: sum of |n x - S|^2 over n^3
    trace = float(operator.sum_over(lambda rows: np.array([[float((rows * rows).sum())]]), (1, 1))[0, 0]) / n
    if not trace:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)), np.zeros(0), operator.passes), fitted
    values, vectors, residuals = block_lanczos(operator.times, len(sums), components)
    good = values > 1e-12 * values[0]
    return Fit(n, sums, trace, values[good], vectors[:, good], residuals[good], operator.passes), fitted


def _identity_error(found: Fit, fitted: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    operator, to = Centred(fitted, found.n, found.sums), found.vectors / np.sqrt(found.values)
    k = len(found.values)
    mean = operator.sum_over(lambda rows: (rows @ to).sum(axis=0)[None, :], (1, k)) / found.n

    def outer(rows: np.ndarray) -> np.ndarray:
        w = rows @ to - mean
        return w.T @ w

    return float(np.abs(operator.sum_over(outer, (k, k)) / found.n - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of embeddings (vec_id and vector; other columns are ignored) on their principal components.

    Rows with a null vector or null or non-finite entries are dropped. Entries become x = floor(256 c). The fit list holds
    each distinct x once: n vectors, sums S, covariance with divisor n. Components are numbered from 1 by falling
    eigenvalue. Returns for each row and component vec_id, component (int), n, deviation (sum over dimensions of
    (n x - S)^2, exact; null beyond a long), whitened ((x - S / n) on the component, over the root of its eigenvalue),
    explained (eigenvalue over trace) and identity_error (largest entry of the whitened covariance less the identity).

    Components without variance have no rows: so do fewer than two distinct vectors, or none. Of vectors of several lengths
    those of the most frequent length (the larger of equal ones) count, others are dropped like malformed entries; empty
    vectors have no components. Repeated rows and null vec_ids are rows like others.
    """
    x = quantised(embeddings, vector)
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = x.where(F.size("x") == (sizes.d if sizes else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    found, fitted = fit(rows, components)
    k, dims = len(found.values), len(found.sums)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = _identity_error(found, fitted)
    n, sums, to, explained = found.n, found.sums, found.vectors / np.sqrt(found.values), found.values / found.trace

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = _deviations(_matrix(batch.column(1), dims), n, sums)
        squares = [s if s < _MOST else None for s in _squares(d)]
        w = d.astype(np.float64) / n @ to
        m = len(w)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return _batched(rows, project, schema)
