"""PCA whitening of embeddings by matrix-free block subspace iteration: no covariance matrix is made, each pass of Spark over the rows multiplies it into a block of columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import cut, drop_cut, in_arrow

SCALE, SHIFT = 1024, 100_000
#: A component is certified once |V c - e c| is at most so much of the largest eigenvalue; eigenvalues at most EMPTY of the trace are none.
CERTIFIED, EMPTY = 1e-12, 1e-12
_BIG = 1 << 62


def fixed_point(vector: Column) -> Column:
    """Entries as long, floor(1024 c) + 100000; null where the vector or an entry is null, not finite, or beyond what a long holds."""
    inside = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 50), F.lit(False)))  # false for NaN too, which is above all numbers
    return F.when(vector.isNotNull() & F.coalesce(inside, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that can be whitened. Where lengths differ, rows of another length than the commonest (of several the longest) are left out, too, and so are empty vectors."""
    x = embeddings.select("vec_id", fixed_point(F.col(vector)).alias("x")).filter("x is not null and size(x) > 0")
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.size("x") == (common["d"] if common else 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Moments:
    n: int
    sums: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)


def moments(x: DataFrame) -> Moments:
    """How many rows there are, and the exact sum of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                m = _matrix(b, len(b.column(0)[0]))
                n, total = n + len(m), m.sum(0) if total is None else total + m.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.concatenate([[n], total]))], ["i", "s"])

    rows = sorted(in_arrow(x.select("x"), work, "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).collect())  # one row a dimension
    return Moments(rows[0]["s"] if rows else 0, np.array([r["s"] for r in rows[1:]], np.int64))


def _summed(x: DataFrame, part, rows: int, cols: int) -> np.ndarray:
    """The sum of part(matrix) (rows x cols) over the batches of all tasks; only the sum reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, cols))
        for b in batches:
            if b.num_rows:
                total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *[pa.array(c) for c in total.T]], ["i", *[f"c{j}" for j in range(cols)]])

    schema = "i long, " + ", ".join(f"c{j} double" for j in range(cols))
    found = in_arrow(x.select("x"), work, schema).groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(cols)]).collect()
    out = np.zeros((rows, cols))
    for r in found:
        out[r["i"]] = r[1:]
    return out


def times_covariance(x: DataFrame, m: Moments, q: np.ndarray) -> np.ndarray:
    """V q, in one pass: each row is centred, then multiplied. Rows stay where they are; what moves is d x p numbers a task."""
    mean, d = m.mean, len(m.sums)

    def part(b: pa.RecordBatch) -> np.ndarray:
        rows = _matrix(b, d) - mean
        return rows.T @ (rows @ q)

    return _summed(x, part, *q.shape) / m.n


@dataclass(frozen=True)
class Components:
    """Unit columns by falling eigenvalue, what certified them, and how many passes it took."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int


def _orthonormal(block: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis; columns that add at most `floor` are dropped."""
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > floor]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0] if u.shape[1] else u


def iterate(times, d: int, trace: float, k: int, oversample: int = 8, most_columns: int = 256, most_passes: int = 500, seed: int = 5) -> Components:
    """The k leading eigenpairs of a matrix known by times(q) alone.

    A pass multiplies the newest block. Rayleigh-Ritz works on all blocks held, so on flat spectra, where the power method gains little a pass, no pass is lost; once more
    than most_columns are held, the best Ritz vectors are kept and the rest is dropped. The next block is what the wanted Ritz pairs still lack, filled up with images
    of the others. It ends when the residuals of all k pairs are small, as held and then once more from a fresh product of the final vectors.
    """
    k, width = min(k, d), min(d, k + oversample)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    basis, image, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    while True:
        fresh = times(block)
        passes += 1
        basis, image = np.hstack([basis, block]), np.hstack([image, fresh])
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        left = ritz_image - ritz * values
        sizes = np.linalg.norm(left[:, :k], axis=0)
        bound = CERTIFIED * max(values[0], 0.0)
        block = _orthonormal(left[:, : width + k], basis, bound * 0.01)[:, :width] if basis.shape[1] < d else np.zeros((d, 0))
        if (sizes <= bound).all() or not block.shape[1]:
            again = times(ritz[:, :k])
            passes += 1
            values = np.einsum("ij,ij->j", ritz[:, :k], again)
            worst = float(np.linalg.norm(again - ritz[:, :k] * values, axis=0).max())
            if worst <= 4 * bound or not block.shape[1]:
                break
        if passes >= most_passes:
            raise ArithmeticError(f"residuals are {sizes.max():.3g} after {passes} passes, wanted {bound:.3g}")
        if basis.shape[1] + width > max(most_columns, 3 * width):
            basis, image = ritz[:, : 2 * width], ritz_image[:, : 2 * width]
            block = _orthonormal(block, basis, 1e-3)
    held = values > EMPTY * trace
    order = np.argsort(-values[held], kind="stable")
    return Components(ritz[:, :k][:, held][:, order], values[held][order], trace, worst, passes)


def components(x: DataFrame, m: Moments, k: int = 8, **how) -> Components:
    """The leading components of the rows' covariance (divisor n). Fewer than k where fewer have variance."""
    d = len(m.sums)
    mean = m.mean
    trace = float(_summed(x, lambda b: np.square(_matrix(b, d) - mean).sum(0)[:, None], d, 1).sum() / m.n) if m.n else 0.0
    if trace <= 0:
        return Components(np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 1)
    return iterate(lambda q: times_covariance(x, m, q), d, trace, k, **how)


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """sum of (n x - S)^2 a row, exact; none where no long holds it."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * m.n + int(np.abs(m.sums).max(initial=0))
    if top * top * max(len(m.sums), 1) < _BIG:
        return np.square(m.n * x - m.sums).sum(1).tolist()
    sums = [int(s) for s in m.sums]
    exact = (sum((m.n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def projected(b: pa.RecordBatch, m: Moments, c: Components) -> np.ndarray:
    return (_matrix(b, len(m.sums)) - m.mean) @ (c.vectors / np.sqrt(c.values))


def identity_error(x: DataFrame, m: Moments, c: Components) -> float:
    """The largest absolute entry of the covariance of all whitened rows minus the identity, by a pass over them."""
    k = len(c.values)

    def part(b: pa.RecordBatch) -> np.ndarray:
        w = projected(b, m, c)
        return np.vstack([w.T @ w, w.sum(0)])

    found = _summed(x, part, k + 1, k) / m.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max(initial=0))


def whiten(embeddings: DataFrame, k: int = 8, vector: str = "embedding", **how) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual, passes): a row for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries give nothing, nor do those of another length (`usable`). Rows that repeat each other all count and all
    come back; a null vec_id is kept. Components without variance are none, so equal rows, one row or no rows give no rows. Of components with equal
    eigenvalues any orthonormal choice may come. Only sums of d x p numbers reach the driver.
    """
    x = usable(embeddings, vector)
    held = cut(x, "fixed-point")
    m = moments(held)
    c = components(held, m, k, **how)
    error = identity_error(held, m, c) if len(c.values) else 0.0
    drop_cut(held)
    found = len(c.values)
    explained = c.values / c.trace if found else c.values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and found:
                r = b.num_rows
                over = lambda v: np.tile(v, r)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(r), found)))
                far = pa.array([v for v in deviations(_matrix(b, len(m.sums)), m) for _ in range(found)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(over(np.arange(1, found + 1, dtype=np.int32))), pa.array(np.full(r * found, m.n)), far, pa.array(projected(b, m, c).ravel()), pa.array(over(explained)), pa.array(np.full(r * found, error)), pa.array(np.full(r * found, c.residual)), pa.array(np.full(r * found, c.passes, np.int32))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual", "passes"],
                )

    kind = x.schema["vec_id"].dataType.simpleString()
    return in_arrow(x, work, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double, passes int")
