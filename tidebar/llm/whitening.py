"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Entries are put on an integer grid (``scale`` steps a unit, then ``shift``), so that sums and
deviations are exact. The fit list holds each distinct grid vector once: copies are folded by
an aggregation with map-side combining. Tasks add up its sums and then, centred first, its
scatter; only these d and d * d numbers come to the driver, d being the dimension. There
the scatter V is factored as L L' with complete pivoting, and columns of L are rotated in pairs
until all are orthogonal: L J = U S, so squared column norms are the eigenvalues of V and
the normalised columns its eigenvectors, without V being multiplied again. Rows are projected
in the tasks, without a shuffle.

Edge cases: a null vector, one with a null, NaN or infinite entry, and one with an entry outside
the grid of a long gives no row. Vectors are of one length; where lengths differ, the commonest
counts (of equally common ones the longest), and vectors of other lengths give no row. Repeated
rows each give rows, but are fitted once; null ids are kept. Directions without variance have
no whitened value, so there are at most rank(V) components: none for an empty table, a single
distinct vector or empty vectors. Equal eigenvalues keep the order in which they were found.
A deviation beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.common import saved

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# grid values of at most this size, so that shifts and differences stay in a long
LARGEST = 1 << 61
SWEEPS = 60
BLOCK = 8192


def grid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): the rows that have a place on the grid, x as an array of longs of one length."""
    v = F.col(vector_col)
    held = df.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(LARGEST))))
    sizes = held.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()  # one row
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + shift)
    return held.where(F.size(v) == (sizes[0].d if sizes else -1)).select(F.col(id_col).alias("id"), x.cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array, at: int, to: int) -> np.ndarray:
    part = column.slice(at, to - at)
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _blocks(batches: Iterator[pa.RecordBatch], place: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(batch.column(place), at, at + part.num_rows)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task per dimension: of the upper parts and of the lower 32 bits."""
    n, high, low = 0, 0, 0
    for _, x in _blocks(batches):
        n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])


@dataclass(frozen=True)
class Centre:
    """The mean of a list as a nearby integer vector and the rest, and its exact sums."""

    n: int
    sums: tuple[int, ...]

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, np.int64), np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, near, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        near, rest = self.parts
        return (x - near).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list:
        """Sum over dimensions of (n * x - sum)^2, exactly; null beyond a long."""
        near, _ = self.parts
        diff = x - near
        left = [s - self.n * int(m) for s, m in zip(self.sums, near, strict=True)]
        bound = self.n * (int(np.abs(diff).max(initial=0)) + 1)
        if x.shape[1] * bound * bound < 1 << 62:
            return ((self.n * diff - np.array(left, np.int64)) ** 2).sum(1).tolist()
        exact = (sum((self.n * int(a) - b) ** 2 for a, b in zip(row, left, strict=True)) for row in diff)
        return [e if e < 1 << 63 else None for e in exact]


def centre(fit: DataFrame) -> Centre | None:
    """Exact sums of the fit list's column ``x``; None without rows."""
    shaped = fit.select("x").mapInArrow(_sums, "i int, n long, high long, low long")
    wide = F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
    rows = sorted(shaped.groupBy("i").agg(F.sum("n").alias("n"), *wide).collect())  # one row a dimension
    return Centre(rows[0].n, tuple((int(r.high) << 32) + int(r.low) for r in rows)) if rows else None


def _scatter(fit: DataFrame, values, d: int, n: int) -> np.ndarray:
    """Covariance with divisor n of ``values(x)``, which must be centred; one d * d matrix a task is added up by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, x in _blocks(batches):
            y = values(x)
            total += y.T @ y
        i, j = np.tril_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((d, d))
    for r in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():  # d * (d + 1) / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a, columns in the order of pivots, one for each direction that has variance."""
    d = len(a)
    rest = np.diag(a).copy()
    floor = d * np.finfo(float).eps * rest.max(initial=0.0)
    cols: list[np.ndarray] = []
    for _ in range(d):
        p = int(np.argmax(rest))
        if not rest[p] > floor:
            break
        col = a[:, p].copy()
        for c in cols:
            col -= c * c[p]
        # rows that were pivots before are zero but for rounding
        col[rest == -np.inf] = 0.0
        col /= np.sqrt(rest[p])
        col[p] = np.sqrt(rest[p])
        rest = np.where(rest == -np.inf, -np.inf, rest - col * col)
        rest[p] = -np.inf
        cols.append(col)
    return np.stack(cols, 1) if cols else np.zeros((d, 0))


def _rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of r columns once, in rounds of disjoint pairs."""
    ring = list(range(r + r % 2))
    for _ in range(max(0, len(ring) - 1)):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring), strict=False) if max(a, b) < r]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of factor @ factor.T."""
    w = factor.copy()
    d, r = w.shape
    small = max(d, 1) * np.finfo(float).eps
    rounds = list(_rounds(r))
    for _ in range(SWEEPS):
        largest = 0.0
        for a, b in rounds:
            p, q = w[:, a], w[:, b]
            pp, qq, pq = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            cosine = np.abs(pq) / np.sqrt(pp * qq)
            largest = max(largest, cosine.max(initial=0.0))
            turn = cosine > small
            if not turn.any():
                continue
            tau = (qq - pp) / np.where(turn, 2 * pq, 1.0)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, t * c, 0.0)
            w[:, a], w[:, b] = c * p - s * q, s * p + c * q
        if largest <= small:
            break
    values = (w * w).sum(0)
    order = np.argsort(-values, kind="stable")
    vectors = w[:, order] / np.sqrt(values[order])
    # the sign is fixed by the largest entry
    lead = vectors[np.abs(vectors).argmax(0), np.arange(r)] if r else np.zeros(0)
    return values[order], vectors * np.where(lead < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """A fitted map: the centre, the components as columns, their eigenvalues, and V's trace."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def fit(placed: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``placed`` (as ``grid`` gives them); None where nothing varies."""
    listed = saved(placed.select("x").distinct())
    mid = centre(listed)
    if mid is None or not mid.sums:
        return None
    v = _scatter(listed, mid.centred, len(mid.sums), mid.n)
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    k = min(components, len(values))
    if not k:
        return None
    model = Whitening(mid, vectors[:, :k], values[:k], float(np.trace(v)), 0.0)

    # means of the whitened fit list, so that its covariance is centred first too
    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for _, x in _blocks(batches):
            total += model.whiten(x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = dict(map(tuple, listed.mapInArrow(means, "i int, v double").groupBy("i").agg(F.sum("v")).collect()))  # k rows
    mean = np.array([sums[i] for i in range(k)]) / mid.n
    error = np.abs(_scatter(listed, lambda x: model.whiten(x) - mean, k, mid.n) - np.eye(k)).max()
    return Whitening(mid, model.components, model.eigenvalues, model.trace, float(error))


def apply(placed: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, number 1 first."""
    kind = placed.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        k = len(model.eigenvalues)
        for part, x in _blocks(batches, 1):
            own = np.repeat(np.arange(len(x)), k)
            columns = [
                part.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(own), model.centre.n)),
                pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(own)), pa.array(model.whiten(x).ravel()),
                pa.array(np.tile(model.eigenvalues / model.trace, len(x))), pa.array(np.full(len(own), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return placed.mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the table's distinct vectors and whiten every row."""
    placed = grid(df, id_col, vector_col)
    return apply(placed, fit(placed, components), id_col)
