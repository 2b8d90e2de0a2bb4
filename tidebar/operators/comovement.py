"""Correlations and the first factor over all series, by blocks of series and of times.

Returns are packed into blocks of some series and some times. Each pair of series blocks meets
in one group that walks over the time blocks and adds up, by matrix products, the counts and sums
that pairwise-complete correlations need. What a task holds is two blocks and their sums,
however many series or times there are, and no matrix of all series is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written

# every block meets every other one: up to BLOCKS of them take SERIES series or more each, but never over MOST
SERIES, BLOCKS, MOST, TIMES = 64, 16, 512, 512
# width of the subspace that holds the first factor, and when its direction counts as found
WIDTH, ROUNDS, TOLERANCE = 32, 200, 1e-13


def series_blocks(long: DataFrame, series: str, per: int | None = None) -> DataFrame:
    """(block, names): series dealt by hash into blocks of about ``per``, names in order."""
    names = long.select(series).distinct()
    number = names.count()
    parts = max(1, -(-number // (per or min(MOST, max(SERIES, -(-number // BLOCKS))))))
    return names.groupBy(F.pmod(F.xxhash64(series), F.lit(parts)).cast("int").alias("block")).agg(F.sort_array(F.collect_list(series)).alias("names"))


def _packed(long: DataFrame, blocks: DataFrame, time: str, series: str, value: str, per: int) -> DataFrame:
    """(block, width, part, cells): the cells of some series at some times, as lists of their times, slots and values."""
    slots = blocks.select("block", F.size("names").alias("width"), F.posexplode("names").alias("slot", series))
    # values are taken from the series' mean, which no correlation sees and sums need
    middle = long.groupBy(series).agg(F.avg(value).alias("_mid"))
    parts = max(1, -(-long.agg(F.approx_count_distinct(time)).collect()[0][0] // per))  # one row
    placed = long.select(series, time, value).join(middle.join(slots, series), series)
    cell = F.struct(F.xxhash64(time).alias("t"), "slot", (F.col(value) - F.col("_mid")).alias("v"))
    listed = placed.groupBy("block", "width", F.pmod(F.xxhash64(time), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(cell).alias("cells"))
    # three plain lists take half the bytes of a list of structs
    return listed.select("block", "width", "part", F.struct(F.col("cells.t").alias("t"), F.col("cells.slot").alias("slot"), F.col("cells.v").alias("v")).alias("cells"))


class _Sums:
    """Counts and sums of every pair of two blocks' series."""

    def __init__(self, rows: int, cols: int) -> None:
        self.n, self.x, self.y, self.xx, self.yy, self.xy = (np.zeros((rows, cols)) for _ in range(6))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Two dense blocks over the same times, NaN where a value is missing."""
        am, bm = ~np.isnan(a), ~np.isnan(b)
        a, b = np.where(am, a, 0.0), np.where(bm, b, 0.0)
        am, bm = am.astype(float), bm.astype(float)
        self.n += am @ bm.T
        self.x += a @ bm.T
        self.y += am @ b.T
        self.xx += (a * a) @ bm.T
        self.yy += am @ (b * b).T
        self.xy += a @ b.T

    def correlation(self) -> np.ndarray:
        """NaN where a pair has under two common times or a side doesn't vary over them."""
        vx, vy = self.n * self.xx - self.x**2, self.n * self.yy - self.y**2
        still = (self.n < 2) | (vx <= 1e-12 * self.n * self.xx) | (vy <= 1e-12 * self.n * self.yy)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (self.n * self.xy - self.x * self.y) / np.sqrt(vx * vy)
        return np.where(still, np.nan, np.clip(c, -1.0, 1.0))


def _dense(cells: pa.StructArray, width: int, times: np.ndarray) -> np.ndarray:
    out = np.full((width, len(times)), np.nan)
    out[cells.field("slot").to_numpy(), np.searchsorted(times, cells.field("t").to_numpy())] = cells.field("v").to_numpy()
    return out


CELL = ["t", "slot", "v"]
_PAIR = "lo int, hi int, rows int, cols int, n binary, corr binary"


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (lo, hi, part, side), one row of sums for each pair of blocks."""
    at, sums, held = None, None, None

    def row() -> pa.RecordBatch:
        made = [pa.array([v], t) for v, t in zip((*at, *sums.n.shape, sums.n.astype(np.int32).tobytes(), sums.correlation().tobytes()), (*[pa.int32()] * 4, pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(made, names=["lo", "hi", "rows", "cols", "n", "corr"])

    for batch in batches:
        for i in range(batch.num_rows):
            lo, hi, part, side, rows, cols = (batch.column(k)[i].as_py() for k in range(6))
            cells = pa.StructArray.from_arrays([batch.column(6)[i][c].values for c in CELL], names=CELL)
            if (lo, hi) != at:
                if at is not None:
                    yield row()
                at, sums, held = (lo, hi), _Sums(rows, cols), None
            if lo == hi:
                times = np.unique(cells.field("t").to_numpy())
                dense = _dense(cells, rows, times)
                sums.add(dense, dense)
            elif side == 0:
                held = (part, cells)
            elif held is not None and held[0] == part:
                times = np.intersect1d(held[1].field("t").to_numpy(), cells.field("t").to_numpy())
                one, two = (c.filter(pa.array(np.isin(c.field("t").to_numpy(), times))) for c in (held[1], cells))
                sums.add(_dense(one, rows, times), _dense(two, cols, times))
    if at is not None:
        yield row()


def correlation_blocks(long: DataFrame, time: str, series: str, value: str, per: int | None = None, times: int = TIMES, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """The blocks of series, and the counts and correlations of each pair of blocks (lo <= hi), packed; kept in the shared folder if they are read again."""
    long = long.where(F.col(value).isNotNull() & F.col(time).isNotNull() & F.col(series).isNotNull())
    blocks = written(series_blocks(long, series, per), "series-blocks")
    packed = written(_packed(long, blocks, time, series, value, times), "return-blocks")
    other = blocks.select(F.col("block").alias("with"), F.size("names").alias("with_width"))
    # every block goes to each pair it belongs to; the table of blocks has a row for each block alone
    met = packed.join(F.broadcast(other)).select(
        F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "part", (F.col("block") > F.col("with")).cast("int").alias("side"),
        F.when(F.col("block") <= F.col("with"), F.col("width")).otherwise(F.col("with_width")).alias("rows"),
        F.when(F.col("block") <= F.col("with"), F.col("with_width")).otherwise(F.col("width")).alias("cols"), "cells",
    )
    dealt = met.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "part", "side")
    pairs = dealt.mapInArrow(_pair_sums, _PAIR)
    return blocks, written(pairs, "pair-blocks") if keep else pairs


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            lo, hi, rows, cols, n, corr, first, second = (batch.column(k)[i].as_py() for k in range(8))
            n, corr = np.frombuffer(n, np.int32).reshape(rows, cols), np.frombuffer(corr).reshape(rows, cols)
            a, b = np.triu_indices(rows) if lo == hi else (np.repeat(np.arange(rows), cols), np.tile(np.arange(cols), rows))
            names = np.array(first, object)[a], np.array(second, object)[b]
            swap = names[0] > names[1]
            left, right = np.where(swap, names[1], names[0]), np.where(swap, names[0], names[1])
            c = corr[a, b]
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n[a, b].astype(np.int64)), pa.array(c, mask=np.isnan(c))], names=["a", "b", "n", "corr"])


def pairwise_correlations(long: DataFrame, time: str, series: str, value: str, per: int | None = None, times: int = TIMES) -> DataFrame:
    """(a, b, n, corr) of every pair a <= b of series over the times that both have; null without variance."""
    blocks, pairs = correlation_blocks(long, time, series, value, per, times, keep=False)
    named = pairs.join(blocks.toDF("lo", "first"), "lo").join(blocks.toDF("hi", "second"), "hi")
    return named.select("lo", "hi", "rows", "cols", "n", "corr", "first", "second").mapInArrow(_unpacked, "a string, b string, n long, corr double")


def complete_times(long: DataFrame, time: str, series: str, value: str) -> DataFrame:
    """The rows at times that every series has a value for, without series that are constant over them."""
    given = long.where(F.col(value).isNotNull())
    number = long.select(series).distinct().count()
    full = given.groupBy(time).agg(F.count_distinct(series).alias("_n")).where(F.col("_n") == number).select(time)
    kept = given.join(full, time)
    varied = kept.groupBy(series).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo < _hi").select(series)
    return kept.join(varied, series)


def _times_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, rows, cols, c, x) to (row, y): a block of correlations times a block of vectors."""
    for batch in batches:
        for i in range(batch.num_rows):
            row, rows, cols, c, x = (batch.column(k)[i].as_py() for k in range(5))
            y = np.frombuffer(c).reshape(rows, cols) @ np.frombuffer(x).reshape(cols, -1)
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([y.tobytes()], pa.binary())], names=["block", "y"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "y"])

    for batch in batches:
        for block, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block == at:
                total = total + np.frombuffer(y)
                continue
            if at is not None:
                yield row()
            at, total = block, np.frombuffer(y)
    if at is not None:
        yield row()


def first_component(blocks: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(series, loading, share): the leading eigenvector of the correlations, by subspace iteration.

    A round multiplies the blocks with ``width`` vectors and turns these to the best directions
    they span, from Gram matrices of ``width`` columns alone. It ends when the first direction's
    residual is nothing. With at most ``width`` series the first round is exact.
    """
    spark = blocks.sparkSession
    number = blocks.agg(F.sum(F.size("names"))).collect()[0][0] or 0  # one value
    if number < 2:
        return spark.createDataFrame([], "series string, loading double, share double")
    p = min(width, number)

    def transposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = [np.frombuffer(c).reshape(r, k).T.tobytes() for c, r, k in zip(*(batch.column(i).to_pylist() for i in (4, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(3), batch.column(2), pa.array(turned, pa.binary())], names=["row", "col", "rows", "cols", "c"])

    shape = "row int, col int, rows int, cols int, c binary"
    whole = pairs.select(F.col("lo").alias("row"), F.col("hi").alias("col"), "rows", "cols", F.col("corr").alias("c"))
    whole = written(whole.unionByName(whole.where("row != col").mapInArrow(transposed, shape)), "correlations")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.random.default_rng([7, b]).standard_normal((w, p)).tobytes() for b, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["block", "x"])

    x = written(blocks.select("block", F.size("names").alias("w")).mapInArrow(start, "block int, x binary"), "vectors")
    best = None
    for _ in range(ROUNDS):
        product = whole.join(x.withColumnRenamed("block", "col"), "col").select("row", "rows", "cols", "c", "x").mapInArrow(_times_vectors, "block int, y binary")
        y = product.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, y binary")
        both = written(x.join(y, "block").select("block", "x", "y"), "products")

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, p, p))
            for batch in batches:
                for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    a, b = np.frombuffer(a).reshape(-1, p), np.frombuffer(b).reshape(-1, p)
                    total += np.stack([a.T @ a, a.T @ b, b.T @ b])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

        sums = dict(map(tuple, both.mapInArrow(grams, "i int, v double").groupBy("i").agg(F.sum("v")).collect()))  # 3 * p * p values
        xx, xy, yy = np.array([sums[i] for i in range(3 * p * p)]).reshape(3, p, p)
        low = np.linalg.inv(np.linalg.cholesky((xx + xx.T) / 2))
        values, turn = np.linalg.eigh(low @ ((xy + xy.T) / 2) @ low.T)
        top, lead = float(values[-1]), low.T @ turn[:, ::-1]
        # the next vectors: products in the order of the directions found, made orthonormal
        scale = np.linalg.cholesky(lead.T @ ((yy + yy.T) / 2) @ lead + 1e-300 * np.eye(p)) if values[0] > 1e-9 * top else None
        onward = lead @ np.linalg.inv(scale).T if scale is not None else lead / np.sqrt(np.maximum(np.diag(lead.T @ yy @ lead), 1e-300))

        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(np.frombuffer(a).reshape(-1, p), np.frombuffer(b).reshape(-1, p)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                off = [float(((b @ lead[:, 0] - top * (a @ lead[:, 0])) ** 2).sum()) for a, b in rows]  # noqa: B023
                first = [(a @ lead[:, 0]).tobytes() for a, _ in rows]  # noqa: B023
                nxt = [(b @ onward).tobytes() for _, b in rows]  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nxt, pa.binary()), pa.array(first, pa.binary()), pa.array(off)], names=["block", "x", "v", "off"])

        state = written(both.mapInArrow(turned, "block int, x binary, v binary, off double"), "directions")
        off = state.agg(F.sum("off")).collect()[0][0] ** 0.5  # one value
        if best is None or off < best[0]:
            best, since = (off, state, top), 0
        else:
            since += 1
        if off <= TOLERANCE * top or p == number or since >= 5:
            break
        x = state.select("block", "x")

    def loadings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.frombuffer(v))], names=["series", "loading"])

    found = written(blocks.join(best[1].select("block", "v"), "block").select("names", "v").mapInArrow(loadings, "series string, loading double"), "loadings")
    norm = found.agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("norm"), F.max_by("loading", F.struct(F.abs("loading").alias("a"), "series")).alias("lead"))
    return found.join(F.broadcast(norm)).select("series", (F.col("loading") / F.col("norm") * F.signum("lead")).alias("loading"), F.lit(best[2] / number).alias("share"))  # one row
