"""Factor information coefficients and their stability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.moments import safe_corr
from ..functions.scalar import erfc, flag, md5_mod, null
from ..session import written
from .chunks import CHUNK, dense_index
from .quantiles import BINS, _edges, _with_bin, with_average_rank


def rank_ic(long: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Count, Pearson and average-rank Spearman correlation per group."""
    groups = list(groups)
    both = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, x, y)
    ranked = with_average_rank(with_average_rank(both, groups, x, "_rx"), groups, y, "_ry")
    return ranked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("sample_count"),
        safe_corr(x, y).alias("pearson_ic"),
        safe_corr("_rx", "_ry").alias("spearman_rank_ic"),
    )


def correlation_p(r: Column, n: Column) -> Column:
    t = F.abs(r) * F.sqrt((n - 2) / F.greatest(F.lit(1e-12), 1.0 - r * r))
    return F.when((n < 3) | r.isNull(), null()).when(F.abs(r) >= 1.0, 0.0).otherwise(erfc(t / F.sqrt(F.lit(2.0))))


def factor_ic(long: DataFrame, factor: str, x: str, y: str, block: str, min_blocks: int = 3) -> DataFrame:
    """Overall and per-block information coefficients of all factors in one job."""
    whole = rank_ic(long, [factor], x, y)
    by = rank_ic(long, [factor, block], x, y).where(F.col("spearman_rank_ic").isNotNull())
    m = F.col("spearman_rank_ic")
    blocks = by.groupBy(factor).agg(
        F.avg(m).alias("ic_mean_by_block"), F.stddev_pop(m).alias("ic_std_by_block"), F.avg(flag(m > 0)).alias("ic_positive_ratio"),
        F.count(m).alias("time_block_count"),
    )
    return whole.withColumn("p_value", correlation_p(F.col("spearman_rank_ic"), F.col("sample_count"))).join(
        blocks, factor, "left"
    ).withColumns(
        {
            "stability_score": F.abs("ic_mean_by_block") / (F.col("ic_std_by_block") + 1e-12),
            "min_block_count_warning": F.when(F.coalesce("time_block_count", F.lit(0)) < min_blocks, 1).otherwise(0),
        }
    )


# rows of one value that are weighed at once, and rows that a bin holds about, where there are enough
PART = 16_384
BIN_ROWS = 4_096
# rows times replicates that a task works on at once
CELLS = 400_000


def _side_bins(rows: DataFrame, factor: str, v: str, name: str) -> DataFrame:
    """Bin of a value in its factor: odd on an edge, a single value of any number of rows, even between two edges."""
    edges = _edges(rows, [factor], v, BINS).withColumn("_step", F.greatest(F.lit(1), F.ceil(F.lit(BIN_ROWS * BINS) / F.col("_total"))).cast("int"))
    thin = edges.select(factor, F.filter("_edges", lambda _, i: i % F.col("_step") == F.least(F.col("_step"), F.size("_edges")) - 1).alias("_edges"))
    binned = _with_bin(rows.join(F.broadcast(thin), factor), v, "_k")  # a row for each factor
    on = F.coalesce(F.get("_edges", F.col("_k")) == F.col(v), F.lit(False))
    return binned.withColumn(name, 2 * F.col("_k") + on.cast("int")).drop("_edges", "_k")


def _weights(at: np.ndarray, starts: np.ndarray, block: int, n: int) -> np.ndarray:
    """Times that each position is drawn, a row for each replicate: the blocks that have begun less those that have ended."""
    draws, count = starts.shape
    ends = starts + block
    ends[:, -1] = starts[:, -1] + n - (count - 1) * block
    order = np.argsort(at)
    lane = np.arange(draws)[:, None] * (len(at) + 1)
    begun, ended = ((lane + np.searchsorted(at[order], edge)).ravel() for edge in (starts, ends))
    size = draws * (len(at) + 1)
    steps = np.bincount(begun, minlength=size) - np.bincount(ended, minlength=size)
    out = np.empty((draws, len(at)), np.int64)
    out[:, order] = np.cumsum(steps.reshape(draws, -1), axis=1)[:, :-1]
    return out


def _twice_ranks(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Twice the rows below a value and once those equal to it, of rows counted ``w`` times, for each replicate."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    upto = np.concatenate([np.zeros((len(w), 1), np.int64), np.cumsum(w[:, order], axis=1)], axis=1)
    both = upto[:, np.searchsorted(v, v)] + upto[:, np.searchsorted(v, v, "right")]
    out = np.empty_like(w)
    out[:, order] = both
    return out


def _whole(most: int) -> type:
    return np.int32 if most < 1 << 31 else np.int64


def _starts(shape: DataFrame, factor: str, draws: int) -> dict[str, tuple[int, int, np.ndarray]]:
    """Rows, block length and blocks' starts of each factor, a list for each replicate that is as long as the root of the rows."""
    lists = shape.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(
        F.col(factor).alias("_f"), "_rep", "_n", "_b",
        F.transform(
            F.sequence(F.lit(0), (F.ceil(F.col("_n") / F.col("_b")) - 1).cast("int")),
            lambda j: md5_mod(F.concat_ws(":", F.col(factor), F.col("_rep").cast("string"), j.cast("string")), F.col("_n") - F.col("_b") + 1),
        ).alias("_s"),
    )
    got = lists.orderBy("_f", "_rep").toArrow()
    out = {}
    for at in range(0, got.num_rows, draws):
        own = got.slice(at, draws)
        flat = own["_s"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out[own["_f"][0].as_py()] = (int(own["_n"][0].as_py()), int(own["_b"][0].as_py()), flat.astype(_whole(flat.max())).reshape(draws, -1))
    return out


def block_bootstrap_ic(
    long: DataFrame, factor: str, x: str, y: str, order: str, horizon: int = 1, draws: int = 200, size: int = CHUNK
) -> DataFrame:
    """Percentile interval of the rank IC from contiguous blocks, re-ranked in every replicate.

    Rows are grouped by bins of ``y`` and then of ``x``; a task works out the multiplicities of its rows from the
    blocks' starts and ranks one bin for all replicates. Only a row's ranks inside its bin of ``y`` are shuffled, as
    small integers; the weights of whole bins, a bounded number, place the bins.
    """
    spark = long.sparkSession
    known = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(factor, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), order)
    pos = dense_index(known, [factor], order, size, name="_pos", total="_n").select(factor, "_x", "_y", "_pos", "_n").where("_n >= 3")
    rows = written(_side_bins(_side_bins(pos, factor, "_x", "_kx"), factor, "_y", "_ky").withColumnRenamed(factor, "_f"), "bootstrap")
    block = F.greatest(F.ceil(F.sqrt("_n")), F.lit(max(1, horizon)))
    shape = rows.groupBy(F.col("_f").alias(factor)).agg(F.max("_n").alias("_n")).withColumn("_b", F.least(block, F.col("_n")))
    starts = spark.sparkContext.broadcast(_starts(shape, factor, draws))
    kind = rows.schema["_f"].dataType.simpleString()

    def weighed(pdf: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
        """Some replicates at a time and the weights of the rows in them."""
        n, b, s = starts.value[pdf["_f"].iat[0]]
        some = max(1, CELLS // max(1, len(pdf)))
        for first in range(0, draws, some):
            yield slice(first, first + some), _weights(pdf["_pos"].to_numpy(), s[first : first + some], b, n)

    def part(k: str) -> Column:
        # a bin of one value is cut by position; the others hold a bounded share of the rows
        return F.when(F.col(k) % 2 == 1, F.floor(F.col("_pos") / PART)).otherwise(0).alias("_part")

    def bin_sums(k: str) -> dict:
        """Bins of each factor in order, and twice the rows below each and below all in each replicate."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"_f": [pdf["_f"].iat[0]], "_k": [pdf["_k"].iat[0]], "_w": [np.concatenate([w.sum(axis=1) for _, w in weighed(pdf)]).tobytes()]})

        sums: dict = {}
        for r in rows.select("_f", F.col(k).alias("_k"), "_pos", part(k)).groupBy("_f", "_k", "_part").applyInPandas(run, f"_f {kind}, _k int, _w binary").toLocalIterator():
            own = sums.setdefault(r["_f"], {})
            own[r["_k"]] = own.get(r["_k"], 0) + np.frombuffer(r["_w"], np.int64)
        out = {}
        for f, own in sums.items():
            keys = sorted(own)
            below = 2 * np.cumsum([np.zeros(draws, np.int64), *[own[i] for i in keys]], axis=0)
            out[f] = (np.array(keys), below.astype(_whole(below.max())))
        return out

    bins = spark.sparkContext.broadcast({"_kx": bin_sums("_kx"), "_ky": bin_sums("_ky")})

    def inner_ranks(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["_y"].to_numpy()
        r = np.empty((len(pdf), draws), np.uint32)
        for at, w in weighed(pdf):
            r[:, at] = _twice_ranks(y, w).T
        if r.max(initial=0) < 1 << 16:
            r = r.astype(np.uint16)
        return pdf[["_f", "_pos", "_x", "_kx", "_ky"]].assign(_r=[row.tobytes() for row in r])

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        f, k = pdf["_f"].iat[0], pdf["_kx"].iat[0]
        n, x = starts.value[f][0], pdf["_x"].to_numpy()
        keys, below_x = bins.value["_kx"][f]
        at_x = np.searchsorted(keys, k)
        keys, below_y = bins.value["_ky"][f]
        at_y = np.searchsorted(keys, pdf["_ky"].to_numpy())
        single = pdf["_ky"].to_numpy() % 2 == 1
        long_as = pdf["_r"].map(lambda r: 0 if r is None else len(r)).to_numpy()
        inner = []
        for kept in (np.uint16, np.uint32):
            here = long_as == draws * np.dtype(kept).itemsize
            if here.any():
                inner.append((here, np.frombuffer(b"".join(pdf["_r"][here]), kept).reshape(-1, draws)))
        sums = np.empty((3, draws))
        for at, w in weighed(pdf):
            low, high = (below_x[i, at].astype(np.int64)[:, None] for i in (at_x, at_x + 1))
            # twice the ranks less their mean, which is the same for every replicate, as each has n rows
            a = (low - n + ((high - low) // 2 if k % 2 else _twice_ranks(x, w))).astype(float)
            b = below_y[at_y, at].astype(np.int64) - n
            b[single] += (below_y[at_y[single] + 1, at] - below_y[at_y[single], at]) // 2
            for here, ranks in inner:
                b[here] += ranks[:, at]
            b, w = b.T.astype(float), w.astype(float)
            wa = w * a
            sums[:, at] = (wa * b).sum(axis=1), (wa * a).sum(axis=1), (w * b * b).sum(axis=1)
        return pd.DataFrame({"_f": f, "_rep": np.arange(draws), "ab": sums[0], "aa": sums[1], "bb": sums[2]})

    cols = f"_f {kind}, _pos long, _x double, _kx int, _ky int, _r binary"
    ranked = rows.where("_ky % 2 = 0").groupBy("_f", "_ky").applyInPandas(inner_ranks, cols)
    tied = rows.where("_ky % 2 = 1").select("_f", "_pos", "_x", "_kx", "_ky", F.lit(None).cast("binary").alias("_r"))
    sums = ranked.unionByName(tied).groupBy("_f", "_kx", part("_kx")).applyInPandas(products, f"_f {kind}, _rep int, ab double, aa double, bb double")
    s = sums.groupBy(F.col("_f").alias(factor), "_rep").agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")])
    ic = s.withColumn("_ic", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))))
    return ic.groupBy(factor).agg(
        F.percentile("_ic", 0.025).alias("ic_bootstrap_ci_low"), F.percentile("_ic", 0.975).alias("ic_bootstrap_ci_high"),
        F.count("_ic").alias("bootstrap_sample_count"),
    ).join(shape.select(factor, F.col("_b").alias("block_size")), factor)
