"""Resampling inference without moving rows between tasks.

Each replicate weight of a row is a Poisson(1) count read from an md5 of the row key
and replicate number: the distributed form of drawing with replacement. Weighted
sums combine map-side, so the shuffle holds replicates, not rows, whatever the size
of a group. The md5 makes every draw repeatable in any SQL engine.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from math import sin

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import flag
from .quantiles import exact_quantiles

# the functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cumulative Poisson(1) probabilities.
POISSON_CDF = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917, 0.999990)
LANES = 4
# rows of a group that are drawn from as one list
PART = 8_192
# md5s made in one go, a number whose words stay in a core's cache
MD5S = 8_192
# digests of a part that are held at once
DRAWN = 500_000
# rows drawn for at once, and groups whose sums a task holds
ROWS, HELD = 512, 1_000


def uniform(row: Column, block: Column, lane: int) -> Column:
    """Repeatable uniform value in [0, 1) for a row key, a replicate block and one of four lanes."""
    h = F.md5(F.concat_ws(":", row.cast("string"), block.cast("string")))
    return F.conv(F.substring(h, 8 * lane + 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def poisson_weight(u: Column) -> Column:
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON_CDF), F.lit(0))


_MD5_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_MD5_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_MD5_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476


def md5_blocks(words: list[np.ndarray | int]) -> tuple[np.ndarray, ...]:
    """The four words of the md5 of messages of one padded block, given as sixteen words that are arrays or equal for all."""
    shape = np.broadcast_shapes(*[np.shape(w) for w in words])
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _MD5_START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        w = words[g]
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(_MD5_SINES[i])
        else:
            f += np.uint32((w + _MD5_SINES[i]) & 0xFFFFFFFF)
        s = _MD5_SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t)
        f <<= np.uint32(s)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return tuple(x + np.uint32(y) for x, y in zip((a, b, c, d), _MD5_START))


def numbered_digests(heads: Sequence[bytes], first: int, last: int) -> np.ndarray:
    """md5 of every head with each number from ``first`` to before ``last`` behind it, as sixteen bytes each.

    Messages of equal lengths go through numpy together; those longer than a block go one by one.
    """
    out = np.empty((len(heads), last - first, 16), np.uint8)
    lengths = np.array([len(h) for h in heads])
    ends = [str(n).encode() for n in range(first, last)]
    widths = np.array([len(e) for e in ends])
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        for width in np.unique(widths):
            reps = np.flatnonzero(widths == width)
            total = int(size + width)
            if total > 55:
                for i in rows:
                    for r in reps:
                        out[i, r] = np.frombuffer(md5(heads[i] + ends[r]).digest(), np.uint8)
                continue
            head, tail = np.zeros((len(rows), 64), np.uint8), np.zeros((len(reps), 64), np.uint8)
            head[:, :size] = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(len(rows), -1)
            tail[:, size:total] = np.frombuffer(b"".join(ends[r] for r in reps), np.uint8).reshape(len(reps), -1)
            tail[:, total] = 0x80
            tail[:, 56:] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
            x, y = head.view("<u4"), tail.view("<u4")
            step = max(1, MD5S // len(reps))
            for a in range(0, len(rows), step):
                part = x[a : a + step]
                words = [part[:, k, None] | y[None, :, k] if part[:, k].any() else (y[None, :, k] if (y[:, k] != y[0, k]).any() else int(y[0, k])) for k in range(16)]
                got = np.stack(md5_blocks(words), axis=2).astype("<u4")
                out[rows[a : a + step, None], reps[None, :]] = got.view(np.uint8).reshape(len(part), len(reps), 16)
    return out


def _digests(heads: Sequence[str], blocks: int) -> bytes:
    """The md5 of every head with every block number behind it."""
    ends = [str(b).encode() for b in range(blocks)]
    return b"".join(md5(head + end).digest() for head in map(str.encode, heads) for end in ends)


def _weights(heads: Sequence[str], draws: int) -> np.ndarray:
    u = np.frombuffer(_digests(heads, -(-draws // LANES)), ">u4").reshape(len(heads), -1)[:, :draws] / 4294967296.0
    return np.searchsorted(POISSON_CDF, u, side="right").astype(float)


def _signs(heads: Sequence[str], draws: int) -> np.ndarray:
    """One sign a row and replicate: a hexadecimal digit below eight keeps the value."""
    read = np.frombuffer(_digests(heads, -(-draws // 32)), np.uint8).reshape(len(heads), -1, 1)
    return 1.0 - 2.0 * (np.concatenate([read >> 7, read >> 3 & 1], axis=2).reshape(len(heads), -1)[:, :draws])


def row_weights(rows: Sequence[str], draws: int) -> np.ndarray:
    """The Poisson weights of rows in every replicate, a row of weights for each, read from the same md5s inside a task."""
    return _weights([f"{row}:" for row in rows], draws)


def replicate_sums(
    df: DataFrame, groups: Sequence[str], value: str, head: Column, draws: int, weights: Callable[[Sequence[str], int], np.ndarray]
) -> DataFrame:
    """Per group and replicate the sum ``s`` of weighted values and ``n`` of weights.

    A task draws a row's weights once, adds them up by products and lets only sums leave; it holds
    the sums of ``HELD`` groups at most. Rows are spread over all tasks first, as the draws are the work.
    """
    groups = list(groups)
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"), head.alias("_head")).repartition(wide, "_head")

    def flush(total: dict[tuple, np.ndarray], types: Sequence[pa.DataType]) -> pa.RecordBatch:
        keys = [pa.array([k[i] for k in total], t) for i, t in enumerate(types)]
        sums = [pa.array([s[i] for s in total.values()], pa.list_(pa.float64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, *sums], names=[*groups, "_s", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(g).type for g in groups]
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                w, v = weights(part.column("_head").to_pylist(), draws), part.column("_v").to_numpy()
                members: dict[tuple, list[int]] = {}
                columns = [part.column(g).to_pylist() for g in groups]
                for i in range(part.num_rows):
                    members.setdefault(tuple(c[i] for c in columns), []).append(i)
                for key, at in members.items():
                    own = w[at]
                    sums = np.stack([v[at] @ own, own.sum(axis=0)])
                    total[key] = total[key] + sums if key in total else sums
                if len(total) > HELD:
                    yield flush(total, types)
                    total = {}
        if total:
            yield flush(total, types)

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in known.select(*groups).schema) + "_s array<double>, _n array<double>"
    sums = known.mapInArrow(run, shape)
    each = sums.select(*groups, F.posexplode(F.arrays_zip("_s", "_n")).alias("replicate", "_x"))
    return each.groupBy(*groups, "replicate").agg(F.sum("_x._s").alias("s"), F.sum("_x._n").alias("n"))


def replicate_means(df: DataFrame, groups: Sequence[str], value: str, row: str, draws: int) -> DataFrame:
    """Weighted mean of every replicate: groups, replicate, mean."""
    sums = replicate_sums(df, groups, value, F.concat_ws(":", F.col(row).cast("string"), F.lit("")), draws, _weights)
    return sums.select(*groups, F.col("replicate").cast("long").alias("replicate"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"))


def bootstrap_mean(df: DataFrame, groups: Sequence[str], value: str, row: str, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """Mean with a percentile bootstrap interval per group; a group holds ``draws`` replicates, no more."""
    groups = list(groups)
    a = max(0.0, min(1.0, 1.0 - level)) / 2.0
    ci = replicate_means(df, groups, value, row, draws).groupBy(*groups).agg(
        F.percentile("mean", a).alias("ci_low"), F.percentile("mean", 1.0 - a).alias("ci_high")
    )
    est = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.avg(value).alias("estimate"), F.count(value).alias("sample_count")
    )
    out = est.join(ci, groups, "left") if groups else est.crossJoin(ci)
    return out.withColumn("warning", F.when(F.col("sample_count") < 30, "small sample; interval is unstable").otherwise(""))


def bootstrap_win_rate(df: DataFrame, groups: Sequence[str], value: str, row: str, draws: int = 1000, level: float = 0.95) -> DataFrame:
    won = df.withColumn("_win", F.when(F.col(value).isNotNull(), flag(F.col(value) > 0) * 100.0))
    return bootstrap_mean(won, groups, "_win", row, draws, level)


def sign_flip_test(df: DataFrame, groups: Sequence[str], effect: str, row: str, draws: int = 1000) -> DataFrame:
    """Two-sided sign-flip permutation test of a mean effect: p = (exceed + 1) / (draws + 1).

    Each replicate is one signed sum over the rows.
    """
    groups = list(groups)
    head = F.concat_ws(":", F.col(row).cast("string"), F.lit("flip"), F.lit(""))
    reps = replicate_sums(df, groups, effect, head, draws, _signs).select(*groups, F.col("s").alias("_s"))
    seen = df.where(F.col(effect).isNotNull()).groupBy(*groups).agg(
        F.avg(effect).alias("mean_effect"), F.count(effect).alias("sample_count"), F.sum(effect).alias("_obs")
    )
    both = reps.join(seen, groups) if groups else reps.crossJoin(seen)
    return both.groupBy(*groups, "mean_effect", "sample_count").agg(
        ((F.count_if(F.abs("_s") >= F.abs("_obs") - 1e-12) + 1) / F.lit(draws + 1.0)).alias("p_value")
    )


def subsample_baseline(
    df: DataFrame, groups: Sequence[str], value: str, row: str, sample_size: int | None, draws: int = 200
) -> DataFrame:
    """Distribution of mean, median and win rate of samples drawn without replacement.

    Drawing ``k`` of ``n`` takes the k smallest md5 keys.
    """
    groups = list(groups)
    known = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"), F.col(row).cast("string").alias("_row"))
    size = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    size = size.withColumn("_k", F.least(F.col("_n"), F.lit(sample_size)) if sample_size else F.col("_n"))
    sized = known.join(size, groups) if groups else known.crossJoin(size)
    if sample_size and sample_size <= PART:
        each = _drawn_in_parts(sized, groups, draws)
    else:
        each = _drawn_by_slices(sized, groups, draws)
    return each.groupBy(*groups).agg(
        F.max("_k").alias("sample_size"),
        F.max("_n").alias("available_label_count"),
        F.avg("_mean").alias("baseline_mean"),
        F.coalesce(F.stddev_samp("_mean"), F.lit(0.0)).alias("baseline_mean_std"),
        F.avg("_median").alias("baseline_median"),
        F.avg("_win").alias("baseline_win_rate"),
        F.percentile("_mean", 0.05).alias("baseline_q05"),
        F.percentile("_mean", 0.95).alias("baseline_q95"),
    )


def _drawn_in_parts(sized: DataFrame, groups: list[str], draws: int) -> DataFrame:
    """Mean, median and win rate of every draw of at most ``PART`` rows.

    A group is cut into parts of about ``PART`` rows, held as lists. Replicates are drawn
    from a part's list, so rows are shuffled once and not once a replicate; only the k
    smallest keys of a part leave it, and only where a group has several parts.
    """
    parts = F.ceil(F.col("_n") / PART)
    wide = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def drawn(df: DataFrame) -> DataFrame:
        rows = df.select(*groups, "_n", "_k", F.pmod(F.xxhash64("_row"), parts).alias("_part"), "_row", "_v")
        # a count of partitions keeps few bytes from being put into few tasks: the draws are the work
        lists = rows.repartition(wide, *groups, "_part").groupBy(*groups, "_n", "_k", "_part").agg(F.sort_array(F.collect_list(F.struct("_row", "_v"))).alias("_rows"))
        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in lists.select(*groups).schema)
        return lists.select(*groups, "_n", "_k", "_rows._row", "_rows._v").mapInArrow(run, f"{kinds}_n long, _k long, _rep int, _low array<struct<h: binary, row: string, v: double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = len(groups)
            for at in range(batch.num_rows):
                n, k = (batch.column(g + i)[at].as_py() for i in range(2))
                row, v = (batch.column(g + 2 + i)[at].values for i in range(2))
                heads = [f"{r}:sub:".encode() for r in row.to_pylist()]
                take = min(k, len(heads))
                step = max(1, DRAWN // len(heads))
                for first in range(0, draws, step):
                    last = min(draws, first + step)
                    h = numbered_digests(heads, first, last)
                    key = np.ascontiguousarray(h[:, :, :8]).view(">u8")[:, :, 0].astype(np.uint64)
                    # the first eight bytes and one row more tell the order but for equal ones
                    at_most = min(take + 1, len(heads))
                    low = np.argpartition(key, at_most - 1, axis=0)[:at_most]
                    low = np.take_along_axis(low, np.argsort(np.take_along_axis(key, low, 0), axis=0), 0)
                    tied = np.diff(np.take_along_axis(key, low, 0), axis=0) == 0
                    low = np.ascontiguousarray(low[:take].T)
                    for r in np.flatnonzero(tied.any(axis=0)):  # rows are in order, so equal digests keep it
                        low[r] = sorted(range(len(heads)), key=lambda i: h[i, r].tobytes())[:take]
                    flat = pa.array(low.ravel())
                    bytes_of = pa.py_buffer(h[low, np.arange(last - first)[:, None]].tobytes())
                    digests = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, 16 * len(flat) + 1, 16, dtype=np.int32)), bytes_of])
                    items = pa.StructArray.from_arrays([digests, row.take(flat), v.take(flat)], names=["h", "row", "v"])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, take), pa.int32()), items)
                    same = [batch.column(i).take(pa.array(np.full(last - first, at))) for i in range(g + 2)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(first, last), pa.int32()), lists], names=[*groups, "_n", "_k", "_rep", "_low"])

    one = drawn(sized.where(parts == 1)).select(*groups, "_n", "_k", "_rep", F.col("_low.v").alias("_vs"))
    several = drawn(sized.where(parts > 1)).select(*groups, "_n", "_k", "_rep", F.inline("_low"))
    first = F.row_number().over(Window.partitionBy(*groups, "_rep").orderBy("h", "row"))
    merged = several.withColumn("_at", first).where(F.col("_at") <= F.col("_k")).groupBy(*groups, "_n", "_k", "_rep").agg(F.collect_list("v").alias("_vs"))
    vs = one.unionByName(merged).withColumn("_vs", F.sort_array("_vs"))
    total = F.aggregate("_vs", F.lit(0.0), lambda a, x: a + x)
    won = F.size(F.filter("_vs", lambda x: x > 0))
    mid = F.get("_vs", F.floor((F.col("_k") - 1) / 2).cast("int")) + F.get("_vs", F.floor(F.col("_k") / 2).cast("int"))
    return vs.select(*groups, "_n", "_k", "_rep", (total / F.col("_k")).alias("_mean"), (mid / 2.0).alias("_median"), (won * 100.0 / F.col("_k")).alias("_win"))


def _drawn_by_slices(sized: DataFrame, groups: list[str], draws: int) -> DataFrame:
    """The same for draws of any size: rows are exploded to replicates and cut by slices of the key space."""
    reps = sized.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    reps = reps.withColumn("_h", F.md5(F.concat_ws(":", "_row", F.lit("sub"), F.col("_rep").cast("string"))))
    kept = _smallest(reps, [*groups, "_rep"])
    mean = kept.groupBy(*groups, "_rep", "_k", "_n").agg(
        F.avg("_v").alias("_mean"), (F.avg(flag(F.col("_v") > 0)) * 100.0).alias("_win")
    )
    med = exact_quantiles(kept, [*groups, "_rep"], "_v", [0.5], ["_median"])
    return mean.join(med, [*groups, "_rep"])


def _smallest(reps: DataFrame, groups: list[str]) -> DataFrame:
    """Rows holding the ``_k`` smallest ``_h`` of each group.

    Keys are uniform, so counts over 4,096 equal slices of the key space say where the
    cut falls. Whole slices below it are kept as they are; only the slice that crosses
    it is ordered, and rows above it are dropped before anything is shuffled.
    """
    sliced = reps.withColumn("_slice", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_c"), F.max("_k").alias("_take"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    cuts = counts.where(F.col("_below") < F.col("_take")).groupBy(*groups).agg(
        F.max("_slice").alias("_cut"), F.max(F.struct("_slice", (F.col("_take") - F.col("_below")).alias("need"))).alias("_m")
    ).select(*groups, "_cut", F.col("_m.need").alias("_need"))
    near = sliced.join(cuts, groups).where(F.col("_slice") <= F.col("_cut"))
    whole = near.where(F.col("_slice") < F.col("_cut"))
    edge = near.where(F.col("_slice") == F.col("_cut")).withColumn(
        "_at", F.row_number().over(Window.partitionBy(*groups).orderBy("_h", "_row"))
    ).where(F.col("_at") <= F.col("_need")).drop("_at")
    return whole.unionByName(edge).drop("_slice", "_cut", "_need", "_h")


def against_baseline(events: DataFrame, baseline: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Event outcomes next to the resampled baseline of their group."""
    groups = list(groups)
    v = F.col(value)
    base = events.groupBy(*groups).agg(
        F.count(v).alias("event_sample_count"), F.avg(v).alias("event_mean"), (F.avg(F.when(v.isNotNull(), flag(v > 0))) * 100.0).alias("event_win_rate")
    )
    med = exact_quantiles(events, groups, value, [0.5], ["event_median"])
    out = base.join(med, groups, "left").join(baseline, groups, "left")
    m = F.col("event_mean")
    return out.withColumns(
        {
            "mean_minus_baseline": m - F.col("baseline_mean"),
            "position": F.when(m.isNull() | F.col("baseline_q05").isNull(), "unknown")
            .when(m < F.col("baseline_q05"), "below_q05")
            .when(m > F.col("baseline_q95"), "above_q95")
            .otherwise("inside"),
        }
    )
