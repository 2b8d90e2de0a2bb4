"""Exact quantiles, ranks and positions of groups of any size.

A group may be too large for one task, so values are first placed in ordered bins
whose edges come from a mergeable sketch. The edges only steer the work: counts per
bin give exact offsets and only the bins that hold a wanted rank are sorted. A merged sketch
depends on the order in which its parts arrive, so edges are written once: counts and
sorted bins must mean the same bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .chunks import CHUNK

BINS = 512


def _edges(df: DataFrame, groups: Sequence[str], value: str, bins: int) -> DataFrame:
    # one foldable text literal instead of a thousand numbers keeps the plan small
    probs = ",".join(repr(k / bins) for k in range(1, bins))
    edges = df.groupBy(*groups).agg(
        F.expr(f"array_sort(array_distinct(percentile_approx({value}, cast(split('{probs}', ',') as array<double>), 10000)))").alias("_edges"),
        F.count(value).alias("_total"),
    )
    return written(edges, "edges")


def _with_bin(df: DataFrame, value: str, name: str = "_bin") -> DataFrame:
    """Number of edges below the value, by a binary search of nine compiled steps."""
    df = df.withColumn(name, F.lit(0))
    step = BINS // 2
    while step:
        below = F.coalesce(F.get("_edges", F.col(name) + (step - 1)) < F.col(value), F.lit(False))
        df = df.withColumn(name, F.when(below, F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return df


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on)) if on else left.crossJoin(right)


def _bin_offsets(binned: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    sizes = binned.groupBy(*groups, "_bin").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], bins: int = BINS
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per probability.

    Groups of at most ``CHUNK`` values are sorted as they are, so many small groups cost one
    shuffle of their values; only larger ones are binned.
    """
    groups = list(groups)
    data = df.select(*groups, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if not groups:
        return _binned_quantiles(data, groups, probs, names, bins)
    sizes = written(data.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    small, large = sizes.agg(F.count_if(F.col("_size") <= CHUNK), F.count_if(F.col("_size") > CHUNK)).first()
    if not large:
        return _sorted_quantiles(data, groups, probs, names)
    if not small:
        return _binned_quantiles(data, groups, probs, names, bins)
    # a group may be null, so sides are told apart by a flag and not by an anti join
    same = [F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    marked = data.alias("d").join(sizes.alias("s"), reduce(lambda a, b: a & b, same)).select(*[F.col(f"d.{g}").alias(g) for g in groups], "_x", "_size")
    few = _sorted_quantiles(marked.where(F.col("_size") <= CHUNK), groups, probs, names)
    return few.unionByName(_binned_quantiles(marked.where(F.col("_size") > CHUNK).drop("_size"), groups, probs, names, bins))


def _sorted_quantiles(data: DataFrame, groups: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    lists = data.groupBy(*groups).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))

    def at(p: float) -> Column:
        pos = F.lit(float(p)) * (F.size("_xs") - 1)
        a, b = F.get("_xs", F.floor(pos).cast("int")), F.get("_xs", F.ceil(pos).cast("int"))
        return a + (b - a) * (pos - F.floor(pos))

    return lists.select(*groups, *[at(p).alias(n) for p, n in zip(probs, names, strict=True)])


def _binned_quantiles(data: DataFrame, groups: list[str], probs: Sequence[float], names: Sequence[str], bins: int) -> DataFrame:
    edges = _edges(data, groups, "_x", bins)
    binned = _with_bin(_joined(data, edges, groups), "_x").drop("_edges")
    offsets = _bin_offsets(binned.select(*groups, "_bin"), groups, F.lit(1))
    total = Window.partitionBy(*groups)
    wanted = F.array(
        *[
            F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("pos"))
            for k, p in enumerate(probs)
        ]
    )
    needed = (
        offsets.withColumn("_all", F.sum("_n").over(total))
        .withColumn(
            "_want",
            F.filter(
                wanted,
                lambda t: (F.ceil(t["pos"]) >= F.col("_off")) & (F.floor(t["pos"]) < F.col("_off") + F.col("_n")),
            ),
        )
        .where(F.size("_want") > 0)
        .select(*groups, "_bin", "_off", "_want")
    )
    ties = (
        binned.join(needed, [*groups, "_bin"])
        .groupBy(*groups, "_bin", "_x")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_off").alias("_off"), F.first("_want").alias("_want"))
    )
    inside = Window.partitionBy(*groups, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ties.withColumn("_end", F.col("_off") + F.sum("_c").over(inside))
    hit = placed.select(*groups, "_x", (F.col("_end") - F.col("_c")).alias("_start"), "_end", F.explode("_want").alias("_w"))
    lo, hi = F.floor("_w.pos"), F.ceil("_w.pos")

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_start")) & (rank < F.col("_end"))

    picked = hit.where(holds(lo) | holds(hi))
    outs = []
    for k, name in enumerate(names):
        mine = F.col("_w.k") == k
        a = F.max(F.when(mine & holds(lo), F.col("_x")))
        b = F.max(F.when(mine & holds(hi), F.col("_x")))
        part = F.max(F.when(mine, F.col("_w.pos") - lo))
        outs.append((a + (b - a) * part).alias(name))
    return picked.groupBy(*groups).agg(*outs)


def value_positions(
    df: DataFrame, groups: Sequence[str], value: str, bins: int = BINS, weight: str | None = None,
    edge_groups: Sequence[str] | None = None,
) -> DataFrame:
    """Per distinct value: ``n_below`` rows before it, ``n_equal`` rows, ``n_total`` rows of its group.

    With ``weight`` a row counts that many times. ``edge_groups`` may name fewer
    columns for the bin edges when many groups share one value range.
    """
    groups = list(groups)
    count = F.sum(weight) if weight else F.count(F.lit(1))
    ties = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(count.alias("n_equal"))
    shared = list(edge_groups) if edge_groups is not None else groups
    edges = _edges(ties, shared, value, bins)
    binned = _with_bin(_joined(ties, edges.drop("_total"), shared), value).drop("_edges")
    offsets = _bin_offsets(binned, groups, F.col("n_equal")).withColumn(
        "n_total", F.sum("_n").over(Window.partitionBy(*groups))
    )
    inside = Window.partitionBy(*groups, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        binned.join(offsets.drop("_n"), [*groups, "_bin"])
        .withColumn("n_below", F.col("_off") + F.sum("n_equal").over(inside) - F.col("n_equal"))
        .select(*groups, value, "n_below", "n_equal", "n_total")
    )


def with_average_rank(df: DataFrame, groups: Sequence[str], value: str, name: str, bins: int = BINS) -> DataFrame:
    """Rank with ties sharing their mean rank (1-based)."""
    pos = value_positions(df, groups, value, bins).select(
        *groups, value, (F.col("n_below") + (F.col("n_equal") + 1) / 2.0).alias(name)
    )
    return df.join(pos, [*groups, value], "left")


def with_first_rank(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    tie: str,
    name: str = "rank_no",
    total: str = "rank_total",
    bins: int = BINS,
    size: int = CHUNK,
) -> DataFrame:
    """Unique rank 1..n by (value, tie), the tie being a unique integer.

    A value heavy enough to matter is an edge itself; its rows close their bin and
    are cut further by the tie, so a constant feature still spreads over tasks.
    """
    groups = list(groups)
    data = df.where(F.col(value).isNotNull())
    edges = _edges(data, groups, value, bins).drop("_total")
    binned = _with_bin(_joined(data, edges, groups), value, "_k")
    heavy = F.coalesce(F.try_element_at("_edges", F.col("_k") + 1) == F.col(value), F.lit(False))
    binned = binned.withColumn("_s", F.when(heavy, F.floor(F.col(tie) / size) + 1).otherwise(-1)).withColumn(
        "_bin", F.struct("_k", "_s")
    ).drop("_edges", "_k", "_s")
    offsets = _bin_offsets(binned.select(*groups, "_bin"), groups, F.lit(1)).withColumn(
        total, F.sum("_n").over(Window.partitionBy(*groups))
    )
    inside = Window.partitionBy(*groups, "_bin").orderBy(value, tie)
    return (
        binned.join(offsets.drop("_n"), [*groups, "_bin"])
        .withColumn(name, F.col("_off") + F.row_number().over(inside))
        .drop("_bin", "_off")
    )
