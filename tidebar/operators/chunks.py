"""Ordered work split into chunks.

A window partitioned by series alone puts a long series into one task. Here a
series is cut into chunks of its dense index. Bounded frames read a halo of
neighbour rows copied into the chunk; running values use a per-chunk summary whose
prefix is joined back. No task ever holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

KEYS = ("symbol", "interval")
CHUNK = 16_384


def rows(w: WindowSpec, lo: int, hi: int) -> WindowSpec:
    return w.rowsBetween(lo, hi)


def over_chunks(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    index: str = "bar_index",
    size: int = CHUNK,
    keep: bool = False,
) -> DataFrame:
    """Run ``build(frame, window)`` with frames reaching ``back`` rows behind and ``ahead`` rows on.

    ``index`` must be dense per key. Every row is computed by the chunk that owns it.
    ``keep`` leaves the ``_chunk`` column in place, so a following ``running`` reuses
    the same partitioning instead of shuffling again.
    """
    i = F.col(index)
    first = F.floor(F.greatest(i - ahead, F.lit(0)) / size)
    last = F.floor((i + back) / size)
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(index)
    out = build(spread, w)
    owned = out.where(F.col("_chunk") == F.floor(F.col(index) / size))
    return owned if keep else owned.drop("_chunk")


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    width: int,
    name: str = "bar_index",
    ties: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Position 0..n-1 within each key by a numeric ``order`` column, counted in bins of ``width``."""
    binned = df.withColumn("_bin", F.floor(F.col(order) / width))
    sizes = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(order, *ties)
    return (
        binned.join(offsets, [*keys, "_bin"])
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_bin", "_off")
    )


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    keys: Sequence[str] = KEYS,
    index: str = "bar_index",
    size: int = CHUNK,
) -> DataFrame:
    """Running values from the series start to the current row.

    ``specs`` maps an output name to (kind, column) with kind ``sum``, ``count``,
    ``max``, ``min`` or ``last`` (last non-null). Chunk summaries are combined by a
    prefix over chunks, then joined back.
    """
    named = df.withColumns({f"_v_{k}": col for k, (_, col) in specs.items()})
    cut = named if "_chunk" in df.columns else named.withColumn("_chunk", F.floor(F.col(index) / size))
    summary = cut.groupBy(*keys, "_chunk").agg(*[_fold(kind, k, index) for k, (kind, _) in specs.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_chunk", *[_scan(kind, F.col(f"_s_{k}"), before).alias(f"_c_{k}") for k, (kind, _) in specs.items()]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carry, [*keys, "_chunk"])
    out = out.withColumns({k: _merge(kind, k, inside) for k, (kind, _) in specs.items()})
    return out.drop("_chunk", *[f"{p}{k}" for k in specs for p in ("_v_", "_c_")])


def _fold(kind: str, k: str, index: str) -> Column:
    v = F.col(f"_v_{k}")
    if kind == "last":
        return F.max_by(v, F.when(v.isNotNull(), F.col(index))).alias(f"_s_{k}")
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](v).alias(f"_s_{k}")


def _scan(kind: str, s: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(s, ignorenulls=True).over(w)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](s).over(w)


def _merge(kind: str, k: str, w: WindowSpec) -> Column:
    v, carry = F.col(f"_v_{k}"), F.col(f"_c_{k}")
    if kind == "sum":
        here = F.sum(v).over(w)
        return F.when(here.isNull() & carry.isNull(), None).otherwise(
            F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
        )
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + F.count(v).over(w)
    if kind == "max":
        return F.greatest(carry, F.max(v).over(w))
    if kind == "min":
        return F.least(carry, F.min(v).over(w))
    return F.coalesce(F.last(v, ignorenulls=True).over(w), carry)
