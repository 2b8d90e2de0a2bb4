"""As-of joins: the latest row at or before an anchor time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    width: int,
    tie: str | None = None,
) -> DataFrame:
    """Attach to each left row the last right row with ``right_time <= left_time``.

    Both sides are laid on one time line cut into slots of ``width``; the last right
    row before a slot is carried in by a prefix over slots. No range join, no pairs,
    and a hot key is spread over its slots.
    """
    keys = list(keys)
    kept = list(left.columns)
    pay = F.struct(*[F.col(p).alias(p) for p in payload])
    lhs = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"),
        F.struct(*[F.col(c) for c in kept]).alias("_l"),
    )
    rhs = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
        (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"), pay.alias("_r"),
    ).where(F.col("_t").isNotNull())
    line = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("_slot", F.floor(F.col("_t") / width))
    ends = line.groupBy(*keys, "_slot").agg(
        F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_slot", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_slot").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    )
    found = line.join(carry, [*keys, "_slot"]).withColumn(
        "_hit", F.coalesce(F.last("_r", ignorenulls=True).over(inside), F.col("_carry"))
    )
    return found.where(F.col("_side") == 1).select(
        *[F.col(f"_l.{c}").alias(c) for c in kept], *[F.col(f"_hit.{p}").alias(p) for p in payload]
    )


def containing_or_completed(anchors: DataFrame, htf: DataFrame, keys: Sequence[str], time: str, width: int) -> DataFrame:
    """Position match: the higher bar open at the anchor, else the last one closed before it."""
    found = asof_join(
        anchors, htf.withColumnsRenamed({"bar_index": "_hi", "open_time_ms": "_ho", "close_time_ms": "_hc"}),
        keys, time, "_ho", ["_hi", "_ho", "_hc"], width,
    )
    inside = F.col("_hi").isNotNull() & (F.col(time) <= F.col("_hc"))
    return found.withColumns(
        {
            "sync_status": F.when(F.col("_hi").isNull(), "unavailable_before_cursor")
            .when(inside, "contains_cursor")
            .otherwise("latest_completed"),
            "htf_bar_index": F.col("_hi"),
        }
    ).drop("_hi", "_ho", "_hc")


def completed_only(
    anchors: DataFrame, states: DataFrame, keys: Sequence[str], time: str, payload: Sequence[str], width: int
) -> DataFrame:
    """Feature match: only bars already closed at the anchor are visible.

    ``close_time_ms`` is the last millisecond of a bar, so the bar is complete one later.
    """
    ready = states.withColumn("_ready", F.col("close_time_ms") + 1)
    return asof_join(anchors, ready, keys, time, "_ready", payload, width)
