"""Intervals on the bar axis: overlap tests and greedy non-overlapping choice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import written
from .asof import asof_join
from .chunks import CHUNK


def overlap_flag(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, name: str = "overlaps", width: int = CHUNK
) -> DataFrame:
    """Whether a closed left interval meets any closed right interval of its key.

    It does exactly when the furthest right end among right intervals starting no
    later than the left end reaches the left start. That is a running maximum on one
    line of positions, so no interval pairs are formed.
    """
    keys = list(keys)
    kept = list(left.columns)
    lhs = left.select(*keys, F.col(end).alias("_p"), F.lit(1).alias("_side"), F.struct(*kept).alias("_l"))
    rhs = right.select(*keys, F.col(start).alias("_p"), F.lit(0).alias("_side"), F.col(end).alias("_reach"))
    line = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("_slot", F.floor(F.col("_p") / width))
    top = line.groupBy(*keys, "_slot").agg(F.max("_reach").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = top.select(*keys, "_slot", F.max("_top").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("_p", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = line.join(carry, [*keys, "_slot"]).withColumn("_far", F.greatest(F.max("_reach").over(inside), "_carry"))
    return found.where(F.col("_side") == 1).select(
        *[F.col(f"_l.{c}").alias(c) for c in kept],
        F.coalesce(F.col("_far") >= F.col(f"_l.{start}"), F.lit(False)).alias(name),
    )


def _leave(starts: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Where the chain from each start first steps outside ``starts``, by doubling; NaN where it ends inside."""
    exits = nxt.astype(float)
    to = np.searchsorted(starts, np.where(np.isnan(exits), np.inf, exits))
    to = np.where((to < len(starts)) & (starts[np.minimum(to, len(starts) - 1)] == exits), to, -1)
    while (to >= 0).any():
        on = np.flatnonzero(to >= 0)
        exits[on], to[on] = exits[to[on]], to[to[on]]
    return exits


def _chain(starts: np.ndarray, nxt: np.ndarray, first: float) -> np.ndarray:
    """The starts on the chain from ``first``, by doubling the part that is known."""
    to = np.searchsorted(starts, np.where(np.isnan(nxt), np.inf, nxt))
    to = np.where((to < len(starts)) & (starts[np.minimum(to, len(starts) - 1)] == nxt), to, len(starts))
    to = np.append(to, len(starts))
    known = np.array([np.searchsorted(starts, first)])
    while True:
        more = to[known]
        more = more[more < len(starts)]
        if not len(more):
            return np.sort(known)
        known, to = np.concatenate([known, more]), to[to]


def greedy_non_overlapping(df: DataFrame, keys: Sequence[str], start: str, end: str, order: str, size: int = CHUNK) -> DataFrame:
    """Keep an interval when it starts after the last kept end, in (start, order) sequence; ends don't lie before starts.

    Of intervals with one start only the first can be kept. Each start has one successor, the
    first start after its end, found by an as-of join; kept are those on the chain from the key's
    first start. Chunks of starts replace it by where it leaves the chunk, then pointers are
    doubled over the few starts at which chunks are entered, and every chunk that the chain enters
    marks its own part. Intervals may be of any length, and rounds are the logarithm of the number of chunks.
    """
    keys = list(keys)
    pos, reach = F.col(start).cast("long"), F.greatest(F.col(end), F.col(start)).cast("long")
    nodes = df.groupBy(*keys, pos.alias("_s")).agg(F.min(F.struct(F.col(order).alias("o"), reach.alias("e"))).alias("_f"))
    nodes = written(nodes.select(*keys, "_s", F.col("_f.o").alias("_o"), F.col("_f.e").alias("_e")), "interval-starts")
    # the first start after an end is the last one at or before it on the reversed line
    ahead = asof_join(
        nodes.select(*keys, "_s", (-F.col("_e") - 1).alias("_t")), nodes.select(*keys, (-F.col("_s")).alias("_rt"), F.col("_s").alias("_next")), keys, "_t", "_rt", ["_next"], size
    )
    linked = written(ahead.select(*keys, F.floor(F.col("_s") / size).alias("_chunk"), "_s", "_next"), "interval-links")
    shape = [df.schema[k] for k in keys]

    def leave(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        made = _leave(pdf["_s"].to_numpy(float), pdf["_next"].to_numpy(float))
        return pdf[[*keys, "_s"]].assign(_to=pd.arrays.IntegerArray(np.nan_to_num(made).astype(np.int64), np.isnan(made)))

    def mark(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        first = pdf.loc[pdf["_entered"], "_s"]
        return pdf.iloc[_chain(pdf["_s"].to_numpy(float), pdf["_next"].to_numpy(float), first.iloc[0])][[*keys, "_s"]] if len(first) else pdf.iloc[:0][[*keys, "_s"]]

    long = T.LongType()
    exits = linked.groupBy(*keys, "_chunk").applyInPandas(leave, T.StructType([*shape, T.StructField("_s", long), T.StructField("_to", long)]))
    exits = written(exits, "interval-exits")
    heads = linked.groupBy(*keys).agg(F.min("_s").alias("_s"))
    doors = heads.unionByName(exits.where("_to is not null").select(*keys, F.col("_to").alias("_s"))).distinct()
    jump = written(exits.join(doors, [*keys, "_s"]), "interval-jumps")
    entered = written(heads, "interval-doors")
    while jump.where("_to is not null").limit(1).count():
        more = entered.join(jump.where("_to is not null"), [*keys, "_s"]).select(*keys, F.col("_to").alias("_s"))
        entered = written(entered.unionByName(more).distinct(), "interval-doors")
        far = jump.select(*keys, F.col("_s").alias("_to"), F.col("_to").alias("_far"))
        jump = written(jump.join(far, [*keys, "_to"]).select(*keys, "_s", F.col("_far").alias("_to")), "interval-jumps")

    marked = linked.join(entered.withColumn("_in", F.lit(True)), [*keys, "_s"], "left").select(*keys, "_chunk", "_s", "_next", F.coalesce("_in", F.lit(False)).alias("_entered"))
    kept = marked.groupBy(*keys, "_chunk").applyInPandas(mark, T.StructType([*shape, T.StructField("_s", long)]))
    chosen = nodes.join(kept, [*keys, "_s"]).select(*keys, F.col("_o").alias(order))
    return df.join(chosen, [*keys, order], "left_semi")
