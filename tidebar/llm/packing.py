"""Packing by optimal length buckets.

The lengths of all rows go into one exact histogram, a row for each distinct length; that is
all the driver gets, and it grows with the variety of lengths only. Dynamic programming over
it finds the bucket bounds that minimise padding when each row is padded to the longest row
of its bucket; best cuts move with the end of the range, so a layer is solved by halving
in m log m steps. Inside a bucket, batches of ``budget`` padded units of length follow one
another; a row's place is its rank in a chunk of rows plus the rows of that bucket in the
chunks before, so no bucket is ordered in one task.

Edge cases: a null or empty text has length 0; rows of length 0 take part in the first
bucket; a row longer than the budget, however long, has a batch of its own; fewer distinct
lengths than buckets give fewer buckets; of bounds with equal padding those with the lower cuts
are taken; repeated rows each take a place; places follow the order in which the input is read, so
they change with its partitioning, while lengths, buckets and the number of batches don't; an
empty table gives an empty result; columns other than the id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.llm.common import saved


BUCKETS = 16
BUDGET = 1 << 16
CHUNK = 1 << 14


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def optimal_bounds(count: np.ndarray, total: np.ndarray, longest: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket bounds (longest length of each) of least padding; bins in order of length."""
    m = len(count)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    s = np.concatenate([[0], np.cumsum(total, dtype=np.int64)])
    top = np.concatenate([[0], longest]).astype(np.int64)
    # best[j]: least padding of the first j bins with the buckets so far; back: where the last bucket begins
    best = n * top - s
    backs = [np.zeros(m + 1, np.int64)]
    for _ in range(min(buckets, m) - 1):
        best, back = _next_layer(best, n, s, top)
        backs.append(back)
    cuts, j = [], m
    for back in reversed(backs):
        if not j:
            break
        cuts.append(int(top[j]))
        j = int(back[j])
    return cuts[::-1]


def _next_layer(best: np.ndarray, n: np.ndarray, s: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding with one bucket more, and its first best cut for each end; ends between two known ones lie between their cuts."""
    m = len(best) - 1
    now, back = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    step = 1 << m.bit_length()
    while step > 1:
        step >>= 1
        ends = np.arange(step, m + 1, 2 * step)
        if not len(ends):
            continue
        after = ends + step
        lo = back[ends - step]
        hi = np.where(after <= m, np.minimum(back[np.minimum(after, m)], ends - 1), ends - 1)
        width = hi - lo + 1
        first = np.cumsum(width) - width
        cut = np.arange(width.sum()) - np.repeat(first - lo, width)
        end = np.repeat(ends, width)
        cost = best[cut] + (n[end] - n[cut]) * top[end] - (s[end] - s[cut])
        now[ends] = np.minimum.reduceat(cost, first)
        back[ends] = np.minimum.reduceat(np.where(cost == np.repeat(now[ends], width), cut, m), first)
    return now, back


def histogram_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bounds from the global histogram of a ``length`` column; one row per distinct length comes to the driver."""
    rows = lengths.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    length, count = (rows.column(k).to_numpy() for k in ("length", "n"))
    order = np.argsort(length)
    length, count = length[order], count[order]
    return optimal_bounds(count, count * length, length, buckets)


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: id, length, bucket and its padded length, batch in the bucket and slot in the batch."""
    lengths = saved(docs.select(F.col(id_col).alias("id"), length.cast("long").alias("length")).withColumn("line", F.monotonically_increasing_id()))
    bounds = histogram_bounds(lengths, buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(edges, lambda b: b < F.col("length")))
    placed = lengths.select("id", "length", "line", bucket.alias("bucket"), F.floor(F.col("line") / CHUNK).alias("chunk"))
    sizes = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    # one row per chunk and bucket
    before = sizes.select("bucket", "chunk", (F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("line"))
    ranked = placed.withColumn("rank", rank).join(before, ["bucket", "chunk"]).withColumn("at", F.col("before") + F.col("rank") - 1)
    padded = F.get(edges, F.col("bucket"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(padded, F.lit(1).cast("long"))))
    return ranked.select(F.col("id").alias(id_col), "length", F.col("bucket").cast("int"), padded.alias("padded_length"), F.floor(F.col("at") / room).alias("batch"), (F.col("at") % room).alias("slot"))
