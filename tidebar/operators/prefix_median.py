"""The median of everything up to each row of a series, in chunks.

A row's median is one order statistic of the values before its chunk and of those of the chunk.
While a chunk of c values is added, the median moves by at most c ranks among the earlier
ones, so the chunk needs those of about c ranks around their middle and nothing else. They are found
from counts: values are binned by sketch edges, which only steer the work, counts of a bin
are summed over chunks, and the bins that hold the wanted ranks are sent to the chunk, equal values
folded. No task holds more than a chunk and those bins, and no series is one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import written
from .chunks import KEYS

CHUNK, BINS, STEP = 4096, 128, 256


def running_median(earlier: np.ndarray, counts: np.ndarray, skip: int, total: int, values: np.ndarray, step: int = STEP) -> np.ndarray:
    """Median after each of ``values``, NaN entries adding nothing; NaN while there is none.

    ``earlier`` are sorted distinct values with ``counts``, a run of ranks of ``total`` earlier ones
    of which ``skip`` lie below the run.
    """
    out = np.full(len(values), np.nan)
    current = np.nan
    if total:
        upto = skip + np.cumsum(counts)
        current = earlier[np.searchsorted(upto, [(total - 1) // 2, total // 2], "right")].mean()
    for at in range(0, len(values), step):
        part = values[at : at + step]
        new = part[~np.isnan(part)]
        k = len(new)
        if k:
            upto = skip + np.cumsum(counts)
            first = int(np.searchsorted(upto, (total - k) // 2 - 1, "left"))
            last = int(np.searchsorted(upto, (total + k) // 2 + 2, "left")) + 1
            below = int(upto[first - 1]) if first else skip
            near = np.unique(np.concatenate([earlier[first:last], new]))
            base = np.zeros(len(near), np.int64)
            base[np.searchsorted(near, earlier[first:last])] = counts[first:last]
            added = np.zeros((k, len(near)), np.int32)
            added[np.arange(k), np.searchsorted(near, new)] = 1
            cum = below + np.cumsum(base + np.cumsum(added, 0), 1)
            # new values below the run are counted by ``added`` alone, as the run starts above none of them
            size = total + np.arange(1, k + 1)
            lower, upper = ((cum <= p[:, None]).sum(1) for p in ((size - 1) // 2, size // 2))
            found = np.concatenate([[current], (near[lower] + near[upper]) / 2.0])
            current = found[-1]
            both, where = np.unique(np.concatenate([earlier, new]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, np.ones(k)]), minlength=len(both)).astype(np.int64)
            earlier, total = both, total + k
        else:
            found = np.array([current])
        out[at : at + step] = found[np.cumsum(~np.isnan(part))]
    return out


def expanding_median(
    df: DataFrame, value: str, name: str, keys: Sequence[str] = KEYS, index: str = "bar_index", size: int = CHUNK, bins: int = BINS
) -> DataFrame:
    """(keys, index, name): the median of ``value`` over all rows of the key up to each row; null while there is none."""
    keys = list(keys)
    rows = df.select(*keys, F.col(index).alias("_i"), F.col(value).cast("double").alias("_x"), F.floor(F.col(index) / size).cast("long").alias("_chunk"))
    rows = rows.withColumn("_x", F.when(~F.isnan("_x"), F.col("_x")))
    chunks = rows.groupBy(*keys, "_chunk").agg(F.count("_x").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = written(chunks.select("*", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_total")), "median-chunks")
    later = chunks.where("_total > 0")

    given = rows.where("_x is not null").join(later.select(*keys).distinct(), keys, "left_semi")
    edges = given.groupBy(*keys).agg(F.percentile_approx("_x", [k / bins for k in range(1, bins)], 20 * bins).alias("_edges"))
    binned = given.join(edges, keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col("_x"))))
    cells = written(binned.groupBy(*keys, "_bin", "_chunk", "_x").agg(F.count("*").alias("_n")), "median-cells")
    counted = cells.groupBy(*keys, "_bin", "_chunk").agg(F.sum("_n").alias("_n"))
    # counts of every bin before each later chunk, from one line of the bin's counts and those chunks
    asked = counted.select(*keys, "_bin").distinct().join(later.select(*keys, "_chunk"), keys)
    line = counted.select(*keys, "_bin", "_chunk", "_n", F.lit(1).alias("_side")).unionByName(asked.select(*keys, "_bin", "_chunk", F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_side")))
    upto = Window.partitionBy(*keys, "_bin").orderBy("_chunk", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = line.withColumn("_before", F.sum("_n").over(upto)).where("_side = 0 and _before > 0").select(*keys, "_bin", "_chunk", "_before")
    lower = Window.partitionBy(*keys, "_chunk").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("_skip", F.coalesce(F.sum("_before").over(lower), F.lit(0))).join(later, [*keys, "_chunk"])
    first, last = F.expr("(_total - _c) div 2 - 2"), F.expr("(_total + _c) div 2 + 2")
    wanted = known.where((F.col("_skip") + F.col("_before") > first) & (F.col("_skip") <= last)).select(*keys, "_bin", F.col("_chunk").alias("_to"), "_skip")
    sent = cells.join(wanted, [*keys, "_bin"]).where("_chunk < _to").groupBy(*keys, F.col("_to").alias("_chunk"), "_x").agg(F.sum("_n").alias("_n"), F.min("_skip").alias("_skip"))

    none = F.lit(None).cast("long")
    own = rows.join(chunks.select(*keys, "_chunk", "_total"), [*keys, "_chunk"]).select(*keys, "_chunk", "_i", "_x", none.alias("_n"), none.alias("_skip"), "_total")
    both = own.unionByName(sent.select(*keys, "_chunk", none.alias("_i"), "_x", "_n", "_skip", none.alias("_total")))

    def medians(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["_n"].isna()].sort_values("_i")
        other = pdf[pdf["_n"].notna()].sort_values("_x")
        skip = int(other["_skip"].min()) if len(other) else 0
        total = int(mine["_total"].iloc[0])
        made = running_median(other["_x"].to_numpy(float), other["_n"].to_numpy(np.int64), skip, total, mine["_x"].to_numpy(float))
        out = mine[keys].copy()
        out[index], out[name] = mine["_i"].astype("int64"), pd.array(np.where(np.isnan(made), None, made), "Float64")
        return out

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(index, T.LongType()), T.StructField(name, T.DoubleType())])
    return both.groupBy(*keys, "_chunk").applyInPandas(medians, schema)
