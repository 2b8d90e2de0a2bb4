"""Block bootstrap of the rank IC: equal to re-ranking every replicate, without a row for each replicate."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import factors

DRAWS = 40
SCHEMA = "factor string, value double, label double, no long"


def table(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        label = rng.gauss(0, 1)
        rows.append(("smooth", label * 0.3 + rng.gauss(0, 1), label, i * 7))
        rows.append(("flag", float(rng.random() < 0.3), label, i * 7))
        rows.append(("steps", float(rng.randrange(5)) if i % 11 else None, round(label, 1), i * 7))
    return rows


def brute(rows, horizon):
    out = {}
    for f, part in pd.DataFrame(rows, columns=["f", "x", "y", "no"]).dropna().groupby("f"):
        part = part.sort_values("no").reset_index(drop=True)
        n = len(part)
        b = min(n, max(int(np.ceil(np.sqrt(n))), horizon))
        ics = []
        for rep in range(DRAWS):
            at = []
            for j in range(-(-n // b)):
                s = int(hashlib.md5(f"{f}:{rep}:{j}".encode()).hexdigest()[:15], 16) % (n - b + 1)
                at += [s + o for o in range(b) if j * b + o < n]
            r = part.iloc[at][["x", "y"]].rank()
            ics.append(r["x"].corr(r["y"]))
        out[f] = (np.quantile(ics, 0.025), np.quantile(ics, 0.975), DRAWS, b)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_intervals_equal_re_ranked_replicates(spark, monkeypatch, small):
    if small:  # many bins, and bins of one value in several parts
        monkeypatch.setattr(factors, "BIN_ROWS", 16)
        monkeypatch.setattr(factors, "PART", 64)
    rows = table(700)
    got = factors.block_bootstrap_ic(spark.createDataFrame(rows, SCHEMA), "factor", "value", "label", "no", 10, DRAWS, size=64)
    got = {r[0]: tuple(r)[1:] for r in got.select("factor", "ic_bootstrap_ci_low", "ic_bootstrap_ci_high", "bootstrap_sample_count", "block_size").collect()}
    want = brute(rows, 10)
    assert got.keys() == want.keys()
    for f in want:
        assert np.allclose(got[f], want[f], atol=1e-12), f


def test_rows_are_not_shuffled_for_each_replicate(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._jvm.java.util.ArrayList()

    def shuffled():
        stages = store.stageList(none, False, False, getattr(store, "stageList$default$4")(), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    n = 20_000
    df = spark.range(n).select(F.lit("a").alias("factor"), F.rand(1).alias("value"), F.rand(2).alias("label"), F.col("id").alias("no"))
    before = shuffled()
    factors.block_bootstrap_ic(df, "factor", "value", "label", "no", 10, 200).collect()
    assert shuffled() - before < 10 * n


def test_a_task_works_on_some_replicates_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(factors, "CELLS", 2_000, raising=False)
    whole = factors._weights

    def weights(at, starts, block, n):
        assert len(starts) == 1 or len(starts) * len(at) <= 2_000
        return whole(at, starts, block, n)

    monkeypatch.setattr(factors, "_weights", weights)
    rows = table(300)
    got = factors.block_bootstrap_ic(spark.createDataFrame(rows, SCHEMA), "factor", "value", "label", "no", 10, DRAWS, size=64)
    got = {r[0]: tuple(r)[1:] for r in got.select("factor", "ic_bootstrap_ci_low", "ic_bootstrap_ci_high", "bootstrap_sample_count", "block_size").collect()}
    want = brute(rows, 10)
    assert got.keys() == want.keys()
    for f in want:
        assert np.allclose(got[f], want[f], atol=1e-12), f
