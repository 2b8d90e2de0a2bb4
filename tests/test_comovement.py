"""Correlations and the first factor over all series against numpy on whole matrices."""

import numpy as np
import pytest

from tidebar.operators import comovement


def matrix(rng, n, times, factor=1.0, missing=0.1):
    common = rng.normal(size=times)
    m = np.array([rng.uniform(0.2, factor) * common + rng.normal(size=times) for _ in range(n)]) * 0.01 + 0.5
    m[rng.random(m.shape) < missing] = np.nan
    return m


def long(spark, m):
    rows = [(f"s{i:03d}", t, None if np.isnan(v) else float(v)) for i, row in enumerate(m) for t, v in enumerate(row)]
    return spark.createDataFrame(rows, "symbol string, t long, r double")


@pytest.mark.parametrize("per,times", [(64, 512), (4, 7)])
def test_pairwise_correlations(spark, per, times):
    m = matrix(np.random.default_rng(1), 19, 40)
    m[3] = 0.25  # constant
    m[4, 1:] = np.nan  # one value only
    got = {(r.a, r.b): (r.n, r.corr) for r in comovement.pairwise_correlations(long(spark, m), "t", "symbol", "r", per, times).collect()}
    assert len(got) == 19 * 20 // 2
    for (a, b), (n, c) in got.items():
        x, y = m[int(a[1:])], m[int(b[1:])]
        both = ~np.isnan(x) & ~np.isnan(y)
        assert n == both.sum()
        if 3 in (int(a[1:]), int(b[1:])) or 4 in (int(a[1:]), int(b[1:])):
            assert c is None
        else:
            assert c == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-12)


@pytest.mark.parametrize("n,per,width", [(12, 64, 32), (30, 7, 6)])
def test_first_component(spark, n, per, width):
    m = matrix(np.random.default_rng(2), n, 300, missing=0.001)
    m[5] = np.where(np.isnan(m[5]), np.nan, 1.5)  # constant series leave
    rows = comovement.complete_times(long(spark, m), "t", "symbol", "r")
    blocks, pairs = comovement.correlation_blocks(rows, "t", "symbol", "r", per, 64)
    got = {r.series: (r.loading, r.share) for r in comovement.first_component(blocks, pairs, width).collect()}
    kept = [i for i in range(n) if i != 5]
    full = m[:, ~np.isnan(m).any(0)][kept]
    values, vectors = np.linalg.eigh(np.corrcoef(full))
    v = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    assert [got[f"s{i:03d}"][0] for i in kept] == pytest.approx(v.tolist(), abs=1e-10)
    assert all(s == pytest.approx(values[-1] / len(kept)) for _, s in got.values())


def test_nothing_to_correlate(spark):
    none = long(spark, np.zeros((0, 0)))
    assert comovement.pairwise_correlations(none, "t", "symbol", "r").count() == 0
    one = comovement.complete_times(long(spark, np.array([[1.0, 2.0]])), "t", "symbol", "r")
    assert comovement.first_component(*comovement.correlation_blocks(one, "t", "symbol", "r")).count() == 0


def test_blocks_stay_few(spark):
    """Each block is sent to all others, so there are few of them where series are many."""
    from pyspark.sql import functions as F

    long = spark.range(4_096).select(F.col("id").cast("string").alias("symbol"))
    assert comovement.series_blocks(long, "symbol").count() <= comovement.BLOCKS
