"""Expanding medians against the plain one, across chunk borders, ties and gaps."""

import random

import numpy as np
import pytest

from tidebar.operators.prefix_median import expanding_median, running_median


def plain(values):
    out, seen = [], []
    for v in values:
        if v is not None and not np.isnan(v):
            seen.append(v)
        out.append(float(np.median(seen)) if seen else None)
    return out


@pytest.mark.parametrize("step", [1, 3, 256])
def test_running_median_after_earlier_values(step):
    rng = np.random.default_rng(step)
    for _ in range(60):
        earlier, new = rng.integers(0, 12, rng.integers(0, 40)) / 4, rng.integers(0, 14, rng.integers(1, 40)) / 4
        new[rng.random(len(new)) < 0.2] = np.nan
        values, counts = np.unique(earlier, return_counts=True)
        got = running_median(values, counts.astype(np.int64), 0, len(earlier), new, step)
        want = plain([*earlier, *new])[len(earlier) :]
        assert [None if np.isnan(g) else g for g in got] == want
        # only the ranks around the middle
        c, n = int((~np.isnan(new)).sum()), len(earlier)
        lo, hi = max(0, (n - c) // 2 - 2), (n + c) // 2 + 3
        values, counts = np.unique(np.sort(earlier)[lo:hi], return_counts=True)
        got = running_median(values, counts.astype(np.int64), lo, n, new, step)
        assert [None if np.isnan(g) else g for g in got] == want


def test_against_plain_medians_over_chunks(spark):
    rng = random.Random(5)
    series = {
        "walk": [rng.gauss(i / 50, 1) for i in range(700)],
        "same": [2.0] * 300,
        "ties": [float(rng.randrange(4)) for _ in range(500)],
        "gaps": [None] * 60 + [rng.random() if rng.random() < 0.4 else None for _ in range(300)],
        "none": [None] * 90,
        "down": [1000.0 - i for i in range(400)],
    }
    rows = [(s, "1h", i, v) for s, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_index long, x double")
    got = {(r.symbol, r.bar_index): r.m for r in expanding_median(df, "x", "m", size=32, bins=8).collect()}
    assert len(got) == len(rows)
    for s, vs in series.items():
        for i, want in enumerate(plain(vs)):
            assert got[s, i] == (want if want is None else pytest.approx(want, abs=1e-12)), (s, i)
