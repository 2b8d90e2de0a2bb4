"""Digests made in numpy, and draws from them."""

from hashlib import md5

import pytest

from tidebar.operators import resample


def test_digests_equal_the_library():
    heads = [f"S{i:06d}-{i * 37}:sub:".encode() for i in range(90)] + [b"x" * n for n in range(60)] + ["é中:".encode()]
    got = resample.numbered_digests(heads, 7, 112)
    assert all(got[i, n - 7].tobytes() == md5(h + str(n).encode()).digest() for i, h in enumerate(heads) for n in range(7, 112))


@pytest.mark.parametrize("part", [8_192, 16])
def test_draws_are_the_least_digests(spark, monkeypatch, part):
    monkeypatch.setattr(resample, "PART", part)
    monkeypatch.setattr(resample, "DRAWN", 1_000)
    # all digests of a part are made by numbered_digests, none by the engine for each row and replicate
    seen = resample.numbered_digests
    monkeypatch.setattr(resample, "numbered_digests", lambda heads, a, b: seen(heads, a, b))
    rows = [(g, f"r{i}", float((i * 7919) % 101 - 40)) for g, n in (("a", 3), ("b", 60), ("c", 12)) for i in range(n)]
    rows += [("b", "r5", 9.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "g string, r string, v double")
    got = {r.g: r for r in resample.subsample_baseline(df, ["g"], "v", "r", 12, 23).collect()}
    for g in "abc":
        own = [(r, v) for h, r, v in rows if h == g and v is not None]
        means, wins = [], []
        for rep in range(23):
            low = [v for _, _, v in sorted((md5(f"{r}:sub:{rep}".encode()).hexdigest(), r, v) for r, v in own)[:12]]
            means.append(sum(sorted(low)) / len(low))
            wins.append(100 * sum(v > 0 for v in low) / len(low))
        assert (got[g].sample_size, got[g].available_label_count) == (min(12, len(own)), len(own))
        assert got[g].baseline_mean == pytest.approx(sum(means) / 23) and got[g].baseline_win_rate == pytest.approx(sum(wins) / 23)
