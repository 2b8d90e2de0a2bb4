"""The chunked and binned operators against brute force on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from tidebar.operators import asof, chunks, features, labels, matching, overlap, quantiles, series, universe


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or abs(p - q) < 1e-9, (x, y)


def test_chunk_size_does_not_change_windows(bars):
    cols = ("symbol", "bar_index", "rolling_volatility_20", "return_zscore_20", "rolling_return_20")
    wide = series.return_series(bars).na.fill(-9.0).select(*cols)
    cut = series.return_series(bars, size=16).na.fill(-9.0).select(*cols)
    close(rows(wide, *cols), rows(cut, *cols))


def test_running_values_cross_chunks(bars):
    out = chunks.running(bars, {"s": ("sum", F.col("volume")), "m": ("max", F.col("close"))}, size=16)
    got = rows(out, "symbol", "bar_index", "s", "m")
    pdf = bars.toPandas().sort_values(["symbol", "bar_index"])
    pdf["s"] = pdf.groupby("symbol")["volume"].cumsum()
    pdf["m"] = pdf.groupby("symbol")["close"].cummax()
    close(got, sorted(map(tuple, pdf[["symbol", "bar_index", "s", "m"]].to_numpy())))


def test_ewma_matches_the_recursion(bars):
    r = series.bar_returns(bars)
    got = {(x.symbol, x.bar_index): x.ewma_variance for x in series.ewma_variance(r, size=64).collect()}
    for symbol, part in r.toPandas().sort_values("bar_index").groupby("symbol"):
        v = None
        for i, x in zip(part["bar_index"], part["log_return"], strict=True):
            if not np.isnan(x):
                v = x * x if v is None else 0.94 * v + 0.06 * x * x
            assert (v is None) == (got[symbol, i] is None)
            assert v is None or abs(got[symbol, i] - v) < 1e-14


def test_exact_quantiles_with_ties(spark):
    data = [("a", float(i % 7)) for i in range(500)] + [("b", float(i) ** 1.5) for i in range(77)] + [("c", 3.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in quantiles.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.93], ["lo", "mid", "hi"]).collect()}
    for g in "abc":
        want = np.quantile([v for k, v in data if k == g], [0.1, 0.5, 0.93])
        assert np.allclose(got[g], want)


def test_first_rank_of_a_constant(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(200)], "id long, v double")
    out = quantiles.with_first_rank(df, [], "v", "id", size=16).orderBy("id").collect()
    assert [r.rank_no for r in out] == list(range(1, 201))


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("k", t) for t in (0, 5, 10, 99, 100, 1000)], "k string, t long")
    right = spark.createDataFrame([("k", 5, 1), ("k", 100, 2), ("k", 7, 3)], "k string, rt long, v int")
    out = asof.asof_join(left, right, ["k"], "t", "rt", ["v"], 10).orderBy("t").collect()
    assert [r.v for r in out] == [None, 1, 3, 3, 2, 2]


def test_overlap_and_greedy_against_brute_force(spark):
    import random

    rng = random.Random(3)
    ivs = [("k", i, s, s + rng.randint(0, 9)) for i, s in enumerate(sorted(rng.randint(0, 300) for _ in range(120)))]
    df = spark.createDataFrame(ivs, "k string, id long, s long, e long")
    other = [(rng.randint(0, 300),) for _ in range(15)]
    right = spark.createDataFrame([("k", a, a + 4) for (a,) in other], "k string, s long, e long")
    got = {r.id: r.overlaps for r in overlap.overlap_flag(df, right, ["k"], "s", "e", width=16).collect()}
    for _, i, s, e in ivs:
        assert got[i] == any(max(s, a) <= min(e, a + 4) for (a,) in other)
    kept, last = [], -1
    for _, i, s, e in sorted(ivs, key=lambda r: (r[2], r[1])):
        if s > last:
            kept.append(i)
            last = e
    out = overlap.greedy_non_overlapping(df, ["k"], "s", "e", "id", size=16)
    assert sorted(r.id for r in out.collect()) == sorted(kept)


def test_greedy_choice_with_intervals_beyond_chunks_and_many_keys(spark):
    import random

    rng = random.Random(9)
    rows = []
    for k, (n, span, longest) in enumerate(((1, 5, 3), (60, 900, 200), (300, 2000, 3), (80, 50, 400), (200, 4000, 40))):
        for i in range(n):
            s = rng.randint(-span, span)
            rows.append((f"k{k}", k * 1000 + i, s, s + rng.randint(0, longest)))
    kept, last = [], {}
    for k, i, s, e in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if s > last.get(k, -(10**9)):
            kept.append(i)
            last[k] = e
    df = spark.createDataFrame(rows, "k string, id long, s long, e long")
    for size in (8, 512):
        out = overlap.greedy_non_overlapping(df, ["k"], "s", "e", "id", size=size)
        assert sorted(r.id for r in out.collect()) == sorted(kept)


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(5)
    pts = [("g", f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(pts, "g string, id string, x double, y double")
    got = {}
    for r in matching.nearest(df, df, ["g"], "id", "id", ["x", "y"], 3, cell=8).collect():
        got.setdefault(r.id, []).append((round(r.context_distance, 9), r.control_sample_id))
    for _, i, x, y in pts:
        want = sorted((round(float(np.hypot(x - a, y - b)), 9), j) for _, j, a, b in pts if j != i)[:3]
        assert sorted(got[i]) == want


def test_future_bars_do_not_change_features(bars):
    cut = 200
    changed = bars.withColumn("close", F.when(F.col("bar_index") > cut, F.col("close") * 3).otherwise(F.col("close"))).withColumn(
        "high", F.when(F.col("bar_index") > cut, F.col("high") * 3).otherwise(F.col("high"))
    )
    cols = ("symbol", "bar_index", "trend_slope_20", "volume_zscore_20", "panic_drop_score", "atr_14")
    a = features.factor_table(bars).where(F.col("bar_index") <= cut).na.fill(-9.0)
    b = features.factor_table(changed).where(F.col("bar_index") <= cut).na.fill(-9.0)
    close(rows(a, *cols), rows(b, *cols))
    ca, cb = (universe.deep_v_flags(x).where(F.col("bar_index") <= cut) for x in (bars, changed))
    assert rows(ca, "symbol", "bar_index", "is_candidate") == rows(cb, "symbol", "bar_index", "is_candidate")


def test_labels_are_null_without_enough_future(bars):
    obs = bars.where("symbol = 'COLD'").selectExpr("concat('o', bar_index) as observation_id", "symbol", "interval", "bar_index")
    out = {r.observation_id: r for r in labels.entry_outcomes(bars, obs, (5,)).collect()}
    assert out["o39"].fwd_ret_5 is None and out["o30"].mfe_10 is None
    assert out["o20"].fwd_ret_5 is not None and out["o20"].mfe_10 is not None
