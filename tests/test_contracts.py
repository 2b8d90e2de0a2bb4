"""Cleaning, guards, fills and streaming against hand-made input."""

import pytest
from pyspark.sql import functions as F

from tidebar.operators import cleaning, guards, rules, trades
from tidebar.streaming import jobs


def test_cleaning_rejects_and_keeps_last(spark):
    raw = [
        ("AAA", "1h", "0", "1", "2", "0.5", "1.5", "10", 0),
        ("AAA", "1h", "3600000", "1", "0.5", "2", "1.5", "10", 1),
        ("AAA", "1h", "7200000", "1", "2", "0.5", "1.5", "-1", 2),
        ("AAA", "1h", "0", "1", "2", "0.5", "1.7", "11", 3),
        ("AAA", "1h", "10800000", "x", "2", "0.5", "1.5", "10", 4),
    ]
    df = spark.createDataFrame(raw, "symbol string, interval string, open_time_ms string, open string, high string, low string, close string, volume string, ingest_seq long")
    out = cleaning.clean(df).collect()
    assert [(r.bar_index, r.close, r.volume) for r in out] == [(0, 1.7, 11.0)]
    s = cleaning.clean_stats(df).collect()[0]
    assert (s.dropped_invalid, s.invalid_ohlc, s.invalid_volume, s.dropped_duplicates, s.out_of_order) == (3, 1, 1, 1, 0)


def test_guards_stop_outcome_columns():
    with pytest.raises(ValueError):
        guards.require_safe(["pre_ret_10", "fwd_ret_5"])
    with pytest.raises(ValueError):
        rules.rule_column([{"column": "nope", "op": "<=", "value": 1}], ["a"], missing="error")


def test_leakage_table_tells_every_column(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "event_id int, pre_ret_10 int, mfe_10 int, other int, off int")
    registry = spark.createDataFrame([("pre_ret_10", True), ("off", True), ("off", False)], "feature_name string, model_input_allowed boolean")
    got = dict(map(tuple, guards.leakage_table(df, registry).collect()))
    assert got == {"event_id": "index", "pre_ret_10": "allowed", "mfe_10": "forbidden", "other": "unregistered", "off": "disallowed"}


def test_contracts_differ():
    names = ["fwd_x", "post_x", "mfe_10", "mfe_20", "label_tags_json", "last_exit_reason", "Exit_bar", "pre_ret_10"]
    assert guards.forbidden(names, "dataset") == ["fwd_x", "post_x", "mfe_10"]
    assert guards.forbidden(names, "factor") == ["fwd_x", "post_x", "mfe_10", "mfe_20", "label_tags_json", "Exit_bar"]
    assert guards.forbidden([*names, " "], "context") == [*names[:-1], " "]


def test_rules_with_close_thresholds_stay_apart(spark):
    rows = [(i, i * 1e-9, float(i % 3 - 1)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    conds = rules.thresholds(df, ["x"])
    got = rules.candidates(conds, 1).collect()
    assert len(got) == 8 == len({r.rule_id for r in got})
    sums = rules.rule_sums(df, conds, rules.candidates(conds, 1), ["x"], "y", [])
    assert sorted(r.n for r in sums.collect()) == [200, 200, 400, 400, 600, 600, 800, 800]


def test_slow_decay_and_long_symbols(spark):
    from pyspark.sql import functions as F

    from tidebar.functions.scalar import zero_padded
    from tidebar.operators import series

    n = 40_000
    rows = [("S", "1h", i, (0.01 if i % 7 else 0.05) * (-1) ** i) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_index long, log_return double")
    got = {r.bar_index: r.ewma_variance for r in series.ewma_variance(df, 0.9999, size=1 << 14).where("bar_index % 1000 = 999").collect()}
    v = None
    for _, _, i, r in rows:
        v = r * r if v is None else 0.9999 * v + 0.0001 * r * r
        if i in got:
            assert abs(got[i] / v - 1) < 1e-9
    texts = spark.range(3).select(zero_padded(F.col("id") * 999_999 + 7, 6).alias("t")).collect()
    assert [r.t for r in texts] == ["000007", "1000006", "2000005"]


def test_fill_and_fees(spark):
    df = spark.createDataFrame([(100.0, 103.2, "LONG")], "a double, b double, side string")
    a = trades.filled_price(F.col("a"), F.col("side"), True, 10.0)
    b = trades.filled_price(F.col("b"), F.col("side"), False, 10.0)
    r = df.select(*[c.alias(n) for n, c in trades.outcome_columns(a, b, F.col("side"), 1000.0, 4.0).items()]).collect()[0]
    qty = 1000 / 100.1
    exit_ = 103.2 * 0.999
    assert r.net_pnl_quote == pytest.approx((exit_ - 100.1) * qty - 0.4 - qty * exit_ * 0.0004)


def test_false_discovery_rates(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20), ("e", None)], "r string, p double")
    got = {x.r: x.q_value for x in rules.benjamini_hochberg(df, "p", "r").collect()}
    assert got["a"] == pytest.approx(0.04) and got["b"] == pytest.approx(0.16 / 3) and got["c"] == pytest.approx(0.16 / 3)
    assert got["d"] == pytest.approx(0.2) and got["e"] is None


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    rows = [("AAA", i * 20, 100.0 + i % 5, 1.0, i) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, s long, price double, size double, seq long").select(
        "symbol", F.timestamp_seconds("s").alias("ts"), "price", "size", "seq"
    )
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df.write.parquet(src)
    stream = jobs.tick_bars(spark.readStream.schema(df.schema).parquet(src), "5 minutes", "1 minute")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.read.schema(stream.schema).parquet(out).orderBy("open_time").collect()
    want = jobs.tick_bars(df, "5 minutes", "1 minute").orderBy("open_time").collect()
    # the last bar is still open when the input ends
    assert got == want[: len(got)] and len(want) - len(got) <= 1 and got


def test_stream_upsert_keeps_last_version(spark, tmp_path):
    rows = [("AAA", 0, 1.0, 0), ("AAA", 0, 2.0, 1), ("AAA", 60, 3.0, 2)]
    df = spark.createDataFrame(rows, "symbol string, s long, close double, ingest_seq long").select("symbol", F.timestamp_seconds("s").alias("open_time"), "close", "ingest_seq")
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df.write.parquet(src)
    q = jobs.upsert_to(spark.readStream.schema(df.schema).parquet(src), out, ck).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.close for r in jobs.read_upserted(spark, out).collect()) == [2.0, 3.0]
