"""Results that the order of summing must not decide."""

from tidebar.operators import universe


def test_equal_averages_make_no_cross(spark):
    # tenths have no exact sum: the averages over 5 and 20 bars are equal but for the last bits
    closes = [1.1, 0.1, 0.3, 0.7, 0.3] * 8 + [0.3 + 2 * 0.2]
    rows = [("A", "4h", i, float(c)) for i, c in enumerate(closes)]
    got = universe.ma_cross(spark.createDataFrame(rows, "symbol string, interval string, bar_index long, close double"))
    crosses = {r["bar_index"]: r["cross"] for r in got.collect()}
    assert all(crosses[i] is None for i in range(40))
    assert set(crosses) == set(range(41))


def test_last_bits_of_a_factor_move_no_row_between_bins(spark):
    from pyspark.sql import functions as F

    from tidebar.operators import study
    from tidebar.plans.catalog import study as queries

    def binned(noise):
        df = spark.range(200).select(F.col("id").cast("string").alias("event_id"), (F.col("id") % 7 / 10.0).alias("y"), *[(F.floor(F.col("id") / 8) / 10.0 + noise * (F.col("id") % 2)).alias(f) for f in queries.FACTORS])
        out = study.factor_bins(queries.settled(df), queries.FACTORS, "y", "event_id", draws=4, digits=queries.BIN_DIGITS)
        return sorted((r["factor"], r["bin_id"], r["sample_count"], round(r["bin_left"], 7)) for r in out.collect())

    assert binned(0.0) == binned(1e-15)
