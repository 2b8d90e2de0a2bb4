"""Folds over all symbols of a side are cut by time into many tasks, not one a side."""

from pyspark.sql import functions as F

from tidebar.plans.catalog import factors
from tidebar.plans.derive import STEP


def test_positions_of_a_side_are_cut_by_bar(spark, monkeypatch):
    days, symbols = 40, 50
    rows = spark.range(days * symbols).select(
        (F.col("id") % symbols * 1_000_000_000 + F.floor(F.col("id") / symbols)).alias("sample_no"),
        (F.floor(F.col("id") / symbols) * STEP).alias("open_time_ms"), F.lit("LONG").alias("side"),
    )
    monkeypatch.setattr(factors, "samples", lambda *_: rows)
    bins = rows.groupBy("side", F.floor(F.col("open_time_ms") / factors.WIDTH)).count()
    assert bins.agg(F.max("count")).first()[0] <= symbols
    out = factors.sample_folds(spark, "").select("sample_no", "period", "split").collect()
    order = [r.sample_no for r in rows.orderBy("open_time_ms", "sample_no").collect()]
    n = len(order)
    first, size, want = n // 2, (n - n // 2) // 3, set()
    for k in range(3):
        end = first + k * size
        stop = n if k == 2 else end + size
        want |= {(x, f"period_{k + 1}", "train") for x in order[:end]} | {(x, f"period_{k + 1}", "test") for x in order[end:stop]}
    assert {tuple(r) for r in out} == want and len(out) == len(want)
