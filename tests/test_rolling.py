import numpy as np
from pyspark.sql import Window, functions as F

from tidebar.operators.chunks import over_chunks
from tidebar.operators.rolling import rolled
from tidebar.plans import derive


def test_sliding_figures_equal_window_functions_to_the_last_bit(spark):
    rng = np.random.default_rng(3)
    rows = [(s, "4h", i, None if rng.random() < 0.1 else float(rng.normal()), float(rng.integers(1, 4))) for s in ("A", "B") for i in range(70)]
    df = spark.createDataFrame(rows, "symbol string, interval string, bar_index long, x double, v double")
    x, at = F.col("x"), F.col("bar_index")
    specs = {
        "n": ("count", x, -9, -1), "hi": ("max", x, -9, -1), "lo": ("min", x, -9, 0), "mean": ("mean", x, -9, -1), "std": ("std", x, -9, 0),
        "slope": ("slope", (x, at), -9, -1), "peak": ("first_top", (F.col("v"), at), -9, 0), "share": ("rank_share", F.col("v"), -9, 0),
        "deep": ("drawdown", F.col("v"), -9, 0),
    }
    # chunks of 16 rows: frames reach over their borders
    got = over_chunks(df, lambda d, w: rolled(d, specs), back=9, size=16)
    w = Window.partitionBy("symbol").orderBy("bar_index")
    past, here = w.rowsBetween(-9, -1), w.rowsBetween(-9, 0)
    vs = F.collect_list("v").over(here)
    want = df.withColumns(
        {
            "n": F.count(x).over(past).cast("double"), "hi": F.max(x).over(past), "lo": F.min(x).over(here), "mean": F.avg(x).over(past), "std": F.stddev_pop(x).over(here),
            "slope": F.regr_slope(x, at).over(past), "peak": F.max(F.struct("v", (-at).alias("i"))).over(here)["i"].cast("double") * -1,
            "share": F.size(F.filter(vs, lambda t: t <= F.col("v"))) / F.size(vs),
            "deep": F.array_min(F.transform(vs, lambda t, i: t / F.array_max(F.slice(vs, F.lit(1), i + 1)) - 1.0)),
        }
    )
    assert got.columns == want.columns
    key = lambda r: (r["symbol"], r["bar_index"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_ticks_are_folded_once_for_the_bars(spark, tmp_path):
    days = spark.range(300).selectExpr("id l_orderkey", "1 l_linenumber", "id l_partkey", "id % 8 l_suppkey", "date_add(date'1995-01-01', cast(id as int)) l_shipdate", "100.0D + id l_extendedprice", "1.0D l_quantity")
    days.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = derive.build_bars(spark, str(tmp_path))
    assert "lineitem" not in "".join(made.inputFiles())
    assert made.count() == made.select("symbol", "bar_index").distinct().count() == 150
