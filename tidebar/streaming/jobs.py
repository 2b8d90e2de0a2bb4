"""Structured Streaming jobs over ticks, bars, premium samples and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.feed import latest_by_key


def tick_bars(ticks: DataFrame, length: str, late: str) -> DataFrame:
    """Tumbling bars, emitted once the watermark shows them complete. Ticks: symbol, ts, price, size, seq."""
    order = F.struct("ts", "seq")
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"),
    ).select("symbol", F.col("window.start").alias("open_time"), F.col("window.end").alias("close_time"), "open", "high", "low", "close", "volume", "trades")


def sliding_stats(bars: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    return bars.withWatermark("open_time", late).groupBy("symbol", F.window("open_time", length, slide)).agg(
        F.avg("close").alias("mean_close"), F.stddev_samp("close").alias("std_close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars")
    )


def candidate_bursts(candidates: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of candidate bars; ``gap`` is the episode gap plus one bar, as a gap equal to it still joins."""
    return candidates.withWatermark("open_time", late).groupBy("symbol", F.session_window("open_time", gap)).agg(
        F.count(F.lit(1)).alias("candidates"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time")
    )


def unique_bars(bars: DataFrame, late: str) -> DataFrame:
    return bars.withWatermark("open_time", late).dropDuplicatesWithinWatermark(["symbol", "open_time"])


def upsert_to(bars: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "open_time"), order: str = "ingest_seq") -> DataStreamWriter:
    """Keep the last version of each bar: every micro-batch is folded, then appended as a numbered version."""

    def store(batch: DataFrame, epoch: int) -> None:
        latest_by_key(batch, list(keys), F.col(order)).withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return bars.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def read_upserted(spark, path: str, keys: tuple[str, ...] = ("symbol", "open_time"), order: str = "ingest_seq") -> DataFrame:
    return latest_by_key(spark.read.parquet(path).drop("epoch"), list(keys), F.struct(order, "_epoch")).drop("_epoch")


def quality_counters(bars: DataFrame, length: str, late: str) -> DataFrame:
    bad: Column = (F.col("high") < F.col("low")) | (F.col("volume") < 0)
    return bars.withWatermark("open_time", late).groupBy("symbol", F.window("open_time", length)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_rows"), F.count_if(F.col("close").isNull()).alias("missing_close")
    )


def premium_samples(raw: DataFrame) -> DataFrame:
    """Usable samples with the premium over the exchange rate in percent."""
    return raw.where(F.col("sample_status") == "OK").withColumn("premium_pct", (F.col("price_cny") - F.col("usd_cny_rate")) / F.col("usd_cny_rate") * 100.0)


def premium_near_bars(bars: DataFrame, premium: DataFrame, late: str, reach: str) -> DataFrame:
    """Bars joined to the premium samples of the time just before them."""
    b = bars.withWatermark("open_time", late).alias("b")
    p = premium.withWatermark("sample_time", late).alias("p")
    near = F.expr(f"p.sample_time <= b.open_time AND p.sample_time > b.open_time - INTERVAL {reach}")
    return b.join(p, near)
