"""Bars, events and samples derived from the given tables.

``lineitem`` is the price feed: four suppliers form a symbol and three ship days a
4h bar. Each derivation has a SQL twin used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import INTERVAL_MS, utc8_text, zero_padded
from ..operators.chunks import CHUNK, dense_index
from ..session import stored, written

BASE_MS = 1_672_531_200_000
INTERVAL = "4h"
STEP = INTERVAL_MS[INTERVAL]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: symbol, tick time, price and size."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return li.select(
        F.concat(F.lit("S"), zero_padded(F.floor(F.col("l_suppkey") / 4), 6)).alias("symbol"),
        F.lit(INTERVAL).alias("interval"),
        (F.lit(BASE_MS) + F.floor(day / 3) * STEP).alias("open_time_ms"),
        F.struct(
            day.alias("d"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
        ).alias("seq"),
        ((F.lit(90_000) + F.floor(F.col("l_extendedprice") / 10.0)) / 100.0).alias("price"),
        F.col("l_quantity").alias("size"),
    )


def ticks_to_bars(t: DataFrame) -> DataFrame:
    return t.groupBy("symbol", "interval", "open_time_ms").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )


def build_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ticks_to_bars(ticks(spark, sf_dir)).withColumn("close_time_ms", F.col("open_time_ms") + STEP - 1)
    # written once: the index reads them twice, and folding the ticks is most of the work
    return dense_index(written(out, "folded"), ["symbol", "interval"], "open_time_ms", STEP * CHUNK)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored, densely indexed bar table."""
    return stored(
        spark, sf_dir, "bars", lambda: build_bars(spark, sf_dir).sortWithinPartitions("symbol", "interval", "bar_index")
    )


BARS_SQL = f"""
ticks AS (
  SELECT 'S' || lpad(cast(l_suppkey // 4 AS VARCHAR), greatest(6, length(cast(l_suppkey // 4 AS VARCHAR)))::INTEGER, '0') AS symbol, '{INTERVAL}' AS "interval",
         {BASE_MS} + (date_diff('day', DATE '1995-01-01', cast(l_shipdate AS DATE)) // 3) * {STEP} AS open_time_ms,
         date_diff('day', DATE '1995-01-01', cast(l_shipdate AS DATE)) AS d,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         (90000 + floor(l_extendedprice / 10.0::DOUBLE)) / 100.0::DOUBLE AS price, l_quantity AS size
  FROM lineitem),
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY open_time_ms) - 1 AS bar_index
  FROM (SELECT symbol, "interval", open_time_ms, open_time_ms + {STEP} - 1 AS close_time_ms,
               first(price ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
               max(price) AS high, min(price) AS low,
               last(price ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
               sum(size) AS volume, count(*) AS trades
        FROM ticks GROUP BY 1, 2, 3, 4))"""


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows with duplicates, bad prices, bad volumes, unreadable numbers and late arrival."""
    b = bars(spark, sf_dir)
    i = F.col("bar_index")
    feed = b.select(
        "symbol",
        "interval",
        "bar_index",
        F.col("open_time_ms").cast("string").alias("open_time_ms"),
        F.col("open").cast("string").alias("open"),
        F.when(i % 53 == 7, F.col("low") - 1).otherwise(F.col("high")).cast("string").alias("high"),
        F.col("low").cast("string").alias("low"),
        F.when(i % 71 == 5, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("close"),
        F.when(i % 61 == 3, -F.col("volume")).otherwise(F.col("volume")).cast("string").alias("volume"),
        (i * 100 + F.when(i % 29 == 0, 350).otherwise(0)).alias("ingest_seq"),
    )
    again = feed.where(i % 37 == 0).withColumns(
        {"volume": F.lit("5.0"), "ingest_seq": F.col("ingest_seq") + 1}
    )
    return feed.unionByName(again).drop("bar_index")


RAW_SQL = """
feed AS (
  SELECT symbol, "interval", bar_index, open_time_ms, open,
         CASE WHEN bar_index % 53 = 7 THEN low - 1 ELSE high END AS high, low,
         CASE WHEN bar_index % 71 = 5 THEN NULL ELSE close END AS close,
         CASE WHEN bar_index % 61 = 3 THEN -volume ELSE volume END AS volume,
         bar_index * 100 + CASE WHEN bar_index % 29 = 0 THEN 350 ELSE 0 END AS ingest_seq
  FROM bars),
raw AS (
  SELECT * EXCLUDE (bar_index) FROM feed
  UNION ALL
  SELECT symbol, "interval", open_time_ms, open, high, low, close, 5.0 AS volume, ingest_seq + 1
  FROM feed WHERE bar_index % 37 = 0)"""


def event_marks() -> tuple[Column, Column]:
    """Whether a bar opens and whether it closes a trade."""
    i = F.col("bar_index")
    return (i >= 20) & (i % 17 == 0), (i >= 30) & ((i - 10) % 17 == 0)


def trade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPEN marks on every 17th bar and CLOSE marks ten bars later, with tag text of mixed quality."""
    b = bars(spark, sf_dir).select("symbol", "interval", "bar_index", "open_time_ms")
    i = F.col("bar_index")
    is_open, is_close = event_marks()
    start = F.when(is_open, i).otherwise(i - 10)
    side = F.when(F.floor(start / 17) % 2 == 0, "LONG").otherwise("SHORT")
    tags = (
        F.when(start % 3 == 0, F.lit('["deep_v","volume"]'))
        .when(start % 5 == 1, F.lit(""))
        .when(start % 7 == 2, F.lit("not json"))
        .otherwise(F.lit('["pin_bar"]'))
    )
    return (
        b.where(is_open | is_close)
        .select(
            F.concat_ws("-", "symbol", i.cast("string"), F.when(is_open, "O").otherwise("C")).alias("event_id"),
            F.concat_ws("-", "symbol", start.cast("string")).alias("trade_id"),
            F.concat(F.lit("SES"), F.substring("symbol", -1, 1)).alias("session_id"),
            F.when(is_open, "OPEN").otherwise("CLOSE").alias("event_type"),
            side.alias("side"),
            "symbol",
            "interval",
            "bar_index",
            "open_time_ms",
            utc8_text("open_time_ms").alias("bar_open_time_bjt"),
            tags.alias("label_tags_json"),
        )
    )


EVENTS_SQL = """
marks AS (
  SELECT symbol, "interval", bar_index, open_time_ms,
         bar_index >= 20 AND bar_index % 17 = 0 AS is_open,
         CASE WHEN bar_index >= 20 AND bar_index % 17 = 0 THEN bar_index ELSE bar_index - 10 END AS start
  FROM bars
  WHERE (bar_index >= 20 AND bar_index % 17 = 0) OR (bar_index >= 30 AND (bar_index - 10) % 17 = 0)),
trade_events AS (
  SELECT symbol || '-' || bar_index || '-' || CASE WHEN is_open THEN 'O' ELSE 'C' END AS event_id,
         symbol || '-' || start AS trade_id, 'SES' || right(symbol, 1) AS session_id,
         CASE WHEN is_open THEN 'OPEN' ELSE 'CLOSE' END AS event_type,
         CASE WHEN (start // 17) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
         symbol, "interval", bar_index, open_time_ms,
         strftime(make_timestamp(open_time_ms * 1000) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS bar_open_time_bjt,
         CASE WHEN start % 3 = 0 THEN '["deep_v","volume"]' WHEN start % 5 = 1 THEN ''
              WHEN start % 7 = 2 THEN 'not json' ELSE '["pin_bar"]' END AS label_tags_json
  FROM marks)"""
