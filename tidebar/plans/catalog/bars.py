"""Bar building, cleaning, quality and ids."""

from pyspark.sql import functions as F

from ...operators import cleaning, series
from ...operators.chunks import KEYS
from .. import derive
from ..derive import BARS_SQL, BASE_MS, RAW_SQL, STEP, bars, raw_feed
from ..registry import query

LAST_MS = BASE_MS + 833 * STEP

VALID_SQL = f"""
{BARS_SQL}, {RAW_SQL},
tagged AS (
  SELECT *, open_time_ms + {STEP} - 1 AS close_time_ms,
         CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'missing'
              WHEN high < low OR open < low OR open > high OR close < low OR close > high THEN 'invalid_ohlc'
              WHEN volume < 0 THEN 'invalid_volume' END AS reason
  FROM raw),
kept AS (SELECT * FROM tagged WHERE reason IS NULL),
cleaned AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY open_time_ms) - 1 AS bar_index
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval", open_time_ms ORDER BY ingest_seq DESC) AS rn FROM kept)
  WHERE rn = 1),
stats AS (
  SELECT t.symbol, t."interval", count(*) FILTER (t.reason IS NOT NULL) AS dropped_invalid,
         count(*) FILTER (t.reason = 'invalid_ohlc') AS invalid_ohlc,
         count(*) FILTER (t.reason = 'invalid_volume') AS invalid_volume
  FROM tagged t GROUP BY 1, 2),
copies AS (SELECT symbol, "interval", count(*) - count(DISTINCT open_time_ms) AS dropped_duplicates FROM kept GROUP BY 1, 2),
disorder AS (
  SELECT symbol, "interval", count(*) FILTER (open_time_ms < prev) AS out_of_order
  FROM (SELECT *, lag(open_time_ms) OVER (PARTITION BY symbol, "interval" ORDER BY ingest_seq) AS prev FROM kept)
  GROUP BY 1, 2),
clean_stats AS (SELECT * FROM stats JOIN copies USING (symbol, "interval") JOIN disorder USING (symbol, "interval"))"""


@query(
    "bars_from_ticks",
    'SELECT symbol, "interval", bar_index, open_time_ms, close_time_ms, open, high, low, close, volume, trades FROM bars',
    BARS_SQL,
    "open high low close volume",
)
def _(spark, sf):
    return derive.build_bars(spark, sf).select(
        *KEYS, "bar_index", "open_time_ms", "close_time_ms", "open", "high", "low", "close", "volume", "trades"
    )


@query(
    "clean_bars",
    f"""SELECT symbol, "interval", bar_index, open_time_ms, close_time_ms, open, high, low, close, volume
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY open_time_ms) - 1 AS bi FROM cleaned
          WHERE open_time_ms BETWEEN {BASE_MS + 10 * STEP} AND {LAST_MS}) , (SELECT 1)
    """.replace("bar_index, open_time_ms", "bi AS bar_index, open_time_ms"),
    VALID_SQL,
    "open high low close volume",
)
def _(spark, sf):
    out = cleaning.clean(raw_feed(spark, sf), BASE_MS + 10 * STEP, LAST_MS)
    return out.select(*KEYS, "bar_index", "open_time_ms", "close_time_ms", "open", "high", "low", "close", "volume")


@query("clean_statistics", "SELECT * FROM clean_stats", VALID_SQL)
def _(spark, sf):
    return cleaning.clean_stats(raw_feed(spark, sf))


@query(
    "series_quality_report",
    f"""SELECT *, CASE WHEN invalid_rows > 0 OR strictly_increasing = 0 THEN 'FAIL'
                      WHEN duplicated_bars > 0 OR missing_bars > 0 THEN 'WARNING' ELSE 'PASS' END AS data_quality_status
    FROM (SELECT symbol, "interval", {(LAST_MS - BASE_MS) // STEP + 1} AS expected_bars, n AS actual_bars,
                 greatest({(LAST_MS - BASE_MS) // STEP + 1} - n, 0) AS missing_bars,
                 dropped_duplicates AS duplicated_bars, dropped_invalid AS invalid_rows,
                 CASE WHEN out_of_order = 0 THEN 1 ELSE 0 END AS strictly_increasing,
                 strftime(make_timestamp(a * 1000) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS first_open_time_bjt,
                 strftime(make_timestamp(b * 1000) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS last_open_time_bjt
          FROM (SELECT symbol, "interval", count(*) AS n, min(open_time_ms) AS a, max(open_time_ms) AS b FROM cleaned GROUP BY 1, 2)
          JOIN clean_stats USING (symbol, "interval"))""",
    VALID_SQL,
    ints="expected_bars missing_bars duplicated_bars invalid_rows strictly_increasing",
)
def _(spark, sf):
    raw = raw_feed(spark, sf)
    return cleaning.series_quality(cleaning.clean(raw), cleaning.clean_stats(raw), BASE_MS, LAST_MS)


@query(
    "raw_feed_audit",
    """SELECT *, CASE WHEN invalid_rows > 0 THEN 'FAIL' WHEN warnings <> '' THEN 'WARNING' ELSE 'PASS' END AS quality_status
    FROM (SELECT c.*, actual_bars, duplicate_bars, missing_bars, expected_bars, out_of_order_bars,
           invalid_ohlc_rows + non_numeric_ohlcv_rows + missing_time_rows + missing_volume_rows + negative_volume_rows AS invalid_rows,
           array_to_string(list_filter([
             CASE WHEN missing_time_rows > 0 THEN 'missing_time' END, CASE WHEN missing_bars > 0 THEN 'missing_bars' END,
             CASE WHEN duplicate_bars > 0 THEN 'duplicate_bars' END, CASE WHEN out_of_order_bars > 0 THEN 'out_of_order' END,
             CASE WHEN invalid_ohlc_rows > 0 THEN 'invalid_ohlc' END, CASE WHEN non_numeric_ohlcv_rows > 0 THEN 'non_numeric_ohlcv' END,
             CASE WHEN negative_volume_rows > 0 THEN 'negative_volume' END, CASE WHEN missing_volume_rows > 0 THEN 'missing_volume' END
           ], lambda x: x IS NOT NULL), ',') AS warnings
    FROM (SELECT symbol, "interval", count(*) AS row_count, 0 AS missing_time_rows,
                 count(*) FILTER (high < greatest(open, coalesce(close, open), low) OR low > least(open, coalesce(close, open), high)) AS invalid_ohlc_rows,
                 count(*) FILTER (close IS NULL) AS non_numeric_ohlcv_rows,
                 count(*) FILTER (volume IS NULL) AS missing_volume_rows, count(*) FILTER (volume < 0) AS negative_volume_rows
          FROM raw GROUP BY 1, 2) c
    JOIN (SELECT symbol, "interval", count(*) AS actual_bars, sum(k - 1) AS duplicate_bars,
                 coalesce(sum(CASE WHEN gap > {step} THEN gap // {step} - 1 END), 0) AS missing_bars,
                 (max(open_time_ms) - min(open_time_ms)) // {step} + 1 AS expected_bars
          FROM (SELECT *, open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol, "interval" ORDER BY open_time_ms) AS gap
                FROM (SELECT symbol, "interval", open_time_ms, count(*) AS k FROM raw GROUP BY 1, 2, 3)) GROUP BY 1, 2) USING (symbol, "interval")
    JOIN (SELECT symbol, "interval", count(*) FILTER (open_time_ms < prev) AS out_of_order_bars
          FROM (SELECT *, lag(open_time_ms) OVER (PARTITION BY symbol, "interval" ORDER BY ingest_seq) AS prev FROM raw)
          GROUP BY 1, 2) USING (symbol, "interval"))""".replace("{step}", str(STEP)),
    f"{BARS_SQL}, {RAW_SQL}",
    ints="missing_time_rows duplicate_bars missing_bars expected_bars invalid_rows",
)
def _(spark, sf):
    return cleaning.raw_audit(raw_feed(spark, sf))


@query(
    "candle_ids",
    """SELECT symbol, "interval", bar_index, substr(sha256(upper(symbol) || '|' || "interval" || '|' || open_time_ms), 1, 32) AS candle_id FROM bars""",
    BARS_SQL,
)
def _(spark, sf):
    return cleaning.with_candle_id(bars(spark, sf)).select(*KEYS, "bar_index", "candle_id")


@query(
    "bar_table_digest",
    """SELECT symbol, "interval", row_count,
              'dv_' || substr(sha256(row_count || '|' || x1 || '|' || x2 || '|' || s), 1, 24) AS data_version
    FROM (SELECT symbol, "interval", count(*) AS row_count, bit_xor(a) AS x1, bit_xor(b) AS x2, cast(sum(a % 1000003) AS BIGINT) AS s
          FROM (SELECT symbol, "interval", cast('0x' || substr(h, 1, 15) AS BIGINT) AS a, cast('0x' || substr(h, 17, 15) AS BIGINT) AS b
                FROM (SELECT symbol, "interval", md5(concat_ws('|', bar_index, open_time_ms, cast(round(open * 100) AS BIGINT), cast(round(high * 100) AS BIGINT), cast(round(low * 100) AS BIGINT), cast(round(close * 100) AS BIGINT), cast(volume AS BIGINT), trades)) AS h FROM bars))
          GROUP BY 1, 2)""",
    BARS_SQL,
)
def _(spark, sf):
    # prices are whole cents
    b = bars(spark, sf).withColumns({c: F.round(F.col(c) * 100).cast("long") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume").cast("long")})
    return cleaning.content_digest(b, KEYS, ["bar_index", "open_time_ms", "open", "high", "low", "close", "volume", "trades"]).select(*KEYS, "row_count", "data_version")


@query(
    "range_slice_status",
    f"""SELECT symbol, "interval", a AS available_start_ms, b AS available_end_ms, n AS bars_in_range,
           CASE WHEN a > {BASE_MS + 2 * STEP} OR b < {BASE_MS + 600 * STEP} THEN 'needs_market_data'
                WHEN n < 560 THEN 'error' ELSE 'ready' END AS status
    FROM (SELECT symbol, "interval", min(open_time_ms) AS a, max(open_time_ms) + {STEP} AS b,
                 count(*) FILTER (open_time_ms >= {BASE_MS + 2 * STEP} AND open_time_ms < {BASE_MS + 600 * STEP}) AS n FROM bars GROUP BY 1, 2)""",
    BARS_SQL,
)
def _(spark, sf):
    return cleaning.range_slice(bars(spark, sf), BASE_MS + 2 * STEP, BASE_MS + 600 * STEP, 560)[1]


@query(
    "resample_daily",
    """SELECT symbol, '1d' AS "interval", s AS open_time_ms, s + 86400000 - 1 AS close_time_ms, first(open ORDER BY open_time_ms) AS open,
       max(high) AS high, min(low) AS low, last(close ORDER BY open_time_ms) AS close, sum(volume) AS volume, count(*) AS source_bars
    FROM (SELECT *, open_time_ms - open_time_ms % 86400000 AS s FROM bars) GROUP BY symbol, s""",
    BARS_SQL,
    "open high low close volume",
)
def _(spark, sf):
    return series.resample(bars(spark, sf), "1d")
