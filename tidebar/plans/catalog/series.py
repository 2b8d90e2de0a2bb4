"""Returns, volatility, regimes, liquidity, runs and higher timeframes."""

from pyspark.sql import functions as F

from ...operators import series
from ...operators.chunks import KEYS
from ..derive import BARS_SQL, bars
from ..registry import query

W = 'PARTITION BY symbol, "interval" ORDER BY bar_index'


def frame(lo: int, hi: int) -> str:
    def side(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    return f"({W} ROWS BETWEEN {side(lo)} AND {side(hi)})"


RET_SQL = f"""
{BARS_SQL},
rets AS (
  SELECT *, close / prev - 1 AS simple_return, ln(close / prev) AS log_return
  FROM (SELECT *, lag(close) OVER ({W}) AS prev FROM bars))"""

SERIES_COLS = (
    "simple_return log_return abs_return squared_return rolling_return_5 rolling_return_10 rolling_return_20 "
    "rolling_volatility_20 rolling_volatility_50 realized_volatility_20 downside_volatility_20 high_low_range_pct "
    "close_position volume_zscore_20 return_zscore_20"
)


def series_sql(src: str = "rets", part: str = W) -> str:
    def f(n: int) -> str:
        return f"({part} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"

    return f"""
  SELECT *, abs(log_return) AS abs_return, log_return * log_return AS squared_return,
    {", ".join(f"close / lag(close, {k}) OVER ({part}) - 1 AS rolling_return_{k}" for k in (5, 10, 20))},
    stddev_samp(log_return) OVER {f(19)} AS rolling_volatility_20,
    stddev_samp(log_return) OVER {f(49)} AS rolling_volatility_50,
    CASE WHEN count(log_return) OVER {f(19)} >= 2 THEN sqrt(sum(log_return * log_return) OVER {f(19)}) END AS realized_volatility_20,
    stddev_samp(CASE WHEN log_return < 0 THEN log_return END) OVER {f(19)} AS downside_volatility_20,
    (high - low) / nullif(close, 0) AS high_low_range_pct, (close - low) / nullif(high - low, 0) AS close_position,
    CASE WHEN count(volume) OVER {f(19)} >= 2 THEN (volume - avg(volume) OVER {f(19)}) / nullif(stddev_pop(volume) OVER {f(19)}, 0) END AS volume_zscore_20,
    CASE WHEN count(log_return) OVER {f(19)} >= 2 THEN (log_return - avg(log_return) OVER {f(19)}) / nullif(stddev_pop(log_return) OVER {f(19)}, 0) END AS return_zscore_20
  FROM {src}"""


@query("bar_returns", 'SELECT symbol, "interval", bar_index, simple_return, log_return, abs(log_return) AS abs_return, log_return * log_return AS squared_return FROM rets', RET_SQL, "simple_return log_return abs_return squared_return")
def _(spark, sf):
    return series.bar_returns(bars(spark, sf)).select(*KEYS, "bar_index", "simple_return", "log_return", "abs_return", "squared_return")


@query(
    "bar_return_series",
    f'SELECT symbol, "interval", bar_index, {", ".join(SERIES_COLS.split())} FROM ({series_sql()})',
    RET_SQL,
    SERIES_COLS,
)
def _(spark, sf):
    return series.return_series(bars(spark, sf)).select(*KEYS, "bar_index", *SERIES_COLS.split())


FRAG_SQL = f"""
{BARS_SQL},
frag AS (SELECT * FROM bars WHERE bar_index % 40 < 25),
seg AS (
  SELECT *, sum(CASE WHEN bar_index - p <> 1 THEN 1 ELSE 0 END) OVER ({W}) AS segment
  FROM (SELECT *, lag(bar_index) OVER ({W}) AS p FROM frag)),
segret AS (
  SELECT *, close / prev - 1 AS simple_return, ln(close / prev) AS log_return
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, "interval", segment ORDER BY bar_index) AS prev FROM seg))"""


@query(
    "segment_return_series",
    f"""SELECT symbol, "interval", segment, bar_index, {", ".join(SERIES_COLS.split())},
        CASE WHEN prev IS NULL THEN 1.0 ELSE 0.0 END AS is_segment_start
        FROM ({series_sql("segret", 'PARTITION BY symbol, "interval", segment ORDER BY bar_index')})""",
    FRAG_SQL,
    SERIES_COLS + " is_segment_start",
    "segment",
)
def _(spark, sf):
    frag = bars(spark, sf).where(F.col("bar_index") % 40 < 25)
    return series.segment_return_series(frag).select(*KEYS, "segment", "bar_index", *SERIES_COLS.split(), "is_segment_start")


@query(
    "cumulative_and_excess_returns",
    f"""SELECT symbol, "interval", bar_index, rolling_log_return, cumulative_log_return, log_return - b AS excess_return
    FROM (SELECT *, sum(log_return) OVER {frame(-9, 0)} AS rolling_log_return,
                 sum(coalesce(log_return, 0)) OVER ({W}) AS cumulative_log_return FROM rets)
    LEFT JOIN (SELECT open_time_ms, avg(log_return) AS b FROM rets GROUP BY 1) USING (open_time_ms)""",
    RET_SQL,
    "rolling_log_return cumulative_log_return excess_return",
)
def _(spark, sf):
    b = bars(spark, sf)
    bench = series.bar_returns(b).groupBy("open_time_ms").agg(F.avg("log_return").alias("benchmark_log_return"))
    return series.long_horizon_returns(b, bench).select(
        *KEYS, "bar_index", "rolling_log_return", "cumulative_log_return", "excess_return"
    )


@query(
    "annualized_returns",
    """SELECT symbol, "interval", m AS annualized_log_return, exp(m) - 1 AS annualized_return
    FROM (SELECT symbol, "interval", avg(log_return) * 2190 AS m FROM rets GROUP BY 1, 2)""",
    RET_SQL,
    "annualized_log_return annualized_return",
)
def _(spark, sf):
    return series.annualized(series.bar_returns(bars(spark, sf)), 2190)


EWMA_SQL = f"""
{RET_SQL},
sq AS (SELECT symbol, "interval", bar_index, log_return * log_return AS x, row_number() OVER ({W}) AS k FROM rets WHERE log_return IS NOT NULL),
ewma AS (
  SELECT a.symbol, a."interval", a.bar_index,
         sum(CASE WHEN b.k = 1 THEN b.x ELSE 0.06 * b.x END * pow(0.94, a.k - b.k)) AS v
  FROM sq a JOIN sq b ON a.symbol = b.symbol AND a."interval" = b."interval" AND b.k <= a.k AND b.k > a.k - 600
  GROUP BY 1, 2, 3),
vols AS (
  SELECT r.symbol, r."interval", r.bar_index, stddev_samp(log_return) OVER {frame(-19, 0)} AS rv,
         CASE WHEN count(log_return) OVER {frame(-19, 0)} >= 2 THEN sqrt(sum(log_return * log_return) OVER {frame(-19, 0)}) END AS zv
  FROM rets r)"""


@query("ewma_volatility", 'SELECT symbol, "interval", bar_index, sqrt(v) AS ewma_volatility FROM rets LEFT JOIN ewma USING (symbol, "interval", bar_index)', EWMA_SQL, "ewma_volatility")
def _(spark, sf):
    out = series.ewma_variance(series.bar_returns(bars(spark, sf)))
    return out.select(*KEYS, "bar_index", F.sqrt("ewma_variance").alias("ewma_volatility"))


@query(
    "volatility_state",
    """SELECT *, CASE WHEN volatility_percentile <= 25 THEN 'LOW' WHEN volatility_percentile <= 75 THEN 'MID'
                     WHEN volatility_percentile <= 95 THEN 'HIGH' ELSE 'EXTREME' END AS regime
    FROM (SELECT c.*, (SELECT avg(CASE WHEN sqrt(e.v) <= c.ewma_volatility_current THEN 1.0 ELSE 0.0 END) * 100 FROM ewma e
                       WHERE e.symbol = c.symbol AND e."interval" = c."interval") AS volatility_percentile
          FROM (SELECT symbol, "interval", last(rv ORDER BY bar_index) AS rolling_volatility_current,
                       last(zv ORDER BY bar_index) AS realized_volatility_current,
                       last(sqrt(v) ORDER BY bar_index) AS ewma_volatility_current
                FROM vols JOIN ewma USING (symbol, "interval", bar_index) GROUP BY 1, 2) c)""",
    EWMA_SQL,
    "rolling_volatility_current realized_volatility_current ewma_volatility_current volatility_percentile",
)
def _(spark, sf):
    return series.volatility_now(series.bar_returns(bars(spark, sf)))


REGIME_SQL = f"""
{RET_SQL},
pre AS (
  SELECT *, max(close) OVER {frame(-49, 0)} AS top, close / lag(close, 50) OVER ({W}) - 1 AS rolling_return_50,
         stddev_samp(log_return) OVER {frame(-49, 0)} AS rolling_volatility_50, max(close) OVER ({W}) AS peak FROM rets),
q AS (SELECT symbol, "interval", quantile_cont(rolling_volatility_50, 0.25) AS q25, quantile_cont(rolling_volatility_50, 0.75) AS q75,
             quantile_cont(rolling_volatility_50, 0.9) AS q90 FROM pre GROUP BY 1, 2),
lab AS (
  SELECT pre.*, greatest(coalesce(1.5 * rolling_volatility_50 * sqrt(50.0), 0.02), 0.02) AS trend_threshold,
         CASE WHEN rolling_volatility_50 IS NULL THEN 'normal_vol' WHEN rolling_volatility_50 <= q25 THEN 'low_vol'
              WHEN rolling_volatility_50 >= q90 THEN 'extreme_vol' WHEN rolling_volatility_50 >= q75 THEN 'high_vol' ELSE 'normal_vol' END AS volatility_regime
  FROM pre JOIN q USING (symbol, "interval")),
regime AS (
  SELECT symbol, "interval", bar_index, volatility_regime, trend_regime, (close / peak - 1) * 100 AS drawdown_pct,
         top AS rolling_max_close_50, (close / top - 1) * 100 AS distance_to_rolling_high_50_pct, rolling_return_50,
         rolling_volatility_50, trend_threshold, volatility_regime || '_' || trend_regime AS regime_label
  FROM (SELECT *, CASE WHEN rolling_return_50 > trend_threshold THEN 'uptrend' WHEN rolling_return_50 < -trend_threshold THEN 'downtrend' ELSE 'range' END AS trend_regime FROM lab))"""
REGIME_FLOATS = "drawdown_pct rolling_max_close_50 distance_to_rolling_high_50_pct rolling_return_50 rolling_volatility_50 trend_threshold"


@query("bar_regimes", "SELECT * FROM regime", REGIME_SQL, REGIME_FLOATS)
def _(spark, sf):
    return series.regimes(bars(spark, sf)).select(
        *KEYS, "bar_index", "volatility_regime", "trend_regime", *REGIME_FLOATS.split(), "regime_label"
    )


@query(
    "regime_distribution",
    """SELECT symbol, "interval", field, value, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol, "interval", field) AS pct
    FROM (SELECT symbol, "interval", 'volatility_regime' AS field, volatility_regime AS value FROM regime
          UNION ALL SELECT symbol, "interval", 'trend_regime', trend_regime FROM regime
          UNION ALL SELECT symbol, "interval", 'regime_label', regime_label FROM regime) GROUP BY 1, 2, 3, 4""",
    REGIME_SQL,
    "pct",
)
def _(spark, sf):
    return series.regime_distribution(series.regimes(bars(spark, sf)))


LIQ_SQL = f"""
{RET_SQL},
l1 AS (SELECT *, ln(high / low) AS range_log, volume * close AS quote_volume FROM rets),
l2 AS (
  SELECT *, CASE WHEN bar_index >= 49 THEN median(range_log) OVER {frame(-49, 0)} END AS range_vol_base,
         CASE WHEN bar_index >= 49 THEN median(quote_volume) OVER {frame(-49, 0)} END AS volume_base FROM l1),
l3 AS (SELECT *, range_log / (range_vol_base + 1e-12) AS vol_ratio, quote_volume / (volume_base + 1e-12) AS volume_ratio FROM l2),
l4 AS (SELECT *, vol_ratio / (volume_ratio + 1e-12) AS impact_score FROM l3),
l5 AS (SELECT *, CASE WHEN count(impact_score) OVER {frame(-99, 0)} = 100 THEN median(impact_score) OVER {frame(-99, 0)} END AS impact_median FROM l4),
l6 AS (SELECT *, abs(impact_score - impact_median) AS dev FROM l5),
l7 AS (SELECT *, CASE WHEN count(dev) OVER {frame(-99, 0)} = 100 THEN median(dev) OVER {frame(-99, 0)} END AS impact_mad FROM l6),
l8 AS (SELECT *, (impact_score - impact_median) / (1.4826 * impact_mad + 1e-12) AS impact_z FROM l7),
liq AS (
  SELECT symbol, "interval", bar_index, range_log, vol_ratio, volume_ratio, impact_score, impact_median, impact_mad, impact_z,
    CASE WHEN impact_z IS NULL OR volume_ratio IS NULL OR vol_ratio IS NULL THEN 'UNKNOWN'
         WHEN impact_z > 2 AND volume_ratio < 0.8 THEN 'LOW_LIQUIDITY_SHOCK' WHEN impact_z > 2 AND volume_ratio >= 1.5 THEN 'EVENT_REPRICING'
         WHEN impact_z < -1 AND volume_ratio >= 1.5 THEN 'ABSORPTION' WHEN volume_ratio < 0.5 AND vol_ratio < 0.8 THEN 'QUIET_THIN_MARKET'
         ELSE 'NORMAL_LIQUIDITY' END AS liquidity_state FROM l8)"""
LIQ_FLOATS = "range_log vol_ratio volume_ratio impact_score impact_median impact_mad impact_z"


@query("liquidity_proxy", "SELECT * FROM liq", LIQ_SQL, LIQ_FLOATS)
def _(spark, sf):
    return series.liquidity_proxy(bars(spark, sf)).select(*KEYS, "bar_index", *LIQ_FLOATS.split(), "liquidity_state")


STATES = ("LOW_LIQUIDITY_SHOCK", "EVENT_REPRICING", "ABSORPTION", "QUIET_THIN_MARKET", "NORMAL_LIQUIDITY")


@query(
    "liquidity_summary",
    f"""SELECT symbol, "interval", count(*) AS total_rows, count(*) FILTER (liquidity_state <> 'UNKNOWN') AS valid_rows,
    {", ".join(f"count(*) FILTER (liquidity_state = '{s}') AS {s.lower()}_count" for s in STATES)},
    avg(impact_score) AS mean_impact_score, median(impact_score) AS median_impact_score FROM liq GROUP BY 1, 2""",
    LIQ_SQL,
    "mean_impact_score median_impact_score",
)
def _(spark, sf):
    return series.liquidity_summary(series.liquidity_proxy(bars(spark, sf)))


@query(
    "rolling_correlation",
    """SELECT a.symbol, a.open_time_ms, CASE WHEN count(*) OVER f >= 2 THEN CASE WHEN isnan(corr(a.log_return, b.log_return) OVER f) THEN NULL ELSE corr(a.log_return, b.log_return) OVER f END END AS rolling_corr
    FROM rets a JOIN rets b ON b.symbol = 'S000000' AND a.open_time_ms = b.open_time_ms
    WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL AND a.symbol <> 'S000000'
    WINDOW f AS (PARTITION BY a.symbol ORDER BY a.open_time_ms ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    RET_SQL,
    "rolling_corr",
)
def _(spark, sf):
    from ...operators.chunks import dense_index
    from ..derive import STEP

    r = series.bar_returns(bars(spark, sf)).where(F.col("log_return").isNotNull()).select("symbol", "open_time_ms", F.col("log_return").alias("x"))
    ref = r.where(F.col("symbol") == "S000000").select("open_time_ms", F.col("x").alias("y"))
    pairs = dense_index(r.where(F.col("symbol") != "S000000").join(ref, "open_time_ms"), ["symbol"], "open_time_ms", STEP * 16384, name="pos")
    return series.rolling_correlation(pairs, 30, ["symbol"], "pos").select("symbol", "open_time_ms", "rolling_corr")


@query(
    "higher_close_times",
    """SELECT symbol, "interval", bar_index, open_time_ms + 14400000 AS close_time_ms FROM bars""",
    BARS_SQL,
)
def _(spark, sf):
    return series.with_close_time(bars(spark, sf).drop("close_time_ms")).select(*KEYS, "bar_index", "close_time_ms")


DAILY_SQL = f"""
{BARS_SQL},
daily AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS bar_index
  FROM (SELECT symbol, '1d' AS "interval", s AS open_time_ms, s + 86400000 - 1 AS close_time_ms, first(open ORDER BY open_time_ms) AS open,
       max(high) AS high, min(low) AS low, last(close ORDER BY open_time_ms) AS close, sum(volume) AS volume
    FROM (SELECT *, open_time_ms - open_time_ms % 86400000 AS s FROM bars) GROUP BY symbol, s)),
dret AS (SELECT *, ln(close / lag(close) OVER ({W})) AS lr FROM daily),
dvol AS (
  SELECT *, close / lag(close, 19) OVER ({W}) - 1 AS ret20, sqrt(sum(lr * lr) OVER {frame(-18, 0)}) AS vol19,
         CASE WHEN count(lr) OVER {frame(-19, 0)} = 20 THEN sqrt(sum(lr * lr) OVER {frame(-19, 0)}) END AS vol20,
         close / max(high) OVER {frame(-19, 0)} - 1 AS dh, close / min(low) OVER {frame(-19, 0)} - 1 AS dl FROM dret),
dbase AS (SELECT *, median(vol20) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base FROM dvol),
htf AS (
  SELECT symbol, "interval", bar_index, open_time_ms, close_time_ms, close, bar_index + 1 AS available_bars,
    CASE WHEN bar_index >= 19 THEN 'available' ELSE 'insufficient_history' END AS history_status,
    CASE WHEN bar_index >= 19 THEN ret20 END AS pre_simple_ret_20, CASE WHEN bar_index >= 19 THEN vol19 END AS realized_vol_20,
    CASE WHEN bar_index >= 19 THEN dh END AS distance_to_high, CASE WHEN bar_index >= 19 THEN dl END AS distance_to_low,
    CASE WHEN bar_index >= 19 THEN CASE WHEN ret20 > greatest(0.002, vol19) THEN 'uptrend' WHEN ret20 < -greatest(0.002, vol19) THEN 'downtrend' ELSE 'range' END END AS trend_regime,
    CASE WHEN bar_index >= 19 THEN CASE WHEN base > 0 AND vol19 > base * 1.5 THEN 'high_vol' WHEN base > 0 AND vol19 < base * 0.75 THEN 'low_vol' ELSE 'normal_vol' END END AS volatility_regime
  FROM dbase)"""
HTF_FLOATS = "close pre_simple_ret_20 realized_vol_20 distance_to_high distance_to_low"


def daily(spark, sf):
    from ...operators.chunks import dense_index

    return dense_index(series.resample(bars(spark, sf), "1d"), list(KEYS), "open_time_ms", 86_400_000 * 365)


@query("higher_timeframe_state", "SELECT * FROM htf", DAILY_SQL, HTF_FLOATS)
def _(spark, sf):
    return series.htf_state(daily(spark, sf))


@query(
    "drawdown_series",
    f"""SELECT symbol, "interval", bar_index, wealth, max(wealth) OVER ({W}) AS peak, wealth / max(wealth) OVER ({W}) - 1 AS drawdown
    FROM (SELECT *, exp(sum(log_return) OVER ({W})) AS wealth FROM rets WHERE log_return IS NOT NULL)""",
    RET_SQL,
    "wealth peak drawdown",
)
def _(spark, sf):
    return series.drawdown(series.bar_returns(bars(spark, sf))).select(*KEYS, "bar_index", "wealth", "peak", "drawdown")


@query(
    "max_drawdown_span",
    f"""WITH p AS (SELECT *, max(close) OVER ({W}) AS pk FROM bars),
     s AS (SELECT *, max(CASE WHEN close = pk AND coalesce(prevpk < pk, true) THEN bar_index END) OVER ({W}) AS st
           FROM (SELECT *, lag(pk) OVER ({W}) AS prevpk FROM p)),
     m AS (SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY 1 - close / pk DESC, bar_index) AS rn FROM s)
    SELECT symbol, "interval", (close / pk - 1) * 100 AS max_drawdown_pct, CASE WHEN pk > close THEN st END AS drawdown_start,
           CASE WHEN pk > close THEN bar_index END AS drawdown_end FROM m WHERE rn = 1""",
    BARS_SQL,
    "max_drawdown_pct",
)
def _(spark, sf):
    return series.max_drawdown(bars(spark, sf), "close")


@query(
    "trailing_runs",
    f"""SELECT symbol, "interval", bar_index,
      bar_index - coalesce(max(CASE WHEN NOT (close >= open) THEN bar_index END) OVER ({W}), -1) AS bull_run,
      bar_index - coalesce(max(CASE WHEN NOT (close < open) THEN bar_index END) OVER ({W}), -1) AS bear_run FROM bars""",
    BARS_SQL,
)
def _(spark, sf):
    up = F.col("close") >= F.col("open")
    return series.trailing_runs(bars(spark, sf), {"bull_run": up, "bear_run": ~up}).select(*KEYS, "bar_index", "bull_run", "bear_run")


@query(
    "longest_streaks",
    f"""SELECT symbol, "interval", max(bar_index - coalesce(a, -1)) AS max_consecutive_wins, max(bar_index - coalesce(b, -1)) AS max_consecutive_losses
    FROM (SELECT *, max(CASE WHEN NOT coalesce(simple_return > 0, false) THEN bar_index END) OVER ({W}) AS a,
                 max(CASE WHEN NOT coalesce(simple_return < 0, false) THEN bar_index END) OVER ({W}) AS b FROM rets) GROUP BY 1, 2""",
    RET_SQL,
)
def _(spark, sf):
    return series.longest_streaks(series.bar_returns(bars(spark, sf)), "simple_return", KEYS, "bar_index")


@query(
    "atr_slope_volume_rank",
    f"""SELECT symbol, "interval", bar_index, tr AS true_range, avg(tr) OVER {frame(-13, 0)} AS atr,
       regr_slope(ln(close), bar_index) OVER {frame(-19, 0)} AS slope_log_close,
       len(list_filter(vs, lambda x: x <= volume)) / len(vs) AS volume_rank
    FROM (SELECT *, coalesce(greatest(high - low, abs(high - prev), abs(low - prev)), high - low) AS tr,
                 list(volume) OVER {frame(-99, 0)} AS vs FROM rets)""",
    RET_SQL,
    "true_range atr slope_log_close volume_rank",
)
def _(spark, sf):
    return series.atr_and_slope(bars(spark, sf)).select(*KEYS, "bar_index", "true_range", "atr", "slope_log_close", "volume_rank")
