"""Decision-time features joined to events and observations."""

from pyspark.sql import functions as F

from ...operators import asof, features, universe
from ...operators.chunks import KEYS
from ..derive import BARS_SQL, EVENTS_SQL, STEP, bars, trade_events
from ..registry import query
from .series import DAILY_SQL, HTF_FLOATS, RET_SQL, W, daily, frame

SLOT = STEP * 4096

LEGACY = (
    "price_proxy event_body event_upper_wick event_lower_wick event_range event_volume event_vol_ratio_5 pre_ret_3 pre_ret_5 "
    "pre_ret_10 pre_vol_3 pre_vol_5 pre_vol_10 prev_high10_dist_pct prev_low10_dist_pct event_upper_ratio event_lower_ratio event_body_ratio"
)


def div(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) >= 1e-12 THEN ({a}) / ({b}) END"


LEGACY_SQL = f"""
{RET_SQL}, {EVENTS_SQL},
legacy AS (
  SELECT symbol, "interval", bar_index, (high + low) / 2 AS price_proxy, abs(close - open) AS event_body,
    high - greatest(open, close) AS event_upper_wick, least(open, close) - low AS event_lower_wick, high - low AS event_range, volume AS event_volume,
    volume / nullif(avg(volume) OVER {frame(-5, -1)}, 0) AS event_vol_ratio_5,
    {", ".join(f"lag(close, 1) OVER ({W}) / lag(close, {n}) OVER ({W}) - 1 AS pre_ret_{n}" for n in (3, 5, 10))},
    {", ".join(f"CASE WHEN bar_index >= {n} THEN stddev_pop(simple_return) OVER {frame(1 - n, -1)} END AS pre_vol_{n}" for n in (3, 5, 10))},
    max(high) OVER {frame(-10, -1)} / ((high + low) / 2) - 1 AS prev_high10_dist_pct,
    min(low) OVER {frame(-10, -1)} / ((high + low) / 2) - 1 AS prev_low10_dist_pct,
    (high - greatest(open, close)) / nullif(high - low, 0) AS event_upper_ratio,
    (least(open, close) - low) / nullif(high - low, 0) AS event_lower_ratio, abs(close - open) / nullif(high - low, 0) AS event_body_ratio,
    bar_index - coalesce(max(CASE WHEN NOT close >= open THEN bar_index END) OVER ({W}), -1) AS bull_run_count,
    bar_index - coalesce(max(CASE WHEN NOT close < open THEN bar_index END) OVER ({W}), -1) AS bear_run_count
  FROM rets)"""


@query(
    "event_features_stored",
    f'SELECT event_id, side, {", ".join(LEGACY.split())}, bull_run_count, bear_run_count FROM trade_events JOIN legacy USING (symbol, "interval", bar_index)',
    LEGACY_SQL,
    LEGACY,
)
def _(spark, sf):
    f = features.legacy_features(bars(spark, sf)).select(*KEYS, "bar_index", *LEGACY.split(), "bull_run_count", "bear_run_count")
    return trade_events(spark, sf).join(f, [*KEYS, "bar_index"]).select("event_id", "side", *LEGACY.split(), "bull_run_count", "bear_run_count")


P20, IN = frame(-20, -1), frame(-19, -1)
ENH = (
    "pre_ret_3 pre_ret_5 pre_ret_10 pre_ret_20 pre_max_drawdown_20 pre_volatility_20 pre_bear_ratio_20 pre_avg_body_20 pre_avg_range_20 "
    "pre_avg_volume_20 event_body_pct event_range_pct event_body_ratio event_upper_wick_ratio event_lower_wick_ratio event_close_position "
    "event_is_bullish event_is_bearish event_volume_ratio_20 event_range_vs_avg_range_20 event_body_vs_avg_body_20 break_prev_low_20 "
    "recover_prev_low_20 distance_to_prev_low_pct pre_ret_20_zscore capitulation_score log_ret_1 pre_log_ret_5 pre_log_ret_10 pre_log_ret_20 "
    "realized_vol_20 atr_14 range_pct range_atr_ratio body_atr_ratio upper_wick_atr_ratio lower_wick_atr_ratio volume_zscore_20 range_zscore_20 "
    "close_position distance_to_prev_high_20 distance_to_prev_low_20 break_prev_high_20 fake_breakout_down fake_breakout_up trend_slope_20"
)
ENH_INT = "pre_down_bar_count_20 pre_consecutive_bear_count"
ENH_TEXT = "volatility_regime time_of_day_bucket"

ENH_BASE = f"""
{RET_SQL},
tr AS (SELECT *, coalesce(greatest(high - low, abs(high - prev), abs(low - prev)), high - low) AS tr, high - low AS span, abs(close - open) AS body,
              high - greatest(open, close) AS uw, least(open, close) - low AS lw FROM rets),
e1 AS (
  SELECT *, max(high) OVER {P20} AS hi, min(low) OVER {P20} AS lo,
    (sum(tr) OVER {frame(-13, 0)} - first_value(tr) OVER {frame(-13, 0)} + first_value(span) OVER {frame(-13, 0)}) / count(*) OVER {frame(-13, 0)} AS atr_14,
    {", ".join(f"CASE WHEN bar_index >= 2 THEN lag(close) OVER ({W}) / first_value(close) OVER {frame(-n, -1)} - 1 END AS pre_ret_{n}" for n in (3, 5, 10, 20))},
    {", ".join(f"CASE WHEN bar_index >= 2 THEN ln(lag(close) OVER ({W}) / first_value(close) OVER {frame(-n, -1)}) END AS pre_log_ret_{n}" for n in (5, 10, 20))},
    list(close) OVER {P20} AS cs,
    stddev_pop(simple_return) OVER {IN} AS pre_volatility_20, stddev_pop(log_return) OVER {IN} AS realized_vol_20,
    coalesce(sum(CASE WHEN close < open THEN 1 ELSE 0 END) OVER {P20}, 0) AS pre_down_bar_count_20,
    avg(CASE WHEN close < open THEN 1.0 ELSE 0.0 END) OVER {P20} AS pre_bear_ratio_20,
    coalesce(bar_index - 1 - coalesce(max(CASE WHEN NOT close < open THEN bar_index END) OVER {P20}, min(bar_index) OVER {P20} - 1), 0) AS pre_consecutive_bear_count,
    avg(body) OVER {P20} AS pre_avg_body_20, avg(span) OVER {P20} AS pre_avg_range_20, avg(volume) OVER {P20} AS pre_avg_volume_20,
    CASE WHEN bar_index >= 2 THEN {div(f"volume - avg(volume) OVER {P20}", f"stddev_pop(volume) OVER {P20}")} END AS volume_zscore_20,
    CASE WHEN bar_index >= 2 THEN {div(f"span - avg(span) OVER {P20}", f"stddev_pop(span) OVER {P20}")} END AS range_zscore_20,
    CASE WHEN bar_index >= 2 THEN regr_slope(ln(close), bar_index) OVER {P20} END AS trend_slope_20,
    (((open_time_ms + 28800000) // 3600000) % 24) AS hr
  FROM tr),
e2 AS (
  SELECT *, CASE WHEN len(cs) >= 2 THEN abs(list_min(list_transform(cs, lambda x, i: x / list_max(cs[1:i]) - 1))) END AS pre_max_drawdown_20,
    body / open AS event_body_pct, span / open AS event_range_pct, span / open AS range_pct, {div("body", "span")} AS event_body_ratio,
    {div("uw", "span")} AS event_upper_wick_ratio, {div("lw", "span")} AS event_lower_wick_ratio,
    {div("close - low", "span")} AS event_close_position, {div("close - low", "span")} AS close_position,
    CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS event_is_bullish, CASE WHEN close < open THEN 1.0 ELSE 0.0 END AS event_is_bearish,
    {div("volume", "pre_avg_volume_20")} AS event_volume_ratio_20, {div("span", "pre_avg_range_20")} AS event_range_vs_avg_range_20,
    {div("body", "pre_avg_body_20")} AS event_body_vs_avg_body_20,
    CASE WHEN low < lo THEN 1.0 ELSE 0.0 END AS break_prev_low_20, CASE WHEN low < lo AND close > lo THEN 1.0 ELSE 0.0 END AS recover_prev_low_20,
    CASE WHEN low < lo AND close > lo THEN 1.0 ELSE 0.0 END AS fake_breakout_down, CASE WHEN high > hi THEN 1.0 ELSE 0.0 END AS break_prev_high_20,
    CASE WHEN high > hi AND close < hi THEN 1.0 ELSE 0.0 END AS fake_breakout_up,
    close / lo - 1 AS distance_to_prev_low_pct, close / lo - 1 AS distance_to_prev_low_20, close / hi - 1 AS distance_to_prev_high_20,
    {div("pre_ret_20", "pre_volatility_20")} AS pre_ret_20_zscore, ln(close / prev) AS log_ret_1,
    {div("span", "atr_14")} AS range_atr_ratio, {div("body", "atr_14")} AS body_atr_ratio, {div("uw", "atr_14")} AS upper_wick_atr_ratio,
    {div("lw", "atr_14")} AS lower_wick_atr_ratio,
    CASE WHEN realized_vol_20 < 0.003 THEN 'LOW' WHEN realized_vol_20 > 0.015 THEN 'HIGH' WHEN realized_vol_20 IS NOT NULL THEN 'NORMAL' END AS volatility_regime,
    CASE WHEN hr < 8 THEN 'BJT_00_08' WHEN hr < 16 THEN 'BJT_08_16' ELSE 'BJT_16_24' END AS time_of_day_bucket
  FROM e1),
enhanced AS (
  SELECT *, (coalesce(greatest(0, least(1, -pre_ret_20 / 0.10)), 0) + coalesce(greatest(0, least(1, pre_max_drawdown_20 / 0.12)), 0)
    + coalesce(greatest(0, least(1, (event_volume_ratio_20 - 1) / 4)), 0) + coalesce(greatest(0, least(1, event_lower_wick_ratio / 0.7)), 0)
    + coalesce(greatest(0, least(1, (event_close_position - 0.3) / 0.7)), 0)) / 5 * 100 AS capitulation_score FROM e2)"""


# DuckDB's greatest/least skip NULLs, so the ramps guard their input
ENH_BASE = (
    ENH_BASE.replace("coalesce(greatest(0, least(1, -pre_ret_20 / 0.10)), 0)", "CASE WHEN pre_ret_20 IS NULL THEN 0 ELSE greatest(0, least(1, -pre_ret_20 / 0.10)) END")
    .replace("coalesce(greatest(0, least(1, pre_max_drawdown_20 / 0.12)), 0)", "CASE WHEN pre_max_drawdown_20 IS NULL THEN 0 ELSE greatest(0, least(1, pre_max_drawdown_20 / 0.12)) END")
    .replace("coalesce(greatest(0, least(1, (event_volume_ratio_20 - 1) / 4)), 0)", "CASE WHEN event_volume_ratio_20 IS NULL THEN 0 ELSE greatest(0, least(1, (event_volume_ratio_20 - 1) / 4)) END")
    .replace("coalesce(greatest(0, least(1, event_lower_wick_ratio / 0.7)), 0)", "CASE WHEN event_lower_wick_ratio IS NULL THEN 0 ELSE greatest(0, least(1, event_lower_wick_ratio / 0.7)) END")
    .replace("coalesce(greatest(0, least(1, (event_close_position - 0.3) / 0.7)), 0)", "CASE WHEN event_close_position IS NULL THEN 0 ELSE greatest(0, least(1, (event_close_position - 0.3) / 0.7)) END")
)
ENH_ALL = f"{ENH} {ENH_INT} {ENH_TEXT}"


@query(
    "event_features_enhanced",
    f'SELECT event_id, {", ".join(ENH_ALL.split())} FROM trade_events JOIN enhanced USING (symbol, "interval", bar_index)',
    f"{ENH_BASE}, {EVENTS_SQL}",
    ENH,
    ENH_INT,
)
def _(spark, sf):
    f = features.enhanced_features(bars(spark, sf)).select(*KEYS, "bar_index", *ENH_ALL.split())
    return trade_events(spark, sf).join(f, [*KEYS, "bar_index"]).select("event_id", *ENH_ALL.split())


FACT = (
    "body_pct body_to_range upper_wick_ratio lower_wick_ratio upper_wick_atr_ratio lower_wick_atr_ratio close_position range_pct range_atr_ratio "
    "body_atr_ratio log_ret_1 pre_ret_3 pre_ret_5 pre_ret_10 pre_ret_20 pre_log_ret_5 pre_log_ret_10 down_run_length up_run_length trend_slope_20 "
    "distance_to_prev_high_20 distance_to_prev_low_20 break_prev_high_20 break_prev_low_20 reclaim_prev_low_20 reject_prev_high_20 break_depth "
    "reclaim_strength true_range atr_14 realized_vol_20 realized_vol_50 range_zscore_20 volume_ratio_5 volume_ratio_20 volume_zscore_20 "
    "quote_volume_proxy quote_volume_zscore_20 volume_climax_score volume_absorption_score volume_dump_score reversal_candle_score "
    "panic_drop_score false_breakdown_score fake_breakout_score hour_of_day day_of_week"
)
FACT_TEXT = "volatility_regime time_session trend_regime"


def unit(x: str, s: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0.0, least(1.0, ({x}) / {s})) END"


def score(*parts: str) -> str:
    return f"list_avg([{', '.join(f'cast({p} AS DOUBLE)' for p in parts)}]) * 100"


def run_sql(cond: str) -> str:
    return f"coalesce(bar_index - 1 - coalesce(max(CASE WHEN NOT {cond} THEN bar_index END) OVER {P20}, min(bar_index) OVER {P20} - 1), 0)"


FACT_SQL = f"""
{RET_SQL},
f0 AS (SELECT *, coalesce(greatest(high - low, abs(high - prev), abs(low - prev)), high - low) AS true_range, high - low AS span, abs(close - open) AS body,
              high - greatest(open, close) AS uw, least(open, close) - low AS lw, close * volume AS quote_volume_proxy FROM rets),
f1 AS (
  SELECT *, max(high) OVER {P20} AS hi, min(low) OVER {P20} AS lo, avg(true_range) OVER {frame(-13, 0)} AS atr_14,
    {", ".join(f"prev / lag(close, {n}) OVER ({W}) - 1 AS pre_ret_{n}" for n in (3, 5, 10, 20))},
    {", ".join(f"ln(prev / lag(close, {n}) OVER ({W})) AS pre_log_ret_{n}" for n in (5, 10))},
    {", ".join(f"CASE WHEN bar_index >= {n} THEN stddev_pop(log_return) OVER {frame(1 - n, -1)} END AS realized_vol_{n}" for n in (20, 50))},
    volume / avg(volume) OVER {frame(-5, -1)} AS volume_ratio_5, volume / avg(volume) OVER {P20} AS volume_ratio_20,
    CASE WHEN bar_index >= 2 THEN regr_slope(ln(close), bar_index) OVER {P20} END AS trend_slope_20,
    CASE WHEN bar_index >= 2 THEN {div(f"span - avg(span) OVER {P20}", f"stddev_pop(span) OVER {P20}")} END AS range_zscore_20,
    CASE WHEN bar_index >= 2 THEN {div(f"volume - avg(volume) OVER {P20}", f"stddev_pop(volume) OVER {P20}")} END AS volume_zscore_20,
    CASE WHEN bar_index >= 2 THEN {div(f"quote_volume_proxy - avg(quote_volume_proxy) OVER {P20}", f"stddev_pop(quote_volume_proxy) OVER {P20}")} END AS quote_volume_zscore_20,
    {run_sql("close > open")} AS up_run_length, {run_sql("close < open")} AS down_run_length
  FROM f0),
f2 AS (
  SELECT *, body / open AS body_pct, {div("body", "span")} AS body_to_range, {div("uw", "span")} AS upper_wick_ratio, {div("lw", "span")} AS lower_wick_ratio,
    {div("uw", "atr_14")} AS upper_wick_atr_ratio, {div("lw", "atr_14")} AS lower_wick_atr_ratio, {div("close - low", "span")} AS close_position,
    span / open AS range_pct, {div("span", "atr_14")} AS range_atr_ratio, {div("body", "atr_14")} AS body_atr_ratio, ln(close / prev) AS log_ret_1,
    close / hi - 1 AS distance_to_prev_high_20, close / lo - 1 AS distance_to_prev_low_20,
    CASE WHEN high > hi THEN 1.0 ELSE 0.0 END AS break_prev_high_20, CASE WHEN low < lo THEN 1.0 ELSE 0.0 END AS break_prev_low_20,
    CASE WHEN low < lo AND close > lo THEN 1.0 ELSE 0.0 END AS reclaim_prev_low_20, CASE WHEN high > hi AND close < hi THEN 1.0 ELSE 0.0 END AS reject_prev_high_20,
    CASE WHEN low < lo THEN (lo - low) / lo ELSE 0.0 END AS break_depth, CASE WHEN low < lo AND close > lo THEN (close - lo) / lo ELSE 0.0 END AS reclaim_strength,
    CASE WHEN realized_vol_20 < 0.003 THEN 'LOW' WHEN realized_vol_20 > 0.015 THEN 'HIGH' WHEN realized_vol_20 IS NOT NULL THEN 'NORMAL' END AS volatility_regime,
    ((open_time_ms + 28800000) // 3600000) % 24 AS hour_of_day, (((open_time_ms + 28800000) // 86400000) + 3) % 7 AS day_of_week,
    CASE WHEN trend_slope_20 < -0.001 THEN 'DOWN' WHEN trend_slope_20 > 0.001 THEN 'UP' WHEN trend_slope_20 IS NOT NULL THEN 'FLAT' END AS trend_regime
  FROM f1),
factors AS (
  SELECT *, CASE WHEN hour_of_day < 8 THEN 'BJT_00_08' WHEN hour_of_day < 16 THEN 'BJT_08_16' ELSE 'BJT_16_24' END AS time_session,
    {score(unit("volume_ratio_20", 3), unit("range_atr_ratio", 3))} AS volume_climax_score,
    {score(unit("volume_ratio_20", 3), "reclaim_prev_low_20", "close_position")} AS volume_absorption_score,
    {score(unit("-pre_ret_10", 0.05), unit("volume_ratio_20", 3))} AS volume_dump_score,
    {score("lower_wick_ratio", "close_position", "body_to_range")} AS reversal_candle_score,
    {score(unit("-pre_ret_10", 0.05), unit("range_atr_ratio", 3), unit("volume_ratio_20", 3))} AS panic_drop_score,
    {score("break_prev_low_20", "reclaim_prev_low_20", "close_position")} AS false_breakdown_score,
    {score("break_prev_high_20", "reject_prev_high_20", "1.0 - close_position")} AS fake_breakout_score
  FROM f2)"""


@query(
    "event_factors",
    f'SELECT event_id, {", ".join((FACT + " " + FACT_TEXT).split())} FROM trade_events JOIN factors USING (symbol, "interval", bar_index)',
    f"{FACT_SQL}, {EVENTS_SQL}",
    FACT,
)
def _(spark, sf):
    cols = f"{FACT} {FACT_TEXT}".split()
    f = features.factor_table(bars(spark, sf)).select(*KEYS, "bar_index", *cols)
    return trade_events(spark, sf).join(f, [*KEYS, "bar_index"]).select("event_id", *cols)


def ctx_block(k: int) -> str:
    f, i = frame(1 - k, 0), frame(2 - k, 0)

    def z(v: str) -> str:
        return f"CASE WHEN stddev_pop({v}) OVER {f} = 0 THEN 0.0 ELSE ({v} - avg({v}) OVER {f}) / stddev_pop({v}) OVER {f} END"

    vals = {
        "pre_log_ret": f"ln(close / lag(close, {k - 1}) OVER ({W}))",
        "pre_simple_ret": f"close / lag(close, {k - 1}) OVER ({W}) - 1",
        "realized_vol": f"stddev_pop(log_return) OVER {i}",
        "downside_vol": f"coalesce(stddev_pop(CASE WHEN log_return < 0 THEN log_return END) OVER {i}, 0)",
        "range_mean": f"avg(rl) OVER {f}",
        "range_zscore": z("rl"),
        "volume_zscore": z("volume"),
        "trend_slope": f"regr_slope(ln(close), bar_index) OVER {f}",
        "distance_to_high": f"close / max(high) OVER {f} - 1",
        "distance_to_low": f"close / min(low) OVER {f} - 1",
    }
    cols = ", ".join(f"{v} AS {n}" for n, v in vals.items())
    names = list(vals) + ["max_drawdown"]
    return f"""
w{k} AS (SELECT symbol, "interval", bar_index, {cols}, list(close) OVER {f} AS cs FROM (SELECT *, ln(high / low) AS rl FROM rets)),
x{k} AS (SELECT * EXCLUDE (cs), list_min(list_transform(cs, lambda x, i: x / list_max(cs[1:i]) - 1)) AS max_drawdown FROM w{k} JOIN smp USING (symbol, "interval", bar_index)),
c{k} AS (
  SELECT sample_id, symbol, "interval", bar_index, {k} AS lookback_bars, 'available_bars' AS feature_name, cast(least(bar_index + 1, {k}) AS DOUBLE) AS feature_value FROM x{k}
  UNION ALL SELECT sample_id, symbol, "interval", bar_index, {k}, 'insufficient_history', CASE WHEN bar_index + 1 < {k} THEN 1.0 ELSE 0.0 END FROM x{k}
  {" ".join(f'UNION ALL SELECT sample_id, symbol, "interval", bar_index, {k}, {chr(39)}{n}{chr(39)}, {n} FROM x{k} WHERE bar_index + 1 >= {k}' for n in names)})"""


CTX_SQL = f"""
{RET_SQL}, {EVENTS_SQL},
smp AS (SELECT event_id AS sample_id, symbol, "interval", bar_index FROM trade_events WHERE event_type = 'OPEN'),
{ctx_block(20)}, {ctx_block(50)}, {ctx_block(100)}"""


@query(
    "context_features_long",
    """SELECT 'ctx_' || substr(sha256(sample_id || '|context_v1|' || lookback_bars || '|' || feature_name), 1, 24) AS context_feature_id,
       sample_id, 'context_v1' AS feature_version, symbol, "interval", bar_index, lookback_bars, feature_name, feature_value
    FROM (SELECT * FROM c20 UNION ALL SELECT * FROM c50 UNION ALL SELECT * FROM c100)""",
    CTX_SQL,
    "feature_value",
)
def _(spark, sf):
    s = trade_events(spark, sf).where("event_type = 'OPEN'").select(F.col("event_id").alias("sample_id"), *KEYS, "bar_index")
    return features.context_long(bars(spark, sf), s)


W20 = frame(-19, 0)
ENTRY_SQL = f"""
g1 AS (
  SELECT symbol, "interval", bar_index, open_time_ms, open, high, low, close, volume,
    {", ".join(f"close / lag(close, {n}) OVER ({W}) - 1 AS prior_ret_{n}" for n in (5, 10, 20))},
    CASE WHEN bar_index >= 1 THEN regr_slope(ln(close), bar_index) OVER {W20} END AS trend_slope_20,
    close / max(high) OVER {W20} - 1 AS distance_to_recent_high_20, close / min(low) OVER {W20} - 1 AS distance_to_recent_low_20,
    close / max(high) OVER {W20} - 1 AS drop_from_recent_high_20,
    bar_index - coalesce(max(CASE WHEN NOT close < open THEN bar_index END) OVER {W20}, min(bar_index) OVER {W20} - 1) AS consecutive_bearish_bars,
    coalesce(max(CASE WHEN close < open THEN (open - close) / open END) OVER {W20}, 0) AS largest_red_bar_pct_20,
    list(high) OVER {W20} AS hs, list(volume) OVER {frame(-99, 0)} AS vs,
    abs(close - open) / nullif(high - low, 0) AS body_ratio, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_shadow_ratio,
    (least(open, close) - low) / nullif(high - low, 0) AS lower_shadow_ratio, (close - low) / nullif(high - low, 0) AS close_position_in_range,
    CASE WHEN high > low THEN (high - low) / prev END AS range_pct, (close - min(low) OVER {W20}) / nullif(high - low, 0) AS reclaim_ratio,
    volume / avg(volume) OVER {P20} AS volume_ratio_to_ma20,
    CASE WHEN stddev_pop(volume) OVER {P20} > 0 THEN (volume - avg(volume) OVER {P20}) / stddev_pop(volume) OVER {P20} WHEN bar_index > 0 THEN 0 END AS volume_zscore_20,
    stddev_pop(log_return) OVER {W20} AS realized_vol_20,
    (high - low) / nullif(avg(tr) OVER {W20}, 0) AS atr_ratio_20,
    CASE WHEN stddev_pop(high - low) OVER {P20} > 0 THEN (high - low - avg(high - low) OVER {P20}) / stddev_pop(high - low) OVER {P20} WHEN bar_index > 0 THEN 0 END AS range_zscore_20
  FROM (SELECT *, coalesce(greatest(high - low, abs(high - prev), abs(low - prev)), high - low) AS tr FROM rets)),
entryfeat AS (
  SELECT * EXCLUDE (hs, vs), len(hs) - list_position(hs, list_max(hs)) AS down_move_duration,
    len(list_filter(vs, lambda x: x <= volume)) / len(vs) AS volume_rank_100,
    CASE WHEN bar_index < 20 THEN 1 ELSE 0 END AS insufficient_history FROM g1)"""

UNIVERSE_SQL = f"""
u1 AS (
  SELECT *, coalesce(bar_index > 5 AND high > low AND prev / lag(close, 5) OVER ({W}) - 1 <= -0.015 AND (high - low) / prev >= 0.02
      AND (volume / avg(volume) OVER {P20} >= 1.5
           OR CASE WHEN stddev_pop(volume) OVER {P20} > 0 THEN (volume - avg(volume) OVER {P20}) / stddev_pop(volume) OVER {P20} ELSE 0 END >= 1.0), false) AS core,
    coalesce((least(open, close) - low) / nullif(high - low, 0) >= 0.35, false) AS shadow,
    coalesce(close > open AND (close - open) / nullif(high - low, 0) >= 0.55, false) AS bull
  FROM rets),
u2 AS (SELECT *, coalesce(lag(core) OVER ({W}), false) AS pcore, lag(open_time_ms) OVER ({W}) AS ptime FROM u1),
uni AS (
  SELECT 'entry_obs_' || substr(sha256(symbol || '|' || "interval" || '|' || bar_index || '|rule_seeded|'), 1, 20) AS observation_id,
    symbol, "interval", bar_index, CASE WHEN core AND shadow THEN bar_index ELSE bar_index - 1 END AS setup_bar_index, bar_index AS decision_bar_index,
    strftime(make_timestamp(open_time_ms * 1000) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS bar_time,
    strftime(make_timestamp(CASE WHEN core AND shadow THEN open_time_ms ELSE ptime END * 1000) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS setup_bar_time,
    CASE WHEN core AND shadow THEN 'CURRENT_BAR_CLOSE' ELSE 'NEXT_BAR_CONFIRMATION' END AS decision_timing,
    'review_filter|prior_drop|range_expansion|volume_expansion|' || CASE WHEN core AND shadow THEN 'lower_shadow' ELSE 'bullish_confirmation' END AS candidate_reason
  FROM u2 WHERE (core AND shadow) OR (bull AND pcore))"""
UNI_COLS = "observation_id bar_index setup_bar_index decision_bar_index bar_time setup_bar_time decision_timing candidate_reason".split()


@query("entry_observation_universe", f'SELECT symbol, "interval", {", ".join(UNI_COLS)} FROM uni', f"{RET_SQL}, {UNIVERSE_SQL}")
def _(spark, sf):
    return universe.entry_universe(bars(spark, sf)).select(*KEYS, *UNI_COLS)


ENTRY_COLS = list(features.ENTRY_FEATURES)


@query(
    "entry_context_features",
    f"""SELECT u.observation_id, u.setup_bar_index, u.decision_bar_index, u.decision_bar_index AS feature_cutoff_bar_index,
       CASE WHEN u.decision_timing = 'CURRENT_BAR_CLOSE' THEN 'current_bar_close' ELSE 'confirmation_bar_included' END AS feature_timing_policy,
       {", ".join("f." + c for c in ENTRY_COLS)}, f.insufficient_history
    FROM uni u JOIN entryfeat f ON u.symbol = f.symbol AND u."interval" = f."interval" AND u.decision_bar_index = f.bar_index""",
    f"{RET_SQL}, {UNIVERSE_SQL}, {ENTRY_SQL}",
    " ".join(ENTRY_COLS),
    "insufficient_history",
)
def _(spark, sf):
    b = bars(spark, sf)
    out = features.entry_feature_rows(b, universe.entry_universe(b))
    return out.select(
        "observation_id", "setup_bar_index", "decision_bar_index", "feature_cutoff_bar_index", "feature_timing_policy", *ENTRY_COLS, "insufficient_history"
    )


@query(
    "entry_features_setup_bar_only",
    f"""SELECT u.observation_id, u.setup_bar_index AS feature_cutoff_bar_index, f.prior_ret_5, f.volume_zscore_20, f.lower_shadow_ratio
    FROM uni u JOIN entryfeat f ON u.symbol = f.symbol AND u."interval" = f."interval" AND u.setup_bar_index = f.bar_index""",
    f"{RET_SQL}, {UNIVERSE_SQL}, {ENTRY_SQL}",
    "prior_ret_5 volume_zscore_20 lower_shadow_ratio",
)
def _(spark, sf):
    b = bars(spark, sf)
    out = features.entry_feature_rows(b, universe.entry_universe(b), allow_confirmation=False)
    return out.select("observation_id", "feature_cutoff_bar_index", "prior_ret_5", "volume_zscore_20", "lower_shadow_ratio")


CUTOFF_SQL = """
cuts AS (
  SELECT symbol || '-' || bar_index AS observation_id, bar_index, bar_index - (bar_index % 3) AS setup_bar_index,
         bar_index + CASE WHEN bar_index % 11 = 0 THEN -4 ELSE 0 END AS decision_bar_index,
         CASE WHEN bar_index % 13 = 5 THEN 'LATER' WHEN bar_index % 2 = 0 THEN 'CURRENT_BAR_CLOSE' ELSE 'NEXT_BAR_CONFIRMATION' END AS decision_timing
  FROM bars)"""


@query(
    "cutoff_resolution",
    """SELECT observation_id, CASE WHEN decision_timing = 'CURRENT_BAR_CLOSE' THEN decision_bar_index ELSE decision_bar_index END AS feature_cutoff_bar_index,
      CASE WHEN decision_timing = 'LATER' THEN 'unsupported_timing'
           WHEN decision_timing = 'CURRENT_BAR_CLOSE' AND setup_bar_index <> decision_bar_index THEN 'setup_differs_from_decision'
           WHEN decision_timing = 'CURRENT_BAR_CLOSE' AND bar_index <> decision_bar_index THEN 'bar_differs_from_decision'
           WHEN decision_bar_index < setup_bar_index THEN 'before_setup' END AS cutoff_violation
    FROM cuts""",
    f"{BARS_SQL}, {CUTOFF_SQL}",
)
def _(spark, sf):
    i = F.col("bar_index")
    obs = bars(spark, sf).select(
        F.concat_ws("-", "symbol", i.cast("string")).alias("observation_id"), "bar_index", (i - i % 3).alias("setup_bar_index"),
        (i + F.when(i % 11 == 0, -4).otherwise(0)).alias("decision_bar_index"),
        F.when(i % 13 == 5, "LATER").when(i % 2 == 0, "CURRENT_BAR_CLOSE").otherwise("NEXT_BAR_CONFIRMATION").alias("decision_timing"),
    )
    return features.resolve_cutoff(obs).select("observation_id", "feature_cutoff_bar_index", "cutoff_violation")


WIN_SQL = f"""
{BARS_SQL}, {EVENTS_SQL},
slots AS (SELECT e.event_id, e.symbol, e."interval", e.bar_index AS at, o."offset" FROM trade_events e, (SELECT unnest(range(-20, 21)) AS "offset") o),
win AS (
  SELECT s.event_id, s.symbol, s."interval", s."offset", CASE WHEN s."offset" = 0 THEN 1 ELSE 0 END AS is_event_bar, b.bar_index, b.open_time_ms, b.open, b.high, b.low, b.close, b.volume,
         CASE WHEN b.close IS NULL THEN 1 ELSE 0 END AS is_missing_padding
  FROM slots s LEFT JOIN bars b ON s.symbol = b.symbol AND s."interval" = b."interval" AND b.bar_index = s.at + s."offset")"""


@query("event_windows_long", "SELECT * FROM win", WIN_SQL, "open high low close volume", "is_event_bar is_missing_padding")
def _(spark, sf):
    return features.event_windows(bars(spark, sf), trade_events(spark, sf))


SLOTS = list(range(-20, 21))


@query(
    "event_windows_wide",
    f"""SELECT event_id, {", ".join(f'max(close) FILTER ("offset" = {o}) AS {"pre_%d" % -o if o < 0 else "event_0" if o == 0 else "post_%d" % o}' for o in SLOTS)}
    FROM win GROUP BY 1""",
    WIN_SQL,
    " ".join("pre_%d" % -o if o < 0 else "event_0" if o == 0 else "post_%d" % o for o in SLOTS),
)
def _(spark, sf):
    return features.wide_windows(features.event_windows(bars(spark, sf), trade_events(spark, sf)), "close", SLOTS)


@query("bars_from_windows", 'SELECT DISTINCT symbol, "interval", bar_index, open_time_ms, open, high, low, close, volume FROM win WHERE is_missing_padding = 0', WIN_SQL, "open high low close volume")
def _(spark, sf):
    return features.bars_from_windows(features.event_windows(bars(spark, sf), trade_events(spark, sf)))


@query(
    "window_return_series",
    """SELECT event_id, bar_index, close / p - 1 AS simple_return, ln(close / p) AS log_return,
        stddev_samp(ln(close / p)) OVER (PARTITION BY event_id ORDER BY "offset" ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling_volatility_20,
        CASE WHEN p IS NULL THEN 1.0 ELSE 0.0 END AS is_segment_start
    FROM (SELECT *, lag(close) OVER (PARTITION BY event_id ORDER BY "offset") AS p FROM win WHERE bar_index IS NOT NULL)""",
    WIN_SQL,
    "simple_return log_return rolling_volatility_20 is_segment_start",
)
def _(spark, sf):
    from ...operators.series import window_return_series

    out = window_return_series(features.event_windows(bars(spark, sf), trade_events(spark, sf)))
    return out.select("event_id", "bar_index", "simple_return", "log_return", "rolling_volatility_20", "is_segment_start")


ANCHOR_SQL = """
anchors AS (
  SELECT event_id, upper(event_type) AS kind, 'S' || lpad(cast(user_id % 20 AS VARCHAR), 6, '0') AS symbol,
         1672531200000 + cast(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 250.0) AS BIGINT) AS t FROM events)"""


def anchors(spark, sf):
    """Event rows as cursor times on the bar calendar."""
    from ...functions.scalar import epoch_ms
    from ..derive import table

    e = table(spark, sf, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(
        "event_id", F.upper("event_type").alias("kind"),
        F.concat(F.lit("S"), F.lpad((F.col("user_id") % 20).cast("string"), 6, "0")).alias("symbol"),
        (F.lit(1_672_531_200_000) + F.floor(us / 250.0)).alias("t"),
    )


@query(
    "asof_containing_bar",
    """SELECT a.event_id, a.symbol, a.t, d.bar_index AS htf_bar_index,
      CASE WHEN d.bar_index IS NULL THEN 'unavailable_before_cursor' WHEN a.t <= d.close_time_ms THEN 'contains_cursor' ELSE 'latest_completed' END AS sync_status
    FROM anchors a ASOF LEFT JOIN daily d ON a.symbol = d.symbol AND a.t >= d.open_time_ms""",
    f"{DAILY_SQL}, {ANCHOR_SQL}",
)
def _(spark, sf):
    out = asof.containing_or_completed(anchors(spark, sf), daily(spark, sf), ["symbol"], "t", SLOT)
    return out.select("event_id", "symbol", "t", "htf_bar_index", "sync_status")


@query(
    "multi_timeframe_context",
    """SELECT a.event_id, a.symbol, d.bar_index AS htf_bar_index, d.available_bars, d.history_status, d.trend_regime, d.volatility_regime,
       d.close, d.pre_simple_ret_20, d.realized_vol_20, d.distance_to_high, d.distance_to_low
    FROM anchors a ASOF LEFT JOIN htf d ON a.symbol = d.symbol AND a.t >= d.close_time_ms + 1""",
    f"{DAILY_SQL}, {ANCHOR_SQL}",
    HTF_FLOATS,
)
def _(spark, sf):
    from ...operators.series import htf_state

    cols = ["bar_index", "available_bars", "history_status", "trend_regime", "volatility_regime", *HTF_FLOATS.split()]
    states = htf_state(daily(spark, sf))
    out = asof.completed_only(anchors(spark, sf), states, ["symbol"], "t", cols, SLOT)
    return out.withColumnRenamed("bar_index", "htf_bar_index").select("event_id", "symbol", "htf_bar_index", *cols[1:])


PREMIUM_SQL = """
premium AS (
  SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS pos
  FROM (SELECT event_id, 1672531200000 + cast(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 250.0) AS BIGINT) AS t,
               value AS premium, value * 0.9 AS buy, value * 1.2 AS sell FROM events WHERE event_type = 'view')),
pstat AS (
  SELECT t, pos, premium AS premium_avg_pct, premium - lag(premium, 2) OVER (ORDER BY pos) AS premium_change_3,
    CASE WHEN pos >= 1 AND stddev_pop(premium) OVER w >= 1e-12 THEN (premium - avg(premium) OVER w) / stddev_pop(premium) OVER w END AS premium_zscore_50,
    sell - buy AS premium_spread
  FROM premium WINDOW w AS (ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


def premium(spark, sf):
    from ...operators.chunks import dense_index

    p = anchors(spark, sf).where("kind = 'VIEW'").drop("symbol", "kind")
    from ..derive import table

    v = table(spark, sf, "events").select("event_id", "value")
    p = p.join(v, "event_id").select(
        F.lit("premium").alias("feed"), "event_id", "t", F.col("value").alias("premium"), (F.col("value") * 0.9).alias("buy"), (F.col("value") * 1.2).alias("sell")
    )
    return dense_index(p, ["feed"], "t", SLOT, name="pos", ties=("event_id",))


@query(
    "premium_asof_features",
    """SELECT e.event_id, p.premium_avg_pct, p.premium_change_3, p.premium_zscore_50, p.premium_spread
    FROM trade_events e ASOF LEFT JOIN (SELECT * FROM pstat QUALIFY row_number() OVER (PARTITION BY t ORDER BY pos DESC) = 1) p ON e.open_time_ms >= p.t""",
    f"{BARS_SQL}, {EVENTS_SQL}, {PREMIUM_SQL}",
    "premium_avg_pct premium_change_3 premium_zscore_50 premium_spread",
)
def _(spark, sf):
    cols = ["premium_avg_pct", "premium_change_3", "premium_zscore_50", "premium_spread"]
    stats = features.premium_stats(premium(spark, sf))
    ev = trade_events(spark, sf).select("event_id", F.lit("premium").alias("feed"), "open_time_ms")
    return asof.asof_join(ev, stats, ["feed"], "open_time_ms", "t", cols, SLOT, tie="pos").select("event_id", *cols)
