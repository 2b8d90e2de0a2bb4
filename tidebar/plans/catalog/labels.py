"""Outcome labels and candidate scans."""

from pyspark.sql import functions as F

from ...operators import labels, universe
from ...operators.chunks import KEYS
from ..derive import BARS_SQL, EVENTS_SQL, bars, trade_events
from ..registry import query
from .features import P20, UNIVERSE_SQL
from .series import RET_SQL, W, frame

FWD10 = frame(1, 10)
STORED = " ".join([f"fwd_ret_{k}" for k in (1, 3, 5, 10)] + [f"fwd_ret_{k}_side_adj" for k in (1, 3, 5, 10)] + ["mfe_10", "mae_10"])


@query(
    "event_labels_stored",
    f"""SELECT event_id, {", ".join(f"fwd_ret_{k}, CASE WHEN side = 'LONG' THEN fwd_ret_{k} ELSE -fwd_ret_{k} END AS fwd_ret_{k}_side_adj" for k in (1, 3, 5, 10))},
      CASE WHEN side = 'LONG' THEN top / mid - 1 ELSE (mid - bot) / mid END AS mfe_10, CASE WHEN side = 'LONG' THEN bot / mid - 1 ELSE (mid - top) / mid END AS mae_10
    FROM trade_events JOIN (SELECT symbol, "interval", bar_index, (high + low) / 2 AS mid, max(high) OVER {FWD10} AS top, min(low) OVER {FWD10} AS bot,
      {", ".join(f"lead(close, {k}) OVER ({W}) / ((high + low) / 2) - 1 AS fwd_ret_{k}" for k in (1, 3, 5, 10))} FROM bars) USING (symbol, "interval", bar_index)""",
    f"{BARS_SQL}, {EVENTS_SQL}",
    STORED,
)
def _(spark, sf):
    out = trade_events(spark, sf).join(labels.stored_forward(bars(spark, sf)), [*KEYS, "bar_index"])
    return labels.stored_side(out).select("event_id", *STORED.split())


LAB = (
    " ".join(f"fwd_ret_{k} fwd_ret_{k}_side_adj" for k in (1, 3, 5, 10, 20))
    + " mfe_5 mfe_10 mfe_20 mae_5 mae_10 mae_20 time_to_mfe_10 time_to_mae_10 hit_tp_1pct_before_sl_1pct hit_tp_2pct_before_sl_1pct"
    + " good_reversal failed_reversal strong_rebound clean_trade trap_move"
)


def touch_sql(tp: float, sl: float) -> str:
    goal = f"list_position(list_transform(p, lambda b: CASE WHEN short THEN b.low / base - 1 <= -{tp} ELSE b.high / base - 1 >= {tp} END), true)"
    stop = f"list_position(list_transform(p, lambda b: CASE WHEN short THEN b.high / base - 1 >= {sl} ELSE b.low / base - 1 <= -{sl} END), true)"
    return f"CASE WHEN len(p) > 0 THEN CASE WHEN coalesce({goal}, 0) > 0 AND (coalesce({stop}, 0) = 0 OR {goal} < {stop}) THEN 1.0 ELSE 0.0 END END"


LAB_BODY = f"""
fw AS (
  SELECT symbol, "interval", bar_index, close AS base, {", ".join(f"lead(close, {k}) OVER ({W}) AS c{k}" for k in (1, 3, 5, 10, 20))},
    {", ".join(f"max(high) OVER {frame(1, k)} AS h{k}, min(low) OVER {frame(1, k)} AS l{k}" for k in (5, 10, 20))},
    list({{'high': high, 'low': low}}) OVER {frame(1, 20)} AS p FROM bars),
le AS (SELECT e.*, f.* EXCLUDE (symbol, "interval", bar_index), e.side = 'SHORT' AS short FROM trade_events e JOIN fw f USING (symbol, "interval", bar_index)),
l1 AS (
  SELECT event_id, trade_id, symbol, "interval", bar_index, open_time_ms, event_type, side, label_tags_json, session_id,
    {", ".join(f"c{k} / base - 1 AS fwd_ret_{k}, CASE WHEN short THEN -1 ELSE 1 END * (c{k} / base - 1) AS fwd_ret_{k}_side_adj" for k in (1, 3, 5, 10, 20))},
    {", ".join(f"CASE WHEN short THEN -(l{k} / base - 1) ELSE h{k} / base - 1 END AS mfe_{k}, CASE WHEN short THEN -(h{k} / base - 1) ELSE l{k} / base - 1 END AS mae_{k}" for k in (5, 10, 20))},
    CASE WHEN short THEN list_position(list_transform(p[1:10], lambda b: b.low), l10) ELSE list_position(list_transform(p[1:10], lambda b: b.high), h10) END AS time_to_mfe_10,
    CASE WHEN short THEN list_position(list_transform(p[1:10], lambda b: b.high), h10) ELSE list_position(list_transform(p[1:10], lambda b: b.low), l10) END AS time_to_mae_10,
    {touch_sql(0.01, 0.01)} AS hit_tp_1pct_before_sl_1pct, {touch_sql(0.02, 0.01)} AS hit_tp_2pct_before_sl_1pct
  FROM le),
evlab AS (
  SELECT *, CASE WHEN known THEN CASE WHEN f > 0 AND mae_10 > -0.01 THEN 1.0 ELSE 0.0 END END AS good_reversal,
    CASE WHEN known THEN CASE WHEN f <= 0 AND mae_10 <= -0.01 THEN 1.0 ELSE 0.0 END END AS failed_reversal,
    CASE WHEN f IS NOT NULL THEN CASE WHEN f >= 0.01 THEN 1.0 ELSE 0.0 END END AS strong_rebound,
    CASE WHEN known THEN CASE WHEN mfe_10 >= 0.01 AND mae_10 > -0.005 THEN 1.0 ELSE 0.0 END END AS clean_trade,
    CASE WHEN known THEN CASE WHEN mfe_10 < 0.005 AND mae_10 <= -0.01 THEN 1.0 ELSE 0.0 END END AS trap_move
  FROM (SELECT *, fwd_ret_10_side_adj AS f, fwd_ret_10_side_adj IS NOT NULL AND mfe_10 IS NOT NULL AND mae_10 IS NOT NULL AS known FROM l1))"""
LAB_SQL = f"{BARS_SQL}, {EVENTS_SQL}, {LAB_BODY}"


@query("event_labels", f'SELECT event_id, {", ".join(LAB.split())} FROM evlab', LAB_SQL, LAB)
def _(spark, sf):
    return labels.event_labels(bars(spark, sf), trade_events(spark, sf)).select("event_id", *LAB.split())


STRAT = "label_win_5 label_win_10 label_strong_rebound_10 label_failed_reversal_10 label_good_trade_10 label_bad_trade_10 mfe_mae_ratio_10"


@query(
    "strategy_labels",
    """SELECT event_id, CASE WHEN fwd_ret_5_side_adj > 0 THEN 1.0 ELSE 0.0 END AS label_win_5, CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END AS label_win_10,
      CASE WHEN f > 0.005 THEN 1.0 ELSE 0.0 END AS label_strong_rebound_10, CASE WHEN mae_10 < -0.006 AND f <= 0 THEN 1.0 ELSE 0.0 END AS label_failed_reversal_10,
      CASE WHEN mfe_10 > 0.008 AND mae_10 > -0.004 THEN 1.0 ELSE 0.0 END AS label_good_trade_10, CASE WHEN mae_10 < -0.008 THEN 1.0 ELSE 0.0 END AS label_bad_trade_10,
      abs(mfe_10 / nullif(mae_10, 0)) AS mfe_mae_ratio_10 FROM evlab""",
    LAB_SQL,
    STRAT,
)
def _(spark, sf):
    return labels.strategy_labels(labels.event_labels(bars(spark, sf), trade_events(spark, sf)))


OUT_SQL = f"""
{BARS_SQL}, {EVENTS_SQL},
oh AS (
  SELECT *, lead(open, 1) OVER ({W}) AS nopen, {", ".join(f"lead(close, {h}) OVER ({W}) AS x{h}, max(high) OVER {frame(1, h)} AS t{h}, min(low) OVER {frame(1, h)} AS b{h}, count(*) OVER {frame(1, h)} AS n{h}" for h in (5, 10, 20, 50))} FROM bars),
ol AS (
  {" UNION ALL ".join(f'SELECT e.event_id AS sample_id, e.side, o.symbol, o."interval", o.bar_index, {h} AS horizon_bars, x{h} AS ex, t{h} AS top, b{h} AS bot, n{h} AS n, nopen, open, high, low, close FROM trade_events e JOIN oh o USING (symbol, "interval", bar_index) WHERE e.event_type = {chr(39)}OPEN{chr(39)}' for h in (5, 10, 20, 50))}),
ob AS (
  SELECT *, 'next_open' AS pricing_basis, nopen AS entry FROM ol UNION ALL SELECT *, 'event_close', close FROM ol
  UNION ALL SELECT *, 'legacy_mid', (high + low) / 2 FROM ol UNION ALL SELECT *, 'worst_case_same_bar', CASE WHEN side = 'SHORT' THEN low ELSE high END FROM ol),
oo AS (
  SELECT *, CASE WHEN n >= horizon_bars THEN CASE WHEN side = 'SHORT' THEN entry / ex - 1 ELSE ex / entry - 1 END END AS fwd_ret,
    CASE WHEN n >= horizon_bars THEN CASE WHEN side = 'SHORT' THEN entry / bot - 1 ELSE top / entry - 1 END END AS mfe,
    CASE WHEN n >= horizon_bars THEN CASE WHEN side = 'SHORT' THEN entry / top - 1 ELSE bot / entry - 1 END END AS mae FROM ob)"""


@query(
    "outcome_labels",
    """SELECT 'out_' || substr(sha256(sample_id || '|outcome_v1|' || horizon_bars || '|' || pricing_basis), 1, 24) AS outcome_label_id, sample_id, 'outcome_v1' AS label_version,
      symbol, "interval", bar_index, horizon_bars, pricing_basis, fwd_ret, mfe, mae, CASE WHEN mfe >= 0.02 THEN 1 WHEN mfe IS NOT NULL THEN 0 END AS hit_tp,
      CASE WHEN mae <= -0.01 THEN 1 WHEN mae IS NOT NULL THEN 0 END AS hit_sl, fwd_ret / 0.01 AS r_multiple, CASE WHEN n < horizon_bars THEN 1 ELSE 0 END AS insufficient_future_bars FROM oo""",
    OUT_SQL,
    "fwd_ret mfe mae r_multiple",
)
def _(spark, sf):
    s = trade_events(spark, sf).where("event_type = 'OPEN'").select(F.col("event_id").alias("sample_id"), *KEYS, "bar_index", "side")
    return labels.outcome_labels(bars(spark, sf), s)


def path_touch(tie: str) -> str:
    goal = "list_position(list_transform(p, lambda b: b.high >= close * 1.02), true)"
    stop = "list_position(list_transform(p, lambda b: b.low <= close * 0.99), true)"
    return f"""CASE WHEN n >= 10 THEN CASE WHEN coalesce({goal}, 0) = 0 AND coalesce({stop}, 0) = 0 THEN NULL WHEN {goal} = {stop} THEN {tie}
      WHEN coalesce({stop}, 0) = 0 OR (coalesce({goal}, 0) > 0 AND {goal} < {stop}) THEN 1.0 ELSE 0.0 END END"""


ENTRY_OUT_SQL = f"""
{RET_SQL}, {UNIVERSE_SQL},
ef AS (
  SELECT symbol, "interval", bar_index, close, {", ".join(f"lead(close, {h}) OVER ({W}) / close - 1 - 0.0012 AS fwd_ret_{h}" for h in (5, 10, 20))},
    max(high) OVER {FWD10} / close - 1 AS mfe, min(low) OVER {FWD10} / close - 1 AS mae, count(*) OVER {FWD10} AS n, list({{'high': high, 'low': low}}) OVER {FWD10} AS p FROM bars),
entryout AS (
  SELECT observation_id, fwd_ret_5, fwd_ret_10, fwd_ret_20, CASE WHEN n >= 10 THEN mfe END AS mfe_10, CASE WHEN n >= 10 THEN mae END AS mae_10,
    CASE WHEN n >= 10 THEN CASE WHEN mfe >= 0.02 THEN 1.0 ELSE 0.0 END END AS hit_tp_10, CASE WHEN n >= 10 THEN CASE WHEN mae <= -0.01 THEN 1.0 ELSE 0.0 END END AS hit_sl_10,
    {path_touch("0.0")} AS hit_tp_before_sl_10, {path_touch("1.0")} AS hit_tp_first, {path_touch("NULL")} AS hit_ambiguous
  FROM uni JOIN ef USING (symbol, "interval", bar_index))"""
EO = "fwd_ret_5 fwd_ret_10 fwd_ret_20 mfe_10 mae_10 hit_tp_10 hit_sl_10 hit_tp_before_sl_10"


@query("entry_outcomes", f'SELECT observation_id, {", ".join(EO.split())} FROM entryout', ENTRY_OUT_SQL, EO)
def _(spark, sf):
    b = bars(spark, sf)
    return labels.entry_outcomes(b, universe.entry_universe(b), fee_bps=4, slippage_bps=2).select("observation_id", *EO.split())


@query(
    "entry_outcomes_by_policy",
    """SELECT observation_id, 'stop_loss_first' AS policy, hit_tp_before_sl_10 FROM entryout WHERE fwd_ret_20 IS NOT NULL
       UNION ALL SELECT observation_id, 'take_profit_first', hit_tp_first FROM entryout WHERE fwd_ret_20 IS NOT NULL
       UNION ALL SELECT observation_id, 'ambiguous', hit_ambiguous FROM entryout WHERE fwd_ret_20 IS NOT NULL""",
    ENTRY_OUT_SQL,
    "hit_tp_before_sl_10",
)
def _(spark, sf):
    b = bars(spark, sf)
    u = universe.entry_universe(b)
    out = None
    for policy in ("stop_loss_first", "take_profit_first", "ambiguous"):
        part = labels.entry_outcomes(b, u, same_bar=policy, drop_short=True).select("observation_id", F.lit(policy).alias("policy"), "hit_tp_before_sl_10")
        out = part if out is None else out.unionByName(part)
    return out


@query("label_windows", "SELECT observation_id, bar_index + 1 AS label_start_bar, bar_index + 10 AS label_end_bar FROM uni", f"{RET_SQL}, {UNIVERSE_SQL}")
def _(spark, sf):
    return labels.label_window(universe.entry_universe(bars(spark, sf)), 10).select("observation_id", "label_start_bar", "label_end_bar")


def zz(v: str) -> str:
    return f"CASE WHEN stddev_pop({v}) OVER {P20} > 0 THEN ({v} - avg({v}) OVER {P20}) / stddev_pop({v}) OVER {P20} ELSE 0 END"


DEEP_SQL = f"""
dv AS (
  SELECT *, CASE WHEN coalesce(prev / lag(close, 10) OVER ({W}) - 1 < 0 AND ({zz("volume")} >= 1.0 OR volume / avg(volume) OVER {P20} >= 1.5) AND high > low
      AND ((least(open, close) - low) / nullif(high - low, 0) >= 0.45 OR (low < min(low) OVER {P20} AND close > min(low) OVER {P20})), false) THEN 1 ELSE 0 END AS is_candidate FROM rets),
acts AS (SELECT symbol, "interval", bar_index, session_id, event_type || '_' || side AS user_action FROM trade_events),
obs AS (
  SELECT coalesce(session_id, 'scan') AS session_id, symbol, "interval", bar_index, open_time_ms, coalesce(user_action, 'NO_ACTION') AS user_action, is_candidate,
    CASE WHEN user_action IS NOT NULL THEN 'USER_TRADE' WHEN is_candidate = 1 THEN 'AUTO_CANDIDATE' ELSE 'SCHEDULED_BAR' END AS source_type
  FROM dv LEFT JOIN acts USING (symbol, "interval", bar_index) WHERE bar_index >= 20),
observations AS (
  SELECT 'obs_' || substr(sha256(session_id || '|' || symbol || '|' || "interval" || '|' || bar_index || '|' || source_type), 1, 20) AS sample_id, session_id,
    'LONG_DEEP_V_REVERSAL' AS profile_id, source_type, symbol, "interval", bar_index,
    strftime(make_timestamp(open_time_ms * 1000) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS event_time_bjt, user_action,
    CASE WHEN user_action <> 'NO_ACTION' THEN split_part(user_action, '_', 2) END AS side, CASE WHEN source_type = 'USER_TRADE' THEN 1 ELSE 0 END AS is_user_trade,
    is_candidate, 0 AS is_matched_control FROM obs)"""


def actions(spark, sf):
    return trade_events(spark, sf).select(*KEYS, "bar_index", "session_id", F.concat_ws("_", "event_type", "side").alias("user_action"))


def observations(spark, sf):
    return universe.deep_v_universe(bars(spark, sf), actions(spark, sf))


@query("deep_v_universe", "SELECT * FROM observations", f"{RET_SQL}, {EVENTS_SQL}, {DEEP_SQL}", ints="is_user_trade is_candidate is_matched_control")
def _(spark, sf):
    return observations(spark, sf)


@query(
    "observation_vocabulary_split",
    """SELECT CASE WHEN bar_index % 19 = 3 THEN 'JUMP' ELSE user_action END AS user_action, source_type,
       CASE WHEN bar_index % 19 = 3 THEN 'bad_user_action' ELSE '' END AS errors, count(*) AS n FROM observations GROUP BY 1, 2, 3""",
    f"{RET_SQL}, {EVENTS_SQL}, {DEEP_SQL}",
)
def _(spark, sf):
    o = observations(spark, sf).withColumn("user_action", F.when(F.col("bar_index") % 19 == 3, "JUMP").otherwise(F.col("user_action")))
    good, bad = universe.split_by_vocabulary(o, {"user_action": universe.ACTIONS, "source_type": universe.SOURCE_TYPES})
    both = good.withColumn("errors", F.lit("")).unionByName(bad)
    return both.groupBy("user_action", "source_type", "errors").agg(F.count(F.lit(1)).alias("n"))


@query(
    "strategy_sample_membership",
    """SELECT 'strat_' || substr(sha256('exp_1|' || sample_id || '|CANDIDATE'), 1, 20) AS strategy_sample_id, sample_id, 'exp_1' AS experiment_id,
       'f1' AS feature_version, 'l1' AS label_version, 'h1' AS dataset_hash, 'CANDIDATE' AS sample_role FROM observations WHERE is_candidate = 1""",
    f"{RET_SQL}, {EVENTS_SQL}, {DEEP_SQL}",
)
def _(spark, sf):
    return universe.attach_to_experiment(observations(spark, sf).where("is_candidate = 1"), "exp_1", "CANDIDATE", "f1", "l1", "h1")


ENTRY_RULE_SQL = f"""
er AS (
  SELECT *, coalesce(bar_index >= 20 AND high > low AND prev < lag(close, 20) OVER ({W}) AND close / lag(close, 5) OVER ({W}) - 1 <= -0.02
      AND volume / nullif(avg(volume) OVER {P20}, 0) >= 1.5, false) AS setup,
    coalesce((least(open, close) - low) / nullif(high - low, 0) >= 0.45, false) AS pin, coalesce(close > open AND (close - open) / nullif(high - low, 0) >= 0.6, false) AS bull FROM rets),
er2 AS (SELECT *, max(CASE WHEN setup THEN 1 ELSE 0 END) OVER {frame(-2, -1)} AS recent FROM er),
entries AS (
  SELECT symbol, "interval", bar_index, CASE WHEN setup AND pin THEN 'pinbar_close' WHEN bull AND recent = 1 THEN 'confirmation_bar' ELSE 'conditions_not_met' END AS entry_reason FROM er2)"""


@query(
    "deep_v_entry_signals",
    """SELECT symbol, "interval", bar_index, entry_reason, CASE WHEN entry_reason <> 'conditions_not_met' THEN 1 ELSE 0 END AS should_open_long FROM entries""",
    f"{RET_SQL}, {ENTRY_RULE_SQL}",
    ints="should_open_long",
)
def _(spark, sf):
    out = universe.deep_v_entries(bars(spark, sf), volume_multiple=1.5, confirm_bars=2)
    return out.select(*KEYS, "bar_index", "entry_reason", "should_open_long")


@query(
    "moving_average_cross",
    f"""SELECT symbol, "interval", bar_index, mf / ms - 1 AS ma_gap,
      CASE WHEN bar_index >= 20 AND lag(sd) OVER ({W}) <= 0 AND sd > 0 THEN 'UP' WHEN bar_index >= 20 AND lag(sd) OVER ({W}) >= 0 AND sd < 0 THEN 'DOWN' END AS "cross"
    FROM (SELECT *, CASE WHEN abs(mf - ms) <= 1e-12 * greatest(abs(mf), abs(ms)) THEN 0 ELSE sign(mf - ms) END AS sd FROM (SELECT *, avg(close) OVER {frame(-4, 0)} AS mf, avg(close) OVER {frame(-19, 0)} AS ms FROM bars))""",
    BARS_SQL,
    "ma_gap",
)
def _(spark, sf):
    return universe.ma_cross(bars(spark, sf)).select(
        *KEYS, "bar_index", (F.col("ma_fast") / F.col("ma_slow") - 1).alias("ma_gap"), "cross"
    )


@query(
    "candidate_forward_study",
    f"""SELECT symbol, "interval", is_candidate, count(*) AS n, count(fwd) AS n_outcome, avg(fwd) AS mean_fwd_ret_10, stddev_samp(fwd) AS std_fwd_ret_10,
       avg(CASE WHEN fwd > 0 THEN 100.0 WHEN fwd IS NOT NULL THEN 0.0 END) AS win_rate_pct, avg(lv) AS mean_volatility
    FROM (SELECT *, lead(close, 10) OVER ({W}) / ((high + low) / 2) - 1 AS fwd, stddev_samp(log_return) OVER {frame(-19, 0)} AS lv FROM dv) WHERE bar_index >= 20 GROUP BY 1, 2, 3""",
    f"{RET_SQL}, {EVENTS_SQL}, {DEEP_SQL}",
    "mean_fwd_ret_10 std_fwd_ret_10 win_rate_pct mean_volatility",
    "is_candidate",
)
def _(spark, sf):
    from ...functions.scalar import flag
    from ...operators import series
    from ..derive import build_bars

    b = build_bars(spark, sf)
    key = [*KEYS, "bar_index"]
    flags = universe.deep_v_flags(b).select(*key, "is_candidate")
    vol = series.return_series(b).select(*key, "rolling_volatility_20")
    fwd = labels.stored_forward(b).select(*key, "fwd_ret_10")
    f = F.col("fwd_ret_10")
    return flags.join(vol, key).join(fwd, key).groupBy(*KEYS, "is_candidate").agg(
        F.count(F.lit(1)).alias("n"), F.count(f).alias("n_outcome"), F.avg(f).alias("mean_fwd_ret_10"), F.stddev_samp(f).alias("std_fwd_ret_10"),
        F.avg(F.when(f.isNotNull(), flag(f > 0) * 100.0)).alias("win_rate_pct"), F.avg("rolling_volatility_20").alias("mean_volatility"),
    )
