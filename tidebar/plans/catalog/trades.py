"""Trades, equity, performance and barrier exits."""

from pyspark.sql import functions as F

from ...operators import barrier, trades as T, universe
from ...operators.chunks import KEYS
from ..derive import BARS_SQL, EVENTS_SQL, bars, trade_events
from ..registry import query
from .labels import ENTRY_RULE_SQL
from .series import RET_SQL, W

TRADE_SQL = f"""
{BARS_SQL}, {EVENTS_SQL},
tp AS (
  SELECT o.trade_id, o.session_id, o.symbol, o."interval", o.side, o.event_id AS entry_event_id, o.bar_index AS entry_bar_index, o.open_time_ms AS entry_time_ms,
    c.event_id AS exit_event_id, c.bar_index AS exit_bar_index, c.open_time_ms AS exit_time_ms, CASE WHEN c.event_id IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status,
    c.bar_index - o.bar_index AS holding_bars
  FROM (SELECT * FROM trade_events WHERE event_type = 'OPEN') o LEFT JOIN (SELECT * FROM trade_events WHERE event_type = 'CLOSE') c USING (trade_id)),
tf AS (
  SELECT tp.*, (a.high + a.low) / 2 * CASE WHEN side = 'LONG' THEN 1.001 ELSE 0.999 END AS entry_fill_price, (b.high + b.low) / 2 * CASE WHEN side = 'SHORT' THEN 1.001 ELSE 0.999 END AS exit_fill_price
  FROM tp JOIN bars a ON a.symbol = tp.symbol AND a.bar_index = tp.entry_bar_index LEFT JOIN bars b ON b.symbol = tp.symbol AND b.bar_index = tp.exit_bar_index),
tr AS (
  SELECT *, gross_pnl_quote - entry_fee_quote - exit_fee_quote AS net_pnl_quote, gross_pnl_quote / 10 AS gross_return_pct, (gross_pnl_quote - entry_fee_quote - exit_fee_quote) / 10 AS net_return_pct,
         (entry_fee_quote + exit_fee_quote) / 10 AS fee_return_pct
  FROM (SELECT *, CASE WHEN exit_fill_price IS NOT NULL THEN 1000 / entry_fill_price END AS quantity, CASE WHEN exit_fill_price IS NOT NULL THEN 0.4 END AS entry_fee_quote, 1000 / entry_fill_price * exit_fill_price * 0.0004 AS exit_fee_quote,
    (exit_fill_price - entry_fill_price) * (1000 / entry_fill_price) * CASE WHEN side = 'LONG' THEN 1 ELSE -1 END AS gross_pnl_quote FROM tf)),
eq AS (
  SELECT session_id, row_number() OVER w AS sequence_no, trade_id, exit_event_id AS event_id, 10000 + sum(net_pnl_quote) OVER w - net_pnl_quote AS equity_before, gross_pnl_quote AS realized_gross_pnl,
         entry_fee_quote + exit_fee_quote AS realized_fee, net_pnl_quote AS realized_net_pnl, 10000 + sum(net_pnl_quote) OVER w AS equity_after
  FROM tr WHERE status = 'CLOSED' WINDOW w AS (PARTITION BY session_id ORDER BY exit_time_ms, trade_id)),
equity AS (
  SELECT *, realized_net_pnl / equity_before * 100 AS equity_return_pct, (equity_after / greatest(10000, max(equity_after) OVER (PARTITION BY session_id ORDER BY sequence_no)) - 1) * 100 AS drawdown_pct FROM eq)"""


def paired(spark, sf):
    return T.pair_events(trade_events(spark, sf))


def priced(spark, sf):
    return T.priced_trades(paired(spark, sf), bars(spark, sf), "MID", 10.0, 4.0)


def equity(spark, sf):
    return T.equity_curve(priced(spark, sf))


@query("paired_trades", "SELECT * FROM tp", TRADE_SQL)
def _(spark, sf):
    return paired(spark, sf)


PRICE_COLS = "entry_fill_price exit_fill_price quantity entry_fee_quote exit_fee_quote gross_pnl_quote net_pnl_quote gross_return_pct net_return_pct fee_return_pct"


@query("trade_outcomes", f"SELECT trade_id, {', '.join(PRICE_COLS.split())} FROM tr", TRADE_SQL, PRICE_COLS)
def _(spark, sf):
    return priced(spark, sf).select("trade_id", *PRICE_COLS.split())


EQ_FLOATS = "equity_before realized_gross_pnl realized_fee realized_net_pnl equity_after equity_return_pct drawdown_pct"


@query("equity_curve", "SELECT * FROM equity", TRADE_SQL, EQ_FLOATS)
def _(spark, sf):
    return equity(spark, sf)


PERF = "average_holding_bars profit_factor win_rate_pct average_return_pct max_profit_pct max_loss_pct average_win_pct average_loss_pct payoff_ratio"
PERF_SQL = f"""
{TRADE_SQL},
tg AS (SELECT *, 'ALL' AS side_group FROM tr UNION ALL SELECT *, side FROM tr),
tq AS (SELECT *, row_number() OVER (PARTITION BY session_id, side_group ORDER BY exit_time_ms, trade_id) - 1 AS p FROM tg WHERE status = 'CLOSED'),
stk AS (SELECT session_id, side_group, max(p - coalesce(a, -1)) AS max_consecutive_wins, max(p - coalesce(b, -1)) AS max_consecutive_losses FROM (
  SELECT *, max(CASE WHEN NOT net_return_pct > 0 THEN p END) OVER w AS a, max(CASE WHEN NOT net_return_pct < 0 THEN p END) OVER w AS b FROM tq WINDOW w AS (PARTITION BY session_id, side_group ORDER BY p)) GROUP BY 1, 2),
perf AS (SELECT * FROM (SELECT session_id, side_group, count(*) AS total_trades, count(*) FILTER (status = 'CLOSED') AS closed_trades, count(*) FILTER (status = 'OPEN') AS open_trades,
   avg(holding_bars) AS average_holding_bars, coalesce(sum(net_return_pct) FILTER (net_return_pct > 0), 0) / nullif(abs(sum(net_return_pct) FILTER (net_return_pct < 0)), 0) AS profit_factor,
   avg(CASE WHEN net_return_pct > 0 THEN 100.0 WHEN net_return_pct IS NOT NULL THEN 0.0 END) AS win_rate_pct, avg(net_return_pct) AS average_return_pct,
   max(net_return_pct) FILTER (net_return_pct > 0) AS max_profit_pct, min(net_return_pct) FILTER (net_return_pct < 0) AS max_loss_pct,
   avg(net_return_pct) FILTER (net_return_pct > 0) AS average_win_pct, avg(net_return_pct) FILTER (net_return_pct < 0) AS average_loss_pct,
   avg(net_return_pct) FILTER (net_return_pct > 0) / nullif(abs(avg(net_return_pct) FILTER (net_return_pct < 0)), 0) AS payoff_ratio FROM tg GROUP BY 1, 2) JOIN stk USING (session_id, side_group))"""


@query("performance_summary", "SELECT * FROM perf", PERF_SQL, PERF)
def _(spark, sf):
    return T.performance_summary(priced(spark, sf))


FLAT = ["total_trades", "closed_trades", "open_trades", *PERF.split(), "max_consecutive_wins", "max_consecutive_losses"]


@query(
    "performance_flat",
    "SELECT session_id, " + ", ".join(f"max(CASE WHEN side_group = '{g}' THEN {v} END) AS {p}{v}" for g, p in (("ALL", ""), ("LONG", "long_"), ("SHORT", "short_")) for v in FLAT) + " FROM perf GROUP BY 1",
    PERF_SQL,
    " ".join(f"{p}{v}" for p in ("", "long_", "short_") for v in PERF.split()),
)
def _(spark, sf):
    return T.flat_summary(T.performance_summary(priced(spark, sf)))


@query(
    "recent_trade",
    """SELECT session_id, trade_id AS recent_trade_id, side AS recent_trade_side, status AS recent_trade_status, net_return_pct AS recent_trade_return_pct, holding_bars AS recent_trade_holding_bars
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY status = 'CLOSED' DESC, coalesce(exit_time_ms, entry_time_ms) DESC, trade_id DESC) AS rn FROM tr) WHERE rn = 1""",
    TRADE_SQL,
    "recent_trade_return_pct",
)
def _(spark, sf):
    return T.recent_trade(priced(spark, sf))


AN = (
    "win_rate_pct loss_rate_pct average_return_pct average_win_pct average_loss_pct max_profit_pct max_loss_pct gross_profit_pct gross_loss_pct profit_factor payoff_ratio win_loss_ratio "
    "trade_sharpe trade_sortino var_5_pct median_return_pct cvar_5_pct final_equity time_sharpe time_sortino max_drawdown_pct initial_equity total_net_pnl total_return_pct calmar_ratio sharpe_trade sortino_trade"
)


def sor(x: str, p: str = "1.0") -> str:
    return f"CASE WHEN count({x}) >= 2 AND count(*) FILTER ({x} < 0) > 0 THEN avg({x}) / CASE WHEN count(*) FILTER ({x} < 0) = 1 THEN abs(min({x})) ELSE nullif(stddev_samp({x}) FILTER ({x} < 0), 0) END * sqrt({p}) END"


@query(
    "trade_analysis",
    f"""SELECT *, 10000.0 AS initial_equity, final_equity - 10000 AS total_net_pnl, (final_equity / 10000 - 1) * 100 AS total_return_pct, (final_equity / 10000 - 1) * 100 / nullif(abs(max_drawdown_pct), 0) AS calmar_ratio FROM
     (SELECT session_id, count(*) AS total_trades, count(*) FILTER (status = 'OPEN') AS open_trades, 'manual_replay_records' AS basis FROM tr GROUP BY 1)
     JOIN (SELECT session_id, count(*) AS closed_trades, avg(CASE WHEN r > 0 THEN 100.0 ELSE 0 END) AS win_rate_pct, avg(CASE WHEN r < 0 THEN 100.0 ELSE 0 END) AS loss_rate_pct, avg(r) AS average_return_pct,
        avg(r) FILTER (r > 0) AS average_win_pct, avg(r) FILTER (r < 0) AS average_loss_pct, max(r) FILTER (r > 0) AS max_profit_pct, min(r) FILTER (r < 0) AS max_loss_pct, coalesce(sum(r) FILTER (r > 0), 0) AS gross_profit_pct,
        coalesce(sum(r) FILTER (r < 0), 0) AS gross_loss_pct, sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)) AS profit_factor, avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)) AS payoff_ratio,
        count(*) FILTER (r > 0) / nullif(cast(count(*) FILTER (r < 0) AS DOUBLE), 0) AS win_loss_ratio, avg(r) / stddev_samp(r) AS trade_sharpe, {sor('r')} AS trade_sortino,
        quantile_cont(r, 0.05) AS var_5_pct, median(r) AS median_return_pct FROM (SELECT session_id, net_return_pct AS r FROM tr WHERE status = 'CLOSED') GROUP BY 1) USING (session_id)
     JOIN (SELECT session_id, avg(net_return_pct) AS cvar_5_pct FROM tr JOIN (SELECT session_id, quantile_cont(net_return_pct, 0.05) AS q FROM tr GROUP BY 1) USING (session_id) WHERE net_return_pct <= q GROUP BY 1) USING (session_id)
     JOIN (SELECT session_id, last(equity_after ORDER BY sequence_no) AS final_equity, avg(x) / stddev_samp(x) * sqrt(2190.0) AS time_sharpe, {sor('x', '2190.0')} AS time_sortino, min(drawdown_pct) AS max_drawdown_pct,
        avg(equity_return_pct / 100) / stddev_pop(equity_return_pct / 100) AS sharpe_trade, avg(equity_return_pct / 100) / nullif(stddev_pop(equity_return_pct / 100) FILTER (equity_return_pct < 0), 0) AS sortino_trade
        FROM (SELECT *, equity_after / equity_before - 1 AS x FROM equity) GROUP BY 1) USING (session_id)""",
    TRADE_SQL,
    AN,
)
def _(spark, sf):
    t = priced(spark, sf)
    return T.trade_analysis(t, T.equity_curve(t), 10_000.0, "4h")


@query(
    "equity_max_drawdown",
    """WITH v AS (SELECT DISTINCT session_id, 10000.0 AS value, 0 AS pos FROM equity UNION ALL SELECT session_id, equity_after, sequence_no FROM equity),
     p AS (SELECT *, max(value) OVER (PARTITION BY session_id ORDER BY pos) AS pk FROM v),
     s AS (SELECT *, max(CASE WHEN coalesce(lp < pk, true) THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) AS st FROM (SELECT *, lag(pk) OVER (PARTITION BY session_id ORDER BY pos) AS lp FROM p)),
     m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY 1 - value / pk DESC, pos) AS rn FROM s)
    SELECT session_id, (value / pk - 1) * 100 AS max_drawdown_pct, CASE WHEN value < pk THEN st END AS drawdown_start, CASE WHEN value < pk THEN pos END AS drawdown_end FROM m WHERE rn = 1""",
    TRADE_SQL,
    "max_drawdown_pct",
)
def _(spark, sf):
    return T.equity_drawdown(equity(spark, sf), 10_000.0)


# -- barrier exits of the entry rule

SIG_SQL = f"""
{RET_SQL}, {ENTRY_RULE_SQL},
sig AS (SELECT symbol, "interval", bar_index, CASE WHEN bar_index % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM entries WHERE entry_reason <> 'conditions_not_met'),
pa AS (SELECT symbol, "interval", bar_index, list({{'open': open, 'high': high, 'low': low, 'close': close}}) OVER (PARTITION BY symbol, "interval" ORDER BY bar_index ROWS BETWEEN 1 FOLLOWING AND 11 FOLLOWING) AS p FROM bars),
pm AS (SELECT * FROM (VALUES ('tight', 1.0, 2.0, 6, false), ('base', 1.5, 3.0, 10, false), ('eager', 1.5, 1.5, 10, true)) t(param_id, st, tk, mh, tf)),
x0 AS (SELECT *, side = 'SHORT' AS sh, p[1].open AS entry_price FROM sig JOIN pa USING (symbol, "interval", bar_index), pm WHERE len(p) > 0),
x1 AS (SELECT *, entry_price * CASE WHEN sh THEN 1 + st / 100.0 ELSE 1 - st / 100.0 END AS sp, entry_price * CASE WHEN sh THEN 1 - tk / 100.0 ELSE 1 + tk / 100.0 END AS xp FROM x0),
x2 AS (SELECT *, nullif(coalesce(list_position(list_transform(p[1:mh], lambda b: CASE WHEN sh THEN b.high >= sp ELSE b.low <= sp END), true), 0), 0) AS s,
                 nullif(coalesce(list_position(list_transform(p[1:mh], lambda b: CASE WHEN sh THEN b.low <= xp ELSE b.high >= xp END), true), 0), 0) AS t FROM x1),
x3 AS (SELECT *, CASE WHEN t IS NOT NULL AND (s IS NULL OR t < s OR (t = s AND tf)) THEN 'take_profit' WHEN s IS NOT NULL THEN 'stop_loss' WHEN len(p) > mh THEN 'max_bars_hold' ELSE 'end_of_data' END AS exit_reason FROM x2),
x4 AS (SELECT *, CASE exit_reason WHEN 'take_profit' THEN t WHEN 'stop_loss' THEN s WHEN 'max_bars_hold' THEN mh + 1 ELSE len(p) END AS steps,
         CASE exit_reason WHEN 'take_profit' THEN xp WHEN 'stop_loss' THEN sp WHEN 'max_bars_hold' THEN p[mh + 1].open ELSE p[len(p)].close END AS exit_price FROM x3),
xt AS (
  SELECT 'bt_' || substr(sha256(symbol || '|' || "interval" || '|' || bar_index || '|' || param_id), 1, 24) AS trade_id, param_id, symbol, "interval", side, bar_index AS signal_bar_index, bar_index + 1 AS entry_bar_index,
    bar_index + steps AS exit_bar_index, bar_index + steps - CASE WHEN exit_reason = 'max_bars_hold' THEN 1 ELSE 0 END AS blocked_until, entry_price, exit_price, exit_reason, 0.4 AS entry_fee_quote, 1000 / entry_price * exit_price * 0.0004 AS exit_fee_quote,
    (exit_price - entry_price) * (1000 / entry_price) * CASE WHEN sh THEN -1 ELSE 1 END - 0.4 - 1000 / entry_price * exit_price * 0.0004 AS net_pnl_quote,
    ((exit_price - entry_price) * (1000 / entry_price) * CASE WHEN sh THEN -1 ELSE 1 END - 0.4 - 1000 / entry_price * exit_price * 0.0004) / 10 AS net_return_pct FROM x4)"""
PARAMS = (
    {"param_id": "tight", "stop_pct": 1.0, "take_pct": 2.0, "max_hold": 6},
    {"param_id": "base", "stop_pct": 1.5, "take_pct": 3.0, "max_hold": 10},
    {"param_id": "eager", "stop_pct": 1.5, "take_pct": 1.5, "max_hold": 10, "take_first": True},
)


def exits(spark, sf):
    b = bars(spark, sf)
    s = universe.deep_v_entries(b, volume_multiple=1.5, confirm_bars=2).where("should_open_long = 1")
    s = s.select(*KEYS, "bar_index", F.when(F.col("bar_index") % 2 == 0, "LONG").otherwise("SHORT").alias("side"))
    return barrier.barrier_exits(b, s, PARAMS)


XCOLS = "trade_id param_id symbol interval side signal_bar_index entry_bar_index exit_bar_index entry_price exit_price exit_reason net_pnl_quote net_return_pct".split()


@query("barrier_exits", "SELECT " + ", ".join('"interval"' if c == "interval" else c for c in XCOLS) + " FROM xt", SIG_SQL, "entry_price exit_price net_pnl_quote net_return_pct", "exit_bar_index")
def _(spark, sf):
    return exits(spark, sf).select(*XCOLS)


GREEDY = """
sq AS (SELECT *, greatest(blocked_until, signal_bar_index + 2) AS until, row_number() OVER (PARTITION BY param_id, symbol, "interval" ORDER BY signal_bar_index, trade_id) AS k FROM xt),
kept AS (
  SELECT param_id, symbol, "interval", trade_id, k, until FROM sq WHERE k = 1
  UNION ALL
  SELECT n.param_id, n.symbol, n."interval", n.trade_id, n.k, n.until FROM kept c, LATERAL (
    SELECT * FROM sq WHERE sq.param_id = c.param_id AND sq.symbol = c.symbol AND sq."interval" = c."interval" AND sq.signal_bar_index > c.until ORDER BY k LIMIT 1) n),
single AS (SELECT xt.* FROM xt JOIN kept USING (trade_id))"""
SINGLE_SQL = f"RECURSIVE {SIG_SQL.strip()}, {GREEDY}"


def single(spark, sf):
    return barrier.one_at_a_time(exits(spark, sf), 2, size=256)


@query("single_position_trades", "SELECT trade_id, param_id, exit_reason, net_pnl_quote FROM single", SINGLE_SQL, "net_pnl_quote")
def _(spark, sf):
    return single(spark, sf).select("trade_id", "param_id", "exit_reason", "net_pnl_quote")


SUM_FLOATS = "net_pnl total_fees average_return_pct win_rate_pct average_bars"


@query(
    "rule_trade_summary",
    f"""SELECT param_id, symbol, count(*) AS trade_count, sum(net_pnl_quote) AS net_pnl, sum(entry_fee_quote + exit_fee_quote) AS total_fees, avg(net_return_pct) AS average_return_pct,
      avg(CASE WHEN net_return_pct > 0 THEN 100.0 ELSE 0.0 END) AS win_rate_pct, avg(exit_bar_index - entry_bar_index + 1) AS average_bars,
      {", ".join(f"count(*) FILTER (exit_reason = '{k}') AS exit_{k}" for k in ("take_profit", "stop_loss", "max_bars_hold", "end_of_data"))} FROM single GROUP BY 1, 2""",
    SINGLE_SQL,
    SUM_FLOATS,
)
def _(spark, sf):
    return barrier.result_summary(single(spark, sf), ["param_id", "symbol"])


@query(
    "marked_equity",
    """SELECT t.param_id, t.symbol, t."interval", b.bar_index, sum(CASE WHEN b.bar_index = exit_bar_index THEN 0 ELSE (close / entry_price - 1) * CASE WHEN side = 'LONG' THEN 1000 ELSE -1000 END END) AS unrealized_pnl,
      sum(CASE WHEN b.bar_index = exit_bar_index THEN net_pnl_quote ELSE 0 END) AS realized_net_pnl, count(*) FILTER (b.bar_index <> exit_bar_index) AS open_positions
    FROM single t JOIN bars b ON b.symbol = t.symbol AND b.bar_index BETWEEN t.entry_bar_index AND t.exit_bar_index GROUP BY ALL""",
    SINGLE_SQL,
    "unrealized_pnl realized_net_pnl",
)
def _(spark, sf):
    return barrier.marked_equity(single(spark, sf), bars(spark, sf))


@query(
    "simulated_equity_table",
    """SELECT param_id, symbol, "interval", bar_index, cash_equity, unrealized_pnl, realized_net_pnl, cash_equity + unrealized_pnl AS equity_after, greatest(10000, top) AS peak_equity,
      ((cash_equity + unrealized_pnl) / greatest(10000, top) - 1) * 100 AS drawdown_pct
    FROM (SELECT *, max(cash_equity + unrealized_pnl) OVER (PARTITION BY param_id, symbol, "interval" ORDER BY bar_index) AS top
      FROM (SELECT *, 10000 + sum(realized_net_pnl) OVER (PARTITION BY param_id, symbol, "interval" ORDER BY bar_index) AS cash_equity
        FROM (SELECT p.param_id, b.symbol, b."interval", b.bar_index, coalesce(u, 0) AS unrealized_pnl, coalesce(r, 0) AS realized_net_pnl
          FROM bars b JOIN (SELECT DISTINCT param_id, symbol, "interval" FROM single) p USING (symbol, "interval")
          LEFT JOIN (SELECT t.param_id, t.symbol, t."interval", b.bar_index,
              sum(CASE WHEN b.bar_index = exit_bar_index THEN 0 ELSE (close - entry_price) * 1000 / entry_price * CASE WHEN side = 'LONG' THEN 1 ELSE -1 END - 0.4 - 1000 / entry_price * close * 0.0004 END) AS u,
              sum(CASE WHEN b.bar_index = exit_bar_index THEN net_pnl_quote ELSE 0 END) AS r
            FROM single t JOIN bars b ON b.symbol = t.symbol AND b."interval" = t."interval" AND b.bar_index BETWEEN t.entry_bar_index AND t.exit_bar_index GROUP BY ALL) m
          ON m.param_id = p.param_id AND m.symbol = b.symbol AND m."interval" = b."interval" AND m.bar_index = b.bar_index)))""",
    SINGLE_SQL,
    "cash_equity unrealized_pnl realized_net_pnl equity_after peak_equity drawdown_pct",
)
def _(spark, sf):
    return barrier.equity_table(single(spark, sf), bars(spark, sf), size=256)


@query(
    "funding_accrual",
    """SELECT trade_id, coalesce((SELECT sum(-1000 * (b.bar_index % 3) / 10000.0 * CASE WHEN t.side = 'LONG' THEN 1 ELSE -1 END) FROM bars b
       WHERE b.symbol = t.symbol AND b.bar_index > t.entry_bar_index AND b.bar_index <= t.exit_bar_index), 0) AS funding_pnl_quote FROM xt t""",
    SIG_SQL,
    "funding_pnl_quote",
)
def _(spark, sf):
    rates = bars(spark, sf).select(*KEYS, "bar_index", (F.col("bar_index") % 3).alias("rate_bps"))
    return barrier.funding(exits(spark, sf), rates).select("trade_id", "funding_pnl_quote")


# by the share of each series that lies before the signal
PARTS = "CASE WHEN signal_bar_index < series_bars * 0.6 THEN 'train' WHEN signal_bar_index < series_bars * 0.8 THEN 'validation' ELSE 'test' END"


@query(
    "parameter_sweep",
    f"""WITH m AS (SELECT param_id, {", ".join(f"count(*) FILTER (part = '{p}') AS {p}_trades, coalesce(sum(net_pnl_quote) FILTER (part = '{p}'), 0) AS {p}_net_pnl" for p in ("train", "validation", "test"))}
      FROM (SELECT *, {PARTS} AS part FROM single JOIN (SELECT symbol, "interval", max(bar_index) + 1 AS series_bars FROM bars GROUP BY 1, 2) USING (symbol, "interval")) GROUP BY 1)
    SELECT *, CASE WHEN param_id = (SELECT param_id FROM m WHERE train_trades >= 5 AND validation_trades >= 5 ORDER BY validation_net_pnl DESC, train_net_pnl DESC, param_id DESC LIMIT 1) THEN 1 ELSE 0 END AS selected,
      CASE WHEN train_net_pnl > 0 AND test_net_pnl <= 0 THEN 'overfit_risk' ELSE '' END AS warning FROM m""",
    SINGLE_SQL,
    "train_net_pnl validation_net_pnl test_net_pnl",
    "selected",
)
def _(spark, sf):
    length = bars(spark, sf).groupBy(*KEYS).agg((F.max("bar_index") + 1).alias("series_bars"))
    return barrier.sweep(single(spark, sf).join(length, list(KEYS)), F.expr(PARTS))


@query(
    "manual_vs_rule_entries",
    """SELECT symbol, "interval", count(*) FILTER (a AND b) AS overlap_count, count(*) FILTER (a AND NOT b) AS manual_only_count, count(*) FILTER (b AND NOT a) AS rule_only_count, count(*) FILTER (a AND b) / cast(count(*) AS DOUBLE) AS jaccard
    FROM (SELECT symbol, "interval", i, bool_or(k = 'm') AS a, bool_or(k = 'r') AS b FROM (SELECT symbol, "interval", bar_index AS i, 'm' AS k FROM trade_events WHERE event_type = 'OPEN' UNION ALL
      SELECT symbol, "interval", entry_bar_index, 'r' FROM xt) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    f"{SIG_SQL}, {EVENTS_SQL}",
    "jaccard",
)
def _(spark, sf):
    return T.compare_entries(paired(spark, sf), exits(spark, sf))
