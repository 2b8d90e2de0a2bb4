"""Trade pairing, fills, equity and performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import DAY_MS, INTERVAL_MS, flag, null, ratio
from .chunks import CHUNK, KEYS, dense_index, over_chunks, running
from .quantiles import exact_quantiles
from .series import longest_streaks, max_drawdown

# Bars per year by interval.
PERIODS_PER_YEAR = {k: 365.0 * DAY_MS / v for k, v in INTERVAL_MS.items()}

TIME_BIN = DAY_MS * 365


def pair_events(events: DataFrame) -> DataFrame:
    """One row per trade from its OPEN and CLOSE marks; the latest mark of a kind wins."""
    kind = F.upper("event_type")
    order = F.struct("open_time_ms", "event_id")
    mark = F.struct("event_id", "bar_index", "open_time_ms")

    def side_of(k: str, what) -> Column:
        return F.max_by(what, F.when(kind == k, order))

    out = events.groupBy("trade_id").agg(
        side_of("OPEN", F.struct("session_id", *KEYS, "side")).alias("_t"), side_of("OPEN", mark).alias("_o"), side_of("CLOSE", mark).alias("_c")
    ).where(F.col("_o").isNotNull())
    return out.select(
        "trade_id", "_t.session_id", "_t.symbol", "_t.interval", "_t.side",
        F.col("_o.event_id").alias("entry_event_id"), F.col("_o.bar_index").alias("entry_bar_index"), F.col("_o.open_time_ms").alias("entry_time_ms"),
        F.col("_c.event_id").alias("exit_event_id"), F.col("_c.bar_index").alias("exit_bar_index"), F.col("_c.open_time_ms").alias("exit_time_ms"),
        F.when(F.col("_c").isNull(), "OPEN").otherwise("CLOSED").alias("status"),
        (F.col("_c.bar_index") - F.col("_o.bar_index")).alias("holding_bars"),
    )


def fill_mode(mode: str) -> str:
    m = str(mode or "MID").strip().upper()
    return m if m in ("MID", "CLOSE", "OPEN") else "MID"


def raw_price(mode: str, p: str = "") -> Column:
    m = fill_mode(mode)
    if m == "MID":
        return (F.col(f"{p}high") + F.col(f"{p}low")) / 2.0
    return F.col(f"{p}{m.lower()}")


def filled_price(raw: Column, side: Column, opening: bool, slippage_bps: float) -> Column:
    """Adverse slippage: buyers pay more, sellers get less."""
    slip = max(0.0, slippage_bps) / 10_000.0
    buys = (side == "LONG") if opening else (side == "SHORT")
    return F.when(buys, raw * (1.0 + slip)).otherwise(raw * (1.0 - slip))


def outcome_columns(entry: Column, exit_: Column, side: Column, notional: float, fee_bps: float) -> dict[str, Column]:
    """Quantity, fees and returns of a round trip; a bad price gives zeros."""
    ok = (entry > 0) & (exit_ > 0) & F.lit(notional > 0)
    fee = max(0.0, fee_bps) / 10_000.0
    qty = F.lit(float(notional)) / entry
    gross = (exit_ - entry) * qty * F.when(side == "LONG", 1.0).otherwise(-1.0)
    fee_in, fee_out = F.lit(notional * fee), qty * exit_ * fee

    def safe(x: Column) -> Column:
        return F.when(exit_.isNull(), null()).when(ok, x).otherwise(0.0)

    return {
        "quantity": safe(qty),
        "entry_fee_quote": safe(fee_in),
        "exit_fee_quote": safe(fee_out),
        "gross_pnl_quote": safe(gross),
        "net_pnl_quote": safe(gross - fee_in - fee_out),
        "gross_return_pct": safe(gross / notional * 100.0),
        "net_return_pct": safe((gross - fee_in - fee_out) / notional * 100.0),
        "fee_return_pct": safe((fee_in + fee_out) / notional * 100.0),
    }


def priced_trades(trades: DataFrame, bars: DataFrame, mode: str = "MID", slippage_bps: float = 0.0, fee_bps: float = 4.0, notional: float = 1000.0) -> DataFrame:
    """Trades with fills at both ends and their outcome."""
    px = bars.select(*KEYS, "bar_index", raw_price(mode).alias("_raw"))
    a = px.select(*KEYS, F.col("bar_index").alias("entry_bar_index"), F.col("_raw").alias("entry_raw_price"))
    b = px.select(*KEYS, F.col("bar_index").alias("exit_bar_index"), F.col("_raw").alias("exit_raw_price"))
    t = trades.join(a, [*KEYS, "entry_bar_index"], "left").join(b, [*KEYS, "exit_bar_index"], "left")
    t = t.withColumns(
        {
            "entry_fill_price": filled_price(F.col("entry_raw_price"), F.col("side"), True, slippage_bps),
            "exit_fill_price": filled_price(F.col("exit_raw_price"), F.col("side"), False, slippage_bps),
        }
    )
    return t.withColumns(outcome_columns(F.col("entry_fill_price"), F.col("exit_fill_price"), F.col("side"), notional, fee_bps)).withColumn(
        "final_return_pct", F.col("gross_return_pct")
    )


def realized(kind: str, notional: float = 1000.0) -> Column:
    """Realised PnL with its fallbacks to a return on the notional."""
    if kind == "net":
        return F.coalesce("net_pnl_quote", F.coalesce("final_return_pct", F.lit(0.0)) / 100.0 * notional)
    back = F.coalesce("gross_return_pct", "final_return_pct", F.lit(0.0))
    return F.coalesce("gross_pnl_quote", back / 100.0 * notional)


def equity_curve(trades: DataFrame, initial: float = 10_000.0, notional: float = 1000.0, keys: Sequence[str] = ("session_id",), size: int = CHUNK) -> DataFrame:
    """Running account per session over closed trades in exit order, with drawdown from the running peak."""
    closed = trades.where("status = 'CLOSED'").withColumns(
        {
            "realized_gross_pnl": realized("gross", notional),
            "realized_net_pnl": realized("net", notional),
            "realized_fee": F.coalesce("entry_fee_quote", F.lit(0.0)) + F.coalesce("exit_fee_quote", F.lit(0.0)),
        }
    )
    seq = dense_index(closed, keys, "exit_time_ms", TIME_BIN, name="_pos", ties=("trade_id",))
    run = running(seq, {"_sum": ("sum", F.col("realized_net_pnl"))}, keys=keys, index="_pos", size=size)
    run = run.withColumns({"equity_after": initial + F.col("_sum"), "equity_before": initial + F.col("_sum") - F.col("realized_net_pnl")})
    run = running(run, {"_peak": ("max", F.col("equity_after"))}, keys=keys, index="_pos", size=size)
    peak = F.greatest(F.lit(float(initial)), F.col("_peak"))
    return run.select(
        *keys, (F.col("_pos") + 1).alias("sequence_no"), "trade_id", F.col("exit_event_id").alias("event_id"), "equity_before", "realized_gross_pnl",
        "realized_fee", "realized_net_pnl", "equity_after",
        F.coalesce(ratio("realized_net_pnl", "equity_before") * 100.0, F.lit(0.0)).alias("equity_return_pct"),
        F.coalesce((ratio("equity_after", peak) - 1.0) * 100.0, F.lit(0.0)).alias("drawdown_pct"),
    )


def net_return() -> Column:
    return F.coalesce("net_return_pct", "final_return_pct")


def return_metrics(r: Column) -> dict[str, Column]:
    """Aggregates of a return column in percent."""
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    return {
        "win_rate_pct": F.avg(F.when(r.isNotNull(), flag(r > 0))) * 100.0,
        "loss_rate_pct": F.avg(F.when(r.isNotNull(), flag(r < 0))) * 100.0,
        "average_return_pct": F.avg(r),
        "average_win_pct": F.avg(win),
        "average_loss_pct": F.avg(loss),
        "max_profit_pct": F.max(win),
        "max_loss_pct": F.min(loss),
        "gross_profit_pct": F.coalesce(F.sum(win), F.lit(0.0)),
        "gross_loss_pct": F.coalesce(F.sum(loss), F.lit(0.0)),
        "profit_factor": F.when(F.count(win) > 0, ratio(F.sum(win), F.abs(F.sum(loss)))),
        "payoff_ratio": ratio(F.avg(win), F.abs(F.avg(loss))),
        "win_loss_ratio": ratio(F.count(win), F.count(loss)),
    }


def sharpe(r: Column, periods: float | None = None, risk_free: float = 0.0) -> Column:
    """Mean over sample deviation of excess returns, annualised when periods are given."""
    x = r - (risk_free / periods if periods else risk_free)
    out = F.when(F.count(x) >= 2, ratio(F.avg(x), F.stddev_samp(x)))
    return out * (periods**0.5) if periods else out


def sortino(r: Column, periods: float | None = None, risk_free: float = 0.0) -> Column:
    """As the Sharpe ratio over the deviation of losses; a single loss counts by its size."""
    x = r - (risk_free / periods if periods else risk_free)
    bad = F.when(x < 0, x)
    spread = F.when(F.count(bad) == 1, F.abs(F.max(bad))).otherwise(F.nullif(F.stddev_samp(bad), F.lit(0.0)))
    out = F.when((F.count(x) >= 2) & (F.count(bad) > 0), ratio(F.avg(x), spread))
    return out * (periods**0.5) if periods else out


def performance_summary(trades: DataFrame, key: str = "session_id", size: int = CHUNK) -> DataFrame:
    """Trade statistics per session for all trades and for each side, in long form."""
    both = trades.withColumn("side_group", F.explode(F.array(F.lit("ALL"), F.col("side"))))
    keys = [key, "side_group"]
    closed = F.col("status") == "CLOSED"
    r = F.when(closed, net_return())
    m = return_metrics(r)
    names = ("win_rate_pct", "average_return_pct", "max_profit_pct", "max_loss_pct", "average_win_pct", "average_loss_pct", "payoff_ratio")
    base = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(closed).alias("closed_trades"), F.count_if(F.col("status") == "OPEN").alias("open_trades"),
        F.avg(F.when(closed, F.col("holding_bars"))).alias("average_holding_bars"),
        ratio(F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"),
        *[m[n].alias(n) for n in names],
    )
    seq = dense_index(both.where(closed).withColumn("_r", net_return()).where("_r is not null"), keys, "exit_time_ms", TIME_BIN, name="_pos", ties=("trade_id",))
    runs = longest_streaks(seq, "_r", keys, "_pos", size)
    return base.join(runs, keys, "left").fillna(0, ["max_consecutive_wins", "max_consecutive_losses"])


def flat_summary(long: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per session with long_ and short_ columns beside the overall ones."""
    values = [c for c in long.columns if c not in (key, "side_group")]
    cols = []
    for g, p in (("ALL", ""), ("LONG", "long_"), ("SHORT", "short_")):
        cols += [F.max(F.when(F.col("side_group") == g, F.col(v))).alias(f"{p}{v}") for v in values]
    return long.groupBy(key).agg(*cols)


def recent_trade(trades: DataFrame, key: str = "session_id") -> DataFrame:
    """The latest trade of a session, closed ones first."""
    closed = F.col("status") == "CLOSED"
    order = F.struct(closed.alias("c"), F.coalesce("exit_time_ms", "entry_time_ms").alias("t"), "trade_id")
    row = F.struct("trade_id", "side", "status", net_return().alias("return_pct"), "holding_bars")
    return trades.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(
        key, *[F.col(f"_r.{n}").alias(f"recent_trade_{n.removeprefix('trade_')}") for n in ("trade_id", "side", "status", "return_pct", "holding_bars")]
    )


def trade_analysis(trades: DataFrame, equity: DataFrame, initial: float, interval: str, key: str = "session_id", size: int = CHUNK) -> DataFrame:
    """Whole analysis of a session: returns, tails, ratios, equity and drawdown."""
    closed = trades.where("status = 'CLOSED'").withColumn("_r", net_return())
    counts = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(F.col("status") == "OPEN").alias("open_trades"),
        F.when(F.max(F.col("trade_id").startswith("bt_")), "backtest_records").otherwise("manual_replay_records").alias("basis"),
    )
    r = F.col("_r")
    base = closed.groupBy(key).agg(
        F.count(F.lit(1)).alias("closed_trades"), *[c.alias(n) for n, c in return_metrics(r).items()],
        sharpe(r).alias("trade_sharpe"), sortino(r).alias("trade_sortino"),
    )
    q = exact_quantiles(closed, [key], "_r", [0.05, 0.5], ["var_5_pct", "median_return_pct"])
    tail = closed.join(q, key).where(r <= F.col("var_5_pct")).groupBy(key).agg(F.avg(r).alias("cvar_5_pct"))
    moves = over_chunks(
        equity.withColumn("_i", F.col("sequence_no") - 1),
        lambda d, w: d.withColumn("_x", F.when(F.col("_i") > 0, ratio("equity_after", F.lag("equity_after").over(w)) - 1.0).otherwise(F.col("equity_after") / F.lit(initial) - 1.0)),
        back=1, keys=[key], index="_i", size=size,
    )
    periods = PERIODS_PER_YEAR[interval]
    x = F.col("_x")
    eq = moves.groupBy(key).agg(
        F.max_by("equity_after", "sequence_no").alias("final_equity"), sharpe(x, periods).alias("time_sharpe"), sortino(x, periods).alias("time_sortino"),
        F.min("drawdown_pct").alias("max_drawdown_pct"), F.avg(F.col("equity_return_pct") / 100.0).alias("_m"), F.stddev_pop(F.col("equity_return_pct") / 100.0).alias("_s"),
        F.stddev_pop(F.when(F.col("equity_return_pct") < 0, F.col("equity_return_pct") / 100.0)).alias("_d"), F.count(F.lit(1)).alias("_n"),
    )
    total = (F.col("final_equity") / F.lit(initial) - 1.0) * 100.0
    out = counts.join(base, key, "left").join(q, key, "left").join(tail, key, "left").join(eq, key, "left")
    return out.withColumns(
        {
            "initial_equity": F.lit(float(initial)),
            "total_net_pnl": F.col("final_equity") - initial,
            "total_return_pct": total,
            "calmar_ratio": ratio(total, F.abs("max_drawdown_pct")),
            "sharpe_trade": F.when(F.col("_n") >= 2, ratio("_m", "_s")),
            "sortino_trade": ratio("_m", "_d"),
        }
    ).drop("_m", "_s", "_d", "_n")


def equity_drawdown(equity: DataFrame, initial: float, key: str = "session_id", size: int = CHUNK) -> DataFrame:
    """Deepest equity drawdown with start and end, the initial balance being position 0."""
    first = equity.select(key).distinct().select(key, F.lit(float(initial)).alias("value"), F.lit(0).cast("long").alias("pos"))
    rest = equity.select(key, F.col("equity_after").alias("value"), F.col("sequence_no").cast("long").alias("pos"))
    return max_drawdown(first.unionByName(rest), "value", [key], "pos", size)


def compare_entries(manual: DataFrame, rule: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entry bars marked by hand against those of a rule: overlap, exclusives and Jaccard."""
    on = [*keys, "entry_bar_index"]
    a = manual.select(*on).distinct().withColumn("_a", F.lit(1))
    b = rule.select(*on).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, on, "full_outer")
    m, r = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.groupBy(*keys).agg(
        F.count_if(m & r).alias("overlap_count"), F.count_if(m & ~r).alias("manual_only_count"), F.count_if(r & ~m).alias("rule_only_count"),
        (F.count_if(m & r) / F.count(F.lit(1))).alias("jaccard"),
    )
