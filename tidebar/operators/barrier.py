"""Rule trades as tables: every signal gets its exit by the first barrier touched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import digest_id
from .chunks import CHUNK, KEYS, over_chunks, running
from .labels import path
from .overlap import greedy_non_overlapping
from .trades import outcome_columns

# One parameter set of the exit rule.
DEFAULTS = {"param_id": "base", "stop_pct": 1.5, "take_pct": 3.0, "max_hold": 20, "take_first": False}


def param_array(params: Sequence[dict]) -> Column:
    """Parameter sets of a sweep as a literal array."""
    full = [{**DEFAULTS, **p} for p in params]
    return F.array(
        *[
            F.struct(
                F.lit(p["param_id"]).alias("param_id"), F.lit(float(p["stop_pct"])).alias("stop_pct"), F.lit(float(p["take_pct"])).alias("take_pct"),
                F.lit(int(p["max_hold"])).alias("max_hold"), F.lit(bool(p["take_first"])).alias("take_first"),
            )
            for p in full
        ]
    )


def barrier_exits(
    bars: DataFrame, signals: DataFrame, params: Sequence[dict] = (DEFAULTS,), fee_bps: float = 4.0, notional: float = 1000.0, size: int = CHUNK
) -> DataFrame:
    """Entry at the next open, exit at the first of stop, target or time limit, for every signal and parameter set.

    ``signals`` has symbol, interval, bar_index and side. A limit exit fills at the open
    after the last held bar, or at the last close where the series ends.
    """
    reach = max(int({**DEFAULTS, **p}["max_hold"]) for p in params) + 1
    marked = bars.select(*KEYS, "bar_index", "open", "high", "low", "close").join(
        signals.select(*KEYS, "bar_index", "side"), [*KEYS, "bar_index"], "left"
    )
    wide = over_chunks(marked, lambda d, w: d.withColumn("_path", path(w, reach)), ahead=reach, size=size)
    df = wide.where(F.col("side").isNotNull() & (F.size("_path") > 0)).withColumn("_p", F.explode(param_array(params)))
    held = F.slice("_path", F.lit(1), F.col("_p.max_hold"))
    entry = F.get("_path", F.lit(0))["open"]
    short = F.col("side") == "SHORT"
    up_stop, up_take = 1.0 - F.col("_p.stop_pct") / 100.0, 1.0 + F.col("_p.take_pct") / 100.0
    dn_stop, dn_take = 1.0 + F.col("_p.stop_pct") / 100.0, 1.0 - F.col("_p.take_pct") / 100.0
    df = df.withColumns({"entry_price": entry, "_held": held}).withColumns(
        {
            "_stop": F.when(short, F.col("entry_price") * dn_stop).otherwise(F.col("entry_price") * up_stop),
            "_take": F.when(short, F.col("entry_price") * dn_take).otherwise(F.col("entry_price") * up_take),
        }
    )

    def first(test) -> Column:
        at = F.array_position(F.transform("_held", test), True)
        return F.when(at > 0, at)

    stop = first(lambda b: F.when(short, b["high"] >= F.col("_stop")).otherwise(b["low"] <= F.col("_stop")))
    take = first(lambda b: F.when(short, b["low"] <= F.col("_take")).otherwise(b["high"] >= F.col("_take")))
    df = df.withColumns({"_s": stop, "_t": take})
    s, t = F.col("_s"), F.col("_t")
    took = t.isNotNull() & (s.isNull() | (t < s) | ((t == s) & F.col("_p.take_first")))
    reason = (
        F.when(took, "take_profit").when(s.isNotNull(), "stop_loss").when(F.size("_path") > F.col("_p.max_hold"), "max_bars_hold").otherwise("end_of_data")
    )
    df = df.withColumn("exit_reason", reason)
    why = F.col("exit_reason")
    steps = F.when(why == "take_profit", t).when(why == "stop_loss", s).when(why == "max_bars_hold", F.col("_p.max_hold") + 1).otherwise(F.size("_path"))
    price = (
        F.when(why == "take_profit", F.col("_take")).when(why == "stop_loss", F.col("_stop"))
        .when(why == "max_bars_hold", F.get("_path", F.col("_p.max_hold"))["open"]).otherwise(F.element_at("_path", -1)["close"])
    )
    out = df.select(
        digest_id("bt_", *KEYS, "bar_index", "_p.param_id").alias("trade_id"), F.col("_p.param_id").alias("param_id"), *KEYS, "side",
        F.col("bar_index").alias("signal_bar_index"), (F.col("bar_index") + 1).alias("entry_bar_index"), (F.col("bar_index") + steps).alias("exit_bar_index"),
        # a limit exit leaves at an open, so that bar may signal again
        (F.col("bar_index") + steps - F.when(why == "max_bars_hold", 1).otherwise(0)).alias("blocked_until"),
        "entry_price", price.alias("exit_price"), "exit_reason",
    )
    return out.withColumns(outcome_columns(F.col("entry_price"), F.col("exit_price"), F.col("side"), notional, fee_bps))


def one_at_a_time(trades: DataFrame, cooldown: int = 0, size: int = CHUNK) -> DataFrame:
    """Keep the trades a single position would take: a signal inside a kept trade, or its cooldown, is dropped."""
    spaced = trades.withColumn("_until", F.greatest(F.col("blocked_until"), F.col("signal_bar_index") + cooldown))
    return greedy_non_overlapping(spaced, [*KEYS, "param_id"], "signal_bar_index", "_until", "trade_id", size).drop("_until")


def marked_equity(trades: DataFrame, bars: DataFrame, notional: float = 1000.0) -> DataFrame:
    """Open profit of held trades at every close, and realised profit on the exit bar; a trade spans few bars."""
    held = trades.select("param_id", *KEYS, "side", "entry_price", "net_pnl_quote", "exit_bar_index", F.explode(F.sequence("entry_bar_index", "exit_bar_index")).alias("bar_index"))
    px = bars.select(*KEYS, "bar_index", "close")
    out = held.join(px, [*KEYS, "bar_index"])
    done = F.col("bar_index") == F.col("exit_bar_index")
    open_pnl = (F.col("close") / F.col("entry_price") - 1.0) * F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0) * notional
    return out.groupBy("param_id", *KEYS, "bar_index").agg(
        F.sum(F.when(done, F.lit(0.0)).otherwise(open_pnl)).alias("unrealized_pnl"),
        F.sum(F.when(done, F.col("net_pnl_quote")).otherwise(0.0)).alias("realized_net_pnl"),
        F.count_if(~done).alias("open_positions"),
    )


def equity_table(trades: DataFrame, bars: DataFrame, initial: float = 10_000.0, notional: float = 1000.0, fee_bps: float = 4.0, size: int = CHUNK) -> DataFrame:
    """Cash, open profit after fees, equity, peak and drawdown at the close of every bar of each series and parameter set.

    A held trade is marked as if it were closed there, with both fees; on its exit bar its
    profit moves to cash. ``trades`` may carry ``funding_pnl_quote``.
    """
    paid = F.coalesce("funding_pnl_quote", F.lit(0.0)) if "funding_pnl_quote" in trades.columns else F.lit(0.0)
    held = trades.select("param_id", *KEYS, "side", "entry_price", "net_pnl_quote", paid.alias("_paid"), "exit_bar_index", F.explode(F.sequence("entry_bar_index", "exit_bar_index")).alias("bar_index"))
    px = bars.select(*KEYS, "bar_index", "close")
    done = F.col("bar_index") == F.col("exit_bar_index")
    mark = outcome_columns(F.col("entry_price"), F.col("close"), F.col("side"), notional, fee_bps)["net_pnl_quote"]
    marks = held.join(px, [*KEYS, "bar_index"]).groupBy("param_id", *KEYS, "bar_index").agg(
        F.sum(F.when(done, 0.0).otherwise(mark + F.col("_paid"))).alias("unrealized_pnl"),
        F.sum(F.when(done, F.col("net_pnl_quote") + F.col("_paid")).otherwise(0.0)).alias("realized_net_pnl"),
    )
    sets = trades.select("param_id", *KEYS).distinct()
    line = px.join(sets, list(KEYS)).join(marks, ["param_id", *KEYS, "bar_index"], "left").fillna(0.0, ["unrealized_pnl", "realized_net_pnl"])
    keys = ["param_id", *KEYS]
    cash = running(line, {"_won": ("sum", F.col("realized_net_pnl"))}, keys=keys, size=size).withColumn("cash_equity", F.lit(initial) + F.col("_won"))
    cash = cash.withColumn("equity_after", F.col("cash_equity") + F.col("unrealized_pnl"))
    top = running(cash, {"_top": ("max", F.col("equity_after"))}, keys=keys, size=size).withColumn("peak_equity", F.greatest(F.lit(initial), F.col("_top")))
    down = F.when(F.col("peak_equity") != 0, (F.col("equity_after") / F.col("peak_equity") - 1.0) * 100.0).otherwise(0.0)
    return top.select(*keys, "bar_index", "cash_equity", "unrealized_pnl", "realized_net_pnl", "equity_after", "peak_equity", down.alias("drawdown_pct"))


def funding(trades: DataFrame, rates: DataFrame, notional: float = 1000.0) -> DataFrame:
    """Funding profit of each trade: the rate of every bar after entry up to the exit, against a long position.

    ``rates`` has symbol, interval, bar_index and rate_bps.
    """
    held = trades.where(F.col("exit_bar_index") > F.col("entry_bar_index")).select(
        "trade_id", *KEYS, "side", F.explode(F.sequence(F.col("entry_bar_index") + 1, F.col("exit_bar_index"))).alias("bar_index")
    )
    paid = held.join(rates.select(*KEYS, "bar_index", "rate_bps"), [*KEYS, "bar_index"]).groupBy("trade_id").agg(
        F.sum(-F.lit(notional) * F.col("rate_bps") / 10_000.0 * F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)).alias("funding_pnl_quote")
    )
    return trades.join(paid, "trade_id", "left").fillna(0.0, ["funding_pnl_quote"])


def result_summary(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trade counts, fees, averages and exit reasons per group."""
    r = F.col("net_return_pct")
    why = F.col("exit_reason")
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("net_pnl_quote").alias("net_pnl"),
        F.sum(F.col("entry_fee_quote") + F.col("exit_fee_quote")).alias("total_fees"), F.avg(r).alias("average_return_pct"),
        (F.avg(F.when(r > 0, 100.0).otherwise(0.0))).alias("win_rate_pct"), F.avg(F.col("exit_bar_index") - F.col("entry_bar_index") + 1).alias("average_bars"),
        *[F.count_if(why == k).alias(f"exit_{k}") for k in ("take_profit", "stop_loss", "max_bars_hold", "end_of_data")],
    )


def sweep(trades: DataFrame, part: Column, minimum: int = 5) -> DataFrame:
    """Rank parameter sets on the training part, choose on validation, report the test part once.

    ``part`` maps a trade to train, validation or test. A set whose result falls apart
    outside training carries an overfit warning.
    """
    m = trades.withColumn("_part", part).groupBy("param_id").agg(
        *[
            agg.alias(f"{p}_{n}")
            for p in ("train", "validation", "test")
            for n, agg in (
                ("trades", F.count_if(F.col("_part") == p)),
                ("net_pnl", F.coalesce(F.sum(F.when(F.col("_part") == p, F.col("net_pnl_quote"))), F.lit(0.0))),
            )
        ]
    )
    usable = (F.col("train_trades") >= minimum) & (F.col("validation_trades") >= minimum)
    best = m.where(usable).agg(F.max_by("param_id", F.struct("validation_net_pnl", "train_net_pnl", "param_id")).alias("_best"))
    return m.crossJoin(F.broadcast(best)).select(
        "*", F.when(F.col("param_id") == F.col("_best"), 1).otherwise(0).alias("selected"),
        F.when((F.col("train_net_pnl") > 0) & (F.col("test_net_pnl") <= 0), "overfit_risk").otherwise("").alias("warning"),
    ).drop("_best")
