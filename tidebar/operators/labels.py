"""Outcome labels. Four contracts live side by side and never mix with inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions.scalar import change, digest_id, flag, null, ratio
from .chunks import CHUNK, KEYS, over_chunks, rows


def path(w: WindowSpec, ahead: int, start: int = 1) -> Column:
    """The coming bars as an array of (offset, open, high, low, close)."""
    bar = F.struct("bar_index", "open", "high", "low", "close")
    return F.collect_list(bar).over(rows(w, start, ahead))


def first_touch(bars: Column, high_hit, low_hit) -> tuple[Column, Column]:
    """Index of the first bar meeting each test, NULL when none does."""

    def first(test) -> Column:
        at = F.array_position(F.transform(bars, lambda b: F.coalesce(test(b), F.lit(False))), True)
        return F.when(at > 0, at)

    return first(high_hit), first(low_hit)


def stored_forward(bars: DataFrame, size: int = CHUNK) -> DataFrame:
    """Forward returns from the mid price with excursions; a cut-off future still counts."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        nxt = rows(w, 1, 10)
        mid = (F.col("high") + F.col("low")) / 2.0
        return d.withColumns(
            {
                "price_proxy": mid,
                **{f"fwd_ret_{k}": change(mid, F.lead("close", k).over(w)) for k in (1, 3, 5, 10)},
                "_top": F.max("high").over(nxt),
                "_low": F.min("low").over(nxt),
            }
        )

    return over_chunks(bars, build, ahead=10, size=size)


def stored_side(df: DataFrame, side: str = "side") -> DataFrame:
    """Turn the stored forward columns by trade side."""
    long = F.col(side) == "LONG"
    mid = F.col("price_proxy")
    sign = F.when(long, 1.0).otherwise(-1.0)
    return df.withColumns(
        {
            **{f"fwd_ret_{k}_side_adj": F.col(f"fwd_ret_{k}") * sign for k in (1, 3, 5, 10)},
            "mfe_10": F.when(long, change(mid, "_top")).otherwise(ratio(mid - F.col("_low"), mid)),
            "mae_10": F.when(long, change(mid, "_low")).otherwise(ratio(mid - F.col("_top"), mid)),
        }
    ).drop("_top", "_low")


def forward_paths(bars: DataFrame, ahead: int, size: int = CHUNK) -> DataFrame:
    """Every bar with its coming bars attached; join events to it by bar."""
    return over_chunks(bars, lambda d, w: d.withColumn("path", path(w, ahead)), ahead=ahead, size=size)


def event_labels(bars: DataFrame, events: DataFrame, trades: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """Forward returns, excursions, first-touch and class labels of events, priced at the event close."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        cols: dict[str, Column] = {f"_c{k}": F.lead("close", k).over(w) for k in (1, 3, 5, 10, 20)}
        for k in (5, 10, 20):
            cols[f"_h{k}"] = F.max("high").over(rows(w, 1, k))
            cols[f"_l{k}"] = F.min("low").over(rows(w, 1, k))
        ahead = path(w, 20)
        cols["_path"] = F.transform(ahead, lambda b: F.struct(b["high"].alias("high"), b["low"].alias("low")))
        return d.withColumns(cols)

    wide = over_chunks(bars.select(*KEYS, "bar_index", "open", "high", "low", "close"), build, ahead=20, size=size)
    df = events.join(wide, [*KEYS, "bar_index"])
    short = F.upper(F.coalesce("side", F.lit("LONG"))) == "SHORT"
    sign = F.when(short, -1.0).otherwise(1.0)
    base, p = F.col("close"), F.col("_path")
    cols: dict[str, Column] = {}
    for k in (1, 3, 5, 10, 20):
        cols[f"fwd_ret_{k}"] = change(base, f"_c{k}")
        cols[f"fwd_ret_{k}_side_adj"] = change(base, f"_c{k}") * sign
    for k in (5, 10, 20):
        up, down = change(base, f"_h{k}"), change(base, f"_l{k}")
        cols[f"mfe_{k}"] = F.when(short, -down).otherwise(up)
        cols[f"mae_{k}"] = F.when(short, -up).otherwise(down)
    ten = F.slice(p, 1, 10)
    at_top = F.array_position(F.transform(ten, lambda b: b["high"]), F.col("_h10"))
    at_low = F.array_position(F.transform(ten, lambda b: b["low"]), F.col("_l10"))
    cols["time_to_mfe_10"] = F.when(F.col("_h10").isNotNull(), F.when(short, at_low).otherwise(at_top)).cast("double")
    cols["time_to_mae_10"] = F.when(F.col("_h10").isNotNull(), F.when(short, at_top).otherwise(at_low)).cast("double")
    for tp, sl in ((0.01, 0.01), (0.02, 0.01)):
        goal, stop = first_touch(
            p,
            lambda b, tp=tp: F.when(short, b["low"] / base - 1.0 <= -tp).otherwise(b["high"] / base - 1.0 >= tp),
            lambda b, sl=sl: F.when(short, b["high"] / base - 1.0 >= sl).otherwise(b["low"] / base - 1.0 <= -sl),
        )
        won = goal.isNotNull() & (stop.isNull() | (goal < stop))
        cols[f"hit_tp_{round(tp * 100)}pct_before_sl_{round(sl * 100)}pct"] = F.when(F.size(p) > 0, flag(won))
    df = df.withColumns(cols)
    f10, up10, dn10 = F.col("fwd_ret_10_side_adj"), F.col("mfe_10"), F.col("mae_10")
    known = f10.isNotNull() & up10.isNotNull() & dn10.isNotNull()
    df = df.withColumns(
        {
            "good_reversal": F.when(known, flag((f10 > 0) & (dn10 > -0.01))),
            "failed_reversal": F.when(known, flag((f10 <= 0) & (dn10 <= -0.01))),
            "strong_rebound": F.when(f10.isNotNull(), flag(f10 >= 0.01)),
            "clean_trade": F.when(known, flag((up10 >= 0.01) & (dn10 > -0.005))),
            "trap_move": F.when(known, flag((up10 < 0.005) & (dn10 <= -0.01))),
        }
    ).drop("_path", *[f"_c{k}" for k in (1, 3, 5, 10, 20)], *[f"_{x}{k}" for x in "hl" for k in (5, 10, 20)])
    if trades is None:
        return df
    closed = trades.where(F.upper("status") == "CLOSED").select(
        "trade_id",
        F.coalesce("net_return_pct", "final_return_pct").alias("manual_return"),
        F.col("holding_bars").cast("double").alias("manual_holding_bars"),
    )
    return df.join(closed, "trade_id", "left").withColumn(
        "manual_win", F.when(F.col("manual_return").isNotNull(), flag(F.col("manual_return") > 0))
    )


def strategy_labels(labels: DataFrame) -> DataFrame:
    """Boolean outcome classes; an unknown outcome counts as false."""
    f5, f10 = F.col("fwd_ret_5_side_adj"), F.col("fwd_ret_10_side_adj")
    up, dn = F.col("mfe_10"), F.col("mae_10")
    return labels.select(
        "event_id",
        flag(f5 > 0).alias("label_win_5"),
        flag(f10 > 0).alias("label_win_10"),
        flag(f10 > 0.005).alias("label_strong_rebound_10"),
        flag((dn < -0.006) & (f10 <= 0)).alias("label_failed_reversal_10"),
        flag((up > 0.008) & (dn > -0.004)).alias("label_good_trade_10"),
        flag(dn < -0.008).alias("label_bad_trade_10"),
        F.abs(ratio(up, dn)).alias("mfe_mae_ratio_10"),
    )


# Accepted horizons and pricing bases.
HORIZONS = (5, 10, 20, 50)
PRICING = ("next_open", "event_close", "legacy_mid", "worst_case_same_bar")


def outcome_labels(
    bars: DataFrame,
    samples: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    pricing: Sequence[str] = PRICING,
    take_profit: float = 0.02,
    stop_loss: float = 0.01,
    version: str = "outcome_v1",
    size: int = CHUNK,
) -> DataFrame:
    """Long outcome rows per sample, horizon and pricing basis, with an insufficient-future flag."""
    reach = max(horizons)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        cols = {"_open": F.lead("open", 1).over(w)}
        for h in horizons:
            f = rows(w, 1, h)
            cols[f"_o{h}"] = F.struct(
                F.lit(h).alias("h"),
                F.count(F.lit(1)).over(f).alias("n"),
                F.lead("close", h).over(w).alias("exit"),
                F.max("high").over(f).alias("top"),
                F.min("low").over(f).alias("low"),
            )
        return d.withColumns(cols)

    wide = over_chunks(bars.select(*KEYS, "bar_index", "open", "high", "low", "close"), build, ahead=reach, size=size)
    df = samples.join(wide, [*KEYS, "bar_index"])
    short = F.upper(F.coalesce("side", F.lit("LONG"))) == "SHORT"
    prices = {
        "next_open": F.col("_open"),
        "event_close": F.col("close"),
        "legacy_mid": (F.col("high") + F.col("low")) / 2.0,
        "worst_case_same_bar": F.when(short, F.col("low")).otherwise(F.col("high")),
    }
    bases = F.array(*[F.struct(F.lit(p).alias("basis"), prices[p].alias("entry")) for p in pricing])
    long = (
        df.withColumn("_b", F.explode(bases))
        .withColumn("_o", F.explode(F.array(*[F.col(f"_o{h}") for h in horizons])))
        .withColumns({"_short": short, "_ok": (F.col("_o.n") >= F.col("_o.h")) & (F.col("_b.entry") > 0)})
    )
    e, o, ok = F.col("_b.entry"), F.col("_o"), F.col("_ok")

    def turned(x: Column, y: Column) -> Column:
        return F.when(ok, F.when(F.col("_short"), ratio(e, y) - 1.0).otherwise(x / e - 1.0))

    fwd, mfe, mae = turned(o["exit"], o["exit"]), turned(o["top"], o["low"]), turned(o["low"], o["top"])
    return long.select(
        digest_id("out_", "sample_id", F.lit(version), o["h"], "_b.basis").alias("outcome_label_id"),
        "sample_id",
        F.lit(version).alias("label_version"),
        *KEYS,
        "bar_index",
        o["h"].alias("horizon_bars"),
        F.col("_b.basis").alias("pricing_basis"),
        fwd.alias("fwd_ret"),
        mfe.alias("mfe"),
        mae.alias("mae"),
        F.when(mfe.isNotNull(), F.when(mfe >= take_profit, 1).otherwise(0)).alias("hit_tp"),
        F.when(mae.isNotNull(), F.when(mae <= -stop_loss, 1).otherwise(0)).alias("hit_sl"),
        (fwd / stop_loss if stop_loss > 0 else null()).alias("r_multiple"),
        F.when(o["n"] < o["h"], 1).otherwise(0).alias("insufficient_future_bars"),
    )


def entry_outcome_columns(horizons: Sequence[int]) -> list[str]:
    """Column layout of the entry outcome table for a horizon list."""
    return [
        "observation_id",
        *[f"fwd_ret_{h}" for h in dict.fromkeys(horizons)],
        "mfe_10", "mae_10", "hit_tp_10", "hit_sl_10", "hit_tp_before_sl_10",
    ]


def entry_outcomes(
    bars: DataFrame,
    obs: DataFrame,
    horizons: Sequence[int] = (5, 10, 20),
    take_profit: float = 0.02,
    stop_loss: float = 0.01,
    fee_bps: float = 0.0,
    slippage_bps: float = 0.0,
    same_bar: str = "stop_loss_first",
    drop_short: bool = False,
    size: int = CHUNK,
) -> DataFrame:
    """Cost-adjusted forward returns and the ten-bar path of entry observations; untouched stays NULL."""
    cost = 2.0 * (max(0.0, fee_bps) + max(0.0, slippage_bps)) / 10_000.0

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        ten = rows(w, 1, 10)
        close = F.col("close")
        ok = close > 0
        ahead = path(w, 10)
        full = ok & (F.size(ahead) >= 10)
        mfe = F.when(full, F.max("high").over(ten) / close - 1.0)
        mae = F.when(full, F.min("low").over(ten) / close - 1.0)
        goal, stop = first_touch(
            ahead,
            lambda b: b["high"] >= close * (1.0 + max(0.0, take_profit)),
            lambda b: b["low"] <= close * (1.0 - max(0.0, stop_loss)),
        )
        tie = {"take_profit_first": F.lit(1.0), "ambiguous": null()}.get(same_bar, F.lit(0.0))
        touch = (
            F.when(goal.isNull() & stop.isNull(), null())
            .when(goal == stop, tie)
            .when(stop.isNull() | (goal < stop), 1.0)
            .otherwise(0.0)
        )
        return d.withColumns(
            {
                **{
                    f"fwd_ret_{h}": F.when(ok, F.lead("close", h).over(w) / close - 1.0 - cost)
                    for h in dict.fromkeys(horizons)
                },
                "mfe_10": mfe,
                "mae_10": mae,
                "hit_tp_10": F.when(full, flag(mfe >= take_profit)),
                "hit_sl_10": F.when(full, flag(mae <= -stop_loss)),
                "hit_tp_before_sl_10": F.when(full, touch),
            }
        )

    reach = max(10, *horizons)
    wide = over_chunks(bars.select(*KEYS, "bar_index", "high", "low", "close", "open"), build, ahead=reach, size=size)
    out = obs.select("observation_id", *KEYS, "bar_index").join(wide, [*KEYS, "bar_index"], "left").select(
        *entry_outcome_columns(horizons)
    )
    if drop_short:
        out = out.dropna(subset=[f"fwd_ret_{h}" for h in horizons])
    return out


def label_window(df: DataFrame, horizon: int, bar: str = "bar_index") -> DataFrame:
    """Closed interval of bars an outcome looks at."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    return df.withColumns(
        {"label_start_bar": F.col(bar) + 1, "label_end_bar": F.col(bar) + horizon}
    )
