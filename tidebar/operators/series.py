"""Bar-series operators: returns, volatility, regimes, runs, higher timeframes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.scalar import INTERVAL_MS, change, finite, flag, interval_ms, ln_pos, null, ratio, zero_padded
from .chunks import CHUNK, KEYS, over_chunks, rows, running
from .prefix_median import expanding_median
from .quantiles import exact_quantiles


def _at_least(value: Column, counted: Column, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(counted).over(w) >= n, value)


def pop_z(value: Column, frame: WindowSpec, minimum: int = 2, eps: float = 0.0) -> Column:
    """Population z-score of a value against a frame; NULL for a flat or short frame."""
    return _at_least(
        ratio(value - F.avg(value).over(frame), F.stddev_pop(value).over(frame), eps), value, minimum, frame
    )


def with_returns(df: DataFrame, w: WindowSpec) -> DataFrame:
    prev = F.lag("close").over(w)
    return df.withColumns(
        {
            "simple_return": change(prev, "close"),
            "log_return": ln_pos(ratio("close", prev)),
        }
    ).withColumns({"abs_return": F.abs("log_return"), "squared_return": F.col("log_return") * F.col("log_return")})


def add_return_columns(df: DataFrame, w: WindowSpec) -> DataFrame:
    out = with_returns(df, w)
    r, down = F.col("log_return"), F.when(F.col("log_return") < 0, F.col("log_return"))
    w20, w50 = rows(w, -19, 0), rows(w, -49, 0)
    span = F.col("high") - F.col("low")
    return out.withColumns(
        {
            **{f"rolling_return_{k}": change(F.lag("close", k).over(w), "close") for k in (5, 10, 20)},
            "rolling_volatility_20": F.stddev_samp(r).over(w20),
            "rolling_volatility_50": F.stddev_samp(r).over(w50),
            "realized_volatility_20": _at_least(F.sqrt(F.sum("squared_return").over(w20)), r, 2, w20),
            "downside_volatility_20": F.stddev_samp(down).over(w20),
            "high_low_range_pct": ratio(span, "close"),
            "close_position": ratio(F.col("close") - F.col("low"), span),
            "volume_zscore_20": pop_z(F.col("volume"), w20),
            "return_zscore_20": pop_z(r, w20),
        }
    )


def return_series(bars: DataFrame, size: int = CHUNK, keep: bool = False) -> DataFrame:
    """Whole-series returns, volatilities and z-scores of every bar."""
    return over_chunks(bars, add_return_columns, back=51, size=size, keep=keep)


def bar_returns(bars: DataFrame, size: int = CHUNK, keep: bool = False) -> DataFrame:
    return over_chunks(bars, with_returns, back=1, size=size, keep=keep)


def window_return_series(windows: DataFrame) -> DataFrame:
    """Returns inside event windows; nothing crosses from one event to another.

    A window holds a fixed number of rows, so the event is the partition.
    """
    real = windows.where(F.col("bar_index").isNotNull())
    w = Window.partitionBy("event_id").orderBy("offset")
    out = add_return_columns(real, w)
    return out.withColumns({"segment_id": F.col("event_id"), "is_segment_start": flag(F.row_number().over(w) == 1)})


def segments(df: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """Number the runs of consecutive ``bar_index`` values of a filtered series."""
    from .chunks import dense_index

    pos = dense_index(df, keys, "bar_index", size, name="_pos")
    cut = over_chunks(
        pos,
        lambda d, w: d.withColumn(
            "_jump", F.when(F.coalesce(F.col("bar_index") - F.lag("bar_index").over(w), F.lit(1)) != 1, 1).otherwise(0)
        ),
        back=1,
        keys=keys,
        index="_pos",
        size=size,
        keep=True,
    )
    out = running(cut, {"segment": ("sum", F.col("_jump"))}, keys=keys, index="_pos", size=size)
    return out.drop("_jump", "_pos")


def segment_return_series(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Return series of fragments without an event id, cut at every gap in ``bar_index``."""
    from .chunks import dense_index

    seg = segments(df, size=size)
    keys = [*KEYS, "segment"]
    pos = dense_index(seg, keys, "bar_index", size, name="_pos")
    out = over_chunks(pos, add_return_columns, back=51, keys=keys, index="_pos", size=size)
    return out.withColumn("is_segment_start", flag(F.col("_pos") == 0)).drop("_pos")


def long_horizon_returns(bars: DataFrame, benchmark: DataFrame, window: int = 10, size: int = CHUNK) -> DataFrame:
    """Cumulative, rolling-sum and excess log returns; ``benchmark`` has open_time_ms and benchmark_log_return."""
    r = over_chunks(
        bars,
        lambda d, w: with_returns(d, w).withColumn(
            "rolling_log_return", F.sum("log_return").over(rows(w, 1 - window, 0))
        ),
        back=window + 1,
        size=size,
        keep=True,
    )
    cum = running(r, {"cumulative_log_return": ("sum", F.coalesce("log_return", F.lit(0.0)))}, size=size)
    return cum.join(benchmark, "open_time_ms", "left").withColumn(
        "excess_return", F.col("log_return") - F.col("benchmark_log_return")
    )


def annualized(returns: DataFrame, periods: int) -> DataFrame:
    per_year = F.avg("log_return") * periods
    return returns.groupBy(*KEYS).agg(
        per_year.alias("annualized_log_return"), finite(F.expm1(per_year)).alias("annualized_return")
    )


def ewma_variance(returns: DataFrame, decay: float = 0.94, size: int = CHUNK) -> DataFrame:
    """Exponentially weighted variance of ``log_return``, seeded by the first square.

    A block is as long as the weights in it stay in range (1e-30), or one chunk for slow
    decays; the carry into a block takes the block ends before it as far back as their
    weight is above 1e-30, however many those are. Rows without a return keep the last value.
    """
    if not 0.0 < decay < 1.0:
        raise ValueError("decay must lie between 0 and 1")
    fade = 30 * math.log(10) / -math.log(decay)
    block = int(min(CHUNK, max(16, math.ceil(fade))))
    terms = math.ceil(fade / block) + 1
    known = running(
        returns, {"_seen": ("count", F.col("log_return"))}, size=size
    )
    sq = F.col("log_return") * F.col("log_return")
    k = F.col("_seen") - 1
    base = (
        known.withColumns({"_blk": F.when(k >= 0, F.floor(k / block)), "_pos": F.when(k >= 0, k % block)})
        .withColumn("_w", F.when(F.col("log_return").isNotNull(), F.when(k == 0, sq).otherwise(sq * (1 - decay))))
    )
    ends = base.where(F.col("_w").isNotNull()).groupBy(*KEYS, "_blk").agg(
        F.sum(F.col("_w") * F.pow(F.lit(decay), F.lit(block - 1) - F.col("_pos"))).alias("_own")
    )

    def carry(d: DataFrame, w: WindowSpec) -> DataFrame:
        ends = F.collect_list("_own").over(rows(w, -terms, -1))
        return d.withColumn("_in", F.aggregate(ends, F.lit(0.0), lambda acc, x: acc * decay**block + x))

    carried = over_chunks(ends, carry, back=terms, index="_blk", size=size).drop("_own")
    inside = Window.partitionBy(*KEYS, "_blk").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(F.col("_w") * F.pow(F.lit(decay), -F.col("_pos"))).over(inside)
    joined = base.join(carried, [*KEYS, "_blk"], "left")
    return joined.withColumn(
        "ewma_variance",
        F.when(
            F.col("_pos").isNotNull(),
            F.pow(F.lit(decay), F.col("_pos")) * (scaled + decay * F.coalesce("_in", F.lit(0.0))),
        ),
    ).drop("_seen", "_blk", "_pos", "_w", "_in")


def volatility_now(returns: DataFrame, window: int = 20, size: int = CHUNK) -> DataFrame:
    """Latest rolling, realised and EWMA volatility with the percentile regime of the EWMA series."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        f = rows(w, 1 - window, 0)
        r = F.col("log_return")
        return d.withColumns(
            {
                "rolling_volatility": F.stddev_samp(r).over(f),
                "realized_volatility": _at_least(F.sqrt(F.sum(r * r).over(f)), r, 2, f),
            }
        )

    vol = ewma_variance(over_chunks(returns, build, back=window, size=size, keep=True), size=size).withColumn(
        "ewma_volatility", F.sqrt("ewma_variance")
    )

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("bar_index"))).alias(f"{name}_current")

    now = vol.groupBy(*KEYS).agg(*[latest(n) for n in ("rolling_volatility", "realized_volatility", "ewma_volatility")])
    share = (
        vol.where(F.col("ewma_volatility").isNotNull())
        .join(now, [*KEYS])
        .groupBy(*KEYS)
        .agg((F.avg(flag(F.col("ewma_volatility") <= F.col("ewma_volatility_current"))) * 100).alias("volatility_percentile"))
    )
    p = F.col("volatility_percentile")
    return now.join(share, [*KEYS], "left").withColumn(
        "regime",
        F.when(p.isNull(), "UNKNOWN")
        .when(p <= 25, "LOW")
        .when(p <= 75, "MID")
        .when(p <= 95, "HIGH")
        .otherwise("EXTREME"),
    )


def regimes(bars: DataFrame, window: int = 50, multiplier: float = 1.5, floor: float = 0.02, size: int = CHUNK) -> DataFrame:
    """Volatility regime by series quantiles, trend regime by a scaled move, drawdown from the running high."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = with_returns(d, w)
        f = rows(w, 1 - window, 0)
        top = F.max("close").over(f)
        return d.withColumns(
            {
                "rolling_max_close_50": top,
                "distance_to_rolling_high_50_pct": change(top, "close") * 100.0,
                "rolling_return_50": change(F.lag("close", window).over(w), "close"),
                "rolling_volatility_50": F.coalesce(
                    F.stddev_samp("log_return").over(f), F.stddev_samp("simple_return").over(f)
                ),
            }
        )

    base = over_chunks(bars, build, back=window + 1, size=size, keep=True)
    base = running(base, {"_peak": ("max", F.col("close"))}, size=size)
    q = exact_quantiles(base, KEYS, "rolling_volatility_50", [0.0, 0.25, 0.75, 0.9, 1.0], ["_q0", "_q25", "_q75", "_q90", "_q1"])
    v = F.col("rolling_volatility_50")
    varied = F.col("_q0") < F.col("_q1")
    limit = F.greatest(
        F.coalesce(multiplier * F.abs(v) * F.sqrt(F.lit(float(window))), F.lit(floor)), F.lit(floor)
    )
    move = F.col("rolling_return_50")
    out = base.join(q, [*KEYS], "left").withColumns(
        {
            "volatility_regime": F.when(v.isNull() | ~F.coalesce(varied, F.lit(False)), "normal_vol")
            .when(v <= F.col("_q25"), "low_vol")
            .when(v >= F.col("_q90"), "extreme_vol")
            .when(v >= F.col("_q75"), "high_vol")
            .otherwise("normal_vol"),
            "trend_threshold": limit,
            "trend_regime": F.when(move > limit, "uptrend").when(move < -limit, "downtrend").otherwise("range"),
            "drawdown_pct": change("_peak", "close") * 100.0,
        }
    )
    return out.withColumn("regime_label", F.concat_ws("_", "volatility_regime", "trend_regime")).drop(
        "_peak", "_q0", "_q25", "_q75", "_q90", "_q1"
    )


def regime_distribution(reg: DataFrame) -> DataFrame:
    """Count and share per series of each value of the three regime columns."""
    fields = ("volatility_regime", "trend_regime", "regime_label")
    long = reg.select(
        *KEYS,
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("unknown")).alias("value")) for f in fields])).alias("s"),
    ).select(*KEYS, "s.field", "s.value")
    n = long.groupBy(*KEYS, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*KEYS, "field")))


def liquidity_proxy(bars: DataFrame, window: int = 50, state_window: int = 100, eps: float = 1e-12, size: int = CHUNK) -> DataFrame:
    """Range and volume against rolling medians, impact z by median deviation, and a five-state label."""

    def median(x: Column, w: WindowSpec, n: int) -> Column:
        f = rows(w, 1 - n, 0)
        return F.when(F.count(x).over(f) == n, F.percentile(x, 0.5).over(f))

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        ok = (F.col("close") > 0) & (F.col("high") > 0) & (F.col("low") > 0)
        d = d.withColumns(
            {
                "log_return": ln_pos(ratio("close", F.lag("close").over(w))),
                "range_log": F.when(ok, F.ln(F.col("high") / F.col("low"))),
                "quote_volume": F.col("volume") * F.col("close"),
            }
        ).withColumn("_qv", F.when(ok & (F.col("quote_volume") > 0), F.col("quote_volume")))
        d = d.withColumns(
            {
                "range_vol_base": median(F.col("range_log"), w, window),
                "volume_base": median(F.col("_qv"), w, window),
            }
        ).withColumns(
            {
                "vol_ratio": F.col("range_log") / (F.col("range_vol_base") + eps),
                "volume_ratio": F.col("_qv") / (F.col("volume_base") + eps),
            }
        ).withColumn("impact_score", F.col("vol_ratio") / (F.col("volume_ratio") + eps))
        d = d.withColumn("impact_median", median(F.col("impact_score"), w, state_window))
        d = d.withColumn("_dev", F.abs(F.col("impact_score") - F.col("impact_median")))
        d = d.withColumn("impact_mad", median(F.col("_dev"), w, state_window))
        return d.withColumn(
            "impact_z", (F.col("impact_score") - F.col("impact_median")) / (1.4826 * F.col("impact_mad") + eps)
        ).drop("_qv", "_dev")

    out = over_chunks(bars, build, back=window + 2 * state_window, size=size)
    z, vr, rr = F.col("impact_z"), F.col("volume_ratio"), F.col("vol_ratio")
    return out.withColumn(
        "liquidity_state",
        F.when(z.isNull() | vr.isNull() | rr.isNull(), "UNKNOWN")
        .when((z > 2) & (vr < 0.8), "LOW_LIQUIDITY_SHOCK")
        .when((z > 2) & (vr >= 1.5), "EVENT_REPRICING")
        .when((z < -1) & (vr >= 1.5), "ABSORPTION")
        .when((vr < 0.5) & (rr < 0.8), "QUIET_THIN_MARKET")
        .otherwise("NORMAL_LIQUIDITY"),
    )


def liquidity_summary(proxy: DataFrame) -> DataFrame:
    state = F.col("liquidity_state")
    agg = proxy.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(state != "UNKNOWN").alias("valid_rows"),
        *[
            F.count_if(state == s).alias(f"{s.lower()}_count")
            for s in ("LOW_LIQUIDITY_SHOCK", "EVENT_REPRICING", "ABSORPTION", "QUIET_THIN_MARKET", "NORMAL_LIQUIDITY")
        ],
        F.avg("impact_score").alias("mean_impact_score"),
    )
    med = exact_quantiles(proxy, KEYS, "impact_score", [0.5], ["median_impact_score"])
    return agg.join(med, [*KEYS], "left")


def rolling_correlation(pairs: DataFrame, window: int, keys: Sequence[str], index: str, size: int = CHUNK) -> DataFrame:
    """Rolling Pearson correlation of columns ``x`` and ``y`` from two joint values on."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        f = rows(w, 1 - window, 0)
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        return d.withColumn(
            "rolling_corr",
            F.when(F.count(F.when(both, 1)).over(f) >= 2, finite(F.corr("x", "y").over(f))),
        )

    return over_chunks(pairs, build, back=window, keys=keys, index=index, size=size)


# Higher timeframes looked at for each base interval.
HIGHER = {
    "1m": ("5m", "15m"),
    "3m": ("15m", "1h"),
    "5m": ("15m", "1h"),
    "15m": ("1h", "4h"),
    "30m": ("1h", "4h"),
    "1h": ("4h", "1d"),
    "4h": ("1d",),
    "1d": (),
}


def resample(bars: DataFrame, target: str) -> DataFrame:
    """Bars of a longer interval, aligned to the epoch; map-side combining keeps a hot symbol spread."""
    step = INTERVAL_MS[target]
    start = F.col("open_time_ms") - F.pmod(F.col("open_time_ms"), F.lit(step))
    out = bars.withColumn("_start", start).groupBy("symbol", "_start").agg(
        F.min_by("open", "open_time_ms").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time_ms").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("source_bars"),
    )
    return out.select(
        "symbol",
        F.lit(target).alias("interval"),
        F.col("_start").alias("open_time_ms"),
        (F.col("_start") + step - 1).alias("close_time_ms"),
        "open", "high", "low", "close", "volume", "source_bars",
    )


def with_close_time(bars: DataFrame, size: int = CHUNK) -> DataFrame:
    """Close time from the interval, else the median spacing of the series."""
    gaps = over_chunks(
        bars, lambda d, w: d.withColumn("_gap", F.col("open_time_ms") - F.lag("open_time_ms").over(w)), back=1, size=size
    )
    spacing = exact_quantiles(gaps, KEYS, "_gap", [0.5], ["_spacing"])
    step = F.coalesce(interval_ms(), F.col("_spacing").cast("long"))
    return gaps.join(spacing, [*KEYS], "left").withColumn("close_time_ms", F.col("open_time_ms") + step).drop("_gap", "_spacing")


def htf_state(htf: DataFrame, size: int = CHUNK) -> DataFrame:
    """State of every completed higher-timeframe bar: move, volatility, trend, distance to range ends.

    The volatility baseline is the median of the whole visible history, found chunk by chunk.
    """

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = with_returns(d, w)
        f20, f19 = rows(w, -19, 0), rows(w, -18, 0)
        sq = F.col("squared_return")
        return d.withColumns(
            {
                "pre_simple_ret_20": change(F.lag("close", 19).over(w), "close"),
                "realized_vol_20": F.when(F.count(sq).over(f19) >= 1, F.sqrt(F.sum(sq).over(f19))),
                "_vol": F.when(F.count(sq).over(f20) == 20, F.sqrt(F.sum(sq).over(f20))),
                "distance_to_high": change(F.max("high").over(f20), "close"),
                "distance_to_low": change(F.min("low").over(f20), "close"),
            }
        )

    cut = over_chunks(htf, build, back=21, size=size)
    base = expanding_median(cut, "_vol", "_base")
    enough = F.col("bar_index") >= 19
    move, vol, usual = F.col("pre_simple_ret_20"), F.col("realized_vol_20"), F.col("_base")
    limit = F.greatest(F.lit(0.002), F.coalesce(vol, F.lit(0.0)))
    out = cut.join(base, [*KEYS, "bar_index"])
    return out.select(
        *KEYS, "bar_index", "open_time_ms", "close_time_ms", "close",
        (F.col("bar_index") + 1).alias("available_bars"),
        F.when(enough, "available").otherwise("insufficient_history").alias("history_status"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("pre_simple_ret_20", "realized_vol_20", "distance_to_high", "distance_to_low")],
        F.when(enough, F.when(move > limit, "uptrend").when(move < -limit, "downtrend").otherwise("range")).alias("trend_regime"),
        F.when(
            enough,
            F.when((usual > 0) & (vol > usual * 1.5), "high_vol")
            .when((usual > 0) & (vol < usual * 0.75), "low_vol")
            .otherwise("normal_vol"),
        ).alias("volatility_regime"),
    )


def drawdown(returns: DataFrame, size: int = CHUNK) -> DataFrame:
    """Wealth, running peak and drawdown from log returns."""
    r = F.col("log_return")
    wealth = running(returns.where(r.isNotNull()), {"_sum": ("sum", r)}, size=size).withColumn("wealth", F.exp("_sum"))
    return running(wealth, {"peak": ("max", F.col("wealth"))}, size=size).withColumn(
        "drawdown", F.col("wealth") / F.col("peak") - 1.0
    ).drop("_sum")


def max_drawdown(values: DataFrame, value: str, keys: Sequence[str] = KEYS, index: str = "bar_index", size: int = CHUNK) -> DataFrame:
    """Deepest relative fall of ``value`` below its running peak, with peak and trough positions."""
    peak = F.struct(F.col(value).alias("v"), (-F.col(index)).alias("i"))
    run = running(values.where(F.col(value).isNotNull()), {"_peak": ("max", peak)}, keys=keys, index=index, size=size)
    dd = F.when(F.col("_peak.v") > 0, 1.0 - F.col(value) / F.col("_peak.v")).otherwise(0.0)
    worst = F.struct(dd.alias("dd"), (-F.col(index)).alias("e"), F.col("_peak.i").alias("s"))
    return run.groupBy(*keys).agg(F.max(worst).alias("_w")).select(
        *keys,
        (F.col("_w.dd") * -100.0).alias("max_drawdown_pct"),
        F.when(F.col("_w.dd") > 0, -F.col("_w.s")).alias("drawdown_start"),
        F.when(F.col("_w.dd") > 0, -F.col("_w.e")).alias("drawdown_end"),
    )


def trailing_runs(bars: DataFrame, conditions: dict[str, Column], size: int = CHUNK) -> DataFrame:
    """Length of the unbroken run of a condition that ends at each bar."""
    specs = {f"_brk_{n}": ("last", F.when(~F.coalesce(cond, F.lit(False)), F.col("bar_index"))) for n, cond in conditions.items()}
    out = running(bars, specs, size=size)
    return out.withColumns(
        {n: F.col("bar_index") - F.coalesce(F.col(f"_brk_{n}"), F.lit(-1)) for n in conditions}
    ).drop(*specs)


def longest_streaks(df: DataFrame, value: str, keys: Sequence[str], index: str, size: int = CHUNK) -> DataFrame:
    """Longest winning and losing streak; a zero ends both."""
    v = F.col(value)
    specs = {
        "_w": ("last", F.when(~F.coalesce(v > 0, F.lit(False)), F.col(index))),
        "_l": ("last", F.when(~F.coalesce(v < 0, F.lit(False)), F.col(index))),
    }
    run = running(df, specs, keys=keys, index=index, size=size)
    return run.groupBy(*keys).agg(
        F.max(F.col(index) - F.coalesce("_w", F.lit(-1))).alias("max_consecutive_wins"),
        F.max(F.col(index) - F.coalesce("_l", F.lit(-1))).alias("max_consecutive_losses"),
    )


def episodes(obs: DataFrame, max_gap: int = 3, size: int = CHUNK) -> DataFrame:
    """A new episode starts where the bar gap to the previous observation of the series exceeds ``max_gap``."""
    from .chunks import dense_index

    pos = dense_index(obs, KEYS, "bar_index", size, name="_pos", ties=("observation_id",))
    cut = over_chunks(
        pos,
        lambda d, w: d.withColumn("_new", F.when(F.col("bar_index") - F.lag("bar_index").over(w) > max_gap, 1).otherwise(0)),
        back=1,
        index="_pos",
        size=size,
        keep=True,
    )
    out = running(cut, {"_ep": ("sum", F.col("_new"))}, index="_pos", size=size)
    return out.withColumn(
        "episode_id", F.concat(
            F.concat_ws("|", "symbol", "interval"), F.lit("|ep_"), zero_padded(F.col("_ep") + 1, 6)
        )
    ).drop("_new", "_ep", "_pos")


def true_range(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_and_slope(bars: DataFrame, atr: int = 14, slope: int = 20, rank: int = 100, size: int = CHUNK) -> DataFrame:
    """True range, ATR, slope of log close and the share of recent volumes not above the current one."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("true_range", true_range(w))
        fs, fr = rows(w, 1 - slope, 0), rows(w, 1 - rank, 0)
        recent = F.collect_list("volume").over(fr)
        return d.withColumns(
            {
                "atr": F.avg("true_range").over(rows(w, 1 - atr, 0)),
                "slope_log_close": F.regr_slope(ln_pos("close"), F.col("bar_index")).over(fs),
                "volume_rank": F.size(F.filter(recent, lambda x: x <= F.col("volume"))) / F.size(recent),
            }
        )

    return over_chunks(bars, build, back=max(atr, slope, rank) + 1, size=size)
