"""Decision-time features of every bar, computed once and joined to events.

All features of a family share one window partitioning, so each family is a single
shuffle and sort. Frames never reach past the current bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions.scalar import change, clamp, digest_id, finite, flag, ln_pos, ramp, ratio, utc8_date, utc8_hour
from ..session import written
from .chunks import CHUNK, KEYS, over_chunks, rows
from .rolling import Spec, rolled
from .series import trailing_runs, true_range

EPS = 1e-12


def _span() -> Column:
    return F.col("high") - F.col("low")


def _body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def _upper() -> Column:
    return F.col("high") - F.greatest("open", "close")


def _lower() -> Column:
    return F.least("open", "close") - F.col("low")


def _run(cond: Column, frame: WindowSpec) -> Column:
    """Rows since the last break of ``cond`` inside a frame that ends at the previous bar."""
    brk = F.max(F.when(~F.coalesce(cond, F.lit(False)), F.col("bar_index"))).over(frame)
    first = F.min("bar_index").over(frame)
    return F.coalesce(F.col("bar_index") - 1 - F.coalesce(brk, first - 1), F.lit(0)).cast("double")


def _fold_drawdown(values: Column) -> Column:
    """Deepest relative fall below the running maximum of an ordered array."""
    start = F.struct(F.element_at(values, 1).alias("top"), F.lit(0.0).alias("dd"))

    def step(acc: Column, x: Column) -> Column:
        top = F.greatest(acc["top"], x)
        return F.struct(top.alias("top"), F.least(acc["dd"], x / top - 1.0).alias("dd"))

    return F.aggregate(values, start, step, lambda acc: acc["dd"])


def price_proxy() -> Column:
    return (F.col("high") + F.col("low")) / 2.0


def legacy_features(bars: DataFrame, size: int = CHUNK) -> DataFrame:
    """Stored event row: shape, five-bar volume ratio, prior returns and volatility, ten-bar extremes, runs."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"price_proxy": price_proxy(), "_r": change(F.lag("close").over(w), "close")})
        prior5, prior10 = rows(w, -5, -1), rows(w, -10, -1)
        mid = F.col("price_proxy")
        cols = {
            "event_body": _body(),
            "event_upper_wick": _upper(),
            "event_lower_wick": _lower(),
            "event_range": _span(),
            "event_volume": F.col("volume"),
            "event_vol_ratio_5": ratio("volume", F.avg("volume").over(prior5)),
            "prev_high10_dist_pct": change(mid, F.max("high").over(prior10)),
            "prev_low10_dist_pct": change(mid, F.min("low").over(prior10)),
            "event_upper_ratio": ratio(_upper(), _span()),
            "event_lower_ratio": ratio(_lower(), _span()),
            "event_body_ratio": ratio(_body(), _span()),
        }
        for n in (3, 5, 10):
            cols[f"pre_ret_{n}"] = change(F.lag("close", n).over(w), F.lag("close", 1).over(w))
            inner = rows(w, 1 - n, -1)
            cols[f"pre_vol_{n}"] = F.when(F.col("bar_index") >= n, F.stddev_pop("_r").over(inner))
        return d.withColumns(cols).drop("_r")

    out = over_chunks(bars, build, back=11, size=size, keep=True)
    up = F.col("close") >= F.col("open")
    return trailing_runs(out, {"bull_run_count": up, "bear_run_count": ~up}, size=size)


def enhanced_features(bars: DataFrame, size: int = CHUNK) -> DataFrame:
    """Fifty decision-time features over the twenty prior bars; short history is used as far as it goes."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        p20, inner = rows(w, -20, -1), rows(w, -19, -1)
        prev = F.lag("close").over(w)
        d = d.withColumns(
            {"_r": finite(change(prev, "close")), "_lr": ln_pos(ratio("close", prev)), "_tr": true_range(w), "_prev": prev}
        )
        down = F.col("close") < F.col("open")
        span, body = _span(), _body()
        top, floor_ = F.max("high").over(p20), F.min("low").over(p20)
        atr_frame = rows(w, -13, 0)
        # the first bar of the fourteen has no predecessor inside the window, so its range stands in
        atr = (
            F.sum("_tr").over(atr_frame) - F.first("_tr").over(atr_frame) + F.first(span).over(atr_frame)
        ) / F.count("_tr").over(atr_frame)
        cols: dict[str, Column] = {"_hi": top, "_lo": floor_, "atr_14": atr}
        for n in (3, 5, 10, 20):
            f = rows(w, -n, -1)
            enough = F.count("close").over(f) >= 2
            first, last = F.first("close").over(f), F.last("close").over(f)
            cols[f"pre_ret_{n}"] = F.when(enough, ratio(last - first, first, EPS))
            if n > 3:
                cols[f"pre_log_ret_{n}"] = F.when(enough & (first > 0) & (last > 0), F.ln(last / first))
        closes = F.collect_list("close").over(p20)
        cols |= {
            "pre_max_drawdown_20": F.when(F.count("close").over(p20) >= 2, F.abs(_fold_drawdown(closes))),
            "pre_volatility_20": F.stddev_pop("_r").over(inner),
            "realized_vol_20": F.stddev_pop("_lr").over(inner),
            "pre_down_bar_count_20": F.coalesce(F.sum(flag(down)).over(p20), F.lit(0.0)).cast("long"),
            "pre_bear_ratio_20": F.avg(flag(down)).over(p20),
            "pre_consecutive_bear_count": _run(down, p20).cast("long"),
            "pre_avg_body_20": F.avg(body).over(p20),
            "pre_avg_range_20": F.avg(F.abs(span)).over(p20),
            "pre_avg_volume_20": F.avg("volume").over(p20),
            "volume_zscore_20": F.when(
                F.count("volume").over(p20) >= 2,
                ratio(F.col("volume") - F.avg("volume").over(p20), F.stddev_pop("volume").over(p20), EPS),
            ),
            "range_zscore_20": F.when(
                F.count(span).over(p20) >= 2,
                ratio(span - F.avg(F.abs(span)).over(p20), F.stddev_pop(F.abs(span)).over(p20), EPS),
            ),
            "trend_slope_20": F.when(
                F.count(ln_pos("close")).over(p20) >= 2, F.regr_slope(ln_pos("close"), F.col("bar_index")).over(p20)
            ),
        }
        return d.withColumns(cols)

    d = over_chunks(bars, build, back=21, size=size)
    span, body, close = _span(), _body(), F.col("close")
    hi, lo, atr = F.col("_hi"), F.col("_lo"), F.col("atr_14")
    d = d.withColumns(
        {
            "event_body_pct": ratio(body, "open", EPS),
            "event_range_pct": ratio(span, "open", EPS),
            "range_pct": ratio(span, "open", EPS),
            "event_body_ratio": ratio(body, span, EPS),
            "event_upper_wick_ratio": ratio(_upper(), span, EPS),
            "event_lower_wick_ratio": ratio(_lower(), span, EPS),
            "event_close_position": ratio(close - F.col("low"), span, EPS),
            "close_position": ratio(close - F.col("low"), span, EPS),
            "event_is_bullish": flag(close > F.col("open")),
            "event_is_bearish": flag(close < F.col("open")),
            "event_volume_ratio_20": ratio("volume", "pre_avg_volume_20", EPS),
            "event_range_vs_avg_range_20": ratio(span, "pre_avg_range_20", EPS),
            "event_body_vs_avg_body_20": ratio(body, "pre_avg_body_20", EPS),
            "break_prev_low_20": flag(F.col("low") < lo),
            "recover_prev_low_20": flag((F.col("low") < lo) & (close > lo)),
            "fake_breakout_down": flag((F.col("low") < lo) & (close > lo)),
            "break_prev_high_20": flag(F.col("high") > hi),
            "fake_breakout_up": flag((F.col("high") > hi) & (close < hi)),
            "distance_to_prev_low_pct": ratio(close - lo, lo, EPS),
            "distance_to_prev_low_20": ratio(close - lo, lo, EPS),
            "distance_to_prev_high_20": ratio(close - hi, hi, EPS),
            "pre_ret_20_zscore": ratio("pre_ret_20", "pre_volatility_20", EPS),
            "log_ret_1": F.when((close > 0) & (F.col("_prev") > 0), F.ln(close / F.col("_prev"))),
            "range_atr_ratio": ratio(span, atr, EPS),
            "body_atr_ratio": ratio(body, atr, EPS),
            "upper_wick_atr_ratio": ratio(_upper(), atr, EPS),
            "lower_wick_atr_ratio": ratio(_lower(), atr, EPS),
            "volatility_regime": volatility_class("realized_vol_20"),
            "time_of_day_bucket": session_bucket("open_time_ms"),
        }
    )
    return d.withColumn("capitulation_score", capitulation_score()).drop("_hi", "_lo", "_r", "_lr", "_tr", "_prev")


def capitulation_score() -> Column:
    """Mean of five bounded ramps, times one hundred."""
    # The ramp of each component.
    parts = [
        ramp(-F.col("pre_ret_20"), 0.0, 0.10),
        ramp("pre_max_drawdown_20", 0.0, 0.12),
        ramp("event_volume_ratio_20", 1.0, 5.0),
        ramp("event_lower_wick_ratio", 0.0, 0.70),
        ramp("event_close_position", 0.30, 1.0),
    ]
    return sum(parts, F.lit(0.0)) / 5.0 * 100.0


def volatility_class(vol) -> Column:
    v = F.col(vol)
    return F.when(v.isNull(), None).when(v < 0.003, "LOW").when(v > 0.015, "HIGH").otherwise("NORMAL")


def session_bucket(ms) -> Column:
    h = utc8_hour(ms)
    return F.when(h < 8, "BJT_00_08").when(h < 16, "BJT_08_16").otherwise("BJT_16_24")


def _mean_score(*parts: Column) -> Column:
    known = F.array_compact(F.array(*parts))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, total / F.size(known) * 100.0)


def _unit(x: Column, scale: float = 1.0) -> Column:
    return F.when(x.isNotNull(), clamp(x / scale, 0.0, 1.0))


def factor_table(bars: DataFrame, size: int = CHUNK, only: Column | None = None) -> DataFrame:
    """The registered factors, of the bars that ``only`` names; a prior-window return needs its full number of bars."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("close").over(w)
        span, at, v = _span(), F.col("bar_index"), F.col("volume")
        cols: dict[str, Column] = {
            "_lr": ln_pos(ratio("close", prev)), "true_range": true_range(w), "_prev": prev, "_qv": F.col("close") * v, "_lc": ln_pos("close")
        }
        for n in (3, 5, 10, 20):
            first = F.lag("close", n).over(w)
            cols[f"pre_ret_{n}"] = ratio(prev - first, first, EPS)
            if n in (5, 10):
                cols[f"pre_log_ret_{n}"] = F.when((first > 0) & (prev > 0), F.ln(prev / first))
        specs: dict[str, Spec] = {
            "_hi": ("max", F.col("high"), -20, -1),
            "_lo": ("min", F.col("low"), -20, -1),
            "atr_14": ("mean", F.col("true_range"), -13, 0),
            "_v5": ("mean", v, -5, -1),
            "_cn": ("count", F.col("_lc"), -20, -1),
            "_sl": ("slope", (F.col("_lc"), at), -20, -1),
            "_first": ("min", at, -20, -1),
        }
        scored = {"range_zscore_20": span, "volume_zscore_20": v, "quote_volume_zscore_20": F.col("_qv")}
        for name, x in scored.items():
            specs |= {f"_{kind}_{name}": (kind, x, -20, -1) for kind in ("count", "mean", "std")}
        for n in (20, 50):
            specs[f"_rv{n}"] = ("std", F.col("_lr"), 1 - n, -1)
        broken = {"up_run_length": F.col("close") > F.col("open"), "down_run_length": F.col("close") < F.col("open")}
        for name, cond in broken.items():
            specs[f"_brk_{name}"] = ("max", F.when(~F.coalesce(cond, F.lit(False)), at), -20, -1)
        d = rolled(d.withColumns(cols), specs, only=only)
        out: dict[str, Column] = {
            "volume_ratio_5": ratio(v, "_v5", EPS),
            "volume_ratio_20": ratio(v, "_mean_volume_zscore_20", EPS),
            "trend_slope_20": F.when(F.col("_cn") >= 2, F.col("_sl")),
        }
        for name, x in scored.items():
            out[name] = F.when(F.col(f"_count_{name}") >= 2, ratio(x - F.col(f"_mean_{name}"), F.col(f"_std_{name}"), EPS))
        for n in (20, 50):
            out[f"realized_vol_{n}"] = F.when(at >= n, F.col(f"_rv{n}"))
        for name in broken:
            out[name] = F.coalesce(at - 1 - F.coalesce(f"_brk_{name}", F.col("_first") - 1), F.lit(0)).cast("double")
        return d.withColumns(out).drop("_lc", *[n for n in specs if n not in ("_hi", "_lo", "atr_14")])

    d = over_chunks(bars, build, back=51, size=size)
    span, body, close, low, high = _span(), _body(), F.col("close"), F.col("low"), F.col("high")
    hi, lo, atr = F.col("_hi"), F.col("_lo"), F.col("atr_14")
    breaks_low, breaks_high = low < lo, high > hi
    reclaims, rejects = breaks_low & (close > lo), breaks_high & (close < hi)
    d = d.withColumns(
        {
            "body_pct": ratio(body, "open", EPS),
            "body_to_range": ratio(body, span, EPS),
            "upper_wick_ratio": ratio(_upper(), span, EPS),
            "lower_wick_ratio": ratio(_lower(), span, EPS),
            "upper_wick_atr_ratio": ratio(_upper(), atr, EPS),
            "lower_wick_atr_ratio": ratio(_lower(), atr, EPS),
            "close_position": ratio(close - low, span, EPS),
            "range_pct": ratio(span, "open", EPS),
            "range_atr_ratio": ratio(span, atr, EPS),
            "body_atr_ratio": ratio(body, atr, EPS),
            "log_ret_1": F.when((close > 0) & (F.col("_prev") > 0), F.ln(close / F.col("_prev"))),
            "distance_to_prev_high_20": ratio(close - hi, hi, EPS),
            "distance_to_prev_low_20": ratio(close - lo, lo, EPS),
            "break_prev_high_20": flag(breaks_high),
            "break_prev_low_20": flag(breaks_low),
            "reclaim_prev_low_20": flag(reclaims),
            "reject_prev_high_20": flag(rejects),
            "break_depth": F.when(breaks_low, ratio(lo - low, lo, EPS)).otherwise(0.0),
            "reclaim_strength": F.when(reclaims, ratio(close - lo, lo, EPS)).otherwise(0.0),
            "volatility_regime": volatility_class("realized_vol_20"),
            "quote_volume_proxy": F.col("_qv"),
            "hour_of_day": utc8_hour("open_time_ms").cast("double"),
            "day_of_week": F.weekday(utc8_date("open_time_ms")).cast("double"),
            "time_session": session_bucket("open_time_ms"),
            "trend_regime": F.when(F.col("trend_slope_20").isNull(), None)
            .when(F.col("trend_slope_20") < -0.001, "DOWN")
            .when(F.col("trend_slope_20") > 0.001, "UP")
            .otherwise("FLAT"),
        }
    )
    vr, ra, cp = F.col("volume_ratio_20"), F.col("range_atr_ratio"), F.col("close_position")
    drop = -F.col("pre_ret_10")
    d = d.withColumns(
        {
            "volume_climax_score": _mean_score(_unit(vr, 3), _unit(ra, 3)),
            "volume_absorption_score": _mean_score(_unit(vr, 3), F.col("reclaim_prev_low_20"), cp),
            "volume_dump_score": _mean_score(_unit(drop, 0.05), _unit(vr, 3)),
            "reversal_candle_score": _mean_score(F.col("lower_wick_ratio"), cp, F.col("body_to_range")),
            "panic_drop_score": _mean_score(_unit(drop, 0.05), _unit(ra, 3), _unit(vr, 3)),
            "false_breakdown_score": _mean_score(F.col("break_prev_low_20"), F.col("reclaim_prev_low_20"), cp),
            "fake_breakout_score": _mean_score(F.col("break_prev_high_20"), F.col("reject_prev_high_20"), 1.0 - cp),
        }
    )
    return d.drop("_hi", "_lo", "_lr", "_prev", "_qv")


def premium_stats(premium: DataFrame, size: int = CHUNK) -> DataFrame:
    """Level, two-step change and fifty-sample z-score of each premium sample; rows need ``pos``, ``t``, ``premium``."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        f = rows(w, -49, 0)
        p = F.col("premium")
        return d.withColumns(
            {
                "premium_avg_pct": p,
                "premium_change_3": p - F.lag(p, 2).over(w),
                "premium_zscore_50": F.when(
                    F.count(p).over(f) >= 2, ratio(p - F.avg(p).over(f), F.stddev_pop(p).over(f), EPS)
                ),
                "premium_spread": F.col("sell") - F.col("buy"),
            }
        )

    return over_chunks(premium, build, back=50, keys=["feed"], index="pos", size=size)


# Metric names of the context feature table.
CONTEXT_METRICS = (
    "pre_log_ret", "pre_simple_ret", "realized_vol", "downside_vol", "range_mean", "range_zscore", "volume_zscore",
    "trend_slope", "distance_to_high", "distance_to_low",
)


def context_long(bars: DataFrame, samples: DataFrame, version: str = "context_v1", size: int = CHUNK) -> DataFrame:
    """Context features in long form for lookbacks of 20, 50 and 100 bars including the current one."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("close").over(w)
        d = d.withColumns(
            {
                "_lr": ln_pos(ratio("close", prev)), "_rl": ln_pos(ratio("high", "low")), "_lc": ln_pos("close"),
                **{f"_at{k}": F.lag("close", k - 1).over(w) for k in (20, 50, 100)},
            }
        )
        down = F.when(F.col("_lr") < 0, F.col("_lr"))
        specs: dict[str, Spec] = {}
        for k in (20, 50, 100):
            f, inner = (1 - k, 0), (2 - k, 0)
            specs |= {
                f"_{k}_realized_vol": ("std", F.col("_lr"), *inner), f"_{k}_down": ("std", down, *inner), f"_{k}_range_mean": ("mean", F.col("_rl"), *f),
                f"_{k}_rs": ("std", F.col("_rl"), *f), f"_{k}_vm": ("mean", F.col("volume"), *f), f"_{k}_vs": ("std", F.col("volume"), *f),
                f"_{k}_trend_slope": ("slope", (F.col("_lc"), F.col("bar_index")), *f), f"_{k}_high": ("max", F.col("high"), *f),
                f"_{k}_low": ("min", F.col("low"), *f), f"_{k}_max_drawdown": ("drawdown", F.col("close"), *f),
            }
        d = rolled(d, specs, only=F.coalesce("_wanted", F.lit(False)))
        cols: dict[str, Column] = {}
        for k in (20, 50, 100):
            first = F.col(f"_at{k}")

            def z(v: str, mean: str, std: str) -> Column:
                return F.when(F.col(std) == 0, 0.0).otherwise((F.col(v) - F.col(mean)) / F.col(std))

            values = {
                "pre_log_ret": F.when((first > 0) & (F.col("close") > 0), F.ln(F.col("close") / first)),
                "pre_simple_ret": F.when(first > 0, F.col("close") / first - 1.0),
                "downside_vol": F.coalesce(f"_{k}_down", F.lit(0.0)),
                "range_zscore": z("_rl", f"_{k}_range_mean", f"_{k}_rs"),
                "volume_zscore": z("volume", f"_{k}_vm", f"_{k}_vs"),
                "distance_to_high": change(f"_{k}_high", "close"),
                "distance_to_low": change(f"_{k}_low", "close"),
            }
            cols |= {f"_{k}_{n}": v for n, v in values.items()}
        return d.withColumns(cols)

    # samples are marked first: only their bars leave the window stage and pay for the folds below
    marks = samples.select(*KEYS, "bar_index", F.lit(True).alias("_wanted")).distinct()
    marked = bars.select(*KEYS, "bar_index", "high", "low", "close", "volume").join(marks, [*KEYS, "bar_index"], "left")
    wide = over_chunks(marked, build, back=101, size=size)
    pairs = []
    for k in (20, 50, 100):
        full = F.col("bar_index") + 1 >= k
        named = {
            "available_bars": F.least(F.col("bar_index") + 1, F.lit(k)).cast("double"),
            "insufficient_history": flag(~full),
            **{n: F.when(full, F.col(f"_{k}_{n}")) for n in CONTEXT_METRICS},
            "max_drawdown": F.when(full, F.col(f"_{k}_max_drawdown")),
        }
        for n, v in named.items():
            always = n in ("available_bars", "insufficient_history")
            pairs.append(
                F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), v.alias("v"), (F.lit(True) if always else full).alias("on"))
            )
    long = samples.join(
        wide.select(*KEYS, "bar_index", F.explode(F.array(*pairs)).alias("_p")).where("_p.on"), [*KEYS, "bar_index"]
    )
    return long.select(
        digest_id("ctx_", "sample_id", F.lit(version), F.col("_p.k"), F.col("_p.n")).alias("context_feature_id"),
        "sample_id",
        F.lit(version).alias("feature_version"),
        *KEYS,
        "bar_index",
        F.col("_p.k").alias("lookback_bars"),
        F.col("_p.n").alias("feature_name"),
        finite("_p.v").alias("feature_value"),
    )


ENTRY_FEATURES = (
    "prior_ret_5", "prior_ret_10", "prior_ret_20", "trend_slope_20", "distance_to_recent_high_20",
    "distance_to_recent_low_20", "drop_from_recent_high_20", "consecutive_bearish_bars", "largest_red_bar_pct_20",
    "down_move_duration", "body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "close_position_in_range",
    "range_pct", "reclaim_ratio", "volume_ratio_to_ma20", "volume_zscore_20", "volume_rank_100", "realized_vol_20",
    "atr_ratio_20", "range_zscore_20",
)


def entry_features(bars: DataFrame, size: int = CHUNK, only: Column | None = None) -> DataFrame:
    """The twenty-two entry features of every bar, or those that ``only`` names, ready to be joined on a cutoff bar."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("close").over(w)
        span, body, close, at = _span(), _body(), F.col("close"), F.col("bar_index")

        def prior(k: int) -> Column:
            base = F.lag("close", k).over(w)
            return F.when(base > 0, close / base - 1.0)

        shaped = F.col("high") > F.col("low")
        d = d.withColumns(
            {
                "_lr": ln_pos(ratio("close", prev)), "_tr": true_range(w), "_lc": ln_pos("close"), "range_pct": F.when(shaped & (prev > 0), span / prev),
                **{f"prior_ret_{k}": prior(k) for k in (5, 10, 20)},
            }
        )
        red = F.when(close < F.col("open"), ratio(F.col("open") - close, "open"))
        specs: dict[str, Spec] = {
            "_top": ("max", F.col("high"), -19, 0), "_bottom": ("min", F.col("low"), -19, 0),
            "_break": ("max", F.when(~(close < F.col("open")), at), -19, 0), "_first": ("min", at, -19, 0), "_red": ("max", red, -19, 0),
            "_peak": ("first_top", (F.col("high"), at), -19, 0), "_atr": ("mean", F.col("_tr"), -19, 0),
            "_vm": ("mean", F.col("volume"), -20, -1), "_vs": ("std", F.col("volume"), -20, -1), "_rm": ("mean", span, -20, -1), "_rs": ("std", span, -20, -1),
            "_cn": ("count", F.col("_lc"), -19, 0), "_sl": ("slope", (F.col("_lc"), at), -19, 0),
            "volume_rank_100": ("rank_share", F.col("volume"), -99, 0), "realized_vol_20": ("std", F.col("_lr"), -19, 0),
        }
        d = rolled(d, specs, only=only)
        top, bottom, vm, vs, rm, rs, atr = (F.col(n) for n in ("_top", "_bottom", "_vm", "_vs", "_rm", "_rs", "_atr"))
        return d.withColumns(
            {
                "trend_slope_20": F.when(F.col("_cn") >= 2, F.col("_sl")),
                "distance_to_recent_high_20": F.when(top > 0, close / top - 1.0),
                "distance_to_recent_low_20": F.when(bottom > 0, close / bottom - 1.0),
                "drop_from_recent_high_20": F.when(top > 0, close / top - 1.0),
                "consecutive_bearish_bars": (at - F.coalesce("_break", F.col("_first") - 1)).cast("double"),
                "largest_red_bar_pct_20": F.coalesce("_red", F.lit(0.0)),
                "down_move_duration": (at - F.col("_peak")).cast("double"),
                "body_ratio": F.when(shaped, body / span),
                "upper_shadow_ratio": F.when(shaped, F.greatest(_upper(), F.lit(0.0)) / span),
                "lower_shadow_ratio": F.when(shaped, F.greatest(_lower(), F.lit(0.0)) / span),
                "close_position_in_range": F.when(shaped, (close - F.col("low")) / span),
                "reclaim_ratio": F.when(shaped, (close - bottom) / span),
                "volume_ratio_to_ma20": F.when(vm > 0, F.col("volume") / vm),
                "volume_zscore_20": F.when(vs > 0, (F.col("volume") - vm) / vs).when(vm.isNotNull(), 0.0),
                "atr_ratio_20": F.when(atr > 0, span / atr),
                "range_zscore_20": F.when(rs > 0, (span - rm) / rs).when(rm.isNotNull(), 0.0),
                "insufficient_history": at < 20,
            }
        ).drop("_lr", "_tr", "_lc", *[n for n in specs if n.startswith("_")])

    return over_chunks(bars, build, back=101, size=size)


def resolve_cutoff(obs: DataFrame, allow_confirmation: bool = True) -> DataFrame:
    """Last bar visible to an observation's features, the policy used, and a violation text."""
    timing = F.upper(F.coalesce("decision_timing", F.lit("CURRENT_BAR_CLOSE")))
    decision = F.coalesce("decision_bar_index", "bar_index")
    current = timing == "CURRENT_BAR_CLOSE"
    setup = F.coalesce("setup_bar_index", F.when(current, decision).otherwise(F.col("bar_index")))
    known = timing.isin("CURRENT_BAR_CLOSE", "NEXT_BAR_CONFIRMATION")
    policy = F.when(current, "current_bar_close").otherwise(
        "confirmation_bar_included" if allow_confirmation else "setup_bar_only"
    )
    cutoff = F.when(current | F.lit(allow_confirmation), decision).otherwise(setup)
    return obs.withColumns(
        {
            "setup_bar_index": setup,
            "decision_bar_index": decision,
            "feature_cutoff_bar_index": cutoff,
            "feature_timing_policy": policy,
            "uses_next_bar_confirmation": flag(~current),
            "cutoff_violation": F.when(~known, "unsupported_timing")
            .when(current & (setup != decision), "setup_differs_from_decision")
            .when(current & (F.col("bar_index") != decision), "bar_differs_from_decision")
            .when(cutoff > decision, "after_decision")
            .when(cutoff < setup, "before_setup"),
        }
    )


def entry_feature_rows(bars: DataFrame, obs: DataFrame, allow_confirmation: bool = True, size: int = CHUNK) -> DataFrame:
    """Observations with the features of their cutoff bar."""
    # written once, as it is read twice: cutoff bars are marked, and only they leave the sliding stage
    cut = written(resolve_cutoff(obs, allow_confirmation).where(F.col("cutoff_violation").isNull()).drop("cutoff_violation"), "cutoffs")
    marks = cut.select(*KEYS, F.col("feature_cutoff_bar_index").alias("bar_index"), F.lit(True).alias("_wanted")).distinct()
    marked = bars.select(*KEYS, "bar_index", "open", "high", "low", "close", "volume").join(marks, [*KEYS, "bar_index"], "left")
    feats = entry_features(marked, size, F.coalesce("_wanted", F.lit(False))).select(
        *KEYS, F.col("bar_index").alias("feature_cutoff_bar_index"), *ENTRY_FEATURES, "insufficient_history"
    )
    return cut.join(feats, [*KEYS, "feature_cutoff_bar_index"], "left")


def event_windows(bars: DataFrame, events: DataFrame, pre: int = 20, post: int = 20) -> DataFrame:
    """Long windows around events; offsets outside the series stay as padding rows."""
    slots = events.select("event_id", *KEYS, F.col("bar_index").alias("_at")).withColumn(
        "offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))
    ).withColumn("_i", F.col("_at") + F.col("offset"))
    b = bars.select(*KEYS, F.col("bar_index").alias("_i"), "open_time_ms", "open", "high", "low", "close", "volume")
    return slots.join(b, [*KEYS, "_i"], "left").select(
        "event_id", *KEYS, "offset",
        F.when(F.col("offset") == 0, 1).otherwise(0).alias("is_event_bar"),
        F.when(F.col("close").isNotNull(), F.col("_i")).alias("bar_index"),
        "open_time_ms", "open", "high", "low", "close", "volume",
        F.when(F.col("close").isNull(), 1).otherwise(0).alias("is_missing_padding"),
    )


def slot_name(offset) -> Column:
    o = F.col(offset)
    return F.when(o < 0, F.concat(F.lit("pre_"), (-o).cast("string"))).when(o == 0, "event_0").otherwise(
        F.concat(F.lit("post_"), o.cast("string"))
    )


def wide_windows(windows: DataFrame, value: str, offsets: list[int]) -> DataFrame:
    """One row per event, one column per slot; the slot list is given, so no extra pass finds it."""
    names = [f"pre_{-o}" if o < 0 else "event_0" if o == 0 else f"post_{o}" for o in offsets]
    return (
        windows.where(F.col("offset").isin(*offsets))
        .withColumn("slot", slot_name("offset"))
        .groupBy("event_id")
        .pivot("slot", names)
        .agg(F.max(value))
    )


def bars_from_windows(windows: DataFrame) -> DataFrame:
    """Bars rebuilt from overlapping windows; the smallest event id supplies each bar."""
    fields = ["open_time_ms", "open", "high", "low", "close", "volume"]
    real = windows.where(F.col("is_missing_padding") == 0)
    return real.groupBy(*KEYS, "bar_index").agg(F.min_by(F.struct(*fields), "event_id").alias("_b")).select(
        *KEYS, "bar_index", *[F.col(f"_b.{f}").alias(f) for f in fields]
    )
