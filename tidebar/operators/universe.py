"""Candidate and observation scans over whole bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions.scalar import digest_id, utc8_text
from .chunks import CHUNK, KEYS, over_chunks, rows
from .cleaning import with_candle_id
from .rolling import Spec, rolled

# Vocabularies of the observation tables.
ACTIONS = ("OPEN_LONG", "OPEN_SHORT", "CLOSE_LONG", "CLOSE_SHORT", "HOLD", "NO_ACTION")
TRADE_ACTIONS = ("OPEN_LONG", "OPEN_SHORT", "CLOSE_LONG", "CLOSE_SHORT")
SOURCE_TYPES = ("USER_TRADE", "USER_EVENT", "AUTO_CANDIDATE", "SCHEDULED_BAR", "MATCHED_CONTROL")
SAMPLE_ROLES = ("USER_ACTION", "NO_ACTION", "CANDIDATE", "CONTROL", "TRAIN", "TEST")
CANDIDATE_SOURCES = ("rule_seeded", "manual_context", "model_ranked")


def _yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _z_or_zero(v: Column, f: WindowSpec) -> Column:
    s = F.stddev_pop(v).over(f)
    return F.when(s > 0, (v - F.avg(v).over(f)) / s).otherwise(0.0)


def _ratio_or_zero(v: Column, f: WindowSpec) -> Column:
    m = F.avg(v).over(f)
    return F.when(m > 0, v / m).otherwise(0.0)


def deep_v_flags(
    bars: DataFrame,
    pre_ret: float = 0.0,
    volume_z: float = 1.0,
    volume_ratio: float = 1.5,
    lower_wick: float = 0.45,
    reclaim: int = 20,
    size: int = CHUNK,
) -> DataFrame:
    """``is_candidate`` for every bar with enough history; only visible bars enter."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        p20, back = rows(w, -20, -1), rows(w, -reclaim, -1)
        first, prev = F.lag("close", 10).over(w), F.lag("close").over(w)
        v, span = F.col("volume"), F.col("high") - F.col("low")
        low = F.min("low").over(back)
        wick = F.greatest(F.least("open", "close") - F.col("low"), F.lit(0.0))
        reclaimed = (F.col("low") < low) & (F.col("close") > low)
        fell = F.when(first != 0, prev / first - 1.0) < pre_ret
        busy = (_z_or_zero(v, p20) >= volume_z) | (_ratio_or_zero(v, p20) >= volume_ratio)
        shaped = (span > 0) & ((wick / F.when(span > 0, span) >= lower_wick) | reclaimed)
        return d.withColumn("is_candidate", F.when(_yes(fell & busy & shaped), 1).otherwise(0))

    need = max(20, reclaim, 10)
    return over_chunks(bars, build, back=need, size=size).where(F.col("bar_index") >= need)


def deep_v_universe(
    bars: DataFrame, actions: DataFrame, profile: str = "LONG_DEEP_V_REVERSAL", size: int = CHUNK, **limits
) -> DataFrame:
    """One observation per bar; ``actions`` maps (symbol, interval, bar_index) to a user action and session."""
    flags = deep_v_flags(bars, size=size, **limits)
    joined = flags.join(actions, [*KEYS, "bar_index"], "left")
    action = F.coalesce(F.upper("user_action"), F.lit("NO_ACTION"))
    traded = action.isin(*TRADE_ACTIONS)
    kind = F.when(traded, "USER_TRADE").when(F.col("is_candidate") == 1, "AUTO_CANDIDATE").otherwise("SCHEDULED_BAR")
    return observation_rows(
        joined.withColumns({"user_action": action, "source_type": kind, "session_id": F.coalesce("session_id", F.lit("scan"))}),
        profile,
    )


def observation_rows(df: DataFrame, profile: str | None = None) -> DataFrame:
    """Observation layout: side from the action, flags from the source, and the stable sample id.

    Works for trades, no-action bars, candidates and matched controls alike; input
    needs session_id, source_type, user_action and the bar keys.
    """
    traded = F.col("user_action").isin(*TRADE_ACTIONS)
    zero = F.lit(0)
    return df.select(
        digest_id(
            "obs_", "session_id", F.upper("symbol"), "interval", "bar_index", "source_type", length=20
        ).alias("sample_id"),
        "session_id",
        F.lit(profile).cast("string").alias("profile_id"),
        "source_type",
        *KEYS,
        "bar_index",
        utc8_text("open_time_ms").alias("event_time_bjt"),
        "user_action",
        F.when(traded, F.element_at(F.split("user_action", "_"), 2)).alias("side"),
        F.when(F.col("source_type") == "USER_TRADE", 1).otherwise(0).alias("is_user_trade"),
        (F.coalesce("is_candidate", zero) if "is_candidate" in df.columns else F.when(F.col("source_type") == "AUTO_CANDIDATE", 1).otherwise(0)).alias("is_candidate"),
        F.when(F.col("source_type") == "MATCHED_CONTROL", 1).otherwise(0).alias("is_matched_control"),
    )


def split_by_vocabulary(df: DataFrame, allowed: dict[str, tuple]) -> tuple[DataFrame, DataFrame]:
    """Rows whose coded columns hold known values, and the rest with the reason."""
    reasons = F.array_compact(
        F.array(*[F.when(~_yes(F.col(c).isin(*values)), F.lit(f"bad_{c}")) for c, values in allowed.items()])
    )
    tagged = df.withColumn("errors", F.array_join(reasons, ","))
    return tagged.where(F.col("errors") == "").drop("errors"), tagged.where(F.col("errors") != "")


def entry_universe(
    bars: DataFrame,
    drop_lookback: int = 5,
    volume_lookback: int = 20,
    min_drop: float = 0.015,
    min_range: float = 0.02,
    volume_ratio: float = 1.5,
    volume_z: float = 1.0,
    lower_shadow: float = 0.35,
    confirm_body: float = 0.55,
    source: str = "rule_seeded",
    data_version: str = "",
    size: int = CHUNK,
) -> DataFrame:
    """Review candidates: a core setup with a long lower shadow, or a bullish bar after a core setup."""

    v = F.col("volume")

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev, start = F.lag("close").over(w), F.lag("close", drop_lookback).over(w)
        span = F.col("high") - F.col("low")
        usable = (F.col("bar_index") > max(1, drop_lookback)) & (F.col("bar_index") >= 2) & (span > 0) & (prev > 0) & (start > 0)
        fell = prev / F.when(start > 0, start) - 1.0 <= -abs(min_drop)
        wide = span / F.when(prev > 0, prev) >= min_range
        shadow = F.greatest(F.least("open", "close") - F.col("low"), F.lit(0.0)) / F.when(span > 0, span) >= lower_shadow
        bull = (span > 0) & (F.col("close") > F.col("open")) & (
            (F.col("close") - F.col("open")) / F.when(span > 0, span) >= confirm_body
        )
        d = d.withColumns({"_fit": _yes(usable & fell & wide), "_shadow": _yes(shadow), "_bull": _yes(bull)})
        d = d.withColumns(
            {"_prev_fit": _yes(F.lag("_fit").over(w)), "_prev_volume": F.lag("volume").over(w), "_prev_time": F.lag("open_time_ms").over(w)}
        )
        odd = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 1)
        specs: dict[str, Spec] = {}
        for at, shift in (("", 0), ("_prev", 1)):
            frame = (-volume_lookback - shift, -1 - shift)
            specs |= {f"_m{at}": ("mean", v, *frame), f"_s{at}": ("std", v, *frame), f"_odd{at}": ("max", odd, *frame)}
        d = d.select(*KEYS, "_chunk", "bar_index", "open_time_ms", "volume", "_prev_volume", "_prev_time", "_fit", "_shadow", "_bull", "_prev_fit")
        # volume decides only on bars that have the rest; no others leave the task
        return rolled(d, specs, only=(F.col("_fit") & F.col("_shadow")) | (F.col("_bull") & F.col("_prev_fit")))

    def busy(volume: str, at: str) -> Column:
        x, m = F.col(volume), F.col(f"_m{at}")
        # frames skip what isn't a number, a window's deviation becomes one
        s = F.when(F.col(f"_odd{at}") == 1, float("nan")).otherwise(F.col(f"_s{at}"))
        share, z = F.when(m > 0, x / m).otherwise(0.0), F.when(s > 0, (x - m) / s).otherwise(0.0)
        return (share >= volume_ratio) | (z >= volume_z)

    d = over_chunks(bars, build, back=max(drop_lookback, volume_lookback) + 2, size=size).withColumns(
        {"_core": F.col("_fit") & _yes(busy("volume", "")), "_prev_core": F.col("_prev_fit") & _yes(busy("_prev_volume", "_prev"))}
    )
    now, later = F.col("_core") & F.col("_shadow"), F.col("_bull") & F.col("_prev_core")
    d = d.where(now | later).withColumn("_now", now)
    timing = F.when(F.col("_now"), "CURRENT_BAR_CLOSE").otherwise("NEXT_BAR_CONFIRMATION")
    last = F.when(F.col("_now"), "lower_shadow").otherwise("bullish_confirmation")
    setup = F.when(F.col("_now"), F.col("bar_index")).otherwise(F.col("bar_index") - 1)
    return with_candle_id(d).select(
        digest_id(
            "entry_obs_", F.upper("symbol"), "interval", "bar_index", F.lit(source), F.lit(data_version), length=20
        ).alias("observation_id"),
        *KEYS,
        "bar_index",
        utc8_text("open_time_ms").alias("bar_time"),
        setup.alias("setup_bar_index"),
        F.col("bar_index").alias("decision_bar_index"),
        utc8_text(F.when(F.col("_now"), F.col("open_time_ms")).otherwise(F.col("_prev_time"))).alias("setup_bar_time"),
        utc8_text("open_time_ms").alias("decision_bar_time"),
        "candle_id",
        F.lit(source).alias("candidate_source"),
        F.lit(1).alias("eligible_for_review"),
        F.concat_ws("|", F.lit("review_filter|prior_drop|range_expansion|volume_expansion"), last).alias("candidate_reason"),
        timing.alias("decision_timing"),
        F.col("bar_index").alias("feature_cutoff_bar_index"),
    )


def deep_v_entries(
    bars: DataFrame,
    trend_lookback: int = 20,
    drop_lookback: int = 5,
    min_drop: float = 0.02,
    volume_lookback: int = 20,
    volume_multiple: float = 2.0,
    lower_shadow: float = 0.45,
    confirm_bars: int = 1,
    confirm_body: float = 0.6,
    uptrend_lookback: int | None = None,
    uptrend_return: float = 0.0,
    size: int = CHUNK,
) -> DataFrame:
    """Entry signal of every bar: pin bar at its own close, or a bullish bar soon after a setup bar."""
    need = max(trend_lookback, drop_lookback, volume_lookback, uptrend_lookback or 0)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        start, prev = F.lag("close", trend_lookback).over(w), F.lag("close").over(w)
        drop_start = F.lag("close", drop_lookback).over(w)
        span = F.col("high") - F.col("low")
        mean_volume = F.avg("volume").over(rows(w, -volume_lookback, -1))
        cond = (
            (F.col("bar_index") >= need)
            & (span > 0)
            & (start > 0)
            & (drop_start > 0)
            & (prev < start)
            & (F.col("close") / F.when(drop_start > 0, drop_start) - 1.0 <= -min_drop)
            & (mean_volume > 0)
            & (F.col("volume") / F.when(mean_volume > 0, mean_volume) >= volume_multiple)
        )
        if uptrend_lookback:
            base = F.lag("close", uptrend_lookback).over(w)
            cond = cond & (base > 0) & (F.col("close") / F.when(base > 0, base) - 1.0 >= uptrend_return)
        shadow = F.greatest(F.least("open", "close") - F.col("low"), F.lit(0.0)) / F.when(span > 0, span) >= lower_shadow
        bull = (span > 0) & (F.col("close") > F.col("open")) & (
            (F.col("close") - F.col("open")) / F.when(span > 0, span) >= confirm_body
        )
        d = d.withColumns({"_setup": F.when(_yes(cond), 1).otherwise(0), "_pin": _yes(cond & shadow), "_bull": _yes(bull)})
        recent = F.max("_setup").over(rows(w, -confirm_bars, -1))
        return d.withColumn(
            "entry_reason",
            F.when(F.col("_pin"), "pinbar_close")
            .when(F.col("_bull") & (recent == 1), "confirmation_bar")
            .otherwise("conditions_not_met"),
        )

    out = over_chunks(bars, build, back=need + confirm_bars + 1, size=size)
    return out.withColumn("should_open_long", F.when(F.col("entry_reason") != "conditions_not_met", 1).otherwise(0)).drop(
        "_setup", "_pin", "_bull"
    )


def ma_cross(bars: DataFrame, fast: int = 5, slow: int = 20, size: int = CHUNK) -> DataFrame:
    """Moving-average cross events; averages are equal within a relative 1e-12, so that the order of summing makes no cross."""
    slow = max(slow, fast + 1)
    a, b = F.col("ma_fast"), F.col("ma_slow")
    side = F.when(F.abs(a - b) <= 1e-12 * F.greatest(F.abs(a), F.abs(b)), 0.0).otherwise(F.signum(a - b))

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns(
            {"ma_fast": F.avg("close").over(rows(w, 1 - fast, 0)), "ma_slow": F.avg("close").over(rows(w, 1 - slow, 0))}
        )
        d = d.withColumn("_side", side)
        before, ready = F.lag("_side").over(w), F.col("bar_index") >= slow
        return d.withColumn(
            "cross",
            F.when(ready & (before <= 0) & (F.col("_side") > 0), "UP").when(ready & (before >= 0) & (F.col("_side") < 0), "DOWN"),
        ).drop("_side")

    return over_chunks(bars, build, back=slow + 1, size=size)


def attach_to_experiment(
    observations: DataFrame, experiment: str, role: str, feature_version: str, label_version: str, dataset_hash: str
) -> DataFrame:
    """Membership rows linking observations to an experiment in a role."""
    return observations.select(
        digest_id("strat_", F.lit(experiment), "sample_id", F.lit(role), length=20).alias("strategy_sample_id"),
        "sample_id",
        F.lit(experiment).alias("experiment_id"),
        F.lit(feature_version).alias("feature_version"),
        F.lit(label_version).alias("label_version"),
        F.lit(dataset_hash).alias("dataset_hash"),
        F.lit(role).alias("sample_role"),
    )
