"""Return distribution, dependence, tail risk and microstructure diagnostics per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.moments import excess_kurtosis, safe_corr, skew
from ..functions.scalar import chi_square_sf, flag, ratio, utc8_hour
from .chunks import CHUNK, KEYS, dense_index, over_chunks
from .quantiles import exact_quantiles
from .series import drawdown, ewma_variance


def positions(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    return dense_index(df, keys, order, width, name="pos")


def acf(df: DataFrame, value: str, keys: Sequence[str] = KEYS, index: str = "pos", lags: int = 20, size: int = CHUNK) -> DataFrame:
    """Autocorrelation by lag; undefined where either side is constant. ``index`` is dense over known values.

    All lags come from one windowed pass and one aggregate.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, index, F.col(value).alias("_v"))
    lagged = over_chunks(
        known, lambda d, w: d.withColumns({f"_l{k}": F.lag("_v", k).over(w) for k in range(1, lags + 1)}), back=lags, keys=keys, index=index, size=size
    )
    agg = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[safe_corr("_v", f"_l{k}").alias(f"_c{k}") for k in range(1, lags + 1)]
    )
    rows = F.array(
        F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")),
        *[F.struct(F.lit(k).alias("lag"), F.col(f"_c{k}").alias("acf")) for k in range(1, lags + 1)],
    )
    return agg.select(*keys, "_n", F.explode(rows).alias("_r")).where(F.col("_r.lag") < F.col("_n")).select(
        *keys, "_r.lag", "_r.acf", (F.col("_n") - F.col("_r.lag")).alias("sample_count"), F.col("_n").alias("n")
    )


def ljung_box(table: DataFrame, keys: Sequence[str], lags: int = 10, alpha: float = 0.05) -> DataFrame:
    """Portmanteau statistic and approximate p-value from an autocorrelation table."""
    used = table.where((F.col("lag") >= 1) & (F.col("lag") <= lags) & F.col("acf").isNotNull())
    n = F.max("n")
    q = used.groupBy(*keys).agg(
        n.alias("n"), (n * (n + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("statistic")
    )
    p = F.when(F.col("statistic") <= 0, 1.0).otherwise(chi_square_sf(F.col("statistic"), F.lit(lags)))
    return q.where(F.col("n") > lags).withColumn("p_value", p).withColumn("significant", F.when(F.col("p_value") < alpha, 1).otherwise(0))


def variants(df: DataFrame, value: str, keys: Sequence[str], index: str) -> DataFrame:
    """The series itself, its square and its size, stacked under ``variant``."""
    v = F.col(value)
    kinds = F.array(
        F.struct(F.lit("return").alias("variant"), v.alias("value")),
        F.struct(F.lit("squared").alias("variant"), (v * v).alias("value")),
        F.struct(F.lit("absolute").alias("variant"), F.abs(v).alias("value")),
    )
    return df.where(v.isNotNull()).select(*keys, index, F.explode(kinds).alias("_k")).select(*keys, index, "_k.variant", "_k.value")


def white_noise(df: DataFrame, value: str, keys: Sequence[str] = KEYS, index: str = "pos", lags: int = 10) -> DataFrame:
    """Ljung-Box on returns, squares and sizes in one pass, with the two verdicts."""
    on = [*keys, "variant"]
    tests = ljung_box(acf(variants(df, value, keys, index), "value", on, index, lags), on, lags)
    return tests.groupBy(*keys).agg(
        *[F.max(F.when(F.col("variant") == k, F.col(c))).alias(f"{k}_{c}") for k in ("return", "squared", "absolute") for c in ("statistic", "p_value")],
        F.max(F.when(F.col("variant") == "return", F.col("significant"))).alias("return_white_noise_rejected"),
        F.max(F.when(F.col("variant") != "return", F.col("significant"))).alias("volatility_clustering_warning"),
    )


def clustering(df: DataFrame, value: str, keys: Sequence[str] = KEYS, index: str = "pos", lags: int = 10) -> DataFrame:
    """Mean size of the squared-return autocorrelations and the dependence proxy."""
    sq = df.withColumn("_sq", F.col(value) * F.col(value))
    table = acf(sq, "_sq", keys, index, lags)
    score = table.where("lag > 0").groupBy(*keys).agg(F.avg(F.abs("acf")).alias("score"))
    test = ljung_box(table, keys, lags).select(*keys, "statistic", "p_value", F.col("significant").alias("arch_proxy_warning"))
    return score.join(test, list(keys), "left")


def pacf(table: DataFrame, keys: Sequence[str], lags: int = 20) -> DataFrame:
    """Partial autocorrelations by Durbin-Levinson; each group is one series' table of at most ``lags`` rows."""
    keys = list(keys)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy(dtype=float)
        m = len(r) - 1
        phi = np.zeros((m + 1, m + 1))
        out = [1.0]
        for k in range(1, m + 1):
            top = r[k] - np.dot(phi[k - 1, 1:k], r[k - 1 : 0 : -1])
            low = 1.0 - np.dot(phi[k - 1, 1:k], r[1:k])
            phi[k, k] = top / low if abs(low) > 1e-12 else np.nan
            phi[k, 1:k] = phi[k - 1, 1:k] - phi[k, k] * phi[k - 1, k - 1 : 0 : -1]
            out.append(phi[k, k])
        return pd.DataFrame([[*key, i, v] for i, v in enumerate(out)], columns=[*keys, "lag", "pacf"])

    schema = T.StructType([*[table.schema[k] for k in keys], T.StructField("lag", T.LongType()), T.StructField("pacf", T.DoubleType())])
    return table.where((F.col("lag") <= lags) & F.col("acf").isNotNull()).groupBy(*keys).applyInPandas(solve, schema)


def describe(df: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Moments, quantiles, tail means and the Jarque-Bera test."""
    keys = list(keys)
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), skew(v).alias("skewness"), excess_kurtosis(v).alias("excess_kurtosis"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        (F.avg(F.when(v.isNotNull(), flag(v > 0))) * 100.0).alias("positive_pct"), (F.avg(F.when(v.isNotNull(), flag(v < 0))) * 100.0).alias("negative_pct"),
    )
    names = ["q01", "q05", "q25", "median", "q75", "q95", "q99"]
    q = exact_quantiles(df, keys, value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], names)
    tails = df.where(v.isNotNull()).join(q.select(*keys, "q05", "q95"), keys).groupBy(*keys).agg(
        F.avg(F.when(v <= F.col("q05"), v)).alias("left_tail_mean_5pct"), F.avg(F.when(v >= F.col("q95"), v)).alias("right_tail_mean_5pct")
    )
    jb = F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4.0)
    return base.join(q, keys, "left").join(tails, keys, "left").withColumns(
        {
            "tail_asymmetry": F.when(F.col("right_tail_mean_5pct") > 0, F.abs("left_tail_mean_5pct") / F.col("right_tail_mean_5pct")),
            "jb_statistic": jb,
            "jb_p_value": F.exp(-jb / 2.0),
            "normality_rejected": F.when(F.coalesce(F.exp(-jb / 2.0) < 0.05, F.lit(False)), 1).otherwise(0),
            "heavy_tail_warning": F.when(F.coalesce(F.col("excess_kurtosis") > 1.0, F.lit(False)), 1).otherwise(0),
        }
    )


# Standard normal quantiles and densities at 95% and 99%.
NORMAL_Z = {0.95: 1.6448536269514722, 0.99: 2.3263478740408408}
NORMAL_DENSITY = {0.95: 0.10313564037537128, 0.99: 0.026652142203457736}


def risk_summary(returns: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """Historical, normal and exponentially weighted VaR and shortfall (losses positive) and the deepest drawdown."""
    keys = list(keys)
    r = returns.where(F.col("log_return").isNotNull()).withColumn("_loss", -F.col("log_return"))
    q = exact_quantiles(r, keys, "_loss", [0.95, 0.99], ["historical_var_95", "historical_var_99"])
    base = r.join(q, keys).groupBy(*keys).agg(
        F.max("historical_var_95").alias("historical_var_95"),
        F.avg(F.when(F.col("_loss") >= F.col("historical_var_95"), F.col("_loss"))).alias("historical_es_95"),
        F.max("historical_var_99").alias("historical_var_99"),
        F.avg(F.when(F.col("_loss") >= F.col("historical_var_99"), F.col("_loss"))).alias("historical_es_99"),
        F.avg("_loss").alias("_m"), F.coalesce(F.stddev_samp("_loss"), F.lit(0.0)).alias("_s"),
    )
    e = ewma_variance(returns, size=size).groupBy(*keys).agg(
        F.sqrt(F.max_by("ewma_variance", F.when(F.col("ewma_variance").isNotNull(), F.col("bar_index")))).alias("_e")
    )
    dd = drawdown(returns, size).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    z, d = NORMAL_Z[0.95], NORMAL_DENSITY[0.95]
    m = F.col("_m")
    return base.join(e, keys, "left").join(dd, keys, "left").withColumns(
        {
            "normal_var_95": m + F.col("_s") * z,
            "normal_es_95": m + F.col("_s") * d / 0.05,
            "ewma_var_95": m + F.col("_e") * z,
            "ewma_es_95": m + F.col("_e") * d / 0.05,
            "tail_loss_ratio": F.when(F.col("historical_var_95") > 0, F.col("historical_es_95") / F.col("historical_var_95")),
        }
    ).drop("_m", "_s", "_e")


def concentration_bounds(df: DataFrame, value: str, keys: Sequence[str] = KEYS, ks: Sequence[float] = (2, 3, 4, 5)) -> DataFrame:
    """Chebyshev and Cantelli bounds next to the observed k-sigma shares."""
    keys = list(keys)
    v = F.col(value)
    known = df.where(v.isNotNull())
    base = known.groupBy(*keys).agg(F.count(v).alias("sample_size"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    marked = known.join(base, keys)
    gap = v - F.col("mean")
    shares = marked.where("std > 0").groupBy(*keys).agg(
        *[F.avg(flag(F.abs(gap) >= k * F.col("std"))).alias(f"_t{i}") for i, k in enumerate(ks)],
        *[F.avg(flag(gap <= -k * F.col("std"))).alias(f"_d{i}") for i, k in enumerate(ks)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(k)).alias("k"), F.lit(1.0 / (k * k)).alias("chebyshev_bound"), F.lit(1.0 / (1.0 + k * k)).alias("cantelli_downside_bound"),
                F.col(f"_t{i}").alias("empirical_two_sided_exceedance"), F.col(f"_d{i}").alias("empirical_downside_exceedance"),
            )
            for i, k in enumerate(ks)
        ]
    )
    return base.join(shares, keys, "left").select(*keys, "sample_size", "mean", "std", F.explode(rows).alias("_r")).select(
        *keys, "sample_size", "mean", "std", "_r.*"
    )


def top_share(df: DataFrame, value: str, keys: Sequence[str] = KEYS, share: float = 0.05) -> DataFrame:
    """Share of the total held by the largest rows: the top 5 percent by count, at least one row.

    Distinct values carry their counts, so the cut needs no ordering of rows.
    """
    from .quantiles import value_positions

    keys = list(keys)
    pos = value_positions(df.withColumn("_neg", -F.greatest(F.col(value), F.lit(0.0))), keys, "_neg")
    take = F.greatest(F.lit(1), F.ceil(F.col("n_total") * share))
    kept = F.greatest(F.lit(0), F.least(F.col("n_equal"), take - F.col("n_below")))
    return pos.groupBy(*keys).agg(
        ratio(F.sum(-F.col("_neg") * kept), F.sum(-F.col("_neg") * F.col("n_equal"))).alias("volume_concentration")
    )


def microstructure(returns: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """Bounce proxy, zero-return share, range share and volume concentration."""
    keys = list(keys)
    lagged = over_chunks(returns, lambda d, w: d.withColumn("_l", F.lag("log_return").over(w)), back=1, keys=keys, size=size)
    base = lagged.groupBy(*keys).agg(
        F.when(F.count("log_return") >= 3, safe_corr("log_return", "_l")).alias("lag1_return_autocorrelation"),
        F.avg(F.when(F.col("log_return").isNotNull(), flag(F.col("log_return") == 0))).alias("zero_return_ratio"),
        F.avg(ratio(F.col("high") - F.col("low"), "close")).alias("high_low_range_ratio"),
    )
    out = base.join(top_share(returns, "volume", keys), keys, "left")
    return out.withColumn(
        "warnings",
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(F.col("lag1_return_autocorrelation") < -0.15, F.lit("bid_ask_bounce")),
                    F.when(F.col("zero_return_ratio") > 0.25, F.lit("high_zero_return_ratio")),
                )
            ),
            ",",
        ),
    )


def session_summary(returns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, mean and std of returns in three parts of the UTC+8 day; empty parts stay with count 0."""
    keys = list(keys)
    part = F.floor(utc8_hour("open_time_ms") / 8)
    r = F.col("log_return")
    aggs = []
    for i in range(3):
        x = F.when(part == i, r)
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("session"), F.col(f"_n{i}").alias("count"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std"))
            for i, name in enumerate(("00-07", "08-15", "16-23"))
        ]
    )
    return returns.groupBy(*keys).agg(*aggs).select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def metric_rows(tables: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Long report: section, metric and value of several per-series tables."""
    out = None
    for section, (df, cols) in tables.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
        part = df.select(*keys, F.lit(section).alias("section"), F.explode(pairs).alias("_p")).select(*keys, "section", "_p.metric", "_p.value")
        out = part if out is None else out.unionByName(part)
    return out
