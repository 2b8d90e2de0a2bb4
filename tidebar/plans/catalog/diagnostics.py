"""Time-series diagnostics and risk per series."""

from pyspark.sql import functions as F

from ...operators import comovement, diagnostics as D, series
from ...operators.chunks import KEYS
from ..derive import bars
from ..registry import query
from ..samples import LABEL, SAMPLES_SQL, samples
from .factors import erfc_sql
from .series import EWMA_SQL, RET_SQL

IV = 'symbol, "interval"'


def rets(spark, sf):
    return series.bar_returns(bars(spark, sf))


def placed(spark, sf):
    r = rets(spark, sf).where(F.col("log_return").isNotNull())
    return D.positions(r, KEYS, "bar_index", 16_384)


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL) AND min({b}) < max({b}) THEN corr({a}, {b}) END"


def acf_ctes(src: str, part: str, lags: int, order: str) -> str:
    """Autocorrelation table of ``v`` by partition."""
    lag = ", ".join(f"lag(v, {k}) OVER (PARTITION BY {part} ORDER BY {order}) AS l{k}" for k in range(1, lags + 1))
    rows = " UNION ALL ".join(f"SELECT {part}, {k} AS lag, {corr_sql('v', f'l{k}')} AS acf, count(*) AS n FROM al GROUP BY ALL" for k in range(1, lags + 1))
    return f"al AS (SELECT *, {lag} FROM {src}), acfs AS (SELECT *, n - lag AS sample_count FROM (SELECT {part}, 0 AS lag, 1.0 AS acf, count(*) AS n FROM al GROUP BY ALL UNION ALL {rows}))"


LR = f"lr AS (SELECT {IV}, bar_index, log_return AS v FROM rets WHERE log_return IS NOT NULL)"


@query("autocorrelation", f"SELECT {IV}, lag, acf, sample_count, n FROM acfs", f"{RET_SQL}, {LR}, {acf_ctes('lr', IV, 20, 'bar_index')}", "acf")
def _(spark, sf):
    return D.acf(placed(spark, sf), "log_return")


def lb_sql(part: str, lags: int) -> str:
    z = f"(((statistic / {lags}.0) ** (1.0 / 3.0) - (1.0 - 2.0 / (9.0 * {lags}))) / sqrt(2.0 / (9.0 * {lags})))"
    x = f"(abs({z}) / sqrt(2.0))"
    tail = f"0.5 * CASE WHEN {z} < 0 THEN 2.0 - {erfc_sql(x)} ELSE {erfc_sql(x)} END"
    return f"""(SELECT *, CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END AS significant FROM (SELECT *, {tail} AS p_value FROM (
      SELECT {part}, max(n) AS n, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS statistic FROM acfs WHERE lag BETWEEN 1 AND {lags} AND acf IS NOT NULL GROUP BY ALL)))"""


@query("ljung_box", f"SELECT * FROM {lb_sql(IV, 10)}", f"{RET_SQL}, {LR}, {acf_ctes('lr', IV, 10, 'bar_index')}", "statistic p_value", "significant")
def _(spark, sf):
    return D.ljung_box(D.acf(placed(spark, sf), "log_return", lags=10), KEYS, 10)


VAR = f"lv AS (SELECT {IV}, bar_index, 'return' AS variant, log_return AS v FROM rets WHERE log_return IS NOT NULL UNION ALL SELECT {IV}, bar_index, 'squared', log_return * log_return FROM rets WHERE log_return IS NOT NULL UNION ALL SELECT {IV}, bar_index, 'absolute', abs(log_return) FROM rets WHERE log_return IS NOT NULL)"
KINDS = ("return", "squared", "absolute")


@query(
    "white_noise_diagnostic",
    f"""SELECT {IV}, {", ".join(f"max(CASE WHEN variant = '{k}' THEN {c} END) AS {k}_{c}" for k in KINDS for c in ("statistic", "p_value"))},
      max(CASE WHEN variant = 'return' THEN significant END) AS return_white_noise_rejected, max(CASE WHEN variant <> 'return' THEN significant END) AS volatility_clustering_warning
    FROM {lb_sql(IV + ", variant", 10)} GROUP BY ALL""",
    f"{RET_SQL}, {VAR}, {acf_ctes('lv', IV + ', variant', 10, 'bar_index')}",
    " ".join(f"{k}_{c}" for k in KINDS for c in ("statistic", "p_value")),
    "return_white_noise_rejected volatility_clustering_warning",
)
def _(spark, sf):
    return D.white_noise(placed(spark, sf), "log_return")


@query(
    "volatility_clustering",
    f"SELECT * FROM (SELECT {IV}, avg(abs(acf)) AS score FROM acfs WHERE lag > 0 GROUP BY ALL) JOIN (SELECT {IV}, statistic, p_value, significant AS arch_proxy_warning FROM {lb_sql(IV, 10)}) USING ({IV})",
    f"{RET_SQL}, sqr AS (SELECT {IV}, bar_index, log_return * log_return AS v FROM rets WHERE log_return IS NOT NULL), {acf_ctes('sqr', IV, 10, 'bar_index')}",
    "score statistic p_value",
    "arch_proxy_warning",
)
def _(spark, sf):
    return D.clustering(placed(spark, sf), "log_return")


@query("partial_autocorrelation")
def _(spark, sf):
    return D.pacf(D.acf(placed(spark, sf), "log_return"), KEYS, 10)


DESC = "mean std skewness excess_kurtosis min max positive_pct negative_pct q01 q05 q25 median q75 q95 q99 left_tail_mean_5pct right_tail_mean_5pct tail_asymmetry jb_statistic jb_p_value"


@query(
    "return_distribution",
    f"""SELECT *, exp(-jb_statistic / 2) AS jb_p_value, CASE WHEN coalesce(exp(-jb_statistic / 2) < 0.05, false) THEN 1 ELSE 0 END AS normality_rejected, CASE WHEN coalesce(excess_kurtosis > 1, false) THEN 1 ELSE 0 END AS heavy_tail_warning,
      CASE WHEN right_tail_mean_5pct > 0 THEN abs(left_tail_mean_5pct) / right_tail_mean_5pct END AS tail_asymmetry
    FROM (SELECT *, n / 6.0 * (skewness * skewness + excess_kurtosis * excess_kurtosis / 4) AS jb_statistic FROM (
      SELECT {IV}, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, skewness(v) AS skewness, kurtosis(v) AS excess_kurtosis, min(v) AS min, max(v) AS max, avg(CASE WHEN v > 0 THEN 100.0 ELSE 0.0 END) AS positive_pct,
        avg(CASE WHEN v < 0 THEN 100.0 ELSE 0.0 END) AS negative_pct, {", ".join(f"quantile_cont(v, {p}) AS {n}" for p, n in ((0.01, "q01"), (0.05, "q05"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.95, "q95"), (0.99, "q99")))}
      FROM lr GROUP BY ALL)) JOIN (SELECT {IV}, avg(v) FILTER (v <= a) AS left_tail_mean_5pct, avg(v) FILTER (v >= b) AS right_tail_mean_5pct FROM lr JOIN (SELECT {IV}, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM lr GROUP BY ALL) USING ({IV}) GROUP BY ALL) USING ({IV})""",
    f"{RET_SQL}, {LR}",
    DESC,
    "normality_rejected heavy_tail_warning",
)
def _(spark, sf):
    return D.describe(rets(spark, sf), "log_return")


RISK = "historical_var_95 historical_es_95 historical_var_99 historical_es_99 max_drawdown normal_var_95 normal_es_95 ewma_var_95 ewma_es_95 tail_loss_ratio"


@query(
    "risk_summary",
    f"""SELECT {IV}, v95 AS historical_var_95, e95 AS historical_es_95, v99 AS historical_var_99, e99 AS historical_es_99, max_drawdown, m + s * {D.NORMAL_Z[0.95]} AS normal_var_95, m + s * {D.NORMAL_DENSITY[0.95]} / 0.05 AS normal_es_95,
      m + ew * {D.NORMAL_Z[0.95]} AS ewma_var_95, m + ew * {D.NORMAL_DENSITY[0.95]} / 0.05 AS ewma_es_95, CASE WHEN v95 > 0 THEN e95 / v95 END AS tail_loss_ratio
    FROM (SELECT {IV}, max(v95) AS v95, max(v99) AS v99, avg(-v) FILTER (-v >= v95) AS e95, avg(-v) FILTER (-v >= v99) AS e99, avg(-v) AS m, stddev_samp(v) AS s
          FROM lr JOIN (SELECT {IV}, quantile_cont(-v, 0.95) AS v95, quantile_cont(-v, 0.99) AS v99 FROM lr GROUP BY ALL) USING ({IV}) GROUP BY ALL)
    JOIN (SELECT {IV}, last(sqrt(v) ORDER BY bar_index) AS ew FROM ewma GROUP BY ALL) USING ({IV})
    JOIN (SELECT {IV}, min(w / pk - 1) AS max_drawdown FROM (SELECT *, max(w) OVER (PARTITION BY {IV} ORDER BY bar_index) AS pk FROM (SELECT *, exp(sum(v) OVER (PARTITION BY {IV} ORDER BY bar_index)) AS w FROM lr)) GROUP BY ALL) USING ({IV})""",
    f"{EWMA_SQL}, {LR}",
    RISK,
)
def _(spark, sf):
    return D.risk_summary(rets(spark, sf))


CB = "k mean std chebyshev_bound cantelli_downside_bound empirical_two_sided_exceedance empirical_downside_exceedance"


@query(
    "concentration_bounds",
    f"""SELECT {IV}, count(*) AS sample_size, max(m) AS mean, max(s) AS std, k, 1 / (k * k) AS chebyshev_bound, 1 / (1 + k * k) AS cantelli_downside_bound, avg(CASE WHEN abs(v - m) >= k * s THEN 1.0 ELSE 0.0 END) AS empirical_two_sided_exceedance,
      avg(CASE WHEN v - m <= -k * s THEN 1.0 ELSE 0.0 END) AS empirical_downside_exceedance
    FROM lr JOIN (SELECT {IV}, avg(v) AS m, stddev_samp(v) AS s FROM lr GROUP BY ALL) USING ({IV}), (SELECT unnest([2.0, 3.0, 4.0, 5.0]) AS k) GROUP BY {IV}, k""",
    f"{RET_SQL}, {LR}",
    CB,
)
def _(spark, sf):
    return D.concentration_bounds(rets(spark, sf), "log_return")


@query(
    "microstructure_proxies",
    f"""SELECT *, array_to_string(list_filter([CASE WHEN lag1_return_autocorrelation < -0.15 THEN 'bid_ask_bounce' END, CASE WHEN zero_return_ratio > 0.25 THEN 'high_zero_return_ratio' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM (SELECT {IV}, {corr_sql('log_return', 'l')} AS lag1_return_autocorrelation, avg(CASE WHEN log_return = 0 THEN 1.0 WHEN log_return IS NOT NULL THEN 0.0 END) AS zero_return_ratio, avg((high - low) / close) AS high_low_range_ratio
          FROM (SELECT *, lag(log_return) OVER (PARTITION BY {IV} ORDER BY bar_index) AS l FROM rets) GROUP BY ALL)
    JOIN (SELECT {IV}, sum(volume) FILTER (rn <= greatest(1, ceil(n * 0.05))) / sum(volume) AS volume_concentration FROM (SELECT *, row_number() OVER (PARTITION BY {IV} ORDER BY volume DESC) AS rn, count(*) OVER (PARTITION BY {IV}) AS n FROM bars) GROUP BY ALL) USING ({IV})""",
    RET_SQL,
    "lag1_return_autocorrelation zero_return_ratio high_low_range_ratio volume_concentration",
)
def _(spark, sf):
    return D.microstructure(rets(spark, sf))


@query(
    "intraday_session_summary",
    f"""SELECT {IV}, session, count(r) AS count, avg(r) AS mean, stddev_samp(r) AS std FROM (SELECT {IV}, s AS session, CASE WHEN s = CASE ((open_time_ms + 28800000) // 3600000) % 24 // 8 WHEN 0 THEN '00-07' WHEN 1 THEN '08-15' ELSE '16-23' END THEN log_return END AS r
       FROM rets, (SELECT unnest(['00-07', '08-15', '16-23']) AS s)) GROUP BY ALL""",
    RET_SQL,
    "mean std",
)
def _(spark, sf):
    return D.session_summary(rets(spark, sf))


RETURNS_SQL = "mv AS (SELECT symbol, open_time_ms, log_return AS v FROM rets WHERE log_return IS NOT NULL), ms AS (SELECT DISTINCT symbol FROM mv)"


@query(
    "correlation_matrix",
    """SELECT p.a, p.b, count(x.v) AS n, CASE WHEN count(x.v) >= 2 THEN corr(x.v, y.v) END AS corr FROM (SELECT l.symbol AS a, r.symbol AS b FROM ms l, ms r WHERE l.symbol <= r.symbol) p
       LEFT JOIN (mv x JOIN mv y USING (open_time_ms)) ON x.symbol = p.a AND y.symbol = p.b GROUP BY 1, 2""",
    f"{RET_SQL}, {RETURNS_SQL}",
    "corr",
)
def _(spark, sf):
    return comovement.pairwise_correlations(rets(spark, sf), "open_time_ms", "symbol", "log_return")


# the correlations are squared over and over, so that only their leading direction is left
@query(
    "pca_first_factor",
    "SELECT symbol AS series, v * sign(max_by(v, abs(v)) OVER ()) AS beta_to_first_pc, share AS explained_variance_ratio FROM pv",
    f"""RECURSIVE {RET_SQL}, {RETURNS_SQL},
    mf AS (SELECT open_time_ms FROM mv GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM ms)),
    mz AS (SELECT symbol, open_time_ms, v FROM mv JOIN mf USING (open_time_ms) QUALIFY min(v) OVER (PARTITION BY symbol) < max(v) OVER (PARTITION BY symbol)),
    mc AS (SELECT x.symbol AS i, y.symbol AS j, corr(x.v, y.v) AS v FROM mz x JOIN mz y USING (open_time_ms) GROUP BY 1, 2 HAVING (SELECT count(DISTINCT symbol) FROM mz) >= 2),
    mp AS (SELECT 0 AS k, i, j, v FROM mc UNION ALL SELECT k + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (SELECT x.k, x.i, y.j, sum(x.v * y.v) AS v FROM mp x JOIN mp y ON x.j = y.i WHERE x.k < 18 GROUP BY 1, 2, 3)),
    pl AS (SELECT i AS symbol, v / sqrt(sum(v * v) OVER ()) AS v FROM mp WHERE k = 18 AND j = (SELECT i FROM mp WHERE k = 18 AND i = j ORDER BY v DESC, i LIMIT 1)),
    pv AS (SELECT symbol, v, (SELECT sum(a.v * mc.v * b.v) FROM mc JOIN pl a ON a.symbol = mc.i JOIN pl b ON b.symbol = mc.j) / count(*) OVER () AS share FROM pl)""",
    "beta_to_first_pc explained_variance_ratio",
)
def _(spark, sf):
    full = comovement.complete_times(rets(spark, sf), "open_time_ms", "symbol", "log_return")
    first = comovement.first_component(*comovement.correlation_blocks(full, "open_time_ms", "symbol", "log_return"))
    return first.select("series", F.col("loading").alias("beta_to_first_pc"), F.col("share").alias("explained_variance_ratio"))


@query(
    "outcome_series_diagnostics",
    f"SELECT outcome, side, variant, n, statistic, p_value, significant FROM {lb_sql('outcome, side, variant', 10)}",
    f"""{SAMPLES_SQL}, o1 AS (SELECT side, sample_no, 'mfe_10' AS outcome, mfe_10 AS x FROM samples UNION ALL SELECT side, sample_no, '{LABEL}', {LABEL} FROM samples),
    ov AS (SELECT side, outcome, sample_no, 'return' AS variant, x AS v FROM o1 WHERE x IS NOT NULL UNION ALL SELECT side, outcome, sample_no, 'squared', x * x FROM o1 WHERE x IS NOT NULL UNION ALL SELECT side, outcome, sample_no, 'absolute', abs(x) FROM o1 WHERE x IS NOT NULL),
    {acf_ctes('ov', 'outcome, side, variant', 10, 'sample_no')}""",
    "statistic p_value",
    "significant",
)
def _(spark, sf):
    from ...operators.study import unpivot

    long = unpivot(samples(spark, sf), ["side", "sample_no"], ["mfe_10", LABEL], "outcome", "x").where("x is not null")
    keys = ["outcome", "side"]
    pos = D.positions(long, keys, "sample_no", 10_000_000)
    on = [*keys, "variant"]
    return D.ljung_box(D.acf(D.variants(pos, "x", keys, "pos"), "value", on, "pos", 10), on, 10)


@query(
    "series_report",
    f"""SELECT {IV}, 'distribution' AS section, 'n' AS metric, cast(count(v) AS DOUBLE) AS value FROM lr GROUP BY ALL UNION ALL SELECT {IV}, 'distribution', 'mean', avg(v) FROM lr GROUP BY ALL
      UNION ALL SELECT {IV}, 'distribution', 'std', stddev_samp(v) FROM lr GROUP BY ALL UNION ALL SELECT {IV}, 'distribution', 'median', median(v) FROM lr GROUP BY ALL
      UNION ALL SELECT {IV}, 'sessions', session, cast(count(r) AS DOUBLE) FROM (SELECT {IV}, s AS session, CASE WHEN s = CASE ((open_time_ms + 28800000) // 3600000) % 24 // 8 WHEN 0 THEN '00-07' WHEN 1 THEN '08-15' ELSE '16-23' END THEN log_return END AS r
       FROM rets, (SELECT unnest(['00-07', '08-15', '16-23']) AS s)) GROUP BY ALL""",
    f"{RET_SQL}, {LR}",
    "value",
)
def _(spark, sf):
    r = rets(spark, sf)
    s = D.session_summary(r).select(*KEYS, F.lit("sessions").alias("section"), F.col("session").alias("metric"), F.col("count").cast("double").alias("value"))
    return D.metric_rows({"distribution": (D.describe(r, "log_return"), ["n", "mean", "std", "median"])}).unionByName(s)
