"""Event studies, distributions, binning and resampling."""

from pyspark.sql import functions as F

from ...functions.scalar import utc8_month
from ...operators import resample, study
from ..registry import query
from ..samples import FACTORS, LABEL, SAMPLES_SQL, samples

STAT_FLOATS = "mean std win_rate profit_loss_ratio q05 q25 median q75 q95"


def stat_sql(v: str) -> str:
    return f"""count({v}) AS sample_count, avg({v}) AS mean, stddev_samp({v}) AS std, avg(CASE WHEN {v} > 0 THEN 100.0 WHEN {v} IS NOT NULL THEN 0.0 END) AS win_rate,
    avg({v}) FILTER ({v} > 0) / nullif(abs(avg({v}) FILTER ({v} < 0)), 0) AS profit_loss_ratio,
    quantile_cont({v}, 0.05) AS q05, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.75) AS q75, quantile_cont({v}, 0.95) AS q95,
    CASE WHEN count({v}) < 30 THEN 'severe' WHEN count({v}) < 100 THEN 'exploratory' ELSE '' END AS small_sample_warning"""


RETS = ("fwd_ret_1_side_adj", "fwd_ret_5_side_adj", LABEL)


@query(
    "event_study_by_tag",
    f"SELECT label_tag, event_type, side, outcome, {stat_sql('value')} FROM (UNPIVOT (SELECT label_tag, event_type, side, {', '.join(RETS)} FROM tagged) ON {', '.join(RETS)} INTO NAME outcome VALUE value) GROUP BY 1, 2, 3, 4",
    SAMPLES_SQL,
    STAT_FLOATS,
)
def _(spark, sf):
    return study.event_study_by_tag(samples(spark, sf), RETS)


def boot_ctes(src: str, groups: str, value: str, row: str, draws: int) -> str:
    """Poisson replicate means and their interval, as SQL."""
    blocks = -(-draws // 4)
    lanes = " UNION ALL ".join(
        f"SELECT {groups}, b * 4 + {k} AS rep, v, (cast('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) / 4294967296.0) AS u FROM bh" for k in range(4)
    )
    weight = " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in resample.POISSON_CDF)
    return f"""
bh AS (SELECT {groups}, {value} AS v, b, md5({row} || ':' || b) AS h FROM {src}, (SELECT unnest(range(0, {blocks})) AS b) WHERE {value} IS NOT NULL),
bl AS ({lanes}),
bm AS (SELECT {groups}, rep, sum(w * v) / nullif(sum(w), 0) AS m FROM (SELECT *, {weight} AS w FROM bl WHERE rep < {draws}) GROUP BY {groups}, rep),
boot AS (SELECT {groups}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY {groups})"""


def grouping_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{' + '.join(g)}' AS group_by, concat_ws('|', {', '.join(f'coalesce({chr(34)}{c}{chr(34)}, {chr(39)}NULL{chr(39)})' for c in g)}) AS group_key, event_id || '#' || label_tag AS rowkey, {LABEL} AS value FROM tagged"
        for g in study.GROUPINGS
    )


@query(
    "event_study_grouping_sets",
    f"SELECT * FROM (SELECT group_by, group_key, {stat_sql('value')} FROM g GROUP BY 1, 2) LEFT JOIN boot USING (group_by, group_key)",
    f"{SAMPLES_SQL}, g AS ({grouping_sql()}), {boot_ctes('g', 'group_by, group_key', 'value', 'rowkey', 200)}",
    STAT_FLOATS + " ci_low ci_high",
)
def _(spark, sf):
    return study.event_study(samples(spark, sf), LABEL, draws=200)


@query("tag_counts", "SELECT label_tag, event_type, count(*) AS n FROM tagged GROUP BY 1, 2", SAMPLES_SQL)
def _(spark, sf):
    return study.explode_tags(samples(spark, sf)).groupBy("label_tag", "event_type").agg(F.count(F.lit(1)).alias("n"))


def long_sql(cols, ids: str, src: str = "samples", name: str = "feature") -> str:
    """NULL-keeping unpivot."""
    return " UNION ALL ".join(f"SELECT {ids}, '{c}' AS {name}, cast({c} AS DOUBLE) AS value FROM {src}" for c in cols)


DIST_FLOATS = "mean std skewness excess_kurtosis q01 q05 q25 q50 q75 q95 q99 top_5pct_abs_share p99_to_p95_abs_ratio median iqr"


def dist_sql(src: str, groups: str) -> str:
    """Distribution statistics; group columns are never NULL here."""
    g = [x.strip() for x in groups.split(",")]
    return f"""
SELECT d.*, q50 AS median, q75 - q25 AS iqr, CASE WHEN coalesce(excess_kurtosis > 1, false) OR coalesce(top_5pct_abs_share > 0.25, false) THEN 1 ELSE 0 END AS heavy_tail_warning
FROM (SELECT {', '.join('s.' + x for x in g)}, count(value) AS n, count(*) FILTER (value IS NULL) AS missing_count, avg(value) AS mean,
        CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END AS std,
        CASE WHEN count(value) >= 3 THEN CASE WHEN stddev_pop(value) = 0 THEN 0.0 ELSE skewness(value) END END AS skewness,
        CASE WHEN count(value) >= 4 THEN CASE WHEN stddev_pop(value) = 0 THEN 0.0 ELSE kurtosis(value) END END AS excess_kurtosis,
        {', '.join(f"quantile_cont(value, {p}) AS {n}" for p, n in zip(study.PROBS, study.PROB_NAMES))},
        CASE WHEN count(value) > 0 THEN CASE WHEN sum(abs(value)) > 0 THEN sum(abs(value)) FILTER (abs(value) >= a95) / sum(abs(value)) ELSE 0.0 END END AS top_5pct_abs_share,
        CASE WHEN max(a95) > 0 THEN max(a99) / max(a95) END AS p99_to_p95_abs_ratio
      FROM {src} s JOIN (SELECT {groups}, quantile_cont(abs(value), 0.95) AS a95, quantile_cont(abs(value), 0.99) AS a99 FROM {src} GROUP BY {groups}) t
        ON {' AND '.join(f's.{x} = t.{x}' for x in g)} GROUP BY {', '.join('s.' + x for x in g)}) d"""


DECIDE = "CASE sample_no % 5 WHEN 0 THEN 'ENTRY' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'UNCERTAIN' WHEN 3 THEN 'ENTRY' ELSE 'REJECT' END"
DECIDED_SQL = f"{SAMPLES_SQL}, decided AS (SELECT *, {DECIDE} AS human_decision, strftime(make_timestamp((open_time_ms + 28800000) * 1000), '%Y-%m') AS period FROM samples)"


def decided(spark, sf):
    return samples(spark, sf).withColumns({"human_decision": F.expr(DECIDE), "period": utc8_month("open_time_ms")})


@query(
    "feature_distribution_by_group",
    dist_sql("lg", "side, feature"),
    f"{DECIDED_SQL}, lg AS ({long_sql(FACTORS, 'side', 'decided')})",
    DIST_FLOATS,
    "heavy_tail_warning",
)
def _(spark, sf):
    return study.distribution(study.unpivot(samples(spark, sf), ["side"], FACTORS), ["side", "feature"])


NAMES = ("n", "mean", "median", "iqr", "skewness", "excess_kurtosis", "q05", "q95")


@query(
    "entry_reject_differences",
    f"""SELECT *, {', '.join(f'entry_{n} - reject_{n} AS {n}_diff' for n in NAMES[1:])} FROM (
      SELECT feature, {', '.join(f"max(CASE WHEN d = '{d}' THEN {n} END) AS {d}_{n}" for d in ('entry', 'reject') for n in NAMES)} FROM ({dist_sql('lg', 'd, feature')}) GROUP BY 1)""",
    f"{DECIDED_SQL}, lg AS (SELECT * FROM ({long_sql(FACTORS, 'lower(human_decision) AS d', 'decided')}) WHERE d IN ('entry', 'reject'))",
    " ".join(f"{d}_{n}" for d in ("entry", "reject") for n in NAMES[1:]) + " " + " ".join(f"{n}_diff" for n in NAMES[1:]),
)
def _(spark, sf):
    return study.entry_vs_reject(decided(spark, sf), FACTORS)


@query(
    "feature_drift_by_month",
    f"""SELECT *, median - baseline_median AS median_diff_vs_first_period, CASE WHEN abs(median - baseline_median) > greatest(0.5, 3 * coalesce(b_iqr, 0)) THEN 1 ELSE 0 END AS drift_warning FROM (
     SELECT *, first_value(median) OVER w AS baseline_median, first_value(iqr) OVER w AS b_iqr FROM ({dist_sql('lg', 'period, feature')}) WINDOW w AS (PARTITION BY feature ORDER BY period))""".replace("SELECT *, median -", "SELECT * EXCLUDE (b_iqr), median -"),
    f"{DECIDED_SQL}, lg AS ({long_sql(FACTORS, 'period', 'decided')})",
    DIST_FLOATS + " baseline_median median_diff_vs_first_period",
    "heavy_tail_warning drift_warning",
)
def _(spark, sf):
    return study.drift(samples(spark, sf), utc8_month("open_time_ms"), FACTORS)


# Fixed value: digits of a factor that bins go by; the bits beyond depend on the order of summing
BIN_DIGITS = 9


def settled(df):
    return df.withColumns({f: F.round(F.col(f).cast("double"), BIN_DIGITS) for f in FACTORS})


def settled_sql(long: str) -> str:
    return f"SELECT * REPLACE (round(value, {BIN_DIGITS}) AS value) FROM ({long})"


def rank_bin_sql(q: int, extra: str = "") -> str:
    return f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, sample_no) AS r, count(*) OVER (PARTITION BY feature) AS n FROM lg WHERE value IS NOT NULL),
kd AS (SELECT feature, greatest(1, least({q}, count(DISTINCT value))) AS bins FROM lg GROUP BY 1),
binned AS (SELECT rk.*, CASE WHEN bins <= 1 THEN 0 ELSE greatest(0, cast(ceil((r - 1) * bins / cast(greatest(n - 1, 1) AS DOUBLE)) AS BIGINT) - 1) END AS bin_id FROM rk JOIN kd USING (feature))"""


@query(
    "decision_rate_by_bin",
    """SELECT *, entry_count / nullif(cast(entry_count + reject_count AS DOUBLE), 0) AS entry_rate FROM (
      SELECT feature, bin_id, min(value) AS bin_left, max(value) AS bin_right, count(*) AS total_count, count(*) FILTER (human_decision = 'ENTRY') AS entry_count,
             count(*) FILTER (human_decision = 'REJECT') AS reject_count FROM binned GROUP BY 1, 2)""",
    f"{DECIDED_SQL}, lg AS ({settled_sql(long_sql(FACTORS, 'sample_no, human_decision', 'decided'))}), {rank_bin_sql(4)}",
    "bin_left bin_right entry_rate",
    "bin_id",
)
def _(spark, sf):
    return study.decision_bins(settled(decided(spark, sf)), FACTORS, "sample_no")


@query(
    "outcome_by_feature_bin",
    f"""SELECT 'posterior_only' AS analysis_role, feature, bin_id, bin_left, bin_right, outcome_col, n, entry_count, reject_count, median, iqr, skewness, excess_kurtosis
    FROM ({dist_sql('ob', 'feature, bin_id, outcome_col')}) JOIN (SELECT feature, bin_id, min(value) AS bin_left, max(value) AS bin_right,
      count(*) FILTER (human_decision = 'ENTRY') AS entry_count, count(*) FILTER (human_decision = 'REJECT') AS reject_count FROM binned GROUP BY 1, 2) USING (feature, bin_id)""",
    f"""{DECIDED_SQL}, lg AS ({settled_sql(long_sql(FACTORS, 'sample_no, human_decision, mfe_10, fwd_ret_10_side_adj', 'decided'))}), {rank_bin_sql(4)},
    ob AS (SELECT feature, bin_id, 'mfe_10' AS outcome_col, mfe_10 AS value FROM binned UNION ALL SELECT feature, bin_id, '{LABEL}', {LABEL} FROM binned)""",
    "bin_left bin_right median iqr skewness excess_kurtosis",
    "bin_id",
)
def _(spark, sf):
    return study.outcome_bins(settled(decided(spark, sf)), FACTORS, ["mfe_10", LABEL], "sample_no")


def edge_sql(k: int, by: str = "feature") -> str:
    edges = ", ".join(f"quantile_cont(value, {i / k})" for i in range(k + 1))
    return f"""
ed AS (SELECT {by}, list_distinct([{edges}]) AS raw FROM lg WHERE value IS NOT NULL GROUP BY 1),
es AS (SELECT {by}, list_sort(raw) AS e FROM ed),
binned AS (SELECT lg.*, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < value)) AS bin_id, e FROM lg JOIN es USING ({by}) WHERE value IS NOT NULL AND len(e) > 1)"""


BIN_FLOATS = "bin_left bin_right label_mean win_rate_pct p25 label_median p75"


def bin_body(by: str = "feature") -> str:
    return f"""SELECT {by}, bin_id, max(e[bin_id]) AS bin_left, max(e[bin_id + 1]) AS bin_right, count(*) AS sample_count, avg({LABEL}) AS label_mean,
      avg(CASE WHEN {LABEL} > 0 THEN 100.0 ELSE 0.0 END) AS win_rate_pct, quantile_cont({LABEL}, 0.25) AS p25, quantile_cont({LABEL}, 0.5) AS label_median,
      quantile_cont({LABEL}, 0.75) AS p75, CASE WHEN count(*) < 20 THEN 1 ELSE 0 END AS low_sample_warning FROM binned GROUP BY 1, 2"""


@query("feature_binning", bin_body(), f"{SAMPLES_SQL}, lg AS ({long_sql(FACTORS, LABEL)}), {edge_sql(5)}", BIN_FLOATS, "bin_id low_sample_warning")
def _(spark, sf):
    return study.feature_bins(samples(spark, sf), FACTORS, LABEL)


@query(
    "feature_binning_equal_width",
    bin_body(),
    f"""{SAMPLES_SQL}, lg AS ({long_sql(FACTORS, LABEL)}),
    es AS (SELECT feature, list_sort(list_distinct([{', '.join(f'min(value) + (max(value) - min(value)) * {i / 5}' for i in range(6))}])) AS e FROM lg GROUP BY 1),
    binned AS (SELECT lg.*, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < value)) AS bin_id, e FROM lg JOIN es USING (feature) WHERE value IS NOT NULL AND len(e) > 1)""",
    BIN_FLOATS,
    "bin_id low_sample_warning",
)
def _(spark, sf):
    return study.feature_bins(samples(spark, sf), FACTORS, LABEL, equal_width=True)


FB_FLOATS = "bin_left bin_right mean_label win_rate q25 median_label q75 ci_low ci_high monotonicity_score missing_rate"


@query(
    "factor_binning_summary",
    f"""SELECT f.*, ci_low, ci_high, monotonicity_score, missing_rate, source_sample_count FROM (
      SELECT factor, bin_id, max(e[bin_id]) AS bin_left, max(e[bin_id + 1]) AS bin_right, count(*) AS sample_count, avg({LABEL}) AS mean_label,
        avg(CASE WHEN {LABEL} > 0 THEN 100.0 ELSE 0.0 END) AS win_rate, quantile_cont({LABEL}, 0.25) AS q25, quantile_cont({LABEL}, 0.5) AS median_label, quantile_cont({LABEL}, 0.75) AS q75
      FROM binned GROUP BY 1, 2) f JOIN boot USING (factor, bin_id)
    JOIN (SELECT factor, corr(no, rk) AS monotonicity_score FROM (SELECT factor, row_number() OVER (PARTITION BY factor ORDER BY bin_id) AS no,
           rank() OVER (PARTITION BY factor ORDER BY m) + (count(*) OVER (PARTITION BY factor, m) - 1) / 2.0 AS rk
           FROM (SELECT factor, bin_id, avg({LABEL}) AS m FROM binned GROUP BY 1, 2)) GROUP BY 1) USING (factor)
    JOIN (SELECT factor, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate, count(*) AS source_sample_count FROM lg0 GROUP BY 1) USING (factor)""",
    f"""{SAMPLES_SQL}, lg0 AS ({settled_sql(long_sql(FACTORS, 'event_id, ' + LABEL, name='factor'))}), lg AS (SELECT * FROM lg0 WHERE value IS NOT NULL AND {LABEL} IS NOT NULL),
    nb AS (SELECT factor, least(5, count(DISTINCT value), greatest(2, count(*) // 5)) AS bins FROM lg GROUP BY 1),
    es AS (SELECT factor, CASE bins {' '.join(f"WHEN {k} THEN list_sort(list_distinct([{', '.join(f'round(quantile_cont(value, {i / k}), {BIN_DIGITS})' for i in range(k + 1))}]))" for k in (2, 3, 4, 5))} END AS e
           FROM lg JOIN nb USING (factor) GROUP BY factor, bins),
    binned AS (SELECT lg.*, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < value)) AS bin_id, e FROM lg JOIN es USING (factor) WHERE len(e) > 1),
    {boot_ctes('binned', 'factor, bin_id', LABEL, 'event_id', 200)}""",
    FB_FLOATS,
    "bin_id",
)
def _(spark, sf):
    return study.factor_bins(settled(samples(spark, sf)), FACTORS, LABEL, "event_id", draws=200, digits=BIN_DIGITS)


@query(
    "bootstrap_mean_interval",
    f"""SELECT * FROM (SELECT side, avg({LABEL}) AS estimate, count({LABEL}) AS sample_count, CASE WHEN count({LABEL}) < 30 THEN 'small sample; interval is unstable' ELSE '' END AS warning
       FROM samples WHERE {LABEL} IS NOT NULL GROUP BY 1) JOIN boot USING (side)""",
    f"{SAMPLES_SQL}, {boot_ctes('samples', 'side', LABEL, 'event_id', 1000)}",
    "estimate ci_low ci_high",
)
def _(spark, sf):
    return resample.bootstrap_mean(samples(spark, sf), ["side"], LABEL, "event_id", 1000)


@query(
    "bootstrap_win_rate_interval",
    """SELECT * FROM (SELECT side, avg(win) AS estimate, count(win) AS sample_count, CASE WHEN count(win) < 30 THEN 'small sample; interval is unstable' ELSE '' END AS warning
       FROM wins WHERE win IS NOT NULL GROUP BY 1) JOIN boot USING (side)""",
    f"{SAMPLES_SQL}, wins AS (SELECT *, CASE WHEN {LABEL} > 0 THEN 100.0 WHEN {LABEL} IS NOT NULL THEN 0.0 END AS win FROM samples), {boot_ctes('wins', 'side', 'win', 'event_id', 1000)}",
    "estimate ci_low ci_high",
)
def _(spark, sf):
    return resample.bootstrap_win_rate(samples(spark, sf), ["side"], LABEL, "event_id", 1000)


@query(
    "sign_flip_permutation",
    f"""SELECT side, avg({LABEL}) AS mean_effect, count({LABEL}) AS sample_count, (max(ex) + 1) / 1001.0 AS p_value FROM samples JOIN (
       SELECT side, count(*) FILTER (abs(s) >= abs(obs) - 1e-12) AS ex FROM (
         SELECT side, b * 32 + k AS r, sum(CASE WHEN cast('0x' || substr(h, cast(k + 1 AS INTEGER), 1) AS BIGINT) < 8 THEN v ELSE -v END) AS s FROM
           (SELECT side, {LABEL} AS v, b, k, md5(event_id || ':flip:' || b) AS h FROM samples, (SELECT unnest(range(0, 32)) AS b), (SELECT unnest(range(0, 32)) AS k) WHERE {LABEL} IS NOT NULL)
         GROUP BY 1, 2) JOIN (SELECT side, sum({LABEL}) AS obs FROM samples GROUP BY 1) USING (side) WHERE r < 1000 GROUP BY 1) USING (side) WHERE {LABEL} IS NOT NULL GROUP BY 1""",
    SAMPLES_SQL,
    "mean_effect p_value",
)
def _(spark, sf):
    return resample.sign_flip_test(samples(spark, sf), ["side"], LABEL, "event_id", 1000)


def sub_ctes(src: str, groups: str, value: str, row: str, size: int, draws: int) -> str:
    return f"""
sb AS (SELECT {groups}, {value} AS v, rep, count(*) OVER (PARTITION BY {groups}, rep) AS n,
        row_number() OVER (PARTITION BY {groups}, rep ORDER BY md5({row} || ':sub:' || rep), {row}) AS rn FROM {src}, (SELECT unnest(range(0, {draws})) AS rep) WHERE {value} IS NOT NULL),
sm AS (SELECT {groups}, rep, max(n) AS n, count(*) AS k, avg(v) AS m, median(v) AS md, avg(CASE WHEN v > 0 THEN 100.0 ELSE 0.0 END) AS w FROM sb WHERE rn <= {size} GROUP BY {groups}, rep),
base AS (SELECT {groups}, max(k) AS sample_size, max(n) AS available_label_count, avg(m) AS baseline_mean, coalesce(stddev_samp(m), 0) AS baseline_mean_std, avg(md) AS baseline_median,
        avg(w) AS baseline_win_rate, quantile_cont(m, 0.05) AS baseline_q05, quantile_cont(m, 0.95) AS baseline_q95 FROM sm GROUP BY {groups})"""


BASE_FLOATS = "baseline_mean baseline_mean_std baseline_median baseline_win_rate baseline_q05 baseline_q95"


@query("random_event_baseline", "SELECT * FROM base", f"{SAMPLES_SQL}, {sub_ctes('samples', 'side', LABEL, 'event_id', 100, 200)}", BASE_FLOATS)
def _(spark, sf):
    return resample.subsample_baseline(samples(spark, sf), ["side"], LABEL, "event_id", 100, 200)


@query(
    "event_vs_baseline",
    """SELECT *, event_mean - baseline_mean AS mean_minus_baseline, CASE WHEN event_mean < baseline_q05 THEN 'below_q05' WHEN event_mean > baseline_q95 THEN 'above_q95' ELSE 'inside' END AS position
    FROM (SELECT side, count(v) AS event_sample_count, avg(v) AS event_mean, avg(CASE WHEN v > 0 THEN 100.0 WHEN v IS NOT NULL THEN 0.0 END) AS event_win_rate, median(v) AS event_median
          FROM (SELECT side, fwd_ret_10_side_adj AS v FROM samples WHERE event_type = 'OPEN') GROUP BY 1) JOIN base USING (side)""",
    f"{SAMPLES_SQL}, {sub_ctes('samples', 'side', LABEL, 'event_id', 100, 200)}",
    BASE_FLOATS + " event_mean event_win_rate event_median mean_minus_baseline",
)
def _(spark, sf):
    s = samples(spark, sf)
    base = resample.subsample_baseline(s, ["side"], LABEL, "event_id", 100, 200)
    return resample.against_baseline(s.where("event_type = 'OPEN'"), base, ["side"], LABEL)


@query(
    "random_bar_baseline",
    "SELECT * FROM base",
    f"""{SAMPLES_SQL}, bf AS (SELECT symbol, symbol || '-' || bar_index AS rowkey, CASE WHEN bar_index >= 50 THEN lead(close, 10) OVER (PARTITION BY symbol ORDER BY bar_index) / close - 1 END AS fwd FROM bars),
    {sub_ctes('bf', 'symbol', 'fwd', 'rowkey', 50, 200)}""",
    BASE_FLOATS,
)
def _(spark, sf):
    from ...operators.chunks import over_chunks
    from ..derive import bars

    f = over_chunks(bars(spark, sf), lambda d, w: d.withColumn("fwd", F.lead("close", 10).over(w) / F.col("close") - 1), ahead=10)
    f = f.where("bar_index >= 50").withColumn("rowkey", F.concat_ws("-", "symbol", F.col("bar_index").cast("string")))
    return resample.subsample_baseline(f, ["symbol"], "fwd", "rowkey", 50, 200)
