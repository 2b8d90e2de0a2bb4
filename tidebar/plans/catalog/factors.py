"""Factor research, rule search and splits."""

from pyspark.sql import functions as F

from ...functions.scalar import ERF_A, ERF_T, utc8_month
from ...operators import factors, labels, rulebook, rules, series, splits, study, universe
from ...operators.chunks import KEYS
from ...session import fresh, written
from ..derive import STEP, bars
from ..registry import query
from ..samples import FACTORS, LABEL, SAMPLES_SQL, samples
from .features import UNIVERSE_SQL
from .series import RET_SQL
from .study import DECIDED_SQL, decided, long_sql



def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + {ERF_T} * ({x})))"
    a = ERF_A
    return f"({t} * ({a[0]} + {t} * ({a[1]} + {t} * ({a[2]} + {t} * ({a[3]} + {t} * {a[4]})))) * exp(-({x}) * ({x})))"


def ranks(src: str, groups: str, x: str = "value", y: str = LABEL) -> str:
    return f"""(SELECT {groups}, {x} AS x, {y} AS y, rank() OVER (PARTITION BY {groups} ORDER BY {x}) + (count(*) OVER (PARTITION BY {groups}, {x}) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY {groups} ORDER BY {y}) + (count(*) OVER (PARTITION BY {groups}, {y}) - 1) / 2.0 AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""


def cor(a: str, b: str) -> str:
    return f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END"


IC_FLOATS = "pearson_ic spearman_rank_ic p_value ic_mean_by_block ic_std_by_block ic_positive_ratio stability_score"


def factor_long(spark, sf, names=FACTORS):
    s = samples(spark, sf).withColumn("month", utc8_month("open_time_ms"))
    return study.unpivot(s, ["sample_no", "month", LABEL], names, "factor", "value")


T_SQL = "abs(spearman_rank_ic) * sqrt((sample_count - 2) / greatest(1e-12, 1 - spearman_rank_ic * spearman_rank_ic)) / sqrt(2.0)"


@query(
    "factor_information_coefficient",
    f"""SELECT *, ic_mean / 1.0 AS ic_mean_by_block, ic_sd AS ic_std_by_block, abs(ic_mean) / (ic_sd + 1e-12) AS stability_score, CASE WHEN coalesce(time_block_count, 0) < 3 THEN 1 ELSE 0 END AS min_block_count_warning,
        CASE WHEN sample_count >= 3 AND spearman_rank_ic IS NOT NULL THEN CASE WHEN abs(spearman_rank_ic) >= 1 THEN 0.0 ELSE {erfc_sql("(" + T_SQL + ")")} END END AS p_value
    FROM (SELECT factor, count(*) AS sample_count, {cor('x', 'y')} AS pearson_ic, {cor('rx', 'ry')} AS spearman_rank_ic FROM {ranks('lg', 'factor')} GROUP BY 1)
    LEFT JOIN (SELECT factor, avg(ic) AS ic_mean, stddev_pop(ic) AS ic_sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS ic_positive_ratio, count(*) AS time_block_count
      FROM (SELECT factor, month, {cor('rx', 'ry')} AS ic FROM {ranks('lg', 'factor, month')} GROUP BY 1, 2) WHERE ic IS NOT NULL GROUP BY 1) USING (factor)""".replace("SELECT *, ic_mean / 1.0", "SELECT * EXCLUDE (ic_mean, ic_sd), ic_mean"),
    f"{SAMPLES_SQL}, lg AS (SELECT *, strftime(make_timestamp((open_time_ms + 28800000) * 1000), '%Y-%m') AS month FROM ({long_sql(FACTORS, 'open_time_ms, ' + LABEL, name='factor')}))",
    IC_FLOATS,
    "min_block_count_warning",
)
def _(spark, sf):
    return factors.factor_ic(factor_long(spark, sf), "factor", "value", LABEL, "month")


@query(
    "factor_ic_block_bootstrap",
    f"""SELECT factor, quantile_cont(ic, 0.025) AS ic_bootstrap_ci_low, quantile_cont(ic, 0.975) AS ic_bootstrap_ci_high, count(ic) AS bootstrap_sample_count, max(b) AS block_size
    FROM (SELECT factor, rep, max(b) AS b, {cor('rx', 'ry')} AS ic FROM (
      SELECT factor, rep, b, rank() OVER (PARTITION BY factor, rep ORDER BY value) + (count(*) OVER (PARTITION BY factor, rep, value) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY factor, rep ORDER BY {LABEL}) + (count(*) OVER (PARTITION BY factor, rep, {LABEL}) - 1) / 2.0 AS ry
      FROM draws JOIN pos USING (factor, p)) GROUP BY 1, 2) GROUP BY 1""",
    f"""{SAMPLES_SQL}, lg AS ({long_sql(FACTORS, 'sample_no, ' + LABEL, name='factor')}),
    pos AS (SELECT factor, value, {LABEL}, row_number() OVER (PARTITION BY factor ORDER BY sample_no) - 1 AS p, count(*) OVER (PARTITION BY factor) AS n FROM lg WHERE value IS NOT NULL AND {LABEL} IS NOT NULL),
    shp AS (SELECT factor, n, least(n, greatest(cast(ceil(sqrt(n)) AS BIGINT), 10)) AS b FROM (SELECT DISTINCT factor, n FROM pos)),
    st AS (SELECT factor, n, b, rep, j, cast('0x' || substr(md5(factor || ':' || rep || ':' || j), 1, 15) AS BIGINT) % (n - b + 1) AS s
           FROM shp, (SELECT unnest(range(0, 200)) AS rep), LATERAL (SELECT unnest(range(0, cast(ceil(n / cast(b AS DOUBLE)) AS BIGINT))) AS j)),
    draws AS (SELECT factor, rep, b, s + o AS p FROM st, LATERAL (SELECT unnest(range(0, b)) AS o) WHERE j * b + o < n)""",
    "ic_bootstrap_ci_low ic_bootstrap_ci_high",
    "block_size",
)
def _(spark, sf):
    return factors.block_bootstrap_ic(factor_long(spark, sf, FACTORS), "factor", "value", LABEL, "sample_no", 10, 200)


# -- splits over the event samples and the entry universe


def fold_case(n: int, purge: int, embargo: int) -> str:
    out = []
    for k in range(n):
        stop = "n" if k == n - 1 else f"least(n, f + {k} * z + z)"
        out.append(
            f"SELECT *, 'period_{k + 1}' AS period, CASE WHEN p < f + {k} * z - {purge} THEN 'train' WHEN p >= least({stop}, f + {k} * z + {embargo}) AND p < {stop} THEN 'test' END AS split FROM fz "
            f"WHERE n >= 2 AND f + {k} * z < n AND {stop} > f + {k} * z AND f + {k} * z - {purge} > 0 AND least({stop}, f + {k} * z + {embargo}) < {stop}"
        )
    return " UNION ALL ".join(out)


def folds_ctes(src: str, part: str, order: str, n: int, purge: int, embargo: int) -> str:
    return f"""
fp AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1 AS p, count(*) OVER (PARTITION BY {part}) AS n FROM {src}),
fz AS (SELECT *, greatest(1, (n - greatest(1, n // 2)) // {n}) AS z, greatest(1, n // 2) AS f FROM fp),
folds AS (SELECT * FROM ({fold_case(n, purge, embargo)}) WHERE split IS NOT NULL)"""


OBS_SQL = f"{RET_SQL}, {UNIVERSE_SQL}, ob AS (SELECT observation_id, symbol, \"interval\", bar_index, bar_index + 1 AS label_start_bar, bar_index + 10 AS label_end_bar FROM uni)"


def obs(spark, sf):
    return labels.label_window(universe.entry_universe(bars(spark, sf)).select("observation_id", *KEYS, "bar_index"), 10)


IV = 'symbol, "interval"'
PART = f'PARTITION BY {IV}'
CHRON_SQL = f"""
{OBS_SQL},
cn AS (SELECT *, row_number() OVER ({PART} ORDER BY bar_index, observation_id) - 1 AS p, count(*) OVER ({PART}) AS n FROM ob),
ch AS (SELECT * EXCLUDE (p, n), CASE WHEN n < 3 OR floor(n * 0.6) <= 0 OR floor(n * 0.2) <= 0 OR n - floor(n * 0.6) - floor(n * 0.2) <= 0 THEN 'too_small'
         WHEN p < floor(n * 0.6) THEN 'train' WHEN p < floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM cn)"""


@query("chronological_split", "SELECT observation_id, split FROM ch", CHRON_SQL)
def _(spark, sf):
    return splits.chronological(obs(spark, sf), 0.6, 0.2, 0.2).select("observation_id", "split")


@query(
    "purged_embargo_split",
    """SELECT observation_id, CASE WHEN p < greatest(c - 3, 0) THEN 'train' WHEN p < c THEN 'purged' WHEN p < least(n, c + 2) THEN 'embargoed' ELSE 'test' END AS split
    FROM (SELECT *, least(n, cast(floor(n * 0.7) AS BIGINT)) AS c FROM cn)""",
    CHRON_SQL,
)
def _(spark, sf):
    return splits.purged_embargo(obs(spark, sf), 0.7, 3, 2).select("observation_id", "split")


@query(
    "walk_forward_expanding_folds",
    "SELECT observation_id, period, split FROM folds",
    f"{OBS_SQL}, {folds_ctes('ob', IV, 'bar_index, observation_id', 3, 2, 1)}",
)
def _(spark, sf):
    return splits.expanding_folds(obs(spark, sf), 3, 0.5, 2, 1).select("observation_id", "period", "split")


ROLL_SQL = f"""
{CHRON_SQL},
rf AS (SELECT cn.* EXCLUDE (p, n), fold, CASE WHEN p - fold * 4 < 12 THEN 'train' WHEN p - fold * 4 < 16 THEN 'validation' ELSE 'test' END AS split
       FROM cn, LATERAL (SELECT unnest(range(0, n)) AS fold) WHERE n >= 20 AND fold <= (n - 20) // 4 AND p >= fold * 4 AND p < fold * 4 + 20)"""


@query("walk_forward_rolling_folds", "SELECT observation_id, fold, split FROM rf", ROLL_SQL)
def _(spark, sf):
    return splits.rolling_folds(obs(spark, sf), 12, 4, 4, 4).select("observation_id", "fold", "split")


def purge_ctes(src: str, keys: str, embargo: int, episodes: bool = False) -> str:
    on = " AND ".join(f"e.{k} = t.{k}" for k in keys.split(", "))
    ep = f"WHEN split = 'train' AND EXISTS (SELECT 1 FROM {src} e WHERE {on} AND e.split IN ('validation', 'test') AND e.episode_id = t.episode_id) THEN 'purged_episode'" if episodes else ""
    return f"""
ev AS (SELECT {keys}, min(bar_index) AS lo, max(bar_index) AS hi FROM {src} WHERE split IN ('validation', 'test') GROUP BY ALL),
pg AS (SELECT t.* EXCLUDE (split), CASE
    WHEN split = 'train' AND EXISTS (SELECT 1 FROM {src} e WHERE {on} AND e.split IN ('validation', 'test') AND greatest(e.label_start_bar, t.label_start_bar) <= least(e.label_end_bar, t.label_end_bar)) THEN 'purged'
    WHEN split = 'train' AND {embargo} > 0 AND bar_index BETWEEN lo - {embargo} AND hi + {embargo} THEN 'embargoed' {ep} ELSE split END AS split
  FROM {src} t LEFT JOIN ev USING ({keys}))"""


@query("purged_chronological_split", "SELECT observation_id, split FROM pg", f"{CHRON_SQL}, {purge_ctes('ch', IV, 15)}")
def _(spark, sf):
    return splits.purged_chronological(obs(spark, sf), 0.6, 0.2, 0.2, 15).select("observation_id", "split")


@query("purged_walk_forward", "SELECT observation_id, fold, split FROM pg", f"{ROLL_SQL}, {purge_ctes('rf', IV + ', fold', 12)}")
def _(spark, sf):
    return splits.purged_walk_forward(obs(spark, sf), 12, 4, 4, 4, 12).select("observation_id", "fold", "split")


@query(
    "embargo_boundaries",
    f"""SELECT observation_id, CASE WHEN split = 'validation' AND bar_index <= t + 20 THEN 'embargoed' WHEN split = 'test' AND bar_index <= v + 20 THEN 'embargoed' ELSE split END AS split
    FROM ch LEFT JOIN (SELECT {IV}, max(bar_index) FILTER (split = 'train') AS t, max(bar_index) FILTER (split = 'validation') AS v FROM ch GROUP BY ALL) USING ({IV})""",
    CHRON_SQL,
)
def _(spark, sf):
    return splits.embargo_boundaries(splits.chronological(obs(spark, sf), 0.6, 0.2, 0.2), KEYS, 20).select("observation_id", "split")


EPI = f"""
ep AS (SELECT *, symbol || '|' || "interval" || '|ep_' || lpad(cast(1 + sum(CASE WHEN bar_index - pb > 3 THEN 1 ELSE 0 END) OVER ({PART} ORDER BY bar_index) AS VARCHAR), 6, '0') AS episode_id
       FROM (SELECT *, lag(bar_index) OVER ({PART} ORDER BY bar_index) AS pb FROM SRC))"""


@query("episode_ids", "SELECT observation_id, episode_id FROM ep", f"{OBS_SQL}, {EPI.replace('SRC', 'ob')}")
def _(spark, sf):
    return series.episodes(obs(spark, sf), 3).select("observation_id", "episode_id")


EPS_SQL = f"{CHRON_SQL}, {EPI.replace('SRC', 'ch')}, {purge_ctes('ep', IV, 0, True)}"


@query("purged_split_with_episodes", "SELECT observation_id, split FROM pg", EPS_SQL)
def _(spark, sf):
    return splits.purged_chronological(series.episodes(obs(spark, sf), 3), 0.6, 0.2, 0.2, episodes=True).select("observation_id", "split")


@query(
    "split_integrity",
    f"""SELECT *, CASE WHEN warnings = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT {IV}, a AS train_count, b AS validation_count, c AS test_count, pu AS purged_count, em AS embargoed_count, 0 AS duplicate_observation_count, coalesce(ov, 0) AS label_window_overlap_count, coalesce(lk, 0) AS episode_leakage_count,
        array_to_string(list_filter([CASE WHEN coalesce(t1 > v0, false) OR coalesce(v1 > s0, false) THEN 'time_order_violation' END, CASE WHEN a = 0 OR b = 0 OR c = 0 THEN 'empty_split' END,
          CASE WHEN lk > 0 THEN 'episode_leakage' END, CASE WHEN ov > 0 THEN 'label_window_overlap' END], lambda x: x IS NOT NULL), ',') AS warnings
      FROM (SELECT {IV}, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'validation') AS b, count(*) FILTER (split = 'test') AS c, count(*) FILTER (split IN ('purged', 'purged_episode')) AS pu,
         count(*) FILTER (split = 'embargoed') AS em, max(bar_index) FILTER (split = 'train') AS t1, min(bar_index) FILTER (split = 'validation') AS v0, max(bar_index) FILTER (split = 'validation') AS v1, min(bar_index) FILTER (split = 'test') AS s0
         FROM ep GROUP BY ALL)
      LEFT JOIN (SELECT {IV}, count(*) AS ov FROM ep t WHERE split = 'train' AND EXISTS (SELECT 1 FROM ep e WHERE e.symbol = t.symbol AND e."interval" = t."interval" AND e.split IN ('validation', 'test')
         AND greatest(e.label_start_bar, t.label_start_bar) <= least(e.label_end_bar, t.label_end_bar)) GROUP BY ALL) USING ({IV})
      LEFT JOIN (SELECT {IV}, count(*) AS lk FROM (SELECT {IV}, episode_id FROM ep GROUP BY ALL HAVING count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split IN ('validation', 'test')) > 0) GROUP BY ALL) USING ({IV}))""",
    EPS_SQL,
    ints="duplicate_observation_count",
)
def _(spark, sf):
    return splits.integrity(splits.chronological(series.episodes(obs(spark, sf), 3), 0.6, 0.2, 0.2))


@query(
    "non_overlapping_windows",
    f"""SELECT observation_id FROM keepers""",
    f"""RECURSIVE {OBS_SQL.strip()}, sq AS (SELECT *, row_number() OVER ({PART} ORDER BY label_start_bar, observation_id) AS k FROM ob),
    keepers AS (
      SELECT symbol, "interval", observation_id, k, label_end_bar FROM sq WHERE k = 1
      UNION ALL
      SELECT n.symbol, n."interval", n.observation_id, n.k, n.label_end_bar FROM keepers c, LATERAL (
        SELECT * FROM sq WHERE sq.symbol = c.symbol AND sq."interval" = c."interval" AND sq.label_start_bar > c.label_end_bar ORDER BY k LIMIT 1) n)""",
)
def _(spark, sf):
    return splits.non_overlapping(obs(spark, sf), size=128).select("observation_id")


@query(
    "factor_stability_by_fold",
    f"SELECT factor, period, count(*) AS sample_count, {cor('x', 'y')} AS pearson_ic, {cor('rx', 'ry')} AS spearman_rank_ic FROM {ranks('lf', 'factor, period')} GROUP BY 1, 2",
    f"""{SAMPLES_SQL}, src AS (SELECT * FROM samples), {folds_ctes('src', 'side', 'open_time_ms, sample_no', 3, 0, 0)},
    tf AS (SELECT * FROM folds WHERE split = 'test'), lf AS ({long_sql(FACTORS, 'period, ' + LABEL, 'tf', 'factor')})""",
    "pearson_ic spearman_rank_ic",
)
def _(spark, sf):
    # written once: the ranks read it several times
    f = written(sample_folds(spark, sf).where("split = 'test'").select("period", LABEL, *FACTORS), "folds")
    return factors.rank_ic(study.unpivot(f, ["period", LABEL], FACTORS, "factor", "value"), ["factor", "period"], "value", LABEL)


# one bar's time: all symbols share a side's line of positions, so a bin holds at most a row of each symbol
WIDTH = STEP


def sample_folds(spark, sf, purge=0):
    return splits.expanding_folds(samples(spark, sf), 3, 0.5, purge, 0, ["side"], WIDTH, "open_time_ms", "sample_no")


def cond_ctes(src: str, names, probs=(0.2, 0.4, 0.6, 0.8), by: str = "") -> str:
    g, group, part = (f"{by}, ", f"GROUP BY {by}", f"PARTITION BY {by} ") if by else ("", "", "")
    per = " UNION ALL ".join(
        f"SELECT {g}{i} AS f, '{n}' AS col, unnest(list_distinct([{', '.join(f'quantile_cont({n}, {p})' for p in probs)}])) AS v FROM {src} {group} HAVING min({n}) < max({n})" for i, n in enumerate(names, 1)
    )
    return f"""
cv AS ({per}),
cc AS (SELECT row_number() OVER ({part}ORDER BY f, v, op) - 1 AS idx, *, printf('%s %s %.6f', col, op, v) AS txt, concat_ws(' ', col, op, row_number() OVER (PARTITION BY {g}f, op ORDER BY v)) AS nm FROM cv, (SELECT unnest(['<=', '>=']) AS op))"""


def truth(names, alias="s") -> str:
    return "CASE c.f " + " ".join(f"WHEN {i} THEN CASE WHEN c.op = '<=' THEN {alias}.{n} <= c.v ELSE {alias}.{n} >= c.v END" for i, n in enumerate(names, 1)) + " END"


def rule_ctes(depth: int = 3) -> str:
    d3 = """UNION ALL SELECT 3, a.idx, b.idx, c.idx, a.txt || ' AND ' || b.txt || ' AND ' || c.txt, a.nm || ' AND ' || b.nm || ' AND ' || c.nm FROM cc a JOIN cc b ON b.idx > a.idx AND b.f <> a.f JOIN cc c ON c.idx > b.idx AND c.f <> a.f AND c.f <> b.f""" if depth == 3 else ""
    d2 = "UNION ALL SELECT 2, a.idx, b.idx, NULL, a.txt || ' AND ' || b.txt, a.nm || ' AND ' || b.nm FROM cc a JOIN cc b ON b.idx > a.idx AND b.f <> a.f" if depth >= 2 else ""
    return f"""
rl AS (SELECT *, 'rule_' || sha256(rule_name) AS rule_id FROM (SELECT 1 AS depth, idx AS i1, NULL AS i2, NULL AS i3, txt AS rule_text, nm AS rule_name FROM cc {d2} {d3}))"""


def hits(names, src: str, cols: str) -> str:
    return f"""
tr AS (SELECT s.sample_no, c.idx FROM {src} s, cc c WHERE coalesce({truth(names)}, false)),
mt AS (SELECT rule_id, t.sample_no FROM rl JOIN tr t ON t.idx = rl.i1
       WHERE (i2 IS NULL OR EXISTS (SELECT 1 FROM tr x WHERE x.sample_no = t.sample_no AND x.idx = i2)) AND (i3 IS NULL OR EXISTS (SELECT 1 FROM tr y WHERE y.sample_no = t.sample_no AND y.idx = i3))),
hit AS (SELECT rule_id, {cols} FROM mt JOIN {src} USING (sample_no))"""


SPLIT_SQL = f"""
{SAMPLES_SQL},
sp0 AS (SELECT *, row_number() OVER (PARTITION BY "interval" ORDER BY open_time_ms, sample_no) - 1 AS p, count(*) OVER (PARTITION BY "interval") AS n FROM samples),
sp AS (SELECT *, CASE WHEN p < c - 10 THEN 'train' WHEN p >= c + 5 THEN 'test' ELSE 'out' END AS split FROM (SELECT *, cast(floor(n * 0.7) AS BIGINT) AS c FROM sp0)),
train AS (SELECT * FROM sp WHERE split = 'train'), used AS (SELECT * FROM sp WHERE split <> 'out')"""


def split_samples(spark, sf):
    return splits.purged_embargo(samples(spark, sf), 0.7, 10, 5, ["interval"], WIDTH, "open_time_ms", "sample_no")


def met_sql(a: str) -> str:
    return f"s{a} / n{a} AS m{a}, w{a} * 100.0 / n{a} AS win{a}, up{a} / nullif(dn{a}, 0) AS pf{a}, CASE WHEN n{a} >= 2 THEN {erfc_sql(f'(abs(s{a} / n{a}) / (sd{a} / sqrt(n{a})) / sqrt(2.0))')} END AS p{a}"


RULE_FLOATS = (
    "mean_return win_rate profit_factor p_value raw_p_value test_mean_return test_win_rate train_score test_score q_value degradation_pct degradation_ratio "
    "stability_score median_return ci_low ci_high"
)

def rule_boot() -> str:
    from .study import boot_ctes

    return boot_ctes("top_rows", "rule_id", LABEL, "event_id", 200)


@query(
    "rule_search",
    """SELECT rule_id, rule_text, coalesce(na, 0) AS sample_count, coalesce(nb, 0) AS test_sample_count, ma AS mean_return, wina AS win_rate, pfa AS profit_factor, pa AS p_value, pb AS raw_p_value,
      mb AS test_mean_return, winb AS test_win_rate, train_score, test_score, q_value, fdr_pass, fdr_status, (train_score - test_score) / nullif(abs(train_score), 0) * 100 AS degradation_pct,
      degradation_ratio, mb / nullif(ma, 0) AS stability_score, validation_status, median_return, ci_low, ci_high, rank_no
    FROM tops LEFT JOIN (SELECT rule_id, median(fwd_ret_10_side_adj) AS median_return FROM top_rows GROUP BY 1) USING (rule_id) LEFT JOIN boot USING (rule_id)""",
    f"""{SPLIT_SQL}, {cond_ctes('train', FACTORS)}, {rule_ctes()}, {hits(FACTORS, 'used', 'split, event_id, ' + LABEL)},
    ag AS (SELECT rule_id, {', '.join(f"count({LABEL}) FILTER (split = '{s}') AS n{a}, sum({LABEL}) FILTER (split = '{s}') AS s{a}, stddev_samp({LABEL}) FILTER (split = '{s}') AS sd{a}, count(*) FILTER (split = '{s}' AND {LABEL} > 0) AS w{a}, sum({LABEL}) FILTER (split = '{s}' AND {LABEL} > 0) AS up{a}, -sum({LABEL}) FILTER (split = '{s}' AND {LABEL} < 0) AS dn{a}" for s, a in (('train', 'a'), ('test', 'b')))} FROM hit WHERE {LABEL} IS NOT NULL GROUP BY 1),
    mx AS (SELECT rule_id, rule_text, nullif(na, 0) AS na, nullif(nb, 0) AS nb, {met_sql('a')}, {met_sql('b')} FROM rl LEFT JOIN (SELECT * REPLACE (nullif(na, 0) AS na, nullif(nb, 0) AS nb, coalesce(upa, 0) AS upa, coalesce(upb, 0) AS upb) FROM ag) USING (rule_id)),
    qv AS (SELECT rule_id, least(1.0, min(pb * k / r) OVER (ORDER BY r DESC)) AS q_value FROM (SELECT rule_id, pb, row_number() OVER (ORDER BY pb, rule_id) AS r, count(*) OVER () AS k FROM mx WHERE pb BETWEEN 0 AND 1)),
    vr AS (SELECT *, CASE WHEN coalesce(q_value <= 0.1, false) THEN 1 ELSE 0 END AS fdr_pass, CASE WHEN q_value IS NULL THEN 'unavailable' ELSE 'available' END AS fdr_status, ma * sqrt(na) AS train_score, mb * sqrt(nb) AS test_score,
             (ma - mb) / nullif(abs(ma), 0) AS degradation_ratio FROM mx LEFT JOIN qv USING (rule_id)),
    vs AS (SELECT *, CASE WHEN coalesce(na, 0) < 30 OR coalesce(nb, 0) < 30 THEN 'rejected_low_sample' WHEN degradation_ratio IS NULL OR q_value IS NULL THEN 'unavailable' WHEN q_value > 0.1 THEN 'rejected_fdr'
             WHEN degradation_ratio > 0.5 THEN 'rejected_oos_degradation' ELSE 'validated_candidate' END AS validation_status FROM vr),
    tops AS (SELECT *, row_number() OVER (ORDER BY validation_status = 'validated_candidate' DESC, fdr_pass DESC, round(test_score, 9) DESC NULLS LAST, round(degradation_ratio, 9) ASC NULLS LAST, coalesce(nb, 0) DESC, round(train_score, 9) DESC NULLS LAST, coalesce(na, 0) DESC, rule_id) AS rank_no FROM vs),
    top_rows AS (SELECT * FROM hit WHERE split = 'train' AND {LABEL} IS NOT NULL AND rule_id IN (SELECT rule_id FROM tops WHERE rank_no <= 200)), {rule_boot()}""",
    RULE_FLOATS,
    "fdr_pass",
)
def _(spark, sf):
    return rules.search_rules(split_samples(spark, sf), FACTORS, LABEL, "event_id", 3, 200, draws=200)


@query(
    "rule_mining_pairs",
    f"""SELECT rule_id, rule_text, n AS sample_count, n * 100.0 / (SELECT count(*) FROM samples) AS coverage_pct, lm AS label_mean, w * 100.0 / n AS win_rate_pct, u AS avg_mfe_10, d AS avg_mae_10, abs(u / nullif(d, 0)) AS risk_reward_proxy
    FROM (SELECT rule_id, count(*) AS n, avg({LABEL}) AS lm, count(*) FILTER ({LABEL} > 0) AS w, avg(mfe_10) AS u, avg(mae_10) AS d FROM hit GROUP BY 1) JOIN rl USING (rule_id) WHERE n >= 30""",
    f"{SAMPLES_SQL}, {cond_ctes('samples', FACTORS)}, {rule_ctes(2)}, {hits(FACTORS, 'samples', LABEL + ', mfe_10, mae_10')}",
    "coverage_pct label_mean win_rate_pct avg_mfe_10 avg_mae_10 risk_reward_proxy",
)
def _(spark, sf):
    return rules.mine_rules(samples(spark, sf), FACTORS, LABEL)


@query(
    "rule_walk_forward",
    """SELECT period, rule_id, na AS train_sample_count, nb AS test_sample_count, ma AS train_mean, mb AS test_mean, wa AS train_win_rate, wb AS test_win_rate, (ma - mb) / nullif(abs(ma), 0) AS degradation_ratio,
      CASE WHEN na < 30 OR nb < 30 THEN 'rejected_low_sample' WHEN (ma - mb) / nullif(abs(ma), 0) IS NULL THEN 'unavailable' WHEN (ma - mb) / abs(ma) > 0.5 THEN 'rejected_oos_degradation' ELSE 'exploratory_candidate' END AS validation_status
    FROM (SELECT period, rule_id, count(*) FILTER (split = 'train') AS na, count(*) FILTER (split = 'test') AS nb, avg(v) FILTER (split = 'train') AS ma, avg(v) FILTER (split = 'test') AS mb,
           avg(CASE WHEN v > 0 THEN 100.0 ELSE 0.0 END) FILTER (split = 'train') AS wa, avg(CASE WHEN v > 0 THEN 100.0 ELSE 0.0 END) FILTER (split = 'test') AS wb
          FROM (SELECT a.period, CASE WHEN b.nm IS NULL THEN 'rule_' || sha256(a.nm) ELSE 'rule_' || sha256(a.nm || ' AND ' || b.nm) END AS rule_id, a.split, a.v FROM tr a
            JOIN (SELECT period, sample_no, idx, f, nm FROM tr UNION ALL SELECT DISTINCT period, sample_no, NULL, NULL, NULL FROM tr) b
            ON a.period = b.period AND a.sample_no = b.sample_no AND (b.idx IS NULL OR (b.idx > a.idx AND b.f <> a.f))) GROUP BY 1, 2)""",
    f"""{SAMPLES_SQL}, src AS (SELECT * FROM samples), {folds_ctes('src', 'side', 'open_time_ms, sample_no', 3, 10, 0)}, ft AS (SELECT * FROM folds WHERE split = 'train'), {cond_ctes('ft', FACTORS, by='period')},
    tr AS (SELECT s.period, s.sample_no, s.split, s.{LABEL} AS v, c.idx, c.f, c.nm FROM folds s JOIN cc c ON c.period = s.period WHERE s.{LABEL} IS NOT NULL AND coalesce({truth(FACTORS)}, false))""",
    "train_mean test_mean train_win_rate test_win_rate degradation_ratio",
)
def _(spark, sf):
    folds = sample_folds(spark, sf, 10)
    conds = rules.thresholds(folds.where("split = 'train'"), FACTORS, by=["period"])
    return rules.walk_forward(folds, conds, rules.candidates(conds, 2), FACTORS, LABEL)


@query(
    "entry_rule_hypotheses",
    """SELECT col AS feature, op AS operator, v AS threshold, n AS sample_count, e AS entry_count, n - e AS reject_count, e / cast(n AS DOUBLE) AS entry_rate, base AS baseline_entry_rate, e / cast(n AS DOUBLE) - base AS entry_rate_lift
    FROM (SELECT idx, count(*) AS n, count(*) FILTER (human_decision = 'ENTRY') AS e FROM tr JOIN jd USING (sample_no) GROUP BY 1) JOIN cc USING (idx), (SELECT avg(CASE WHEN human_decision = 'ENTRY' THEN 1.0 ELSE 0.0 END) AS base FROM jd) WHERE n >= 5""",
    f"{DECIDED_SQL}, jd AS (SELECT * FROM decided WHERE human_decision IN ('ENTRY', 'REJECT')), {cond_ctes('jd', FACTORS, (0.25, 0.5, 0.75))}, {rule_ctes(1)}, {hits(FACTORS, 'jd', LABEL)}",
    "threshold entry_rate baseline_entry_rate entry_rate_lift",
)
def _(spark, sf):
    return rules.decision_hypotheses(decided(spark, sf), FACTORS)


@query(
    "rule_predicate_scan",
    "SELECT event_id FROM samples WHERE pre_ret_10 <= -0.01 AND lower_wick_ratio >= 0.2 AND range_atr_ratio > 0.5",
    SAMPLES_SQL,
)
def _(spark, sf):
    s = samples(spark, sf)
    cond = [
        {"column": "pre_ret_10", "op": "<=", "value": -0.01},
        {"column": "lower_wick_ratio", "op": ">=", "value": 0.2},
        {"column": "range_atr_ratio", "op": ">", "value": 0.5},
    ]
    return s.where(rules.rule_column(cond, s.columns)).select("event_id")


@query(
    "rule_validation_counts",
    """SELECT validation_status, count(*) AS n FROM (SELECT CASE WHEN n < 30 THEN 'rejected_low_sample' WHEN lift < 0 THEN 'rejected_oos_degradation' ELSE 'validated_candidate' END AS validation_status
       FROM (SELECT symbol, count(*) AS n, avg(fwd_ret_10_side_adj) AS lift FROM samples GROUP BY 1)) GROUP BY 1""",
    SAMPLES_SQL,
)
def _(spark, sf):
    g = samples(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("lift"))
    v = splits.rule_verdict(F.col("n"), F.col("n"), F.lit(0.0001), F.col("lift"), F.lit(0.0), 0.1, 30, 1.0)
    return g.select(v.alias("validation_status")).groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"))


# -- stored rules: a book written as CSV with JSON conditions and read back

BOOK_SQL = f"{SAMPLES_SQL}, book AS (SELECT cast(substr(symbol, 2) AS BIGINT) AS rule_index, round(avg(pre_ret_10), 4) AS fall, round(avg(lower_wick_ratio), 4) AS wick FROM samples GROUP BY symbol)"


def condition(column, op, value):
    return F.struct(F.lit(column).alias("column") if isinstance(column, str) else column.alias("column"), F.lit(op).alias("op"), value.cast("double").alias("value"))


def stored_book(spark, sf, *conditions):
    """A rule per symbol from its own averages, through a file as another tool would leave it."""
    own = samples(spark, sf).groupBy(F.substr("symbol", F.lit(2)).cast("long").alias("rule_index")).agg(F.round(F.avg("pre_ret_10"), 4).alias("fall"), F.round(F.avg("lower_wick_ratio"), 4).alias("wick"))
    text = F.to_json(F.array_compact(F.array(*conditions))).alias("conditions_json")
    own.select("rule_index", text).write.option("header", True).option("escape", '"').csv(path := fresh(spark, "rules"))
    return spark.read.option("header", True).option("escape", '"').schema("rule_index long, conditions_json string").csv(path)


@query(
    "stored_rule_signals",
    "SELECT event_id, rule_index FROM samples JOIN book ON round(pre_ret_10, 9) <= fall AND round(lower_wick_ratio, 9) >= wick AND round(range_atr_ratio, 9) > 0.5",
    BOOK_SQL,
)
def _(spark, sf):
    book = stored_book(spark, sf, condition("pre_ret_10", "<=", F.col("fall")), condition("lower_wick_ratio", ">=", F.col("wick")), condition("range_atr_ratio", ">", F.lit(0.5)))
    # factors are compared to nine digits: thresholds have four, and last bits of the factors are not the same everywhere
    return rulebook.rule_signals(samples(spark, sf), book, "event_id", digits=9)


@query(
    "stored_rule_parameters",
    """SELECT rule_index, CASE WHEN problem IS NULL THEN cast(lookback AS DOUBLE) END AS drop_lookback, CASE WHEN problem IS NULL THEN abs(fall) END AS min_drop_pct, CASE WHEN problem IS NULL THEN 20.0 END AS volume_lookback, CASE WHEN problem IS NULL THEN 2.0 END AS volume_spike_multiple,
       CASE WHEN problem IS NULL THEN wick END AS lower_shadow_min_ratio, problem FROM (SELECT *, 5 + rule_index % 3 * 5 AS lookback, CASE WHEN NOT fall < 0 OR fall IS NULL THEN 'no parameter for pre_ret_' || (5 + rule_index % 3 * 5) WHEN rule_index % 5 = 4 THEN 'no parameter for range_pct' END AS problem FROM book)""",
    BOOK_SQL,
    "drop_lookback min_drop_pct volume_lookback volume_spike_multiple lower_shadow_min_ratio",
)
def _(spark, sf):
    i = F.col("rule_index")
    fall = condition(F.concat(F.lit("pre_ret_"), (5 + i % 3 * 5).cast("string")), "<=", F.col("fall"))
    book = stored_book(spark, sf, fall, condition("lower_shadow_ratio", ">=", F.col("wick")), F.when(i % 5 == 4, condition("range_pct", ">", F.lit(0.01))))
    made = rulebook.entry_parameters(book)
    names = ("drop_lookback", "min_drop_pct", "volume_lookback", "volume_spike_multiple", "lower_shadow_min_ratio")
    return made.select("rule_index", *[F.try_element_at("parameters", F.lit(n)).alias(n) for n in names], "problem")
