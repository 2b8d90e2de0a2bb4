"""Audits, guards, change feeds and manifests."""

from pyspark.sql import functions as F

from ...operators import actionlog, cleaning, feed, guards
from ...operators.chunks import KEYS
from ...sources import tables
from ..derive import BARS_SQL, bars
from ..registry import query
from ..samples import FACTORS, SAMPLES_SQL, samples

LOG_SQL = f"""
{BARS_SQL},
log AS (
  SELECT symbol || '-' || (bar_index - bar_index % 4) AS observation_id, 's' AS session_id, symbol, "interval", bar_index, open_time_ms AS changed_at, bar_index AS change_no,
    CASE WHEN bar_index % 4 = 0 THEN 'CREATE' WHEN bar_index % 28 = 27 THEN 'DELETE' ELSE 'UPDATE' END AS operation,
    CASE bar_index % 5 WHEN 0 THEN 'ENTRY' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'UNCERTAIN' ELSE 'ENTRY' END AS human_decision, cast(1 + bar_index % 5 AS INTEGER) AS confidence, 'n' || bar_index AS note FROM bars)"""


def log(spark, sf):
    i = F.col("bar_index")
    return bars(spark, sf).select(
        F.concat_ws("-", "symbol", (i - i % 4).cast("string")).alias("observation_id"), F.lit("s").alias("session_id"), *KEYS, "bar_index",
        F.col("open_time_ms").alias("changed_at"), i.alias("change_no"),
        F.when(i % 4 == 0, "CREATE").when(i % 28 == 27, "DELETE").otherwise("UPDATE").alias("operation"),
        F.when(i % 5 == 1, "REJECT").when(i % 5 == 2, "UNCERTAIN").otherwise("ENTRY").alias("human_decision"),
        (i % 5 + 1).cast("int").alias("confidence"), F.concat(F.lit("n"), i.cast("string")).alias("note"),
    )


@query(
    "current_annotations",
    """SELECT observation_id AS annotation_key, human_decision, confidence, note, v AS annotation_version, a AS created_at, b AS updated_at FROM (
      SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY changed_at DESC, change_no DESC) AS rn, count(*) FILTER (operation <> 'DELETE') OVER (PARTITION BY observation_id) AS v, min(changed_at) OVER (PARTITION BY observation_id) AS a,
        max(changed_at) OVER (PARTITION BY observation_id) AS b FROM log) WHERE rn = 1 AND operation <> 'DELETE'""",
    LOG_SQL,
    ints="confidence",
)
def _(spark, sf):
    return feed.current_annotations(log(spark, sf))


@query(
    "annotation_revisions",
    """SELECT observation_id AS annotation_key, operation, changed_at, row_number() OVER w AS revision_no, lag(human_decision) OVER w AS previous_decision, CASE WHEN operation <> 'DELETE' THEN human_decision END AS new_decision
    FROM log WINDOW w AS (PARTITION BY observation_id ORDER BY changed_at, change_no)""",
    LOG_SQL,
    ints="revision_no",
)
def _(spark, sf):
    h = feed.revision_history(log(spark, sf))
    return h.select(
        "annotation_key", "operation", "changed_at", "revision_no", F.get_json_object("previous_payload", "$.human_decision").alias("previous_decision"),
        F.get_json_object("new_payload", "$.human_decision").alias("new_decision"),
    )


@query(
    "weekly_annotation_summary",
    """SELECT *, annotation_count - lag(annotation_count) OVER (ORDER BY week) AS annotation_count_delta, entry_count - lag(entry_count) OVER (ORDER BY week) AS entry_count_delta, reject_count - lag(reject_count) OVER (ORDER BY week) AS reject_count_delta
    FROM (SELECT changed_at // 604800000 AS week, count(*) AS annotation_count, count(*) FILTER (human_decision = 'ENTRY') AS entry_count, count(*) FILTER (human_decision = 'REJECT') AS reject_count, count(*) FILTER (human_decision = 'UNCERTAIN') AS uncertain_count,
            count(*) FILTER (operation <> 'CREATE') AS modification_count FROM log GROUP BY 1)""",
    LOG_SQL,
)
def _(spark, sf):
    h = log(spark, sf)
    return feed.weekly(h, h)


@query(
    "annotation_validation",
    """SELECT symbol, errors, count(*) AS n FROM (SELECT symbol, array_to_string(list_filter([CASE WHEN bar_index % 17 = 3 THEN 'decision' END, CASE WHEN bar_index % 5 = 4 THEN 'setup_not_decision' END, CASE WHEN bar_index % 17 = 3 OR bar_index % 9 > 4 OR bar_index % 9 < 1 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS errors FROM log) GROUP BY 1, 2""",
    LOG_SQL,
)
def _(spark, sf):
    i = F.col("bar_index")
    a = log(spark, sf).withColumns(
        {
            "human_decision": F.when(i % 17 == 3, "MAYBE").otherwise(F.col("human_decision")), "decision_timing": F.lit("CURRENT_BAR_CLOSE"),
            "setup_bar_index": i - F.when(i % 5 == 4, 1).otherwise(0), "decision_bar_index": i,
            "confidence": F.when((i % 17 == 3) | (i % 9 > 4) | (i % 9 < 1), "9").otherwise("3"), "reason_tags": F.array(F.lit("volume")),
        }
    )
    return guards.validate_annotations(a, ["volume"]).groupBy("symbol", "errors").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_column_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, (count(*) - count({c})) / cast(count(*) AS DOUBLE) AS missing_ratio, 0 AS infinite, CASE WHEN min({c}) = max({c}) THEN 1 ELSE 0 END AS is_constant FROM samples" for c in FACTORS
    ),
    SAMPLES_SQL,
    "missing_ratio",
    "infinite is_constant",
)
def _(spark, sf):
    return cleaning.column_audit(samples(spark, sf), FACTORS)


@query(
    "sample_value_counts",
    "SELECT 'side' AS \"column\", side AS value, count(*) AS n FROM samples GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'symbol', symbol, count(*) FROM samples GROUP BY 2",
    SAMPLES_SQL,
)
def _(spark, sf):
    return cleaning.value_counts(samples(spark, sf), ["side", "event_type", "symbol"])


@query(
    "table_key_differences",
    """WITH k AS (SELECT event_id, event_type = 'OPEN' AS a, bar_index % 2 = 0 AS b FROM samples) SELECT 'features' AS left_table, 'labels' AS right_table, count(*) FILTER (a AND NOT b) AS only_left FROM k WHERE a OR b
       UNION ALL SELECT 'labels', 'features', count(*) FILTER (b AND NOT a) FROM k WHERE a OR b""",
    SAMPLES_SQL,
)
def _(spark, sf):
    s = samples(spark, sf)
    return cleaning.key_differences({"features": s.where("event_type = 'OPEN'"), "labels": s.where("bar_index % 2 = 0")}, "event_id")


@query(
    "feature_label_split",
    "SELECT event_id, pre_ret_10, fwd_ret_10_side_adj, mfe_10 FROM samples",
    SAMPLES_SQL,
    "pre_ret_10 fwd_ret_10_side_adj mfe_10",
)
def _(spark, sf):
    feats, outs, _ = guards.split_columns(samples(spark, sf))
    guards.require_safe(feats.columns[1:], "dataset")
    return feats.select("event_id", "pre_ret_10").join(outs.select("event_id", "fwd_ret_10_side_adj", "mfe_10"), "event_id")


@query(
    "filtered_scan",
    "SELECT event_id FROM samples WHERE side = 'LONG' AND event_type IN ('OPEN')",
    SAMPLES_SQL,
)
def _(spark, sf):
    return tables.where_all(samples(spark, sf), side="LONG", event_type=["OPEN"], symbol=None).select("event_id")


REGISTRY = tuple((c, c != "break_prev_low_20") for c in FACTORS)


@query(
    "sample_leakage_report",
    f"""SELECT c.column_name AS "column", CASE WHEN lower(c.column_name) LIKE 'fwd\\_%' ESCAPE '\\' OR regexp_matches(lower(c.column_name), '^(mfe|mae|post_|future|manual_trade_final|exit|pnl|label)') THEN 'forbidden'
      WHEN c.column_name IN ({", ".join(f"'{n}'" for n in guards.INDEX_COLUMNS)}) THEN 'index' WHEN r.allowed IS NULL THEN 'unregistered' WHEN NOT r.allowed THEN 'disallowed' ELSE 'allowed' END AS finding
    FROM (SELECT DISTINCT unnest(json_keys(to_json(s))) AS column_name FROM samples s) c LEFT JOIN (VALUES {", ".join(f"('{c}', {str(ok).lower()})" for c, ok in REGISTRY)}) r(name, allowed) ON r.name = c.column_name""",
    SAMPLES_SQL,
)
def _(spark, sf):
    registry = spark.createDataFrame(list(REGISTRY), "feature_name string, model_input_allowed boolean")
    return guards.leakage_table(samples(spark, sf), registry)


@query("sample_duplicate_trades", "SELECT trade_id, count(*) AS n FROM samples GROUP BY 1 HAVING count(*) > 1", SAMPLES_SQL)
def _(spark, sf):
    return cleaning.duplicate_ids(samples(spark, sf), "trade_id")


@query("dataset_manifest")
def _(spark, sf):
    s = samples(spark, sf)
    return tables.dataset_manifest(s, cleaning.content_digest(s.withColumn("_t", F.lit(1)), ["_t"], ["event_id", "side", "bar_index"]))


# -- a log of trade actions: eight bars make a trade, each bar leaves one action on it

ACTIONS = list(actionlog.MOVES)
# where each action leads from states 0, 1 and 2
LEADS = [''.join("-" if t is None else str(actionlog.STATES.index(t)) for t in to) for to in actionlog.MOVES.values()]
STEP_SQL = f"substr([{', '.join(repr(x) for x in LEADS)}][x.a + 1], s.st + 1, 1)"


@query(
    "folded_trade_actions",
    """SELECT trade_id, ['NONE', 'OPEN', 'CLOSED'][r.st + 1] AS status, CASE WHEN r.en >= 0 THEN 'e' || r.en END AS entry_event_id, CASE WHEN r.ex >= 0 THEN 'e' || r.ex END AS exit_event_id, r.ok AS applied, r.bad AS refused FROM folded""",
    f"""{BARS_SQL},
    acts AS (SELECT symbol || '-' || (bar_index // 8) AS trade_id, list({{'st': 0::BIGINT, 'en': -1::BIGINT, 'ex': -1::BIGINT, 'ok': 0::BIGINT, 'bad': 0::BIGINT, 'a': ((bar_index * 7 + bar_index // 3) % 8)::BIGINT, 'b': bar_index::BIGINT}} ORDER BY bar_index) AS xs FROM bars GROUP BY 1),
    folded AS (SELECT trade_id, list_reduce(list_prepend({{'st': 0::BIGINT, 'en': -1::BIGINT, 'ex': -1::BIGINT, 'ok': 0::BIGINT, 'bad': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}}, xs), lambda s, x: {{
      'st': CASE WHEN {STEP_SQL} = '-' THEN s.st ELSE cast(nullif({STEP_SQL}, '-') AS BIGINT) END,
      'en': CASE WHEN {STEP_SQL} = '-' THEN s.en WHEN {STEP_SQL} = '0' THEN -1 WHEN {STEP_SQL} = '1' AND s.st = 0 THEN x.b ELSE s.en END,
      'ex': CASE WHEN {STEP_SQL} = '-' THEN s.ex WHEN {STEP_SQL} = '2' THEN x.b ELSE -1 END,
      'ok': s.ok + CASE WHEN {STEP_SQL} = '-' THEN 0 ELSE 1 END, 'bad': s.bad + CASE WHEN {STEP_SQL} = '-' THEN 1 ELSE 0 END, 'a': x.a, 'b': x.b}}) AS r FROM acts)""",
)
def _(spark, sf):
    i = F.col("bar_index")
    made = bars(spark, sf).select(
        F.concat_ws("-", "symbol", F.floor(i / 8).cast("string")).alias("trade_id"), F.col("open_time_ms").alias("changed_at"), i.alias("change_no"),
        F.get(F.array(*map(F.lit, ACTIONS)), ((i * 7 + F.floor(i / 3)) % 8).cast("int")).alias("operation"), F.concat(F.lit("e"), i.cast("string")).alias("event_id"),
    )
    return actionlog.folded_trades(made)
