"""Stateful streams and upserts over whole tables, held against the twins of their batch operators."""

from pyspark.sql import functions as F

from ...operators.chunks import KEYS
from ...session import fresh
from ...sources.versioned import VersionedTable
from ...streaming import stateful
from ..derive import BARS_SQL, EVENTS_SQL, RAW_SQL, bars, raw_feed
from ..registry import query
from .feeds import LOG_SQL, log
from .labels import DEEP_SQL, actions
from .series import RET_SQL

# the tables are read as one batch, after which the watermark stands at the last row
NO_DELAY = "0 seconds"


@query("streamed_deep_v_universe", "SELECT * FROM observations", f"{RET_SQL}, {EVENTS_SQL}, {DEEP_SQL}", ints="is_user_trade is_candidate is_matched_control")
def _(spark, sf):
    sent = bars(spark, sf).select(*KEYS, "open_time_ms", F.lit(0).cast("long").alias("ingest_seq"), "open", "high", "low", "close", "volume")
    judged = stateful.replayed(sent, fresh(spark, "candidates"), lambda s: stateful.candidate_stream(s, NO_DELAY))
    return stateful.stream_universe(judged, actions(spark, sf))


def _changes(spark, sf):
    return stateful.replayed(log(spark, sf), fresh(spark, "annotations"), lambda s: stateful.annotation_stream(s, NO_DELAY))


@query(
    "streamed_current_annotations",
    """SELECT observation_id AS annotation_key, human_decision, confidence, note, v AS annotation_version, a AS created_at, b AS updated_at FROM (
      SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY changed_at DESC, change_no DESC) AS rn, count(*) FILTER (operation <> 'DELETE') OVER (PARTITION BY observation_id) AS v, min(changed_at) OVER (PARTITION BY observation_id) AS a,
        max(changed_at) OVER (PARTITION BY observation_id) AS b FROM log) WHERE rn = 1 AND operation <> 'DELETE'""",
    LOG_SQL,
    ints="confidence",
)
def _(spark, sf):
    return stateful.stream_current(_changes(spark, sf))


@query(
    "streamed_annotation_revisions",
    """SELECT observation_id AS annotation_key, operation, changed_at, row_number() OVER w AS revision_no, lag(human_decision) OVER w AS previous_decision, CASE WHEN operation <> 'DELETE' THEN human_decision END AS new_decision
    FROM log WINDOW w AS (PARTITION BY observation_id ORDER BY changed_at, change_no)""",
    LOG_SQL,
    ints="revision_no",
)
def _(spark, sf):
    return stateful.stream_revisions(_changes(spark, sf)).select(
        "annotation_key", "operation", "changed_at", "revision_no", F.get_json_object("previous_payload", "$.human_decision").alias("previous_decision"),
        F.get_json_object("new_payload", "$.human_decision").alias("new_decision"),
    )


MONTH = 30 * 86_400_000


@query(
    "upserted_feed",
    "SELECT symbol, \"interval\", open_time_ms, ingest_seq, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, \"interval\", open_time_ms ORDER BY ingest_seq DESC) AS rn FROM raw) WHERE rn = 1",
    f"{BARS_SQL}, {RAW_SQL}",
    "volume",
)
def _(spark, sf):
    raw = raw_feed(spark, sf).select(*KEYS, F.col("open_time_ms").cast("long").alias("open_time_ms"), "ingest_seq", F.col("volume").cast("double").alias("volume"))
    table = VersionedTable(spark, fresh(spark, "feed"), (*KEYS, "open_time_ms"), "ingest_seq", F.floor(F.col("open_time_ms") / MONTH))
    # later batches bring new bars and other versions of bars that are stored
    for number, rest in enumerate((2, 0, 1)):
        table.upsert(raw.where(F.col("ingest_seq") % 3 == rest), number)
    return table.read()
