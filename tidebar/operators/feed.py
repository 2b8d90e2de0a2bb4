"""Change feeds: current state, revision history and last-operation folding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last write per key by an aggregate, so a key with very many versions is folded map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def annotation_key() -> Column:
    """The observation, or its series and bar where no observation is named."""
    return F.coalesce("observation_id", F.concat_ws("|", "session_id", "symbol", "interval", F.col("bar_index").cast("string")))


def current_annotations(log: DataFrame) -> DataFrame:
    """Active annotation per key with its version, first creation time and last change; deletes hide it."""
    keyed = log.withColumn("annotation_key", annotation_key())
    order = F.struct("changed_at", "change_no")
    out = keyed.groupBy("annotation_key").agg(
        F.max_by(F.struct("operation", "human_decision", "confidence", "note"), order).alias("_r"),
        F.count_if(F.col("operation") != "DELETE").alias("annotation_version"), F.min("changed_at").alias("created_at"), F.max("changed_at").alias("updated_at"),
    )
    return out.where(F.col("_r.operation") != "DELETE").select(
        "annotation_key", "_r.human_decision", "_r.confidence", "_r.note", "annotation_version", "created_at", "updated_at"
    )


def revision_history(log: DataFrame) -> DataFrame:
    """Every change with its revision number and the payload before and after it."""
    keyed = log.withColumns({"annotation_key": annotation_key(), "payload": F.to_json(F.struct("human_decision", "confidence", "note"))})
    w = Window.partitionBy("annotation_key").orderBy("changed_at", "change_no")
    return keyed.select(
        "annotation_key", "operation", "changed_at", F.row_number().over(w).alias("revision_no"), F.lag("payload").over(w).alias("previous_payload"),
        F.when(F.col("operation") != "DELETE", F.col("payload")).alias("new_payload"),
    )


def decode_history(history: DataFrame) -> DataFrame:
    shape = "human_decision string, confidence int, note string"
    return history.withColumn("_n", F.from_json("new_payload", shape)).select("*", "_n.human_decision", "_n.confidence").drop("_n")


def latest_session(sessions: DataFrame) -> DataFrame:
    row = F.struct(*sessions.columns)
    return sessions.agg(F.max_by(row, F.struct(F.coalesce("saved_at", "opened_at"), "session_id")).alias("_s")).select("_s.*")


def weekly(notes: DataFrame, history: DataFrame, week_ms: int = 604_800_000) -> DataFrame:
    """Decision counts per week with the change against the week before, and modifications."""
    w = F.floor(F.col("changed_at") / week_ms)
    d = F.upper("human_decision")
    counts = notes.groupBy(w.alias("week")).agg(
        F.count(F.lit(1)).alias("annotation_count"), *[F.count_if(d == x).alias(f"{x.lower()}_count") for x in ("ENTRY", "REJECT", "UNCERTAIN")]
    )
    mods = history.where("operation <> 'CREATE'").groupBy(w.alias("week")).agg(F.count(F.lit(1)).alias("modification_count"))
    both = counts.join(mods, "week", "full_outer").fillna(0)
    order = Window.orderBy("week")
    return both.withColumns({f"{x}_delta": F.col(x) - F.lag(x).over(order) for x in ("annotation_count", "entry_count", "reject_count")})
