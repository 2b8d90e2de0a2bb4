"""Trades as a log of actions leaves them: open, close, undo, redo, reopen and delete.

An action maps a trade's state to another, or is refused in it. A run of actions is such a map too,
so runs of any length are folded apart, once for each state they may begin in, and their maps are
then applied in order: rows to chunks, chunks to parts of the sort, parts to trades. A trade with a
very long log is spread over tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

CHUNK = 4096
STATES = ("NONE", "OPEN", "CLOSED")
# The state that an action leads to from NONE, OPEN and CLOSED; null where it is refused.
MOVES = {
    "OPEN": ("OPEN", None, None),
    "REDO_OPEN": ("OPEN", None, None),
    "UNDO_OPEN": (None, "NONE", "NONE"),
    "CLOSE": (None, "CLOSED", None),
    "REDO_CLOSE": (None, "CLOSED", None),
    "UNDO_CLOSE": (None, None, "OPEN"),
    "REOPEN": (None, "OPEN", "OPEN"),
    "DELETE": ("NONE", "NONE", "NONE"),
}


def _start(state: Column | str) -> Column:
    """A fold that has seen nothing: events not yet known are those of before."""
    none = F.lit(None).cast("string")
    at = F.lit(state) if isinstance(state, str) else state
    return F.struct(at.alias("state"), none.alias("entry"), none.alias("exit"), F.lit(True).alias("entry_kept"), F.lit(True).alias("exit_kept"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))


def _apply(acc: Column, row: Column) -> Column:
    """One action on a state. An open sets the entry event, a close the exit event; what ends a state forgets its event."""
    table = F.create_map(*[x for a, to in MOVES.items() for s, t in zip(STATES, to, strict=True) for x in (F.lit(f"{a}/{s}"), F.lit(t).cast("string"))])
    to = F.try_element_at(table, F.concat(row["action"], F.lit("/"), acc["state"]))
    ok, opens, closes = to.isNotNull(), row["action"].endswith("OPEN") & (acc["state"] == "NONE"), (to == "CLOSED") & (acc["state"] == "OPEN")
    gone, same = to == "NONE", acc["state"] == to
    entry = F.when(~ok, acc["entry"]).when(gone, None).when(opens, row["event"]).otherwise(acc["entry"])
    exit_ = F.when(~ok | same, acc["exit"]).when(closes, row["event"]).otherwise(None)
    exit_ = F.when(ok & gone, None).otherwise(exit_)
    return F.struct(
        F.coalesce(to, acc["state"]).alias("state"), entry.alias("entry"), exit_.alias("exit"), (acc["entry_kept"] & ~(ok & (gone | opens))).alias("entry_kept"),
        (acc["exit_kept"] & ~(ok & (gone | ~same))).alias("exit_kept"), (acc["applied"] + ok.cast("long")).alias("applied"), (acc["refused"] + (~ok).cast("long")).alias("refused"),
    )


def _then(acc: Column, run: Column) -> Column:
    """A run's map applied to a state."""
    made = F.element_at(run["to"], acc["state"])
    return F.struct(
        made["state"].alias("state"), F.when(made["entry_kept"], acc["entry"]).otherwise(made["entry"]).alias("entry"), F.when(made["exit_kept"], acc["exit"]).otherwise(made["exit"]).alias("exit"),
        (acc["entry_kept"] & made["entry_kept"]).alias("entry_kept"), (acc["exit_kept"] & made["exit_kept"]).alias("exit_kept"), (acc["applied"] + made["applied"]).alias("applied"), (acc["refused"] + made["refused"]).alias("refused"),
    )


def _from_each(items: str, step) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, STATES)), F.array(*[F.aggregate(items, _start(s), step) for s in STATES])).alias("to")


def folded_trades(log: DataFrame, key: str = "trade_id", order: Sequence[str] = ("changed_at", "change_no"), action: str = "operation", event: str = "event_id", size: int = CHUNK) -> DataFrame:
    """(key, status, entry_event_id, exit_event_id, applied, refused) of every trade in the log, those that are gone as NONE.

    Actions go by ``order``; unknown ones are refused. Rows without a key belong to no trade.
    """
    rows = log.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.upper(F.coalesce(action, F.lit(""))).alias("action"), F.col(event).cast("string").alias("event"))
    by = ["k", *[f"o{i}" for i in range(len(order))], "action", "event"]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("k", "action", "event", F.monotonically_increasing_id().alias("at")), "actions")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    starts = placed.groupBy("k", "part").agg(F.min("at").alias("first"))
    cut = placed.join(starts, ["k", "part"]).withColumn("chunk", F.floor((F.col("at") - F.col("first")) / size))
    chunks = cut.groupBy("k", "part", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "action", "event"))).alias("rows")).select("k", "part", "chunk", _from_each("rows", _apply))  # ``size`` rows
    parts = chunks.groupBy("k", "part").agg(F.collect_list(F.struct("chunk", "to")).alias("runs")).select("k", "part", _sorted("chunk")).select("k", "part", _from_each("runs", _then))
    trades = parts.groupBy("k").agg(F.collect_list(F.struct("part", "to")).alias("runs")).select("k", _sorted("part"))  # a run for each part of the sort
    done = trades.select("k", F.aggregate("runs", _start("NONE"), _then).alias("t"))
    return done.select(F.col("k").alias(key), F.col("t.state").alias("status"), F.col("t.entry").alias("entry_event_id"), F.col("t.exit").alias("exit_event_id"), "t.applied", "t.refused")


def _sorted(by: str) -> Column:
    """Runs by their number; maps have no order of their own."""
    return F.array_sort("runs", lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0)).alias("runs")
