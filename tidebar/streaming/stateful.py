"""Stateful streams: rows in event-time order, candidate detection and annotation versions.

Arrival order means nothing: a key's rows wait in its state until the watermark has passed their
time, then a timer releases them in order. Rows that come after the watermark has passed them are not
dropped but leave as ``late`` rows, so a job can count or store them. State per key is the rows that wait,
bounded by the watermark's delay, and what the job carries on: twenty bars, or one version.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.feed import annotation_key, latest_by_key
from ..operators.universe import TRADE_ACTIONS, observation_rows

BACK = 20
# keys of annotations that share a state; fixed for a checkpoint
BUCKETS = 2_048
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """States of many keys live in the embedded store, with its changes in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class InOrder(StatefulProcessor):
    """Releases a key's rows by (time, order) once the watermark has passed them.

    ``waiting`` is (column, type) pairs, of which the first two are the time in milliseconds and the order
    among rows of one time; ``released`` and ``late`` make output rows.
    """

    waiting: tuple[tuple[str, str], ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", ", ".join(f"{c} {t}" for c, t in self.waiting))
        self.timer = handle.getValueState("timer", "at long")

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.waiting]

    def _plain(self, rows: pd.DataFrame) -> list[tuple]:
        """Rows as the state's types; a column of whole numbers with gaps arrives as floats."""
        whole = [t in ("int", "long") for _, t in self.waiting]
        return [tuple(None if pd.isna(v) else int(v) if w else getattr(v, "item", lambda v=v: v)() for v, w in zip(r, whole, strict=True)) for r in rows[self.names].itertuples(index=False)]

    def _wake(self, at: int) -> None:
        """One timer a key, for its earliest row; a time counts as passed when the watermark reaches it."""
        if self.timer.exists():
            old = int(self.timer.get()[0])
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        earliest = None
        for pdf in rows:
            time = pdf[self.names[0]].to_numpy()
            late = pdf[time <= passed]
            if len(late):
                yield self.late(key, late[self.names])
            held = pdf[time > passed]
            if len(held):
                self.rows.appendList(self._plain(held))
                earliest = min(int(held[self.names[0]].min()), earliest if earliest is not None else 1 << 62)
        if earliest is not None:
            self._wake(max(earliest - 1, 0))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = pd.DataFrame(list(self.rows.get()), columns=self.names)
        self.timer.clear()
        ready = rows[rows[self.names[0]] <= passed].sort_values(self.names[:2], kind="stable")
        rest = rows[rows[self.names[0]] > passed]
        if len(rest):
            self.rows.put(self._plain(rest))
            self._wake(max(int(rest[self.names[0]].min()) - 1, 0))
        else:
            self.rows.clear()
        if len(ready):
            yield self.released(key, ready)

    def released(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, keys: list[str], time_col: str, late: str, processor: InOrder, schema: str) -> DataFrame:
    """``rows`` through ``processor`` per key. The time column itself stays out, else the engine would drop late rows unseen."""
    timed = rows.withWatermark(time_col, late).select(*keys, *processor.names)
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


class DeepV(InOrder):
    """Deep-V candidates from the last ``BACK`` bars of a series, its bar index counted on."""

    waiting = (("open_time_ms", "long"), ("ingest_seq", "long"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "double"))
    out = "symbol string, interval string, open_time_ms long, ingest_seq long, bar_index long, is_candidate int, kind string"

    def __init__(self, pre_ret: float = 0.0, volume_z: float = 1.0, volume_ratio: float = 1.5, lower_wick: float = 0.45, reclaim: int = 20) -> None:
        if reclaim > BACK:
            raise ValueError(f"reclaim looks back {BACK} bars at most")
        self.limits = (pre_ret, volume_z, volume_ratio, lower_wick, reclaim)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "seen long, closes array<double>, lows array<double>, volumes array<double>")

    def released(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # of versions of one bar the last counts
        rows = rows.drop_duplicates("open_time_ms", keep="last")
        seen, *past = self.ring.get() if self.ring.exists() else (0, [], [], [])
        close, low, volume = (np.concatenate([np.array(p, float), rows[c].to_numpy(float)]) for p, c in zip(past, ("close", "low", "volume"), strict=True))
        known = len(past[0])
        flags = [self._flag(r, i + known, close, low, volume) for i, r in enumerate(rows.itertuples(index=False))]
        self.ring.update((int(seen) + len(rows), close[-BACK:].tolist(), low[-BACK:].tolist(), volume[-BACK:].tolist()))
        index = np.arange(int(seen), int(seen) + len(rows))
        out = pd.DataFrame({"symbol": key[0], "interval": key[1], "open_time_ms": rows["open_time_ms"].to_numpy(), "ingest_seq": rows["ingest_seq"].to_numpy(), "bar_index": index, "is_candidate": np.array(flags, np.int32), "kind": "bar"})
        return out[out["bar_index"] >= BACK]

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": key[0], "interval": key[1], "open_time_ms": rows["open_time_ms"].to_numpy(), "ingest_seq": rows["ingest_seq"].to_numpy(), "bar_index": pd.array([None] * len(rows), "Int64"), "is_candidate": np.zeros(len(rows), np.int32), "kind": "late"})

    def _flag(self, bar, at: int, close: np.ndarray, low: np.ndarray, volume: np.ndarray) -> int:
        """The conditions of ``universe.deep_v_flags`` on the bars before ``at``; missing values meet none."""
        pre_ret, z_min, ratio_min, wick_min, reclaim = self.limits
        if at < BACK:
            return 0
        first, prev = close[at - 10], close[at - 1]
        span = bar.high - bar.low
        v = volume[at - BACK : at]
        v = v[~np.isnan(v)]
        mean, spread = (v.mean(), v.std()) if len(v) else (np.nan, np.nan)
        z = (bar.volume - mean) / spread if spread > 0 else 0.0
        ratio = bar.volume / mean if mean > 0 else 0.0
        before = low[at - reclaim : at]
        before = before[~np.isnan(before)]
        floor = before.min() if len(before) else np.nan
        wick = max(min(bar.open, bar.close) - bar.low, 0.0)
        fell = first != 0 and prev / first - 1.0 < pre_ret
        shaped = span > 0 and (wick / span >= wick_min or (bar.low < floor and bar.close > floor))
        return int(bool(fell and (z >= z_min or ratio >= ratio_min) and shaped))


def candidate_stream(bars: DataFrame, late: str, **limits: float) -> DataFrame:
    """Every bar with enough history and its candidate flag, and late bars, as ``kind`` tells.

    Bars: symbol, interval, open_time_ms, ingest_seq and prices, in any order and any number of
    versions. A bar is judged once, when the watermark has reached it; a version that comes
    afterwards is late.
    """
    timed = bars.withColumn("event_time", F.timestamp_millis("open_time_ms"))
    return _stateful(timed, ["symbol", "interval"], "event_time", late, DeepV(**limits), DeepV.out)


def stream_universe(candidates: DataFrame, actions: DataFrame, profile: str = "LONG_DEEP_V_REVERSAL") -> DataFrame:
    """Observation rows of judged bars; ``actions`` is a table of (symbol, interval, bar_index, session_id, user_action)."""
    judged = candidates.where("kind = 'bar'").join(actions, ["symbol", "interval", "bar_index"], "left")
    action = F.coalesce(F.upper("user_action"), F.lit("NO_ACTION"))
    kind = F.when(action.isin(*TRADE_ACTIONS), "USER_TRADE").when(F.col("is_candidate") == 1, "AUTO_CANDIDATE").otherwise("SCHEDULED_BAR")
    return observation_rows(judged.withColumns({"user_action": action, "source_type": kind, "session_id": F.coalesce("session_id", F.lit("scan"))}), profile)


class Versions(InOrder):
    """Versions of annotations: the current ones are state, every change leaves with what it replaced.

    Keys share a state by hash, so that calls of the state grow with these buckets and not with the keys; a batch
    rewrites the current versions of the buckets it meets. A delete keeps the counts, so that a later change goes on with them, until ``forget`` milliseconds
    of event time have passed; then the key starts anew. Without ``forget`` nothing expires.
    """

    waiting = (("changed_at", "long"), ("change_no", "long"), ("operation", "string"), ("human_decision", "string"), ("confidence", "int"), ("note", "string"), ("annotation_key", "string"))
    out = "annotation_key string, changed_at long, change_no long, operation string, revision_no long, annotation_version long, created_at long, human_decision string, confidence int, note string, previous_payload string, new_payload string, kind string"

    def __init__(self, forget: int | None = None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.heads = handle.getListState("heads", "annotation_key string, revisions long, versions long, created_at long, payload string, deleted_at long")

    def _known(self) -> dict[str, tuple]:
        return {k: tuple(head) for k, *head in self.heads.get()}

    def _keep(self, heads: dict[str, tuple]) -> None:
        if heads:
            self.heads.put([(k, *head) for k, head in heads.items()])
        else:
            self.heads.clear()

    def released(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        heads, out = self._known(), []
        for r in rows.itertuples(index=False):
            revisions, versions, created, payload, deleted = heads.get(r.annotation_key, (0, 0, None, None, None))
            if deleted is not None and self.forget is not None and r.changed_at - deleted > self.forget:
                revisions, versions, created, payload = 0, 0, None, None
            gone = r.operation == "DELETE"
            now = json.dumps({k: v for k, v in (("human_decision", r.human_decision), ("confidence", None if pd.isna(r.confidence) else int(r.confidence)), ("note", r.note)) if not (v is None or pd.isna(v))}, separators=(",", ":"), ensure_ascii=False)
            revisions, versions = int(revisions) + 1, int(versions) + (not gone)
            created = int(r.changed_at) if created is None else int(created)
            out.append((r.annotation_key, int(r.changed_at), int(r.change_no), r.operation, revisions, versions, created, r.human_decision, r.confidence, r.note, payload, None if gone else now, "change"))
            heads[r.annotation_key] = (revisions, versions, created, now, int(r.changed_at) if gone else None)
        self._keep(heads)
        return self._frame(out)

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return self._frame([(r.annotation_key, int(r.changed_at), int(r.change_no), r.operation, None, None, None, r.human_decision, r.confidence, r.note, None, None, "late") for r in rows.itertuples(index=False)])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.out.split(", ")]
        frame = pd.DataFrame(rows, columns=names)
        whole = {c: "Int64" for c in ("revision_no", "annotation_version", "created_at")} | {"confidence": "Int32"}
        return frame.astype(whole)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.forget is None:
            return
        heads, passed = self._known(), timerValues.getCurrentWatermarkInMs()
        left = {k: head for k, head in heads.items() if head[4] is None or passed <= int(head[4]) + self.forget}
        if len(left) < len(heads):
            self._keep(left)
        deleted = [int(head[4]) for head in left.values() if head[4] is not None]
        if deleted and not self.timer.exists():  # nothing waits: the timer that is left lets deleted versions expire
            self._wake(min(deleted) + self.forget + 1)


def annotation_stream(log: DataFrame, late: str, forget: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Every change of an annotation with its revision number, version and payloads, and late changes, as ``kind`` tells."""
    timed = log.withColumns({"annotation_key": annotation_key(), "event_time": F.timestamp_millis("changed_at")})
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("annotation_key"), F.lit(buckets)))
    return _stateful(timed, ["bucket"], "event_time", late, Versions(forget), Versions.out)


def stream_revisions(changes: DataFrame) -> DataFrame:
    """The stored changes of ``annotation_stream`` in the layout of ``feed.revision_history``."""
    done = changes.where("kind = 'change'")
    return done.select("annotation_key", "operation", "changed_at", "revision_no", "previous_payload", "new_payload")


def stream_current(changes: DataFrame) -> DataFrame:
    """The stored changes of ``annotation_stream`` in the layout of ``feed.current_annotations``; deletes hide a key."""
    last = latest_by_key(changes.where("kind = 'change'"), ["annotation_key"], F.struct("changed_at", "change_no"))
    return last.where("operation <> 'DELETE'").select("annotation_key", "human_decision", "confidence", "note", "annotation_version", "created_at", F.col("changed_at").alias("updated_at"))


def replayed(rows: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A finished table sent through a stream: written as the stream's source, read by ``build`` until all is read, and its output read back."""
    spark = rows.sparkSession
    rows.write.parquet(f"{folder}/in")
    stream = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    query = appended(stream, f"{folder}/out", f"{folder}/state").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that adds each batch's rows to a table of files, exactly once, and stops when the source is read."""
    use_state_store(stream.sparkSession)
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
