"""Event flows: debounced changes, own writes, histories, messages, incremental merge of a change feed.

Each is a function over rows that serves a batch and a stream; the stateful one has a twin of each kind.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from termweave.functions.expressions import sctid

DEPTH = 50


def debounce(changes: DataFrame, key: str = "path", quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Key, first_ts, last_ts, n of each run of changes that a quiet period ends.

    In a stream a run is emitted when the watermark has passed its end.
    """
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    runs = rows.groupBy(F.session_window("ts", quiet), F.col(key)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return runs.select(key, "first_ts", "last_ts", "n")


def foreign(changes: DataFrame, own: DataFrame, within_ms: int = 100) -> DataFrame:
    """Changes (path, mtime_ms, size) that are not our own writes: same path and size, times close."""
    o = own.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime_ms").alias("_m"))
    near = F.abs(F.col("mtime_ms") - F.col("_m")) < within_ms
    return changes.join(o, (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & near, "left_anti")


# ---------------------------------------------------------------- T04


def navigate(state: dict, action: str, value: str | None, depth: int = DEPTH) -> str | None:
    """One step of a navigation history; back and forward are lists, newest last.  Returns the place after it."""
    back, forward = state["back"], state["forward"]
    if action == "push" and value and (not back or back[-1] != value):
        back.append(value)
        del back[:-depth]
        forward.clear()
    elif action == "undo" and len(back) > 1:
        forward.append(back.pop())
    elif action == "redo" and forward:
        back.append(forward.pop())
    elif action == "clear":
        back.clear()
        forward.clear()
    return back[-1] if back else None


def edit(state: dict, action: str, value: str | None, depth: int = DEPTH) -> str | None:
    """One step of an edit history: undo and redo stacks beside the current value; equal values are pushed again."""
    undo, redo, now = state["back"], state["forward"], state.get("now")
    if action == "push":
        undo.append(now)
        del undo[:-depth]
        redo.clear()
        state["now"] = value
    elif action == "undo" and undo:
        redo.append(now)
        state["now"] = undo.pop()
    elif action == "redo" and redo:
        undo.append(now)
        state["now"] = redo.pop()
    elif action == "clear":
        undo.clear()
        redo.clear()
        state["now"] = value
    return state.get("now")


HISTORY = "key string, seq long, current string, n_back int, n_forward int"


def history(events: DataFrame, step: Callable = navigate, depth: int = DEPTH) -> DataFrame:
    """T04, batch: key, seq, current, n_back, n_forward after every event (key, ts, seq, action, value).

    Events are sorted by key, time and seq inside partitions and read in order, so a key of any length
    needs the memory of one state and one batch.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", "seq", "action", "value")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {"back": [], "forward": []}
        for pdf in batches:
            out = []
            for k, seq, action, value in zip(pdf["key"], pdf["seq"], pdf["action"], pdf["value"]):
                if k != key:
                    key, state = k, {"back": [], "forward": []}
                now = step(state, action, value, depth)
                out.append((k, seq, now, len(state["back"]), len(state["forward"])))
            yield pd.DataFrame(out, columns=["key", "seq", "current", "n_back", "n_forward"])

    return rows.repartition("key").sortWithinPartitions("key", "ts", "seq").mapInPandas(replay, HISTORY)


class Stack:
    """A list kept as positions in a state map: what a batch doesn't touch is neither read nor written."""

    def __init__(self, state, first: int, end: int):
        self.state, self.first, self.end = state, first, end
        self.own: dict[int, str | None] = {}
        self.gone: set[int] = set()

    def __len__(self) -> int:
        return self.end - self.first

    def __getitem__(self, i: int) -> str | None:
        at = self.end + i
        return self.own[at] if at in self.own else self.state.getValue((at,))[0]

    def append(self, value: str | None) -> None:
        self.own[self.end] = value
        self.end += 1

    def _drop(self, at: int) -> None:
        self.own.pop(at, None)
        self.gone.add(at)

    def pop(self) -> str | None:
        value = self[-1]
        self.end -= 1
        self._drop(self.end)
        return value

    def __delitem__(self, cut: slice) -> None:
        """del stack[:-n]: the oldest go until n are left."""
        while len(self) > -cut.stop:
            self._drop(self.first)
            self.first += 1

    def clear(self) -> None:
        while len(self):
            self.end -= 1
            self._drop(self.end)

    def save(self) -> None:
        for at in self.gone - self.own.keys():
            if self.state.containsKey((at,)):
                self.state.removeKey((at,))
        for at, value in self.own.items():
            self.state.updateValue((at,), (value,))


class Replay(StatefulProcessor):
    """The state of one key's history: two stacks, their bounds and the current value; it goes when idle for idle_ms."""

    def __init__(self, step: Callable, depth: int, idle_ms: int | None):
        self.step, self.depth, self.idle_ms = step, depth, idle_ms

    def init(self, handle) -> None:
        stack = lambda name: handle.getMapState(name, "at long", "value string", self.idle_ms)
        self.back, self.forward = stack("back"), stack("forward")
        self.bounds = handle.getValueState("bounds", "b0 long, b1 long, f0 long, f1 long, now string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b0, b1, f0, f1, now = self.bounds.get() if self.bounds.exists() else (0, 0, 0, 0, None)
        back, forward = Stack(self.back, b0, b1), Stack(self.forward, f0, f1)
        state = {"back": back, "forward": forward, "now": now}
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = []
        for seq, action, value in zip(batch["seq"], batch["action"], batch["value"]):
            current = self.step(state, action, value, self.depth)
            out.append((key[0], seq, current, len(back), len(forward)))
        back.save()
        forward.save()
        self.bounds.update((back.first, back.end, forward.first, forward.end, state["now"]))
        yield pd.DataFrame(out, columns=["key", "seq", "current", "n_back", "n_forward"])


def history_stream(events: DataFrame, step: Callable = navigate, depth: int = DEPTH, idle_ms: int | None = None) -> DataFrame:
    """T04, stream: as history(), the state kept for each key between batches; a batch's events in order of time.

    Each batch reads and writes only the places of the stacks that its events touch, and a key that is
    idle for idle_ms is forgotten.  The state is in RocksDB: start the query with on_rocksdb(), as drain() does.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", "seq", "action", "value")
    return rows.groupBy("key").transformWithStateInPandas(Replay(step, depth, idle_ms), HISTORY, "Append", "None" if idle_ms is None else "ProcessingTime")


@contextlib.contextmanager
def on_rocksdb(spark: SparkSession):
    """Streaming queries started inside keep their state in RocksDB; the session's setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def route(messages: DataFrame, base: str = "http://snomed.info/id/") -> DataFrame:
    """The columns of messages but json, target, value: focus messages as an IRI, node messages passed on; others go."""
    kept = [c for c in messages.columns if c != "json"]
    m = messages.withColumn("_m", F.from_json("json", "command string, payload struct<id:string,label:string>"))
    cmd, id_ = F.col("_m.command"), F.col("_m.payload.id")
    iri = F.when(id_.rlike(r"^\d+$"), F.concat(F.lit(base), id_)).otherwise(id_)
    target = F.when(cmd == "CONCEPT_FOCUS", "focus").when(cmd == "GRAPH_NODE_SELECT", "forward")
    out = m.select(*kept, target.alias("target"), F.when(cmd == "CONCEPT_FOCUS", iri).otherwise(id_).alias("value"))
    return out.where("target is not null and value is not null").withColumn("sctid", sctid(F.col("value")))


def merge_feed(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run apply(changes, batch id) on every batch of a change feed until what is there is used up."""
    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there into a Parquet table and read it."""
    with on_rocksdb(rows.sparkSession):
        q = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
