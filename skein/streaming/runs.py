"""Runs that can be paused: streams that commit batch by batch, values kept across restarts, events of a run."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from skein.operators.datasets import KeyValueStore, foreach_batch, record


def start(stream: DataFrame, root: str, checkpoint: str, *, until_idle: bool = False, **parts: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Commits each batch of the stream as a transaction under root. A run that is stopped and started again with its
    checkpoint goes on where it was; a batch that was cut short is written anew under its number, so nothing counts
    twice. How many rows or files a batch holds is the source's option (maxFilesPerTrigger), which bounds what waits.
    until_idle: ends with what is there at its start."""
    out = stream.writeStream.foreachBatch(foreach_batch(root, **parts)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if until_idle else out).start()


def pause(query: StreamingQuery) -> None:
    """Stops fetching. The checkpoint holds what was committed."""
    query.stop()
    query.awaitTermination()


class RecoverableState:
    """A small value (anything JSON takes) that survives restarts, as a record of a key-value store at path.

    It is loaded on first use, changed in place and written by persist() if it has changed since; later records stand.
    maybe_persist() writes at most every so many seconds."""

    def __init__(self, spark: SparkSession, path: str, key: str, default: Any, every_s: float = 60) -> None:
        self.spark, self.path, self.key, self.every_s = spark, path, key, every_s
        self._default, self._written, self._at = json.dumps(default), None, 0.0
        self._value: Any = None

    def _records(self) -> DataFrame | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.parquet(self.path) if fs.exists(fs_path) else None

    @property
    def value(self) -> Any:
        if self._written is None:
            rows = self._records()
            found = KeyValueStore(rows).get(self.key).first() if rows is not None else None
            self._written = bytes(found["value"]).decode() if found else ""
            self._value = json.loads(self._written or self._default)
        return self._value

    @value.setter
    def value(self, new: Any) -> None:
        self.value  # noqa: B018  what is stored is loaded first, so that persist() can tell a change
        self._value = new

    def persist(self) -> bool:
        key, _, _ = record(self.key, None)
        text = json.dumps(self.value)
        if text == self._written:
            return False
        body = None if self.value is None else text.encode()
        rows = self.spark.createDataFrame([(time.time_ns(), key, body, "application/json; charset=utf-8")], "seq long, key string, value binary, content_type string")
        rows.coalesce(1).write.mode("append").parquet(self.path)
        self._written, self._at = text, time.monotonic()
        return True

    def maybe_persist(self) -> bool:
        return time.monotonic() - self._at >= self.every_s and self.persist()

    def reset(self) -> None:
        self.value = json.loads(self._default)


class Events(StreamingQueryListener):
    """Calls handlers on a run's events: started, persist_state and system_info (after each batch), idle, and at its end
    aborting (with an error) or exit. Add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[Any], None]]] = defaultdict(list)

    def on(self, event: str, handler: Callable[[Any], None]) -> None:
        self.handlers[event].append(handler)

    def emit(self, event: str, what: Any = None) -> None:
        for h in self.handlers[event]:
            h(what)

    def onQueryStarted(self, event: Any) -> None:
        self.emit("started", event)

    def onQueryProgress(self, event: Any) -> None:
        self.emit("system_info", event.progress)
        self.emit("persist_state", event.progress)

    def onQueryIdle(self, event: Any) -> None:
        self.emit("idle", event)

    def onQueryTerminated(self, event: Any) -> None:
        self.emit("aborting" if event.exception else "exit", event)
