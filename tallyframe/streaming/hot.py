"""Hot windows of many groups as a stateful processor: arrivals are counted in tables, tables freeze and leave.

The state of a group is its number of arrivals, a map of counts by (window, key, label) of at most keep + 1 windows, and
a list of the points held, of at most two hot windows; it doesn't grow with the stream. A group's rows of one
micro-batch are numbered in order, so a batch takes 17 bytes a row there: bound it by the source's rate options.
One sequence of arrivals over all rows is ``counts.hot_window_stream``, which runs in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The one state store that keeps maps and lists.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"

#: kind "view": the sum of the frozen tables by key and label; "point": a point held, cnt is 1.
SHAPE = "group string, arrivals long, kind string, ordinal long, key string, label double, cnt double"


class HotWindows(StatefulProcessor):
    """After each batch: a group's merged view of its last ``keep`` frozen tables, and the points that it holds.

    A table is frozen after count_table_size arrivals. Points are queued until the arrivals reach a multiple of
    hot_window_size, when the queue is trimmed to the last hot_window_size. A group without rows for idle_ms (None:
    never) is dropped by a timer.
    """

    def __init__(self, order: str, count_table_size: int, keep: int, hot_window_size: int, idle_ms: int | None = None):
        if min(count_table_size, keep, hot_window_size) <= 0:
            raise ValueError("sizes must be positive")
        self.order, self.size, self.keep, self.hot, self.idle_ms = order, count_table_size, keep, hot_window_size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrivals = handle.getValueState("arrivals", "n long")
        self.tables = handle.getMapState("tables", "window long, key string, label double", "cnt double")
        self.points = handle.getListState("points", "ordinal long, key string, label double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.arrivals.get()[0] if self.arrivals.exists() else 0
        batch = pd.concat([pd.DataFrame({"o": f[self.order], "key": f["key"].astype("category"), "label": f["label"]}) for f in rows], ignore_index=True)
        batch["key"] = batch["key"].astype("category")
        batch = batch.iloc[np.lexsort((batch["label"], batch["key"].cat.codes, batch["o"]))].reset_index(drop=True)
        batch["ordinal"] = n + batch.index
        self._count(batch)
        n += len(batch)
        self._hold(batch, n)
        self.arrivals.update((n,))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._state(key[0], n)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.arrivals, self.tables, self.points):
            state.clear()
        return iter(())

    def _count(self, batch: pd.DataFrame) -> None:
        """Adds the batch's counts by window, and drops the windows that have left the view."""
        last = (int(batch["ordinal"].iloc[-1]) + 1) // self.size
        window = batch["ordinal"] // self.size
        for (w, k, label), cnt in batch.groupby([window, "key", "label"], observed=True).size().items():
            if w >= last - self.keep:
                at = (int(w), str(k), float(label))
                held = self.tables.getValue(at)
                self.tables.updateValue(at, ((held[0] if held else 0.0) + float(cnt),))
        for at in [tuple(k) for k in self.tables.keys() if k[0] < last - self.keep]:
            self.tables.removeKey(at)

    def _hold(self, batch: pd.DataFrame, n: int) -> None:
        """Queues the batch's points and trims the queue."""
        first = n // self.hot * self.hot - self.hot
        new = batch[batch["ordinal"] >= first]
        new = [(int(o), str(k), float(label)) for o, k, label in zip(new["ordinal"], new["key"], new["label"], strict=True)]
        old = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        kept = [p for p in old if p[0] >= first]
        if len(kept) == len(old):
            self.points.appendList(new)
        else:
            self.points.put(kept + new)

    def _state(self, group: str, n: int) -> pd.DataFrame:
        view: dict[tuple[str, float], float] = {}
        for (w, k, label), (cnt,) in self.tables.iterator():
            if w < n // self.size:
                view[k, label] = view.get((k, label), 0.0) + cnt
        rows = [(group, n, "view", None, k, label, cnt) for (k, label), cnt in view.items()]
        rows += [(group, n, "point", o, k, label, 1.0) for o, k, label in (self.points.get() if self.points.exists() else ())]
        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SHAPE.split(", ")])
        return out.astype({"ordinal": "Int64", "arrivals": "int64"})


@contextmanager
def _state_store(spark: SparkSession):
    """The state store of queries that are started inside."""
    before = spark.conf.get(_STORE_KEY, None)
    spark.conf.set(_STORE_KEY, STORE)
    try:
        yield
    finally:
        spark.conf.unset(_STORE_KEY) if before is None else spark.conf.set(_STORE_KEY, before)


def hot_windows(stream: DataFrame, *, order: str, count_table_size: int, keep: int, hot_window_size: int, idle_ms: int | None = None) -> DataFrame:
    """A stream (group, ``order``, key, label) as SHAPE: after each batch the state of the groups that it has rows of.

    group, key and label aren't null. Rows of equal order are taken by key, then label.
    """
    processor = HotWindows(order, count_table_size, keep, hot_window_size, idle_ms)
    return stream.select("group", order, "key", "label").groupBy("group").transformWithStateInPandas(processor, SHAPE, "Update", "ProcessingTime" if idle_ms is not None else "None")


def run_hot_windows(states: DataFrame, path: str) -> None:
    """Runs hot_windows over all that is there now; each batch is a folder of its own, which a rerun replaces.

    Started again with the same path, it goes on from the state in its checkpoint.
    """

    def keep_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    with _state_store(states.sparkSession):
        query = states.writeStream.foreachBatch(keep_batch).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each group."""
    states = spark.read.schema(SHAPE).parquet(f"{path}/states").drop("batch")
    newest = states.groupBy("group").max("arrivals").toDF("group", "arrivals")
    return states.join(newest, ["group", "arrivals"], "left_semi")
