"""The speed gate and velocity on streams: keyed state a track, with counts of what was accepted and rejected.

A track's state is a list of its last accepted samples and a value with its two counts; a timer of processing time closes a track that
has been idle, with a last word on its counts, and removes its state. State of this kind lies in RocksDB, which `keyed_state` sets for
the session where nothing else is set. Rows of one micro-batch are put in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from groundflow.operators.tracks import gate

SAMPLE, COUNTS = "t double, x double, y double", "accepted long, rejected long"
OBSERVED = "accepted boolean, v_x double, v_y double, window_full boolean, n_accepted long, n_rejected long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keyed_state(spark: SparkSession) -> None:
    """State of several kinds a key needs the RocksDB store; the file store that Spark takes by itself can't hold it."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def slopes(t: np.ndarray, v: np.ndarray, window: int) -> np.ndarray:
    """Least-squares slope of v over t in every row's last `window` rows; 0 where there is none."""
    if not len(t):
        return np.zeros(0)
    wide = lambda a: np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(window - 1, np.nan), a)), window)
    a, b = wide(t), wide(v)
    both = ~(np.isnan(a) | np.isnan(b))
    n = np.maximum(both.sum(axis=1, keepdims=True), 1)
    a = np.where(both, a, 0.0)
    a = np.where(both, a - a.sum(axis=1, keepdims=True) / n, 0.0)
    size = (a * a).sum(axis=1)
    return np.divide((a * np.where(both, b, 0.0)).sum(axis=1), size, out=np.zeros(len(t)), where=size > 0)


class Gate(StatefulProcessor):
    """Either every observation with its verdict and velocity, or (counts_only) a track's counts after each micro-batch."""

    def __init__(self, keys: list[str], carried: list[str], max_speed: float, window: int, idle_ms: int | None, counts_only: bool):
        self.keys, self.carried, self.max_speed, self.window, self.idle_ms, self.counts_only = keys, carried, max_speed, window, idle_ms, counts_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.counts = handle.getListState("held", SAMPLE), handle.getValueState("counts", COUNTS)

    def _told(self, key: tuple, accepted: int, rejected: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, accepted, rejected, closed)], columns=[*self.keys, "accepted", "rejected", "closed"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values(["t_sec", "x", "y", *self.carried], na_position="first", kind="stable")
        counted = self.counts.get()  # every look at the state is a message, so a new track takes one
        before = np.array([tuple(s) for s in self.held.get()] if counted else [], float).reshape(-1, 3)
        n_accepted, n_rejected = counted or (0, 0)
        own = found[["t_sec", "x", "y"]].to_numpy(float)
        last = before[-1:]
        ok = gate(*np.concatenate((last, own)).T, self.max_speed)[len(last) :]
        upto = np.cumsum(ok)
        kept = np.concatenate((before, own[ok]))
        self.counts.update((int(n_accepted + upto[-1]), int(n_rejected + len(ok) - upto[-1])))
        if ok.any():
            self.held.put([tuple(map(float, s)) for s in kept[-self.window :]])
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if self.counts_only:
            yield self._told(key, int(n_accepted + upto[-1]), int(n_rejected + len(ok) - upto[-1]), False)
            return
        out = pd.DataFrame({k: v for k, v in zip(self.keys, [[x] * len(ok) for x in key], strict=True)})
        for c in ("t_sec", "x", "y", *self.carried):
            out[c] = found[c].to_numpy()
        out["accepted"] = ok
        for name, c in (("v_x", 1), ("v_y", 2)):
            speed = np.full(len(ok), np.nan)
            speed[ok] = slopes(kept[:, 0], kept[:, c], self.window)[len(before) :]
            out[name] = pd.Series(speed).astype(object).where(ok, None)
        out["window_full"] = ok & (len(before) + upto >= self.window)
        out["n_accepted"], out["n_rejected"] = n_accepted + upto, n_rejected + np.arange(1, len(ok) + 1) - upto
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = self.counts.get() if self.counts.exists() else (0, 0)
        self.held.clear()
        self.counts.clear()
        if self.counts_only:
            yield self._told(key, *counts, True)

    def close(self) -> None:
        pass


def _gated(observations: DataFrame, schema: StructType, carried: list[str], max_speed: float, window_frames: int, idle: str | None, streams: list[str] | None, counts_only: bool, event_time: str = "") -> DataFrame:
    if window_frames < 2:
        raise ValueError("a window has at least 2 samples")
    if idle and event_time:
        raise ValueError("idle tracks are closed by processing time, and rows with event time have no timers of that kind")
    keyed_state(observations.sparkSession)
    keys = [*(streams or []), "track_id"]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    rows = observations.select(*keys, "t_sec", "x", "y", *carried).groupBy(*keys)
    processor = Gate(keys, carried, max_speed, window_frames, idle_ms, counts_only)
    mode = "EventTime" if event_time else "ProcessingTime" if idle else "None"
    return rows.transformWithStateInPandas(processor, schema, "Update" if counts_only else "Append", mode, eventTimeColumnName=event_time)


def observed(observations: DataFrame, max_speed: float, window_frames: int, idle: str | None = "10 minutes", streams: list[str] | None = None, carried: list[str] | None = None, event_time: str = "") -> DataFrame:
    """Every observation (streams, track_id, t_sec, x, y, and the carried columns) with accepted, velocity (null where rejected),
    window_full, and n_accepted and n_rejected, its track's counts so far.

    State goes after `idle` of processing time without rows; None keeps it, which a query that is to end by itself needs. With an
    event-time column among the carried ones, stateful operators may follow."""
    carried = carried or []
    plain = observations.select(*(streams or []), "track_id", "t_sec", "x", "y", *carried).schema
    return _gated(observations, StructType([*plain, *StructType.fromDDL(OBSERVED)]), carried, max_speed, window_frames, idle, streams, False, event_time)


def gated_velocity(observations: DataFrame, max_speed: float, window_frames: int, idle: str | None = "10 minutes", streams: list[str] | None = None) -> DataFrame:
    """Accepted observations with their velocity, for each track of each stream."""
    found = observed(observations, max_speed, window_frames, idle, streams)
    return found.where("accepted").drop("accepted", "n_accepted", "n_rejected")


def gate_counts(observations: DataFrame, max_speed: float, idle: str | None = "10 minutes", streams: list[str] | None = None) -> DataFrame:
    """accepted and rejected of every track that a micro-batch touches (output mode update), and once more with `closed` when it has
    been idle. The last row of a track equals what tracks.rejections counts in batch."""
    keys = observations.select(*(streams or []), "track_id").schema
    schema = StructType([*keys, *StructType.fromDDL("accepted long, rejected long, closed boolean")])
    return _gated(observations, schema, [], max_speed, 2, idle, streams, True)
