"""Running totals, identities seen so far and untracked boxes on streams, by event time.

A row's event time is a timestamp column; a stream's watermark trails the latest one by `delay`. A frame is told once the watermark has
passed it, so rows of it may come in any order until then; rows that come later than that are passed over. The last frames of a
stream that stops are told when a later row (of any kind) has moved the watermark past them. Operators may follow one another, as
each hands the event time on: the gate, counts a frame, and totals so far are three kinds of state in one query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from groundflow.operators.detections import same_box
from groundflow.streaming.gate import keyed_state

AT = "event_time"


def with_event_time(rows: DataFrame, delay: str) -> DataFrame:
    """rows with event_time from t_sec, and a watermark that trails it.

    Seconds count from a day after the epoch: at the epoch a watermark begins, and a row of second 0 would be late there."""
    return rows.withColumn(AT, F.timestamp_micros(((F.col("t_sec") + F.lit(86_400.0)) * F.lit(1e6)).cast("long"))).withWatermark(AT, delay)


class Running(StatefulProcessor):
    """Sums over a stream's frames. Upstream tells each frame once and in order of event time from batch to batch."""

    def __init__(self, keys: list[str], names: list[str]):
        self.keys, self.names = keys, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"s{k} long" for k in range(len(self.names))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values([AT, "frame_idx"], kind="stable").reset_index(drop=True)
        before = self.sums.get() if self.sums.exists() else (0,) * len(self.names)
        for name, start in zip(self.names, before, strict=True):
            found[f"{name}_so_far"] = found[name].cumsum() + start
        self.sums.update(tuple(int(found[f"{n}_so_far"].iloc[-1]) for n in self.names))
        yield found[[*self.keys, "frame_idx", AT, *self.names, *(f"{n}_so_far" for n in self.names)]]

    def close(self) -> None:
        pass


def totals_so_far(rows: DataFrame, counts: dict[str, Column], streams: list[str]) -> DataFrame:
    """For every frame that rows (streams, frame_idx, event_time, ...) tell of: the counts over its rows, and their totals so far in its
    stream. rows have a watermark; a frame has one event time. A frame that has to appear without rows needs one that no count counts."""
    keyed_state(rows.sparkSession)
    per = rows.groupBy(*streams, "frame_idx", AT).agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    schema = StructType([*per.schema, *[StructField(f"{n}_so_far", per.schema[n].dataType) for n in counts]])
    return per.groupBy(*streams).transformWithStateInPandas(Running(streams, list(counts)), schema, "Append", "EventTime", eventTimeColumnName=AT)


class FirstSight(StatefulProcessor):
    """A key's first row by event time, told once the watermark has passed it; what comes later tells nothing. A key that was told and
    not seen for `forget_ms` is forgotten."""

    def __init__(self, keys: list[str], forget_ms: int | None):
        self.keys, self.forget_ms = keys, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "frame_idx long, at long, told boolean, last long")

    def _forget_at(self, last: int) -> int:
        return _timer(last) + self.forget_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows))
        at = found[AT].astype("datetime64[us]").astype("int64").to_numpy()
        new, last = min(zip(at.tolist(), found["frame_idx"].tolist(), strict=True)), int(at.max())
        held = self.first.get()  # every look at the state is a message
        if held is None:
            self.first.update((new[1], new[0], False, last))
            self.handle.registerTimer(_timer(new[0]))
        elif held[2] and not self.forget_ms:
            pass
        else:
            frame, first, told, before = held
            if told and self.forget_ms and new[0] - before > self.forget_ms * 1000:  # away for too long, though its timer is still to come
                self.handle.deleteTimer(self._forget_at(before))
                self.handle.registerTimer(_timer(new[0]))
                frame, first, told = new[1], new[0], False
            elif told:
                if self.forget_ms and last > before:
                    self.handle.deleteTimer(self._forget_at(before))
                    self.handle.registerTimer(self._forget_at(last))
            elif new < (first, frame):
                self.handle.deleteTimer(_timer(first))
                self.handle.registerTimer(_timer(new[0]))
                first, frame = new
            self.first.update((frame, first, told, max(last, before)))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, at, told, last = self.first.get()
        if told:
            self.first.clear()
            return
        self.first.update((frame, at, True, last))
        if self.forget_ms:
            self.handle.registerTimer(self._forget_at(last))
        yield pd.DataFrame([(*key, frame, pd.Timestamp(at, unit="us"))], columns=[*self.keys, "frame_idx", AT])

    def close(self) -> None:
        pass


def _timer(micros: int) -> int:
    """Timers count milliseconds; one at or after the time, so that the watermark has passed it."""
    return -(-micros // 1000)


def first_sightings(observations: DataFrame, streams: list[str], forget: str | None = None) -> DataFrame:
    """The first frame of every track (streams, track_id, frame_idx, event_time). observations have a watermark.

    State is a small value a track, as long as the stream runs; with `forget` a track that was not seen for so long by event time leaves
    it, and counts anew if it comes back."""
    keyed_state(observations.sparkSession)
    keys = [*streams, "track_id"]
    rows = observations.select(*keys, "frame_idx", AT)
    processor = FirstSight(keys, int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, StructType(list(rows.schema)), "Append", "EventTime", eventTimeColumnName=AT)


def ids_so_far(observations: DataFrame, frames: DataFrame, streams: list[str], forget: str | None = None) -> DataFrame:
    """For each frame (streams, frame_idx, event_time): new_ids, tracks seen for the first time, and new_ids_so_far. Both inputs have a
    watermark."""
    seen = first_sightings(observations, streams, forget).select(*streams, "frame_idx", AT, F.lit(1).alias("new"))
    spine = frames.select(*streams, "frame_idx", AT, F.lit(0).alias("new"))
    return totals_so_far(spine.unionByName(seen), {"new_ids": F.sum("new")}, streams)


def unmatched(candidates: DataFrame, reference: DataFrame, streams: list[str]) -> DataFrame:
    """Candidates that have no box in the reference, told once the watermark has passed their frame; both have a watermark.

    A reference box that comes before that still takes its candidate out; one that comes later is passed over, and so is a late
    candidate."""
    a, b = candidates.alias("a"), reference.select(*streams, "frame_idx", AT, "x1", "y1", "x2", "y2").alias("b")
    same = same_box(streams=streams) & (F.col(f"a.{AT}") == F.col(f"b.{AT}"))
    return a.join(b, same, "left_outer").where(F.col("b.frame_idx").isNull()).select("a.*")
