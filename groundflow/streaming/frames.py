"""Streams of frames, one row a frame: rolling density, tracking, and the trajectory sink.

A frame comes whole, empty or not, so nothing has to be waited for. Frames of one micro-batch are put in order of time; a
frame that is not later than those before it in its stream is passed over. State goes after `idle` of processing time; with
None it stays, and a query that is to end by itself (trigger availableNow) needs that.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundflow import schema
from groundflow.operators.density import Grid
from groundflow.operators.tracking import Params, Tracker

GRID_OUT = "stream_id string, frame_idx long, t_sec double, col int, row int, value double"
TRACK_OUT = "stream_id string, frame_idx long, x1 double, y1 double, x2 double, y2 double, conf double, track_id long"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _keyed(frames: DataFrame, out: str, state: str, step: Callable, idle: str | None) -> DataFrame:
    """step(key, ordered frames, state or None) -> (rows, new state); a stream's state goes when it is idle."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows, new = step(key[0], pd.concat(list(batches)).sort_values("frame_idx"), held.get if held.exists else None)
        held.update(new)
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=_names(out))

    return frames.groupBy("stream_id").applyInPandasWithState(update, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def rolling_density(frames: DataFrame, grid: Grid, seconds: float, idle: str | None = "10 minutes") -> DataFrame:
    """Mean persons a cell over the last seconds, for every frame and every cell that is not empty.

    frames: stream_id, frame_idx, t_sec, points (x, y), and if wanted reset. A row whose reset is true is no frame but an order: the
    window of its stream is emptied before the frame of the same number, as density.rolling does between cuts (density.cut_at). Like
    a frame it is passed over if it comes later than a frame that it should stand before. State is the counts of the frames in the window."""

    # only the number of each point's cell goes on: a frame may have very many points
    along = lambda p, c, start: (p[c] - F.lit(float(start))) / F.lit(float(grid.cell))
    place = lambda p: F.floor(along(p, "y", grid.y0)).cast("int") * F.lit(grid.n_cols) + F.floor(along(p, "x", grid.x0)).cast("int")
    on_grid = lambda p: (along(p, "x", grid.x0) >= 0) & (along(p, "x", grid.x0) < grid.n_cols) & (along(p, "y", grid.y0) >= 0) & (along(p, "y", grid.y0) < grid.n_rows)
    cells = F.transform(F.filter("points", on_grid), place).alias("cells")

    def step(stream: str, rows: pd.DataFrame, held: tuple | None) -> tuple:
        times, sizes, places, last = (list(held[0]), list(held[1]), list(held[2]), held[3]) if held else ([], [], [], -1)
        total, out = np.bincount(places, minlength=grid.n_cols * grid.n_rows), []
        orders = rows["reset"].fillna(False).astype(bool)
        for frame in rows[["frame_idx", "t_sec", "cells"]].assign(order=orders).sort_values(["frame_idx", "order"], ascending=[True, False]).itertuples():
            if frame.frame_idx <= last:
                continue
            if frame.order:
                total[:], times, sizes, places = 0, [], [], []
                continue
            last, own = frame.frame_idx, [] if frame.cells is None else frame.cells.tolist()
            times.append(float(frame.t_sec))
            sizes.append(len(own))
            places += own
            np.add.at(total, own, 1)
            gone = next(k for k, t in enumerate(times) if t >= frame.t_sec - seconds)
            n = sum(sizes[:gone])
            np.subtract.at(total, places[:n], 1)
            del times[:gone], sizes[:gone], places[:n]
            out += [(stream, frame.frame_idx, frame.t_sec, k % grid.n_cols, k // grid.n_cols, total[k] / len(times)) for k in np.flatnonzero(total).tolist()]
        return out, (times, sizes, places, int(last))

    reset = F.col("reset") if "reset" in frames.columns else F.lit(False)
    return _keyed(frames.select("stream_id", "frame_idx", "t_sec", cells, reset.alias("reset")), GRID_OUT, "times array<double>, sizes array<int>, places array<int>, last long", step, idle)


def track(frames: DataFrame, params: Params = Params(), idle: str | None = "10 minutes") -> DataFrame:
    """Boxes with track_id, as the batch form gives them up to the ids' numbers.

    frames: stream_id, frame_idx, boxes (x1, y1, x2, y2, conf). State is the stream's live tracks."""

    def step(stream: str, rows: pd.DataFrame, held: tuple | None) -> tuple:
        tracker, out = pickle.loads(held[0]) if held else Tracker(params), []
        for frame in rows.itertuples():
            if tracker.frame is not None and frame.frame_idx <= tracker.frame:
                continue
            boxes = sorted((tuple(b[c] for c in ("x1", "y1", "x2", "y2", "conf")) for b in frame.boxes if b["conf"] is not None), key=lambda b: (-b[4], b)) if frame.boxes is not None else []
            sure = np.array([b for b in boxes if b[4] >= params.high_conf], float).reshape(-1, 5)
            ids = tracker.update(frame.frame_idx, sure[:, :4], sure[:, 4]).tolist() if len(sure) else []
            out += [(stream, frame.frame_idx, *b, i) for b, i in zip(boxes, ids + [-1] * (len(boxes) - len(ids)), strict=True)]
        return out, (pickle.dumps(tracker),)

    return _keyed(frames.select("stream_id", "frame_idx", "boxes"), TRACK_OUT, "tracker binary", step, idle)


def lifetimes(observations: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """Running first and last time and number of observations a track (output mode update or complete)."""
    return observations.groupBy(*(streams or []), "track_id").agg(F.min("t_sec").alias("first_t"), F.max("t_sec").alias("last_t"), F.count("*").alias("n_observations"))


def write_trajectory(rows: DataFrame, path: str, checkpoint: str, form: str = "csv") -> StreamingQuery:
    """Append trajectory rows as files; the checkpoint makes a restart neither lose nor repeat rows."""
    sink = rows.select(schema.names(schema.TRAJECTORY)).writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)
    if form == "csv":
        sink = sink.option("header", True).option("nanValue", "nan")
    return sink.outputMode("append").trigger(availableNow=True).start()
