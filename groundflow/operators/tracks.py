"""Operators on track observations: speed gate, velocity, lifetimes, churn.

`streams` names the columns that tell cameras apart: a track's number counts within its stream only. Without it a table is
one camera's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundflow.functions.ranks import exact_percentiles


def gate(t: np.ndarray, x: np.ndarray, y: np.ndarray, max_speed: float) -> np.ndarray:
    """Which observations of one track, in order, are accepted. Missing numbers (nan) are never too fast, nor is what follows."""
    ok, n = np.ones(len(t), bool), len(t)
    with np.errstate(invalid="ignore", divide="ignore"):
        fast = lambda dt, dx, dy: (dt > 0) & (np.sqrt(dx * dx + dy * dy) / dt > max_speed)
        steps = np.flatnonzero(fast(t[1:] - t[:-1], x[1:] - x[:-1], y[1:] - y[:-1])) + 1
        k = 0
        while k < n:
            at = int(np.searchsorted(steps, k + 1))
            if at == len(steps):
                break  # from an accepted row on, steps between neighbours decide until one is too fast
            last = int(steps[at]) - 1
            k = last + 1
            while k < n and fast(t[k] - t[last], x[k] - x[last], y[k] - y[last]):
                ok[k] = False
                k += 1
    return ok


def speed_gate(observations: DataFrame, max_speed: float, streams: list[str] | None = None) -> DataFrame:
    """observations (streams, track_id, t_sec, x, y, ...) with `accepted`, in each track's order of time.

    An observation is rejected if it is faster than the limit from the last ACCEPTED one; the first is accepted, and
    so is one that does not lie later. Sorted tracks pass by and only the last accepted row is held, so that a
    track of any length fits."""
    keys = [*(streams or []), "track_id"]
    rest = [c for c in observations.columns if c not in (*keys, "t_sec", "x", "y", "accepted")]
    rows = observations.select(*keys, "t_sec", "x", "y", *rest)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, held = None, np.zeros((3, 0))
        for batch in found:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in range(len(keys))), strict=True))
            t, x, y = (batch.column(len(keys) + c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero([True, *(a != b for a, b in zip(names, names[1:], strict=False))])
            flags = np.ones(len(names), bool)
            for a, b in zip(edges.tolist(), [*edges.tolist()[1:], len(names)], strict=True):
                before = held if names[a] == track else np.zeros((3, 0))
                rows = np.concatenate((before, np.stack((t[a:b], x[a:b], y[a:b]))), axis=1)
                got = gate(*rows, max_speed)
                flags[a:b] = got[before.shape[1] :]
                track, held = names[a], rows[:, [np.flatnonzero(got)[-1]]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], names=[*batch.schema.names, "accepted"])

    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, "t_sec", "x", "y", *rest)
    return sorted_.mapInArrow(run, rows.schema.add("accepted", "boolean"))


def rejections(gated: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """Per track with rejected observations: accepted, rejected and the rejected share in percent; see most_rejected."""
    counts = gated.groupBy(*(streams or []), "track_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    share = F.col("rejected") / (F.col("accepted") + F.col("rejected")) * F.lit(100.0)
    return counts.where("rejected > 0").withColumn("rejected_pct", share)


def most_rejected(gated: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """The rejections, most first; ties by stream and track."""
    return rejections(gated, streams).orderBy(F.desc("rejected"), *(streams or []), "track_id")


def gate_totals(gated: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """Accepted and rejected observations over all tracks, with the rejected share in percent (0 without any)."""
    counts = gated.groupBy(*(streams or [])).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    return counts.withColumn("rejected_pct", F.coalesce(F.try_divide(F.col("rejected") * F.lit(100.0), F.col("accepted") + F.col("rejected")), F.lit(0.0)))


def velocity(accepted: DataFrame, window_frames: int, streams: list[str] | None = None) -> DataFrame:
    """Least-squares velocity over the last accepted samples, this one included; 0 for one sample or equal times."""
    if window_frames < 2:
        raise ValueError("a window has at least 2 samples")
    last = Window.partitionBy(*(streams or []), "track_id").orderBy("t_sec", "x", "y").rowsBetween(-(window_frames - 1), 0)
    n = F.count("*").over(last)
    slope = lambda c: F.when(n < 2, 0.0).otherwise(F.coalesce(F.regr_slope(c, "t_sec").over(last), F.lit(0.0)))
    return accepted.withColumns({"v_x": slope("x"), "v_y": slope("y"), "window_full": n == window_frames})


def step_rate(observations: DataFrame, steps: int = 30, streams: list[str] | None = None) -> DataFrame:
    """Observations a second over a track's last up to `steps` time steps; null where there is no step or all are 0.

    Adds the column `rate`; a track's first row has none, its second one has the rate of one step."""
    order = Window.partitionBy(*(streams or []), "track_id").orderBy("t_sec", "x", "y")
    stepped = observations.withColumn("dt", F.col("t_sec") - F.lag("t_sec").over(order))
    return stepped.withColumn("rate", F.try_divide(F.lit(1.0), F.avg("dt").over(order.rowsBetween(-(steps - 1), 0)))).drop("dt")


def lifetimes(observations: DataFrame, streams: list[str] | None = None) -> DataFrame:
    return observations.groupBy(*(streams or []), "track_id").agg((F.max("t_sec") - F.min("t_sec")).alias("lifetime_s"), F.count("*").alias("n_observations"))


def churn(observations: DataFrame, n_frames: Column | int, streams: list[str] | None = None) -> DataFrame:
    """Track statistics in one row, over the tracks of all streams; 0 where there are no tracks. n_frames: all frames, empty
    ones too. Medians and the like are exact, and no task holds all lifetimes."""
    return churn_of(lifetimes(observations, streams), n_frames)


def churn_of(life: DataFrame, n_frames: Column | int) -> DataFrame:
    """As churn, from lifetimes: lifetime_s and n_observations of every track."""
    share = lambda s: F.coalesce(F.avg((F.col("lifetime_s") >= s).cast("int")), F.lit(0.0))
    rows = F.coalesce(F.sum("n_observations"), F.lit(0))
    totals = life.agg(
        F.count("*").alias("n_tracks"), rows.alias("n_rows"), F.coalesce(F.min("lifetime_s"), F.lit(0.0)).alias("life_min"), F.coalesce(F.max("lifetime_s"), F.lit(0.0)).alias("life_max"),
        share(1.0).alias("ge_1_0s"), share(2.5).alias("ge_2_5s"), F.coalesce(F.try_divide(rows.cast("double"), F.lit(n_frames).cast("double")), F.lit(0.0)).alias("mean_simultaneous"),
    )
    ranks = exact_percentiles(life, "lifetime_s", [0.5, 0.9]).select(*[F.coalesce(a, F.lit(0.0)).alias(b) for a, b in (("p0", "life_median"), ("p1", "life_p90"))])
    one = [df.withColumn("whole", F.lit(0)) for df in (totals, ranks)]
    found = one[0].join(F.broadcast(one[1]), "whole")  # a row each
    return found.select("n_tracks", "n_rows", "life_min", "life_median", "life_p90", "life_max", "ge_1_0s", "ge_2_5s", "mean_simultaneous")


def ids_so_far(observations: DataFrame, frames: DataFrame, block: int = 100_000, streams: list[str] | None = None) -> DataFrame:
    """For each frame the number of distinct tracks up to it: first appearances, summed up.

    Sums run within blocks of frames, and over the blocks' totals, so that no task holds all frames."""
    by = streams or []
    firsts = observations.groupBy(*by, "track_id").agg(F.min("frame_idx").alias("frame_idx")).groupBy(*by, "frame_idx").agg(F.count("*").alias("new_ids"))
    spine = frames.join(firsts, [*by, "frame_idx"], "left").select(*by, "frame_idx", F.coalesce("new_ids", F.lit(0)).alias("new_ids"), F.floor(F.col("frame_idx") / block).alias("block"))
    totals = spine.groupBy(*by, "block").agg(F.sum("new_ids").alias("n"))
    before = totals.select(*by, "block", (F.sum("n").over(Window.partitionBy(*by).orderBy("block")) - F.col("n")).alias("before"))
    within = F.sum("new_ids").over(Window.partitionBy(*by, "block").orderBy("frame_idx"))
    return spine.join(before, [*by, "block"]).select(*by, "frame_idx", "new_ids", (within + F.col("before")).alias("ids_so_far"))
