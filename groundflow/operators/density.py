"""Spatial density on a ground grid: per frame, rolling over time, smoothed, coloured.

`streams` names the columns that tell cameras apart; without it a table is one camera's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundflow.functions.geometry import Points, four_points

#: Densities in persons a square metre and their colours (blue, green, red).
STOPS_HARD = [(0.0, (200, 255, 255)), (2.45, (0, 170, 255)), (2.5, (0, 30, 255)), (4.0, (0, 0, 255))]
STOPS_EASED = [(0.0, (200, 255, 255)), (2.0, (0, 170, 255)), (2.5, (0, 30, 255)), (4.0, (0, 0, 255))]


#: Cells that a task smooths at once.
CELLS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    cell: float
    n_cols: int
    n_rows: int

    @classmethod
    def over(cls, quad: Points, cell: float) -> Grid:
        p = four_points(quad)
        if cell <= 0:
            raise ValueError("a cell has a positive size")
        (x0, y0), (x1, y1) = p.min(axis=0).tolist(), p.max(axis=0).tolist()
        return cls(x0, y0, cell, max(1, math.ceil((x1 - x0) / cell)), max(1, math.ceil((y1 - y0) / cell)))

    def place(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """col and row of each point; points outside are dropped (so is the very upper edge)."""
        c, r = (F.floor((F.col(v) - F.lit(o)) / F.lit(self.cell)).cast("int") for v, o in ((x, self.x0), (y, self.y0)))
        return points.withColumns({"col": c, "row": r}).where(F.col("col").between(0, self.n_cols - 1) & F.col("row").between(0, self.n_rows - 1))

    def cells(self, frames: DataFrame) -> DataFrame:
        """Every frame with every cell: a grid's cells are few."""
        cells = F.explode(F.sequence(F.lit(0), F.lit(self.n_cols * self.n_rows - 1)))
        return frames.withColumn("k", cells).withColumns({"col": (F.col("k") % self.n_cols).cast("int"), "row": F.floor(F.col("k") / self.n_cols).cast("int")}).drop("k")


def frame_density(points: DataFrame, frames: DataFrame, area_m2: float, cell: float, streams: list[str] | None = None) -> DataFrame:
    """For every frame, empty ones too: persons, density, and the fullest cell's density (null when empty)."""
    keys = [*(streams or []), "frame_idx"]
    cells = points.groupBy(*keys, F.floor(F.col("x") / cell).alias("ci"), F.floor(F.col("y") / cell).alias("cj")).agg(F.count("*").alias("n"))
    per = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    spine = frames.join(per, keys, "left")
    n = F.coalesce("n", F.lit(0))
    return spine.select(*keys, "t_sec", n.alias("in_quad"), (n / F.lit(area_m2)).alias("density"), (F.col("top") / F.lit(cell * cell)).alias("peak_cell_density"))


def density_summary(series: DataFrame, area_m2: float, streams: list[str] | None = None) -> DataFrame:
    """Mean, peak and the first frame that has it, of all rows or of each stream."""
    best = F.max_by(F.struct("frame_idx", "t_sec"), F.struct("density", -F.col("frame_idx")))
    found = series.groupBy(*(streams or [])).agg(F.count("*").alias("n_frames"), F.sum("in_quad").alias("persons"), (F.avg("in_quad") / F.lit(area_m2)).alias("mean_density"), F.max("density").alias("max_density"), best.alias("at"), F.max(F.coalesce("peak_cell_density", F.lit(0.0))).alias("max_cell_density"))
    return found.select(*(streams or []), "n_frames", "persons", "mean_density", "max_density", F.col("at.frame_idx").alias("max_frame"), F.col("at.t_sec").alias("max_t"), "max_cell_density")


def density_report(series: DataFrame, records: DataFrame, area_m2: float, cell: float, streams: list[str] | None = None) -> DataFrame:
    """The whole summary of a density run: density_summary, with the number of records (in the quad or not), the first frame
    with the fullest cell, and the busiest cell of all time with its count. records: frame_idx, x, y, in_quad."""
    by = [*(streams or [])] or ["whole"]
    series, records = (df if streams else df.withColumn("whole", F.lit(0)) for df in (series, records))
    fullest = F.coalesce("peak_cell_density", F.lit(0.0))
    cell_at = series.groupBy(*by).agg(F.max_by("frame_idx", F.struct(fullest, -F.col("frame_idx"))).alias("max_cell_frame"))
    counts = records.groupBy(*by).agg(F.count("*").alias("n_records"))
    busiest = busiest_cell(records.where("in_quad"), cell, by).select(*by, F.array("ci", "cj", "n").alias("busiest"))
    found = density_summary(series, area_m2, by).join(cell_at, by).join(counts, by, "left").join(busiest, by, "left")
    found = found.withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return found if streams else found.drop("whole")


def busiest_cell(points: DataFrame, cell: float, streams: list[str] | None = None) -> DataFrame:
    """The cell with most person-frames, of all rows or of each stream; of equal ones the one that was filled first."""
    by = streams or []
    cells = points.groupBy(*by, F.floor(F.col("x") / cell).alias("ci"), F.floor(F.col("y") / cell).alias("cj")).agg(F.count("*").alias("n"), F.min("frame_idx").alias("first"))
    best = F.max_by(F.struct("ci", "cj", "n"), F.struct("n", -F.col("first"), -F.col("ci"), -F.col("cj")))
    return cells.groupBy(*by).agg(best.alias("b")).where("b is not null").select(*by, "b.ci", "b.cj", "b.n")


def _blocks(frames: DataFrame, seconds: float, block_seconds: float | None) -> DataFrame:
    """frames with `block`, a stretch of time, and `halo`: a frame is also in the later blocks whose windows reach back to it.

    So every window lies within one block, and a long recording is many of them."""
    length = F.lit(float(block_seconds or max(8 * seconds, 60.0)))
    own = F.floor(F.col("t_sec") / length)
    last = F.floor((F.col("t_sec") + F.lit(seconds + 0.001)) / length)  # a little more for rounding; the window's bounds decide
    placed = frames.withColumn("block", F.explode(F.sequence(own, last)))
    return placed.withColumn("halo", F.col("block") > own)


def _in_window(value: str, seconds: float, by: list[str]) -> Column:
    """Sum of a whole-number column over the rows of the last seconds, both ends included.

    As the rows up to now plus the rows from the window's start on, minus all: sums that only ever grow along an order,
    so that a row costs the same however long the window is. Its bounds are in SQL, where they may be a fraction."""
    part = f"PARTITION BY {', '.join(by)}"
    upto = f"sum({value}) OVER ({part} ORDER BY t_sec RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    since = f"sum({value}) OVER ({part} ORDER BY t_sec DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {float(seconds)!r}D FOLLOWING)"
    return F.expr(f"{upto} + {since} - sum({value}) OVER ({part})")


def _counted(frames: DataFrame, seconds: float, by: list[str], block_seconds: float | None) -> DataFrame:
    """frames with their block and n_frames."""
    placed = _blocks(frames, seconds, block_seconds).withColumn("one", F.lit(1).cast("long"))
    return placed.withColumn("n_frames", _in_window("one", seconds, [*by, "block"])).where(~F.col("halo")).drop("halo", "one")


def frames_in_window(frames: DataFrame, seconds: float, streams: list[str] | None = None, block_seconds: float | None = None) -> DataFrame:
    """frames with n_frames: how many frames of their stream lie in the last seconds, both ends included."""
    return _counted(frames, seconds, streams or [], block_seconds).drop("block")


def rolling(points: DataFrame, frames: DataFrame, grid: Grid, seconds: float, streams: list[str] | None = None, block_seconds: float | None = None) -> DataFrame:
    """Mean persons a cell over the frames of the last seconds (both ends included, empty frames counted), for every frame
    and cell. points: streams, frame_idx, x, y; frames: streams, frame_idx, t_sec.

    Counts and the frames' cells meet in one shuffle by stream, block of time and cell."""
    by = streams or []
    frames = frames.select(*by, "frame_idx", "t_sec")
    counts = grid.place(points, "x", "y").groupBy(*by, "frame_idx", "col", "row").agg(F.count("*").alias("n"))
    filled = counts.join(_blocks(frames, seconds, block_seconds), [*by, "frame_idx"]).withColumn("n_frames", F.lit(None).cast("long"))
    asked = grid.cells(_counted(frames, seconds, by, block_seconds)).withColumn("n", F.lit(0).cast("long"))
    columns = [*by, "block", "col", "row", "frame_idx", "t_sec", "n", "n_frames"]
    sums = filled.select(columns).unionByName(asked.select(columns)).withColumn("persons", _in_window("n", seconds, [*by, "block", "col", "row"]))
    return sums.where("n_frames is not null").select(*by, "frame_idx", "t_sec", "col", "row", (F.col("persons") / F.col("n_frames")).alias("value"))


def cut_at(rows: DataFrame, resets: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """rows (streams, frame_idx, ...) with `segment`: how many resets (streams, frame_idx) of their stream stand at or before them.

    Given to rolling and the like as one more stream, it empties every window at a reset. Resets are orders that someone gives, so
    a stream's fit in a row."""
    by = streams or ["whole"]
    rows, resets = (df if streams else df.withColumn("whole", F.lit(0)) for df in (rows, resets))
    orders = resets.groupBy(*by).agg(F.collect_list("frame_idx").alias("_orders"))
    found = rows.join(orders, by, "left").withColumn("segment", F.coalesce(F.size(F.filter("_orders", lambda r: r <= F.col("frame_idx"))), F.lit(0)))
    return found.drop("_orders") if streams else found.drop("_orders", "whole")


def _leaves(frames: DataFrame, seconds: float, by: list[str], length: float) -> DataFrame:
    """frames with leave_t: the time of the first frame whose window no longer holds this one; null if there is none.

    Frames' times and windows' starts are walked together in blocks of time; what lies beyond a block's end is looked up among the
    blocks' first starts, a row a block."""
    start = F.col("t_sec") - F.lit(float(seconds))
    asks = frames.select(*by, "frame_idx", "t_sec", F.col("t_sec").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("double").alias("leave"))
    starts = frames.select(*by, F.lit(None).cast("long").alias("frame_idx"), F.lit(None).cast("double").alias("t_sec"), start.alias("at"), F.lit(0).alias("ask"), F.col("t_sec").alias("leave"))
    both = asks.unionByName(starts).withColumn("block", F.floor(F.col("at") / F.lit(length)))
    # of equal ones starts come first: a window that begins at a frame still holds it
    later = Window.partitionBy(*by, "block").orderBy("at", "ask").rowsBetween(1, Window.unboundedFollowing)
    within = both.withColumn("leave_t", F.first("leave", True).over(later)).where("ask = 1")
    firsts = both.where("ask = 0").groupBy(*by, "block").agg(F.min("leave").alias("first"))
    blocks = both.select(*by, "block").distinct().join(firsts, [*by, "block"], "left")
    beyond = blocks.select(*by, "block", F.first("first", True).over(Window.partitionBy(*by).orderBy("block").rowsBetween(1, Window.unboundedFollowing)).alias("beyond"))
    return within.join(beyond, [*by, "block"]).select(*by, "frame_idx", F.coalesce("leave_t", "beyond").alias("leave_t"))


def rolling_intervals(points: DataFrame, frames: DataFrame, grid: Grid, seconds: float, streams: list[str] | None = None, block_seconds: float | None = None) -> DataFrame:
    """What rolling gives, without the dense grid: for each cell the spans of time with equally many persons in the
    window: streams, col, row, from_t (included), until_t (not included; null: to the end) and persons, more than 0.

    A point enters its cell's window at its own frame and leaves it at the first frame whose window no longer holds it; between
    such events a cell's number of persons is constant. Events of one cell are summed in blocks of time and over the blocks' totals, so
    that no task walks all of a busy cell's. rolling_values makes the frames' values of them."""
    by, length = streams or [], float(block_seconds or max(64 * seconds, 600.0))
    frames = frames.select(*by, "frame_idx", "t_sec")
    cell = [*by, "col", "row"]
    counts = grid.place(points, "x", "y").groupBy(*by, "frame_idx", "col", "row").agg(F.count("*").alias("n"))
    known = frames.join(_leaves(frames, seconds, by, length), [*by, "frame_idx"])
    met = counts.join(known, [*by, "frame_idx"])
    event = F.explode(F.array(F.struct(F.col("t_sec").alias("t"), F.col("n").alias("d")), F.struct(F.col("leave_t").alias("t"), (-F.col("n")).alias("d"))))
    events = met.select(*cell, event.alias("e")).select(*cell, "e.t", "e.d").where("t is not null").groupBy(*cell, "t").agg(F.sum("d").alias("d")).where("d <> 0")
    events = events.withColumn("block", F.floor(F.col("t") / F.lit(length)))
    totals = events.groupBy(*cell, "block").agg(F.sum("d").alias("sum"), F.min("t").alias("first"))
    over = Window.partitionBy(*cell).orderBy("block")
    edges = totals.select(*cell, "block", (F.sum("sum").over(over) - F.col("sum")).alias("before"), F.lead("first").over(over).alias("next"))
    inside = Window.partitionBy(*cell, "block").orderBy("t")
    placed = events.join(edges, [*cell, "block"]).withColumns({"persons": F.sum("d").over(inside) + F.col("before"), "until_t": F.coalesce(F.lead("t").over(inside), "next")})
    return placed.where("persons > 0").select(*cell, F.col("t").alias("from_t"), "until_t", "persons")


def rolling_values(intervals: DataFrame, frames: DataFrame, seconds: float, streams: list[str] | None = None, block_seconds: float | None = None) -> DataFrame:
    """The values that rolling gives, but for zeros, from rolling_intervals. Spans and frames meet in blocks of time."""
    by, length = streams or ["whole"], float(block_seconds or max(8 * seconds, 60.0))
    frames, spans = (df if streams else df.withColumn("whole", F.lit(0)) for df in (frames, intervals))
    known = frames_in_window(frames.select(*by, "frame_idx", "t_sec"), seconds, by).withColumn("block", F.floor(F.col("t_sec") / F.lit(length)))
    spans = spans.join(known.groupBy(*by).agg(F.max("block").alias("_last")), by)
    first, last = (F.floor(F.col(c) / F.lit(length)) for c in ("from_t", "until_t"))
    spans = spans.withColumn("block", F.explode(F.sequence(first, F.greatest(first, F.least(F.coalesce(last, F.col("_last")), F.col("_last"))))))
    met = spans.join(known, [*by, "block"]).where((F.col("t_sec") >= F.col("from_t")) & (F.col("until_t").isNull() | (F.col("t_sec") < F.col("until_t"))))
    return met.select(*(streams or []), "frame_idx", "t_sec", "col", "row", (F.col("persons") / F.col("n_frames")).alias("value"))


def grid_peak(grid_values: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """The highest cell value of every frame."""
    return grid_values.groupBy(*(streams or []), "frame_idx").agg(F.max("value").alias("peak"))


#: What a heat map's colours are scaled to, in persons a cell and persons a square metre.
SCALES = {"count": 3.0, "density": 4.0}


def scale(mode: str, **scales: float) -> float:
    """The top of a heat map's scale; unknown modes are refused."""
    if mode not in SCALES:
        raise ValueError(f"a heat map shows 'count' or 'density', not {mode!r}")
    return scales.get(mode, SCALES[mode])


def in_mode(grid_values: DataFrame, grid: Grid, mode: str) -> DataFrame:
    """Grid values as they are (`count`) or by area (`density`)."""
    scale(mode)
    return grid_values if mode == "count" else grid_values.withColumn("value", F.col("value") / F.lit(grid.cell * grid.cell))


def legend_tick(value: Column, vmax: float, top: int, height: int) -> Column:
    """The pixel row of a value on a legend that runs from vmax at `top` down to 0; halves go to the even row."""
    share = to_ramp(value, vmax, 1.0) if vmax > 0 else F.lit(0.0)
    return F.bround(F.lit(float(top)) + (F.lit(1.0) - share) * F.lit(float(height)), 0).cast("int")


def kernel(sigma: float, n: int) -> list[tuple[int, int, float]]:
    """(from, to, weight) of Gaussian smoothing along n cells, mirrored at the edges; weights are kept whole."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    found: dict[tuple[int, int], float] = {}
    for to in range(n):
        for k, w in zip(range(-radius, radius + 1), raw, strict=True):
            at = (to + k) % (2 * n)
            at = at if at < n else 2 * n - 1 - at
            found[at, to] = found.get((at, to), 0.0) + w / sum(raw)
    return [(a, b, w) for (a, b), w in sorted(found.items())]


def smoothed(grid_values: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """Separable Gaussian smoothing; sigma <= 0 leaves all as it is. Every cell of a frame comes back, cells that were missing count as 0.

    A frame's cells that are not 0 meet in one row (a grid's cells are few), and both passes are made there: one shuffle."""
    if sigma <= 0:
        return grid_values
    keys = [c for c in grid_values.columns if c not in ("col", "row", "value")]
    across, down = np.zeros((grid.n_cols, grid.n_cols)), np.zeros((grid.n_rows, grid.n_rows))
    for table, n in ((across, grid.n_cols), (down, grid.n_rows)):
        for a, b, w in kernel(sigma, n):
            table[b, a] = w
    cells, size = F.when(F.col("value") != 0, F.struct((F.col("row") * grid.n_cols + F.col("col")).alias("k"), "value")), grid.n_cols * grid.n_rows
    met = grid_values.groupBy(*keys).agg(F.collect_list(cells).alias("_cells")).select(*keys, F.col("_cells.k").alias("_k"), F.col("_cells.value").alias("_v"))
    schema = met.select(*keys, F.lit(0).alias("col"), F.lit(0).alias("row"), F.lit(0.0).alias("value")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, CELLS_AT_ONCE // size)):
                part = batch.slice(start, max(1, CELLS_AT_ONCE // size))
                n, (k, v) = part.num_rows, part.columns[len(keys) :]
                plain = np.zeros((n, size))
                np.add.at(plain, (np.repeat(np.arange(n), np.diff(k.offsets.to_numpy())), k.flatten().to_numpy()), v.flatten().to_numpy())
                found = down @ plain.reshape(n, grid.n_rows, grid.n_cols) @ across.T
                row = pa.array(np.repeat(np.arange(n), size))
                place = np.tile(np.arange(size, dtype=np.int32), n)
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in part.columns[: len(keys)]), pa.array(place % grid.n_cols), pa.array(place // grid.n_cols), pa.array(found.ravel())], names=[*keys, "col", "row", "value"])

    return met.mapInArrow(run, schema)


def colour(value: Column, stops: list = STOPS_HARD) -> Column:
    """(b, g, r) by linear steps between stops, held at both ends and cut to whole numbers."""
    stops = sorted(stops)
    v = F.least(F.greatest(value, F.lit(stops[0][0])), F.lit(stops[-1][0]))

    def channel(k: int) -> Column:
        found = F.lit(float(stops[-1][1][k]))
        for (a, x), (b, y) in reversed(list(zip(stops, stops[1:], strict=False))):
            found = F.when(v < b, F.lit(float(x[k])) + (v - F.lit(a)) / F.lit(b - a) * F.lit(float(y[k] - x[k]))).otherwise(found)
        return found.cast("int")

    return F.struct(*[channel(k).alias(c) for k, c in enumerate("bgr")])


def to_ramp(value: Column, vmax: float, top: float = 4.0) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(vmax)) / F.lit(max(vmax, 1e-9)) * F.lit(top)


def overlay_alpha(value: Column, vmax: float, gamma: float = 0.5, most: float = 0.7) -> Column:
    return F.pow(to_ramp(value, vmax, 1.0), F.lit(gamma)) * F.lit(most)
