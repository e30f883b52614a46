"""Operators on detections, one row a box: filters, funnel, matching, tiling and overlap suppression.

`streams` names the columns that tell cameras apart; frames of different cameras never meet. Without it a table is one
camera's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundflow.functions.geometry import foot_point, in_polygon, in_polygon_once, in_quad_of_edges, quad_edges, rounded_quad, to_ground
from groundflow.sources.kept import forget, kept, to_all

BOX = ["x1", "y1", "x2", "y2"]


def people(detections: DataFrame, least_conf: float, class_id: int = 0) -> DataFrame:
    """Class and confidence filters; they reach the scan and must stand before folds."""
    return detections.where((F.col("class_id") == class_id) & (F.col("conf") >= least_conf))


def project(detections: DataFrame, h: list[list[float]], quad: list) -> DataFrame:
    """foot_x, foot_y, in_quad, and world_x, world_y (null outside the quad)."""
    fx, fy = foot_point()
    wide = detections.withColumns({"foot_x": fx, "foot_y": fy})
    inside = in_polygon(quad, F.col("foot_x"), F.col("foot_y"))
    wx, wy = to_ground(h, F.col("foot_x"), F.col("foot_y"))
    return wide.withColumn("in_quad", inside).withColumns({"world_x": F.when(F.col("in_quad"), wx), "world_y": F.when(F.col("in_quad"), wy)})


def project_inside(detections: DataFrame, h: list[list[float]], quad: list) -> DataFrame:
    """The rows of project that are inside. The condition, which Spark moves down to where boxes are made, works the foot point
    out once; use this rather than a filter on in_quad where boxes are expressions."""
    x, y = foot_point()
    inside = detections.where(in_polygon_once(quad, x, y)).withColumns({"foot_x": x, "foot_y": y})
    wx, wy = to_ground(h, F.col("foot_x"), F.col("foot_y"))
    return inside.withColumns({"in_quad": F.lit(True), "world_x": wx, "world_y": wy})


def project_each(detections: DataFrame, calibrations: DataFrame, streams: list[str]) -> DataFrame:
    """As project, with each stream's own quad and matrix. calibrations: streams, H, image_points (four corners), one row a stream.

    Detections of a stream without calibration are outside. Few calibrations are broadcast, as a shuffle by stream would put all rows of a
    stream into one task; what the test of a quad needs is worked out there, once a stream."""
    fx, fy = foot_point()
    wanted = quad_edges(F.col("image_points")) | {f"_h{r}{c}": F.col("H")[r][c] for r in range(3) for c in range(3)}
    known = calibrations.select(*streams, *[c.alias(n) for n, c in wanted.items()])
    wide = detections.withColumns({"foot_x": fx, "foot_y": fy}).join(to_all(known), streams, "left")
    x, y = F.col("foot_x"), F.col("foot_y")
    line = lambda r: F.col(f"_h{r}0") * x + F.col(f"_h{r}1") * y + F.col(f"_h{r}2")
    world = {f"world_{axis}": F.when(F.col("in_quad"), F.try_divide(line(r), line(2))) for r, axis in enumerate("xy")}
    return wide.withColumn("in_quad", F.coalesce(in_quad_of_edges(x, y), F.lit(False))).withColumns(world).drop(*wanted)


def in_zone(quad: list) -> Column:
    """Whether the foot point lies in the quad with corners at whole pixels, by which boxes are split before tracking."""
    return in_polygon(rounded_quad(quad), *foot_point())


def state() -> Column:
    """How a box is shown: outside the zone, tracked, or in the quad but not (yet) tracked. Needs in_zone and track_id."""
    return F.when(~F.col("in_zone"), "outside").when(F.col("track_id") >= 0, "tracked").otherwise("in_quad_untracked")


def excluded(detections: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """Per frame: boxes outside the zone, confirmed ones that the exact quad leaves out, and both together.

    detections: frame_idx, in_zone, in_quad, track_id (-1: not confirmed)."""
    lost = F.count_if(F.col("in_zone") & (F.col("track_id") >= 0) & ~F.col("in_quad"))
    counts = detections.groupBy(*(streams or []), "frame_idx").agg(F.count_if(~F.col("in_zone")).alias("n_outside"), lost.alias("n_unprojected"))
    return counts.withColumn("n_excluded", F.col("n_outside") + F.col("n_unprojected"))


def funnel(detections: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """total, in_quad, tracked, emitted and lost share, of all rows or of each stream. detections: in_quad, track_id (-1:
    not confirmed)."""
    tracked = F.count_if(F.col("in_quad") & (F.col("track_id") >= 0))
    counts = detections.groupBy(*(streams or [])).agg(F.count("*").alias("total"), F.count_if("in_quad").alias("in_quad"), tracked.alias("tracked"), tracked.alias("emitted"))
    return counts.withColumn("loss", 1.0 - F.try_divide(F.col("tracked").cast("double"), F.col("in_quad").cast("double")))


def same_box(atol: float = 1e-3, rtol: float = 1e-5, streams: list[str] | None = None) -> Column:
    """Candidate `a` and reference `b` of one frame agree; the relative part is of the candidate."""
    close = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(f"a.{c}")) for c in BOX]
    return reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*(streams or []), "frame_idx")] + close)


def matched(candidates: DataFrame, reference: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """Candidates that have the same box in the reference (equi-join on the frame, then the tolerance)."""
    return candidates.alias("a").join(reference.alias("b"), same_box(streams=streams), "left_semi")


def unmatched(candidates: DataFrame, reference: DataFrame, streams: list[str] | None = None) -> DataFrame:
    return candidates.alias("a").join(reference.alias("b"), same_box(streams=streams), "left_anti")


def with_truth(boxes: DataFrame, truth: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """Each box with its person's known position (null for false boxes). boxes: frame_idx, truth_agent_id; truth: frame_id,
    agent_id, x_world, y_world.

    Both are tables of a row a person and frame. Their sizes are told wrongly where they are multiplied out of a small table, so the
    join is a merge in any case and never a broadcast of the truth."""
    by = streams or []
    known = truth.select(*by, F.col("frame_id").alias("frame_idx"), F.col("agent_id").alias("truth_agent_id"), F.col("x_world").alias("truth_x"), F.col("y_world").alias("truth_y"))
    return boxes.join(known.hint("merge"), [*by, "frame_idx", "truth_agent_id"], "left")


@dataclass(frozen=True)
class Tiling:
    """How frames are cut: tiles of width x height pixels that overlap by a share of their size, or by `overlap_px`."""

    width: int = 1280
    height: int = 1280
    ratio: float = 0.1
    overlap_px: tuple[int, int] | None = None
    least_conf: float | None = None
    threshold: float = 0.7

    def __post_init__(self) -> None:
        across, down = self.overlap
        if not (0 <= across < self.width and 0 <= down < self.height):
            raise ValueError(f"tiles of {self.width} x {self.height} can't overlap by {across} x {down}")
        if not 0 <= self.threshold <= 1:
            raise ValueError("an overlap threshold lies between 0 and 1")

    @property
    def overlap(self) -> tuple[int, int]:
        """Pixels that neighbours share; halves go to the even number."""
        return self.overlap_px or (round(self.width * self.ratio), round(self.height * self.ratio))


def tile_starts(length: int, tile: int, overlap: int) -> Column:
    """Left (upper) edges of tiles that cover the length."""
    return F.sequence(F.lit(0), F.lit(max(0, length - overlap - 1)), F.lit(tile - overlap))


def to_tiles(detections: DataFrame, width: int, height: int, tiling: Tiling = Tiling()) -> DataFrame:
    """One row for each tile that holds the box's foot point."""
    fx, fy = foot_point()
    placed, (across, down) = detections.withColumns({"fx": fx, "fy": fy}), tiling.overlap
    for axis, length, tile, overlap in (("x", width, tiling.width, across), ("y", height, tiling.height, down)):
        start, at = F.col(f"tile_{axis}"), F.col(f"f{axis}")
        placed = placed.withColumn(f"tile_{axis}", F.explode(tile_starts(length, tile, overlap))).where((at >= start) & (at < start + tile))
    return placed


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs); 0 when both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.coalesce(F.try_divide(w * h, size(a) + size(b) - w * h), F.lit(0.0))


#: Boxes of one frame and class that a task folds at most; more go by cells and rounds.
FOLDED = 1000


def suppress(detections: DataFrame, threshold: float = 0.7, streams: list[str] | None = None, folded: int = FOLDED) -> DataFrame:
    """Greedy suppression a frame and class: by falling confidence (ties by falling coordinates, then by the other columns), a
    box stays unless it overlaps a kept one by more than the threshold. Kept rows come back whole.

    A frame with up to `folded` boxes of a class is walked in one row. Of a fuller one no group holds all: see suppress_crowded,
    which gives the same rows."""
    keys = [*(streams or []), "frame_idx", "class_id"]
    full = detections.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > folded).select(keys)
    if full.isEmpty():
        return _folded(detections, threshold, keys)
    full = kept(full, "full-frames")
    same = [detections[k].eqNullSafe(full[k]) for k in keys]
    few, many = (detections.join(full, same, how) for how in ("left_anti", "left_semi"))
    return _folded(few, threshold, keys).unionByName(suppress_crowded(many, threshold, streams))


def _folded(detections: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    rest = [c for c in detections.columns if c not in (*keys, "conf", *BOX)]
    row = F.struct("conf", *BOX, *rest)
    grouped = detections.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(row))).alias("boxes"))
    none = F.filter("boxes", lambda b: F.lit(False))
    keep = lambda stay, b: F.when(F.exists(stay, lambda k: iou(k, b) > threshold), stay).otherwise(F.concat(stay, F.array(b)))
    return grouped.select(*keys, F.inline(F.aggregate("boxes", none, keep))).select(detections.columns)


def suppress_crowded(detections: DataFrame, threshold: float = 0.7, streams: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """As suppress, for frames of any number of boxes.

    Boxes are put into the square cells that they touch (as long as most boxes' longer side), so only boxes of one cell are compared,
    each pair in the one cell that holds its common part's upper left corner. What is left of the pairs is who stands in whose way. Then in
    rounds: a box with nobody in its way any more stays, and those in whose way it stands go; their own claims go with them. Of
    boxes that are equal in place only the first is compared, as the others go with it or because of it. There are as many rounds as the longest
    chain of boxes that stand in each other's way. The result reads tables under spark.checkpoint.dir; kept.forget(result)
    deletes them."""
    keys = [*(streams or []), "frame_idx", "class_id"]
    rest = [c for c in detections.columns if c not in (*keys, "conf", *BOX)]
    order = F.struct("conf", *BOX, *rest, (-F.monotonically_increasing_id()).alias("_no"))  # of rows that are alike in all, any
    rows = kept(detections.withColumn("_order", order), "crowded-boxes")
    number = F.col("_order")["_no"]
    real = rows.where("x2 > x1 AND y2 > y1").select(*keys, *BOX, "_order")  # others overlap nothing
    best = F.max("_order")["_no"].alias("_best")
    firsts = real.groupBy(*keys, *BOX).agg(F.max("_order").alias("_order"))
    gone = [real.select(*keys, *BOX, number.alias("_no")).join(real.groupBy(*keys, *BOX).agg(best), [*keys, *BOX]).where("_no <> _best").select("_no")] if threshold < 1 else []
    # places that differ are told apart by confidence and box alone, so nothing else has to travel
    places = firsts.withColumn("_order", F.struct(F.col("_order")["conf"].alias("conf"), *[F.col("_order")[c].alias(c) for c in BOX], number.alias("_no"))) if threshold < 1 else real
    side = cell or places.agg(F.percentile_approx(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 0.9)).first()[0] or 1.0
    at = lambda c: F.floor(F.col(c) / F.lit(float(side)))
    put = places.select(*keys, "_order", F.explode(F.sequence(at("x1"), at("x2"))).alias("_cx"), "y1", "y2")
    put = put.withColumn("_cy", F.explode(F.sequence(at("y1"), at("y2")))).drop("y1", "y2")
    a, b = (put.select(*keys, "_cx", "_cy", F.col("_order").alias(f"{n}_order")) for n in ("a", "b"))
    corner = lambda c: F.floor(F.greatest(F.col("a_order")[c], F.col("b_order")[c]) / F.lit(float(side)))
    met = a.join(b, [*keys, "_cx", "_cy"]).where((F.col("a_order") > F.col("b_order")) & (corner("x1") == F.col("_cx")) & (corner("y1") == F.col("_cy")) & (iou(F.col("a_order"), F.col("b_order")) > threshold))
    claims = kept(met.select(F.col("a_order")["_no"].alias("a"), F.col("b_order")["_no"].alias("b")), "claims")
    while not claims.isEmpty():
        free = claims.select("a").distinct().join(claims.select(F.col("b").alias("a")), "a", "left_anti")
        out = kept(claims.join(free, "a").select(F.col("b").alias("_no")).distinct(), "suppressed")
        gone.append(out)
        left = claims.join(out.select(F.col("_no").alias("a")), "a", "left_anti").join(out.select(F.col("_no").alias("b")), "b", "left_anti")
        before, claims = claims, kept(left, "claims")
        forget(before)
    found = rows.withColumn("_no", number)
    for out in gone:
        found = found.join(out, "_no", "left_anti")
    return found.select(detections.columns)


def stacked_pairs(detections: DataFrame, least_across: float = 0.6, most_gap: float = 20.0, most_iou: float = 0.3, streams: list[str] | None = None) -> DataFrame:
    """Pairs of boxes in a frame that stand above each other: wide common span, small gap, little overlap."""
    keys = [*(streams or []), "frame_idx"]
    a, b = (detections.select(*keys, F.struct(*BOX).alias(n)) for n in ("a", "b"))
    pairs = a.join(b, keys).where(F.col("a.y2") < F.col("b.y2"))
    common = F.greatest(F.lit(0.0), F.least("a.x2", "b.x2") - F.greatest("a.x1", "b.x1"))
    across = F.try_divide(common, F.greatest("a.x2", "b.x2") - F.least("a.x1", "b.x1"))
    gap = F.abs(F.col("b.y1") - F.col("a.y2"))
    return pairs.where((across >= least_across) & (gap <= most_gap) & (iou(F.col("a"), F.col("b")) <= most_iou))


def running_totals(per_frame: DataFrame, columns: list[str], streams: list[str], block: int = 100_000) -> DataFrame:
    """Totals so far of per-frame counts, a stream at a time: within blocks of frames, and over the blocks' totals, so that no task
    holds a stream."""
    placed = per_frame.withColumn("_block", F.floor(F.col("frame_idx") / F.lit(block)))
    totals = placed.groupBy(*streams, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    over = Window.partitionBy(*streams).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*streams, "_block", *[F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*streams, "_block").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(before, [*streams, "_block"])
    return joined.withColumns({f"{c}_so_far": F.sum(c).over(inside) + F.col(f"_{c}") for c in columns}).select(*per_frame.columns, *[f"{c}_so_far" for c in columns])
