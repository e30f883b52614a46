"""Ground-plane geometry: small fits on the driver, everything per row as Column expressions."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Points = Sequence[Sequence[float]]
#: A fit whose equations are worse conditioned than this is reported.
CONDITION_LIMIT = 1e6


class QuadError(ValueError):
    """Four points that are no usable quadrilateral."""


def four_points(points: Points) -> np.ndarray:
    found = np.asarray(points, float)
    if found.shape != (4, 2):
        raise ValueError(f"expected 4 points of 2 coordinates, got shape {found.shape}")
    return found


def fit_homography(pixels: Points, metres: Points) -> list[list[float]]:
    """The 3 x 3 matrix that takes four pixel points to four ground points (lower right entry 1)."""
    src, dst = four_points(pixels), four_points(metres)
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    found = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1.0).reshape(3, 3)
    if (c := float(np.linalg.cond(found))) > CONDITION_LIMIT:
        warnings.warn(f"the homography is ill-conditioned ({c:.3g}); the points are nearly on a line", stacklevel=2)
    return found.tolist()


def edge_lengths(points: Points) -> list[float]:
    p = np.asarray(points, float)
    return [float(d) for d in np.hypot(*(np.roll(p, -1, axis=0) - p).T)]


def area(points: Points) -> float:
    p = np.asarray(points, float)
    q = np.roll(p, -1, axis=0)
    return float(abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2)


def is_convex(points: Points) -> bool:
    """All turns to one side; a straight corner counts as a turn to the right."""
    p = np.asarray(points, float)
    a, b = np.roll(p, -1, axis=0) - p, np.roll(p, -2, axis=0) - np.roll(p, -1, axis=0)
    left = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] > 0
    return bool(left.all() or not left.any())


def _side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bool:
    return bool((b[0] - a[0]) * (c[1] - a[1]) > (b[1] - a[1]) * (c[0] - a[0]))


def segments_cross(a: Points, b: Points) -> bool:
    (p, q), (r, s) = np.asarray(a, float), np.asarray(b, float)
    return _side(p, r, s) != _side(q, r, s) and _side(p, q, r) != _side(p, q, s)


def check_quad(points: Points) -> None:
    p = four_points(points)
    if segments_cross(p[[0, 1]], p[[2, 3]]) or segments_cross(p[[1, 2]], p[[3, 0]]):
        raise QuadError("the edges cross: give the corners in order around the quad")
    if not is_convex(p):
        raise QuadError("the quad is not convex")


#: The size in metres that an unmeasured quad is taken to have, and how sizes are named by their origin.
DEFAULT_WIDTH_M, DEFAULT_HEIGHT_M = 7.0, 5.25
ESTIMATED, MEASURED = "ESTIMATED", "USER_MEASURED"


def ground_size(width_m: float | None = None, height_m: float | None = None) -> tuple[float, float, str]:
    """Width, height and origin of a quad's size: an estimate if neither is given; if one is, the other takes its default."""
    source = ESTIMATED if width_m is None and height_m is None else MEASURED
    return (DEFAULT_WIDTH_M if width_m is None else float(width_m), DEFAULT_HEIGHT_M if height_m is None else float(height_m), source)


def rounded_quad(points: Points) -> list[tuple[float, float]]:
    """Corners at whole pixels (halves to the even one): the zone that detections are split by before tracking."""
    return [(float(x), float(y)) for x, y in np.round(four_points(points)).tolist()]


def calibration_record(video: str, frame_index: int, resolution: Sequence[int], image_points: Points, width_m: float, height_m: float, source: str, note: str, timestamp: str) -> dict:
    """A calibration for a ground rectangle of the given size; see schema.CALIBRATION."""
    if not (width_m > 0 and height_m > 0):
        raise ValueError(f"a ground rectangle has a positive width and height, got {width_m} x {height_m}")
    check_quad(image_points)
    world = [[-width_m / 2, 0.0], [width_m / 2, 0.0], [width_m / 2, height_m], [-width_m / 2, height_m]]
    h = np.array(fit_homography(image_points, world))
    back = np.linalg.inv(h)
    there = np.column_stack((np.asarray(world), np.ones(4))) @ back.T
    error = float(np.abs(there[:, :2] / there[:, 2:] - np.asarray(image_points, float)).max())
    if error >= 1.0:
        raise ValueError(f"the round trip is off by {error:.3g} px")
    near, _, far, _ = edge_lengths(image_points)
    scale = lambda length: width_m / length if length else math.nan
    return {
        "video": video, "frame_index": frame_index, "video_resolution": list(resolution), "image_points": [list(map(float, p)) for p in image_points], "world_points": world,
        "H": h.tolist(), "H_inv": back.tolist(), "world_width_m": width_m, "world_height_m": height_m, "source": source, "note": note, "timestamp": timestamp,
        "round_trip_error_px": error, "near_edge_scale_m_per_px": scale(near), "far_edge_scale_m_per_px": scale(far),
    }


def foot_point(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    """Middle of a box's lower edge."""
    return (F.col(x1) + F.col(x2)) / 2, F.col(y2)


def centroid(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return (F.col(x1) + F.col(x2)) / 2, (F.col(y1) + F.col(y2)) / 2


def to_ground(h: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """Homography of a point; null on the horizon."""
    line = lambda r: F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2])
    return F.try_divide(line(h[0]), line(h[2])), F.try_divide(line(h[1]), line(h[2]))


def in_bounds(points: Points, x: Column, y: Column) -> Column:
    """Inside the points' bounding box, edges included."""
    xs, ys = zip(*points, strict=True)
    return x.between(float(min(xs)), float(max(xs))) & y.between(float(min(ys)), float(max(ys)))


def _crosses(x: Column, y: Column, a: Sequence[float], b: Sequence[float]) -> Column:
    """Whether a ray from the point meets the edge; its lower end is out, its upper end in."""
    (ax, ay), (bx, by) = map(float, a), map(float, b)
    if ay == by:
        return F.lit(False)
    spans = (y > min(ay, by)) & (y <= max(ay, by)) & (x <= max(ax, bx))
    return spans if ax == bx else spans & (x <= (y - F.lit(ay)) * F.lit(bx - ax) / F.lit(by - ay) + F.lit(ax))


def _odd(points: Points, x: Column, y: Column) -> Column:
    return reduce(lambda a, b: a != b, [_crosses(x, y, a, b) for a, b in zip(points, [*points[1:], points[0]], strict=True)])


def in_polygon(points: Points, x: Column, y: Column) -> Column:
    """Ray casting with half-open edges, behind a bounding-box test that it implies. x and y should be columns of their own: they are
    compared with every edge."""
    return in_bounds(points, x, y) & _odd(points, x, y)


def in_polygon_once(points: Points, x: Column, y: Column) -> Column:
    """As in_polygon, for a point that is an expression: it is worked out once a row, and the edges are tested in a lambda, which is
    not compiled. For filters, as those are moved down and would repeat the expression for every edge."""
    return in_bounds(points, x, y) & F.exists(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda p: _odd(points, p["x"], p["y"]))


#: Of each edge of a quad in a column: its lower and upper end, its right end, and the line through it.
EDGE = ["low", "high", "right", "ax", "ay", "dx", "dy"]


def quad_edges(points: Column) -> dict[str, Column]:
    """Columns _e<k>_<part> for the edges of a quad in a column (array of four [x, y])."""
    found = {}
    for k in range(4):
        (ax, ay), (bx, by) = ((points[j % 4][0], points[j % 4][1]) for j in (k, k + 1))
        parts = (F.least(ay, by), F.greatest(ay, by), F.greatest(ax, bx), ax, ay, bx - ax, F.nullif(by - ay, F.lit(0.0)))
        found |= {f"_e{k}_{n}": p for n, p in zip(EDGE, parts, strict=True)}
    return found


def in_quad_of_edges(x: Column, y: Column) -> Column:
    """As in_polygon, with the columns of quad_edges, so that every row may have its own quad."""

    def crosses(k: int) -> Column:
        low, high, right, ax, ay, dx, dy = (F.col(f"_e{k}_{n}") for n in EDGE)
        spans = (y > low) & (y <= high) & (x <= right)  # a level edge spans nothing
        return spans & F.coalesce((dx == 0) | (x <= (y - ay) * dx / dy + ax), F.lit(False))

    return reduce(lambda a, b: a != b, [crosses(k) for k in range(4)])


def in_polygon_of(points: Column, x: Column, y: Column) -> Column:
    """As in_polygon, for corners in a column (array of [x, y]), so that every row may have its own polygon."""
    n = F.size(points)

    def crosses(k: Column) -> Column:
        (ax, ay), (bx, by) = ((p[0], p[1]) for p in (points[k], points[(k + 1) % n]))
        at = F.when(ax == bx, ax).otherwise(F.try_divide((y - ay) * (bx - ax), by - ay) + ax)
        spans = (y > F.least(ay, by)) & (y <= F.greatest(ay, by)) & (x <= F.greatest(ax, bx))
        return F.when(spans, x <= at).otherwise(False)  # a level edge spans nothing

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda odd, k: odd != crosses(k))


def to_ground_of(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """As to_ground, for a matrix in a column (array of rows)."""
    line = lambda r: h[r][0] * x + h[r][1] * y + h[r][2]
    return F.try_divide(line(0), line(2)), F.try_divide(line(1), line(2))


def tile_overlap(size: Column, ratio: float) -> Column:
    """Overlap in pixels, halves to the even number."""
    return F.bround(size * F.lit(ratio), 0).cast("int")


def shrink_factor(width: Column, height: Column, long_edge: int) -> Column:
    longest = F.greatest(width, height)
    return F.when((F.lit(long_edge) <= 0) | (longest <= long_edge), 1.0).otherwise(F.lit(float(long_edge)) / longest)


def display_factor(height: Column, most: int = 900) -> Column:
    """The factor that shows a frame no higher than `most` pixels; frames are never enlarged."""
    return F.least(F.lit(1.0), F.lit(float(most)) / height)


def scaled(columns: Sequence[str], factor: Column) -> dict[str, Column]:
    """Boxes' or points' coordinates times a factor, to be given to withColumns."""
    return {c: F.col(c) * factor for c in columns}


def window_length(fps: Column, seconds: float) -> Column:
    return F.greatest(F.lit(2), F.bround(fps * F.lit(seconds), 0).cast("int"))


def clamp_box(width: float, height: float) -> dict[str, Column]:
    """Boxes inside the frame and at least a pixel wide and high."""
    x1, y1 = F.least(F.greatest("x1", F.lit(0.0)), F.lit(width - 1)), F.least(F.greatest("y1", F.lit(0.0)), F.lit(height - 1))
    return {"x1": x1, "y1": y1, "x2": F.least(F.greatest("x2", x1 + 1), F.lit(width)), "y2": F.least(F.greatest("y2", y1 + 1), F.lit(height))}
