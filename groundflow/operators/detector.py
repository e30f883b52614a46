"""Where a detector is plugged in: frames in, boxes out. No model is shipped.

`make()` is called once a task and returns detect(image, x, y, width, height) -> [(x1, y1, x2, y2, conf, class_id)], with
boxes in the coordinates of the part of the image that it was given. `streams` names the columns that tell cameras apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundflow.operators.detections import Tiling, suppress, tile_starts

BOXES = "tile_x integer, tile_y integer, x1 double, y1 double, x2 double, y2 double, conf double, class_id integer"


def detect(parts: DataFrame, make: Callable[[], Callable], least_conf: float | None = None, streams: list[str] | None = None) -> DataFrame:
    """Boxes, in whole-frame coordinates, of parts (frame_idx, image, tile_x, tile_y, tile_w, tile_h)."""
    keys = [*(streams or []), "frame_idx"]
    schema = parts.select(*keys).schema
    for c in BOXES.split(", "):
        schema = schema.add(*c.split())
    names = schema.names

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in found:
            rows = []
            for key, p in zip(batch[keys].itertuples(index=False, name=None), batch.itertuples(index=False), strict=True):
                for x1, y1, x2, y2, conf, class_id in model(p.image, p.tile_x, p.tile_y, p.tile_w, p.tile_h):
                    if least_conf is None or conf >= least_conf:
                        rows.append((*key, p.tile_x, p.tile_y, x1 + p.tile_x, y1 + p.tile_y, x2 + p.tile_x, y2 + p.tile_y, conf, class_id))
            yield pd.DataFrame(rows, columns=names)

    return parts.select(*keys, "image", "tile_x", "tile_y", "tile_w", "tile_h").mapInPandas(run, schema)


def tiles(frames: DataFrame, width: int, height: int, tiling: Tiling = Tiling()) -> DataFrame:
    """Every frame once for each of its overlapping tiles; the last ones end at the frame's edge."""
    across, down = tiling.overlap
    cut = frames.withColumn("tile_x", F.explode(tile_starts(width, tiling.width, across))).withColumn("tile_y", F.explode(tile_starts(height, tiling.height, down)))
    return cut.withColumns({"tile_w": F.least(F.lit(tiling.width), F.lit(width) - F.col("tile_x")), "tile_h": F.least(F.lit(tiling.height), F.lit(height) - F.col("tile_y"))})


def detect_whole(frames: DataFrame, make: Callable, width: int, height: int, least_conf: float | None = None, streams: list[str] | None = None) -> DataFrame:
    whole = frames.select(*(streams or []), "frame_idx", "image", F.lit(0).alias("tile_x"), F.lit(0).alias("tile_y"), F.lit(width).alias("tile_w"), F.lit(height).alias("tile_h"))
    return detect(whole, make, least_conf, streams).drop("tile_x", "tile_y")


def detect_tiled(frames: DataFrame, make: Callable, width: int, height: int, tiling: Tiling = Tiling(), streams: list[str] | None = None) -> DataFrame:
    """Boxes found tile by tile; of those that two tiles saw, the surer one stays."""
    return suppress(detect(tiles(frames, width, height, tiling), make, tiling.least_conf, streams), tiling.threshold, streams)


def detector(make: Callable, width: int, height: int, tiling: Tiling | None = Tiling(), long_edge: int = 0, least_conf: float | None = None, streams: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A detector put together from its parts, for DataFrame.transform: tiled unless `tiling` is None, and on pictures that
    were made smaller to a `long_edge` (0: as they are), whose boxes are scaled back to the width x height frame."""
    shrink = 1.0 if long_edge <= 0 or max(width, height) <= long_edge else long_edge / max(width, height)
    w, h = round(width * shrink), round(height * shrink)

    def run(frames: DataFrame) -> DataFrame:
        found = detect_tiled(frames, make, w, h, tiling, streams) if tiling else detect_whole(frames, make, w, h, least_conf, streams)
        return found.withColumns({c: F.col(c) / F.lit(shrink) for c in ("x1", "y1", "x2", "y2")}) if shrink != 1.0 else found

    return run


def tile_counters(boxes: DataFrame, threshold: float = 0.7, streams: list[str] | None = None) -> DataFrame:
    """Per frame: boxes before and after overlap suppression."""
    keys = [*(streams or []), "frame_idx"]
    before = boxes.groupBy(*keys).agg(F.count("*").alias("n_before"))
    after = suppress(boxes, threshold, streams).groupBy(*keys).agg(F.count("*").alias("n_after"))
    return before.join(after, keys)
