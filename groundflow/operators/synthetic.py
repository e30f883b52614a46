"""Synthetic detections from known positions: missed persons, false boxes, jitter and confidences.

All chance comes from hashes of the seed and a row's keys, so a repeated task gives the same rows. The camera is known by
its homography only: a person's box stands on the foot point, is as wide as the person's width on the ground, and has the
person's proportions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundflow.functions.geometry import clamp_box, to_ground


@dataclass(frozen=True)
class Noise:
    seed: int = 1
    dropout: float = 0.05
    false_per_frame: float = 0.5
    jitter_px: float = 2.0
    conf_mean: float = 0.75
    conf_std: float = 0.1
    person_width_m: float = 0.5
    person_height_m: float = 1.7
    class_id: int = 0


def uniform(seed: int, salt: str, *keys: str, part: int = 0) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the keys; a hash has two such parts."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1 + 13 * part, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal(seed: int, salt: str, *keys: str) -> Column:
    """A standard normal number (Box and Muller) from one hash."""
    far = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(seed, salt, *keys)))
    return far * F.cos(F.lit(2 * math.pi) * uniform(seed, salt, *keys, part=1))


def poisson_steps(mean: float) -> list[float]:
    """The distribution function up to where it cannot be told from 1."""
    term = total = math.exp(-mean)
    steps = [total]
    while 1.0 - total > 1e-15 and term > 1e-18:
        term *= mean / len(steps)
        total += term
        steps.append(total)
    return steps


def detect(truth: DataFrame, frames: DataFrame, h_inv: list[list[float]], width: int, height: int, noise: Noise = Noise()) -> DataFrame:
    """Boxes of the persons in truth (stream_id, frame_idx, agent_id, x_world, y_world) and false ones in frames
    (stream_id, frame_idx), with truth_agent_id (-1: false) and det_id within a frame and agent."""
    s, half = noise.seed, F.lit(noise.person_width_m / 2)
    ratio = noise.person_height_m / noise.person_width_m
    seen = truth.where(uniform(s, "drop", "stream_id", "frame_idx", "agent_id") >= noise.dropout)
    x, y = F.col("x_world"), F.col("y_world")
    foot, left, right = (to_ground(h_inv, at, y) for at in (x, x - half, x + half))
    w = F.abs(right[0] - left[0])
    true = seen.select("stream_id", "frame_idx", F.col("agent_id").alias("truth_agent_id"), F.lit(0).alias("det_id"), foot[0].alias("cx"), foot[1].alias("y2"), w.alias("w"), (w * ratio).alias("h")).where("w is not null")
    chance = uniform(s, "false", "stream_id", "frame_idx")
    n = sum((F.when(chance >= v, 1).otherwise(0) for v in poisson_steps(noise.false_per_frame)), F.lit(0))
    more = frames.withColumn("n", n).where("n > 0").select("stream_id", "frame_idx", F.explode(F.sequence(F.lit(1), "n")).alias("det_id"))
    tall = height * 0.15
    middle = uniform(s, "false.y", "stream_id", "frame_idx", "det_id") * F.lit(float(height))
    false = more.select("stream_id", "frame_idx", F.lit(-1).cast("long").alias("truth_agent_id"), "det_id", (uniform(s, "false.x", "stream_id", "frame_idx", "det_id") * F.lit(float(width))).alias("cx"), (middle + F.lit(tall / 2)).alias("y2"), F.lit(tall / ratio).alias("w"), F.lit(tall).alias("h"))
    boxes = true.unionByName(false)
    keys = ("stream_id", "frame_idx", "truth_agent_id", "det_id")
    boxes = boxes.withColumns({"x1": F.col("cx") - F.col("w") / 2, "y1": F.col("y2") - F.col("h"), "x2": F.col("cx") + F.col("w") / 2})
    if noise.jitter_px > 0:
        boxes = boxes.withColumns({c: F.col(c) + normal(s, c, *keys) * F.lit(noise.jitter_px) for c in ("x1", "y1", "x2", "y2")})
    conf = F.lit(noise.conf_mean) + normal(s, "conf", *keys) * F.lit(noise.conf_std)
    boxes = boxes.withColumns(clamp_box(float(width), float(height)))
    return boxes.select(*keys, "x1", "y1", "x2", "y2", F.least(F.greatest(conf, F.lit(0.01)), F.lit(1.0)).alias("conf"), F.lit(noise.class_id).alias("class_id"))
