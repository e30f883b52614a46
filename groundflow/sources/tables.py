"""Readers and writers of the engine's files, with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundflow import schema


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """A calibration document."""
    return spark.read.schema(schema.CALIBRATION).option("multiLine", True).json(path)


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Calibrations as write_calibrations leaves them, one a line."""
    return spark.read.schema(schema.CALIBRATION).json(path)


def calibration_of(calibrations: DataFrame, video: str) -> dict:
    """One video's calibration as a dict; raises if there is none."""
    found = calibrations.where(F.col("video") == video).head(1)
    if not found:
        raise LookupError(f"no calibration for {video!r}: make one with geometry.calibration_record and write_calibrations")
    return found[0].asDict(recursive=True)


def write_calibrations(spark: SparkSession, records: Sequence[dict], path: str) -> None:
    """Calibration records (geometry.calibration_record), one a line."""
    spark.createDataFrame([tuple(r[c] for c in schema.names(schema.CALIBRATION)) for r in records], schema.CALIBRATION).coalesce(1).write.json(path)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Known cameras: position, point looked at, up direction, field of view and picture size."""
    return spark.read.schema(schema.CAMERA).option("multiLine", True).json(path).select("camera.*")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, frame_idx, image of pictures stored as .../<stream>/<frame number>.<suffix>; other files are passed over.

    Spark lists and reads the files; pictures stay encoded, for a detector to open."""
    return _frames(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """As read_frames, for pictures that keep arriving."""
    files = spark.read.format("binaryFile").load(path + "/*/*").schema
    return _frames(spark.readStream.format("binaryFile").schema(files).load(path + "/*/*"))


def _frames(files: DataFrame) -> DataFrame:
    named = files.select(F.regexp_extract("path", r"([^/]+)/(\d+)\.[^/.]+$", 1).alias("stream_id"), F.regexp_extract("path", r"/(\d+)\.[^/.]+$", 1).alias("n"), F.col("content").alias("image"))
    return named.where("n <> ''").select("stream_id", F.col("n").cast("long").alias("frame_idx"), "image")


def frames_at(frames: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """The listed frames; those that are missing are simply not there. The filter reaches the scan."""
    return frames.where(F.col("frame_idx").isin(list(wanted)))


def single_frame(frames: DataFrame, frame_idx: int) -> DataFrame:
    """One frame, of every stream in the table; raises if there is none."""
    found = frames.where(F.col("frame_idx") == frame_idx)
    if found.isEmpty():
        raise LookupError(f"there is no frame {frame_idx}")
    return found


def frames_before(frames: DataFrame, n: int) -> DataFrame:
    """The first n frames by number (0: all)."""
    return frames.where(F.col("frame_idx") < n) if n else frames


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TRUTH).json(path)


def read_trajectory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Missing world coordinates are written as nan and come back as null."""
    found = spark.read.schema(schema.TRAJECTORY).option("header", True).option("nanValue", "nan").csv(path)
    return found.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in ("world_x_m", "world_y_m")})


def trajectory(detections: DataFrame) -> DataFrame:
    """The fourteen trajectory columns from projected, confirmed detections."""
    nan = F.lit(float("nan"))
    return detections.where("track_id >= 0").select(
        "frame_idx", F.col("t_sec").alias("timestamp_s"), "track_id", *[F.col(c).alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")], "conf",
        F.col("foot_x").alias("foot_px_x"), F.col("foot_y").alias("foot_px_y"), F.coalesce("world_x", nan).alias("world_x_m"), F.coalesce("world_y", nan).alias("world_y_m"), F.col("in_quad").cast("int"), "tile_source",
    )


def write_trajectory_csv(rows: DataFrame, path: str) -> None:
    rows.select(schema.names(schema.TRAJECTORY)).write.option("header", True).option("nanValue", "nan").csv(path)


def write_trajectory_parquet(rows: DataFrame, path: str) -> None:
    rows.select(schema.names(schema.TRAJECTORY)).write.parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Velocity records, density series, summaries: one object a line."""
    rows.write.json(path)


def write_density_run(summary: DataFrame, series: DataFrame, path: str) -> None:
    """A density run: its summary and its series, each as JSON lines in a folder of its own."""
    for name, rows in (("summary", summary), ("density_over_time", series)):
        rows.write.json(f"{path}/{name}")


def frame_spine(videos: DataFrame) -> DataFrame:
    """Every frame of every video with its time; a video without a frame rate counts as 30 a second."""
    fps = F.when(F.col("fps") == 0, 30.0).otherwise(F.col("fps"))
    return videos.select("stream_id", fps.alias("fps"), F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_idx")).withColumn("t_sec", F.col("frame_idx") / F.col("fps"))
