"""Measurements over whole runs: fits, histograms, comparisons of detector settings, camera drift, samples of frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundflow.functions.ranks import exact_percentiles
from groundflow.operators.detections import suppress


def height_fit(boxes: DataFrame, frame_height: float, least_conf: float = 0.5) -> DataFrame:
    """Least-squares fit of a box's height to the row of its foot: n, slope, intercept, r2 and the residuals' standard
    deviation (population). Boxes that touch the frame's lower edge or are less sure are left out."""
    used = boxes.where((F.col("conf") >= least_conf) & (F.col("y2") < frame_height - 1)).select((F.col("y2") - F.col("y1")).alias("h"), "y2")
    fit = used.agg(F.count("*").alias("n"), F.regr_slope("h", "y2").alias("slope"), F.regr_intercept("h", "y2").alias("intercept"), F.regr_r2("h", "y2").alias("r2"), F.regr_syy("h", "y2").alias("syy"))
    left = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") * (1 - F.col("r2"))) / F.col("n"))  # one pass: what the fit leaves of the spread
    return fit.withColumn("residual_std", left).drop("syy")


def histogram(values: DataFrame, column: str, low: float, high: float, n_bins: int) -> DataFrame:
    """bin, lo, hi, n for every bin of equal width, empty ones too: [lo, hi), but the last bin includes its upper edge.

    Values outside are not counted. A value belongs to the bin whose edges, as doubles, enclose it."""
    edges = [low + (high - low) * k / n_bins for k in range(n_bins + 1)]
    v = F.col(column)
    guess = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor((v - low) / ((high - low) / n_bins)).cast("int")))
    at = F.array(*map(F.lit, edges))
    right = F.when(v < at[guess], guess - 1).when((guess < n_bins - 1) & (v >= at[guess + 1]), guess + 1).otherwise(guess)
    counts = values.where((v >= low) & (v <= high)).groupBy(right.alias("bin")).agg(F.count("*").alias("n"))
    spine = values.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", at[F.col("bin")].alias("lo"), at[F.col("bin") + 1].alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def zoomed_histogram(values: DataFrame, column: str, low: float, high: float, n_bins: int) -> DataFrame:
    """As histogram, over values below `high` alone: every bin is [lo, hi)."""
    return histogram(values.where(F.col(column) < high), column, low, high, n_bins)


def config_counts(boxes: DataFrame, config: str, threshold: float = 0.7, streams: Sequence[str] = ()) -> DataFrame:
    """Boxes left after overlap suppression, of every frame and configuration."""
    return suppress(boxes, threshold, [*streams, config]).groupBy(*streams, "frame_idx", config).agg(F.count("*").alias("n"))


def config_ratios(boxes: DataFrame, config: str, baseline: str, threshold: float = 0.7, streams: Sequence[str] = ()) -> DataFrame:
    """What each configuration finds in a frame, as a multiple of the baseline's boxes there; frames without any of the
    baseline's are left out."""
    counts = config_counts(boxes, config, threshold, streams)
    base = F.max(F.when(F.col(config) == baseline, F.col("n"))).over(Window.partitionBy(*streams, "frame_idx"))  # a row a configuration
    return counts.withColumn("n_base", base).where("n_base is not null").withColumn("ratio", F.col("n") / F.col("n_base"))


def mean_ratios(ratios: DataFrame, config: str) -> DataFrame:
    return ratios.groupBy(config).agg(F.avg("ratio").alias("mean_ratio"), F.count("*").alias("n_frames"))


def share_between(boxes: DataFrame, low: float, high: float, by: Sequence[str], column: str = "conf") -> DataFrame:
    """Of each group the boxes with low <= conf < high, all boxes, and the share."""
    part = F.count_if((F.col(column) >= low) & (F.col(column) < high))
    return boxes.groupBy(*by).agg(part.alias("n_between"), F.count("*").alias("n")).withColumn("share", F.col("n_between") / F.col("n"))


def drift(matches: DataFrame, gate_px: float = 2.0) -> DataFrame:
    """One row: the median and 90th percentile of the seconds' median shifts, the largest shift, and whether the camera is
    fixed. matches: second, and the same point's place in the first frame (x0, y0) and then (x, y)."""
    shift = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    each = exact_percentiles(matches.select("second", shift.alias("shift")), "shift", [0.5, 1.0], ["second"])
    found = exact_percentiles(each, "p0", [0.5, 0.9]).select(F.lit(0).alias("whole"), F.col("p0").alias("median_px"), F.col("p1").alias("p90_px"))
    most = each.agg(F.lit(0).alias("whole"), F.max("p1").alias("max_px"))
    return found.join(F.broadcast(most), "whole").drop("whole").withColumn("fixed", F.col("median_px") <= gate_px)  # a row each


def drift_by_second(matches: DataFrame) -> DataFrame:
    """second, median_px and max_px of the shifts."""
    shift = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    return exact_percentiles(matches.select("second", shift.alias("shift")), "shift", [0.5, 1.0], ["second"]).select("second", F.col("p0").alias("median_px"), F.col("p1").alias("max_px"))


def filled_cells(grid_values: DataFrame, most: float = 4.0) -> DataFrame:
    """One row over the cells that are not empty: their number, 50th, 90th and 99th percentile, highest value, and the share
    above `most`."""
    filled = grid_values.where("value > 0")
    totals = filled.agg(F.lit(0).alias("whole"), F.count("*").alias("n"), F.max("value").alias("highest"), F.avg((F.col("value") > most).cast("double")).alias("share_above"))
    ranks = exact_percentiles(filled, "value", [0.5, 0.9, 0.99]).select(F.lit(0).alias("whole"), *[F.col(f"p{k}").alias(c) for k, c in enumerate(("p50", "p90", "p99"))])
    return totals.join(F.broadcast(ranks), "whole").drop("whole")  # a row each


def frames_by_count(counts: DataFrame, every: int = 15, late: float = 0.75, streams: Sequence[str] = ()) -> DataFrame:
    """Four frames to look at, chosen among every so many-th: the fewest and the most boxes, the count nearest the middle
    between them, and the most in the last part of the recording. Ties go to the earlier frame. counts: frame_idx, n."""
    by = list(streams) or ["whole"]
    some = counts.where(F.col("frame_idx") % every == 0)
    some = some if streams else some.withColumn("whole", F.lit(0))
    ends = some.groupBy(*by).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("frame_idx").alias("last"))
    wide = some.join(ends, by)
    first = -F.col("frame_idx")
    near = F.struct(-F.abs(F.col("n") * 2 - F.col("low") - F.col("high")), first)
    is_late = F.when(F.col("frame_idx") >= F.col("last") * late, F.struct("n", first))
    picks = {"fewest": F.struct(-F.col("n"), first), "most": F.struct("n", first), "middle": near, "late": is_late}
    found = wide.groupBy(*by).agg(*[F.max_by(F.struct("frame_idx", "n"), order).alias(name) for name, order in picks.items()])
    rows = found.select(*by, F.inline(F.array(*[F.struct(F.lit(name).alias("pick"), F.col(f"{name}.frame_idx"), F.col(f"{name}.n")) for name in picks])))
    return rows.where("frame_idx is not null") if streams else rows.where("frame_idx is not null").drop("whole")


def against_hand_count(counts: DataFrame, by_hand: DataFrame, streams: Sequence[str] = ()) -> DataFrame:
    """Persons counted by hand (frame_idx, n_hand) that the detector missed, and their percentage; a frame without boxes
    misses all."""
    found = by_hand.join(counts, [*streams, "frame_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    missed = F.col("n_hand") - F.col("n")
    return found.withColumns({"missed": missed, "missed_pct": F.try_divide(missed * F.lit(100.0), F.col("n_hand"))})


def file_stem(path: Column) -> Column:
    """A file's name without folders and its last suffix, by which outputs are named."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def iso_utc(time: Column) -> Column:
    """A time as an ISO-8601 text in UTC to the second, as calibrations carry it. Times without a zone are UTC already."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
