"""Queries of the run-wide measurements, the frame lookups and the smaller functions. Their SQL is written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundflow.functions import geometry as G
from groundflow.functions.ranks import exact_percentiles
from groundflow.operators import analyses as A
from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.operators import tracks as T
from groundflow.plans import registry as R
from groundflow.plans.registry import query
from groundflow.sources import tables as S

#: A quad with corners between pixels, so that the zone at whole pixels differs from it.
FINE_QUAD = [(780.6, 2142.5), (2640.4, 2141.5), (3051.5, 906.4), (2706.5, 852.6)]
_ZONE = R._polygon([(781.0, 2142.0), (2640.0, 2142.0), (3052.0, 906.0), (2706.0, 853.0)], "foot_x", "foot_y")
_FINE = R._polygon(FINE_QUAD, "foot_x", "foot_y")
_SPLIT = f"(SELECT *, {_ZONE} AS in_zone, {_FINE} AS in_quad, {R._TRACKED} AS track_id FROM (SELECT *, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM det) a) s"


def _split(spark, d):
    boxes = R.detections(spark, d)
    return boxes.withColumns({"in_zone": E.in_zone(FINE_QUAD), "in_quad": G.in_polygon(FINE_QUAD, *G.foot_point()), "track_id": F.expr(R._TRACKED)})


@query("det", sql=f"SELECT frame_idx, count(*) FILTER (NOT in_zone) AS n_outside, count(*) FILTER (in_zone AND track_id >= 0 AND NOT in_quad) AS n_unprojected, count(*) FILTER (NOT in_zone OR track_id >= 0 AND NOT in_quad) AS n_excluded FROM {_SPLIT} GROUP BY 1")
def excluded_per_frame(spark, d):
    return E.excluded(_split(spark, d))


@query("det", sql=f"SELECT CASE WHEN NOT in_zone THEN 'outside' WHEN track_id >= 0 THEN 'tracked' ELSE 'in_quad_untracked' END AS state, count(*) AS n FROM {_SPLIT} GROUP BY 1")
def box_states(spark, d):
    return _split(spark, d).groupBy(E.state().alias("state")).agg(F.count("*").alias("n"))


@query("frames", sql="SELECT * FROM frames WHERE frame_idx IN (1, 7, 33, 64, 99, 20000000)")
def listed_frames(spark, d):
    return S.frames_at(R.frames(spark, d), [1, 7, 33, 64, 99, 20_000_000])


@query("frames", sql="SELECT * FROM frames WHERE frame_idx = 7")
def one_frame(spark, d):
    return S.single_frame(R.frames(spark, d), 7)


@query("frames", sql="SELECT * FROM frames WHERE frame_idx < 500")
def first_frames(spark, d):
    return S.frames_before(R.frames(spark, d), 500)


@query("tframes", sql=f"SELECT frame_idx, t_sec, count(*) OVER (ORDER BY t_sec RANGE BETWEEN {R.WINDOW_S}::DOUBLE PRECEDING AND CURRENT ROW) AS n_frames FROM tframes")
def frames_in_window(spark, d):
    return D.frames_in_window(R.track_frames(spark, d), R.WINDOW_S)


@query("roll", sql="SELECT frame_idx, max(value) AS peak FROM roll GROUP BY 1")
def frame_peaks(spark, d):
    return D.grid_peak(R._rolling(spark, d))


@query("smooth", sql="SELECT max(round(value, 7)) AS peak, arg_max(frame_idx, (round(value, 7), -frame_idx)) AS frame_idx FROM smooth")
def replayed_peak(spark, d):
    found = D.smoothed(R._rolling(spark, d), R.GRID, R.SIGMA).withColumn("value", F.round("value", 7))
    return found.agg(F.max("value").alias("peak"), F.max_by("frame_idx", F.struct("value", -F.col("frame_idx"))).alias("frame_idx"))


_BINS = "(SELECT range::INT AS bin, 0.05::DOUBLE + (0.9::DOUBLE - 0.05::DOUBLE) * range / 10 AS lo, 0.05::DOUBLE + (0.9::DOUBLE - 0.05::DOUBLE) * (range + 1) / 10 AS hi FROM range(10)) b"


@query("det", sql=f"SELECT bin, lo, hi, count(conf) AS n FROM {_BINS} LEFT JOIN det ON conf >= lo AND (conf < hi OR bin = 9 AND conf <= hi) GROUP BY ALL")
def full_histogram(spark, d):
    return A.histogram(R.detections(spark, d), "conf", 0.05, 0.9, 10)


@query("det", sql=f"SELECT bin, lo, hi, count(conf) AS n FROM {_BINS} LEFT JOIN det ON conf >= lo AND conf < hi GROUP BY ALL")
def zoomed_histogram(spark, d):
    return A.zoomed_histogram(R.detections(spark, d), "conf", 0.05, 0.9, 10)


@query("gate", sql="SELECT track_id, accepted, rejected, round(100 * rejected / (accepted + rejected)::DOUBLE, 9) AS rejected_pct FROM (SELECT track_id, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM gate GROUP BY 1) s WHERE rejected > 0 ORDER BY rejected DESC, track_id")
def most_rejected_tracks(spark, d):
    return T.most_rejected(T.speed_gate(R.tracks(spark, d), R.SPEED)).withColumn("rejected_pct", F.round("rejected_pct", 9))


@query("gate", sql="SELECT count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, round(100 * count(*) FILTER (NOT accepted) / count(*)::DOUBLE, 9) AS rejected_pct FROM gate")
def gate_totals(spark, d):
    return T.gate_totals(T.speed_gate(R.tracks(spark, d), R.SPEED)).withColumn("rejected_pct", F.round("rejected_pct", 9))


@query("roll", sql="SELECT count(*) AS n, round(max(value), 9) AS highest, avg((value > 0.5)::INT) AS share_above, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.99), 9) AS p99 FROM roll WHERE value > 0")
def filled_cell_stats(spark, d):
    found = A.filled_cells(R._rolling(spark, d), 0.5)
    return found.withColumns({c: F.round(c, 9) for c in ("highest", "p50", "p90", "p99")})


@query("det", sql="""SELECT any_value(n) AS n, round(any_value(slope), 6) AS slope, round(any_value(intercept), 4) AS intercept, round(sqrt(avg(pow(y2 - y1 - slope * y2 - intercept, 2))), 4) AS residual_std FROM
  (SELECT * FROM det WHERE conf >= 0.5::DOUBLE AND y2 < 2159) p, (SELECT count(*) AS n, regr_slope(y2 - y1, y2) AS slope, regr_intercept(y2 - y1, y2) AS intercept FROM det WHERE conf >= 0.5::DOUBLE AND y2 < 2159) f""")
def height_fit_residuals(spark, d):
    found = A.height_fit(R.detections(spark, d), 2160.0)
    return found.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("residual_std", 4).alias("residual_std"))


_LEFT = (
    R.kept_boxes_sql("frame_idx", "class_id", "tile_source")
    + ", per AS (SELECT frame_idx, tile_source, count(*) AS n FROM kept_boxes GROUP BY 1, 2), ratios AS (SELECT p.frame_idx, p.tile_source, p.n, b.n AS n_base, p.n / b.n::DOUBLE AS ratio FROM per p JOIN per b ON p.frame_idx = b.frame_idx AND b.tile_source = 'untiled') "
)


@query(sql=_LEFT + "SELECT * FROM ratios")
def config_ratios(spark, d):
    return A.config_ratios(R.detections(spark, d), "tile_source", "untiled", 0.3)


@query(sql=_LEFT + "SELECT tile_source, round(avg(ratio), 9) AS mean_ratio, count(*) AS n_frames FROM ratios GROUP BY 1")
def config_mean_ratios(spark, d):
    return A.mean_ratios(config_ratios(spark, d), "tile_source").withColumn("mean_ratio", F.round("mean_ratio", 9))


@query("det", sql="SELECT tile_source, frame_idx, count(*) FILTER (conf_pct >= 3 AND conf_pct < 4) AS n_between, count(*) AS n, count(*) FILTER (conf_pct >= 3 AND conf_pct < 4) / count(*)::DOUBLE AS share FROM det GROUP BY 1, 2")
def low_conf_by_frame(spark, d):
    return A.share_between(R.detections(spark, d), 3, 4, ["tile_source", "frame_idx"], "conf_pct")


_MATCHES = "(SELECT frame_idx % 11 AS second, x1 AS x0, y1 AS y0, x1 + conf_pct AS x, y1 - conf_pct / 2 AS y FROM det) m"


def _matches(spark, d):
    return R.detections(spark, d).selectExpr("frame_idx % 11 AS second", "x1 AS x0", "y1 AS y0", "x1 + conf_pct AS x", "y1 - conf_pct / 2D AS y")


@query("det", sql=f"SELECT second, round(quantile_cont(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)), 0.5), 9) AS median_px, round(max(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0))), 9) AS max_px FROM {_MATCHES} GROUP BY 1")
def drift_by_second(spark, d):
    return A.drift_by_second(_matches(spark, d)).withColumns({c: F.round(c, 9) for c in ("median_px", "max_px")})


@query("det", sql=f"""SELECT round(quantile_cont(m, 0.5), 9) AS median_px, round(quantile_cont(m, 0.9), 9) AS p90_px, round(max(top), 9) AS max_px, quantile_cont(m, 0.5) <= 2 AS fixed
  FROM (SELECT second, quantile_cont(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)), 0.5) AS m, max(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0))) AS top FROM {_MATCHES} GROUP BY 1) s""")
def camera_drift(spark, d):
    return A.drift(_matches(spark, d)).withColumns({c: F.round(c, 9) for c in ("median_px", "p90_px", "max_px")})


@query("det", sql="""SELECT h.frame_idx, n_hand, coalesce(n, 0) AS n, n_hand - coalesce(n, 0) AS missed, 100 * (n_hand - coalesce(n, 0)) / n_hand::DOUBLE AS missed_pct
  FROM (SELECT o_orderkey AS frame_idx, 5 + o_orderkey % 4 AS n_hand FROM orders WHERE o_orderkey % 20 = 0) h LEFT JOIN (SELECT frame_idx, count(*) AS n FROM det GROUP BY 1) c USING (frame_idx)""")
def hand_count_misses(spark, d):
    by_hand = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 20 = 0").selectExpr("o_orderkey AS frame_idx", "5 + o_orderkey % 4 AS n_hand")
    return A.against_hand_count(R.detections(spark, d).groupBy("frame_idx").agg(F.count("*").alias("n")), by_hand)


@query("trk", sql="""SELECT pick, frame_idx, n FROM (SELECT *, row_number() OVER (PARTITION BY pick ORDER BY score DESC, frame_idx) AS place FROM (SELECT c.*, p.pick,
    CASE pick WHEN 'fewest' THEN -n WHEN 'most' THEN n WHEN 'middle' THEN -abs(2 * n - low - high) WHEN 'late' THEN CASE WHEN frame_idx >= last * 0.75::DOUBLE THEN n END END AS score
  FROM (SELECT *, min(n) OVER () AS low, max(n) OVER () AS high, max(frame_idx) OVER () AS last FROM (SELECT frame_idx, count(*) AS n FROM trk WHERE frame_idx % 15 = 0 GROUP BY 1) a) c, (VALUES ('fewest'), ('most'), ('middle'), ('late')) p(pick)) s WHERE score IS NOT NULL) r WHERE place = 1""")
def chosen_frames(spark, d):
    return A.frames_by_count(R.tracks(spark, d).groupBy("frame_idx").agg(F.count("*").alias("n")))


@query("proj", sql=f"""SELECT frame_idx, round(sqrt(pow(world_x - {R._line(R.H[0]).replace('foot_y', 'cy')} / {R._line(R.H[2]).replace('foot_y', 'cy')}, 2) + pow(world_y - {R._line(R.H[1]).replace('foot_y', 'cy')} / {R._line(R.H[2]).replace('foot_y', 'cy')}, 2)), 6) AS gap_m
  FROM (SELECT *, (y1 + y2) / 2 AS cy FROM proj) p WHERE in_quad""")
def foot_centroid_distance(spark, d):
    x, y = G.to_ground(R.H, *G.centroid())
    gap = F.hypot(F.col("world_x") - x, F.col("world_y") - y)
    return R.inside(spark, d).select("frame_idx", F.round(gap, 6).alias("gap_m"))


@query("det", "frames", sql="""SELECT (SELECT count(*) FROM frames) AS n_frames, sum(n)::DOUBLE / (SELECT count(*) FROM frames) AS mean_n, min(n) AS min_n, max(n) AS max_n, (SELECT count(DISTINCT frame_idx % 93) FROM det WHERE conf_pct >= 5) AS n_ids,
  (SELECT sum(conf_pct) / count(*)::DOUBLE FROM det) AS mean_pct, (SELECT quantile_cont(conf_pct::DOUBLE, 0.1) FROM det) AS p10, (SELECT quantile_cont(conf_pct::DOUBLE, 0.9) FROM det) AS p90 FROM """ + R._COUNTS)
def detection_run_summary(spark, d):
    boxes = R.detections(spark, d)
    per = R._counts(spark, d).agg(F.lit(0).alias("whole"), F.count("*").alias("n_frames"), (F.sum("n").cast("double") / F.count("*")).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))
    ids = boxes.agg(F.lit(0).alias("whole"), F.count_distinct(F.when(F.col("conf_pct") >= 5, F.col("frame_idx") % 93)).alias("n_ids"), (F.sum("conf_pct") / F.count("*")).alias("mean_pct"))
    ranks = exact_percentiles(boxes, "conf_pct", [0.1, 0.9]).select(F.lit(0).alias("whole"), F.col("p0").alias("p10"), F.col("p1").alias("p90"))
    return per.join(F.broadcast(ids), "whole").join(F.broadcast(ranks), "whole").drop("whole")  # a row each


@query("dens", sql=f"""SELECT s.*, c.max_cell_frame, n.n_records, b.busiest FROM
  (SELECT count(*) AS n_frames, sum(in_quad)::BIGINT AS persons, round(avg(in_quad) / 90, 9) AS mean_density, max(density) AS max_density, arg_max(frame_idx, (density, -frame_idx)) AS max_frame, arg_max(t_sec, (density, -frame_idx)) AS max_t, max(coalesce(peak_cell_density, 0)) AS max_cell_density FROM dens) s,
  (SELECT arg_max(frame_idx, (coalesce(peak_cell_density, 0), -frame_idx)) AS max_cell_frame FROM dens) c, (SELECT count(*) AS n_records FROM proj) n,
  (SELECT ci || ' ' || cj || ' ' || n AS busiest FROM (SELECT CAST(floor(world_x) AS BIGINT) AS ci, CAST(floor(world_y) AS BIGINT) AS cj, count(*) AS n FROM proj WHERE in_quad GROUP BY 1, 2 ORDER BY n DESC, min(frame_idx), ci, cj LIMIT 1) q) b""")
def density_report(spark, d):
    records = R.projected(spark, d).withColumns({"x": F.col("world_x"), "y": F.col("world_y")})
    found = D.density_report(R.frame_density(spark, d), records, R.AREA, 1.0)
    return found.withColumns({"busiest": F.array_join("busiest", " "), "mean_density": F.round("mean_density", 9)})


def _eased(k: int) -> str:
    (a, b, c) = ((200, 0, 0), (255, 170, 30), (255, 255, 255))[k]
    last = (0, 0, 255)[k]
    return f"CAST(trunc(CASE WHEN v < 2 THEN {a} + v / 2::DOUBLE * {b - a} WHEN v < 2.5 THEN {b} + (v - 2) / 0.5::DOUBLE * {c - b} WHEN v < 4 THEN {c} + (v - 2.5::DOUBLE) / 1.5::DOUBLE * {last - c} ELSE {last} END) AS INT)"


@query("roll", sql=f'SELECT frame_idx, col, "row", {_eased(0)} AS b, {_eased(1)} AS g, {_eased(2)} AS r FROM (SELECT *, least(value * 2, 4::DOUBLE) AS v FROM roll) s')
def density_colour_eased(spark, d):
    top = D.to_ramp(F.col("value") * 2, D.scale("density"))
    return R._rolling(spark, d).select("frame_idx", "col", "row", D.colour(top, D.STOPS_EASED).alias("c")).select("frame_idx", "col", "row", "c.b", "c.g", "c.r")


@query("roll", sql='SELECT DISTINCT round(value, 6) AS value, round_even(40 + (1 - least(greatest(round(value, 6) / 3, 0), 1)) * 520, 0)::INT AS tick FROM roll')
def legend_ticks(spark, d):
    values = R._rolling(spark, d).select(F.round("value", 6).alias("value")).distinct()
    return values.withColumn("tick", D.legend_tick(F.col("value"), D.scale("count"), 40, 520))


@query(sql="SELECT p_partkey, round_even(p_size * 0.5::DOUBLE, 0)::INT AS overlap, greatest(2, round_even(p_size * 0.25::DOUBLE, 0)::INT) AS window_frames, least(1, 20 / p_size::DOUBLE) AS factor FROM part")
def pixel_sizes(spark, d):
    size = F.col("p_size")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", G.tile_overlap(size, 0.5).alias("overlap"), G.window_length(size, 0.25).alias("window_frames"), G.display_factor(size, 20).alias("factor"))


@query("det", sql="SELECT frame_idx, x1 * 0.25::DOUBLE AS x1, y1 * 0.25::DOUBLE AS y1, x2 * 0.25::DOUBLE AS x2, y2 * 0.25::DOUBLE AS y2 FROM det")
def display_boxes(spark, d):
    return R.detections(spark, d).withColumns(G.scaled(E.BOX, G.display_factor(F.lit(2160), 540))).select("frame_idx", *E.BOX)


@query(sql="SELECT c_custkey, c_name || '.take' || c_nationkey AS stem FROM customer")
def output_names(spark, d):
    path = F.concat(F.lit("/videos/day.1/"), "c_name", F.lit(".take"), F.col("c_nationkey").cast("string"), F.lit(".mp4"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", A.file_stem(path).alias("stem"))


@query(sql="SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS made, count(*) AS n FROM events GROUP BY 1")
def calibration_times(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(A.iso_utc(F.col("ts")).alias("made")).agg(F.count("*").alias("n"))


@query("roll", sql='SELECT frame_idx, t_sec, col, "row", value FROM roll WHERE value > 0')
def sparse_rolling_density(spark, d):
    """The rolling density that is not 0, from spans of time in which a cell's number of persons is constant."""
    frames = R.track_frames(spark, d)
    spans = D.rolling_intervals(R.tracks(spark, d).drop("t_sec"), frames, R.GRID, R.WINDOW_S)
    return D.rolling_values(spans, frames, R.WINDOW_S).select("frame_idx", "t_sec", "col", "row", "value")


@query("trk", "tframes", sql=f"""SELECT s.segment, s.frame_idx, s.col, s."row", s.value FROM (SELECT segment, frame_idx, col, "row", sum(coalesce(n, 0)) OVER w / (count(*) OVER w)::DOUBLE AS value
  FROM (SELECT *, (frame_idx >= 200)::INT + (frame_idx >= 500)::INT AS segment FROM tframes) f CROSS JOIN (SELECT CAST(range AS INT) AS col FROM range(10)) a CROSS JOIN (SELECT CAST(range AS INT) AS "row" FROM range(10)) b
  LEFT JOIN (SELECT frame_idx, CAST(floor(x / 10) AS INT) AS col, CAST(floor(y / 10) AS INT) AS "row", count(*) AS n FROM trk WHERE x >= 0 AND x < 100 AND y >= 0 AND y < 100 GROUP BY ALL) c USING (frame_idx, col, "row")
  WINDOW w AS (PARTITION BY segment, col, "row" ORDER BY t_sec RANGE BETWEEN {R.WINDOW_S}::DOUBLE PRECEDING AND CURRENT ROW)) s WHERE value > 0""")
def density_between_resets(spark, d):
    """Rolling density whose window is emptied at frames 200 and 500."""
    resets = spark.createDataFrame([(200,), (500,)], "frame_idx long")
    frames, points = (D.cut_at(df, resets) for df in (R.track_frames(spark, d), R.tracks(spark, d).drop("t_sec")))
    found = D.rolling(points, frames, R.GRID, R.WINDOW_S, ["segment"]).where("value > 0")
    return found.select("segment", "frame_idx", "col", "row", "value")


@query("det", sql="SELECT frame_idx, n, n_sure, (sum(n) OVER w)::BIGINT AS n_so_far, (sum(n_sure) OVER w)::BIGINT AS n_sure_so_far FROM (SELECT frame_idx, count(*) AS n, count(*) FILTER (conf_pct >= 5) AS n_sure FROM det GROUP BY 1) s WINDOW w AS (ORDER BY frame_idx)")
def frame_totals_so_far(spark, d):
    """Boxes of each frame and up to it, over one stream that no task holds whole."""
    per = R.detections(spark, d).groupBy(F.lit(0).alias("stream_id"), "frame_idx").agg(F.count("*").alias("n"), F.count_if(F.col("conf_pct") >= 5).alias("n_sure"))
    return E.running_totals(per, ["n", "n_sure"], ["stream_id"], 2_000).drop("stream_id")
