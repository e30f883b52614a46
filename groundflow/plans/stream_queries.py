"""Queries over several cameras at once: whatever is numbered within a camera is keyed by the camera too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundflow.functions import geometry as G
from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.operators import detector as P
from groundflow.operators import tracks as T
from groundflow.plans import registry as R
from groundflow.plans.registry import query

STREAM = ["stream_id"]
SPEED, SAMPLES, WINDOW_S = 40.0, 4, 0.5
GRID = D.Grid(-3.0, 0.0, 1.5, 4, 8)

#: Walkers as tracks: numbers run from 0 to 6 in every camera, so that all cameras use the same ones.
_WALK = "SELECT stream_id, agent_id % 7 AS track_id, frame_idx, frame_idx / CAST(30 AS DOUBLE) AS t_sec, x_world AS x, y_world AS y FROM"
R.SQL["walk"] = f"walk AS ({_WALK} ({R.WALKERS} FROM customer, (SELECT range AS k FROM range(40)) s) q)"
R.SQL["wframes"] = "wframes AS (SELECT n_nationkey AS stream_id, range AS frame_idx, range / CAST(30 AS DOUBLE) AS t_sec FROM nation, range(340))"
R.SQL["cams"] = f"""cams AS (SELECT CASE WHEN tile_source = 'tiled' THEN 0 ELSE 1 END AS stream_id, * FROM det),
split AS (SELECT *, CASE WHEN stream_id = 0 THEN {R._polygon(R.QUAD, 'foot_x', 'foot_y')} ELSE {R._polygon([(100.0, 2100.0), (1900.0, 2050.0), (1700.0, 300.0), (400.0, 350.0)], 'foot_x', 'foot_y')} END AS in_quad FROM (SELECT *, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM cams) a)"""
R.SQL["wgate"] = f"""seq AS (SELECT *, row_number() OVER (PARTITION BY stream_id, track_id ORDER BY t_sec, x, y, frame_idx) AS k FROM walk),
wgate AS (SELECT stream_id, track_id, k, t_sec, x, y, true AS accepted, t_sec AS lt, x AS lx, y AS ly FROM seq WHERE k = 1
  UNION ALL SELECT s.stream_id, s.track_id, s.k, s.t_sec, s.x, s.y, ok, CASE WHEN ok THEN s.t_sec ELSE lt END, CASE WHEN ok THEN s.x ELSE lx END, CASE WHEN ok THEN s.y ELSE ly END
  FROM (SELECT s.*, g.lt, g.lx, g.ly, NOT (s.t_sec - g.lt > 0 AND sqrt((s.x - g.lx)*(s.x - g.lx) + (s.y - g.ly)*(s.y - g.ly)) / nullif(s.t_sec - g.lt, 0) > {SPEED}::DOUBLE) AS ok
  FROM wgate g JOIN seq s ON s.stream_id = g.stream_id AND s.track_id = g.track_id AND s.k = g.k + 1) s)"""
R._NEEDS |= {"cams": ["det"], "wgate": ["walk"]}
QUAD_1 = [(100.0, 2100.0), (1900.0, 2050.0), (1700.0, 300.0), (400.0, 350.0)]
WORLD_1 = [(0.0, 0.0), (8.0, 0.0), (8.0, 20.0), (0.0, 20.0)]


def walkers(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"{_WALK} ({R.WALKERS} FROM {{steps}}) q", steps=R.walker_steps(spark, d))


def walker_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(339).cast("long")))
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("stream_id"), frames.alias("frame_idx")).withColumn("t_sec", F.col("frame_idx") / F.lit(30.0))


def cameras(spark: SparkSession, d: str) -> DataFrame:
    """The detections as two cameras' that share their frames' numbers."""
    return R.detections(spark, d).withColumn("stream_id", F.when(F.col("tile_source") == "tiled", 0).otherwise(1))


def calibrations(spark: SparkSession) -> DataFrame:
    rows = [(k, G.fit_homography(q, w), [list(p) for p in q]) for k, (q, w) in enumerate(((R.QUAD, R.WORLD), (QUAD_1, WORLD_1)))]
    return spark.createDataFrame(rows, "stream_id int, H array<array<double>>, image_points array<array<double>>")


@query("walk", sql="SELECT stream_id, track_id, round(max(t_sec) - min(t_sec), 9) AS lifetime_s, count(*) AS n_observations FROM walk GROUP BY 1, 2")
def stream_lifetimes(spark, d):
    return T.lifetimes(walkers(spark, d), STREAM).withColumn("lifetime_s", F.round("lifetime_s", 9))


@query("walk", sql="""SELECT count(*) AS n_tracks, sum(n)::BIGINT AS n_rows, round(min(life), 6) AS life_min, round(quantile_cont(life, 0.5), 6) AS life_median, round(quantile_cont(life, 0.9), 6) AS life_p90, round(max(life), 6) AS life_max,
  avg((life >= 1)::INT) AS ge_1_0s, avg((life >= 2.5)::INT) AS ge_2_5s, sum(n)::DOUBLE / 8500::DOUBLE AS mean_simultaneous FROM (SELECT max(t_sec) - min(t_sec) AS life, count(*) AS n FROM walk GROUP BY stream_id, track_id) s""")
def stream_churn(spark, d):
    return T.churn(walkers(spark, d), 8500, STREAM).withColumns({c: F.round(c, 6) for c in ("life_min", "life_median", "life_p90", "life_max")})


@query("wgate", sql="SELECT stream_id, track_id, t_sec, x, y, accepted FROM wgate")
def stream_speed_gate(spark, d):
    return T.speed_gate(walkers(spark, d), SPEED, STREAM).select("stream_id", "track_id", "t_sec", "x", "y", "accepted")


@query("wgate", sql=f"""SELECT stream_id, track_id, t_sec, round(CASE WHEN min(t_sec) OVER w = max(t_sec) OVER w THEN 0 ELSE regr_slope(y, t_sec) OVER w END, 4) AS v_y, count(*) OVER w = {SAMPLES} AS window_full
  FROM wgate WHERE accepted WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY t_sec, x, y ROWS BETWEEN {SAMPLES - 1} PRECEDING AND CURRENT ROW)""")
def stream_velocity(spark, d):
    found = T.velocity(T.speed_gate(walkers(spark, d), SPEED, STREAM).where("accepted"), SAMPLES, STREAM)
    return found.select("stream_id", "track_id", "t_sec", F.round("v_y", 4).alias("v_y"), "window_full")


@query("walk", "wframes", sql="""SELECT stream_id, frame_idx, coalesce(n, 0) AS new_ids, (sum(coalesce(n, 0)) OVER (PARTITION BY stream_id ORDER BY frame_idx))::BIGINT AS ids_so_far
  FROM wframes LEFT JOIN (SELECT stream_id, frame_idx, count(*) AS n FROM (SELECT stream_id, track_id, min(frame_idx) AS frame_idx FROM walk GROUP BY 1, 2) a GROUP BY 1, 2) b USING (stream_id, frame_idx)""")
def stream_ids_so_far(spark, d):
    return T.ids_so_far(walkers(spark, d), walker_frames(spark, d), 100, STREAM)


@query("walk", "wframes", sql="""SELECT stream_id, frame_idx, t_sec, coalesce(n, 0)::BIGINT AS in_quad, coalesce(n, 0) / 90::DOUBLE AS density, top / 2.25::DOUBLE AS peak_cell_density FROM wframes LEFT JOIN
  (SELECT stream_id, frame_idx, sum(n) AS n, max(n) AS top FROM (SELECT stream_id, frame_idx, floor(x / 1.5::DOUBLE), floor(y / 1.5::DOUBLE), count(*) AS n FROM walk GROUP BY ALL) c GROUP BY 1, 2) p USING (stream_id, frame_idx)""")
def stream_density(spark, d):
    return D.frame_density(walkers(spark, d), walker_frames(spark, d), 90.0, 1.5, STREAM)


@query("walk", sql="""SELECT stream_id, ci, cj, n FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, first, ci, cj) AS place FROM
  (SELECT stream_id, floor(x / 1.5::DOUBLE)::BIGINT AS ci, floor(y / 1.5::DOUBLE)::BIGINT AS cj, count(*) AS n, min(frame_idx) AS first FROM walk GROUP BY 1, 2, 3) c) r WHERE place = 1""")
def stream_busiest_cells(spark, d):
    return D.busiest_cell(walkers(spark, d), 1.5, STREAM)


@query("walk", "wframes", sql=f"""SELECT stream_id, frame_idx, col, "row", round(value, 9) AS value FROM (SELECT stream_id, frame_idx, t_sec, col, "row", sum(coalesce(n, 0)) OVER w / (count(*) OVER w)::DOUBLE AS value
  FROM wframes CROSS JOIN (SELECT range::INT AS col FROM range(4)) a CROSS JOIN (SELECT range::INT AS "row" FROM range(8)) b LEFT JOIN
  (SELECT stream_id, frame_idx, floor((x + 3) / 1.5::DOUBLE)::INT AS col, floor(y / 1.5::DOUBLE)::INT AS "row", count(*) AS n FROM walk GROUP BY ALL) c USING (stream_id, frame_idx, col, "row")
  WINDOW w AS (PARTITION BY stream_id, col, "row" ORDER BY t_sec RANGE BETWEEN {WINDOW_S}::DOUBLE PRECEDING AND CURRENT ROW)) r WHERE value > 0""")
def stream_rolling_density(spark, d):
    found = D.rolling(walkers(spark, d), walker_frames(spark, d), GRID, WINDOW_S, STREAM, block_seconds=2.0).where("value > 0")
    return found.select("stream_id", "frame_idx", "col", "row", F.round("value", 9).alias("value"))


@query("cams", sql="SELECT stream_id, count(*) AS total, count(*) FILTER (in_quad) AS in_quad, count(*) FILTER (in_quad AND conf_pct >= 5) AS tracked, count(*) FILTER (in_quad AND conf_pct >= 5) AS emitted FROM split GROUP BY 1")
def stream_funnel(spark, d):
    boxes = E.project_each(cameras(spark, d), calibrations(spark), STREAM)
    return E.funnel(boxes.withColumn("track_id", F.expr(R._TRACKED)), STREAM).drop("loss")


def _map(h: list[list[float]], r: int) -> str:
    return f"{R._line(h[r])} / {R._line(h[2])}"


_H1 = G.fit_homography(QUAD_1, WORLD_1)


@query("cams", sql=f"""SELECT stream_id, frame_idx, foot_x, foot_y, in_quad, round(CASE WHEN in_quad THEN CASE WHEN stream_id = 0 THEN {_map(R.H, 0)} ELSE {_map(_H1, 0)} END END, 6) AS world_x,
  round(CASE WHEN in_quad THEN CASE WHEN stream_id = 0 THEN {_map(R.H, 1)} ELSE {_map(_H1, 1)} END END, 6) AS world_y FROM split""")
def stream_projection(spark, d):
    found = E.project_each(cameras(spark, d), calibrations(spark), STREAM)
    return found.select("stream_id", "frame_idx", "foot_x", "foot_y", "in_quad", F.round("world_x", 6).alias("world_x"), F.round("world_y", 6).alias("world_y"))


_SAME = " AND ".join(f"abs(a.{c} - b.{c}) <= 0.001::DOUBLE + 0.00001::DOUBLE * abs(a.{c})" for c in E.BOX)


@query("cams", sql=f"SELECT stream_id, frame_idx, count(*) AS n FROM cams a WHERE class_id = 0 AND NOT EXISTS (SELECT 1 FROM cams b WHERE b.conf_pct >= 5 AND a.frame_idx = b.frame_idx AND a.stream_id = b.stream_id AND {_SAME}) GROUP BY 1, 2")
def stream_unmatched(spark, d):
    found = cameras(spark, d).select(*STREAM, "frame_idx", "class_id", "conf_pct", *E.BOX)
    return E.unmatched(found.where("class_id = 0"), found.where("conf_pct >= 5"), STREAM).groupBy(*STREAM, "frame_idx").agg(F.count("*").alias("n"))


_KEPT = R.kept_boxes_sql("frame_idx", "class_id", "tile_source")


@query(sql=_KEPT + "SELECT CASE WHEN tile_source = 'tiled' THEN 0 ELSE 1 END AS stream_id, frame_idx, class_id, conf, x1, y1, x2, y2 FROM kept_boxes")
def stream_nms(spark, d):
    return E.suppress(cameras(spark, d), 0.3, STREAM).select(*STREAM, "frame_idx", "class_id", "conf", *E.BOX)


@query(sql=_KEPT + """SELECT stream_id, frame_idx, n_before, n_after FROM (SELECT CASE WHEN tile_source = 'tiled' THEN 0 ELSE 1 END AS stream_id, frame_idx, count(*) AS n_before FROM det GROUP BY 1, 2) b
  JOIN (SELECT CASE WHEN tile_source = 'tiled' THEN 0 ELSE 1 END AS stream_id, frame_idx, count(*) AS n_after FROM kept_boxes GROUP BY 1, 2) a USING (stream_id, frame_idx)""")
def stream_tile_counters(spark, d):
    return P.tile_counters(cameras(spark, d), 0.3, STREAM)


@query("cams", sql=f"""SELECT a.stream_id, a.frame_idx, a.x1 AS ax1, a.y2 AS ay2, b.x1 AS bx1, b.y2 AS by2 FROM cams a JOIN cams b ON a.stream_id = b.stream_id AND a.frame_idx = b.frame_idx AND a.y2 < b.y2
  WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / nullif(greatest(a.x2, b.x2) - least(a.x1, b.x1), 0) >= 0.1::DOUBLE AND abs(b.y1 - a.y2) <= 60
  AND coalesce({R.IOU} / nullif((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - {R.IOU}, 0), 0) <= 0.3::DOUBLE""")
def stream_stacked_pairs(spark, d):
    found = E.stacked_pairs(cameras(spark, d), 0.1, 60.0, 0.3, STREAM)
    return found.select(*STREAM, "frame_idx", F.col("a.x1").alias("ax1"), F.col("a.y2").alias("ay2"), F.col("b.x1").alias("bx1"), F.col("b.y2").alias("by2"))


@query(sql=f"""SELECT b.stream_id, b.frame_idx, b.truth_agent_id, b.det_id, b.conf, w.x_world AS truth_x, w.y_world AS truth_y FROM ({R._SYNTHETIC}) b
  LEFT JOIN ({R.WALKERS} FROM customer, (SELECT range AS k FROM range(40)) s) w ON b.stream_id = w.stream_id AND b.frame_idx = w.frame_idx AND b.truth_agent_id = w.agent_id""")
def boxes_with_truth(spark, d):
    truth = spark.sql(R.WALKERS + " FROM {steps}", steps=R.walker_steps(spark, d)).withColumnRenamed("frame_idx", "frame_id")
    found = E.with_truth(R.synthetic(spark, d), truth, STREAM)
    return found.select("stream_id", "frame_idx", F.col("truth_agent_id").cast("long"), "det_id", F.round("conf", 5).alias("conf"), "truth_x", "truth_y")


def tracked_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    """Lifetimes of the tracks that tracking the synthetic detections gives. SQL cannot express the tracking."""
    found = R.tracked_detections(spark, d).where("track_id >= 0").withColumn("t_sec", F.col("frame_idx") / F.lit(30.0))
    return T.lifetimes(found, STREAM)


R._QUERIES["tracked_lifetimes"] = tracked_lifetimes
