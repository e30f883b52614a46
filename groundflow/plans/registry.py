"""All queries of the engine by name, with the equal SQL. The tables are relabelled as detections and tracks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundflow.functions import geometry as G
from groundflow.functions.ranks import exact_percentiles
from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.operators import detector as P
from groundflow.operators import synthetic as Y
from groundflow.operators import tracking as K
from groundflow.operators import tracks as T

#: A camera's quad in pixels and on the ground in metres.
QUAD = [(781.0, 2143.0), (2640.0, 2142.0), (3052.0, 906.0), (2707.0, 853.0)]
WORLD = [(-3.0, 0.0), (3.0, 0.0), (3.0, 15.0), (-3.0, 15.0)]
H = G.fit_homography(QUAD, WORLD)
H_INV = np.linalg.inv(np.array(H)).tolist()
AREA = G.area(WORLD)
GRID = D.Grid(0.0, 0.0, 10.0, 10, 10)
SPEED, WINDOW_S, SAMPLES, SIGMA = 0.02, 7200.0, 5, 1.0

DET_INNER = """SELECT l_orderkey, CAST((l_partkey*37 + l_suppkey*11) % 3840 AS DOUBLE) AS cx,
  CAST((l_suppkey*53 + l_linenumber*101 + l_partkey*7) % 2160 AS DOUBLE) AS fy, CAST(20 + l_quantity AS DOUBLE) AS w,
  CAST(0.02 AS DOUBLE) + l_discount * CAST(9 AS DOUBLE) AS conf, CAST(round(l_discount * 100) AS BIGINT) AS conf_pct,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS class_id,
  CASE WHEN l_linestatus = 'O' THEN 'tiled' ELSE 'untiled' END AS tile_source FROM lineitem"""
DET_OUTER = ["l_orderkey AS frame_idx", "l_orderkey / CAST(30 AS DOUBLE) AS t_sec", "cx - w/2 AS x1", "fy - 3*w AS y1", "cx + w/2 AS x2", "fy AS y2", "conf", "conf_pct", "class_id", "tile_source"]


def detections(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return spark.sql(DET_INNER.replace("FROM lineitem", "FROM {lines}"), lines=lines).selectExpr(*DET_OUTER)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS frame_idx", "o_orderkey / CAST(30 AS DOUBLE) AS t_sec")


def tracks(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    found = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("track_id"), (micros / F.lit(1000000.0)).alias("t_sec"), F.col("value").cast("double").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return found.withColumn("frame_idx", F.floor((F.col("t_sec") - 1704067200) / 3600))


def track_frames(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select("frame_idx").distinct().withColumn("t_sec", F.col("frame_idx") * F.lit(3600.0))


def projected(spark: SparkSession, d: str) -> DataFrame:
    return E.project(detections(spark, d), H, QUAD)


def inside(spark: SparkSession, d: str) -> DataFrame:
    return E.project_inside(detections(spark, d), H, QUAD)


SQL = {
    "det": f"det AS (SELECT {', '.join(DET_OUTER)} FROM ({DET_INNER}) s)",
    "frames": "frames AS (SELECT o_orderkey AS frame_idx, o_orderkey / CAST(30 AS DOUBLE) AS t_sec FROM orders)",
    "trk": """trk AS (SELECT *, CAST(floor((t_sec - 1704067200) / 3600) AS BIGINT) AS frame_idx FROM (SELECT user_id AS track_id,
  epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t_sec, CAST(value AS DOUBLE) AS x, CAST(props->>'$.k' AS DOUBLE) AS y FROM events) e)""",
    "tframes": "tframes AS (SELECT DISTINCT frame_idx, frame_idx * CAST(3600 AS DOUBLE) AS t_sec FROM trk)",
}


def _polygon(points: list, x: str, y: str) -> str:
    def edge(a: tuple, b: tuple) -> str:
        (ax, ay), (bx, by) = a, b
        return f"({y} > {min(ay, by)}::DOUBLE AND {y} <= {max(ay, by)}::DOUBLE AND {x} <= {max(ax, bx)}::DOUBLE AND {x} <= ({y} - {ay}::DOUBLE) * {bx - ax}::DOUBLE / {by - ay}::DOUBLE + {ax}::DOUBLE)"

    return "(" + " <> ".join(["(" * 3 + edge(points[0], points[1]), edge(points[1], points[2]) + ")", edge(points[2], points[3]) + ")", edge(points[3], points[0]) + ")"]) + ")"


def _line(r: list[float]) -> str:
    return f"({r[0]!r}::DOUBLE * foot_x + {r[1]!r}::DOUBLE * foot_y + {r[2]!r}::DOUBLE)"


SQL["proj"] = f"""proj AS (SELECT *, CASE WHEN in_quad THEN {_line(H[0])} / {_line(H[2])} END AS world_x, CASE WHEN in_quad THEN {_line(H[1])} / {_line(H[2])} END AS world_y
  FROM (SELECT *, {_polygon(QUAD, 'foot_x', 'foot_y')} AS in_quad FROM (SELECT *, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM det) a) b)"""
SQL["dens"] = f"""dens AS (SELECT f.frame_idx, f.t_sec, coalesce(n, 0)::BIGINT AS in_quad, coalesce(n, 0) / (6 * 15)::DOUBLE AS density, top / CAST(1 AS DOUBLE) AS peak_cell_density FROM frames f LEFT JOIN
  (SELECT frame_idx, sum(n) AS n, max(n) AS top FROM (SELECT frame_idx, floor(world_x), floor(world_y), count(*) AS n FROM proj WHERE in_quad GROUP BY ALL) c GROUP BY frame_idx) p USING (frame_idx))"""
SQL["gate"] = f"""seq AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_sec, x, y, frame_idx) AS k FROM trk),
gate AS (SELECT track_id, k, t_sec, x, y, frame_idx, true AS accepted, t_sec AS lt, x AS lx, y AS ly FROM seq WHERE k = 1
  UNION ALL SELECT s.track_id, s.k, s.t_sec, s.x, s.y, s.frame_idx, ok, CASE WHEN ok THEN s.t_sec ELSE lt END, CASE WHEN ok THEN s.x ELSE lx END, CASE WHEN ok THEN s.y ELSE ly END
  FROM (SELECT s.*, g.lt, g.lx, g.ly, NOT (s.t_sec - g.lt > 0 AND sqrt((s.x - g.lx)*(s.x - g.lx) + (s.y - g.ly)*(s.y - g.ly)) / nullif(s.t_sec - g.lt, 0) > {SPEED}::DOUBLE) AS ok
  FROM gate g JOIN seq s ON s.track_id = g.track_id AND s.k = g.k + 1) s)"""
SQL["roll"] = f"""cnt AS (SELECT frame_idx, CAST(floor(x / 10) AS INT) AS col, CAST(floor(y / 10) AS INT) AS "row", count(*) AS n FROM trk WHERE x >= 0 AND x < 100 AND y >= 0 AND y < 100 GROUP BY ALL),
roll AS (SELECT frame_idx, t_sec, col, "row", sum(coalesce(n, 0)) OVER w / (count(*) OVER w)::DOUBLE AS value
  FROM tframes CROSS JOIN (SELECT CAST(range AS INT) AS col FROM range(10)) a CROSS JOIN (SELECT CAST(range AS INT) AS "row" FROM range(10)) b LEFT JOIN cnt USING (frame_idx, col, "row")
  WINDOW w AS (PARTITION BY col, "row" ORDER BY t_sec RANGE BETWEEN {WINDOW_S}::DOUBLE PRECEDING AND CURRENT ROW))"""
SQL["kern"] = "kern(src, dst, w) AS (VALUES " + ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in D.kernel(SIGMA, 10)) + ")"
SQL["smooth"] = """mid AS (SELECT frame_idx, t_sec, "row", k.dst AS col, sum(value * w) AS value FROM roll JOIN kern k ON col = k.src GROUP BY ALL),
smooth AS (SELECT frame_idx, t_sec, col, k.dst AS "row", sum(value * w) AS value FROM mid JOIN kern k ON "row" = k.src GROUP BY ALL)"""
_NEEDS = {"proj": ["det"], "dens": ["frames", "proj"], "gate": ["trk"], "tframes": ["trk"], "roll": ["trk", "tframes"], "smooth": ["roll", "kern"]}
IOU = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _with(*names: str) -> str:
    done: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in done:
            done.append(n)

    for n in names:
        need(n)
    return ("WITH RECURSIVE " if {"gate", "wgate"} & set(done) else "WITH ") + ", ".join(SQL[n] for n in done) + " "


def query(*needs: str, sql: str):
    """Register a query under its function's name."""

    def put(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = (_with(*needs) if needs else "") + sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("dens", sql="SELECT * FROM dens")
def frame_density(spark, d):
    points = inside(spark, d).select("frame_idx", F.col("world_x").alias("x"), F.col("world_y").alias("y"))
    return D.frame_density(points, frames(spark, d), AREA, 1.0)


@query("det", sql="SELECT frame_idx, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, conf FROM det")
def foot_points(spark, d):
    x, y = G.foot_point()
    return detections(spark, d).select("frame_idx", x.alias("foot_x"), y.alias("foot_y"), "conf")


@query("det", sql="SELECT frame_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det")
def centroid_points(spark, d):
    x, y = G.centroid()
    return detections(spark, d).select("frame_idx", x.alias("cx"), y.alias("cy"))


@query("proj", sql=f"SELECT frame_idx, world_x - {_line(H[0]).replace('foot_y', 'cy')} / {_line(H[2]).replace('foot_y', 'cy')} AS dx, world_y - {_line(H[1]).replace('foot_y', 'cy')} / {_line(H[2]).replace('foot_y', 'cy')} AS dy FROM (SELECT *, (y1 + y2) / 2 AS cy FROM proj) p WHERE in_quad")
def foot_centroid_gap(spark, d):
    x, y = G.to_ground(H, *G.centroid())
    return inside(spark, d).select("frame_idx", (F.col("world_x") - x).alias("dx"), (F.col("world_y") - y).alias("dy"))


@query("proj", sql="SELECT frame_idx, foot_x, foot_y, in_quad, world_x, world_y FROM proj")
def ground_projection(spark, d):
    return projected(spark, d).select("frame_idx", "foot_x", "foot_y", "in_quad", "world_x", "world_y")


_EMB = "(SELECT 1920 + 3840 * CAST(embedding[1] AS DOUBLE) AS x, 1080 + 2160 * CAST(embedding[2] AS DOUBLE) AS y, * FROM embeddings) e"


@query("proj", sql="SELECT in_quad, count(*) AS n FROM proj GROUP BY in_quad")
def quad_membership(spark, d):
    return projected(spark, d).groupBy("in_quad").agg(F.count("*").alias("n"))


@query("det", sql="SELECT count(*) AS n, count(*) FILTER ((x1 + x2) / 2 BETWEEN 781 AND 3052 AND y2 BETWEEN 853 AND 2143) AS inside FROM det")
def bbox_membership(spark, d):
    return detections(spark, d).agg(F.count("*").alias("n"), F.count_if(G.in_bounds(QUAD, *G.foot_point())).alias("inside"))


@query("det", sql="SELECT frame_idx, x1, y1, x2, y2, conf FROM det WHERE class_id = 0 AND conf >= 0.3::DOUBLE")
def detection_filter(spark, d):
    return E.people(detections(spark, d), 0.3).select("frame_idx", *E.BOX, "conf")


_TRACKED = "CASE WHEN conf_pct >= 5 THEN 1 ELSE -1 END"


@query("proj", sql=f"SELECT count(*) AS total, count(*) FILTER (in_quad) AS in_quad, count(*) FILTER (in_quad AND {_TRACKED} >= 0) AS tracked, count(*) FILTER (in_quad AND {_TRACKED} >= 0) AS emitted FROM proj")
def funnel_totals(spark, d):
    return E.funnel(projected(spark, d).withColumn("track_id", F.expr(_TRACKED))).drop("loss")


@query("proj", sql=f"SELECT CAST(1 AS DOUBLE) - (count(*) FILTER (in_quad AND {_TRACKED} >= 0))::DOUBLE / (count(*) FILTER (in_quad))::DOUBLE AS loss FROM proj")
def funnel_loss(spark, d):
    return E.funnel(projected(spark, d).withColumn("track_id", F.expr(_TRACKED))).select("loss")


_COUNTS = "(SELECT f.frame_idx, coalesce(n, 0) AS n FROM frames f LEFT JOIN (SELECT frame_idx, count(*) AS n FROM det GROUP BY 1) c USING (frame_idx)) s"


def _counts(spark, d):
    per = detections(spark, d).groupBy("frame_idx").agg(F.count("*").alias("n"))
    return frames(spark, d).join(per, "frame_idx", "left").select("frame_idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("det", "frames", sql=f"SELECT * FROM {_COUNTS}")
def frame_counts(spark, d):
    return _counts(spark, d)


@query("det", "frames", sql=f"SELECT count(*) AS frames, sum(n)::BIGINT AS boxes, sum(n)::DOUBLE / count(*)::DOUBLE AS mean_n, min(n) AS min_n, max(n) AS max_n FROM {_COUNTS}")
def frame_count_stats(spark, d):
    return _counts(spark, d).agg(F.count("*").alias("frames"), F.sum("n").alias("boxes"), (F.sum("n").cast("double") / F.count("*").cast("double")).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


@query("det", sql="SELECT sum(conf_pct)::DOUBLE / count(*)::DOUBLE AS mean_pct, quantile_cont(conf_pct::DOUBLE, 0.1) AS p10, quantile_cont(conf_pct::DOUBLE, 0.5) AS p50, quantile_cont(conf_pct::DOUBLE, 0.9) AS p90 FROM det")
def confidence_stats(spark, d):
    found = detections(spark, d).select("conf_pct")
    mean = found.agg(F.lit(0).alias("whole"), (F.sum("conf_pct").cast("double") / F.count("*").cast("double")).alias("mean_pct"))
    ranks = exact_percentiles(found, "conf_pct", [0.1, 0.5, 0.9]).select(F.lit(0).alias("whole"), *[F.col(f"p{k}").alias(c) for k, c in enumerate(("p10", "p50", "p90"))])
    return mean.join(F.broadcast(ranks), "whole").drop("whole")  # a row each


@query("det", sql="SELECT least(CAST(floor(conf_pct / 2::DOUBLE) AS BIGINT), 4) AS bin, count(*) AS n FROM det GROUP BY 1")
def confidence_histogram(spark, d):
    return detections(spark, d).groupBy(F.least(F.floor(F.col("conf_pct") / 2.0), F.lit(4).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


@query("det", sql="SELECT count(*) FILTER (conf_pct >= 1) AS ge_1, count(*) FILTER (conf_pct >= 2) AS ge_2, count(*) FILTER (conf_pct >= 3) AS ge_3 FROM det")
def threshold_counts(spark, d):
    return detections(spark, d).agg(*[F.count_if(F.col("conf_pct") >= k).alias(f"ge_{k}") for k in (1, 2, 3)])


@query("det", sql="SELECT tile_source, (count(*) FILTER (conf_pct BETWEEN 3 AND 4))::DOUBLE / count(*)::DOUBLE AS share FROM det GROUP BY 1")
def low_conf_share(spark, d):
    return detections(spark, d).groupBy("tile_source").agg((F.count_if(F.col("conf_pct").between(3, 4)).cast("double") / F.count("*").cast("double")).alias("share"))


@query("proj", sql="SELECT CAST(floor(world_x) AS BIGINT) AS ci, CAST(floor(world_y) AS BIGINT) AS cj, count(*) AS n FROM proj WHERE in_quad GROUP BY 1, 2 ORDER BY n DESC, min(frame_idx), ci, cj LIMIT 1")
def busiest_cell(spark, d):
    points = inside(spark, d).select("frame_idx", F.col("world_x").alias("x"), F.col("world_y").alias("y"))
    return D.busiest_cell(points, 1.0)


@query("dens", sql=f"SELECT count(*) AS n_frames, sum(in_quad)::BIGINT AS persons, avg(in_quad) / (6 * 15)::DOUBLE AS mean_density, max(density) AS max_density, arg_max(frame_idx, (density, -frame_idx)) AS max_frame, arg_max(t_sec, (density, -frame_idx)) AS max_t, max(coalesce(peak_cell_density, 0)) AS max_cell_density FROM dens")
def density_summary(spark, d):
    return D.density_summary(frame_density(spark, d), AREA)


@query("trk", sql="SELECT track_id, max(t_sec) - min(t_sec) AS lifetime_s, count(*) AS n_observations FROM trk GROUP BY 1")
def track_lifetimes(spark, d):
    return T.lifetimes(tracks(spark, d))


@query("trk", sql="""SELECT count(*) AS n_tracks, sum(n)::BIGINT AS n_rows, round(quantile_cont(life, 0.0), 3) AS life_min, round(quantile_cont(life, 0.5), 3) AS life_median, round(quantile_cont(life, 0.9), 3) AS life_p90, round(quantile_cont(life, 1.0), 3) AS life_max,
  avg((life >= 1)::INT) AS ge_1_0s, avg((life >= 2.5)::INT) AS ge_2_5s, sum(n)::DOUBLE / 720::DOUBLE AS mean_simultaneous FROM (SELECT max(t_sec) - min(t_sec) AS life, count(*) AS n FROM trk GROUP BY track_id) s""")
def track_churn(spark, d):
    found = T.churn(tracks(spark, d), 720)
    return found.withColumns({c: F.round(c, 3) for c in ("life_min", "life_median", "life_p90", "life_max")})


@query("trk", sql="SELECT frame_idx, count(DISTINCT track_id) AS n_tracks FROM trk GROUP BY 1")
def tracks_per_frame(spark, d):
    return tracks(spark, d).groupBy("frame_idx").agg(F.count_distinct("track_id").alias("n_tracks"))


@query("gate", sql="SELECT track_id, t_sec, x, y, frame_idx, accepted FROM gate")
def speed_gate(spark, d):
    return T.speed_gate(tracks(spark, d), SPEED)


@query("gate", sql="SELECT track_id, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM gate GROUP BY 1 HAVING count(*) FILTER (NOT accepted) > 0")
def gate_rejections(spark, d):
    return T.rejections(T.speed_gate(tracks(spark, d), SPEED)).drop("rejected_pct")


@query("gate", sql=f"""SELECT track_id, t_sec, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE coalesce(regr_slope(x, t_sec) OVER w, 0) END, 9) AS v_x, count(*) OVER w = {SAMPLES} AS window_full
  FROM gate WHERE accepted WINDOW w AS (PARTITION BY track_id ORDER BY t_sec, x, y ROWS BETWEEN {SAMPLES - 1} PRECEDING AND CURRENT ROW)""")
def track_velocity(spark, d):
    found = T.velocity(T.speed_gate(tracks(spark, d), SPEED).where("accepted"), SAMPLES)
    return found.select("track_id", "t_sec", F.round("v_x", 9).alias("v_x"), "window_full")


@query("trk", "tframes", sql="SELECT frame_idx, coalesce(n, 0) AS new_ids, (sum(coalesce(n, 0)) OVER (ORDER BY frame_idx))::BIGINT AS ids_so_far FROM tframes LEFT JOIN (SELECT frame_idx, count(*) AS n FROM (SELECT track_id, min(frame_idx) AS frame_idx FROM trk GROUP BY 1) a GROUP BY 1) b USING (frame_idx)")
def ids_seen_so_far(spark, d):
    return T.ids_so_far(tracks(spark, d), track_frames(spark, d))


@query("trk", sql="SELECT track_id, frame_idx, n, (sum(n) OVER (PARTITION BY track_id ORDER BY frame_idx))::BIGINT AS n_so_far FROM (SELECT track_id, frame_idx, count(*) AS n FROM trk GROUP BY 1, 2) s")
def running_funnel(spark, d):
    return E.running_totals(tracks(spark, d).groupBy("track_id", "frame_idx").agg(F.count("*").alias("n")), ["n"], ["track_id"])


@query("trk", sql="SELECT track_id, t_sec, round(30 / nullif(t_sec - lag(t_sec, 30) OVER w, 0), 12) AS rate FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY t_sec, x, y)")
def moving_average(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("t_sec", "x", "y")
    return tracks(spark, d).select("track_id", "t_sec", F.round(F.try_divide(F.lit(30.0), F.col("t_sec") - F.lag("t_sec", 30).over(w)), 12).alias("rate"))


@query("trk", sql="""SELECT track_id, t_sec, round(1 / nullif(avg(dt) OVER (PARTITION BY track_id ORDER BY t_sec, x, y ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0), 12) AS rate
  FROM (SELECT *, t_sec - lag(t_sec) OVER (PARTITION BY track_id ORDER BY t_sec, x, y) AS dt FROM trk) s""")
def moving_average_up_to_30(spark, d):
    return T.step_rate(tracks(spark, d)).select("track_id", "t_sec", F.round("rate", 12).alias("rate"))


def _rolling(spark, d):
    return D.rolling(tracks(spark, d).drop("t_sec"), track_frames(spark, d), GRID, WINDOW_S)


@query("roll", sql='SELECT frame_idx, t_sec, col, "row", value FROM roll')
def rolling_density(spark, d):
    return _rolling(spark, d).select("frame_idx", "t_sec", "col", "row", "value")


@query("roll", sql="SELECT max(value) AS peak, arg_max(frame_idx, (value, -frame_idx)) AS frame_idx FROM roll")
def rolling_density_peak(spark, d):
    return _rolling(spark, d).agg(F.max("value").alias("peak"), F.max_by("frame_idx", F.struct("value", -F.col("frame_idx"))).alias("frame_idx"))


@query("smooth", sql='SELECT frame_idx, col, "row", round(value, 9) AS value FROM smooth')
def smoothed_density(spark, d):
    return D.smoothed(_rolling(spark, d), GRID, SIGMA).select("frame_idx", F.col("col").cast("int"), F.col("row").cast("int"), F.round("value", 9).alias("value"))


def _ramp_sql(k: int) -> str:
    v, out = "v", ""
    for (a, x), (b, y) in zip(D.STOPS_HARD, D.STOPS_HARD[1:], strict=False):
        out += f"WHEN {v} < {b}::DOUBLE THEN {x[k]}::DOUBLE + ({v} - {a}::DOUBLE) / {b - a!r}::DOUBLE * {y[k] - x[k]}::DOUBLE "
    return f"CAST(trunc(CASE {out} ELSE {D.STOPS_HARD[-1][1][k]}::DOUBLE END) AS INT)"


@query("roll", sql=f'SELECT frame_idx, col, "row", {_ramp_sql(0)} AS b, {_ramp_sql(1)} AS g, {_ramp_sql(2)} AS r FROM (SELECT *, least(greatest(value, 0), 3::DOUBLE) / 3::DOUBLE * 4::DOUBLE AS v FROM roll) s')
def density_colour(spark, d):
    return _rolling(spark, d).select("frame_idx", "col", "row", D.colour(D.to_ramp(F.col("value"), 3.0)).alias("c")).select("frame_idx", "col", "row", "c.b", "c.g", "c.r")


_SAME = " AND ".join(f"abs(a.{c} - b.{c}) <= 0.001::DOUBLE + 0.00001::DOUBLE * abs(a.{c})" for c in E.BOX)


def _two(spark, d):
    found = detections(spark, d)
    return found.where("class_id = 0").select("frame_idx", *E.BOX), found.where("conf_pct >= 5").select("frame_idx", *E.BOX)


@query("det", sql=f"SELECT frame_idx, x1, y1, x2, y2 FROM det a WHERE class_id = 0 AND EXISTS (SELECT 1 FROM det b WHERE b.conf_pct >= 5 AND a.frame_idx = b.frame_idx AND {_SAME})")
def matched_boxes(spark, d):
    return E.matched(*_two(spark, d))


@query("det", sql=f"SELECT frame_idx, x1, y1, x2, y2 FROM det a WHERE class_id = 0 AND NOT EXISTS (SELECT 1 FROM det b WHERE b.conf_pct >= 5 AND a.frame_idx = b.frame_idx AND {_SAME})")
def unmatched_boxes(spark, d):
    return E.unmatched(*_two(spark, d))


@query("det", sql="""SELECT tile_x, tile_y, count(*) AS n FROM (SELECT (x1 + x2) / 2 AS fx, y2 AS fy FROM det) p, (SELECT CAST(range AS INT) AS tile_x FROM range(0, 3712, 1152)) a, (SELECT CAST(range AS INT) AS tile_y FROM range(0, 2032, 1152)) b
  WHERE fx >= tile_x AND fx < tile_x + 1280 AND fy >= tile_y AND fy < tile_y + 1280 GROUP BY 1, 2""")
def tile_assignment(spark, d):
    return E.to_tiles(detections(spark, d), 3840, 2160).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


_OVER = "greatest(0, least(a.x2, boxes[k+1].x2) - greatest(a.x1, boxes[k+1].x1)) * greatest(0, least(a.y2, boxes[k+1].y2) - greatest(a.y1, boxes[k+1].y1))"


def kept_boxes_sql(*keys: str) -> str:
    """Boxes of each group of keys that greedy suppression keeps, as kept_boxes."""
    by, next_box = ", ".join(keys), "boxes[k+1]"
    size = lambda b: f"({b}.x2-{b}.x1)*({b}.y2-{b}.y1)"
    return f"""WITH RECURSIVE {SQL['det']},
g AS (SELECT {by}, list({{'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY conf DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC) AS boxes, count(*) AS n FROM det GROUP BY {by}),
r AS (SELECT {by}, boxes, n, 1::BIGINT AS k, boxes[1:1] AS kept FROM g
  UNION ALL SELECT {by}, boxes, n, k + 1, CASE WHEN len(list_filter(kept, lambda a: {_OVER} / ({size('a')} + {size(next_box)} - {_OVER}) > 0.3::DOUBLE)) > 0
    THEN kept ELSE list_append(kept, {next_box}) END FROM r WHERE k < n),
kept_boxes AS (SELECT {by}, u.b.conf AS conf, u.b.x1 AS x1, u.b.y1 AS y1, u.b.x2 AS x2, u.b.y2 AS y2 FROM r, LATERAL (SELECT unnest(kept) AS b) u WHERE k = n) """


@query(sql=kept_boxes_sql("frame_idx", "class_id") + "SELECT * FROM kept_boxes")
def cross_tile_nms(spark, d):
    return E.suppress(detections(spark, d), 0.3).select("frame_idx", "class_id", "conf", *E.BOX)


@query("det", sql="SELECT count(*) AS n, round(regr_slope(y2 - y1, y2), 6) AS slope, round(regr_intercept(y2 - y1, y2), 4) AS intercept, round(regr_r2(y2 - y1, y2), 6) AS r2 FROM det WHERE conf_pct >= 5 AND y2 < 2159")
def height_fit(spark, d):
    h = F.col("y2") - F.col("y1")
    fit = lambda f, n: F.round(f(h, F.col("y2")), n)
    return detections(spark, d).where("conf_pct >= 5 AND y2 < 2159").agg(F.count("*").alias("n"), fit(F.regr_slope, 6).alias("slope"), fit(F.regr_intercept, 4).alias("intercept"), fit(F.regr_r2, 6).alias("r2"))


@query("det", sql="SELECT frame_idx, (count(*) FILTER (tile_source = 'tiled'))::DOUBLE / nullif(count(*) FILTER (tile_source = 'untiled'), 0)::DOUBLE AS ratio FROM det GROUP BY 1")
def config_ratio(spark, d):
    wide = detections(spark, d).groupBy("frame_idx").pivot("tile_source", ["tiled", "untiled"]).count()
    return wide.select("frame_idx", F.try_divide(F.coalesce("tiled", F.lit(0)).cast("double"), F.col("untiled").cast("double")).alias("ratio"))


@query("det", sql="SELECT tile_source, quantile_cont(y2 - y1, 0.5) AS p50, quantile_cont(y2 - y1, 0.9) AS p90, max(y2 - y1) AS tallest, count(*) FILTER (y2 - y1 > 160) AS n_tall FROM det GROUP BY 1")
def box_height_stats(spark, d):
    h = F.col("y2") - F.col("y1")
    found = detections(spark, d).select("tile_source", h.alias("h"))
    tall = found.groupBy("tile_source").agg(F.max("h").alias("tallest"), F.count_if(F.col("h") > 160).alias("n_tall"))
    ranks = exact_percentiles(found, "h", [0.5, 0.9], ["tile_source"])
    return tall.join(ranks, "tile_source").select("tile_source", F.col("p0").alias("p50"), F.col("p1").alias("p90"), "tallest", "n_tall")


@query("det", sql=f"""SELECT a.frame_idx, a.x1 AS ax1, a.y2 AS ay2, b.x1 AS bx1, b.y2 AS by2 FROM det a JOIN det b ON a.frame_idx = b.frame_idx AND a.y2 < b.y2
  WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / nullif(greatest(a.x2, b.x2) - least(a.x1, b.x1), 0) >= 0.1::DOUBLE AND abs(b.y1 - a.y2) <= 60
  AND coalesce({IOU} / nullif((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - {IOU}, 0), 0) <= 0.3::DOUBLE""")
def stacked_pairs(spark, d):
    return E.stacked_pairs(detections(spark, d), 0.1, 60.0, 0.3).select("frame_idx", F.col("a.x1").alias("ax1"), F.col("a.y2").alias("ay2"), F.col("b.x1").alias("bx1"), F.col("b.y2").alias("by2"))


@query("trk", sql="SELECT frame_idx, count(*) AS n FROM trk WHERE frame_idx % 15 = 0 AND frame_idx < 600 GROUP BY 1")
def sampled_frames(spark, d):
    return tracks(spark, d).where("frame_idx % 15 = 0 AND frame_idx < 600").groupBy("frame_idx").agg(F.count("*").alias("n"))


@query(sql=f"SELECT count(*) AS n, count(*) FILTER ({_polygon(QUAD, 'x', 'y')}) AS inside FROM {_EMB}")
def embedded_points(spark, d):
    found = spark.read.parquet(f"{d}/embeddings.parquet")
    x, y = (F.lit(o) + F.lit(s) * F.col("embedding")[k].cast("double") for k, (o, s) in enumerate(((1920, 3840), (1080, 2160))))
    return found.agg(F.count("*").alias("n"), F.count_if(G.in_polygon(QUAD, x, y)).alias("inside"))


@query(sql=kept_boxes_sql("frame_idx", "class_id") + """SELECT frame_idx, n_before, n_after, n_before - n_after AS n_suppressed FROM (SELECT frame_idx, count(*) AS n_before FROM det GROUP BY 1) b
  JOIN (SELECT frame_idx, count(*) AS n_after FROM kept_boxes GROUP BY 1) a USING (frame_idx)""")
def tile_counters(spark, d):
    return P.tile_counters(detections(spark, d), 0.3).withColumn("n_suppressed", F.col("n_before") - F.col("n_after"))


@query("proj", sql="SELECT frame_idx, CAST(floor(world_x) AS BIGINT) AS ci, CAST(floor(world_y) AS BIGINT) AS cj, count(*) AS n FROM proj WHERE in_quad GROUP BY 1, 2, 3")
def frame_cell_counts(spark, d):
    cell = lambda c: F.floor(F.col(f"world_{c}"))
    return inside(spark, d).groupBy("frame_idx", cell("x").alias("ci"), cell("y").alias("cj")).agg(F.count("*").alias("n"))


@query("roll", sql='SELECT frame_idx, col, "row", round(pow(least(greatest(value, 0), 3::DOUBLE) / 3::DOUBLE, 0.5::DOUBLE) * 0.7::DOUBLE, 9) AS alpha FROM roll')
def density_overlay_alpha(spark, d):
    return _rolling(spark, d).select("frame_idx", "col", "row", F.round(D.overlay_alpha(F.col("value"), 3.0), 9).alias("alpha"))


@query("det", sql="""SELECT frame_idx, x1, y1, least(greatest(x2, x1 + 1), 3840) AS x2, least(greatest(y2, y1 + 1), 2160) AS y2
  FROM (SELECT frame_idx, least(greatest(x1, 0), 3839)::DOUBLE AS x1, least(greatest(y1, 0), 2159)::DOUBLE AS y1, x2, y2 FROM det) c""")
def clamped_boxes(spark, d):
    return detections(spark, d).withColumns(G.clamp_box(3840.0, 2160.0)).select("frame_idx", *E.BOX)


@query("det", sql="SELECT frame_idx, x1 / f AS x1, y1 / f AS y1, x2 / f AS x2, y2 / f AS y2 FROM (SELECT *, 1280::DOUBLE / 3840 AS f FROM det) s")
def rescaled_boxes(spark, d):
    factor = G.shrink_factor(F.lit(3840), F.lit(2160), 1280)
    return detections(spark, d).select("frame_idx", *[(F.col(c) / factor).alias(c) for c in E.BOX])


#: Walkers: every customer crosses the ground of a camera (its nation) for 40 frames.
WALKERS = """SELECT c_nationkey AS stream_id, c_custkey AS agent_id, c_custkey % 300 + k AS frame_idx,
  ((c_custkey * 37) % 600) / CAST(100 AS DOUBLE) - 3 AS x_world, ((c_custkey * 53) % 1000) / CAST(100 AS DOUBLE) + k * CAST(0.05 AS DOUBLE) AS y_world"""
NOISE = Y.Noise(seed=7)


def walker_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's 40 steps. Few tasks read a file of customers, so these are dealt out before they are multiplied; with a number
    given, parts stay apart though they are small by then."""
    people = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return people.repartition(parts, "c_custkey").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39))))


def synthetic(spark: SparkSession, d: str) -> DataFrame:
    walkers = spark.sql(WALKERS + " FROM {steps}", steps=walker_steps(spark, d))
    spine = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("stream_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(339).cast("long"))).alias("frame_idx"))
    return Y.detect(walkers, spine, H_INV, 3840, 2160, NOISE)


def _chance(salt: str, keys: str, part: int = 0) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{NOISE.seed}:{salt}', {keys})), {1 + 13 * part}, 13))::BIGINT / 4503599627370496::DOUBLE)"


def _normal(salt: str) -> str:
    keys = "stream_id, frame_idx, truth_agent_id, det_id"
    return f"(sqrt(-2 * ln(1 - {_chance(salt, keys)})) * cos(2 * pi() * {_chance(salt, keys, 1)}))"


def _point(r: list[float], x: str) -> str:
    return f"({r[0]!r}::DOUBLE * ({x}) + {r[1]!r}::DOUBLE * y_world + {r[2]!r}::DOUBLE)"


def _at(k: int, x: str) -> str:
    return f"({_point(H_INV[k], x)} / {_point(H_INV[2], x)})"


# how many of a Poisson distribution's cumulative shares (mean 1/2) a chance reaches
_FALSE = f"(list_sum(list_transform(range(18), lambda j: ({_chance('false', 'stream_id, frame_idx')} >= list_sum(list_transform(range(j + 1), lambda i: exp(-0.5::DOUBLE) * pow(0.5::DOUBLE, i) / factorial(i::INT)::DOUBLE)))::INT))::BIGINT)"
_SYNTHETIC = f"""WITH walk AS (SELECT *, abs({_at(0, 'x_world + 0.25::DOUBLE')} - {_at(0, 'x_world - 0.25::DOUBLE')}) AS w FROM ({WALKERS} FROM customer, (SELECT range AS k FROM range(40)) s) q),
box AS (SELECT stream_id, frame_idx, agent_id AS truth_agent_id, 0 AS det_id, {_at(0, 'x_world')} AS cx, {_at(1, 'x_world')} AS y2, w, w * 3.4::DOUBLE AS h FROM walk WHERE {_chance('drop', 'stream_id, frame_idx, agent_id')} >= 0.05::DOUBLE
  UNION ALL SELECT stream_id, frame_idx, -1, det_id, {_chance('false.x', 'stream_id, frame_idx, det_id')} * 3840, {_chance('false.y', 'stream_id, frame_idx, det_id')} * 2160 + 162, 324::DOUBLE / 3.4::DOUBLE, 324
  FROM (SELECT stream_id, frame_idx, unnest(range(1, {_FALSE} + 1)) AS det_id FROM (SELECT n_nationkey AS stream_id, range AS frame_idx FROM nation, range(340)) f) g),
moved AS (SELECT *, cx - w / 2 + 2 * {_normal('x1')} AS a1, y2 - h + 2 * {_normal('y1')} AS b1, cx + w / 2 + 2 * {_normal('x2')} AS a2, y2 + 2 * {_normal('y2')} AS b2, 0.75::DOUBLE + 0.1::DOUBLE * {_normal('conf')} AS c FROM box),
held AS (SELECT *, least(greatest(a1, 0), 3839) AS x1, least(greatest(b1, 0), 2159) AS y1 FROM moved)
SELECT stream_id, frame_idx, truth_agent_id::BIGINT AS truth_agent_id, det_id::INT AS det_id, round(x1, 5) AS x1, round(y1, 5) AS y1, round(least(greatest(a2, x1 + 1), 3840), 5) AS x2, round(least(greatest(b2, y1 + 1), 2160), 5) AS y2, round(least(greatest(c, 0.01::DOUBLE), 1), 5) AS conf FROM held"""


@query(sql=_SYNTHETIC)
def synthetic_detections(spark, d):
    numbers = [F.round(c, 5).alias(c) for c in (*E.BOX, "conf")]
    return synthetic(spark, d).select("stream_id", "frame_idx", F.col("truth_agent_id").cast("long"), "det_id", *numbers)


def tracked_detections(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic detections with track ids. SQL cannot express it; tests follow known walkers."""
    return K.track(synthetic(spark, d)).select("stream_id", "frame_idx", "truth_agent_id", "det_id", "track_id")


_QUERIES["tracked_detections"] = tracked_detections
