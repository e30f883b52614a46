"""Queries that run as streams over the test tables, with the SQL of what they come to.

The tables' rows arrive in parts, in order of time, and a query is started anew for each part, from its checkpoint; a last row, in a stream
of its own, moves the watermark past all others. What the query has told by then is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.plans import registry as R
from groundflow.plans.registry import query
from groundflow.sources import tables as S
from groundflow.sources.kept import shared_folder
from groundflow.streaming import frames as Z
from groundflow.streaming import gate as G
from groundflow.streaming import sinks as K
from groundflow.streaming import totals as Q

ONE = ["stream_id"]
#: Seconds later than any of the tables'.
END = 4_000_000_000.0
#: Rows that a micro-batch of a join takes; what it holds is forgotten once the watermark has passed it.
SLICE_ROWS = 4_000_000


def parts(rows: DataFrame, edges: list[int]) -> list[DataFrame]:
    """rows by frame_idx, cut at the edges."""
    at = F.col("frame_idx")
    return [rows.where(at < edges[0]), *[rows.where((at >= a) & (at < b)) for a, b in zip(edges, edges[1:], strict=False)], rows.where(at >= edges[-1])]


def slices(rows: DataFrame, most: int | None = None) -> list[DataFrame]:
    """rows, cut between frames into tables of about `most` rows at most, in order. They are written once, a folder each."""
    n = -(-rows.count() // (most or SLICE_ROWS))
    if n <= 1:
        return [rows]
    low, found = rows.agg(F.min("frame_idx"), F.percentile_approx("frame_idx", [k / n for k in range(1, n)], 100 * n)).first()
    edges = sorted(set(found) - {low})
    placed = rows.withColumn("_slice", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("frame_idx"))) if edges else F.lit(0))
    path = shared_folder(rows.sparkSession, "slices")
    placed.write.partitionBy("_slice").parquet(path)
    return [rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/_slice={k}") for k in range(len(edges) + 1)]


def closing(rows: DataFrame, later: float = 0.0) -> DataFrame:
    return rows.limit(1).withColumns({"stream_id": F.lit("end"), "t_sec": F.lit(END + later), "frame_idx": F.lit(10**9).cast("long")}).select(rows.columns)


def through(spark: SparkSession, arriving: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append", start: Callable | None = None) -> tuple[DataFrame | None, str]:
    """What the query make(stream) tells, with the number of the micro-batch; and its folder. `start` starts a query with a sink of its own."""
    folder, out = shared_folder(spark, "stream"), None
    # state is cut into as many parts as shuffles have, for good: one for each core, so that all are busy and none waits for another
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(held), spark.sparkContext.defaultParallelism)))
    try:
        for k, rows in enumerate(arriving):
            rows.write.parquet(f"{folder}/in/p{k}")
            out = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"))

            def save(batch: DataFrame, number: int) -> None:
                batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

            started = start(out, folder) if start else out.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            started.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    return (None if start else spark.read.schema(f"{_ddl(out)}, batch int").parquet(f"{folder}/out/*")), folder


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Observations of one stream, with seconds from its start."""
    return R.tracks(spark, d).select(F.lit("a").alias("stream_id"), "track_id", "frame_idx", (F.col("t_sec") - F.lit(1704067200.0)).alias("t_sec"), "x", "y")


@query("gate", sql="SELECT track_id, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM gate GROUP BY 1")
def streamed_gate_counts(spark, d):
    """What the gate accepted and rejected of every track, as its state counts it."""
    found, _ = through(spark, parts(tracks(spark, d), [200, 500]), lambda s: G.gate_counts(s, R.SPEED, None, ONE), "update")
    return found.groupBy("track_id").agg(F.max_by(F.struct("accepted", "rejected"), "batch").alias("c")).select("track_id", "c.accepted", "c.rejected")


@query("gate", sql="""SELECT frame_idx, n, n_accepted, (sum(n) OVER w)::BIGINT AS n_so_far, (sum(n_accepted) OVER w)::BIGINT AS n_accepted_so_far
  FROM (SELECT frame_idx, count(*) AS n, count(*) FILTER (accepted) AS n_accepted FROM gate GROUP BY 1) s WINDOW w AS (ORDER BY frame_idx)""")
def streamed_totals(spark, d):
    """Observations and accepted ones of each frame and so far: gate, counts a frame and running totals in one query."""
    rows = tracks(spark, d)
    rows = rows.withColumn("at", F.col("t_sec")).withColumn("t_sec", F.floor(F.col("t_sec") / 3600) * F.lit(3600.0))  # a frame has one time

    def make(s: DataFrame) -> DataFrame:
        timed = Q.with_event_time(s, "2 hours").withColumn("t_sec", F.col("at"))
        return Q.totals_so_far(G.observed(timed, R.SPEED, R.SAMPLES, None, ONE, ["frame_idx", "event_time"], "event_time"), {"n": F.count("*"), "n_accepted": F.count_if("accepted")}, ONE)

    found, _ = through(spark, [*parts(rows, [350]), closing(rows)], make)
    return found.where("stream_id <> 'end'").select("frame_idx", "n", "n_accepted", "n_so_far", "n_accepted_so_far")


@query("trk", "tframes", sql="SELECT frame_idx, coalesce(n, 0)::BIGINT AS new_ids, (sum(coalesce(n, 0)) OVER (ORDER BY frame_idx))::BIGINT AS ids_so_far FROM tframes LEFT JOIN (SELECT frame_idx, count(*) AS n FROM (SELECT track_id, min(frame_idx) AS frame_idx FROM trk GROUP BY 1) a GROUP BY 1) b USING (frame_idx)")
def streamed_ids_so_far(spark, d):
    """Tracks seen for the first time in each frame and so far."""
    seen = tracks(spark, d).select(*ONE, "track_id", "frame_idx", (F.col("frame_idx") * 3600.0).alias("t_sec"))
    rows = seen.unionByName(seen.select(*ONE, "frame_idx", "t_sec").distinct().withColumn("track_id", F.lit(-1).cast("long")))

    def make(s: DataFrame) -> DataFrame:
        timed = Q.with_event_time(s, "2 hours")
        return Q.ids_so_far(timed.where("track_id >= 0"), timed.where("track_id < 0"), ONE)

    ends = closing(rows).withColumn("track_id", F.explode(F.array(F.lit(0), F.lit(-1)).cast("array<bigint>"))).select(rows.columns)
    found, _ = through(spark, [*parts(rows, [350]), ends], make)
    return found.where("stream_id <> 'end'").select("frame_idx", "new_ids", F.col("new_ids_so_far").alias("ids_so_far"))


@query("det", sql=f"SELECT frame_idx, x1, y1, x2, y2 FROM det a WHERE class_id = 0 AND NOT EXISTS (SELECT 1 FROM det b WHERE b.conf_pct >= 5 AND a.frame_idx = b.frame_idx AND {R._SAME})")
def streamed_unmatched_boxes(spark, d):
    """Boxes without a sure box in the same place, from two streams that are joined as they come."""
    boxes = R.detections(spark, d).select(F.lit("a").alias("stream_id"), "frame_idx", "t_sec", "class_id", "conf_pct", *E.BOX)
    rows = boxes.withColumn("side", F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in (("a", F.col("class_id") == 0), ("b", F.col("conf_pct") >= 5))]))).where("side is not null")

    def make(s: DataFrame) -> DataFrame:
        timed = Q.with_event_time(s, "1 second")
        return Q.unmatched(timed.where("side = 'a'"), timed.where("side = 'b'"), ONE)

    ends = [closing(rows, later).withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).select(rows.columns) for later in (0.0, 100.0)]
    found, _ = through(spark, [*(s for part in parts(rows, [7500]) for s in slices(part)), *ends], make)
    return found.where("stream_id <> 'end'").select("frame_idx", *E.BOX)


@query("trk", "tframes", sql=f"""SELECT frame_idx, col, "row", value FROM (SELECT frame_idx, col, "row", sum(coalesce(n, 0)) OVER w / (count(*) OVER w)::DOUBLE AS value
  FROM (SELECT *, (frame_idx >= 150)::INT + (frame_idx >= 430)::INT AS segment FROM tframes) f CROSS JOIN (SELECT CAST(range AS INT) AS col FROM range(10)) a CROSS JOIN (SELECT CAST(range AS INT) AS "row" FROM range(10)) b
  LEFT JOIN (SELECT frame_idx, CAST(floor(x / 10) AS INT) AS col, CAST(floor(y / 10) AS INT) AS "row", count(*) AS n FROM trk WHERE x >= 0 AND x < 100 AND y >= 0 AND y < 100 GROUP BY ALL) c USING (frame_idx, col, "row")
  WINDOW w AS (PARTITION BY segment, col, "row" ORDER BY t_sec RANGE BETWEEN {R.WINDOW_S}::DOUBLE PRECEDING AND CURRENT ROW)) s WHERE value > 0""")
def streamed_density_with_resets(spark, d):
    """Rolling density on a stream that is told to start anew at frames 150 and 430."""
    points = tracks(spark, d).groupBy(*ONE, "frame_idx").agg(F.collect_list(F.struct("x", "y")).alias("points"))
    frames = R.track_frames(spark, d).withColumn("stream_id", F.lit("a")).join(points, [*ONE, "frame_idx"], "left").withColumn("reset", F.lit(False))
    orders = spark.createDataFrame([("a", 150), ("a", 430)], "stream_id string, frame_idx long").withColumns({"t_sec": F.lit(None).cast("double"), "points": F.lit(None).cast(frames.schema["points"].dataType), "reset": F.lit(True)})
    rows = frames.unionByName(orders)
    found, _ = through(spark, parts(rows, [200, 500]), lambda s: Z.rolling_density(s, D.Grid(0.0, 0.0, 10.0, 10, 10), R.WINDOW_S, idle=None))
    return found.select("frame_idx", "col", "row", "value")


@query("det", sql="""SELECT count(*) AS n_tracks, sum(n)::BIGINT AS n_rows, round(min(life), 6) AS life_min, round(quantile_cont(life, 0.5), 6) AS life_median, round(quantile_cont(life, 0.9), 6) AS life_p90, round(max(life), 6) AS life_max,
  avg((life >= 1)::INT) AS ge_1_0s, avg((life >= 2.5)::INT) AS ge_2_5s, sum(n)::DOUBLE / 15000::DOUBLE AS mean_simultaneous FROM (SELECT frame_idx % 997, max(t_sec) - min(t_sec) AS life, count(*) AS n FROM det GROUP BY 1) s""")
def streamed_churn(spark, d):
    """Churn told at the end of a stream whose trajectory rows were logged."""
    rows = S.trajectory(R.projected(spark, d).withColumn("track_id", F.col("frame_idx") % 997))
    start = lambda out, folder: K.log_trajectory(out, f"{folder}/log", f"{folder}/checkpoint", "parquet")
    _, folder = through(spark, parts(rows, [5000, 10_000]), lambda s: s, start=start)
    found = K.close_trajectory(spark, f"{folder}/log", 15_000).drop("total_frames")
    return found.withColumns({c: F.round(c, 6) for c in ("life_min", "life_median", "life_p90", "life_max")})


@query(sql=R.kept_boxes_sql("minute", "class_id").replace("FROM det GROUP BY minute", "FROM (SELECT *, frame_idx // 100 AS minute FROM det) m GROUP BY minute") + "SELECT minute AS frame_idx, class_id, conf, x1, y1, x2, y2 FROM kept_boxes")
def crowded_nms(spark, d):
    """Overlap suppression of crowded frames, by cells and rounds: the boxes of a hundred frames in one."""
    boxes = R.detections(spark, d).withColumn("frame_idx", F.floor(F.col("frame_idx") / 100))
    return E.suppress_crowded(boxes, 0.3).select("frame_idx", "class_id", "conf", *E.BOX)
