"""Streams against their batch forms, over several micro-batches and a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from groundflow.operators import detections as E
from groundflow.operators import tracks as T
from groundflow.plans import registry
from groundflow.streaming import gate as G
from groundflow.streaming import totals as Q

SF = "/root/testdata/sf0.001"
ONE = ["stream_id"]
END = 4_000_000_000.0  # a row of a stream of its own that moves the watermark past all others


class Feed:
    """Files that arrive one after the other; the query is started anew for each, from its checkpoint."""

    def __init__(self, spark, folder, schema, make, mode="append"):
        self.spark, self.folder, self.schema, self.make, self.mode = spark, folder, schema, make, mode

    def arrive(self, rows, name):
        rows.coalesce(1).write.mode("append").parquet(str(self.folder / "in" / name))

    def go(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in" / "*"))
        out = self.make(source)
        self.out_schema = out.schema
        save = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(str(self.folder / "out" / f"{k}"))
        q = out.writeStream.foreachBatch(save).outputMode(self.mode).option("checkpointLocation", str(self.folder / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    def found(self):
        return self.spark.read.schema(StructType([*self.out_schema, StructField("batch", IntegerType())])).parquet(str(self.folder / "out" / "*"))


@pytest.fixture(scope="module")
def walks(spark):
    """Tracks in order, of three streams that use the same numbers."""
    rows = registry.tracks(spark, SF).select((F.col("track_id") % 3).cast("string").alias("stream_id"), F.floor(F.col("track_id") / 3).alias("track_id"), "frame_idx", (F.col("frame_idx") * 3600.0).alias("t_sec"), "x", "y")
    return rows.dropDuplicates(["stream_id", "track_id", "frame_idx"]).cache()


def in_parts(rows, column="frame_idx", parts=3):
    low, high = rows.agg(F.min(column), F.max(column)).first()
    cuts = np.linspace(low, high + 1, parts + 1)
    return [rows.where((F.col(column) >= float(a)) & (F.col(column) < float(b))) for a, b in zip(cuts, cuts[1:], strict=False)]


def test_gate_and_counts_equal_batch(spark, tmp_path, walks):
    want = T.speed_gate(walks, 0.02, ONE)
    feed = Feed(spark, tmp_path, walks.schema, lambda s: G.observed(s, 0.02, 5, None, ONE, ["frame_idx"]))
    for k, part in enumerate(in_parts(walks)):
        feed.arrive(part, f"p{k}")
        feed.go()  # each from the checkpoint of the one before
    got = feed.found()
    key = lambda r: (r.stream_id, r.track_id, r.t_sec, r.x, r.y)
    assert {key(r): r.accepted for r in got.collect()} == {key(r): r.accepted for r in want.collect()}
    fast = {key(r): (r.v_x, r.v_y, r.window_full) for r in T.velocity(want.where("accepted"), 5, ONE).collect()}
    slow = {key(r): (r.v_x, r.v_y, r.window_full) for r in got.where("accepted").collect()}
    assert fast.keys() == slow.keys() and all(fast[k][2] == slow[k][2] and slow[k][:2] == pytest.approx(fast[k][:2], rel=1e-6, abs=1e-9) for k in fast)
    assert all(r.v_x is None and r.v_y is None for r in got.where("not accepted").collect())
    last = got.groupBy(*ONE, "track_id").agg(F.max("n_accepted").alias("a"), F.max("n_rejected").alias("r")).where("r > 0")
    assert {tuple(r) for r in last.collect()} == {tuple(r)[:4] for r in T.rejections(want, ONE).collect()}


def test_gate_counts_come_out(spark, tmp_path, walks):
    feed = Feed(spark, tmp_path, walks.schema, lambda s: G.gate_counts(s, 0.02, None, ONE), "update")
    for k, part in enumerate(in_parts(walks)):
        feed.arrive(part, f"p{k}")
        feed.go()
    last = feed.found().groupBy(*ONE, "track_id").agg(F.max_by(F.struct("accepted", "rejected"), "batch").alias("c")).select(*ONE, "track_id", "c.*").where("rejected > 0")
    assert {tuple(r) for r in last.collect()} == {tuple(r)[:4] for r in T.rejections(T.speed_gate(walks, 0.02, ONE), ONE).collect()}
    assert feed.found().where("closed").count() == 0


def test_idle_tracks_are_closed(spark, tmp_path):
    """A track that sends nothing more is closed by its timer, with its counts; if it comes back, it starts anew."""
    import time

    rows = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 1, 1.0, 50.0, 0.0), ("a", 1, 2.0, 1.0, 0.0)], "stream_id string, track_id long, t_sec double, x double, y double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "*"))
    out = G.gate_counts(source, 2.0, "1 second", ONE)
    q = out.writeStream.format("memory").queryName("closed_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("closed_counts").where("closed").count():
                break
            time.sleep(0.5)
        assert {tuple(r) for r in spark.table("closed_counts").collect()} == {("a", 1, 2, 1, False), ("a", 1, 2, 1, True)}
        rows.limit(1).coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
        for _ in range(120):
            if spark.table("closed_counts").where("accepted = 1").count():
                break
            time.sleep(0.5)
        assert spark.table("closed_counts").where("accepted = 1 and rejected = 0").count() >= 1
    finally:
        q.stop()


def test_gate_of_nulls_and_ties():
    t = np.array([0.0, 1.0, 1.0, np.nan, 2.0])
    assert G.slopes(t, np.array([0.0, 2.0, 4.0, 1.0, np.nan]), 3).tolist() == pytest.approx([0.0, 2.0, 3.0, 0.0, 0.0])
    assert G.slopes(np.zeros(3), np.arange(3.0), 2).tolist() == [0.0, 0.0, 0.0] and len(G.slopes(np.zeros(0), np.zeros(0), 4)) == 0


def closing(rows):
    """A row far later, in a stream of its own."""
    return rows.limit(1).withColumns({"stream_id": F.lit("end"), "t_sec": F.lit(END), "frame_idx": F.lit(10**9).cast("long")}).select(rows.columns)


def test_chained_totals_equal_batch(spark, tmp_path, walks):
    """Gate, counts a frame and running totals in one query."""

    def make(s):
        rows = Q.with_event_time(s, "2 hours")
        seen = G.observed(rows, 0.02, 5, None, ONE, ["frame_idx", "event_time"], "event_time")
        return Q.totals_so_far(seen, {"total": F.count("*"), "tracked": F.count_if("accepted"), "moving": F.count_if(F.col("accepted") & (F.hypot("v_x", "v_y") > 0.001))}, ONE)

    feed = Feed(spark, tmp_path, walks.schema, make)
    parts = in_parts(walks)
    for k, part in enumerate([*parts, closing(walks)]):
        feed.arrive(part, f"p{k}")
        feed.go()
    got = {(r.stream_id, r.frame_idx): tuple(r)[3:9] for r in feed.found().where("stream_id <> 'end'").collect()}
    gated = T.speed_gate(walks, 0.02, ONE)
    fast = T.velocity(gated.where("accepted"), 5, ONE).withColumn("moving", F.hypot("v_x", "v_y") > 0.001).select(*ONE, "track_id", "t_sec", "x", "y", "moving")
    rows = gated.join(fast, [*ONE, "track_id", "t_sec", "x", "y"], "left")
    per = rows.groupBy(*ONE, "frame_idx").agg(F.count("*").alias("total"), F.count_if("accepted").alias("tracked"), F.count_if("moving").alias("moving"))
    want = E.running_totals(per, ["total", "tracked", "moving"], ONE)
    assert got == {(r.stream_id, r.frame_idx): tuple(r)[2:8] for r in want.collect()}


def test_ids_so_far_equal_batch(spark, tmp_path, walks):
    spine = walks.select(*ONE, "frame_idx", "t_sec").distinct()
    rows = walks.select(*ONE, "track_id", "frame_idx", "t_sec").unionByName(spine.withColumn("track_id", F.lit(-1).cast("long")))

    def make(s):
        rows = Q.with_event_time(s, "3 hours")
        return Q.ids_so_far(rows.where("track_id >= 0"), rows.where("track_id < 0"), ONE)

    feed = Feed(spark, tmp_path, rows.schema, make)
    a, b, c = in_parts(rows)
    edge = rows.where(F.col("frame_idx") == a.agg(F.max("frame_idx")).first()[0])
    last = edge.where("track_id >= 0").limit(2)
    for k, part in enumerate([a.exceptAll(last), last, b, c, closing(rows), closing(rows).withColumn("track_id", F.lit(-1).cast("long"))]):
        feed.arrive(part, f"p{k}")
        feed.go()
    got = {(r.stream_id, r.frame_idx): (r.new_ids, r.new_ids_so_far) for r in feed.found().where("stream_id <> 'end'").collect()}
    want = T.ids_so_far(walks, spine.select(*ONE, "frame_idx"), 100, ONE)
    assert got == {(r.stream_id, r.frame_idx): (r.new_ids, r.ids_so_far) for r in want.collect()}


def test_unmatched_boxes_equal_batch(spark, tmp_path):
    boxes = registry.detections(spark, SF).select(F.lit("a").alias("stream_id"), "frame_idx", "t_sec", "class_id", "conf_pct", *E.BOX)
    candidates, reference = boxes.where("class_id = 0"), boxes.where("conf_pct >= 5")
    rows = candidates.withColumn("side", F.lit("a")).unionByName(reference.withColumn("side", F.lit("b")))

    def make(s):
        rows = Q.with_event_time(s, "1 second")
        return Q.unmatched(rows.where("side = 'a'"), rows.where("side = 'b'"), ONE)

    feed = Feed(spark, tmp_path, rows.schema, make)
    ends = closing(rows).withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).select(rows.columns)
    late = rows.where("side = 'b'").limit(1)  # its frame is over: passed over, and nothing is told twice
    for k, part in enumerate([*in_parts(rows), ends, ends.withColumn("t_sec", F.lit(END + 100)), late]):
        feed.arrive(part, f"p{k}")
        feed.go()
    got = feed.found().where("stream_id <> 'end'").groupBy("frame_idx", *E.BOX).count()
    want = E.unmatched(candidates, reference, ONE).groupBy("frame_idx", *E.BOX).count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 100


def test_forgotten_tracks_count_anew(spark, tmp_path):
    """With a limit, a track that was away for longer is a new one; one that was not is still known."""
    times = {0: [0, 1, 2], 1: [0, 50, 90, 130], 2: [100, 300]}
    rows = spark.createDataFrame([("a", k, t, float(t)) for k, ts in times.items() for t in ts], "stream_id string, track_id long, frame_idx long, t_sec double")
    feed = Feed(spark, tmp_path, rows.schema, lambda s: Q.first_sightings(Q.with_event_time(s, "1 second"), ONE, "60 seconds"))
    for k, (low, high) in enumerate([(0, 3), (3, 60), (60, 120), (120, 200), (200, 400)]):
        feed.arrive(rows.where((F.col("frame_idx") >= low) & (F.col("frame_idx") < high)), f"p{k}")
        feed.go()
    feed.arrive(closing(rows), "end")
    feed.go()
    got = sorted((r.track_id, r.frame_idx) for r in feed.found().where("stream_id <> 'end'").collect())
    assert got == [(0, 0), (1, 0), (2, 100), (2, 300)]
