"""What grows with the input is shared out: plans and tasks on small tables that are read by one task."""

import numpy as np
from pyspark.sql import functions as F

from groundflow.functions.ranks import exact_percentiles
from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.plans import registry
from groundflow.plans import streamed_queries as W
from groundflow.streaming import frames as Z

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_a_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_walkers_are_made_by_many_tasks(spark):
    steps = registry.walker_steps(spark, SF)
    per = rows_a_task(steps)
    assert len(per) >= 4 and sum(per) == 150 * 40 and max(per) < sum(per) / 2
    boxes = rows_a_task(registry.synthetic(spark, SF))
    assert max(boxes) < sum(boxes) / 2


def test_truth_is_not_broadcast_whole(spark):
    """A small table that is multiplied out is taken for small; the join may not gather it in every executor."""
    truth = registry.walker_steps(spark, SF).selectExpr("c_custkey % 300 + k AS frame_id", "c_custkey AS agent_id", "0.0D AS x_world", "0.0D AS y_world")
    boxes = spark.range(10).selectExpr("id AS frame_idx", "id AS truth_agent_id")
    plan = plan_of(E.with_truth(boxes, truth))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rows_of_few_cameras_stay_where_they_are(spark):
    """Calibrations go to the rows: by stream, all rows would meet in as many tasks as there are cameras."""
    from groundflow.plans import stream_queries as Q

    plan = plan_of(E.project_each(Q.cameras(spark, SF), Q.calibrations(spark), Q.STREAM))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_percentiles_of_few_groups_are_shared_out(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(0, 30_000, 1, 4).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(9_000)).cast("double").alias("v"))
    found = exact_percentiles(rows, "v", [0.0, 0.25, 0.5, 1.0], ["g"])
    joins = [line for line in plan_of(found).splitlines() if "SortMergeJoin" in line]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert joins and all("_part" in line for line in joins)
    want = {g: [float(np.quantile(np.array(v), s)) for s in (0.0, 0.25, 0.5, 1.0)] for g, v in rows.groupBy("g").agg(F.collect_list("v")).collect()}
    assert {r.g: [r.p0, r.p1, r.p2, r.p3] for r in found.collect()} == want


def test_state_has_a_part_for_each_core(spark, tmp_path):
    held, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(40).selectExpr("'a' AS stream_id", "id AS frame_idx", "CAST(id AS DOUBLE) AS t_sec")
        make = lambda s: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or s
        W.through(spark, [rows], make)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert seen == [str(spark.sparkContext.defaultParallelism)]


def test_slices_keep_order_frames_and_rows(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 4).selectExpr("id * id % 97 AS frame_idx", "id")
    cut = W.slices(rows, 100)
    got = [[(r.frame_idx, r.id) for r in s.collect()] for s in cut]
    assert len(got) > 5 and sorted(sum(got, [])) == sorted((r.frame_idx, r.id) for r in rows.collect())
    assert all(max(a)[0] < min(b)[0] for a, b in zip(got, got[1:], strict=False)) and max(map(len, got)) < 200
    assert W.slices(rows, 1000) == [rows]
    # a join that gets its boxes in many micro-batches tells the same
    monkeypatch.setattr(W, "SLICE_ROWS", 2000)
    sliced = W.streamed_unmatched_boxes(spark, SF).collect()
    want = registry.unmatched_boxes(spark, SF).collect()
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, want))


def test_points_reach_the_state_as_numbers(spark):
    """A frame of very many points is no list of records in Python."""
    frames = spark.createDataFrame([("a", 0, 0.0, [(1.0, 1.0)])], "stream_id string, frame_idx long, t_sec double, points array<struct<x: double, y: double>>")
    plan = Z.rolling_density(frames, D.Grid(0.0, 0.0, 10.0, 10, 10), 5.0, idle=None)._jdf.queryExecution().analyzed().toString()
    assert "AS cells" in plan
