import itertools
import math
import os
from collections import deque

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundflow.functions import geometry as G
from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.operators import tracks as T
from groundflow.plans import catalogue, registry
from groundflow.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings", "customer", "nation", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    assert len(got) == len(want)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_corners_hit_the_ground(spark):
    for (x, y), world in zip(registry.QUAD, registry.WORLD, strict=True):
        got = spark.range(1).select(*G.to_ground(registry.H, F.lit(x), F.lit(y))).first()
        assert got[0] == pytest.approx(world[0], abs=1e-3) and got[1] == pytest.approx(world[1], abs=1e-3)


def test_quads():
    rect = [(0, 0), (4, 0), (4, 6), (0, 6)]
    assert G.edge_lengths(rect) == [4, 6, 4, 6] and G.area(rect) == 24
    quad = [(100, 500), (500, 500), (420, 100), (180, 100)]
    record = G.calibration_record("v", 0, (640, 640), quad, 4.0, 6.0, "USER_MEASURED", "", "")
    assert record["round_trip_error_px"] < 1 and record["far_edge_scale_m_per_px"] > record["near_edge_scale_m_per_px"]
    for bad in ([quad[k] for k in (0, 2, 1, 3)], [quad[0], quad[1], (300, 400), quad[3]]):
        with pytest.raises(G.QuadError):
            G.check_quad(bad)
    with pytest.raises(ValueError):
        G.fit_homography(quad[:3], rect[:3])
    with pytest.warns(UserWarning):
        G.fit_homography([(0, 500), (100, 500.5), (200, 501), (300, 501.5001)], rect)


def _ray(x, y, poly):
    inside = False
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1], strict=True):
        if min(ay, by) < y <= max(ay, by) and x <= max(ax, bx) and (ax == bx or x <= (y - ay) * (bx - ax) / (by - ay) + ax):
            inside = not inside
    return inside


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 4000), st.floats(0, 2200)), min_size=50, max_size=50))
def test_polygon(spark, points):
    points = points + registry.QUAD
    got = spark.createDataFrame([(float(a), float(b)) for a, b in points], "x double, y double").select("x", "y", G.in_polygon(registry.QUAD, F.col("x"), F.col("y"))).collect()
    assert all(r[2] == _ray(r[0], r[1], registry.QUAD) for r in got)


def test_gate_and_velocity(spark):
    rows = [(1, float(t), float(x), 0.0) for t, x in ((0, 0), (1, 1), (2, 50), (3, 3), (4, 60))]
    gated = T.speed_gate(spark.createDataFrame(rows, "track_id long, t_sec double, x double, y double"), 10.0)
    assert [r.t_sec for r in gated.where("accepted").orderBy("t_sec").collect()] == [0, 1, 3]
    last = T.velocity(gated.where("accepted"), 3).orderBy("t_sec").collect()
    assert [r.v_x for r in last] == pytest.approx([0, 1, 1]) and [r.window_full for r in last] == [False, False, True]


def test_moving_average_starts_with_the_second_row(spark):
    got = {}
    for r in catalogue.queries()["moving_average_up_to_30"](spark, SF).orderBy("track_id", "t_sec").collect():
        got.setdefault(r.track_id, []).append(r)
    for rows in got.values():
        steps = deque(maxlen=30)
        assert rows[0].rate is None
        for before, r in itertools.pairwise(rows):
            steps.append(r.t_sec - before.t_sec)
            assert r.rate == pytest.approx(len(steps) / sum(steps), abs=1e-11)
    rows = [(1, float(t), 0.0, 0.0) for t in (0, 1, 3)] + [(2, 5.0, 0.0, 0.0), (2, 5.0, 1.0, 0.0)]
    rates = [r.rate for r in T.step_rate(spark.createDataFrame(rows, "track_id long, t_sec double, x double, y double"), 2).orderBy("track_id", "t_sec", "x").collect()]
    assert rates == [None, 1.0, pytest.approx(2 / 3), None, None]


def test_churn_of_known_tracks(spark):
    rows = [(1, k / 30) for k in range(30)] + [(2, k / 30) for k in range(90)] + [(3, 5 / 30)]
    got = T.churn(spark.createDataFrame(rows, "track_id long, t_sec double"), 90).first()
    assert (got.n_tracks, got.n_rows) == (3, 121) and got.life_median == pytest.approx(29 / 30) and got.ge_1_0s == pytest.approx(1 / 3)
    assert T.churn(spark.createDataFrame([], "track_id long, t_sec double"), 0).first().life_max == 0.0


def test_smoothing_keeps_mass(spark):
    grid = D.Grid.over([(0, 0), (4, 0), (4, 6), (0, 6)], 1.0)
    assert (grid.n_cols, grid.n_rows) == (4, 6)
    values = spark.createDataFrame([(0, 1, 2, 5.0)], "frame_idx long, col int, row int, value double")
    assert D.smoothed(values, grid, 1.0).agg(F.sum("value")).first()[0] == pytest.approx(5.0)
    got = spark.range(1).select(D.colour(F.lit(-5.0)).alias("a"), D.colour(F.lit(999.0)).alias("b"), D.colour(F.lit(2.5)).alias("c")).first()
    assert tuple(got.a) == (200, 255, 255) and tuple(got.b) == (0, 0, 255) and tuple(got.c) == (0, 30, 255)
    with pytest.raises(ValueError):
        D.Grid.over([(0, 0)], 1.0)


def test_suppression_is_idempotent(spark):
    boxes = registry.detections(spark, SF).limit(2000)
    once = E.suppress(boxes, 0.3)
    assert once.count() == E.suppress(once, 0.3).count()


def test_trajectory_round_trip(spark, tmp_path):
    rows = S.trajectory(registry.projected(spark, SF).withColumns({"track_id": F.lit(1).cast("long")}))
    S.write_trajectory_csv(rows, str(tmp_path / "t"))
    back = S.read_trajectory_csv(spark, str(tmp_path / "t"))
    assert back.count() == rows.count() and back.where("world_x_m is null").count() == rows.where("in_quad = 0").count()
    part = next(p for p in os.listdir(tmp_path / "t") if p.endswith(".csv"))
    assert (tmp_path / "t" / part).read_text().startswith("frame_idx,timestamp_s,track_id,bbox_x1,bbox_y1,bbox_x2,bbox_y2,conf,foot_px_x,foot_px_y,world_x_m,world_y_m,in_quad,tile_source")


def test_stream_equals_batch(spark, tmp_path):
    from groundflow.streaming.gate import gated_velocity

    obs = registry.tracks(spark, SF).select("track_id", "t_sec", "x", "y")
    obs.write.parquet(str(tmp_path / "in"))
    stream = gated_velocity(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")), registry.SPEED, 5, idle=None)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.track_id, r.t_sec): r.v_x for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.track_id, r.t_sec): r.v_x for r in T.velocity(T.speed_gate(obs, registry.SPEED).where("accepted"), 5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
