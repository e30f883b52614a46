"""Two cameras whose frames and tracks carry the same numbers must not meet; readers and writers; single functions."""

import json
from collections import deque
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundflow.functions import geometry as G
from groundflow.functions.ranks import exact_percentiles
from groundflow.operators import analyses as A
from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.operators import detector as P
from groundflow.operators import tracks as T
from groundflow.plans import registry
from groundflow.sources import tables as S
from groundflow.streaming import frames as Z

BOXES = "stream_id string, frame_idx long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, det_id long"
ONE = [("a", 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0, 1), ("a", 0, 0, 0.8, 1.0, 0.0, 11.0, 10.0, 2)]
TWO = [("b", *r[1:8], r[8] + 10) for r in ONE] + [("b", 1, 0, 0.7, 0.0, 12.0, 10.0, 22.0, 13), ("b", 1, 0, 0.6, 0.0, 0.0, 10.0, 10.0, 14)]
TRACKS = "stream_id string, track_id long, frame_idx long, t_sec double, x double, y double"


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame(ONE + TWO, BOXES)


@pytest.fixture(scope="module")
def walks(spark):
    """Track 1 in both cameras: one walks to the right, the other one stands elsewhere."""
    rows = [(s, 1, k, k / 10, x + k * dx, 0.0) for s, x, dx in (("a", 0.0, 0.1), ("b", 500.0, 0.0)) for k in range(20)]
    return spark.createDataFrame(rows, TRACKS)


def test_suppression_keeps_cameras_apart_and_rows_whole(spark, boxes):
    got = {(r.stream_id, r.det_id) for r in E.suppress(boxes, 0.5, ["stream_id"]).collect()}
    assert got == {("a", 1), ("b", 11), ("b", 13), ("b", 14)}
    assert E.suppress(boxes, 0.5, ["stream_id"]).columns == boxes.columns
    counts = {(r.stream_id, r.frame_idx): (r.n_before, r.n_after) for r in P.tile_counters(boxes, 0.5, ["stream_id"]).collect()}
    assert counts == {("a", 0): (2, 1), ("b", 0): (2, 1), ("b", 1): (2, 2)}
    assert E.suppress(boxes.limit(0), 0.5, ["stream_id"]).count() == 0


def test_matching_keeps_cameras_apart(boxes):
    a, b = boxes.where("stream_id = 'a'"), boxes.where("stream_id = 'b'")
    assert E.matched(a, b).count() == 2  # one camera's table: equal frame numbers meet
    assert E.matched(a, b, ["stream_id"]).count() == 0 and E.unmatched(a, b, ["stream_id"]).count() == 2
    assert {r.stream_id for r in E.stacked_pairs(boxes, streams=["stream_id"]).collect()} == {"b"}


def test_tracks_of_two_cameras(walks):
    life = {r.stream_id: (r.lifetime_s, r.n_observations) for r in T.lifetimes(walks, ["stream_id"]).collect()}
    assert life == {"a": (1.9, 20), "b": (1.9, 20)}
    assert T.churn(walks, 40, ["stream_id"]).first().n_tracks == 2
    assert T.speed_gate(walks, 2.0, ["stream_id"]).where("not accepted").count() == 0
    assert T.speed_gate(walks, 2.0).where("not accepted").count() > 0  # as one camera the two would be one track
    last = {r.stream_id: r.v_x for r in T.velocity(walks, 5, ["stream_id"]).where("frame_idx = 19").collect()}
    assert last["a"] == pytest.approx(1.0) and last["b"] == 0
    frames = walks.select("stream_id", "frame_idx").distinct()
    assert [r.ids_so_far for r in T.ids_so_far(walks, frames, 7, ["stream_id"]).collect()] == [1] * 40
    rates = T.step_rate(walks, 5, ["stream_id"]).where("frame_idx = 0").collect()
    assert len(rates) == 2 and all(r.rate is None for r in rates)


def test_gate_equals_a_loop_over_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for track in range(40):
        t = np.cumsum(rng.choice([0.0, 0.1, 0.2], 60, p=[0.1, 0.6, 0.3]))
        rows += [(None if k == 7 else "a", track, k, float(t[k]), float(rng.normal() * (5 if rng.random() < 0.2 else 0.2)), 0.0) for k in range(60)]
    got = {(r.stream_id, r.track_id, r.frame_idx): r.accepted for r in T.speed_gate(spark.createDataFrame(rows, TRACKS).repartition(3), 5.0, ["stream_id"]).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[4])):
            ok = last is None or not (r[3] > last[3] and abs(r[4] - last[4]) / (r[3] - last[3]) > 5.0)
            last = r if ok else last
            want[r[:3]] = ok
    assert got == want and not all(want.values())


def test_density_of_two_cameras(spark, walks):
    frames = walks.select("stream_id", "frame_idx", "t_sec")
    series = D.frame_density(walks.where("stream_id = 'a'"), frames, 4.0, 1.0, ["stream_id"])
    assert {(r.stream_id, r.in_quad) for r in series.collect()} == {("a", 1), ("b", 0)}
    summary = {r.stream_id: r.persons for r in D.density_summary(series, 4.0, ["stream_id"]).collect()}
    assert summary == {"a": 20, "b": 0}
    report = {r.stream_id: (r.n_records, r.busiest) for r in D.density_report(series, walks.withColumn("in_quad", F.col("x") < 100), 4.0, 1.0, ["stream_id"]).collect()}
    assert report == {"a": (20, [0, 0, 10]), "b": (20, None)}
    assert [(r.stream_id, r.ci, r.n) for r in D.busiest_cell(walks, 1.0, ["stream_id"]).orderBy("stream_id").collect()] == [("a", 0, 10), ("b", 500, 20)]


@pytest.mark.parametrize("block_seconds", [None, 0.3, 1.0, 7.0])
def test_rolling_equals_a_window_over_frames(spark, block_seconds):
    rng = np.random.default_rng(2)
    grid, rows, spine = D.Grid(0.0, 0.0, 1.0, 3, 2), [], []
    for stream in ("a", "b"):
        for k in range(60):
            spine.append((stream, k, k / 10))
            rows += [(stream, k, float(rng.uniform(-1, 4)), float(rng.uniform(0, 2))) for _ in range(int(rng.integers(0, 4)))]
    got = {(r.stream_id, r.frame_idx, r.col, r.row): r.value for r in D.rolling(spark.createDataFrame(rows, "stream_id string, frame_idx long, x double, y double"), spark.createDataFrame(spine, "stream_id string, frame_idx long, t_sec double"), grid, 0.5, ["stream_id"], block_seconds).collect()}
    want, counted = {}, {}
    for stream in ("a", "b"):
        held = deque()
        for s, k, t in (x for x in spine if x[0] == stream):
            held.append((t, [(int(np.floor(r[2])), int(np.floor(r[3]))) for r in rows if r[0] == s and r[1] == k]))
            while held[0][0] < t - 0.5:
                held.popleft()
            counted[s, k] = len(held)
            for c in range(3):
                for r in range(2):
                    want[s, k, c, r] = sum(p.count((c, r)) for _, p in held) / len(held)
    assert got == pytest.approx(want)
    n = D.frames_in_window(spark.createDataFrame(spine, "stream_id string, frame_idx long, t_sec double"), 0.5, ["stream_id"], block_seconds)
    assert {(r.stream_id, r.frame_idx): r.n_frames for r in n.collect()} == counted


def test_projection_of_each_camera(spark):
    quads = {"a": [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], "b": [(100.0, 0.0), (120.0, 0.0), (110.0, 10.0), (100.0, 10.0)]}
    rows = [(k, G.fit_homography(q, [(0, 0), (1, 0), (1, 1), (0, 1)]), [list(p) for p in q]) for k, q in quads.items()]
    cal = spark.createDataFrame(rows, "stream_id string, H array<array<double>>, image_points array<array<double>>")
    rng = np.random.default_rng(1)
    boxes = [(s, k, float(x), float(y) - 1, float(x), float(y)) for k in range(300) for s, x, y in [(("a", "b", "c")[k % 3], rng.uniform(-5, 125), rng.uniform(-5, 15))]]
    got = E.project_each(spark.createDataFrame(boxes, "stream_id string, frame_idx long, x1 double, y1 double, x2 double, y2 double"), cal, ["stream_id"]).collect()
    for s, q in quads.items():
        own = spark.createDataFrame([b for b in boxes if b[0] == s], "stream_id string, frame_idx long, x1 double, y1 double, x2 double, y2 double")
        want = {r.frame_idx: (r.in_quad, r.world_x) for r in E.project(own, rows[s == "b"][1], q).collect()}
        assert {r.frame_idx: (r.in_quad, r.world_x) for r in got if r.stream_id == s} == want
    assert not any(r.in_quad for r in got if r.stream_id == "c") and len(got) == len(boxes)


def test_homography_equals_exact_fractions():
    """The fit against a solution in fractions: the projective map is the square's to the target's after the inverse of the square's to the source's."""

    def of_square(points):
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = [(Fraction(a), Fraction(b)) for a, b in points]
        sx, sy, dx1, dx2, dy1, dy2 = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3, x1 - x2, x3 - x2, y1 - y2, y3 - y2
        det = dx1 * dy2 - dx2 * dy1
        g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
        return [[x1 - x0 + g * x1, x3 - x0 + h * x3, x0], [y1 - y0 + g * y1, y3 - y0 + h * y3, y0], [g, h, Fraction(1)]]

    def times(a, b):
        return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]

    def adjoint(m):
        minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
        return [[minor(j, i) for j in range(3)] for i in range(3)]

    exact = times(of_square(registry.WORLD), adjoint(of_square(registry.QUAD)))
    exact = [[float(v / exact[2][2]) for v in row] for row in exact]
    assert np.allclose(registry.H, exact, rtol=1e-9, atol=1e-12)
    back = times(of_square(registry.QUAD), adjoint(of_square(registry.WORLD)))
    back = np.array([[float(v) for v in row] for row in back])
    assert np.allclose(np.array(registry.H_INV) / registry.H_INV[2][2], back / back[2, 2], rtol=1e-9)
    assert registry.AREA == 90.0


def test_sizes_and_quads():
    assert G.ground_size() == (7.0, 5.25, "ESTIMATED") and G.ground_size(3.0) == (3.0, 5.25, "USER_MEASURED") and G.ground_size(height_m=2) == (7.0, 2.0, "USER_MEASURED")
    quad = [(100, 500), (500, 500), (420, 100), (180, 100)]
    for w, h in ((0.0, 6.0), (4.0, -1.0), (float("nan"), 1.0)):
        with pytest.raises(ValueError, match="positive"):
            G.calibration_record("v", 0, (640, 640), quad, w, h, "USER_MEASURED", "", "")
    assert G.rounded_quad([(0.5, 1.5), (2.5, 3.4), (1, 1), (-0.5, 0)]) == [(0, 2), (2, 3), (1, 1), (0, 0)]


def test_tilings():
    assert E.Tiling().overlap == (128, 128) and E.Tiling(25, 45, 0.1).overlap == (2, 4) and E.Tiling(640, 640, overlap_px=(100, 50)).overlap == (100, 50)
    for bad in ({"ratio": 1.0}, {"overlap_px": (1280, 0)}, {"threshold": 1.5}, {"ratio": -0.1}):
        with pytest.raises(ValueError):
            E.Tiling(**bad)


def test_composed_detector(spark):
    def make():
        return lambda image, x, y, w, h: [(10.0, 10.0, 20.0, 20.0, 0.5, 0)] if (x, y) == (0, 0) else []

    frames = spark.createDataFrame([("a", 0, b""), ("b", 0, b"")], "stream_id string, frame_idx long, image binary")
    small = frames.transform(P.detector(make, 2000, 1000, tiling=None, long_edge=500, streams=["stream_id"])).collect()
    assert [(r.stream_id, r.x1, r.y2) for r in sorted(small)] == [("a", 40.0, 80.0), ("b", 40.0, 80.0)]
    tiled = frames.transform(P.detector(make, 2000, 1000, E.Tiling(600, 600), streams=["stream_id"])).collect()
    assert sorted((r.stream_id, r.x1) for r in tiled) == [("a", 10.0), ("b", 10.0)]
    assert frames.transform(P.detector(make, 2000, 1000, E.Tiling(600, 600, least_conf=0.6), streams=["stream_id"])).count() == 0


def test_scales_and_legend(spark):
    assert D.scale("count") == 3.0 and D.scale("density") == 4.0 and D.scale("count", count=5.0) == 5.0
    values = spark.createDataFrame([(0, 1, 1, 2.0)], "frame_idx long, col int, row int, value double")
    grid = D.Grid(0.0, 0.0, 0.5, 4, 4)
    assert D.in_mode(values, grid, "count").first().value == 2.0 and D.in_mode(values, grid, "density").first().value == 8.0
    for bad in (lambda: D.scale("sum"), lambda: D.in_mode(values, grid, "")):
        with pytest.raises(ValueError):
            bad()
    ticks = values.select(*[D.legend_tick(F.lit(v), 3.0, 40, 521).alias(str(k)) for k, v in enumerate((-1.0, 0.0, 1.5, 3.0, 9.0))]).first()
    assert list(ticks) == [561, 561, 300, 40, 40] and values.select(D.legend_tick(F.lit(1.0), 0.0, 10, 5)).first()[0] == 15


def test_kernel_equals_a_mirrored_line():
    """Smoothing along n cells is a plain Gaussian over the line that the cells and their mirror images make."""
    for n, sigma in ((10, 1.0), (4, 1.0), (3, 2.5), (1, 1.0)):
        radius, cells = int(4 * sigma + 0.5), np.random.default_rng(n).uniform(size=n)
        line = np.pad(cells, radius, mode="symmetric")
        bell = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        want = np.convolve(line, bell / bell.sum(), mode="valid")
        got = np.zeros(n)
        for a, b, w in D.kernel(sigma, n):
            got[b] += w * cells[a]
        assert got == pytest.approx(want)


def test_percentiles_are_exact(spark):
    rng, shares = np.random.default_rng(3), [0.0, 0.1, 0.5, 0.9, 1.0]
    for values in (rng.normal(size=7), rng.integers(0, 20, 12_000).astype(float), rng.normal(size=23_456)):
        rows = [(k % 3, float(v)) for k, v in enumerate(values)] + [(5, None)]
        got = {r.g: list(r)[1:] for r in exact_percentiles(spark.createDataFrame(rows, "g long, v double"), "v", shares, ["g"]).collect()}
        assert set(got) == set(range(3)) and all(got[g] == pytest.approx(list(np.percentile(values[g::3], [100 * s for s in shares])), rel=1e-12) for g in got)
    assert list(exact_percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()) == [None]


def test_histograms(spark):
    values = spark.createDataFrame([(float(v),) for v in (0.0, 0.1, 0.3, 0.3, 0.7, 1.0, 1.1, -0.1)], "v double")
    assert [r.n for r in A.histogram(values, "v", 0.0, 1.0, 10).orderBy("bin").collect()] == np.histogram([0.0, 0.1, 0.3, 0.3, 0.7, 1.0], np.array([k / 10 for k in range(11)]))[0].tolist()
    assert [r.n for r in A.zoomed_histogram(values, "v", 0.0, 1.0, 2).orderBy("bin").collect()] == [4, 1]
    assert A.histogram(values.limit(0), "v", 0.0, 1.0, 4).agg(F.sum("n")).first()[0] == 0


def test_names(spark):
    paths = ["/a/b/clip.mp4", "clip", "/a.b/c", "x/.hidden", "a/b.tar.gz", ""]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(A.file_stem(F.col("p"))).collect()]
    assert got == ["clip", "clip", "c", ".hidden", "b.tar", ""]


def test_calibrations_come_back(spark, tmp_path):
    quad = [(100, 500), (500, 500), (420, 100), (180, 100)]
    records = [G.calibration_record(v, 3, (640, 480), quad, *G.ground_size(w)[:2], G.ground_size(w)[2], "n", "2024-01-01T00:00:00+00:00") for v, w in (("one.mp4", 4.0), ("two.mp4", None))]
    S.write_calibrations(spark, records, str(tmp_path / "cal"))
    found = S.read_calibrations(spark, str(tmp_path / "cal"))
    assert S.calibration_of(found, "one.mp4") == records[0] and S.calibration_of(found, "two.mp4")["source"] == "ESTIMATED"
    (tmp_path / "single.json").write_text(json.dumps(records[0], indent=2))
    assert S.calibration_of(S.read_calibration(spark, str(tmp_path / "single.json")), "one.mp4")["H"] == records[0]["H"]
    with pytest.raises(LookupError):
        S.calibration_of(found, "three.mp4")


def test_truth_and_cameras(spark, tmp_path):
    (tmp_path / "truth.jsonl").write_text('{"frame_id": 3, "agent_id": 7, "x_world": 1.5, "y_world": 2, "more": 1}\n{"frame_id": 4, "agent_id": 7, "x_world": 1.5, "y_world": 2}\n')
    truth = S.read_truth(spark, str(tmp_path / "truth.jsonl"))
    boxes = spark.createDataFrame([(3, 7), (3, -1), (9, 7)], "frame_idx long, truth_agent_id long")
    assert {(r.frame_idx, r.truth_agent_id): r.truth_x for r in E.with_truth(boxes, truth).collect()} == {(3, 7): 1.5, (3, -1): None, (9, 7): None}
    camera = {"position_m": [0, 1, 2], "look_at_m": [3, 4, 5], "up_hint": [0, 0, 1], "fov_deg": 60, "image_width_px": 640, "image_height_px": 480}
    (tmp_path / "camera.json").write_text(json.dumps({"camera": camera}, indent=1))
    got = S.read_cameras(spark, str(tmp_path / "camera.json")).first()
    assert (got.fov_deg, got.image_width_px, got.look_at_m) == (60.0, 640, [3.0, 4.0, 5.0])


def test_pictures_are_frames(spark, tmp_path):
    for stream, frame, data in (("a", 0, b"0"), ("a", 12, b"12"), ("b", 3, b"3")):
        (tmp_path / "in" / stream).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / stream / f"{frame:06d}.png").write_bytes(data)
    (tmp_path / "in" / "a" / "notes.txt").write_text("no frame")
    frames = S.read_frames(spark, str(tmp_path / "in"))
    assert {(r.stream_id, r.frame_idx): bytes(r.image) for r in frames.collect()} == {("a", 0): b"0", ("a", 12): b"12", ("b", 3): b"3"}
    assert S.frames_at(frames, [0, 3, 99]).count() == 2 and S.single_frame(frames, 12).first().stream_id == "a" and S.frames_before(frames, 5).count() == 2 and S.frames_before(frames, 0).count() == 3
    with pytest.raises(LookupError):
        S.single_frame(frames, 5)
    q = S.stream_frames(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_spine_and_reports(spark, tmp_path, walks):
    spine = S.frame_spine(spark.createDataFrame([("a", 0.0, 31), ("b", 10.0, 2)], "stream_id string, fps double, n_frames long"))
    assert spine.count() == 33 and spine.where("stream_id = 'a'").agg(F.max("t_sec")).first()[0] == 1.0
    series = D.frame_density(walks, walks.select("stream_id", "frame_idx", "t_sec"), 4.0, 1.0, ["stream_id"])
    S.write_density_run(D.density_summary(series, 4.0, ["stream_id"]), series, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/summary")).count() == 2 and spark.read.json(str(tmp_path / "run/density_over_time")).count() == 40
    S.write_json(T.churn(walks, 40, ["stream_id"]), str(tmp_path / "churn"))
    assert spark.read.json(str(tmp_path / "churn")).first().n_tracks == 2
    rows = S.trajectory(registry.projected(spark, "/root/testdata/sf0.001").withColumn("track_id", F.lit(1).cast("long")))
    S.write_trajectory_parquet(rows, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).columns == rows.columns


def test_streamed_lifetimes(spark, tmp_path, walks):
    walks.write.parquet(str(tmp_path / "in"))
    q = Z.lifetimes(spark.readStream.schema(walks.schema).parquet(str(tmp_path / "in")), ["stream_id"]).writeStream.format("memory").queryName("lives").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.stream_id, r.n_observations) for r in spark.table("lives").collect()} == {("a", 20), ("b", 20)}


def test_streamed_gate_of_two_cameras(spark, tmp_path, walks):
    from groundflow.streaming.gate import gated_velocity

    walks.write.parquet(str(tmp_path / "in"))
    out = gated_velocity(spark.readStream.schema(walks.schema).parquet(str(tmp_path / "in")), 2.0, 5, idle=None, streams=["stream_id"])
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out")).count() == 40
