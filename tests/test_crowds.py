"""Crowded frames, sparse rolling density, resets, the sink's end, and the forms of the polygon test."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundflow.functions import geometry as G
from groundflow.operators import density as D
from groundflow.operators import detections as E
from groundflow.operators import tracks as T
from groundflow.plans import registry
from groundflow.sources import tables as S
from groundflow.streaming import frames as Z
from groundflow.streaming import sinks as K

SF = "/root/testdata/sf0.001"
BOXES = "stream_id string, frame_idx long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, note string"


def some_boxes(n=400, seed=2):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        x, y, w, h = rng.uniform(0, 300), rng.uniform(0, 200), rng.uniform(5, 60), rng.uniform(5, 90)
        rows.append(("a" if k % 3 else "b", int(k % 2), int(k % 5 == 0), float(round(rng.uniform(0, 1), 2)), x, y, x + w, y + h, f"n{k}"))
    rows += [(*rows[k][:3], rows[k][3] - 0.1, *rows[k][4:8], "copy") for k in range(0, n, 7)] + [rows[3], rows[3]]
    rows += [("a", 0, 0, 0.5, 10.0, 10.0, 10.0, 50.0, "flat"), ("a", 0, 0, 0.4, 10.0, 10.0, 10.0, 50.0, "flat"), ("a", 0, 0, 0.3, 30.0, 30.0, 20.0, 20.0, "turned"), ("a", 0, 0, None, 0.0, 0.0, 900.0, 900.0, "wide")]
    return rows + [("a", 7, 0, 0.9, 0.0, 0.0, 10.0, 10.0, "alone"), ("a", 7, 0, 0.8, 1.0, 0.0, 11.0, 10.0, "beaten")]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.7, 1.0])
def test_crowded_suppression_equals_the_fold(spark, threshold):
    boxes = spark.createDataFrame(some_boxes(), BOXES).repartition(5)
    want = sorted(map(str, E.suppress(boxes, threshold, ["stream_id"]).collect()))
    assert want == sorted(map(str, E.suppress(boxes, threshold, ["stream_id"], folded=5).collect()))
    assert want == sorted(map(str, E.suppress_crowded(boxes, threshold, ["stream_id"], cell=17.0).collect()))
    assert E.suppress_crowded(boxes.limit(0), threshold, ["stream_id"]).count() == 0


def test_a_crowd_of_copies(spark):
    """Thousands of boxes in one place make no pairs."""
    rows = spark.range(20_000).select(F.lit("a").alias("stream_id"), F.lit(1).cast("long").alias("frame_idx"), F.lit(0).alias("class_id"), (F.col("id") / 20_000).alias("conf"), *[F.lit(float(v)).alias(c) for c, v in zip(E.BOX, (0, 0, 9, 9), strict=True)])
    assert [r.conf for r in E.suppress(rows, 0.5, ["stream_id"]).collect()] == [19_999 / 20_000]


@pytest.mark.parametrize(("seconds", "block"), [(2.0, None), (2.0, 3.0), (0.7, 1.0), (100.0, 10.0)])
def test_intervals_expand_to_rolling_density(spark, seconds, block):
    """Two cameras with empty frames, a long gap and times that round."""
    rng, frames, points = np.random.default_rng(4), [], []
    for stream in ("a", "b"):
        for k in range(120):
            if 50 < k < 58 or rng.random() < 0.1:
                continue
            t = k * 0.1 + (500.0 if k > 80 else 0.0)
            frames.append((stream, k, t))
            points += [(stream, k, float(rng.uniform(-1, 5)), float(rng.uniform(-1, 4))) for _ in range(int(rng.integers(0, 5)))]
    frames, points = spark.createDataFrame(frames, "stream_id string, frame_idx long, t_sec double"), spark.createDataFrame(points, "stream_id string, frame_idx long, x double, y double")
    grid = D.Grid(0.0, 0.0, 1.0, 4, 3)
    spans = D.rolling_intervals(points, frames, grid, seconds, ["stream_id"], block).cache()
    key = lambda r: (r.stream_id, r.frame_idx, r.col, r.row)
    got = {key(r): r.value for r in D.rolling_values(spans, frames, seconds, ["stream_id"], block).collect()}
    want = {key(r): r.value for r in D.rolling(points, frames, grid, seconds, ["stream_id"]).where("value > 0").collect()}
    assert got == want and len(want) > 500
    assert spans.where("until_t <= from_t or persons <= 0").count() == 0 and spans.count() < len(want)
    one, own = frames.where("stream_id = 'a'").drop("stream_id"), points.where("stream_id = 'a'").drop("stream_id")
    alone = D.rolling_values(D.rolling_intervals(own, one, grid, seconds), one, seconds)
    assert {("a", r.frame_idx, r.col, r.row): r.value for r in alone.collect()} == {k: v for k, v in want.items() if k[0] == "a"}
    assert D.rolling_intervals(own.limit(0), one, grid, seconds).count() == 0


def test_smoothing_of_sparse_grids(spark):
    grid, rng = D.Grid(0.0, 0.0, 1.0, 7, 4), np.random.default_rng(1)
    plain = np.where(rng.random((3, 4, 7)) < 0.3, rng.random((3, 4, 7)), 0.0)
    plain[2] = 0.0
    rows = [("s", f, c, r, float(plain[f, r, c])) for f in range(3) for r in range(4) for c in range(7) if plain[f, r, c] or (r, c) == (0, 0)]
    found = D.smoothed(spark.createDataFrame(rows, "stream_id string, frame_idx long, col int, row int, value double"), grid, 1.3)
    assert found.columns == ["stream_id", "frame_idx", "col", "row", "value"]
    want = plain.copy()
    for axis, n in ((2, 7), (1, 4)):
        table = np.zeros((n, n))
        for a, b, w in D.kernel(1.3, n):
            table[b, a] = w
        want = np.moveaxis(np.tensordot(table, want, (1, axis)), 0, axis)
    got = {(r.frame_idx, r.row, r.col): r.value for r in found.collect()}
    assert len(got) == want.size and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in np.ndindex(want.shape))
    assert D.smoothed(found, grid, 0.0) is found


def test_running_totals_in_blocks(spark):
    rows = [(s, f, f % 3, 1) for s in ("a", "b") for f in range(0, 300, 2)]
    per = spark.createDataFrame(rows, "stream_id string, frame_idx long, n long, m long")
    got = {(r.stream_id, r.frame_idx): (r.n, r.n_so_far, r.m_so_far) for r in E.running_totals(per, ["n", "m"], ["stream_id"], 17).collect()}
    assert got == {(s, f): (f % 3, sum(g % 3 for g in range(0, f + 1, 2)), f // 2 + 1) for s, f, *_ in rows}


def test_polygon_forms_agree(spark):
    quads = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 0.0), (5.0, 1.0), (4.0, 5.0), (0.0, 3.0)], [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]]
    points = spark.createDataFrame([(k, a / 4, b / 4, [list(p) for p in q]) for k, q in enumerate(quads) for a in range(-2, 24) for b in range(-2, 24)], "k int, x double, y double, q array<array<double>>")
    x, y = F.col("x"), F.col("y")
    wide = points.withColumns(G.quad_edges(F.col("q"))).withColumns({"edges": G.in_quad_of_edges(x, y), "any": G.in_polygon_of(F.col("q"), x, y)})
    for k, q in enumerate(quads):
        rows = wide.where(F.col("k") == k).select(G.in_polygon(q, x, y).alias("a"), G.in_polygon_once(q, x, y).alias("b"), "edges", "any").collect()
        assert all(r.a == r.b == r.edges == r["any"] for r in rows) and 0 < sum(r.a for r in rows) < len(rows)


def test_projection_of_the_inside(spark):
    boxes = registry.detections(spark, SF)
    whole, inside = E.project(boxes, registry.H, registry.QUAD).where("in_quad"), E.project_inside(boxes, registry.H, registry.QUAD)
    assert whole.columns == inside.columns and whole.exceptAll(inside).count() == inside.exceptAll(whole).count() == 0 and inside.count() > 100


def run(spark, tmp_path, rows, make):
    """The rows as files of a stream, each read in a run of its own."""
    for k, part in enumerate(rows):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        out = make(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in" / "*")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_resets_of_a_stream_equal_cuts(spark, tmp_path):
    grid, one = D.Grid(0.0, 0.0, 10.0, 10, 10), ["stream_id"]
    points = registry.tracks(spark, SF).select(F.lit("a").alias("stream_id"), "frame_idx", "x", "y")
    spine = registry.track_frames(spark, SF).withColumn("stream_id", F.lit("a"))
    resets = spark.createDataFrame([("a", 101), ("a", 400), ("a", 401), ("b", 7)], "stream_id string, frame_idx long")
    packed = spine.join(points.groupBy(*one, "frame_idx").agg(F.collect_list(F.struct("x", "y")).alias("points")), [*one, "frame_idx"], "left").withColumn("reset", F.lit(False))
    orders = resets.select(*one, "frame_idx", F.lit(None).cast("double").alias("t_sec"), F.lit(None).cast(packed.schema["points"].dataType).alias("points"), F.lit(True).alias("reset"))
    rows = packed.unionByName(orders)
    late = orders.where("frame_idx = 101")  # once more, long after its frame: passed over
    got = run(spark, tmp_path, [rows.where("frame_idx < 300"), rows.where("frame_idx >= 300").unionByName(late)], lambda s: Z.rolling_density(s, grid, 7200.0, idle=None))
    frames, spots = (D.cut_at(df, resets, one) for df in (spine, points))
    want = D.rolling(spots, frames, grid, 7200.0, [*one, "segment"]).where("value > 0")
    cells = lambda df: {(r.frame_idx, r.col, r.row): r.value for r in df.collect()}
    assert cells(got) == pytest.approx(cells(want)) and cells(got) != pytest.approx(cells(D.rolling(points, spine, grid, 7200.0, one).where("value > 0")))


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_sink_tells_churn_at_the_end(spark, tmp_path, form):
    at = lambda *p: str(tmp_path.joinpath(*p))
    boxes = registry.projected(spark, SF).withColumn("track_id", F.col("frame_idx") % 17)
    rows = S.trajectory(boxes)
    whole = rows.randomSplit([0.4, 0.6], 1)
    for k, part in enumerate(whole):
        part.coalesce(1).write.parquet(at("in", f"p{k}"))
        stream = spark.readStream.schema(rows.schema).parquet(at("in", "*"))
        assert K.log_trajectory(stream, at("out"), at("cp"), form).awaitTermination(120)
    assert K.log_trajectory(stream, at("out"), at("cp"), form).awaitTermination(120)  # nothing new
    back = S.read_trajectory_csv(spark, at("out", "rows", "batch=*")) if form == "csv" else spark.read.parquet(at("out", "rows", "batch=*"))
    assert back.count() == rows.count()
    # a batch that ended before its checkpoint was written is run again, and takes its own place
    commit = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commit.unlink()
    (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    assert K.log_trajectory(stream, at("out"), at("cp"), form).awaitTermination(120)
    assert spark.read.parquet(at("out", "lifetimes", "batch=*")).agg(F.sum("n_observations")).first()[0] == rows.count()
    want = T.churn(rows.withColumnRenamed("timestamp_s", "t_sec"), 1500).first()
    got = K.close_trajectory(spark, at("out"), 1500).first()
    assert tuple(got)[:-1] == pytest.approx(tuple(want)) and got.total_frames == 1500
    assert K.close_trajectory(spark, at("out"), 99).first() == got  # a second end changes nothing
    assert json.loads(next((tmp_path / "out" / "churn").glob("*.json")).read_text())["n_tracks"] == 17
