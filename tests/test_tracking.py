from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundflow.operators import density as D
from groundflow.operators import detector as P
from groundflow.operators import synthetic as Y
from groundflow.operators import tracking as K
from groundflow.plans import registry
from groundflow.sources import tables as S
from groundflow.streaming import frames as Z

SF = "/root/testdata/sf0.001"
BOXES = "stream_id string, frame_idx long, agent long, conf double, x1 double, y1 double, x2 double, y2 double"


def walk(stream, agent, frames, x, y, dx, dy, conf=0.9):
    return [(stream, f, agent, conf, x + dx * k - 20.0, y + dy * k - 60.0, x + dx * k + 20.0, y + dy * k + 60.0) for k, f in enumerate(frames)]


def scene():
    rows = walk("a", 1, range(60), 100, 300, 5, 0) + walk("a", 2, range(60), 900, 300, -5, 1)
    rows += walk("b", 3, range(40), 100, 300, 3, 3) + walk("b", 4, range(0, 40), 500, 900, 0, -3, conf=0.3)
    return rows + walk("a", 5, range(500, 520), 100, 300, 5, 0)


def ids(rows):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.stream_id, r.frame_idx)):
        found[r.agent].append(r.track_id)
    return found


def test_walkers_keep_their_ids(spark):
    rows = scene()
    got = K.track(spark.createDataFrame(rows, BOXES).repartition(5)).collect()
    assert len(got) == len(rows)
    by = ids(got)
    for agent in (1, 2, 3, 5):
        assert by[agent][:2] == [-1, -1] and len(set(by[agent][2:])) == 1 and by[agent][2] >= 0
    assert set(by[4]) == {-1}  # low confidence
    assert len({by[k][-1] for k in (1, 2, 5)}) == 3  # one stream's ids differ, over a cut as well


def test_gap_is_bridged_up_to_the_limit(spark):
    steady = walk("a", 1, range(60), 100, 300, 4, 0)
    near = [r for r in steady if not 25 <= r[1] < 31]
    by = ids(K.track(spark.createDataFrame(near, BOXES)).collect())
    assert len(set(by[1]) - {-1}) == 1
    far = [r for r in walk("a", 1, range(100), 100, 300, 0, 0) if not 20 <= r[1] < 60]
    by = ids(K.track(spark.createDataFrame(far, BOXES)).collect())
    assert len(set(by[1]) - {-1}) == 2


def test_sections_equal_one_pass(spark):
    """Cutting a stream where no track survives changes no grouping of boxes."""
    rng = np.random.default_rng(3)
    rows = []
    for part in range(6):
        for agent in range(4):
            start = part * 60 + int(rng.integers(0, 5))
            rows += walk("a", part * 10 + agent, range(start, start + 15), float(rng.uniform(100, 900)), 100.0 + 250 * agent, float(rng.uniform(-6, 6)), 0.0)
    got = {(r.frame_idx, r.x1, r.y1): r.track_id for r in K.track(spark.createDataFrame(rows, BOXES)).collect()}
    tracker, want = K.Tracker(K.Params()), {}
    for f in sorted({r[1] for r in rows}):
        own = sorted([r for r in rows if r[1] == f], key=lambda r: (-r[3], r[4:]))
        for r, i in zip(own, tracker.update(f, np.array([r[4:] for r in own]), np.array([r[3] for r in own])).tolist(), strict=True):
            want[f, r[4], r[5]] = i
    groups = lambda d: sorted(map(sorted, ([k for k in d if d[k] == i] for i in set(d.values()) if i >= 0)))
    assert got.keys() == want.keys() and groups(got) == groups(want)
    assert all((got[k] < 0) == (want[k] < 0) for k in got)


def crowd(n_frames, seed=5, stream="a", agents=6, first=0):
    """Walkers that come and go without end, cross, are missed now and then, and seen with noise; there is a box in every frame."""
    rng, rows = np.random.default_rng(seed), []
    for agent in range(agents):
        f = int(rng.integers(0, 20))
        while f < n_frames:
            n, x, y = int(rng.integers(8, 400)), rng.uniform(100, 1800), rng.uniform(100, 900)
            dx, dy = rng.uniform(-4, 4, 2)
            for k in range(min(n, n_frames - f)):
                if rng.random() > 0.1 and not 60 < k % 97 < 75:
                    j = rng.normal(0, 1.5, 4)
                    rows.append((stream, first + f + k, agent, float(rng.uniform(0.4, 1.0)), *map(float, (x + dx * k - 20 + j[0], y + dy * k - 60 + j[1], x + dx * k + 20 + j[2], y + dy * k + 60 + j[3]))))
            f += n + int(rng.integers(1, 30))
    return rows + walk(stream, 99, range(first, first + n_frames), 3000, 300, 0, 0)


def one_pass(rows):
    found = {}
    for stream in {r[0] for r in rows}:
        tracker, frames = K.Tracker(K.Params()), defaultdict(list)
        for r in rows:
            if r[0] == stream:
                frames[r[1]].append(r)
        for f in sorted(frames):
            own = sorted(frames[f], key=lambda r: (-r[3], r[4:]))
            sure = [r for r in own if r[3] >= 0.6]
            ids = tracker.update(f, np.array([r[4:] for r in sure]), np.array([r[3] for r in sure])).tolist() if sure else []
            for r, i in zip(own, ids + [-1] * (len(own) - len(ids)), strict=True):
                found[stream, f, *r[3:]] = (stream, i)
    return found


def groups_of(found):
    by = defaultdict(list)
    for key, (stream, i) in found.items():
        if i >= 0:
            by[stream, i].append(key)
    return sorted(map(sorted, by.values()))


@pytest.mark.parametrize(("block", "overlap"), [(200, 120), (50, 40), (300, 32)])
def test_blocks_equal_one_pass(spark, monkeypatch, block, overlap):
    """A stream without a gap, over many tasks, has the tracks of one pass; blocks whose overlap is too short are followed again."""
    rows = crowd(1500) + crowd(400, 7, "b", 4, 123)
    runs, follow = [], K._follow

    def counted(placed, by, params):
        runs.append(placed.select("_block").distinct().count())
        return follow(placed, by, params)

    monkeypatch.setattr(K, "_follow", counted)
    found = K.track(spark.createDataFrame(rows, BOXES).repartition(7), block_frames=block, overlap=overlap)
    got = {(r.stream_id, r.frame_idx, r.conf, r.x1, r.y1, r.x2, r.y2): (r.stream_id, r.track_id) for r in found.collect()}
    want = one_pass(rows)
    assert got.keys() == want.keys() and all((got[k][1] < 0) == (want[k][1] < 0) for k in got)
    assert groups_of(got) == groups_of(want) and len(groups_of(got)) > 20
    assert runs[0] >= 1500 // block and (len(runs) == 1 or sum(runs[1:]) > 0)
    if overlap == 32:
        assert len(runs) > 1  # some block did not begin as the one before ended


def test_states_that_do_not_agree():
    params, ids = K.Params(), []
    for start in (0, 2000, 2998):
        tracker = K.Tracker(params)
        for f in range(start, 3000):
            tracker.update(f, np.array([[10.0 + f, 10, 50 + f, 90]]), np.array([0.9]))
        ids.append(tracker.saved())
    assert K.agree(ids[1], ids[0], 3000, params) == [(0, 0)] and K.agree(ids[2], ids[0], 3000, params) is None
    assert K.agree(None, ids[0], 3000, params) is None and K.agree(None, ids[0], 3000 + params.lost_frames + 1, params) == [] and K.agree(None, None, 5, params) == []
    with pytest.raises(ValueError):
        K.track(None, overlap=20)


def test_kept_tables_are_forgotten_alone(spark):
    """What a result reads is deleted, and nothing beside it."""
    from groundflow.sources.kept import _folder, forget, kept

    beside = kept(spark.range(5).selectExpr("id", "id % 2 AS odd"), "beside", ["odd"])
    found = K.track(spark.createDataFrame(crowd(300, agents=2), BOXES), block_frames=100, overlap=50)
    folders = {_folder(f) for f in found.inputFiles()}
    assert len(folders) >= 2 and not any("=" in f for f in folders)
    forget(found)
    base = next(iter(folders)).rsplit("/", 1)[0].removeprefix("file:")
    import os

    assert os.path.isdir(base) and not any(os.path.exists(f.removeprefix("file:")) for f in folders) and beside.count() == 5
    assert _folder("file:/a/_b=c/t-1/_kind=0/x=2/part.parquet") == "file:/a/_b=c/t-1"


def test_tracking_edge_cases(spark):
    assert K.track(spark.createDataFrame([], BOXES)).count() == 0
    rows = [("a", 0, 1, None, 0.0, 0.0, 1.0, 1.0), ("a", 0, 2, 0.9, 5.0, 5.0, 5.0, 5.0), ("a", 0, 2, 0.9, 5.0, 5.0, 5.0, 5.0)]
    extra = spark.createDataFrame(rows, BOXES).withColumns({"track_id": F.lit("old"), "section": F.lit("x")})
    assert [r.track_id for r in K.track(extra).collect()] == [-1, -1, -1]


def test_crowd_is_followed(spark):
    """On sf0.001's walkers nearly every confirmed track belongs to one person."""
    rows = registry.tracked_detections(spark, SF).collect()
    owners = defaultdict(Counter)
    for r in rows:
        if r.track_id >= 0:
            owners[r.stream_id, r.track_id][r.truth_agent_id] += 1
    pure = sum(c.most_common(1)[0][1] for c in owners.values()) / sum(sum(c.values()) for c in owners.values())
    assert len(owners) >= 100 and pure > 0.9


def test_noise_can_be_switched_off(spark):
    truth = spark.createDataFrame([(0, f, a, float(a), 5.0) for f in range(50) for a in range(-2, 3)], "stream_id long, frame_idx long, agent_id long, x_world double, y_world double")
    frames = truth.select("stream_id", "frame_idx").distinct()
    quiet = Y.Noise(dropout=0.0, false_per_frame=0.0, jitter_px=0.0, conf_std=0.0)
    boxes = Y.detect(truth, frames, registry.H_INV, 3840, 2160, quiet)
    assert boxes.count() == 250
    from groundflow.operators import detections as E

    back = E.project(boxes, registry.H, [(-1e9, -1e9), (1e9, -1e9), (1e9, 1e9), (-1e9, 1e9)]).agg(F.max(F.abs(F.col("world_x") - F.col("truth_agent_id"))), F.max(F.abs(F.col("world_y") - 5.0))).first()
    assert back[0] < 1e-6 and back[1] < 1e-6
    loud = Y.detect(truth, frames, registry.H_INV, 3840, 2160, Y.Noise(dropout=0.3, false_per_frame=2.0)).cache()
    assert 120 < loud.where("truth_agent_id >= -2 and det_id = 0").count() < 230 and 60 < loud.where("det_id > 0").count() < 140
    assert loud.where("not (x1 >= 0 and x2 <= 3840 and y1 >= 0 and y2 <= 2160 and x1 < x2 and y1 < y2 and conf between 0.01 and 1)").count() == 0


def test_tiled_detector(spark):
    """A detector that reads boxes written in the image; one on a seam is seen twice and comes out once."""

    def make():
        def run(image, x, y, w, h):
            found = [tuple(map(float, b.split(","))) for b in image.decode().split(";")]
            return [(a - x, b - y, c - x, d - y, conf, int(k)) for a, b, c, d, conf, k in found if a >= x and b >= y and c <= x + w and d <= y + h]

        return run

    frames = spark.createDataFrame([(0, b"1170,10,1260,60,0.9,0;10,10,50,90,0.5,0;10,10,50,90,0.2,0")], "frame_idx long, image binary")
    parts = P.detect(P.tiles(frames, 3840, 2160), make)
    assert parts.count() == 4
    got = P.detect_tiled(frames, make, 3840, 2160).orderBy("x1").collect()
    assert [(r.x1, r.conf) for r in got] == [(10.0, 0.5), (1170.0, 0.9)]
    assert P.detect_whole(frames, make, 3840, 2160, 0.4).count() == 2
    assert tuple(P.tile_counters(parts).first())[1:] == (4, 2)


def _through(spark, tmp_path, packed, make):
    packed.write.parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(packed.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_streamed_density_equals_batch(spark, tmp_path):
    grid = D.Grid(0.0, 0.0, 10.0, 10, 10)
    points = registry.tracks(spark, SF).select(F.lit("a").alias("stream_id"), "frame_idx", "x", "y")
    spine = registry.track_frames(spark, SF).withColumn("stream_id", F.lit("a"))
    packed = spine.join(points.groupBy("stream_id", "frame_idx").agg(F.collect_list(F.struct("x", "y")).alias("points")), ["stream_id", "frame_idx"], "left")
    got = _through(spark, tmp_path, packed.coalesce(1), lambda s: Z.rolling_density(s, grid, 7200.0, idle=None)).collect()
    want = D.rolling(points, spine, grid, 7200.0, ["stream_id"]).where("value > 0").collect()
    assert {(r.frame_idx, r.col, r.row): r.value for r in got} == pytest.approx({(r.frame_idx, r.col, r.row): r.value for r in want})


def test_streamed_tracks_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame(scene(), BOXES)
    packed = rows.groupBy("stream_id", "frame_idx").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "conf")).alias("boxes"))
    got = _through(spark, tmp_path, packed, lambda s: Z.track(s, idle=None)).collect()
    want = K.track(rows).collect()
    key = lambda r: (r.stream_id, r.frame_idx, r.x1, r.y1)
    groups = lambda d: sorted(sorted(key(r) for r in d if (r.stream_id, r.track_id) == i) for i in {(r.stream_id, r.track_id) for r in d if r.track_id >= 0})
    assert len(got) == len(want) and groups(got) == groups(want)


def test_trajectory_sink(spark, tmp_path):
    rows = S.trajectory(registry.projected(spark, SF).withColumns({"track_id": F.lit(1).cast("long")}))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    Z.write_trajectory(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    Z.write_trajectory(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)  # a restart repeats nothing
    assert S.read_trajectory_csv(spark, str(tmp_path / "out")).count() == rows.count()


def test_gate_takes_long_tracks_and_nulls(spark):
    from groundflow.operators import tracks as T

    rows = [(1, float(k), float(k), 0.0) for k in range(30_000)] + [(2, None, None, None), (2, 1.0, None, 2.0), (None, 0.0, 0.0, 0.0)]
    got = T.speed_gate(spark.createDataFrame(rows, "track_id long, t_sec double, x double, y double"), 2.0)
    assert got.where("accepted").count() == len(rows)
    assert T.speed_gate(spark.createDataFrame([], "track_id long, t_sec double, x double, y double"), 2.0).count() == 0


def _best_total(score, allowed, row=0, taken=frozenset()):
    if row == len(score):
        return 0.0
    ways = [_best_total(score, allowed, row + 1, taken)]
    ways += [score[row, c] + _best_total(score, allowed, row + 1, taken | {c}) for c in range(score.shape[1]) if allowed[row, c] and c not in taken]
    return max(ways)


def test_pairs_have_the_largest_total(monkeypatch):
    """By bidding, by paths alone and by both; where all bids are spent on ties, too."""
    rng = np.random.default_rng(2)
    for k in range(150):
        n, m = rng.integers(1, 6, 2)
        allowed, score = rng.random((n, m)) < rng.choice([0.3, 0.6, 1.0]), rng.uniform(0.2, 1.2, (n, m))
        score = np.round(score, 1) if k % 2 else score
        monkeypatch.setattr(K, "ROUNDS", (0, 2, 300)[k % 3])
        monkeypatch.setattr(K, "OFFERS", (2, 24)[k % 2])
        r, c = np.nonzero(allowed)
        rows, cols = K.best_pairs(r, c, score[r, c], n, m)
        assert len(set(rows)) == len(rows) and len(set(cols)) == len(cols) and allowed[rows, cols].all()
        assert score[rows, cols].sum() == pytest.approx(_best_total(score, allowed))


def test_pairs_of_a_crowd_are_proved_best():
    """400 boxes that all compete: the prices that are left prove that no other choice is worth more."""
    rng = np.random.default_rng(4)
    for n, m in ((400, 430), (400, 400), (430, 400)):
        r, c = np.nonzero(rng.random((n, m)) < 0.3)
        s = rng.uniform(0.2, 1.2, len(r))
        offers = K._Offers(r, c, s, n, m)
        offers.augment(offers.bid())
        worth = np.zeros(n)
        np.maximum.at(worth, offers.bidder, offers.value - offers.price[offers.item])
        held = offers.value[offers.holder[offers.item] == offers.bidder].sum()
        assert held == pytest.approx(worth.sum() + offers.price.sum()) and (offers.price >= 0).all()
        rows, cols = K.best_pairs(r, c, s, n, m)
        score = np.zeros((n, m))
        score[r, c] = s
        assert score[rows, cols].sum() == pytest.approx(held)


def test_near_pairs_are_all_pairs():
    rng = np.random.default_rng(6)
    corner = rng.uniform(0, 1000, (2, 700, 2))
    a, b = np.concatenate([corner, corner + rng.uniform(0, 150, (2, 700, 2))], axis=2)
    a[5], b[7] = np.nan, np.nan  # meets nothing and hides nothing
    r, c, near = K.near_pairs(a, b, 0.3)
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    whole = both / np.maximum((a[:, 2:] - a[:, :2]).prod(axis=1)[:, None] + (b[:, 2:] - b[:, :2]).prod(axis=1)[None] - both, 1e-9)
    assert set(zip(r.tolist(), c.tolist(), strict=True)) == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(whole >= 0.3))), strict=True))
    assert len(r) > 500 and np.array_equal(near, whole[r, c]) and len(K.near_pairs(a, b[:0], 0.3)[0]) == len(K.near_pairs(a[:0], b, 0.3)[0]) == 0


def test_a_crowd_is_not_compared_as_a_whole():
    """A frame's memory is that of the boxes that lie beside each other, not of all pairs."""
    import tracemalloc

    k = np.arange(3000)
    boxes = np.stack([k % 300 * 50.0, k // 300 * 150.0, k % 300 * 50.0 + 40, k // 300 * 150.0 + 120], axis=1)
    tracker = K.Tracker(K.Params())
    tracemalloc.start()
    ids = [tracker.update(f, boxes + f, np.full(3000, 0.9)) for f in range(4)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and np.array_equal(ids[2], ids[3]) and len(set(ids[3].tolist())) == 3000


def test_the_walkers_of_a_larger_copy_are_followed():
    """The query's camera with 40 walkers at each of 70 places: a frame costs what its overlapping boxes cost, and all walkers live on."""
    import tracemalloc

    rng, k = np.random.default_rng(8), np.repeat(np.arange(70), 40)
    x, y = k * 37 % 600 / 100 - 3, k * 53 % 1000 / 100
    at = lambda x: (lambda p: p[:2] / p[2])(np.array(registry.H_INV) @ np.stack([x, y, np.ones(len(k))]))
    (cx, foot), width = at(x), np.abs(at(x + 0.25)[0] - at(x - 0.25)[0])
    still = np.stack([cx - width / 2, foot - 3.4 * width, cx + width / 2, foot], axis=1)
    tracker = K.Tracker(K.Params())
    tracemalloc.start()
    ids = [tracker.update(f, still + rng.normal(0, 2, still.shape), np.full(len(k), 0.75)) for f in range(5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lives = Counter(i for frame in ids for i in frame.tolist() if i >= 0)
    assert peak < 150e6 and (ids[-1] >= 0).mean() > 0.9 and sum(n == 3 for n in lives.values()) > 0.9 * len(k)


def test_pairs_are_best_from_rough_prices(monkeypatch):
    """Whatever prices bidding starts from: too high ones come down again by paths with the sides exchanged."""
    rng, lowered = np.random.default_rng(9), 0
    monkeypatch.setattr(K, "CROWDED", -1)
    for k in range(150):
        n, m = rng.integers(1, 6, 2)
        allowed, score = rng.random((n, m)) < rng.choice([0.3, 0.6, 1.0]), rng.uniform(0.2, 1.2, (n, m))
        r, c = np.nonzero(allowed)
        offers = K._Offers(r, c, score[r, c], n, m)
        offers.price = rng.uniform(-0.5, 1.5, m).clip(0)
        offers.augment(offers.bid())
        lowered += ((offers.holder < 0) & (offers.price > 0)).any()
        offers.lower()
        item = np.flatnonzero(offers.holder >= 0)
        for rows, cols in ((offers.holder[item], item), K.best_pairs(r, c, score[r, c], n, m)):
            assert len(set(rows)) == len(rows) and len(set(cols)) == len(cols) and allowed[rows, cols].all()
            assert score[rows, cols].sum() == pytest.approx(_best_total(score, allowed))
    assert lowered > 30
    n, m = 500, 520
    base, other = rng.uniform(0, 30, (n, 1)), rng.uniform(0, 30, (1, m))
    s = 0.9 - 0.02 * np.abs(base - other) + rng.uniform(0, 0.1, (n, m))
    r, c = np.nonzero(s > 0.4)
    for r, c, n, m in ((r, c, n, m), (c, r, m, n)):
        value = s[r, c] if n == 500 else s[c, r]
        offers = K._Offers(r.astype(np.int32), c.astype(np.int32), value, n, m)
        offers.choose()
        held = offers.value[offers.holder[offers.item] == offers.bidder].sum()
        assert held == pytest.approx(offers.worth().sum() + offers.price.sum()) and (offers.price >= 0).all() and (offers.price[offers.holder < 0] == 0).all()


def test_a_dense_crowd_costs_its_pairs_alone():
    """Walkers in step at the same places, as in large copies: memory is some numbers a pair that overlaps, and nobody is lost."""
    import tracemalloc

    rng, k = np.random.default_rng(12), np.arange(1200)
    x, y = 500 + k % 4 * 12.0, 400 + k % 4 * 8.0
    still = np.stack([x, y, x + 107, y + 365], axis=1)
    tracker = K.Tracker(K.Params())
    tracker.update(0, still + rng.normal(0, 2, still.shape), np.full(len(k), 0.75))
    tracemalloc.start()
    ids = [tracker.update(f, still + rng.normal(0, 2, still.shape), np.full(len(k), 0.75)) for f in range(1, 4)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = len(K.near_pairs(still, still, 0.3)[0])
    assert pairs > 1_300_000 and peak < 60 * pairs and (ids[-1] >= 0).mean() > 0.99
