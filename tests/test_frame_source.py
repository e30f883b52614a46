"""Frame folders: batch and stream give equal frames, and a restart goes on where it stopped."""

import json

import pytest

from groundflow.sources import frame_source as S


@pytest.fixture
def folder(tmp_path):
    def put(stream, *numbers):
        (tmp_path / "in" / stream).mkdir(parents=True, exist_ok=True)
        for n in numbers:
            (tmp_path / "in" / stream / f"{n:06d}.jpg").write_bytes(f"{stream}{n}".encode())

    put("a", *range(10))
    put("b", 0, 3, 7)
    (tmp_path / "in" / "a" / "video.json").write_text(json.dumps({"fps": 0, "width": 640, "height": 480, "n_frames": 10}))
    (tmp_path / "in" / "b" / "video.json").write_text(json.dumps({"fps": 10.0}))
    (tmp_path / "in" / "b" / "notes.txt").write_text("no frame")
    (tmp_path / "in" / "c").mkdir()
    return put


def rows(df):
    return sorted((r.stream_id, r.frame_idx, r.t_sec, r.fps, r.width, r.height, r.n_frames, bytes(r.image)) for r in df.collect())


def test_batch(spark, tmp_path, folder):
    spark.dataSource.register(S.FrameFolders)
    df = spark.read.format("frame_folders").option("framesPerPartition", 4).load(str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() == 4
    found = rows(df)
    assert [r[:7] for r in found[:2]] == [("a", 0, 0.0, 30.0, 640, 480, 10), ("a", 1, 1 / 30, 30.0, 640, 480, 10)]
    assert [(r[0], r[1], r[2], r[7]) for r in found[10:]] == [("b", 0, 0.0, b"b0"), ("b", 3, 0.3, b"b3"), ("b", 7, 0.7, b"b7")] and len(found) == 13
    assert rows(spark.read.format("frame_folders").load(f"file://{tmp_path}/in")) == found
    (tmp_path / "none").mkdir()
    assert spark.read.format("frame_folders").load(str(tmp_path / "none")).count() == 0


def test_stream_resumes(spark, tmp_path, folder):
    spark.dataSource.register(S.FrameFolders)

    def go():
        source = spark.readStream.format("frame_folders").option("framesPerPartition", 3).option("maxFramesPerStream", 4).load(str(tmp_path / "in"))
        out = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q = out.trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return rows(spark.read.parquet(str(tmp_path / "out")))

    batch = lambda: rows(spark.read.format("frame_folders").load(str(tmp_path / "in")))
    assert go() == batch() and go() == batch()
    folder("a", *range(10, 23))
    folder("d", 5)
    assert go() == batch() and len(batch()) == 27
