"""Frame folders as a data source of their own: pictures stored as <path>/<stream>/<frame number>.<suffix>, in batch and as a stream.

    spark.dataSource.register(FrameFolders)
    spark.read.format("frame_folders").load(path)
    spark.readStream.format("frame_folders").load(path)

A stream's folder may hold video.json with fps, width, height and n_frames; fps 0, or none, counts as 30. Rows carry the metadata with
the picture, which stays encoded. A partition is a run of up to framesPerPartition pictures of one stream, so that a long recording is
read by many tasks. On a stream, an offset is the next frame number of every folder: frames arrive in order within theirs, and one that arrives
below its offset is passed over; maxFramesPerStream bounds what a micro-batch takes of each. Other files are passed over.
Paths are in any store that pyarrow opens."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "stream_id string, frame_idx long, t_sec double, fps double, width int, height int, n_frames long, image binary"
PICTURE = re.compile(r"(\d+)\.[^/.]+$")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path within it."""
    found = re.sub(r"^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(found if "://" in found else f"file://{found}")


@dataclass
class Frames(InputPartition):
    """Pictures of one stream."""

    stream: str
    names: list[str]


class Folders:
    """What both readers share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_partition = int(options.get("framesPerPartition", 256))
        self.per_stream = int(options.get("maxFramesPerStream", 0))

    def streams(self) -> list[str]:
        store, path = opened(self.path)
        return sorted(f.base_name for f in store.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.Directory)

    def pictures(self, stream: str) -> list[tuple[int, str]]:
        """Numbers and names of a stream's pictures, in order."""
        store, path = opened(self.path)
        found = ((PICTURE.match(f.base_name), f) for f in store.get_file_info(pafs.FileSelector(f"{path}/{stream}")) if f.type == pafs.FileType.File)
        return sorted((int(m[1]), f.base_name) for m, f in found if m)

    def runs(self, stream: str, low: int = 0, high: int | None = None) -> list[Frames]:
        names = [name for n, name in self.pictures(stream) if n >= low and (high is None or n < high)]
        return [Frames(stream, names[k : k + self.per_partition]) for k in range(0, len(names), self.per_partition)]

    def metadata(self, stream: str) -> tuple[float, int | None, int | None, int | None]:
        store, path = opened(self.path)
        at = f"{path}/{stream}/video.json"
        found = json.loads(store.open_input_stream(at).read()) if store.get_file_info(at).type == pafs.FileType.File else {}
        return float(found.get("fps") or 30.0), found.get("width"), found.get("height"), found.get("n_frames")

    def read(self, partition: Frames | None) -> Iterator[tuple]:
        if partition is None:  # no pictures at all
            return
        store, path = opened(self.path)
        fps, width, height, n_frames = self.metadata(partition.stream)
        for name in partition.names:
            frame = int(PICTURE.match(name)[1])
            with store.open_input_stream(f"{path}/{partition.stream}/{name}") as f:
                yield partition.stream, frame, frame / fps, fps, width, height, n_frames, f.read()


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders = Folders(options)

    def partitions(self) -> list[Frames]:
        return [run for stream in self.folders.streams() for run in self.folders.runs(stream)]

    def read(self, partition: Frames) -> Iterator[tuple]:
        return self.folders.read(partition)


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folders, self.at = Folders(options), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The next frame number of every folder. What has been handed out before bounds the step, if a bound is set."""
        found = {}
        for stream in self.folders.streams():
            before = (self.at or {}).get(stream, 0)
            new = [n for n, _ in self.folders.pictures(stream) if n >= before]
            new = new[: self.folders.per_stream] if self.folders.per_stream else new
            found[stream] = max([before, *(n + 1 for n in new)])
        self.at = found
        return found

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        self.at = {k: max(v, (self.at or {}).get(k, 0)) for k, v in end.items()}
        return [run for stream, high in end.items() if high > start.get(stream, 0) for run in self.folders.runs(stream, start.get(stream, 0), high)]

    def read(self, partition: Frames) -> Iterator[tuple]:
        return self.folders.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FrameFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FolderStream(self.options)
