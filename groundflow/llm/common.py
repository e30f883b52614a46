"""What the operators share: reading tables, the shared folder, whole-file access and word splitting."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Fixed: upper-case A-Z become lower case and every ASCII byte that is neither a digit nor a letter
#: becomes a space. All bytes of a multi-byte UTF-8 character stay, so that words are the maximal runs
#: of [^\x00-\x2F\x3A-\x60\x7B-\x7F] of the lower-cased text.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Fixed: A-Z become lower case, all other bytes stay.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, through Spark's reader alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Only on one machine (local mode, tests) may that setting be missing; a temporary folder is taken there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="groundflow-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_open = threading.local()


def keep(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    Inside `scratch` the table lives until that ends. Rows lie apart by the column `by`, so that one value's are read alone."""
    path = shared_dir(df.sparkSession, what)
    if getattr(_open, "paths", None):
        _open.paths[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for df in tables for file in df.inputFiles()}:
        delete(path)


def delete(path: str) -> None:
    """Delete a folder, if it is there."""
    fs, local = filesystem(path)
    if fs.get_file_info(local).type == pafs.FileType.Directory:
        fs.delete_dir(local)


@contextmanager
def scratch():
    """Deletes at its end what was kept since its start."""
    _open.paths = [*getattr(_open, "paths", []), []]
    try:
        yield
    finally:
        for path in _open.paths.pop():
            delete(path)


def settled(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, as a table of its own; the tables that it took on the way are deleted."""
    path = shared_dir(spark, what)
    with scratch():
        found = make()
        found.write.parquet(path)
    if getattr(_open, "paths", None):
        _open.paths[-1].append(path)
    return spark.read.schema(found.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Access to whole files inside tasks: file://, s3://, gs:// and hdfs:// alike."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, data: bytes, attempt: str = "0") -> None:
    """All or nothing: a retried or speculative task replaces the file by the same bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{attempt}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Words of the text in UTF-8 with A-Z in lower case; see WORD_BYTES."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield record_batch(held, schema)
            held = []
    if held:
        yield record_batch(held, schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )
