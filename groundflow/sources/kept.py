"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir. Only on one machine may that setting be missing; a temporary folder is taken there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="groundflow-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, what: str, apart: list[str] | None = None) -> DataFrame:
    """rows as a table: its lineage is cut, and a lost executor costs nothing that was done. Values of `apart` lie in folders of
    their own."""
    path = shared_folder(rows.sparkSession, what)
    rows.write.partitionBy(*(apart or [])).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows of a few numbers that may be sent to every executor (some 20 MB).
BROADCAST_ROWS = 100_000


def to_all(few: DataFrame) -> DataFrame:
    """few, for a join that leaves the other side's rows where they are; with more rows than BROADCAST_ROWS as it is."""
    return F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few


def forget(*tables: DataFrame) -> None:
    """Delete the kept tables that these read. They, and what was made from them, can't be read any more."""
    spark = tables[0].sparkSession
    for path in {_folder(file) for df in tables for file in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _folder(file: str) -> str:
    """A table's own folder: above its file, and above folders of a value each."""
    path = file.rsplit("/", 1)[0]
    while "=" in path.rsplit("/", 1)[1]:
        path = path.rsplit("/", 1)[0]
    return path
