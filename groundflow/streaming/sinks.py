"""The trajectory sink with what is told at a stream's end: churn.

Each micro-batch is written to folders of its own number, so a batch that is run again after a failure takes the place of its first
run: rows are neither lost nor repeated. Beside the rows lie the batch's lifetimes (a track's first and last time and number of
observations); those of all batches are merged when churn is asked for, so that no state is held while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from groundflow import schema
from groundflow.operators.tracks import churn_of

LIFE = "track_id long, first_t double, last_t double, n_observations long"
CHURN = "n_tracks long, n_rows long, life_min double, life_median double, life_p90 double, life_max double, ge_1_0s double, ge_2_5s double, mean_simultaneous double, total_frames long"


def log_trajectory(rows: DataFrame, path: str, checkpoint: str, form: str = "csv", streams: list[str] | None = None) -> StreamingQuery:
    """Append a stream's trajectory rows (and streams) under path/rows, and their lifetimes under path/lifetimes."""
    by = streams or []
    columns = [*by, *schema.names(schema.TRAJECTORY)]

    def write(batch: DataFrame, number: int) -> None:
        found = batch.persist()
        out = found.write.mode("overwrite")
        if form == "csv":
            out = out.option("header", True).option("nanValue", "nan")
        out.format(form).save(f"{path}/rows/batch={number}")
        lives = found.groupBy(*by, "track_id").agg(F.min("timestamp_s").alias("first_t"), F.max("timestamp_s").alias("last_t"), F.count("*").alias("n_observations"))
        lives.write.mode("overwrite").parquet(f"{path}/lifetimes/batch={number}")
        found.unpersist()

    return rows.select(columns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged_lifetimes(spark: SparkSession, path: str, streams: list[str] | None = None) -> DataFrame:
    """lifetime_s and n_observations of every track that was logged so far."""
    by = [*(streams or []), "track_id"]
    found = spark.read.option("basePath", f"{path}/lifetimes").parquet(f"{path}/lifetimes/batch=*")
    return found.groupBy(*by).agg((F.max("last_t") - F.min("first_t")).alias("lifetime_s"), F.sum("n_observations").alias("n_observations"))


def logged_churn(spark: SparkSession, path: str, total_frames: int, streams: list[str] | None = None) -> DataFrame:
    """Churn of what was logged so far; may be asked for at any time."""
    return churn_of(logged_lifetimes(spark, path, streams), total_frames).withColumn("total_frames", F.lit(total_frames).cast("long"))


def close_trajectory(spark: SparkSession, path: str, total_frames: int, streams: list[str] | None = None) -> DataFrame:
    """Write churn to path/churn once the stream has stopped, and return it. A second call changes nothing and gives the same row."""
    logged_churn(spark, path, total_frames, streams).coalesce(1).write.mode("ignore").json(f"{path}/churn")
    return spark.read.schema(CHURN).json(f"{path}/churn")
