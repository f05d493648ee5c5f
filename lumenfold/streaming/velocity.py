"""Structured Streaming: deduplicated, windowed event counts with a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's state and output, in the shared checkpoint folder where one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="lumenfold-")
    return f"{root.rstrip('/')}/streams/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """O-294: a stream of a Parquet file or folder; its checkpoint is the cursor."""
    held = spark.read.parquet(path)
    schema, (folder, _, name) = held.schema, path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # A stream reads folders, so a single file is picked out of its folder by name.
    single = any(f.rstrip("/").endswith(f"/{name}") for f in held.inputFiles())
    stream = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return stream.withColumns({f.name: stream[f.name].cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def velocity(events: DataFrame, late: str = "31 days", width: str = "1 day") -> DataFrame:
    """O-296: counts and peaks by kind and window; repeated event ids within ``late`` count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("peak"))
    return counted.select("event_type", F.col("w.start").alias("window_start"), "events", "peak")


def run_to_end(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """O-295: processes what is there, then gives the last state of each key.

    A micro-batch overwrites its own folder, so a batch that is repeated after a
    failure leaves one copy.
    """

    def write(batch: DataFrame, nth: int) -> None:
        batch.withColumn("nth", F.lit(nth)).write.mode("overwrite").parquet(f"{folder}/out/batch={nth}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.parquet(f"{folder}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "nth").alias("r"))
    return rows.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
