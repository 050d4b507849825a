"""Event streams: hourly sums, late data under a watermark, sessions per user."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.plans.staging import stage_path


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A table's folder, or one file, as a stream."""
    schema = spark.read.parquet(path).schema
    name = path.rsplit("/", 1)[-1]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return source.option("pathGlobFilter", name).parquet(path.rsplit("/", 1)[0]) if name.count(".") and not _is_folder(spark, path) else source.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and sum of each type and hour; rows later than the watermark are dropped."""
    told = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return told.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    told = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return told.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result as a table."""
    spark = stream.sparkSession
    view = f"{name}_{uuid.uuid4().hex[:8]}"
    running = stream.writeStream.format("memory").queryName(view).outputMode(mode).option("checkpointLocation", stage_path(spark, name)).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.table(view)


def hourly_batch(spark: SparkSession, path: str) -> DataFrame:
    return run_once(hourly(read_events(spark, path)), "hourly").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
