"""Streams over append-only logs: states of a manifest, counts of a growing pool."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.plans.scratch import new_path

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def attempts(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """A file-source stream of attempts."""
    where, _, name = folder.rpartition("/")
    one = name.endswith(".parquet") and spark.read.parquet(folder).select("_metadata.file_path").first()
    if one and one[0].endswith(name):  # a log of one file: its folder, and only that file
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(where)
    return spark.readStream.schema(schema).parquet(folder)


def outcome_by_window(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """substrate, start, ok, empty, throttled: counts of outcomes by window, late rows beyond the watermark left out."""
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "429").otherwise("empty")
    w = stream.withColumn("kind", kind).withColumn("substrate", F.concat(F.lit("s"), F.col("user_id") % 12)).withWatermark("ts", late)
    g = w.groupBy(F.window("ts", width).alias("w"), "substrate")
    counts = g.agg(F.count_if(F.col("kind") == "ok").alias("ok"), F.count_if(F.col("kind") == "empty").alias("empty"), F.count_if(F.col("kind") == "429").alias("throttled"))
    return counts.select("substrate", F.col("w.start").alias("start"), "ok", "empty", "throttled")


def run_once(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs the stream over all that is there, to a table at path."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()


def replay_yield(spark: SparkSession, source: str) -> DataFrame:
    """The windows that the watermark has closed, over a replay of the log. A directory or a file of the log serves."""
    path = new_path(spark, "stream")
    run_once(outcome_by_window(attempts(spark, source)), path)
    return spark.read.parquet(path)


def replay_counts(spark: SparkSession, source: str) -> DataFrame:
    """label, n: class counts of a pool that grows, kept up to date by complete-mode batches."""
    path = new_path(spark, "pool")
    counts = attempts(spark, source).groupBy((F.col("event_id") % 4).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


def append_log(stream: DataFrame, path: str):
    """An append-only sink: every micro-batch adds its rows once."""
    name = uuid.uuid4().hex
    return stream.writeStream.queryName(f"log_{name}").format("json").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append")
