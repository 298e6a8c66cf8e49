"""Streaming forms (STM-*) of the time-driven operators.

Every function takes a streaming frame of events and gives a streaming frame; ``drain`` runs
one over what a file source holds and returns the result as a table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts", lateness: str = "15 seconds", files: int = 8) -> DataFrame:
    """A file stream with event time and a watermark (STM-5)."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def samples(events: DataFrame, width: str = "2500 milliseconds") -> DataFrame:
    """STM-1: tumbling samples; a window without events is a gap, never filled."""
    return events.groupBy(F.window("ts", width)).agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def sliding_throughput(events: DataFrame, width: str = "5 seconds", slide: str = "1 second") -> DataFrame:
    """STM-3."""
    return events.groupBy(F.window("ts", width, slide)).agg(F.sum("value").alias("value"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """STM-4: a session ends when its key is idle for the gap."""
    return events.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("events"))


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """STM-6: each key once within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def expire(events: DataFrame, key: str, seconds: int = 900) -> DataFrame:
    """STM-4: (key, opened, renewals, status): what is opened and not renewed within its time expires.

    A renewal may come at the last moment, which a session's gap excludes, so the gap is a
    microsecond longer.  State is one row per open session, and is dropped when the watermark
    has passed its end; rows may come in any order behind the watermark.
    """
    grants = events.groupBy(key, F.session_window("ts", f"{seconds} seconds 1 microsecond").alias("s")).agg((F.count("*") - 1).cast("int").alias("renewals"))
    return grants.select(key, F.col("s.start").alias("opened"), "renewals", F.lit("expired").alias("status"))


def drain(stream: DataFrame, mode: str, folder: str, name: str | None = None) -> DataFrame:
    """Run a stream over all that is there (availableNow) and return what it gave, as a table in the folder.

    Every micro-batch writes a part of its own, once more if it runs again, so nothing passes
    through the driver and nothing is doubled.  Of complete mode the last part is the result,
    else all parts are.  A stream of the same name goes on where it ended.
    """
    name = name or f"stream_{uuid.uuid4().hex}"
    out = f"{folder}/{name}-out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    try:
        parts = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    except AnalysisException as e:  # no micro-batch ran
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        parts = parts.where(F.col("batch") == parts.agg(F.max("batch")).first()[0])
    return parts if mode == "update" else parts.drop("batch")


def append_table(stream: DataFrame, target: str, key: str, folder: str, buckets: int = 256) -> None:
    """STM-8, MEM-3: each micro-batch adds the rows whose key the target does not hold; a batch that runs again adds nothing.

    The target is partitioned by ``key_bucket``, the hash of the key modulo ``buckets``; of the
    buckets that a batch touches the keys are read, of the others nothing.  A null key is a
    key.  A target keeps the number of buckets that it was begun with.
    """
    if "key_bucket" in stream.columns:
        raise ValueError("key_bucket is the target's own column")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [x[0] for x in fresh.select("key_bucket").distinct().collect()]  # at most so many as there are buckets
            if not touched:
                return
            new = fresh
            try:
                held = spark.read.schema(fresh.schema).parquet(target).where(F.col("key_bucket").isin(touched)).select(F.col(key).alias("held_key"), F.col("key_bucket").alias("held_bucket"))
                new = fresh.join(held, (F.col("key_bucket") == F.col("held_bucket")) & F.col(key).eqNullSafe(F.col("held_key")), "left_anti")
            except AnalysisException as e:  # the first batch finds no target
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
            new.repartition("key_bucket").write.partitionBy("key_bucket").mode("append").parquet(target)
        finally:
            fresh.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
