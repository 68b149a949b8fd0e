"""Streams: sessions by gap with a watermark, and incremental work on arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import missing
from ..sources.shared import shared_dir


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Rows, first and last time of each session: a key's events with no gap of `gap`. For streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select(key, "first", "last", "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source has now, and return what the last batch put out."""
    spark = stream.sparkSession
    name = "s" + uuid.uuid4().hex
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/halyard/stream-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def incremental(spark: SparkSession, stream: DataFrame, store: str, key: list[str], compute, checkpoint: str):
    """Each batch computes only rows whose key the store lacks, and appends them. A repeated batch adds nothing twice."""

    def batch(df: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        has = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        todo = missing(df, spark.read.parquet(store), key) if has else df
        compute(todo.dropDuplicates(key)).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
