"""Queries on pixels and streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import pixels
from ..streaming import sessions


def image_measures(spark, sf_dir):
    """A seeded picture for each document, measured and hashed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(spark.createDataFrame([], pixels.SCHEMA).schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([pixels.measured(str(i), pixels.scene(i)) for i in batch.column("doc_id").to_pylist()], kind)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").repartition(max(8, spark.sparkContext.defaultParallelism))
    return docs.mapInArrow(run, pixels.SCHEMA).drop("gray", "chroma", "error")


def user_sessions(spark, sf_dir):
    """Sessions of each user: gaps of two hours end them."""
    path = f"{sf_dir}/events.parquet"
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")
    return sessions.sessions(spark.read.parquet(path)).select("user_id", micros("first").alias("first_us"), micros("last").alias("last_us"), "n")


QUERIES = [image_measures, user_sessions]
ORACLES = {
    "user_sessions": "WITH g AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000, true) AS fresh FROM events), s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, k",
}
