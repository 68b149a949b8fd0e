"""Incremental work: what is missing from a store, replacing by key, and content keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parameter_hash(parameters: dict) -> str:
    """SHA-256 of canonical JSON; raises on numbers that JSON does not have."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def missing(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of wanted whose key (say id, fingerprint, analysis) the store lacks."""
    return wanted.join(stored.select(*key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """stored with the rows of fresh in place of those with their keys."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def content_key(df: DataFrame, parameters: dict) -> str:
    """A key of a table's rows, in any order, and of parameters: the sum of row hashes, and their count."""
    columns = sorted(df.columns)
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(h).alias("s"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).alias("t")).first()
    return parameter_hash({"rows": r.n, "sum": str(r.s), "sum1": str(r.t), "parameters": parameters})


def memoised(spark: SparkSession, folder: str, df: DataFrame, parameters: dict, compute) -> DataFrame:
    """compute(df), or what an earlier call with the same rows and parameters has written."""
    path = f"{folder.rstrip('/')}/{content_key(df, parameters)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        compute(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
