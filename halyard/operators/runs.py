"""Runs and what they have stored: results, valid vectors, limits, failures and pages of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def results(photos: DataFrame, in_run: DataFrame, quality: DataFrame, hashes: DataFrame, thumbnails: DataFrame, current: DataFrame) -> DataFrame:
    """A row for each photo of a run, with what its analyses stored for the fingerprint that the run saw, and whether
    the file has changed since.

    in_run: id, fingerprint and the ids of the analyses (quality_id, hashes_id, thumbnails_id); the stored tables:
    id, fingerprint, analysis and their values; current: id, fingerprint.
    """
    out = photos.join(in_run, "id")
    for name, stored in (("quality", quality), ("hashes", hashes), ("thumbnails", thumbnails)):
        out = out.join(stored.withColumnRenamed("analysis", f"{name}_id"), ["id", "fingerprint", f"{name}_id"], "left")
    now = current.select("id", F.col("fingerprint").alias("_now"))
    return out.join(now, "id", "left").withColumn("changed", ~F.col("fingerprint").eqNullSafe(F.col("_now"))).drop("_now")


def newest_valid(records: DataFrame, photos: DataFrame, model: str, preprocessing: str, dimensions: int) -> DataFrame:
    """id and vector of the newest cached record of each photo that fits: model, preprocessing, fingerprint, size,
    finite numbers and length 1."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    good = records.where((F.col("model") == model) & (F.col("preprocessing") == preprocessing) & (F.size("vector") == dimensions))
    good = good.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.abs(norm - 1) <= 1e-4)
    good = good.join(photos.select("id", "fingerprint"), ["id", "fingerprint"], "left_semi")
    return good.groupBy("id").agg(F.max_by("vector", F.struct("generated_at", "cache_key")).alias("vector"))


def within_limits(uploads: DataFrame, key: list[str], order: list[str], count: int = 30, each: int = 15 << 20, total: int = 60 << 20) -> DataFrame:
    """Adds accepted: uploads of a session in their order, while each is small enough and, of those, the number and
    the sum stay within the limits."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    small = F.col("size") <= each
    return uploads.withColumn("accepted", small & (F.sum(small.cast("long")).over(w) <= count) & (F.sum(F.when(small, F.col("size")).otherwise(0)).over(w) <= total))


def failures(df: DataFrame, run: str, stage: str) -> DataFrame:
    """Rows with an error, for the failures table; messages are cut at 2000 characters."""
    return df.where(F.col("error").isNotNull()).select(F.lit(run).alias("run"), F.col("id").alias("path"), F.lit(stage).alias("stage"), F.regexp_extract("error", "^([A-Za-z_]+)", 1).alias("type"), F.substring("error", 1, 2000).alias("message"))


def page(df: DataFrame, order: list[Column | str], size: int, number: int) -> DataFrame:
    """Page `number` (from 0) of df in an order that has no ties; a top-k plan, nothing is sorted as a whole."""
    return df.orderBy(*order).offset(size * number).limit(size)
