"""Capture clocks: tiers, awareness and comparable instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of each tier (fixed values).
CONFIDENCE = {"exif_timezone": "high", "exif_naive": "medium", "filesystem": "low", "unknown": "none"}
_OFFSET = "([+-][0-9]{2}:?[0-9]{2}|Z)$"


def with_clock(df: DataFrame) -> DataFrame:
    """Adds tier, clock_us and aware from capture_time, capture_timezone and filesystem_time (ISO texts).

    A naive capture time takes the capture's offset if there is one; a time that can't be parsed falls to the file's.
    Wall clocks and instants are never compared with each other, so `aware` tells them apart.
    """
    capture = F.when(F.col("capture_time").rlike(_OFFSET), F.col("capture_time")).otherwise(F.concat("capture_time", F.coalesce("capture_timezone", F.lit(""))))
    df = df.withColumn("_capture", capture)
    parsed = lambda c: F.expr(f"CASE WHEN {c} RLIKE '{_OFFSET}' THEN unix_micros(try_cast({c} AS TIMESTAMP_LTZ)) ELSE timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', try_cast({c} AS TIMESTAMP_NTZ)) END")
    df = df.withColumn("_capture_us", parsed("_capture")).withColumn("_file_us", parsed("filesystem_time"))
    has_offset = F.col("_capture").rlike(_OFFSET)
    tier = F.when(F.col("_capture_us").isNotNull(), F.when(has_offset, "exif_timezone").otherwise("exif_naive")).when(F.col("_file_us").isNotNull(), "filesystem").otherwise("unknown")
    aware = F.when(F.col("_capture_us").isNotNull(), has_offset).when(F.col("_file_us").isNotNull(), F.col("filesystem_time").rlike(_OFFSET))
    return df.withColumn("tier", tier).withColumn("aware", aware).withColumn("clock_us", F.coalesce("_capture_us", "_file_us")).drop("_capture", "_capture_us", "_file_us")


def confidence(tier="tier") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col(tier))


def gap_us(left: str, right: str) -> Column:
    """Microseconds between two rows with clocks of one tier and awareness, else null."""
    same = (F.col(f"{left}.tier") == F.col(f"{right}.tier")) & (F.col(f"{left}.aware") == F.col(f"{right}.aware"))
    return F.when(same, F.abs(F.col(f"{left}.clock_us") - F.col(f"{right}.clock_us")))
