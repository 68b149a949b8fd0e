"""Assets of any number for measuring at scale, made where they are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors

SEED, PER_EVENT, APART_US, DIMENSIONS = 81704, 20, 6 * 3600 * 10**6, 64


def normal(*of: Column) -> Column:
    """A normally distributed number that hangs on the given values only (Box and Muller on two hashes)."""
    unit = lambda turn: (F.pmod(F.xxhash64(*of, F.lit(turn), F.lit(SEED)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))


def assets(spark: SparkSession, n: int, spread: float = 0.05, start_us: int = 1_735_689_600_000_000) -> DataFrame:
    """n rows (id, fingerprint, tier, aware, clock_us, event, vector): events of 20 rows a minute apart that begin six hours
    apart, their unit vectors near a centre that is the event's own. The same rows on any layout."""
    row = spark.range(n).select(F.col("id").alias("i"), F.floor(F.col("id") / PER_EVENT).alias("event"))
    places = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    raw = F.transform(places, lambda k: normal(F.lit("event"), F.col("event"), k) + spread * normal(F.lit("row"), F.col("i"), k))
    row = row.withColumn("raw", raw).withColumn("id", F.format_string("s%012d", "i"))
    return row.select(
        "id", F.sha2("id", 256).alias("fingerprint"), F.lit("exif_timezone").alias("tier"), F.lit(True).alias("aware"),
        (F.lit(start_us) + F.col("event") * APART_US + F.col("i") % PER_EVENT * 60_000_000).alias("clock_us"), "event", vectors.normalized("raw").alias("vector"),
    )
