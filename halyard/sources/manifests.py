"""Labelled manifests for evaluation, and the checks that keep their splits apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("development", "held_out")
LABELS = ("EXACT_DUPLICATE", "NEAR_DUPLICATE", "BURST", "VISUALLY_SIMILAR", "UNRELATED")
PHOTOS = "id string, path string, split string, family string, capture_time string, capture_timezone string, sha256 string"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """photos, pairs and groups of a manifest of one JSON object."""
    schema = f"photos array<struct<{PHOTOS.replace(' string', ':string')}>>, pairs array<struct<a:string,b:string,label:string,split:string,category:string>>, groups array<struct<members:array<string>,label:string,split:string>>"
    one = spark.read.schema(schema).option("multiLine", "true").json(path)
    part = lambda c: one.select(F.explode(c).alias("r")).select("r.*")
    return part("photos"), part("pairs"), part("groups")


def expanded(pairs: DataFrame, groups: DataFrame, most: int = 256) -> DataFrame:
    """Labelled pairs a < b: the given ones and all of each group; pairs labelled alike twice count once."""
    if groups.where(F.size("members") > most).limit(1).count():
        raise ValueError(f"a group has more than {most} members")
    m = F.array_sort(F.array_distinct("members"))
    rows = groups.select("label", "split", m.alias("m")).select("label", "split", "m", F.posexplode("m").alias("i", "a"))
    rows = rows.select("label", "split", "a", F.explode(F.slice("m", F.col("i") + 2, F.greatest(F.size("m") - F.col("i") - 1, F.lit(0)))).alias("b"))
    given = pairs.select("label", "split", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return given.unionByName(rows).distinct()


def problems(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind and key of whatever breaks the rules: ids twice, odd splits and labels, families or equal files on both
    sides, pairs of one row, unknown rows, split mismatches, conflicting labels, a side without rows."""
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
    both = lambda c: photos.where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).where("n > 1")
    named = pairs.withColumn("key", F.concat_ws("|", "a", "b"))
    sides = named.join(photos.select(F.col("id").alias("a"), F.col("split").alias("sa")), "a", "left").join(photos.select(F.col("id").alias("b"), F.col("split").alias("sb")), "b", "left")
    empty = photos.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string").join(photos, "split", "left_anti")
    out = row(photos.groupBy("id").count().where("count > 1"), "id twice", "id")
    for more in (
        row(photos.where(~F.col("split").isin(*SPLITS)), "no such split", "id"),
        row(both("family"), "family in both splits", "family"),
        row(both("sha256"), "equal files in both splits", "sha256"),
        row(named.where("a = b"), "pair of one row", "key"),
        row(named.where(~F.col("label").isin(*LABELS)), "no such label", "key"),
        row(sides.where(F.col("sa").isNull() | F.col("sb").isNull()), "unknown row", "key"),
        row(sides.where((F.col("sa") != F.col("split")) | (F.col("sb") != F.col("split"))), "pair across splits", "key"),
        row(named.groupBy("key").agg(F.count_distinct("label").alias("n")).where("n > 1"), "conflicting labels", "key"),
        row(empty, "split without rows", "split"),
    ):
        out = out.unionByName(more)
    return out
