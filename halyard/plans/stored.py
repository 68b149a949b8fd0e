"""Queries on runs and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..sources import bridge
from .features import A, scored


def run_results(spark, sf_dir):
    """Half of the rows are in the run; each analysis lacks some, or has them for an old fingerprint."""
    rows = bridge.assets(spark, sf_dir).select("id", "doc_id", "fingerprint", "size")
    stored = lambda n, name: rows.where(F.col("doc_id") % n != 0).select("id", F.when(F.col("doc_id") % (n * n + 1) == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(name).alias("analysis"), F.col("doc_id").alias(name))
    run = rows.where("doc_id % 2 = 0").select("id", "fingerprint", F.lit("q").alias("quality_id"), F.lit("h").alias("hashes_id"), F.lit("t").alias("thumbnails_id"))
    now = rows.select("id", F.when(F.col("doc_id") % 10 == 0, "edited").otherwise(F.col("fingerprint")).alias("fingerprint"))
    found = runs.results(rows.select("id", "size"), run, stored(3, "q"), stored(5, "h"), stored(7, "t"), now)
    return found.select("id", "size", F.col("q").alias("quality"), F.col("h").alias("hash"), F.col("t").alias("thumbnail"), "changed")


def valid_vectors(spark, sf_dir):
    """Two records for each vector: the newer one of some does not fit."""
    from ..functions import vectors

    photos = bridge.assets(spark, sf_dir).select("id", "fingerprint", "doc_id")
    unit = bridge.vectors(spark, sf_dir).join(photos, "id").withColumn("vector", vectors.normalized("vector"))
    old = unit.select("id", "fingerprint", F.lit("m").alias("model"), F.lit("p").alias("preprocessing"), F.concat("id", F.lit("-1")).alias("cache_key"), F.lit(1).alias("generated_at"), "vector")
    new = unit.select("id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise("m").alias("model"), F.lit("p").alias("preprocessing"), F.concat("id", F.lit("-2")).alias("cache_key"), F.lit(2).alias("generated_at"), F.transform("vector", lambda x: -x).alias("vector"))
    found = runs.newest_valid(old.unionByName(new), photos, "m", "p", 64).join(unit.select("id", F.col("vector").alias("first")), "id")
    return found.select("id", (F.col("vector")[0] == F.col("first")[0]).alias("older"))


def upload_limits(spark, sf_dir):
    """Events as uploads of their users."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", (F.floor(F.col("value") * 1000)).cast("long").alias("size"))
    return runs.within_limits(rows, ["user_id"], ["event_id"], 30, 60000, 500000).select("event_id", "accepted")


def second_page(spark, sf_dir):
    return runs.page(scored(spark, sf_dir).select("id", F.round("quality", 6).alias("quality")), [F.desc("quality"), "id"], 20, 1)


QUERIES = [run_results, valid_vectors, upload_limits, second_page]
_OLD = "CASE WHEN doc_id % {m} = 0 THEN NULL WHEN doc_id % {n} <> 0 THEN doc_id END"
ORACLES = {
    "run_results": A + f" SELECT id, size, {_OLD.format(n=3, m=10)} AS quality, {_OLD.format(n=5, m=26)} AS hash, {_OLD.format(n=7, m=50)} AS thumbnail, doc_id % 10 = 0 AS changed FROM asset WHERE doc_id % 2 = 0",
    "valid_vectors": A + " SELECT id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS older FROM asset JOIN embeddings ON vec_id = doc_id",
    "upload_limits": "WITH u AS (SELECT event_id, user_id, CAST(floor(value * 1000) AS BIGINT) AS size FROM events), r AS (SELECT *, size <= 60000 AS small FROM u) SELECT event_id, small AND sum(CAST(small AS INT)) OVER w <= 30 AND sum(CASE WHEN small THEN size ELSE 0 END) OVER w <= 500000 AS accepted FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    "second_page": A + " SELECT id, round(quality, 6) AS quality FROM scored ORDER BY round(quality, 6) DESC, id LIMIT 20 OFFSET 20",
}
