"""The test tables as an asset feature table: documents stand for photos, events for their clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same text runs on Spark and DuckDB but for the functions in braces.
BASE = """
SELECT CAST(d.doc_id AS STRING) AS id, {sha}(concat('fp:', CAST(d.doc_id AS STRING))) AS fingerprint,
  CASE WHEN d.doc_id % 97 <> 0 THEN {sha}(d.text) END AS sha256,
  CAST(CASE WHEN d.doc_id % 10 = 0 THEN 600 + d.doc_id % 7 * 100 ELSE 1000 + d.doc_id % 9 * 250 END AS INT) AS width,
  CAST(CASE WHEN d.doc_id % 10 = 0 THEN 900 + d.doc_id % 5 * 150 ELSE 750 + d.doc_id % 8 * 125 END AS INT) AS height,
  CAST(d.n_chars AS BIGINT) AS size, CAST(CASE WHEN d.doc_id % 50 = 0 THEN 2 ELSE 1 END AS INT) AS link_count,
  CAST(2 + d.doc_id % 7 AS DOUBLE) AS entropy_bits, CAST(20 + d.doc_id % 200 AS DOUBLE) AS contrast_p95_p5,
  CAST(d.n_chars AS DOUBLE) AS laplacian_variance,
  CAST(CAST(floor(e.value * 100) AS BIGINT) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS mean_luminance,
  CAST(d.doc_id % 20 AS DOUBLE) / CAST(40 AS DOUBLE) AS underexposed, CAST(d.doc_id % 30 AS DOUBLE) / CAST(60 AS DOUBLE) AS overexposed,
  CAST(d.doc_id % 11 AS DOUBLE) / CAST(200 AS DOUBLE) AS clipping, CAST(d.doc_id % 13 AS DOUBLE) AS noise, CAST(d.doc_id % 90 AS DOUBLE) AS colorfulness,
  concat('IMG_', CAST(d.doc_id AS STRING), '.jpg') AS filename, d.lang AS lang, d.source AS source, d.doc_id AS doc_id, e.ts AS ts, e.user_id AS user_id
FROM documents d JOIN events e ON e.event_id = d.doc_id
"""


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows without hashes: every fifth row has a naive clock, a file's clock, none, or (two) one with an offset.

    Events are merged, not broadcast by the driver: their files are far smaller than their rows. Texts are digested before
    the join, so that it moves digests.
    """
    t = _views(spark, sf_dir, "documents", "events")
    documents, events = t["documents"].withColumn("text", F.sha2("text", 256)), t["events"].hint("merge")
    sql = BASE.replace("FROM documents d JOIN events e", "FROM {documents} d JOIN {events} e").replace("{sha}(concat", "sha2(concat").replace("AS STRING))) AS fingerprint", "AS STRING)), 256) AS fingerprint").replace("{sha}(d.text)", "d.text")
    base = spark.sql(sql, documents=documents, events=events)
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    turn = F.col("doc_id") % 5
    return (
        base.withColumn("capture_time", F.when(turn == 0, wall).when(turn == 3, F.concat(wall, F.lit("+00:00"))).when(turn == 4, wall))
        .withColumn("capture_timezone", F.when(turn == 4, "+00:00"))
        .withColumn("filesystem_time", F.when(turn == 1, F.concat(wall, F.lit("+00:00"))))
    )


def _simhash(batches):
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            digests = b"".join(hashlib.md5(w.encode()).digest() for w in set(text.lower().split(" ")))
            votes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).astype(np.int64)
            p_hi, p_lo, d_hi, d_lo = np.packbits(2 * votes.sum(0) > len(votes)).view(">u4").tolist()
            out.append({"id": str(i), "p_hi": p_hi, "p_lo": p_lo, "d_hi": d_hi, "d_lo": d_lo, "a_hi": p_lo, "a_lo": d_hi})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.string()), *((c, pa.int64()) for c in HASH)]))


HASH = ("p_hi", "p_lo", "d_hi", "d_lo", "a_hi", "a_lo")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and three 64-bit hashes in halves: SimHashes of a document's words, a and two that mix the others' halves."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.col("text").isNotNull())
    return words.mapInArrow(_simhash, "id string, " + ", ".join(f"{c} long" for c in HASH))


def hashed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).join(hashes(spark, sf_dir), "id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


# ---------------------------------------------------------------- the same in DuckDB
ORACLE_ASSET = (
    "base AS (" + BASE.format(sha="sha256") + "), asset AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'exif_naive' WHEN 1 THEN 'filesystem' WHEN 2 THEN 'unknown' ELSE 'exif_timezone' END AS tier,"
    " CASE WHEN doc_id % 5 <> 2 THEN doc_id % 5 <> 0 END AS aware, CASE WHEN doc_id % 5 <> 2 THEN epoch_us(ts) END AS clock_us,"
    " laplacian_variance / (laplacian_variance + 500) AS sharpness, greatest(0, least(1, 1 - abs(mean_luminance - 0.5) / 0.5)) AS exposure,"
    " least(contrast_p95_p5 / 255, 1) AS contrast, least(CAST(width AS DOUBLE) * height / 1e6 / 12, 1) AS resolution FROM base),"
    " scored AS (SELECT *, 0.40 * sharpness + 0.25 * exposure + 0.20 * contrast + 0.15 * resolution AS quality FROM asset)"
)
ORACLE_HASH = (
    "toks AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents), md AS (SELECT doc_id, md5(w) AS h FROM toks),"
    " num AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS p_hi, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS p_lo, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS d_hi, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS d_lo FROM md),"
    " simhash AS (SELECT CAST(doc_id AS VARCHAR) AS id, "
    + ", ".join("(" + " + ".join(f"CASE WHEN sum((({n} >> {b}) & 1) * 2 - 1) > 0 THEN {1 << b} ELSE 0 END" for b in range(32)) + f")::BIGINT AS {n}" for n in ("p_hi", "p_lo", "d_hi", "d_lo"))
    + " FROM num GROUP BY doc_id), hashed AS (SELECT s.*, p_hi, p_lo, d_hi, d_lo, p_lo AS a_hi, d_hi AS a_lo FROM scored s JOIN simhash USING (id))"
)
