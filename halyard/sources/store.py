"""What runs leave behind: analyses replaced by key, detection runs saved and read back, derived tables cleared."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection
from .shared import remove

#: Tables that can be made again, and those that hold what people did, which nothing here deletes.
DERIVED = ("quality", "hashes", "thumbnails", "vectors", "pairs", "groups", "evidence", "distances", "savings", "statistics", "events", "rankings")
USER = ("overrides", "names", "blocked", "suppressed", "feedback", "decisions", "ledger")


def _path(folder: str, name: str) -> str:
    if name not in (*DERIVED, *USER):
        raise ValueError(f"no such table: {name}")
    return f"{folder.rstrip('/')}/{name}"


def _partition(folder: str, name: str, key: str, value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9._-]*", value):
        raise ValueError(f"not a name for a partition: {value!r}")
    return f"{_path(folder, name)}/{key}={value}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save(df: DataFrame, folder: str, name: str, key: str, value: str) -> None:
    """df in place of what the table has stored for this key (an analysis, a run); other keys stay as they are.

    A key is one partition of the table, and the partition is replaced when the job commits; an empty df empties it.
    """
    path = _partition(folder, name, key, value)
    df.drop(key).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, folder: str, name: str, key: str, value: str) -> DataFrame:
    """What save() stored for the key; raises a ValueError for a key that was never saved."""
    path = _partition(folder, name, key, value)
    if not exists(spark, path + "/_SUCCESS"):
        raise ValueError(f"{name} holds nothing for {key} {value}")
    return spark.read.parquet(path)


def save_detection(found: dict[str, DataFrame], features: DataFrame, folder: str, run: str) -> None:
    """The tables of detection.detect(); groups with their signatures (features: id, fingerprint). The statistics are
    removed first and written last, so that a run that was lost on the way is not there to be read."""
    remove(features.sparkSession, _partition(folder, "statistics", "run", run))
    members = found["groups"].join(features.select("id", "fingerprint"), F.col("member") == F.col("id"))
    signed = found["groups"].join(detection.signatures(members, ["type", "group"]), ["type", "group"])
    for name in ("pairs", "evidence", "distances", "savings"):
        save(found[name], folder, name, "run", run)
    save(signed, folder, "groups", "run", run)
    save(found["statistics"], folder, "statistics", "run", run)


def load_detection(spark: SparkSession, folder: str, run: str) -> dict[str, DataFrame]:
    """What save_detection() stored, groups in order of type, signature and member."""
    statistics = load(spark, folder, "statistics", "run", run)
    out = {name: load(spark, folder, name, "run", run) for name in ("pairs", "evidence", "distances", "savings", "groups")}
    return out | {"statistics": statistics, "groups": out["groups"].orderBy("type", "signature", "member")}


def clear_derived(spark: SparkSession, folder: str) -> list[str]:
    """Delete every derived table of the folder and nothing else; their names."""
    gone = [name for name in DERIVED if exists(spark, _path(folder, name))]
    for name in gone:
        remove(spark, _path(folder, name))
    return gone
