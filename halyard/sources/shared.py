"""Written tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Only a local master may do without either: it gets a
    temporary folder, which its driver and executor, one process, share. On a cluster that would lose rows, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="halyard-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/halyard/{tag}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes the path when the driver's JVM ends, if it is still there."""
    files, at = _files(spark, path)
    files.deleteOnExit(at)


def _stored(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    spark = df.sparkSession
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._halyard_path = path
    return kept


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder; it goes with dropped(), at the latest when the driver ends."""
    path = fresh_path(df.sparkSession, tag)
    kept = _stored(df, path)
    until_exit(df.sparkSession, path)
    return kept


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    remove(df.sparkSession, df._halyard_path)


class Workspace:
    """The tables of one run, in one folder. Leaving the context removes the folder and the catalogue's names; what
    result() wrote lies beside it and goes when the driver ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.path = fresh_path(spark, tag)
        self.names: list[str] = []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.path)

    def table(self, df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
        kept = _stored(df, f"{self.path}/{tag}-{uuid.uuid4().hex[:8]}", partition_by)
        until_exit(self.spark, self.path)
        return kept

    def bucketed(self, df: DataFrame, tag: str, number: int, column: str) -> DataFrame:
        """A table in `number` buckets of a column: joins on it move the other side only."""
        name = f"halyard_{uuid.uuid4().hex}"
        path = f"{self.path}/{tag}"
        df.repartition(number, column).write.option("path", path).option("compression", "zstd").bucketBy(number, column).saveAsTable(name)
        until_exit(self.spark, self.path)
        self.names.append(name)
        return self.spark.table(name)

    def result(self, df: DataFrame) -> DataFrame:
        """df, computed now and readable after the run's other tables are gone."""
        return written(df, f"{self.tag}-result")
