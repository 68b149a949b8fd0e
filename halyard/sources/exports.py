"""Sinks: selections as JSON or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"event": "Unassigned", "user_label": "unmarked"}
COLUMNS = ("source_path", "source_name", "rank", "event", "technical_quality_v1", "quality_metrics", "explanation", "weaker_points", "user_label")


def manifest(df: DataFrame) -> DataFrame:
    """The exported columns that df has, with defaults for missing events and labels."""
    return df.select(*[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in COLUMNS if c in df.columns])


def guarded(df: DataFrame) -> DataFrame:
    """For CSV: nested columns as JSON text, and an apostrophe before strings that a spreadsheet would run."""
    out = []
    for name, kind in df.dtypes:
        c = F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(name)
        if kind == "string" or kind.startswith(("array", "struct", "map")):
            c = F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
        out.append(c.alias(name))
    return df.select(*out)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write a manifest; an empty CSV still has its header."""
    if kind == "json":
        manifest(df).write.json(path)
    elif kind == "csv":
        guarded(manifest(df)).write.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"no export format: {kind}")


#: Columns of a pair report, in their order (fixed values).
PAIR_REPORT = ("split", "a", "b", "label", "prediction", "phash", "dhash", "ahash", "correlation", "grouped_near", "grouped_burst")


def pair_report(measured: DataFrame) -> DataFrame:
    """Labelled pairs with their verdicts (split, a, b, label, relationship, distances, grouped flags) as a report's rows."""
    return measured.withColumn("prediction", F.col("relationship")).select(*PAIR_REPORT)
