"""Sentences about scores, for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranking import Weights


def reasons(context: str = "event", w: Weights = Weights(), source: str = "hash features") -> Column:
    """What a row of ranking.rank() owes its score to."""
    _, b, c = w.of(context)
    out = [
        F.format_string("Technical quality: %.3f", F.col("quality")), F.format_string("Sharpness percentile in this context: %.0f%%", F.col("sharpness_percentile") * 100),
        F.format_string("Exposure: %.3f", F.col("exposure")), F.format_string("Resolution: %.3f", F.col("resolution")),
    ]
    if b:
        out.append(F.format_string(f"Representation: %.3f ({source})", F.col("representation")))
    if c:
        out.append(F.format_string(f"Uniqueness: %.3f, at most {w.cap:g}", F.col("uniqueness")))
    return F.array(*out)


def weak_points(w: Weights = Weights()) -> Column:
    """What speaks against a row, and what that may mean."""
    return F.array_compact(
        F.array(
            F.when(F.col("quality") < w.floor, "Low technical score: no bonus for uniqueness or coverage"),
            F.when(F.col("sharpness") < 0.2, "Low sharpness, which may be intended"),
            F.when(F.col("exposure") < 0.4, "Exposure far from the middle, which low light may explain"),
            F.when(F.col("representation") < 0.35, "Unlike its context: no bonus for uniqueness"),
        )
    )
