"""Quality from raw measures: normalised parts, the technical score and warnings. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Weights of sharpness, exposure, contrast and resolution (fixed values).
WEIGHTS = (0.40, 0.25, 0.20, 0.15)
SHARPNESS_SCALE, EXPOSURE_TARGET, EXPOSURE_TOLERANCE, FULL_MEGAPIXELS = 500.0, 0.5, 0.5, 12.0
BLUR_BELOW, EXPOSURE_SHARE, LOW_MEGAPIXELS = 0.15, 0.25, 1.0


def megapixels() -> Column:
    return F.col("width").cast("double") * F.col("height") / 1e6


def normalised(df: DataFrame) -> DataFrame:
    """Adds sharpness, exposure, contrast and resolution, each in [0, 1]."""
    clip = lambda c: vectors.clip(c, 0.0, 1.0)
    return (
        df.withColumn("sharpness", F.col("laplacian_variance") / (F.col("laplacian_variance") + SHARPNESS_SCALE))
        .withColumn("exposure", clip(1 - F.abs(F.col("mean_luminance") - EXPOSURE_TARGET) / EXPOSURE_TOLERANCE))
        .withColumn("contrast", clip(F.col("contrast_p95_p5") / 255))
        .withColumn("resolution", clip(megapixels() / FULL_MEGAPIXELS))
    )


def scored(df: DataFrame) -> DataFrame:
    """Adds the normalised parts and their weighted sum, quality."""
    parts = ("sharpness", "exposure", "contrast", "resolution")
    return normalised(df).withColumn("quality", sum((F.col(p) * w for p, w in zip(parts, WEIGHTS)), F.lit(0.0)))


def warnings() -> Column:
    """The warnings of a row of normalised(), in fixed order."""
    return F.array_compact(
        F.array(
            F.when(F.col("sharpness") < BLUR_BELOW, "low_sharpness"),
            F.when(F.col("underexposed") > EXPOSURE_SHARE, "underexposed"),
            F.when(F.col("overexposed") > EXPOSURE_SHARE, "overexposed"),
            F.when(megapixels() < LOW_MEGAPIXELS, "low_resolution"),
        )
    )


def checked_quality(name: str = "quality") -> Column:
    """Quality, 0 if it is missing; raises on values that are not finite or not in [0, 1]."""
    q = F.coalesce(F.col(name), F.lit(0.0))
    return F.when(F.isnan(q) | (q < 0) | (q > 1), F.raise_error(F.lit("quality must be in [0, 1]")).cast("double")).otherwise(q)


def histogram(df: DataFrame) -> DataFrame:
    """Rows by tenths of quality; the last bin holds 1."""
    bin_ = F.least(F.floor(F.col("quality") * 10).cast("long"), F.lit(9).cast("long"))
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def textured(prefix: str = "") -> Column:
    return (F.col(f"{prefix}entropy_bits") >= 3) & (F.col(f"{prefix}contrast_p95_p5") >= 25)
