"""Scores in context, and diverse short lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.shared import dropped, written


@dataclass(frozen=True)
class Weights:
    variant: str = "B"
    quality: float = 0.60
    representation: float = 0.35
    uniqueness: float = 0.05
    cap: float = 0.10
    floor: float = 0.20
    peers: int = 32
    burst_quality: float = 0.70
    diversity: float = 0.25
    coverage: float = 0.05

    def of(self, context: str) -> tuple[float, float, float]:
        if self.variant == "A" or context == "duplicate":
            return 1.0, 0.0, 0.0
        if context == "burst":
            return self.burst_quality, 1 - self.burst_quality, 0.0
        return self.quality, self.representation, self.uniqueness


def features(df: DataFrame, key: list[str], dimensions: int = 64) -> DataFrame:
    """Adds f: the unit vectors of a context if all its rows have one, else +-1/8 for each bit of the hash."""
    if "vector" not in df.columns:
        return df.withColumn("f", vectors.hash_vector("p_hi", "p_lo"))
    every = df.groupBy(*key).agg(F.every(F.col("vector").isNotNull()).alias("_all"))
    unit = vectors.normalized("vector")
    return df.join(every, key).withColumn("f", F.when(F.col("_all"), unit).otherwise(vectors.hash_vector("p_hi", "p_lo"))).drop("_all")


def representation(df: DataFrame, key: list[str], dimensions: int = 64) -> DataFrame:
    """Adds representation: (1 + cosine with the context's centroid) / 2, or 1/2 if the centroid has no length."""
    centroid = df.groupBy(*key).agg(F.array(*[F.avg(F.col("f")[i]) for i in range(dimensions)]).alias("_c")).withColumn("_n", vectors.norm("_c", dimensions))
    r = F.when(F.col("_n") <= 1e-9, 0.5).otherwise(vectors.clip((vectors.dot("f", "_c", dimensions) / F.col("_n") + 1) / 2, 0.0, 1.0))
    return df.join(centroid, key).withColumn("representation", r).drop("_c", "_n")


def uniqueness(df: DataFrame, key: list[str], w: Weights = Weights(), dimensions: int = 64) -> DataFrame:
    """Adds raw_uniqueness: one less the largest dot product with the context's peers, capped; peers are at most
    w.peers + 1 rows evenly spread over the context's ids."""
    order = Window.partitionBy(*key).orderBy("id")
    ranked = df.select(*key, "id", "f", (F.row_number().over(order) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*key)).alias("_n"))
    m = F.least(F.lit(w.peers + 1), F.col("_n"))
    places = F.when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.floor(i * ((F.col("_n") - 1) / (m - 1)))))
    peers = ranked.where(F.array_contains(places, F.col("_i").cast("long"))).select(*key, F.col("id").alias("_peer"), F.col("f").alias("_f"))
    met = df.select(*key, "id", "f").join(peers, key).where(F.col("id") != F.col("_peer"))
    most = met.groupBy(*key, "id").agg(F.max(vectors.dot("f", "_f", dimensions)).alias("_most"))
    u = F.coalesce(vectors.clip(1 - F.col("_most"), 0.0, w.cap), F.lit(0.0))
    return df.join(most, [*key, "id"], "left").withColumn("raw_uniqueness", u).drop("_most")


def rank(df: DataFrame, key: list[str], context: str = "event", w: Weights = Weights()) -> DataFrame:
    """Adds representation, uniqueness (0 below the quality floor or in odd places), score, sharpness_percentile and raw_rank.

    df: key columns, id, quality, sharpness, exposure, resolution, clipping, f (see features()).
    """
    a, b, c = w.of(context)
    df = written(df, "features")  # read for centroids, peers and scores
    df = uniqueness(representation(df, key), key, w)
    u = F.when((F.col("quality") >= w.floor) & (F.col("representation") >= 0.35), F.col("raw_uniqueness")).otherwise(0.0)
    df = df.withColumn("uniqueness", u).withColumn("score", a * F.col("quality") + b * F.col("representation") + c * F.col("uniqueness"))
    df = df.withColumn("sharpness_percentile", F.cume_dist().over(Window.partitionBy(*key).orderBy("sharpness")))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("sharpness"), F.desc("exposure"), F.desc("resolution"), "clipping", "id")
    return df.withColumn("raw_rank", F.row_number().over(order)).drop("raw_uniqueness")


def coverage_bins(df: DataFrame, key: list[str]) -> DataFrame:
    """Adds region: the quarter of the context's time in which a row lies, or unknown."""
    lo = df.groupBy(*key).agg(F.min("clock_us").alias("_lo"), F.max("clock_us").alias("_hi"))
    quarter = F.floor(4 * ((F.col("clock_us") - F.col("_lo")) / 1e6) / ((F.col("_hi") - F.col("_lo")) / 1e6 + 1))
    quarter = F.when(quarter > 3, 3).otherwise(quarter)
    return df.join(lo, key).withColumn("region", F.coalesce(quarter.cast("string"), F.lit("unknown"))).drop("_lo", "_hi")


def pick(rows, k: int, w: Weights):
    """Greedy choice among (id, score, quality, raw_rank, region, f, groups): [(rank, id, adjusted score, similarity)]."""
    left = sorted(rows, key=lambda r: (r["raw_rank"], r["id"]))
    matrix = np.array([r["f"] for r in left], float).reshape(len(left), -1)
    similar, alive = np.zeros(len(left)), np.ones(len(left), bool)
    used, regions, out = set(), set(), []
    b = w.variant == "B"
    while alive.any() and len(out) < k:
        value = np.array([r["score"] - (w.diversity * s if b and out else 0) + (w.coverage if b and r["region"] not in regions and r["quality"] >= w.floor else 0) for r, s in zip(left, similar)])
        i = min(np.flatnonzero(alive), key=lambda j: (-value[j], left[j]["raw_rank"], left[j]["id"]))
        out.append((len(out) + 1, left[i]["id"], float(value[i]), float(similar[i])))
        used |= set(left[i]["groups"])
        regions.add(left[i]["region"])
        alive[i] = False
        alive &= np.array([not used & set(r["groups"]) for r in left])
        similar = np.maximum(similar, np.clip(matrix @ matrix[i], 0, 1))
    return out


def shortlist(df: DataFrame, key: list[str], k: int, w: Weights = Weights()) -> DataFrame:
    """rank, id, selection_score and similarity of the up to k chosen rows of each context.

    df: rank()'s columns, region and groups (arrays of group ids, no two chosen rows share one). A context is one
    greedy task, as large as an event can be; best() chooses from a whole library.
    """
    if not 0 <= k <= 100:
        raise ValueError("a short list has 0 to 100 rows")

    def greedy(pdf):
        import pandas as pd

        rows = pdf.to_dict("records")
        for r in rows:
            r["groups"] = [] if r["groups"] is None else list(r["groups"])
        found = pd.DataFrame(pick(rows, k, w), columns=["rank", "id", "selection_score", "similarity"])
        for c in key:
            found[c] = pdf[c].iloc[0]
        return found[[*key, "rank", "id", "selection_score", "similarity"]]

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in key) + ", rank int, id string, selection_score double, similarity double"
    return df.select(*key, "id", "score", "quality", "raw_rank", "region", "f", "groups").groupBy(*key).applyInPandas(greedy, schema)


#: Rows that best() sends to the driver before it turns to distributed rounds.
CANDIDATES = 4096


def best(df: DataFrame, k: int, w: Weights = Weights(), dimensions: int = 64, most: int | None = None) -> DataFrame:
    """The greedy choice over a whole library; df: id, score, quality, raw_rank, region, f, groups.

    A row never gets more than its score and the bonus. So the choice is made among the `most` rows with the most to
    gain (CANDIDATES; a bounded number, in one pass), and it stands if every pick beats what any other row can reach.
    Otherwise k distributed rounds choose, with the same rows.
    """
    b = w.variant == "B"
    rows = df.select("id", "score", "quality", "raw_rank", "region", "f", "groups")
    reach = F.col("score") + (F.when(F.col("quality") >= w.floor, w.coverage).otherwise(0.0) if b else F.lit(0.0))
    most = CANDIDATES if most is None else most
    if most:
        some = [r.asDict() for r in rows.withColumn("reach", reach).orderBy(F.desc("reach"), "id").limit(most + 1).collect()]
        beyond = some[most]["reach"] if len(some) > most else None
        picks = pick([r | {"groups": r["groups"] or []} for r in some[:most]], k, w)
        if beyond is None or (len(picks) == k and all(value > beyond for _, _, value, _ in picks)):
            return df.sparkSession.createDataFrame(picks, "rank int, id string, selection_score double, similarity double")
    return _rounds(rows, k, w, dimensions)


def _rounds(rows: DataFrame, k: int, w: Weights, dimensions: int) -> DataFrame:
    """Each of k rounds is one distributed pass: it brings similarities up to date with the last pick and observes the
    best row; only that row moves."""
    spark, b = rows.sparkSession, w.variant == "B"
    now, last = rows.withColumn("similar", F.lit(0.0)), None
    regions, picks = [], []
    while len(picks) < k:
        bonus = F.when((F.col("quality") >= w.floor) & ~(F.col("region").isin(regions) if regions else F.lit(False)), w.coverage).otherwise(0.0) if b else F.lit(0.0)
        value = F.col("score") - (w.diversity * F.col("similar") if b else F.lit(0.0)) + bonus
        seen = Observation()
        row = F.min_by(F.struct("id", "region", "f", "groups", "similar", value.alias("value")), F.struct(-value, F.col("raw_rank"), F.col("id")))
        after = written(now.observe(seen, row.alias("r")), "best")
        top = seen.get["r"]
        if last is not None:
            dropped(last)
        last = after
        if top is None:
            break
        picks.append((len(picks) + 1, top["id"], top["value"], top["similar"]))
        regions.append(top["region"])
        f, groups = F.array(*[F.lit(x) for x in top["f"]]), F.array(*[F.lit(g) for g in top["groups"] or []]).cast("array<string>")
        now = after.where((F.col("id") != top["id"]) & ~F.coalesce(F.arrays_overlap("groups", groups), F.lit(False))).withColumn("similar", F.greatest("similar", vectors.clip(vectors.dot("f", f, dimensions), 0.0, 1.0)))
    if last is not None:
        dropped(last)
    return spark.createDataFrame(picks, "rank int, id string, selection_score double, similarity double")
