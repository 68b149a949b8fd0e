"""Events: segments of clocks by gap and span, their records, members' status, manual edits and density variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, clocks, texts, vectors
from ..sources.shared import written
from .graph import labelled

SEGMENT = ["tier", "aware", "segment_start"]
GAP_US, COARSE_US, SPAN_US = 120 * 60 * 10**6, 240 * 60 * 10**6, 18 * 3600 * 10**6


def gap_runs(df: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Adds run: the clock at which the row's run of gaps of at most gap_us began, within its tier and awareness.

    Clocks are summed up in cells as wide as the gap, inside which no run can end; only the cells, whose number is
    bounded by the time that the clocks span, are put in order.
    """
    rows = df.where(F.col("clock_us").isNotNull()).withColumn("_cell", F.floor(F.col("clock_us") / gap_us))
    key = ["tier", "aware"]
    cells = rows.groupBy(*key, "_cell").agg(F.min("clock_us").alias("lo"), F.max("clock_us").alias("hi"))
    order = Window.partitionBy(*key).orderBy("_cell")
    starts = F.when(F.coalesce(F.col("lo") - F.lag("hi").over(order) > gap_us, F.lit(True)), F.col("lo"))
    cells = cells.withColumn("_start", starts).withColumn("run", F.last("_start", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(cells.select(*key, "_cell", "run"), [*key, "_cell"]).drop("_cell")


def segments(df: DataFrame, gap_us: int = GAP_US, span_us: int = SPAN_US) -> DataFrame:
    """Adds segment_start: the clock of the first row of the row's segment. Rows without a clock are left out.

    A segment ends before a gap of more than gap_us, and before a row more than span_us after its first. Runs that
    are no longer than the span are segments as they are; in others the starts are found by a fold over their distinct clocks.
    """
    # what is read more than once is written once, and holds no more than the clocks
    narrow = written(df.where(F.col("clock_us").isNotNull()).select("id", "tier", "aware", "clock_us"), "clocks")
    runs = written(gap_runs(narrow, gap_us), "runs")
    key = ["tier", "aware", "run"]
    sizes = runs.groupBy(*key).agg(F.max("clock_us").alias("_hi"))
    long = sizes.where(F.col("_hi") - F.col("run") > span_us).select(*key)
    inside = runs.select(*key, "clock_us").join(long, key).distinct()

    def fold(pdf):
        out, start = [], None
        for t in sorted(pdf.clock_us):
            if start is None or t - start > span_us:
                start = t
                out.append(t)
        return type(pdf)({k: [pdf[k].iloc[0]] * len(out) for k in key} | {"segment_start": out})

    # the fold's input is a run's distinct clocks; its output is bounded by the time that the run spans
    starts = inside.groupBy(*key).applyInPandas(fold, "tier string, aware boolean, run long, segment_start long")
    starts = starts.groupBy(*key).agg(F.array_sort(F.collect_list("segment_start")).alias("_starts"))
    # without long runs the list is null and the run itself is the segment
    last = F.element_at(F.filter("_starts", lambda s: s <= F.col("clock_us")), -1)
    return df.join(runs.join(starts, key, "left").select("id", F.coalesce(last, F.col("run")).alias("segment_start")), "id")


def records(members: DataFrame, key: list[str]) -> DataFrame:
    """id, n, first and last member by (clock, id), start and end texts for each group, named in order of start and id.

    The order is over events only, whose number is bounded by the time that the clocks span.
    """
    order = F.struct("clock_us", "id")
    found = members.groupBy(*key).agg(
        F.concat(F.lit("auto-"), texts.group_signature(F.collect_list(F.struct("id", "fingerprint")))).alias("event_id"),
        F.count("*").alias("n"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"),
        F.min_by("stamp", order).alias("start"), F.max_by("stamp", order).alias("end"),
    )
    return found.withColumn("name", F.format_string("Event %02d", F.row_number().over(Window.orderBy("start", "event_id"))))


def stamp(aware="aware", clock="clock_us"):
    """ISO text of a clock: with +00:00 for instants, without an offset for wall clocks."""
    whole = F.date_format(F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({clock} AS DECIMAL(24, 6)) / 1000000)"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.col(aware), F.concat(whole, F.lit("+00:00"))).otherwise(whole)


def assignments(df: DataFrame, segmented: DataFrame) -> DataFrame:
    """id, segment_start, status, reason and confidence for every row: members, uncertain members and rows without a clock."""
    found = df.join(segmented.select("id", "segment_start"), "id", "left")
    return found.select(
        "id", "segment_start", "tier", "aware", clocks.confidence().alias("confidence"),
        F.when(F.col("segment_start").isNull(), "UNASSIGNED").when(F.col("tier") != "exif_timezone", "LOW_CONFIDENCE").otherwise("EVENT_MEMBER").alias("status"),
        F.when(F.col("segment_start").isNull(), "No usable timestamp").when(F.col("tier") == "filesystem", "Filesystem timestamp can reflect copying").when(F.col("tier") == "exif_naive", "EXIF has no timezone; camera clocks may differ").otherwise("Temporal continuity").alias("reason"),
    )


def event_representatives(members: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """Up to `most` members for each group, the most central first (then quality, then id), none of them a copy
    (content hash, or at most 2 bits) of one before it. A group is an event, bounded by the longest span.

    With a column `vector`, rows that have one go first, by cosine to the mean of the group's vectors; the others go by
    distance from the median clock, those without a clock last.
    """
    median = members.groupBy(*key).agg(F.median("clock_us").alias("_middle"))
    far = F.coalesce(F.abs(F.col("clock_us") - F.col("_middle")).cast("double"), F.lit(float("inf")))
    near = members.join(median, key)
    if "vector" in members.columns:
        parts = members.where(F.col("vector").isNotNull()).select(*key, F.posexplode("vector").alias("_k", "_v")).groupBy(*key, "_k").agg(F.avg("_v").alias("_v"))
        centre = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_k", "_v")))["_v"].alias("_centre"))
        near, length = near.join(centre, key, "left"), vectors.norm("_centre")
        # a mean of no length is not scaled, so that all cosines are near 0 there
        far = F.when(F.col("vector").isNotNull(), -vectors.dot("vector", "_centre") / F.when(length > 1e-9, length).otherwise(1.0)).otherwise(far)
    near = near.withColumn("_far", far)
    listed = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_far", (-F.col("quality")).alias("worse"), "id", "sha256", "p_hi", "p_lo"))).alias("all"))
    apart = lambda x, y: ~(F.coalesce(x["sha256"] == y["sha256"], F.lit(False)) | F.coalesce(F.bit_count(x["p_hi"].bitwiseXOR(y["p_hi"])) + F.bit_count(x["p_lo"].bitwiseXOR(y["p_lo"])) <= 2, F.lit(False)))
    none = F.slice("all", 1, 0)
    chosen = F.aggregate("all", none, lambda done, x: F.when((F.size(done) < most) & F.forall(done, lambda y: apart(x, y)), F.concat(done, F.array(x))).otherwise(done))
    return listed.select(*key, F.posexplode(chosen).alias("place", "chosen")).select(*key, (F.col("place") + 1).alias("rank"), F.col("chosen.id").alias("id"))


def overlay(assigned: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual overrides (id, fingerprint, event_id or null) replace automatic events where the fingerprint still holds.

    assigned: id, fingerprint, event_id. Adds source: automatic, manual, or conflict (a stale override, not applied).
    """
    o = overrides.select("id", F.col("fingerprint").alias("_print"), F.col("event_id").alias("_event"), F.lit(True).alias("_has"))
    both = assigned.join(o, "id", "left")
    holds = F.coalesce(F.col("_has"), F.lit(False)) & F.col("fingerprint").eqNullSafe(F.col("_print"))
    return both.withColumn("event_id", F.when(holds, F.col("_event")).otherwise(F.col("event_id"))).withColumn("source", F.when(holds, "manual").when(F.col("_has"), "conflict").otherwise("automatic")).drop("_print", "_event", "_has")


def density_edges(df: DataFrame, epsilon: float, window_us: int = COARSE_US, visual: float = 0.3, temporal: float = 0.7, neighbours: int = 64, key: list[str] = SEGMENT) -> DataFrame:
    """Edges of the bounded time graph: rows with vectors, of one window (key), at most `neighbours` places and window_us
    apart, whose weighted distance of vector and clock is at most epsilon. temporal = 0: by vectors alone, at any gap."""
    rows = df.where(F.col("vector").isNotNull())
    ranked = rows.select(*key, "id", "clock_us", vectors.normalized("vector").alias("v"), F.row_number().over(Window.partitionBy(*key).orderBy("clock_us", "id")).alias("place"))
    before = ranked.where("place > 1").withColumn("place", F.explode(F.sequence(F.greatest(F.col("place") - neighbours, F.lit(1)), F.col("place") - 1)))
    pairs = ranked.alias("l").join(before.alias("r"), [*key, "place"])
    visually = visual * F.greatest(F.lit(0.0), 1 - vectors.dot("l.v", "r.v"))
    if temporal:
        delta = F.abs(F.col("r.clock_us") - F.col("l.clock_us")) / window_us
        pairs, distance = pairs.where(delta <= 1), visually + temporal * delta
    else:
        distance = visually
    return pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), distance.alias("distance")).where(F.col("distance") <= epsilon)


def truncated(df: DataFrame, neighbours: int = 64, key: list[str] = SEGMENT) -> DataFrame:
    """Windows (key) in which some row has more rows behind it than density_edges looks at: their members need a review."""
    return df.where(F.col("vector").isNotNull()).groupBy(*key).agg((F.count("*") > neighbours + 1).alias("truncated"))


def density_clusters(nodes: DataFrame, edges: DataFrame, min_samples: int = 2) -> DataFrame:
    """id, cluster (the id of its first core by clock and id, null: noise): cores have min_samples rows within reach,
    themselves counted; a row that is no core joins the earliest of the clusters whose cores reach it.

    nodes: id, clock_us (null counts as the earliest).
    """
    node = F.struct(F.coalesce("clock_us", F.lit(-(1 << 62))).alias("at"), "id")
    nodes = nodes.select("id", node.alias("node"))
    both = edges.select("a", "b").union(edges.select("b", "a"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    core = nodes.join(degree, "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id", "node")
    inner = edges.join(core.select(F.col("id").alias("a"), F.col("node").alias("u")), "a").join(core.select(F.col("id").alias("b"), F.col("node").alias("v")), "b")
    clusters = labelled(core, inner.select("u", "v"), key="node", label="cluster")
    reach = both.join(clusters.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("border"))
    return nodes.select("id").join(clusters.select("id", "cluster"), "id", "left").join(reach, "id", "left").select("id", F.coalesce("cluster", "border")["id"].alias("cluster"))


def density_assignments(df: DataFrame, clustered: DataFrame, dense: DataFrame, key: list[str] = SEGMENT) -> DataFrame:
    """id, cluster, status and reason of every row of df (id, tier, clock_us, vector, key columns; key null without a clock)."""
    rows = df.join(clustered, "id", "left").join(dense, key, "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    known = F.col("cluster").isNotNull()
    return rows.select(
        "id", "cluster",
        F.when(~known, "UNASSIGNED").when((F.col("tier") != "exif_timezone") | F.col("truncated"), "LOW_CONFIDENCE").otherwise("EVENT_MEMBER").alias("status"),
        F.when(F.col("clock_us").isNull(), "No usable timestamp").when(F.col("vector").isNull(), "No vector").when(~known, "Too few rows near by in time and looks")
        .when(F.col("tier") == "filesystem", "Filesystem timestamp can reflect copying").when(F.col("tier") == "exif_naive", "EXIF has no timezone; camera clocks may differ")
        .when(F.col("truncated"), "Dense window: the search for neighbours was bounded").otherwise("Near in time and looks").alias("reason"),
    )
