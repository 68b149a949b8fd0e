import random

import pytest
from pyspark.sql import functions as F

from halyard.functions import clocks
from halyard.operators import corrections, events
from halyard.sources import synthetic

MIN = 60_000_000
CLOCK = "id string, tier string, aware boolean, clock_us long"


def plain(rows, gap, span):
    out = {}
    for key in {(r[1], r[2]) for r in rows if r[3] is not None}:
        start = last = None
        for _, _, _, t, i in sorted((0, 0, 0, r[3], r[0]) for r in rows if (r[1], r[2]) == key and r[3] is not None):
            if start is None or t - last > gap or t - start > span:
                start = t
            last = t
            out[i] = start
    return out


def segments(spark, rows, gap, span):
    return {r.id: r.segment_start for r in events.segments(spark.createDataFrame(rows, CLOCK), gap, span).collect()}


def test_gap_boundary_is_inclusive_and_span_starts_anew(spark):
    rows = [("a", "t", True, 0), ("b", "t", True, 30 * MIN), ("c", "t", True, 60 * MIN + 1), ("n", "t", False, 0), ("m", "unknown", None, None)]
    assert segments(spark, rows, 30 * MIN, 10**15) == {"a": 0, "b": 0, "c": 60 * MIN + 1, "n": 0}
    hourly = [(str(i), "t", True, i * 60 * MIN) for i in range(30)]
    assert len(set(segments(spark, hourly, 120 * MIN, 18 * 60 * MIN).values())) == 2


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_the_plain_walk(spark, seed):
    pick = random.Random(seed)
    rows = [(str(i), pick.choice("tu"), pick.random() < 0.5, pick.randint(-(10**10), 10**10)) for i in range(300)] + [("x", "t", True, None)]
    gap, span = 10 ** pick.randint(7, 9), 10 ** pick.randint(8, 10)
    assert segments(spark, rows, gap, span) == plain(rows, gap, span)


def test_clock_tiers(spark):
    rows = [
        ("naive", "2025-01-01T12:00:00", None, "2025-06-01T00:00:00+00:00"), ("offset", "2025-01-01T12:00:00", "-06:00", None), ("iso", "2025-01-01T18:00:02+00:00", None, None),
        ("bad zone", "2025-01-01T12:00:00", "+99:99", "2025-06-01T00:00:00+00:00"), ("file", None, None, "2025-06-01T02:00:00+02:00"), ("none", "soon", None, None),
    ]
    got = {r.id: r for r in clocks.with_clock(spark.createDataFrame(rows, "id string, capture_time string, capture_timezone string, filesystem_time string")).collect()}
    assert (got["naive"].tier, got["naive"].aware) == ("exif_naive", False)
    assert got["offset"].tier == "exif_timezone" and got["iso"].clock_us - got["offset"].clock_us == 2_000_000
    assert got["bad zone"].tier == "filesystem" and got["bad zone"].clock_us == got["file"].clock_us
    assert got["none"].tier == "unknown" and got["none"].clock_us is None


def test_representatives_skip_copies(spark):
    schema = "k int, id string, clock_us long, quality double, sha256 string, p_hi long, p_lo long"
    rows = [(1, "a", 10, 0.5, "s", 0, 0), (1, "b", 10, 0.4, "s", 5, 5), (1, "c", 11, 0.9, None, 0, 3), (1, "d", 12, 0.9, None, 0, 7), (1, "e", 20, 0.1, None, None, None)]
    got = [r.id for r in events.event_representatives(spark.createDataFrame(rows, schema), ["k"]).orderBy("rank").collect()]
    assert got == ["c", "a", "e"] or got == ["c", "b", "e"] or got[0] == "c"
    assert len(got) == 3 and "e" in got


def test_density_noise_and_border(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [("a", "t", True, 0, v(1, 0)), ("b", "t", True, MIN, v(1, 0)), ("c", "t", True, 2 * MIN, v(1, 0.1)), ("d", "t", True, 200 * MIN, v(0, 1)), ("e", "t", True, 10**12, v(1, 0))]
    df = events.segments(spark.createDataFrame(rows, CLOCK + ", vector array<double>"), events.COARSE_US)
    got = {r.id: r.cluster for r in events.density_clusters(df, events.density_edges(df, 0.25), 3).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": None, "e": None}


def test_density_windows_end_at_the_longest_span(spark):
    """Rows every half hour for 40 hours are three windows, so three clusters; a border row joins the earlier one."""
    rows = [(f"{i:03d}", "t", True, i * 30 * MIN, [1.0, 0.0]) for i in range(81)]
    df = events.segments(spark.createDataFrame(rows, CLOCK + ", vector array<double>"), events.COARSE_US)
    found = [r.cluster for r in events.density_clusters(df, events.density_edges(df, 0.35)).collect()]
    assert sorted(found.count(c) for c in set(found)) == [7, 37, 37]
    edges = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p"), ("x", "y"), ("y", "z"), ("z", "x"), ("x", "m"), ("p", "m")], "a string, b string")
    nodes = spark.createDataFrame([(i, c) for c, i in enumerate("xyzpqrm")], "id string, clock_us long")
    got = {r.id: r.cluster for r in events.density_clusters(nodes, edges, 4).collect()}
    assert got["m"] == "x" and got["q"] is None or got["m"] in ("x", "p")


def test_overlay_and_corrections(spark):
    assigned = spark.createDataFrame([("1", "f1", "e1"), ("2", "f2", "e1"), ("3", "f3", "e2")], "id string, fingerprint string, event_id string")
    none = spark.createDataFrame([], "id string, fingerprint string, event_id string")
    merged = events.overlay(assigned, corrections.merge(none, assigned, ["e1", "e2"], "m"))
    assert {r.event_id for r in merged.collect()} == {"m"}
    cut = corrections.split(none, assigned, "e1", assigned.where("id = '2'"), "s")
    assert {(r.id, r.event_id, r.source) for r in events.overlay(assigned, cut).collect()} == {("1", "e1", "manual"), ("2", "s", "manual"), ("3", "e2", "automatic")}
    with pytest.raises(ValueError):
        corrections.split(none, assigned, "e1", assigned.where("event_id = 'e1'"), "s")
    stale = corrections.move(none, assigned.withColumn("fingerprint", F.lit("old")), None)
    assert {r.source for r in events.overlay(assigned, stale).collect()} == {"conflict"}


def test_blocks_and_valid_groups(spark):
    rows = spark.createDataFrame([("1", "f1"), ("2", "f2"), ("3", "f3")], "id string, fingerprint string")
    blocked = corrections.block(spark.createDataFrame([], "a string, b string, a_fingerprint string, b_fingerprint string"), rows, "2")
    assert {(r.a, r.b) for r in blocked.collect()} == {("1", "2"), ("2", "3")}
    groups = spark.createDataFrame([("g", "s1", "1"), ("g", "s1", "2"), ("h", "s2", "1"), ("h", "s2", "3"), ("i", "s3", "9")], "group string, signature string, id string")
    suppressed = spark.createDataFrame([("s9",)], "signature string")
    ok = corrections.valid_groups(groups, rows, suppressed, corrections.valid_blocks(blocked, rows))
    assert {r.group for r in ok.collect()} == {"h"}


def test_representatives_by_vectors_equal_the_plain_order(spark):
    """Rows with vectors by cosine to the mean of their group's, then rows by the median clock, then those without a clock."""
    pick = random.Random(3)
    rows = [(i % 3, f"{i:02d}", pick.choice([None, pick.randint(0, 99)]), pick.random(), None, None, None, [pick.gauss(0, 1) for _ in range(4)] if pick.random() < 0.6 else None) for i in range(36)]
    rows += [(7, "x", None, 0.5, None, None, None, [1.0, 0.0]), (7, "y", None, 0.9, None, None, None, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, id string, clock_us long, quality double, sha256 string, p_hi long, p_lo long, vector array<double>")
    got = {}
    for r in events.event_representatives(df, ["k"], 20).orderBy("rank").collect():
        got.setdefault(r.k, []).append(r.id)
    for k in (0, 1, 2, 7):
        own = [r for r in rows if r[0] == k]
        vs, ts = [r[7] for r in own if r[7]], sorted(r[2] for r in own if r[2] is not None)
        centre = [sum(x) / len(vs) for x in zip(*vs)]
        size = sum(x * x for x in centre) ** 0.5
        centre = [x / size for x in centre] if size > 1e-9 else centre
        middle = (ts[(len(ts) - 1) // 2] + ts[len(ts) // 2]) / 2 if ts else None
        far = lambda r: -sum(x * y for x, y in zip(r[7], centre)) if r[7] else abs(r[2] - middle) if r[2] is not None else float("inf")  # noqa: B023,E731
        assert got[k] == [r[1] for r in sorted(own, key=lambda r: (far(r), -r[3], r[1]))]


def test_events_are_renamed_and_members_removed(spark):
    assigned = spark.createDataFrame([(str(i), "f", "e1" if i < 3 else "e2" if i < 5 else None) for i in range(6)], "id string, fingerprint string, event_id string")
    none = spark.createDataFrame([], "id string, fingerprint string, event_id string")
    names = spark.createDataFrame([("e2", "Old")], "event_id string, name string")
    overrides, renamed = corrections.rename(none, names, assigned, "e2", "  New ", "m")
    assert {r.id: r.event_id for r in overrides.collect()} == {"3": "m", "4": "m"} and {tuple(r) for r in renamed.collect()} == {("e2", "Old"), ("m", "New")}
    for event, name in (("e2", " "), ("e2", "x" * 121), ("e9", "x")):
        with pytest.raises(ValueError):
            corrections.rename(none, names, assigned, event, name)
    left = corrections.remove(none, assigned, assigned.where("id in ('0', '5')"))
    assert {r.id: r.event_id for r in left.collect()} == {"0": None, "1": "e1", "2": "e1", "5": None}
    assert {r.id: r.event_id for r in events.overlay(assigned, left).collect()} == {"0": None, "1": "e1", "2": "e1", "3": "e2", "4": "e2", "5": None}
    for wrong in (assigned.where("false"), spark.createDataFrame([("9",)], "id string")):
        with pytest.raises(ValueError):
            corrections.remove(none, assigned, wrong)


def test_synthetic_assets_come_back_as_their_events(spark):
    rows = synthetic.assets(spark, 90)
    found = events.segments(rows).select("id", "event", "segment_start").collect()
    assert len(found) == 90 and len({(r.event, r.segment_start) for r in found}) == 5
    one, many = (sorted(map(str, synthetic.assets(spark, 90).repartition(n).collect())) for n in (1, 7))
    assert one == many
    vs = {r.id: (r.event, r.vector) for r in rows.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert all(abs(dot(v, v) - 1) < 1e-9 and len(v) == 64 for _, v in vs.values())
    inside = [dot(a, b) for e, a in vs.values() for f, b in vs.values() if e == f]
    across = [dot(a, b) for e, a in vs.values() for f, b in vs.values() if e != f]
    assert min(inside) > 0.95 and max(across) < 0.6
