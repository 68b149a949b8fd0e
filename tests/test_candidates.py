import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from halyard.operators import candidates, detection, evaluation, evidence, graph, grouping

from tests.plans import plans

HASH = "id string, p_hi long, p_lo long"


def popcount(a, b):
    return bin((a[1] ^ b[1]) << 32 | (a[2] ^ b[2])).count("1")


def adversarial(n, seed):
    pick = random.Random(seed)
    base = [pick.getrandbits(64) for _ in range(12)]
    out = []
    for i in range(n):
        h = pick.choice(base)
        for _ in range(pick.randint(0, 9)):
            h ^= 1 << pick.randint(0, 63)
        out.append((str(i), h >> 32, h & 0xFFFFFFFF))
    return out


def test_hamming_pairs_equal_brute_force(spark):
    rows = adversarial(220, 1) + [("x", None, None)]
    for radius in (0, 2, 8):
        got = {(r.a, r.b, r.distance) for r in candidates.hamming_pairs(spark.createDataFrame(rows, HASH), radius).collect()}
        expected = {(*sorted((a[0], b[0])), popcount(a, b)) for a, b in itertools.combinations(rows[:-1], 2) if popcount(a, b) <= radius}
        assert got == expected
        for count in {n for n, *_ in candidates._ways(radius)}:
            assert {(r.a, r.b, r.distance) for r in candidates.hamming_pairs(spark.createDataFrame(rows, HASH), radius, count=count).collect()} == expected


def test_probes_follow_the_number_of_hashes():
    """Probes and expected meetings of a hash: few at any number of hashes, where bands alone would meet 1 in 128."""
    cost = lambda n: min(p * (1 + n / 2**w) for _, _, p, w in candidates._ways(8))
    assert cost(10**3) < 100 and cost(10**4) < 250 and cost(10**6) < 1200 < 9 * 10**6 / 128


def test_query_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = spark.createDataFrame([(str(i), rng.normal(size=8).tolist()) for i in range(60)], "id string, vector array<double>")
    ask = lambda: {(r.query, r.id, r.rank) for r in candidates.cosine_topk(vecs.limit(20), vecs, 3, 8).collect()}
    whole = ask()
    monkeypatch.setattr(candidates, "QUERY_BLOCK", 4)
    assert ask() == whole and len(whole) == 60


def test_detection_suppresses_and_explains(spark):
    rows = [{"id": i, "sha256": s, "p_lo": p} for i, s, p in (("a", "s", 0), ("b", "s", 0), ("c", None, 1), ("d", None, 3), ("e", None, 0xFFFFF))] + [{"id": "f", "entropy_bits": 1.0}]
    extra = {"fingerprint": "f", "quality": 0.5, "sharpness": 0.5, "exposure": 0.5, "size": 10, "link_count": 1}
    df = _features(spark, rows)
    for c, v in extra.items():
        df = df.withColumn(c, F.lit(v))
    found = detection.detect(df)
    groups = {(r.type, r.group, r.member) for r in found["groups"].collect()}
    assert groups == {("EXACT_DUPLICATE", "a", "a"), ("EXACT_DUPLICATE", "a", "b"), ("NEAR_DUPLICATE", "a", "a"), ("NEAR_DUPLICATE", "a", "c"), ("NEAR_DUPLICATE", "a", "d")}
    assert {(r.type, r.a, r.b) for r in found["evidence"].collect()} == {("EXACT_DUPLICATE", "a", "b"), ("NEAR_DUPLICATE", "a", "c"), ("NEAR_DUPLICATE", "a", "d"), ("NEAR_DUPLICATE", "c", "d")}
    numbers = found["statistics"].first()
    assert (numbers.low_texture_excluded, numbers.exact_copies_collapsed, numbers.budget_limited) == (1, 1, False)
    near = detection.signatures(found["groups"].where("type = 'NEAR_DUPLICATE'").join(df.select("id", "fingerprint"), F.col("member") == F.col("id")), ["type", "group"])
    assert {r.type for r in detection.detect(df, suppressed=near)["groups"].collect()} == {"EXACT_DUPLICATE"}
    more = spark.createDataFrame([("e", "a"), ("f", "a")], "a string, b string")
    assert detection.detect(df, extra=more)["statistics"].first().candidates == numbers.candidates + 1
    labelled = found["pairs"].select("a", "b", "relationship").withColumn("label", F.col("relationship"))
    got = {r.metric: (r.tp, r.fp, r.fn) for r in evaluation.grouped_metrics(evaluation.grouped(labelled, found["groups"])).collect()}
    assert got["near_grouped"] == (3, 0, 0)


def test_time_pairs_respect_tier_and_awareness(spark):
    rows = [("1", "t", True, 0), ("10", "t", True, 5_000_000), ("2", "t", True, 10_000_001), ("3", "t", False, 1), ("4", "u", True, 1), ("5", "t", None, None)]
    got = {(r.a, r.b, r.gap_us) for r in candidates.time_pairs(spark.createDataFrame(rows, "id string, tier string, aware boolean, clock_us long"), 5_000_000).collect()}
    assert got == {("1", "10", 5_000_000)}


def _features(spark, rows):
    base = {"sha256": None, "width": 256, "height": 256, "entropy_bits": 6.0, "contrast_p95_p5": 150.0, "p_hi": 0, "p_lo": 0, "d_hi": 0, "d_lo": 0, "a_hi": 0, "a_lo": 0, "tier": "unknown", "aware": None, "clock_us": None, "filename": "a_1.jpg", "gray": [1.0, 0.0], "chroma": [0.0, 0.0, 0.0]}
    schema = "id string, sha256 string, width int, height int, entropy_bits double, contrast_p95_p5 double, p_hi long, p_lo long, d_hi long, d_lo long, a_hi long, a_lo long, tier string, aware boolean, clock_us long, filename string, gray array<double>, chroma array<double>"
    names = [c.strip().split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schema)


def test_verdicts(spark):
    rows = [
        {"id": "a", "sha256": "s"}, {"id": "b", "sha256": "s"}, {"id": "c", "p_lo": 3}, {"id": "d", "gray": None}, {"id": "e", "entropy_bits": 1.0},
        {"id": "f", "tier": "exif_timezone", "aware": True, "clock_us": 0, "p_lo": 0xFFF, "gray": [0.8, 0.6]}, {"id": "g", "tier": "exif_timezone", "aware": True, "clock_us": 4_000_000},
    ]
    df = _features(spark, rows)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("f", "g")], "a string, b string")
    got = {(r.a, r.b): r for r in evidence.compared(pairs, df).collect()}
    assert got["a", "b"].relationship == "EXACT_DUPLICATE" and got["a", "b"].near_or_exact and not got["a", "b"].near
    assert got["a", "c"].relationship == "NEAR_DUPLICATE" and got["a", "c"].reliability == 0.9
    assert got["a", "d"].relationship is None and got["a", "d"].correlation is None
    assert got["a", "e"].relationship is None and not got["a", "e"].textured
    assert got["f", "g"].relationship == "BURST" and got["f", "g"].reliability == 0.8 and got["f", "g"].gap_s == 4


def test_complete_link_does_not_chain(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "a string, b string")
    groups = {}
    for r in grouping.complete_link(edges).collect():
        groups.setdefault(r.group, set()).add(r.member)
    assert groups == {"a": {"a", "b"}, "x": {"x", "y", "z"}}
    assert grouping.complete_link(edges.limit(0)).count() == 0


def test_blocked_pairs_split_only_their_bucket(spark):
    df = spark.createDataFrame([(i, "s") for i in "abcd"] + [("e", "t"), ("f", "t"), ("g", None), ("h", None)], "id string, sha256 string")
    plain = {(r.id, r.part) for r in grouping.exact_groups(df).collect()}
    assert {i for i, _ in plain} == set("abcdef")
    cut = {r.id: r.part for r in grouping.exact_groups(df, spark.createDataFrame([("a", "b")], "a string, b string")).collect()}
    assert cut == {"a": 0, "c": 0, "d": 0, "e": 0, "f": 0}


def test_representative_and_savings(spark):
    schema = "k string, id string, quality double, width int, height int, sharpness double, exposure double, size long, link_count int"
    df = spark.createDataFrame([("g", "10", 0.5, 10, 10, 0.1, 0.1, 5, 1), ("g", "2", 0.5, 10, 10, 0.1, 0.1, 7, 1), ("g", "3", 0.4, 90, 90, 0.9, 0.9, 9, 2)], schema)
    r = grouping.representatives(df, ["k"]).first()
    assert (r.representative, r.n, r.sharper_than) == ("10", 3, 0)
    assert grouping.reclaimable(df, grouping.representatives(df, ["k"]), ["k"]).first().bytes == 7


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randint(0, 150), pick.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    nodes = spark.range(0, 250).withColumnRenamed("id", "id")
    got = {r.id: r.component for r in graph.labelled(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: top(i) for i in range(250)}


def test_projection_neighbours_find_close_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 64))
    rows = [(f"{c}-{k}", (centres[c] + 0.05 * rng.normal(size=64)).tolist()) for c in range(20) for k in range(3)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    got = {(r.a, r.b) for r in candidates.projection_neighbours(df, cells=2).where(F.col("cosine") > 0.9).collect()}
    expected = {tuple(sorted((f"{c}-{i}", f"{c}-{j}"))) for c in range(20) for i, j in itertools.combinations(range(3), 2)}
    assert len(got & expected) >= 0.95 * len(expected)
    top = candidates.cosine_topk(df.where("id = '0-0'"), df, 2).collect()
    assert {r.id for r in top} == {"0-1", "0-2"}


def test_distributed_components_equal_the_walk(spark, monkeypatch):
    pick = random.Random(5)
    edges = spark.createDataFrame([(str(pick.randint(0, 300)), str(pick.randint(0, 300))) for _ in range(220)], "u string, v string")
    one = {tuple(r) for r in graph.components(edges).collect()}
    monkeypatch.setattr(graph, "SMALL", -1)
    assert {tuple(r) for r in graph.components(edges).collect()} == one


def test_projection_windows_do_not_stop_at_cells(spark):
    """The query's defaults, and many cells, against plain windows of 16 places and the recall of brute force."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    near = [set() for _ in x]
    for line in candidates.projections(64):
        order = np.argsort(unit @ line, kind="stable")
        for k, i in enumerate(order):
            near[i].update(order[max(0, k - 16) : k].tolist() + order[k + 1 : k + 17].tolist())
    top = lambda i, some: sorted(some, key=lambda j: (-cosine[i, j], j))[:16]
    expected = {(f"{min(i, j):03d}", f"{max(i, j):03d}") for i in range(300) for j in top(i, near[i])}
    got = {(r.a, r.b) for r in candidates.projection_neighbours(df).collect()}
    assert got == expected == {(r.a, r.b) for r in candidates.projection_neighbours(df, cells=40).collect()}
    truth = {(f"{min(i, j):03d}", f"{max(i, j):03d}") for i in range(300) for j in top(i, range(300))}
    assert len(got & truth) >= 0.5 * len(truth)


def test_tables_of_blocks_equal_brute_force(spark, monkeypatch):
    """Every way of cutting hashes into blocks, with a key that many share, and without pairs of one content."""
    rows = adversarial(200, 4) + [(f"s{i}", 7 << 20, 1 << (i % 30)) for i in range(40)]
    expected = {(*sorted((a[0], b[0])), popcount(a, b)) for a, b in itertools.combinations(rows, 2) if popcount(a, b) <= 8}
    df = spark.createDataFrame(rows, HASH)
    for blocks, agree, _ in candidates._tables(8):
        monkeypatch.setattr(candidates, "_cheapest", lambda *_, way=(blocks, agree): way)
        assert {tuple(r) for r in candidates.hamming_pairs(df, 8).collect()} == expected
    half = {r[0]: int(r[1] % 2) for r in rows}
    got = {tuple(r) for r in candidates.hamming_pairs(df.withColumn("k", (F.col("p_hi") % 2).cast("string")), 8, unlike="k").collect()}
    assert got == {p for p in expected if half[p[0]] != half[p[1]]}


def test_more_tables_for_more_hashes():
    assert candidates._cheapest(8, 10**4, 1.0) == (9, 1) and candidates._cheapest(8, 10**7, 1.0)[0] > 9 and candidates._cheapest(8, 10**6, 20.0) == (9, 1)
    assert candidates._cheapest(0, 10**6, 1.0)[0] <= 3


def test_a_hash_is_no_row_of_probes(spark):
    """A few numbers a table leave for the executors: 9 rows for each of a few thousand hashes, where probes made 250."""
    pick = random.Random(9)
    df = spark.createDataFrame([(str(i), pick.getrandbits(32), pick.getrandbits(32)) for i in range(3000)], HASH)
    found = plans(spark, lambda: candidates.hamming_pairs(df, 8).collect())
    assert any("MapInArrow" in p for p in found) and not any("SortMergeJoin" in p and "Generate explode" in p for p in found)
