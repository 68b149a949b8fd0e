import csv
import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import measures, preferences, ranking
from halyard.sources import exports

SCHEMA = "k string, id string, quality double, sharpness double, exposure double, resolution double, clipping double, p_hi long, p_lo long, clock_us long, groups array<string>"


def rows(spark, n=30, seed=2):
    pick = random.Random(seed)
    data = [(pick.choice("xy"), str(i), pick.random(), pick.random(), pick.random(), pick.random(), pick.random(), pick.getrandbits(32), pick.getrandbits(32), pick.choice([None, pick.randint(0, 10**10)]), [f"g{i % 11}"] if i % 3 == 0 else []) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def test_contexts_weigh_differently(spark):
    df = ranking.features(rows(spark), ["k"])
    a = ranking.rank(df, ["k"], "event", ranking.Weights("A")).collect()
    assert all(r.score == pytest.approx(r.quality) for r in a)
    for r in ranking.rank(df, ["k"], "burst").collect():
        assert r.score == pytest.approx(0.7 * r.quality + 0.3 * r.representation)


def test_order_does_not_depend_on_partitions(spark):
    df = rows(spark, 60)
    one = {(r.id, r.raw_rank) for r in ranking.rank(ranking.features(df, ["k"]), ["k"]).collect()}
    two = {(r.id, r.raw_rank) for r in ranking.rank(ranking.features(df.repartition(7, F.rand(1)), ["k"]), ["k"]).collect()}
    assert one == two


def test_uniqueness_uses_spread_peers(spark):
    n = 100
    data = [("x", f"{i:03d}", 0.5, 0.5, 0.5, 0.5, 0.0, i * 1000003 % 2**32, i * 7919 % 2**32, 0, []) for i in range(n)]
    df = ranking.features(spark.createDataFrame(data, SCHEMA), ["k"])
    got = {r.id: r.raw_uniqueness for r in ranking.uniqueness(df, ["k"], ranking.Weights(cap=9.0)).collect()}
    f = {r.id: np.array(r.f) for r in df.collect()}
    peers = [f"{i:03d}" for i in np.unique(np.linspace(0, n - 1, 33).astype(int))]
    for i in f:
        assert got[i] == pytest.approx(max(0, 1 - max(f[p] @ f[i] for p in peers if p != i)), abs=1e-9)


def test_shortlist_suppresses_groups_and_library_choice_agrees(spark):
    df = ranking.coverage_bins(ranking.rank(ranking.features(rows(spark, 40), ["k"]), ["k"]), ["k"])
    got = ranking.shortlist(df, ["k"], 8).collect()
    groups = {r.id: r.groups for r in df.collect()}
    for k in "xy":
        used = [g for r in got if r.k == k for g in groups[r.id]]
        assert len(used) == len(set(used))
    one = df.where("k = 'x'")
    few = {(r.rank, r.id) for r in ranking.shortlist(one, ["k"], 6).collect()}
    assert few == {(r.rank, r.id) for r in ranking.best(one, 6).collect()}
    assert few == {(r.rank, r.id) for r in ranking.best(one, 6, most=0).collect()} == {(r.rank, r.id) for r in ranking.best(one, 6, most=7).collect()}
    with pytest.raises(ValueError):
        ranking.shortlist(df, ["k"], 101)


def test_quality_and_warnings(spark):
    df = spark.createDataFrame([(500.0, 0.5, 255.0, 0.1, 0.3, 4000, 3000), (10.0, 0.0, 10.0, 0.9, 0.0, 100, 100)], "laplacian_variance double, mean_luminance double, contrast_p95_p5 double, underexposed double, overexposed double, width int, height int")
    got = measures.scored(df).select("quality", measures.warnings().alias("w")).collect()
    assert got[0].quality == pytest.approx(0.4 * 0.5 + 0.25 + 0.2 + 0.15) and got[0].w == ["overexposed"]
    assert got[1].w == ["low_sharpness", "underexposed", "low_resolution"]
    with pytest.raises(Exception, match="quality"):
        spark.createDataFrame([(1.5,)], "quality double").select(measures.checked_quality()).collect()


def test_csv_guard(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1, "a", ["+x"]), ("/p", 2, None, [])], "source_path string, rank int, event string, explanation array<string>")
    path = str(tmp_path / "out")
    exports.export(df, path, "csv")
    found = [r for f in glob.glob(path + "/*.csv") for r in csv.DictReader(open(f))]
    assert {r["source_path"] for r in found} == {"'=1+1", "/p"} and {r["event"] for r in found} == {"a", "Unassigned"}
    with pytest.raises(ValueError):
        exports.export(df, path, "xml")


def test_rows_without_a_clock_have_no_region(spark):
    df = spark.createDataFrame([("x", "a", 0), ("x", "b", 10**9), ("x", "c", None), ("y", "d", None)], "k string, id string, clock_us long")
    assert {r.id: r.region for r in ranking.coverage_bins(df, ["k"]).collect()} == {"a": "0", "b": "3", "c": "unknown", "d": "unknown"}


def test_personal_short_lists(spark):
    """A learnt score that likes poor rows takes the place of the generic one; without an active model, or with a row
    that has no features, nothing changes."""
    df = ranking.coverage_bins(ranking.rank(ranking.features(rows(spark, 40), ["k"]), ["k"]), ["k"]).withColumn("x", F.array("quality"))
    model = preferences.Model([0.0], [1.0], [-5.0], 1.0, 0.25)
    listed = lambda found: sorted((r.k, r.rank, r.id) for r in found.collect())
    generic, own = listed(ranking.shortlist(df, ["k"], 6)), listed(preferences.personal_shortlist(df, {"active": True, "model": model}, ["k"], 6))
    assert own != generic
    plain = []
    for k in "xy":
        some = [r.asDict() for r in df.where(F.col("k") == k).collect()]
        for r in some:
            r["score"] = 0.25 * r["score"] + 0.75 / (1 + np.exp(5 * r["quality"]))
        some.sort(key=lambda r: (-r["score"], r["id"]))
        for place, r in enumerate(some):
            r["raw_rank"] = place + 1
        plain += [(k, *p[:2]) for p in ranking.pick(some, 6, ranking.Weights())]
    assert own == sorted(plain)
    assert listed(preferences.personal_shortlist(df, {"active": False}, ["k"], 6)) == generic
    gap = df.withColumn("x", F.when(F.col("raw_rank") > 1, F.col("x")))
    assert listed(preferences.personal_shortlist(gap, {"active": True, "model": model}, ["k"], 6)) == generic
