import pytest
from pyspark.sql import functions as F

from halyard.operators import detection
from halyard.sources import store
from tests.test_candidates import _features


def test_analyses_are_replaced_by_key(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    one, two = (spark.createDataFrame(rows, "id string, q double, analysis string") for rows in ([("a", 0.1, "x"), ("b", 0.2, "x")], [("a", 0.9, "x")]))
    store.save(one, folder, "quality", "analysis", "v1")
    store.save(one, folder, "quality", "analysis", "v2")
    store.save(two, folder, "quality", "analysis", "v1")
    assert [tuple(r) for r in store.load(spark, folder, "quality", "analysis", "v1").collect()] == [("a", 0.9)]
    assert store.load(spark, folder, "quality", "analysis", "v2").count() == 2
    store.save(two.where("false"), folder, "quality", "analysis", "v2")
    assert store.load(spark, folder, "quality", "analysis", "v2").count() == 0
    store.save(one, folder, "feedback", "run", "r")
    for wrong in (("quality", "analysis", "v3"), ("quality", "analysis", "../v1"), ("quality", "analysis", ""), ("odd", "analysis", "v1")):
        with pytest.raises(ValueError):
            store.load(spark, folder, *wrong)
    assert store.clear_derived(spark, folder) == ["quality"] and store.clear_derived(spark, folder) == []
    assert store.load(spark, folder, "feedback", "run", "r").count() == 2
    with pytest.raises(ValueError):
        store.load(spark, folder, "quality", "analysis", "v1")


def test_detection_runs_come_back(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    df = _features(spark, [{"id": "a", "sha256": "s"}, {"id": "b", "sha256": "s"}, {"id": "c", "sha256": "t", "p_lo": 1}])
    df = df.withColumn("quality", F.lit(0.5)).withColumn("sharpness", F.lit(0.5)).withColumn("exposure", F.lit(0.5)).withColumn("size", F.lit(100).cast("long")).withColumn("link_count", F.lit(1)).withColumn("fingerprint", F.concat(F.lit("f"), "id"))
    found = detection.detect(df)
    store.save_detection(found, df, folder, "r1")
    back = store.load_detection(spark, folder, "r1")
    for name, table in found.items():
        kept = back[name].drop("signature")
        assert sorted(map(str, kept.collect())) == sorted(map(str, table.select(kept.columns).collect())) and set(kept.columns) == set(table.columns)
    rows = back["groups"].collect()
    assert [(r.type, r.signature, r.member) for r in rows] == sorted((r.type, r.signature, r.member) for r in rows) and len({r.signature for r in rows}) == 2
    empty = {k: t.where("false") for k, t in found.items()}
    store.save_detection(empty | {"statistics": found["statistics"]}, df, folder, "r2")
    assert store.load_detection(spark, folder, "r2")["groups"].count() == 0 and store.load_detection(spark, folder, "r1")["groups"].count() == len(rows)
    with pytest.raises(ValueError):
        store.load_detection(spark, folder, "r3")
