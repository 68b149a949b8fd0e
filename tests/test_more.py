import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.config import Config
from halyard.operators import detection, embeddings, explanations, hierarchy, pixels, preferences, ranking
from halyard.sources import manifests
from tests.test_candidates import _features
from tests.test_learning import examples


def test_config(tmp_path):
    c = Config()
    assert Config.of({"ranking": {"variant": "A"}}).key() != c.key() == Config.of({}).key()
    (tmp_path / "c.toml").write_text("[events]\ngap_minutes = 30\n[duplicates]\nphash = 4\n")
    assert Config.load(str(tmp_path / "c.toml")).events.gap_minutes == 30
    for bad in ({"events": {"visual_weight": 0.9}}, {"events": {"max_span_hours": 25}}, {"ranking": {"quality": 0.9}}, {"duplicates": {"phash": 65}}, {"quality": {"weights": [1, 0, 0, 0]}}, {"nope": {}}, {"events": {"nope": 1}}, {"ranking": {"cap": float("nan")}}):
        with pytest.raises(ValueError):
            Config.of(bad)


def test_detect(spark):
    rows = [{"id": "a", "sha256": "s"}, {"id": "b", "sha256": "s"}, {"id": "c", "sha256": "t", "p_lo": 1}, {"id": "d", "sha256": "u", "p_hi": 2**32 - 1, "gray": [0.0, 1.0]}, {"id": "e", "sha256": "v", "entropy_bits": 0.0}]
    df = _features(spark, rows).withColumn("quality", F.when(F.col("id") == "b", 0.9).otherwise(0.5)).withColumn("sharpness", F.lit(0.5)).withColumn("exposure", F.lit(0.5)).withColumn("size", F.lit(100).cast("long")).withColumn("link_count", F.lit(1))
    found = detection.detect(df)
    groups = {(r.type, r.member): r.representative for r in found["groups"].collect()}
    assert groups == {("EXACT_DUPLICATE", "a"): "b", ("EXACT_DUPLICATE", "b"): "b", ("NEAR_DUPLICATE", "b"): "b", ("NEAR_DUPLICATE", "c"): "b"}
    assert {(r.type, r.bytes) for r in found["savings"].collect()} == {("EXACT_DUPLICATE", 100), ("NEAR_DUPLICATE", 100)}
    apart = detection.detect(df, blocked=spark.createDataFrame([("b", "c")], "a string, b string"))
    assert {r.type for r in apart["groups"].collect()} == {"EXACT_DUPLICATE"}


def test_manifest_checks(spark, tmp_path):
    photo = lambda i, s, f, **k: {"id": i, "path": i, "split": s, "family": f, **k}
    data = {"photos": [photo("1", "development", "f"), photo("2", "development", "f"), photo("3", "held_out", "g"), photo("4", "held_out", "f", sha256="x")], "pairs": [{"a": "2", "b": "1", "label": "BURST", "split": "development"}, {"a": "1", "b": "3", "label": "ODD", "split": "development"}], "groups": [{"members": ["1", "2"], "label": "NEAR_DUPLICATE", "split": "development"}]}
    (tmp_path / "m.json").write_text(json.dumps(data))
    photos, pairs, groups = manifests.read(spark, "file://" + str(tmp_path / "m.json"))
    found = {(r.kind, r.key) for r in manifests.problems(photos, manifests.expanded(pairs, groups)).collect()}
    assert found == {("family in both splits", "f"), ("no such label", "1|3"), ("pair across splits", "1|3"), ("conflicting labels", "1|2")}


def test_hierarchy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (15, 2)), [[50, 50]]])
    labels = hierarchy.hierarchy(x, 5, 3)
    assert len(set(labels[:20])) == 1 and len(set(labels[20:35])) == 1 and labels[0] != labels[20] and labels[35] == -1
    assert set(hierarchy.hierarchy(rng.normal(0, 0.1, (10, 2)), 8, 2).tolist()) <= {0, -1}
    rows = [(1, f"{i:02d}", i * 10**6, [1.0, float(i > 9)]) for i in range(20)] + [(2, f"b{i}", 0, [1.0, 0.0]) for i in range(6)]
    got = hierarchy.window_clusters(spark.createDataFrame(rows, "w int, id string, clock_us long, vector array<double>"), ["w"], limit=20).collect()
    one = {r.id: r.cluster for r in got if not r.id.startswith("b")}
    assert one["00"] == one["09"] and one["10"] == one["19"]
    assert all(r.skipped for r in hierarchy.window_clusters(spark.createDataFrame(rows, "w int, id string, clock_us long, vector array<double>"), ["w"], limit=3).collect())


def test_encode_isolates_failures(spark):
    good = pixels.scene(1, 16)[..., ::-1]
    image = "struct<height:int,width:int,nChannels:int,data:binary>"
    df = spark.createDataFrame([("a", (16, 16, 3, bytearray(good.tobytes()))), ("b", (-1, -1, -1, bytearray())), ("c", (16, 16, 1, bytearray(bytes(256))))], f"id string, image {image}")

    def load():
        def model(images):
            out = [embeddings.prepared(a, 20, 16, [0.5] * 3, [0.5] * 3).mean((1, 2)) for a in images]
            return [v / np.linalg.norm(v) if v[0] > -0.99 else v * np.nan for v in out]

        return model

    got = {r.id: r for r in embeddings.encode(df, load, 3).collect()}
    assert got["a"].error is None and np.linalg.norm(got["a"].vector) == pytest.approx(1, abs=1e-4)
    assert got["b"].vector is None and got["c"].error == "not finite"


def test_explanations(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0.9, 0.5, 0.9, 0.0, 0.25)], "quality double, sharpness double, exposure double, resolution double, representation double, uniqueness double, sharpness_percentile double")
    r = df.select(explanations.reasons().alias("why"), explanations.weak_points().alias("weak"), explanations.reasons("duplicate").alias("short")).first()
    assert r.why[1] == "Sharpness percentile in this context: 25%" and len(r.why) == 6 and len(r.short) == 4 and len(r.weak) == 2
    assert ranking.Weights().of("burst")[2] == 0


def test_learning_curve(spark):
    got = preferences.learning_curve(examples(spark), sizes=(20, 80, 10**6)).collect()
    assert [r.comparisons for r in got] == [20, 80] and got[1].accuracy > 0.75
