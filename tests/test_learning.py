import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import evaluation, incremental, preferences


def test_cluster_metrics_equal_pair_counts(spark):
    pick = random.Random(1)
    rows = [(str(i), pick.choice(["a", "b", "c", None]), pick.choice(["p", "q", None])) for i in range(60)]
    r = evaluation.clusters(spark.createDataFrame(rows, "id string, truth string, predicted string")).first()
    same = lambda x, y, k: x[k] is not None and x[k] == y[k]
    pairs = [(same(x, y, 1), same(x, y, 2)) for x, y in itertools.combinations(rows, 2)]
    assert (r.tp, r.fp, r.fn) == (sum(a and b for a, b in pairs), sum(b and not a for a, b in pairs), sum(a and not b for a, b in pairs))
    perfect = evaluation.clusters(spark.createDataFrame([(str(i), "t" + str(i % 3), "p" + str(i % 3)) for i in range(9)], "id string, truth string, predicted string")).first()
    assert (perfect.ari, perfect.nmi, perfect.purity) == (1.0, pytest.approx(1.0), 1.0)


def test_binary_has_nulls_for_nothing(spark):
    r = evaluation.binary(spark.createDataFrame([(False, False)], "truth boolean, predicted boolean")).first()
    assert (r.tn, r.precision, r.recall, r.f1, r.fpr) == (1, None, None, None, 0.0)


def test_verdict_metrics_leave_exact_labels_out(spark):
    labels = spark.createDataFrame([("a", "b", "EXACT_DUPLICATE"), ("a", "c", "NEAR_DUPLICATE"), ("a", "d", "UNRELATED")], "a string, b string, label string")
    verdicts = spark.createDataFrame([("a", "b", True, True, False), ("a", "c", False, True, False)], "a string, b string, exact boolean, near boolean, burst boolean")
    got = {r.metric: r for r in evaluation.verdict_metrics(evaluation.scored_pairs(labels, verdicts)).collect()}
    assert (got["near"].tp, got["near"].fp, got["near"].tn) == (1, 0, 1) and got["exact"].tp == 1


def test_graded_metrics_equal_plain(spark):
    pick = random.Random(4)
    rows = [("g", str(i), i + 1, pick.randint(0, 3), pick.random() < 0.3, pick.choice("rs"), pick.choice("mnopq")) for i in range(20)]
    r = evaluation.graded(spark.createDataFrame(rows, "k string, id string, position int, relevance int, favorite boolean, region string, moment string"), ["k"], 5).first()
    rel = [x[3] for x in rows]
    dcg = lambda v: sum((2**x - 1) / np.log2(i + 2) for i, x in enumerate(v[:5]))
    assert r.ndcg == pytest.approx(dcg(rel) / dcg(sorted(rel, reverse=True)))
    signs = [np.sign(a - b) for a, b in itertools.combinations(rel, 2)]
    assert r.kendall_tau_a == pytest.approx(sum(signs) / len(signs))
    assert r.pairwise_accuracy == pytest.approx(sum(s > 0 for s in signs) / sum(s != 0 for s in signs))
    assert r.redundancy == pytest.approx((5 - len({x[6] for x in rows[:5]})) / 5)


def examples(spark, groups=24, seed=0):
    rng = np.random.default_rng(seed)
    w = np.zeros(15)
    w[0], w[3] = 3, -2
    out = []
    for g in range(groups):
        for k in range(6):
            a, b = rng.normal(size=15), rng.normal(size=15)
            side = lambda n, x: (f"{g}-{k}-{n}", "f", x.tolist(), float(rng.random()), float(rng.random()))
            out.append((side("a", a), side("b", b), "a" if (a - b) @ w + rng.normal() * 0.2 > 0 else "b", f"g{g:02d}", "holdout" if g % 4 == 3 else "train", False))
    s = "struct<id:string,fingerprint:string,x:array<double>,score_a:double,score_b:double>"
    return spark.createDataFrame(out, f"a {s}, b {s}, choice string, group string, partition string, repeat boolean")


def test_fit_is_the_optimum_and_symmetric(spark):
    df = examples(spark)
    m = preferences.fit(df, 1.0)
    rows = df.collect()
    d = np.array([(np.array(r.a.x) - np.array(r.b.x)) / np.array(m.scale) for r in rows])
    y = np.array([r.choice == "a" for r in rows], float)
    p = 1 / (1 + np.exp(-d @ np.array(m.weights)))
    assert np.abs(d.T @ (p - y) + np.array(m.weights)).max() < 1e-4
    both = df.select((m.probability("a.x", "b.x") + m.probability("b.x", "a.x")).alias("s")).collect() if False else df.select((m.probability(F.col("a.x"), F.col("b.x")) + m.probability(F.col("b.x"), F.col("a.x"))).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in both)
    with pytest.raises(ValueError):
        preferences.fit(df, 0.0)


def test_training_needs_clean_partitions(spark):
    df = examples(spark)
    found = preferences.train(df)
    assert found["active"] and found["accuracy"]["C"] > 0.8
    assert not preferences.train(df.limit(20).withColumn("partition", F.lit("train")))["active"]
    with pytest.raises(ValueError):
        preferences.train(df.unionByName(df.limit(1).withColumn("partition", F.lit("holdout")).withColumn("group", F.lit("g00"))))


def test_sticky_partitions_and_latest(spark):
    c = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3"), ("z", "4")], "component string, id string")
    ledger = spark.createDataFrame([("1", "train"), ("2", "holdout"), ("3", "train")], "id string, partition string")
    got = {r.component: r.partition for r in preferences.sticky_partitions(c, ledger).collect()}
    assert got["x"] == "holdout" and got["y"] == "train" and got["z"] in ("train", "holdout")
    log = spark.createDataFrame([("p", 1, "a", False), ("p", 2, "b", False), ("p", 3, "c", True)], "key string, sequence int, choice string, undone boolean")
    assert preferences.latest(log, ["key"]).first().choice == "b"


def test_consistency_and_sign_test(spark):
    log = spark.createDataFrame([("k", "a", False, 1), ("k", "a", True, 2), ("k", "b", True, 3), ("j", "a", True, 4)], "pair_key string, winner string, repeat boolean, sequence int")
    r = evaluation.consistency(log).first()
    assert (r.repeated, r.agreement) == (2, 0.5)
    few = spark.createDataFrame([(1.0, 0.0)] * 5, "ours double, theirs double")
    assert evaluation.sign_test(few).first().p is None
    assert evaluation.sign_test(few.union(few)).first().p == pytest.approx(2 / 1024)
    b = evaluation.bootstrap(spark.createDataFrame([(f"g{i}", float(i % 2)) for i in range(200)], "group string, value double"), "group", "value").first()
    assert 0.38 < b.low < 0.5 < b.high < 0.62


def test_incremental_store(spark, tmp_path):
    df = spark.createDataFrame([("1", "f", 1), ("2", "f", 2)], "id string, fingerprint string, v int")
    calls = []
    compute = lambda x: calls.append(1) or x.withColumn("v", F.col("v") * 2)
    one = incremental.memoised(spark, "file://" + str(tmp_path), df, {"a": 1}, compute)
    two = incremental.memoised(spark, "file://" + str(tmp_path), df.orderBy(F.desc("id")), {"a": 1}, compute)
    assert len(calls) == 1 and sorted(one.collect()) == sorted(two.collect())
    incremental.memoised(spark, "file://" + str(tmp_path), df, {"a": 2}, compute)
    assert len(calls) == 2
    assert {r.id for r in incremental.missing(df, df.where("id = '1'"), ["id", "fingerprint"]).collect()} == {"2"}
    with pytest.raises(ValueError):
        incremental.parameter_hash({"x": float("nan")})


def test_feedback_log(spark):
    log = spark.createDataFrame(
        [("p", 1, "save", "a"), ("p", 2, "correct", "b"), ("p", 3, "undo", None), ("q", 1, "save", "a"), ("q", 2, "undo", None), ("r", 1, "save", "a"), ("r", 2, "reset", None), ("r", 3, "save", "tie"), ("s", 1, "save", "a"), ("s", 2, "undo", None), ("s", 3, "save", "b"), ("s", 4, "correct", "a"), ("s", 5, "correct", "b"), ("s", 6, "undo", None)],
        "pair_key string, sequence int, action string, choice string",
    )
    assert {(r.pair_key, r.choice) for r in preferences.feedback_state(log, ["pair_key"]).collect()} == {("p", "a"), ("r", "tie"), ("s", "a")}
    fresh = spark.createDataFrame([("p", "a", False, "g", "g", "train", "train"), ("p", "a", True, "g", "g", "train", "train"), ("q", "a", False, "g", "h", "train", "train"), ("z", "?", False, "g", "g", "train", "train"), ("q", "b", False, "g", "g", "train", "train")], "pair_key string, choice string, repeat boolean, group_a string, group_b string, partition_a string, partition_b string")
    assert {(r.pair_key, r.why) for r in preferences.refused(log, fresh).collect()} == {("p", "judged before"), ("q", "different groups"), ("z", "no such choice")}


def test_pair_strategies(spark):
    """Undecided pairs rise with a model, a random order is fixed and no other than the pool's, seen pairs are not asked again."""
    pick = random.Random(4)
    rows = [(f"c{i % 4}", 1, f"{i:02d}", pick.random(), pick.random(), "g", [pick.gauss(0, 2), pick.gauss(0, 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "context string, base int, id string, score_a double, score_b double, group string, x array<double>")
    model = preferences.Model([0.0, 0.0], [1.0, 1.0], [1.0, -1.0], 1.0)
    pairs = lambda **how: [(r.a, r.b, r.key, r.priority) for r in preferences.candidate_pairs(df, **how).collect()]
    useful, unsure, mixed = pairs(), pairs(strategy="uncertainty", model=model), pairs(strategy="random")
    assert {p[2] for p in useful} == {p[2] for p in unsure} == {p[2] for p in mixed}
    x, plain = {r[2]: r[6] for r in rows}, {p[2]: p[3] for p in useful}
    for a, b, key, priority in unsure:
        u = (x[a][0] - x[b][0]) - (x[a][1] - x[b][1])
        p = 1 / (1 + np.exp(-np.clip(u, -35, 35)))
        assert priority == pytest.approx(plain[key] + 4 * (0.5 - abs(p - 0.5)))
    assert [p[3] for p in unsure] == sorted((p[3] for p in unsure), reverse=True)
    assert mixed == pairs(strategy="random") and [p[2] for p in mixed] != [p[2] for p in useful]
    seen = spark.createDataFrame([(p[2],) for p in useful[:30]] * 2, "key string")
    assert [p[2] for p in pairs(seen=seen)] == [p[2] for p in useful[30:]]
    with pytest.raises(ValueError):
        pairs(strategy="other")


def test_refits_equal_fits_to_the_drawn_groups(spark):
    df = examples(spark, 6).cache()
    dimensions = len(df.first().a.x)
    model = preferences.fit(df, 1.0, dimensions)
    found = preferences.refits(df, 1.0, 3, dimensions)
    assert set(found) == {1, 2, 3}
    for draw, weights in found.items():
        again = df.withColumn("draw", F.lit(draw)).withColumn("w", evaluation.drawn("group", "draw", preferences.SEED)).withColumn("turn", F.explode(F.expr("array_repeat(0, w)")))
        assert weights.tolist() == pytest.approx(preferences.fit(again, 1.0, dimensions).weights, abs=1e-6)
    stable = preferences.sign_stability(df, model, 3)
    assert stable == [np.mean([np.sign(w[i]) == np.sign(model.weights[i]) for w in found.values()]) for i in range(dimensions)]
    assert preferences.sign_stability(df.where("false"), model, 3) == [None] * dimensions
