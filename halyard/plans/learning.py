"""Queries on metrics, preferences and incremental state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import evaluation, events, incremental, preferences, ranking
from ..sources import bridge
from .features import A, scored
from .timeline import SEGMENT, _HS, _RANKED, _S, _ranked

ROUND = lambda df, *keep: df.select(*keep, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep])


def _labelled(spark, sf_dir):
    return scored(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")


def binary_metrics(spark, sf_dir):
    """Does technical quality over one half find the documents that are labelled good?"""
    rows = _labelled(spark, sf_dir).select("lang", (F.col("label") == 1).alias("truth"), (F.col("quality") > 0.5).alias("predicted"))
    return ROUND(evaluation.binary(rows, ["lang"]), "lang")


def cluster_metrics(spark, sf_dir):
    """Segments of clocks held against the documents' languages."""
    rows = scored(spark, sf_dir)
    found = rows.join(events.segments(rows).select("id", F.concat("tier", F.lit(":"), "segment_start").alias("predicted")), "id", "left")
    return ROUND(evaluation.clusters(found.select("id", F.when(F.col("lang") != "es", F.col("lang")).alias("truth"), "predicted")))


def assignment_rates(spark, sf_dir):
    rows = scored(spark, sf_dir)
    found = events.assignments(rows, events.segments(rows))
    return ROUND(evaluation.statuses(found, ["confidence"]), "confidence")


def _graded(spark, sf_dir):
    rows = scored(spark, sf_dir)
    order = Window.partitionBy("lang").orderBy(F.desc("quality"), "id")
    return rows.select("lang", "id", F.row_number().over(order).alias("position"), (F.col("doc_id") % 4).cast("int").alias("relevance"), (F.col("doc_id") % 11 == 0).alias("favorite"), F.col("source").alias("region"), F.coalesce("sha256", "id").alias("moment"))


def graded_metrics(spark, sf_dir):
    return ROUND(evaluation.graded(_graded(spark, sf_dir), ["lang"], 10), "lang")


def graded_macro(spark, sf_dir):
    return ROUND(evaluation.macro(evaluation.graded(_graded(spark, sf_dir), ["lang"], 10)))


def pref_features(spark, sf_dir):
    rows = preferences.with_features(_ranked(spark, sf_dir, ranking.Weights()))
    return rows.select("id", *[F.round(F.col("x")[i], 5).alias(n) for i, n in enumerate(preferences.NAMES)])


def _examples(spark, sf_dir):
    """Comparisons of neighbours by id within a language; the sharper one is chosen, now and then not."""
    rows = scored(spark, sf_dir).withColumn("representation", F.lit(0.5)).withColumn("uniqueness", F.lit(0.0))
    rows = preferences.with_features(rows).withColumn("cell", (F.col("doc_id") / 10).cast("int"))
    side = rows.select("cell", "lang", "doc_id", F.struct("id", "fingerprint", "x", F.col("quality").alias("score_a"), F.col("exposure").alias("score_b"), "sharpness").alias("r"))
    pairs = side.select("cell", "lang", "doc_id", F.col("r").alias("a")).join(side.select("cell", "lang", F.col("doc_id").alias("other"), F.col("r").alias("b")), ["cell", "lang"]).where((F.col("other") > F.col("doc_id")) & (F.col("other") <= F.col("doc_id") + 3))
    group = F.concat("cell", F.lit("-"), "lang")
    wins = (F.col("a.sharpness") > F.col("b.sharpness")) != ((F.col("doc_id") + F.col("other")) % 10 == 0)
    return pairs.select("a", "b", F.when((F.col("doc_id") * F.col("other")) % 17 == 0, "tie").when(wins, "a").otherwise("b").alias("choice"), group.alias("group"), texts.holdout(group).alias("partition"), ((F.col("doc_id") + 2 * F.col("other")) % 13 == 0).alias("repeat"), texts.pair_key("a.id", "b.id").alias("pair_key"), (F.col("doc_id") * 100000 + F.col("other")).alias("sequence"))


def pref_accuracy(spark, sf_dir):
    rows = _examples(spark, sf_dir)
    a = evaluation.pair_accuracy(rows, F.col("a.score_a"), F.col("b.score_a"), ["partition"]).withColumnRenamed("accuracy", "accuracy_a")
    b = evaluation.pair_accuracy(rows, F.col("a.score_b"), F.col("b.score_b"), ["partition"]).select("partition", F.col("accuracy").alias("accuracy_b"))
    return ROUND(a.join(b, "partition"), "partition")


def pref_train(spark, sf_dir):
    found = preferences.train(_examples(spark, sf_dir))
    m = found["model"]
    return spark.createDataFrame([(n, round(w, 4), m.alpha, m.regularization, found["active"]) for n, w in zip(preferences.NAMES, m.weights)], "feature string, weight double, alpha double, regularization double, active boolean")


def learning_curve(spark, sf_dir):
    return preferences.learning_curve(_examples(spark, sf_dir))


def sign_test(spark, sf_dir):
    rows = evaluation.decisive(_examples(spark, sf_dir))
    d = lambda s: F.when(F.abs(F.col(f"a.{s}") - F.col(f"b.{s}")) < 1e-10, 0.5).otherwise(((F.col(f"a.{s}") > F.col(f"b.{s}")) == (F.col("choice") == "a")).cast("double"))
    return ROUND(evaluation.sign_test(rows.groupBy("group").agg(F.avg(d("score_a")).alias("ours"), F.avg(d("score_b")).alias("theirs"))))


def group_bootstrap(spark, sf_dir):
    rows = evaluation.decisive(_examples(spark, sf_dir)).withColumn("right", ((F.col("a.score_a") > F.col("b.score_a")) == (F.col("choice") == "a")).cast("double"))
    return ROUND(evaluation.bootstrap(rows, "group", "right"))


def consistency(spark, sf_dir):
    """Each pair is judged twice; the second time every seventh judgement differs."""
    rows = _examples(spark, sf_dir).where("choice <> 'tie'")
    win = F.when(F.col("choice") == "a", F.col("a.id")).otherwise(F.col("b.id"))
    lose = F.when(F.col("choice") == "a", F.col("b.id")).otherwise(F.col("a.id"))
    log = rows.select("pair_key", win.alias("winner"), F.lit(False).alias("repeat"), "sequence").unionByName(rows.select("pair_key", F.when(F.col("sequence") % 7 == 0, lose).otherwise(win).alias("winner"), F.lit(True).alias("repeat"), (F.col("sequence") + 10**12).alias("sequence")))
    return ROUND(evaluation.consistency(log))


def pair_pool(spark, sf_dir):
    rows = scored(spark, sf_dir)
    members = rows.select(F.concat(F.lit("lang:"), "lang").alias("context"), F.lit(1).alias("base"), "id", F.col("quality").alias("score_a"), F.col("exposure").alias("score_b"), F.col("lang").alias("group"))
    copies = rows.where(F.col("sha256").isNotNull()).select(F.concat(F.lit("copy:"), "sha256").alias("context"), F.lit(2).alias("base"), "id", F.col("quality").alias("score_a"), F.col("exposure").alias("score_b"), F.col("lang").alias("group"))
    return preferences.candidate_pairs(members.unionByName(copies)).select("a", "b", "key", F.round("priority", 6).alias("priority"))


def latest_decision(spark, sf_dir):
    """Events as a log of decisions: the last one of each user on each kind counts."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.col("event_id").alias("sequence"), F.when(F.col("event_id") % 3 == 0, "favorite").when(F.col("event_id") % 3 == 1, "keep").otherwise("review").alias("decision"), (F.col("event_id") % 5 == 0).alias("undone"))
    return preferences.latest(log, ["user_id", "event_type"]).select("user_id", "event_type", "sequence", "decision")


def incremental_missing(spark, sf_dir):
    """Two thirds of the rows are stored, some of them with an old fingerprint."""
    rows = bridge.assets(spark, sf_dir).select("id", "doc_id", "fingerprint")
    stored = rows.where("doc_id % 3 <> 0").select("id", F.when(F.col("doc_id") % 19 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return incremental.missing(rows, stored, ["id", "fingerprint"]).select("id", "fingerprint")


def upsert(spark, sf_dir):
    rows = bridge.assets(spark, sf_dir).select("id", "doc_id", F.col("size").alias("value"))
    return incremental.upsert(rows.where("doc_id % 2 = 0").select("id", "value"), rows.where("doc_id % 3 = 0").select("id", (F.col("value") + 1).alias("value")), ["id"])


def sticky_partition(spark, sf_dir):
    rows = bridge.assets(spark, sf_dir)
    components = rows.select(F.coalesce("sha256", "id").alias("component"), "id")
    ledger = rows.where("doc_id % 4 = 0").select("id", F.when(F.col("doc_id") % 8 == 0, "holdout").otherwise("train").alias("partition"))
    return preferences.sticky_partitions(components, ledger)


QUERIES = [binary_metrics, cluster_metrics, assignment_rates, graded_metrics, graded_macro, pref_features, pref_accuracy, pref_train, learning_curve, sign_test, group_bootstrap, consistency, pair_pool, latest_decision, incremental_missing, upsert, sticky_partition]

_R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_GRADED = """, g AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, id) AS position, doc_id % 4 AS relevance, doc_id % 11 = 0 AS favorite, source AS region, coalesce(sha256, id) AS moment FROM scored),
 i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY relevance DESC, id) AS ideal, row_number() OVER (PARTITION BY lang, moment ORDER BY position) AS again FROM g),
 pr AS (SELECT l.lang, count(*) FILTER (WHERE l.relevance > r.relevance) AS ok, count(*) FILTER (WHERE l.relevance < r.relevance) AS bad FROM g l JOIN g r ON l.lang = r.lang AND l.position < r.position GROUP BY l.lang),
 s AS (SELECT lang, count(*) AS n, sum(CASE WHEN position <= 10 THEN (pow(2, relevance) - 1) / log2(position + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, relevance) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg,
  count(*) FILTER (WHERE position <= 10 AND relevance >= 2) AS hits, count(*) FILTER (WHERE relevance >= 2) AS good, count(*) FILTER (WHERE position <= 10 AND favorite) AS loved, count(*) FILTER (WHERE favorite) AS favorites, min(position) FILTER (WHERE position <= 10 AND favorite) AS met,
  count(*) FILTER (WHERE position <= 10) AS shown, count(*) FILTER (WHERE position <= 10 AND again > 1) AS again, count(DISTINCT region) FILTER (WHERE position <= 10 AND relevance >= 2) AS covered, count(DISTINCT region) FILTER (WHERE relevance >= 2) AS regions FROM i GROUP BY lang),
 m AS (SELECT lang, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg, hits / 10 AS precision_at_k, coalesce(hits / nullif(good, 0), 0) AS recall_at_k, coalesce(loved / nullif(favorites, 0), 0) AS favorite_recall, coalesce(1 / met, 0) AS mrr, coalesce(ok / nullif(ok + bad, 0), 1) AS pairwise_accuracy, (ok - bad) / nullif(n * (n - 1) / 2, 0) AS kendall_tau_a, coalesce(again / nullif(shown, 0), 0) AS redundancy, coalesce(covered / nullif(regions, 0), 1) AS coverage FROM s LEFT JOIN pr USING (lang))"""
_GM = ("ndcg", "precision_at_k", "recall_at_k", "favorite_recall", "mrr", "pairwise_accuracy", "kendall_tau_a", "redundancy", "coverage")
_EX = """, x AS (SELECT *, doc_id // 10 AS cell FROM scored), p AS (SELECT a.id AS ida, b.id AS idb, a.quality AS aa, b.quality AS ba, a.exposure AS ab, b.exposure AS bb, a.sharpness AS sa, b.sharpness AS sb, a.doc_id AS i, b.doc_id AS j, a.cell || '-' || a.lang AS grp FROM x a JOIN x b ON a.cell = b.cell AND a.lang = b.lang AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 3),
 ex AS (SELECT *, CASE WHEN (i * j) % 17 = 0 THEN 'tie' WHEN (sa > sb) <> ((i + j) % 10 = 0) THEN 'a' ELSE 'b' END AS choice, (i + 2 * j) % 13 = 0 AS rep, CASE WHEN CAST('0x' || substr(sha256('170406:' || grp), 1, 8) AS BIGINT) % 5 = 0 THEN 'holdout' ELSE 'train' END AS partition, i * 100000 + j AS sequence FROM p),
 dec AS (SELECT *, CASE WHEN abs(aa - ba) < 1e-10 THEN 0.5 ELSE CAST((aa > ba) = (choice = 'a') AS INT) END AS va, CASE WHEN abs(ab - bb) < 1e-10 THEN 0.5 ELSE CAST((ab > bb) = (choice = 'a') AS INT) END AS vb FROM ex WHERE choice <> 'tie' AND NOT rep)"""
_FEATURES = [f"round({e}, 5) AS {n}" for n, e in zip(preferences.NAMES, ("sharpness", "exposure", "contrast", "resolution", "clipping", "entropy_bits / 8", "noise / 255", "colorfulness / 255", "quality", "CASE WHEN width >= height THEN 1.0::DOUBLE ELSE 0 END", "ln(CAST(width AS DOUBLE) / height)", "representation", "uniqueness", "1 - uniqueness", "mean_luminance"))]
ORACLES = {
    "binary_metrics": A + ", l AS (SELECT lang, labels.quality = 1 AS t, scored.quality > 0.5 AS p FROM scored JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM l GROUP BY lang) SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(tp + fn, 0), 6) AS fnr FROM c",
    "cluster_metrics": _S + """, b AS (SELECT s.id, CASE WHEN lang <> 'es' THEN lang END AS truth, CASE WHEN g.segment_start IS NOT NULL THEN s.tier || ':' || g.segment_start END AS predicted FROM scored s LEFT JOIN seg g USING (id)),
 n AS (SELECT *, coalesce(truth, 'noise:' || id) AS t, coalesce(predicted, 'unassigned:' || id) AS p FROM b), q AS (SELECT count(*) FILTER (WHERE l.t = r.t AND l.p = r.p) AS tp, count(*) FILTER (WHERE l.t <> r.t AND l.p = r.p) AS fp, count(*) FILTER (WHERE l.t = r.t AND l.p <> r.p) AS fn, count(*) AS pairs FROM n l JOIN n r ON l.id < r.id),
 c AS (SELECT t, p, count(*) AS k FROM n GROUP BY t, p), ct AS (SELECT t, sum(k) AS kt FROM c GROUP BY t), cp AS (SELECT p, sum(k) AS kp, max(k) AS mx FROM c GROUP BY p), tot AS (SELECT sum(k)::DOUBLE AS nn FROM c),
 h AS (SELECT (SELECT -sum(kt / nn * ln(kt / nn)) FROM ct, tot) AS ht, (SELECT -sum(kp / nn * ln(kp / nn)) FROM cp, tot) AS hp, (SELECT sum(k / nn * ln(k * nn / (kt * kp))) FROM c JOIN ct USING (t) JOIN cp USING (p), tot) AS mi, (SELECT sum(mx) / any_value(nn) FROM cp, tot) AS pu)
 SELECT round((tp - (tp + fn)::DOUBLE * (tp + fp) / pairs) / ((2 * tp + fp + fn) / 2 - (tp + fn)::DOUBLE * (tp + fp) / pairs), 6) AS ari, round(mi / ((ht + hp) / 2), 6) AS nmi, round(pu, 6) AS purity, tp, fp, fn, round(tp / (tp + fp), 6) AS pairwise_precision, round(tp / (tp + fn), 6) AS pairwise_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS pairwise_f1 FROM q, h""",
    "assignment_rates": _S + ", a AS (SELECT CASE s.tier WHEN 'exif_timezone' THEN 'high' WHEN 'exif_naive' THEN 'medium' WHEN 'filesystem' THEN 'low' ELSE 'none' END AS confidence, g.segment_start IS NULL AS u, g.segment_start IS NOT NULL AND s.tier <> 'exif_timezone' AS l FROM scored s LEFT JOIN seg g USING (id)) SELECT confidence, count(*) AS n, round(avg(CAST(u AS INT)), 6) AS unassigned_rate, round(avg(CAST(l AS INT)), 6) AS low_confidence_rate FROM a GROUP BY confidence",
    "graded_metrics": A + _GRADED + " SELECT lang, " + _R6(*_GM) + " FROM m",
    "graded_macro": A + _GRADED + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _GM) + " FROM m",
    "pref_features": _HS + _RANKED + " SELECT id, " + ", ".join(_FEATURES) + " FROM ctx",
    "pref_accuracy": A + _EX + " SELECT partition, count(*) AS n, round(avg(va), 6) AS accuracy_a, round(avg(vb), 6) AS accuracy_b FROM dec GROUP BY partition",
    "sign_test": A + _EX + ", d AS (SELECT avg(va) - avg(vb) AS d FROM dec GROUP BY grp), c AS (SELECT count(*) FILTER (WHERE d > 1e-9) AS wins, count(*) FILTER (WHERE d < -1e-9) AS losses, count(*) FILTER (WHERE abs(d) <= 1e-9) AS ties FROM d), lf AS (SELECT *, wins + losses AS n FROM c) SELECT wins, losses, ties, CASE WHEN n >= 6 THEN round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM (SELECT unnest(range(least(wins, losses) + 1)) AS k))), 6) END AS p FROM lf",
    "consistency": A + _EX + " SELECT count(*) AS repeated, round(avg(CAST(sequence % 7 <> 0 AS INT)), 6) AS agreement FROM ex WHERE choice <> 'tie'",
    "pair_pool": A + """, m AS (SELECT 'lang:' || lang AS context, 1 AS base, id, quality AS qa, exposure AS qb, lang AS grp FROM scored UNION ALL SELECT 'copy:' || sha256, 2, id, quality, exposure, lang FROM scored WHERE sha256 IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY qb, id) AS place, count(*) OVER (PARTITION BY context) AS n FROM m), q AS (SELECT least(l.id, r.id) AS a, greatest(l.id, r.id) AS b, max(l.base + CASE WHEN (l.qa - r.qa) * (l.qb - r.qb) < 0 THEN 1 ELSE 0 END + (1 - abs(l.qb - r.qb))) AS priority FROM o l JOIN o r ON l.context = r.context AND l.place < r.place AND (r.place - l.place <= 3 OR l.n <= 12) AND l.grp = r.grp GROUP BY 1, 2)
 SELECT a, b, a || '|' || b AS key, round(priority, 6) AS priority FROM q ORDER BY q.priority DESC, key LIMIT 2000""",
    "latest_decision": "SELECT user_id, event_type, max(event_id) AS sequence, arg_max(CASE event_id % 3 WHEN 0 THEN 'favorite' WHEN 1 THEN 'keep' ELSE 'review' END, event_id) AS decision FROM events WHERE event_id % 5 <> 0 GROUP BY user_id, event_type",
    "incremental_missing": A + " SELECT id, fingerprint FROM asset WHERE doc_id % 3 = 0 OR doc_id % 19 = 0",
    "upsert": A + " SELECT id, CASE WHEN doc_id % 3 = 0 THEN size + 1 ELSE size END AS value FROM asset WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "sticky_partition": A + ", g AS (SELECT coalesce(sha256, id) AS component, sha256(string_agg(id, '|' ORDER BY id)) AS \"group\", bool_or(doc_id % 8 = 0) AS held, bool_or(doc_id % 4 = 0) AS old FROM asset GROUP BY 1) SELECT component, \"group\", CASE WHEN held THEN 'holdout' WHEN old THEN 'train' WHEN CAST('0x' || substr(sha256('170406:' || \"group\"), 1, 8) AS BIGINT) % 5 = 0 THEN 'holdout' ELSE 'train' END AS partition FROM g",
}
