"""The corpus pipeline: classify, join near duplicates, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's rows as Parquet and reads them again. Counted as part of the llm
subpackage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from halyard.llm.common import Workspace, groups_for, table, text_parts, written

#: SQL can't express the trained classifier, so no stage after it has an oracle.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, learnt from the labelled rows among docs: rows that score below its threshold go.

    Null and empty texts have the bias's score, repeated rows the same one, texts of any length are scored whole, an
    empty table stays empty; columns that share a name with the operator's are left as they are.
    """
    sent = spark.sparkContext.broadcast(quality_classifier.fit(docs, table(spark, sf_dir, "labels")))

    def run(batches):
        for part, texts in text_parts(batches):
            yield part.filter(pa.array([s >= quality_classifier.KEEP_FROM for s in quality_classifier.score_texts(texts, sent.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of the documents that chains of links or equal texts join, the one with the smallest id stays.

    Rows without an id stay if no row of their group has one, one for each group. Groups are of texts: rows that repeat
    an id with different texts are different documents, and of a group's texts with its smallest id that of the smallest
    digest stays. Of rows with that id and text the smallest by their other columns stays, so no order of rows matters.
    Null and empty texts are copies of each other; an empty table stays empty; clashing names are left as they are.
    """
    key = ["halyard group key", "halyard text key"]
    with Workspace(spark, "jaccard-stage") as workspace:
        _, by_text = jaccard_join.classes(workspace, jaccard_join.identified(docs))
        first = workspace.result(by_text.where("least").select(F.col("copy_id").alias(key[0]), F.col("digest").alias(key[1])))
    kept = docs.withColumns({key[0]: jaccard_join.known_id(), key[1]: jaccard_join.digest()}).join(first.hint("merge"), key, "left_semi")
    # the shuffle of the join serves the choice too; what has no order, a map, comes from any of the rows that are equal but for it
    sorts = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rest = [F.any_value(F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in sorts]
    one = kept.groupBy(*key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in sorts])).alias("halyard row"), *rest)
    return one.select(*[F.col("halyard row").getField(c).alias(c) if c in sorts else F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows that hold a test item go. Null, empty and short texts hold none and stay, repeated rows go or
    stay together, texts of any length are searched whole, an empty table stays empty, other columns are untouched."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the kinds of personal data stand in their places; n_chars follows the text. No row goes.

    Null texts stay null and keep their n_chars; empty ones stay empty; other columns are untouched.
    """

    def run(batches):
        for part, old in text_parts(batches):
            texts = [pii.redact(t, pii.finder().spans(t)) for t in old]
            at = part.schema.get_field_index("text")
            part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
            if (at := part.schema.get_field_index("n_chars")) >= 0:
                before = part.column(at).to_pylist()
                part = part.set_column(at, part.schema.field(at), pa.array([n if t is None else len(t) for t, n in zip(texts, before)], part.schema.field(at).type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of all documents, with their sequences. A null or empty text is its end token alone, repeated
    rows are packed each, only texts beyond a sequence are cut, an empty table gives none; other columns are not read."""
    return packing.pack(packing.pieces(docs), groups_for(docs, packing.GROUP_BYTES, 1))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("personal data", redacted),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
