"""Operator 6 sends no table to the driver, however small the planner takes it for."""

import corpus_pipeline
from halyard.llm import jaccard_join

from tests.plans import broadcasts


def documents(spark):
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(words[: 38 + i % 3] + ([f"x{i // 6}"] if i % 2 else []))) for i in range(60)]
    return spark.createDataFrame(rows + [(100, "alone and far from all the others"), (101, None), (102, "")], "doc_id long, text string")


def test_join_broadcasts_nothing(spark):
    assert not broadcasts(spark, lambda: jaccard_join.join(spark, documents(spark)).collect())


def test_pipeline_stage_broadcasts_nothing(spark):
    assert not broadcasts(spark, lambda: corpus_pipeline.one_of_each_group(spark, documents(spark), "").collect())
