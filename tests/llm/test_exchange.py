"""The packed exchange: what a slice sends does not grow with the number of buckets, and a run leaves its result only."""

import os
import random

import numpy as np
import pytest
import zstandard

from halyard.llm import exchange, katz, substrings
from halyard.sources.shared import shared_dir


def a_slice():
    pick = random.Random(1)
    vocabulary = ["".join(pick.choices("abcdefghijklmnop", k=pick.randint(2, 9))) for _ in range(30000)]
    texts = [" ".join(pick.choices(vocabulary, k=300)).encode() + b"\n" for _ in range(1000)]
    return {"slice_id": 5, "doc_ids": list(range(1000)), "sizes": list(map(len, texts)), "texts": zstandard.compress(b"".join(texts))}


def size(rows):
    return len(rows), sum(len(d) for r in rows for d in r["data"])


def test_what_a_slice_sends_is_bounded():
    row, sent = a_slice(), {}
    for buckets in (250, 15_000, 500_000, 50_000_000):
        ways = exchange.digits(buckets)
        assert np.prod(ways) >= buckets and len(ways) <= 3
        s, model = katz._Slice(row, 1000), katz.Model(1000, [katz.Facts(300000 * buckets, 30000, katz.discounts(np.array([0, 9, 5, 3, 2, 1, 1.0])))])
        first, second = katz.Words(ways), katz.Grams(ways, 2, model)
        model.buckets, model.facts[0].scale, model.facts[0].rest = first.buckets, 1.0, 0.1
        words = s.records(1, model, [])[0]
        evaluated = [(np.ones(s.n, np.int64), np.full(s.n, 0.5))]
        anchors = substrings.Anchors(ways)
        sent[buckets] = [size(first.send(5, words)), size(second.send(5, s.records(2, model, evaluated)[0])), size(anchors.send(5, substrings._Slice(row).anchors(13, anchors)[0]))]
    for buckets, found in sent.items():
        for (rows, many), (least_rows, least) in zip(found, sent[250]):
            assert rows <= 1.3 * least_rows and many <= 1.3 * least, (buckets, found, sent[250])


@pytest.mark.parametrize("kind, values", [("key64", [1, 2**63]), ("key48", [5, 2**48 - 1]), ("key40", [0, 2**40 - 1]), ("runs48", [3, 3, 3, 9, 9, 3]), ("small", [0, 7, 2**31]), ("large", [-4, 2**62]), ("real", [0.5, -1e300]), ("flag", [True, False, True]), ("id", [-9, 4, 4, 2**62])])
def test_columns_survive(kind, values):
    x = np.array(values, np.uint64 if kind.startswith(("key", "runs")) else None)
    for y in (x, x[:0]):
        assert exchange.decode(exchange.encode({"c": y}, {"c": kind}), {"c": kind}, len(y))["c"].tolist() == y.tolist()


def test_a_run_leaves_its_result_only(spark):
    df = spark.createDataFrame([(i, f"some words of text {i % 3} and more of them in every one of these rows") for i in range(30)], "doc_id long, text string")
    folder = shared_dir(spark).removeprefix("file:") + "/halyard"
    folder = "/" + folder.lstrip("/")
    names = {t.name for t in spark.catalog.listTables()}
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    katz.train_and_score(spark, df).count()
    substrings.dedupe(spark, df).count()
    assert {t.name for t in spark.catalog.listTables()} == names
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["katz-result", "substrings-result"]
