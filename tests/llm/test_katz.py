import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from halyard.llm import exchange, katz
from halyard.llm.common import Workspace, held_out


def plain(rows, order):
    """The model in dictionaries."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "</>"]) for i, t in rows]
    train = [w for i, w in docs if not held_out(i, 10)]
    counts = [Counter() for _ in range(order + 1)]
    for ws in train:
        for k, w in enumerate(ws):
            for n in range(1, order + 1):
                counts[n][(*((["<s>"] * (n - 1) + ws[:k])[k:]), w)] += 1
    total, types = sum(counts[1].values()), len(counts[1])
    d, of = [None], [None]
    for n in range(1, order + 1):
        c = Counter(counts[n].values())
        d.append(katz.discounts(np.array([0] + [c[r] for r in range(1, katz.CUTOFF + 2)], float)))
    star = lambda n, r: d[n][min(r, katz.CUTOFF + 1)] * r
    unknown = 1 - sum(star(1, r) for r in counts[1].values()) / total if total else 1.0
    scale = 1.0
    if total and unknown < 1 / (total + 1):
        scale, unknown = (1 - 1 / (total + 1)) / (1 - unknown), 1 / (total + 1)
    followers = [defaultdict(dict) for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, r in counts[n].items():
            followers[n][g[:-1]][g[-1]] = r

    def prob(h, w):
        n = len(h) + 1
        if n == 1:
            r = counts[1][(w,)]
            return star(1, r) / total * scale if r else unknown
        f = followers[n].get(h)
        if not f:
            return prob(h[1:], w)
        c = sum(f.values())
        if w in f:
            return star(n, f[w]) / c
        return (1 - sum(star(n, r) for r in f.values()) / c) / (1 - sum(prob(h[1:], x) for x in f)) * prob(h[1:], w)

    out = []
    for i, ws in docs:
        score = sum(math.log10(prob(tuple((["<s>"] * (order - 1) + ws[:k])[k:]), w)) for k, w in enumerate(ws))
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (total + 0.1 * (types + 1))) for w in ws)
        out.append((i, len(ws), sum(counts[1][(w,)] > 0 for w in ws), total, base, score))
    norm = [sum(prob((h,), w) for w in [x[0] for x in counts[1]] + ["unseen"]) for h in list({x[0] for x in counts[1]})[:20] + ["<s>"]] if order > 1 else []
    return out, norm


@pytest.mark.parametrize("order, ways", [(1, 0), (2, 0), (3, 0), (2, 8), (3, 4)])
def test_scores_equal_the_plain_model(spark, monkeypatch, order, ways):
    pick = random.Random(order)
    vocabulary = [f"w{k}" for k in range(60)] + ["A", "é", "A"]
    rows = [(i, " ".join(pick.choices(vocabulary, weights=[1 / (k + 1) for k in range(63)], k=pick.randint(0, 40)))) for i in range(250)]
    rows += [(7, "new words Here"), (7, "new words Here"), (300, None), (301, ""), (302, "w1 w2 " * 3000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    if ways:  # more buckets than ways: records go through relays
        monkeypatch.setattr(exchange, "FIRST", ways)
        monkeypatch.setattr(exchange, "WAYS", ways)
        monkeypatch.setattr(exchange, "RELAY_RECORDS", 700)
        monkeypatch.setattr(katz, "SLICE_BYTES", 2000)
    with Workspace(spark, "test") as workspace:
        scores, tables, model = katz.fit_and_score(workspace, df, order)
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scores.collect())
        assert len(tables) == order and all(t.where("kind = 'model'").count() for t in tables)
    expected, norm = plain(rows, order)
    assert len(got) == len(rows)
    for a, b in zip(got, sorted(expected)):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert norm == pytest.approx([1.0] * len(norm), abs=1e-9)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert katz.train_and_score(spark, spark.createDataFrame([], schema)).count() == 0
    only = katz.train_and_score(spark, spark.createDataFrame([(None, "a b")], schema)).first()
    assert (only.train_tokens, only.base_score, only.score, only.held_out) == (0, 0.0, 0.0, True)
