"""Operators against plain versions on small generated corpora."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from halyard.llm import crf, decontamination, exchange, jaccard_join, quality_classifier, quality_rules, substrings, toxicity, warc
from halyard.llm.common import Workspace, fresh_path

WORD = r"[^\x20\x09-\x0D]+"
low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(seed, n=90, size=120):
    """Texts that share passages, and near and exact copies."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "a.", " x"]
    passages = [pick.choices(vocabulary, k=pick.randint(5, 40)) for _ in range(12)]
    out = []
    for i in range(n):
        if out and pick.random() < 0.3:
            ws = pick.choice(out)[1].split(" ")
            for _ in range(pick.randint(0, 4)):
                ws[pick.randrange(len(ws))] = pick.choice(vocabulary)
        else:
            ws = []
            while len(ws) < pick.randint(1, size):
                ws += pick.choice(passages) if pick.random() < 0.3 else pick.choices(vocabulary, k=7)
        out.append((i * 3 - 40, pick.choice([" ", " ", "\n", " \t"]).join(ws) if pick.random() < 0.9 else " ".join(ws)))
    pick.shuffle(out)
    return out


@pytest.mark.parametrize("seed, ways", [(1, 0), (2, 0), (1, 8), (2, 4)])
def test_substring_dedup(spark, monkeypatch, seed, ways):
    if ways:  # more buckets than ways: records go through relays
        monkeypatch.setattr(exchange, "FIRST", ways)
        monkeypatch.setattr(exchange, "WAYS", ways)
        monkeypatch.setattr(exchange, "RELAY_RECORDS", 1500)
        monkeypatch.setattr(substrings, "SLICE_BYTES", 3000)
    rows = corpus(seed)
    words = {i: re.findall(WORD, t) for i, t in rows}
    first = {}
    for i, ws in words.items():
        for k in range(len(ws) - 12):
            w = tuple(ws[k : k + 13])
            first[w] = min(first.get(w, i), i)
    got = {r.doc_id: r for r in substrings.dedupe(spark, spark.createDataFrame(rows, "doc_id long, text string"), digests=True).collect()}
    spans = {r.doc_id: r for r in substrings.dedupe(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - 12):
            if first[tuple(ws[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert spans[i].kept == kept and {k for s in spans[i].repeats for k in range(s.start, s.stop)} == gone


def shingle_set(t):
    ws = re.findall(WORD, low(t))
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(3) + [(900 + i, " ".join(f"Z{k}" if i < 2 else f"z{k}" for k in range(150)) + " " * i) for i in range(4)] + [(1000 + i, " ".join(f"z{k}" if k != i * 3 else "q" for k in range(150))) for i in range(30)]
    sets = {}
    for i, t in sorted(rows):
        sets.setdefault(t, (i, shingle_set(t)))
    links = {}
    for (a, x), (b, y) in itertools.combinations(sets.values(), 2):
        if x and y and len(x & y) / len(x | y) >= 0.8:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    assert sum(map(len, links.values())) > 400

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in jaccard_join.join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (least(sets[t][0]), sets[t][0], len(links.get(sets[t][0], ()))) for i, t in rows}


def test_jaccard_join_of_a_repeated_id(spark):
    """An id with several texts, the smallest of more than one class: each text keeps its own links and class."""
    text = lambda w, k: " ".join(f"{w}{i}" if i != k else "q" for i in range(120))
    rows = [(1, text(w, -1)) for w in "abc"] + [(k + 2, text(w, 60)) for k, w in enumerate("abc")] + [(1, text("d", -1)), (1, text("e", -1)), (9, text("e", -1)), (None, text("b", 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with Workspace(spark, "test") as workspace:
        docs, by_text = jaccard_join.classes(workspace, jaccard_join.identified(df))
        assert docs.count() == len(rows) and by_text.where("least").count() == 5
    got = sorted((r.doc_id or 0, r.class_id, r.copy_id or 0, r.n_copies, r.n_links) for r in jaccard_join.join(spark, df).collect())
    assert got == sorted([(1, 1, 1, 1, 1), (1, 1, 1, 1, 2), (1, 1, 1, 1, 1), (2, 1, 2, 1, 1), (3, 1, 3, 1, 2), (4, 1, 4, 1, 1), (1, 1, 1, 1, 0), (1, 1, 1, 2, 0), (9, 1, 1, 2, 0), (0, 1, 0, 1, 2)])
    kept = corpus_pipeline.one_of_each_group(spark, df, "").collect()
    assert sorted(tuple(r) for r in kept) == sorted((1, text(w, -1)) for w in "abcde")


def test_pruning_keeps_similar_pairs():
    limits = jaccard_join.least_matches()
    assert [n for n, _ in limits] == [32, 64, 96, 128] and limits[-1][1] > 64
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 800).astype(np.uint64)
        a, b = np.append(both, rng.integers(0, 2**63, 90).astype(np.uint64)), np.append(both, rng.integers(0, 2**63, 90).astype(np.uint64))
        sig = np.stack([jaccard_join.signature(a), jaccard_join.signature(b)]).view(np.uint16)
        i, _j = jaccard_join.prune(sig, np.array([0]), np.array([1]), limits)
        kept += len(i)
    assert kept == 300
    sig = rng.integers(0, 2**16, (2, 128)).astype(np.uint16)
    assert not len(jaccard_join.prune(sig, np.array([0]), np.array([1]), limits)[0])


def test_both_ways_of_exact_intersections_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    dense = jaccard_join.similar(sets, i, j, 0.5)
    assert dense.tolist() == [bool(jaccard_join.similar(sets, i[k : k + 1], j[k : k + 1], 0.5)[0]) for k in range(len(i))]


def test_decontamination(spark):
    pick = random.Random(7)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(k, " ".join(pick.choices(vocabulary, k=pick.choice([5, 6, 9, 14, 30, 61, 200])))) for k in range(60)]
    docs = []
    for i in range(150):
        ws = pick.choices(vocabulary, k=pick.choice([3, 40, 400, 3000]))
        for _ in range(pick.randint(0, 2)):
            part = pick.choice(items)[1].upper().split()
            if pick.random() < 0.5 and len(part) > 25:
                part[pick.randrange(len(part))] = "changed"
            at = pick.randint(0, len(ws))
            ws[at:at] = part
        docs.append((i, " ".join(ws)))
    grams = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(WORD, low(t))] for k in range(len(w) - 4)}
    bench = [(k, grams(t)) for k, t in items]
    expected = {(i, k, len(x & g)) for i, t in docs for g in [grams(t)] for k, x in bench if len(x & g) / len(x) >= 0.8}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_shared) for r in decontamination.search(spark, d, b).collect()} == expected and len(expected) > 80
    assert {r.doc_id for r in decontamination.clean(spark, d, b).collect()} == {i for i, _ in docs} - {i for i, *_ in expected}


def test_items_in_pieces():
    """What the docstring of search() says of items whose pieces lie passages apart."""
    pick = random.Random(8)
    items = [" ".join(f"i{k}x{pick.randrange(10**6)}" for _ in range(pick.randint(60, 400))) for k in range(60)]
    index = decontamination.Index([(k, np.unique(decontamination.shingle_row(t))) for k, t in enumerate(items)])
    found = {}
    for pieces in (1, 2, 4, 8):
        hits = 0
        for k, t in enumerate(items):
            ws, out = t.split(), []
            each = -(-len(ws) // pieces)
            for a in range(0, len(ws), each):  # pieces overlap by a shingle, so that no shingle is lost at a cut
                out += [f"f{pick.randrange(10**6)}" for _ in range(1500)] + ws[max(a - 4, 0) : a + each]
            hits += (k, len(index.sets[k])) in index.search(" ".join(out))
        found[pieces] = hits / len(items)
    assert found[1] == 1 and found[2] >= 0.99 and found[4] >= 0.97 and found[8] >= 0.8


def test_item_blocks_change_nothing(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(25)]
    d, b = spark.createDataFrame([(k, "x " + t + " y") for k, t in items], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 9000)
    assert {(r.doc_id, r.item_id) for r in decontamination.search(spark, d, b).collect()} == {(k, k) for k, _ in items}


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}", "" if i % 10 == 0 else f"<p>{i % 7}\r\n\r\nWARC/1.1</p>" * (i % 5 + 1)) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for roll, least in ((2000, 0), (1 << 20, 30)):
        folder = fresh_path(spark, "test-warc")
        manifest = warc.write(spark, df, folder, roll=roll, shards=3, least=least)
        names = [r.name for r in manifest.collect()]
        assert len(set(names)) == len(names) and (len(names) > 5) == (roll == 2000)
        warc._commit(manifest, folder)  # again: nothing happens
        first = {}
        for i, _, h in pages:
            if len(h) >= least:
                first[h] = min(first.get(h, i), i)
        expected = {(i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first.get(h, i) == i else "revisit", None if first.get(h, i) == i else first[h]) for i, _, h in pages}
        assert {tuple(r) for r in warc.read(spark, manifest, folder).collect()} == expected


def test_warc_files_do_not_depend_on_the_layout(spark):
    """The same rows, in any order and number of partitions, give the same bytes; a page that a third of all rows repeat
    and equal rows beyond a run of numbers are dealt to several shards."""
    pick = random.Random(4)
    pages = [(i, f"http://h/{i % 90}", f"<p>{i % 37}</p>" * pick.randint(0, 40)) for i in range(300)]
    pages += [(7, "http://same", "<p>hot</p>")] * 200 + [(None, None, None)] * 3 + [(None, "u", "<p>hot</p>")]
    found = []
    for n, chunk in ((1, 64), (5, 64), (40, 64)):
        pick.shuffle(pages)
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(n)
        old, warc.CHUNK = warc.CHUNK, chunk
        try:
            manifest = warc.write(spark, df, folder := fresh_path(spark, "test-warc"), roll=4000, shards=9)
        finally:
            warc.CHUNK = old
        found.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in manifest.collect()))
        rows = warc.read(spark, manifest, folder).collect()
        assert sorted(str(r.page_id) for r in rows) == sorted(str(i) for i, _, _ in pages)
        assert [(r.page_id, r.record_type) for r in rows if r.payload_bytes == 10 and r.record_type == "response" and r.payload_digest == base64.b32encode(hashlib.sha1(b"<p>hot</p>").digest()).decode()] == [(7, "response")]
    assert found[0] == found[1] == found[2] and len(found[0]) > 9


def plain_rules(t):
    ws = re.findall(WORD, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    grams = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
    again = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(again), len(ws) < 20 or 100 * len(again) > 30 * len(ws)


def test_quality_rules(spark):
    rows = corpus(9, 60) + [(1000, None), (1001, "\n\n"), (1002, "a b c d e f g h\n" * 9), (1003, " ".join(f"x{i}%%%" for i in range(50))), (1004, "THIS IS LOUD!! " * 2 + " ".join(f"UP{i}!!" for i in range(40)))]
    rows += [(2000 + i, "\n".join(" ".join(f"l{i}{k}{j}" for j in range(12)) + "." for k in range(5))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.label(df, quality_rules.fit(df)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(t)
        assert not (r.base_failed and r.kept)
    assert all(got[2000 + i].kept for i in range(40)) and not got[1003].kept


def test_neighbours_decide_on_lines():
    """Two lines that show the same of themselves get the labels of their neighbours."""
    pick = random.Random(5)
    prose = lambda: " ".join(pick.choice(["the", "river", "was", "slow", "and", "old", "boats", "lay", "there"]) for _ in range(12)) + "."
    junk = lambda: " ".join(f"## {pick.choice(['BUY', 'NOW', 'CLICK'])} $$" for _ in range(4))
    docs = ["\n".join([prose() for _ in range(pick.randint(2, 6))] + [junk() for _ in range(pick.randint(0, 5))] + [prose() for _ in range(pick.randint(0, 3))]) for _ in range(300)]
    learnt = []
    for i, d in enumerate(docs):
        t = quality_rules.Text(d)
        learnt.append((i, quality_rules.line_features(t, t.shares()), quality_rules.weak_labels(t, t.shares())))
    model = quality_rules.fit_lines(learnt)

    def middle(lines):
        t = quality_rules.Text("\n".join(lines))
        f = quality_rules.line_features(t, t.shares())
        f[3, :12] = -1  # the line shows nothing
        return crf.viterbi(model, [np.where(f < 0, 0.0, model.weights[f]).sum(1)])[0][3]

    assert middle([prose()] + [junk() for _ in range(5)] + [prose()]) == 1 and middle([prose() for _ in range(7)]) == 0
    # learnt with all features shown, the field returns the rule; some lines hide them, in the same places each time
    f = quality_rules.line_features(t := quality_rules.Text(docs[0]), t.shares())
    assert (quality_rules.hidden(f, 3) == quality_rules.hidden(f, 3)).all() and (f[:, [5, 8, 9]] == quality_rules.hidden(f, 3)[:, [5, 8, 9]]).all()


def test_weak_labels_equal_plain_ones():
    for text in ["a b c\na b c\n\nSOME LOUD LINE here\n" + "x " * 20 + "\nall rights reserved\n# $ % a b c d", "one\n one\ntwo two two two two"]:
        t = quality_rules.Text(text)
        lines = [x for x in text.split("\n") if x.split()]
        expected = []
        for k, x in enumerate(lines):
            ws = x.split()
            n = len(ws)
            share = lambda f: sum(map(f, ws)) / n
            twice = sum(a == b for a, b in zip(ws, ws[1:])) / n
            expected.append(int(share(lambda w: any(c in "#*$%&|<>" for c in w)) >= 0.1 or (share(lambda w: len(w) > 1 and w.isupper()) >= 0.35 and n >= 3) or twice >= 0.4 or (len(set(ws)) / n <= 0.3 and n >= 12) or bool(quality_rules.NOTICE.search(x.encode())) or x in lines[:k]))
        assert quality_rules.weak_labels(t, t.shares()).tolist() == expected


def test_toxic_words_are_learnt_from_counts_and_company():
    pick = random.Random(6)
    plain = [f"plain{i}" for i in range(400)]
    bad = ["nastyone", "vilestuff", "grimword", "foulthing"]
    texts, y = [], []
    for i in range(400):
        ws = pick.choices(plain, k=40)
        if i % 2:
            ws[20:20] = ["utter", pick.choice(bad)]
        else:
            ws.append("utter")
        texts.append(" ".join(ws))
        y.append(i % 2)
    family = toxicity.families(texts)
    assert len(set(family)) == 400 and toxicity.families([texts[0], texts[1], texts[0] + " more"])[0] == toxicity.families([texts[0], texts[1], texts[0] + " more"])[2]
    found = toxicity.lexicon(lambda: ({k for w in set(t.split()) for k in toxicity.keys(w)} for t in texts), y, family)
    # the plain count: features of toxic families only, which often enough
    has = lambda k, label: {f for t, f, v in zip(texts, family, y) if v == label and any(k in toxicity.keys(w) for w in t.split())}
    assert {b"=" + w.encode() for w in bad} <= found
    assert all(len(has(k, 1)) / (len(has(k, 1)) + len(has(k, 0))) >= toxicity.PURITY for k in found)
    number: dict = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in t.split()]) for t in texts]
    table = np.array([toxicity.slots(w, 1 << 16) for w in number])
    is_bad = np.array([any(k in found for k in toxicity.keys(w)) for w in number])
    turn, learnt = np.random.default_rng(1), []
    for d, v in zip(docs, y):
        x = toxicity.features(table, d)
        x[turn.random(len(d)) < toxicity.HIDDEN, : toxicity.OWN] = -1
        learnt.append((x, (is_bad[d] & bool(v)).astype(int)))
    tagger = toxicity.Tagger(crf.fit(learnt, 1 << 16, epochs=8))
    a, b, c = tagger.marginals(["plain1 plain2 utter qwzzk plain3 plain4", "plain1 plain2 plain5 qwzzk plain3 plain4", "so utter"])
    assert a[3] > 20 * b[3] and c.max() < 0.5  # a word that was never seen, by its company
    assert tagger.emissions("plain1 Nastyone").tolist() == pytest.approx([sum(float(tagger.model.weights[i]) for i in f if i >= 0) for f in toxicity.features(np.array([toxicity.slots(w, 1 << 16) for w in ("plain1", "Nastyone")]), np.arange(2))])


def test_crf_equals_enumeration():
    rng = np.random.default_rng(2)
    model = crf.Model(np.zeros(1, np.float32), rng.normal(size=2), rng.normal(size=(2, 2)))
    seqs = [rng.normal(size=n) * 2 for n in (1, 5, 3, 7)]
    p, v = crf.marginals(model, seqs), crf.viterbi(model, seqs)
    for e, m, best in zip(seqs, p, v):
        score = {}
        for y in itertools.product((0, 1), repeat=len(e)):
            score[y] = model.start[y[0]] + sum(e[k] for k in range(len(e)) if y[k]) + sum(model.move[a, b] for a, b in zip(y, y[1:]))
        z = sum(np.exp(s) for s in score.values())
        assert m == pytest.approx([sum(np.exp(s) for y, s in score.items() if y[k]) / z for k in range(len(e))])
        assert tuple(best) == max(score, key=score.get)


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id")
    found = quality_classifier.classify(known, labels).where("held_out").join(labels, "doc_id")
    assert found.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.98
    found = toxicity.score(known, toxicity.fit(known, labels)).where("held_out").join(labels, "doc_id")
    assert found.select(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.97
    row = found.where("predicted = 1").first()
    assert row.n_offending == len(row.offending) > 0


def test_ftrl_equals_the_plain_update():
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 9, 4)), None, int(rng.random() < 0.5)) for _ in range(30)]
    rows = [(i, np.full(len(i), 0.5), y) for i, _, y in rows]
    z, n = [0.0] * 9, [0.0] * 9
    w = lambda k: 0.0 if abs(z[k]) <= 1e-4 else -(z[k] - np.sign(z[k]) * 1e-4) / ((1 + n[k] ** 0.5) / 0.5 + 1e-3)
    for _ in range(2):
        for i, x, y in rows:
            p = 1 / (1 + np.exp(-sum(w(k) * v for k, v in zip(i, x))))
            for k, v, old in [(k, v, w(k)) for k, v in zip(i, x)]:
                g = (p - y) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / 0.5 * old
                n[k] += g * g
    assert quality_classifier.fit_ftrl(rows, 9, epochs=2) == pytest.approx([w(k) for k in range(9)], rel=1e-5)
