"""Operator 10: line sequence labelling. Viterbi decoding of a linear-chain conditional random field marks each
line as content or boilerplate; a document stays if enough of its words are content and no base rule refuses it."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import map_rows, table, windows, word_hashes

#: The most documents that a fit reads; scoring has no bound.
TRAIN_ROWS = 3000
#: The least share of words in content lines of a document that stays.
CONTENT_SHARE = 0.5
#: The base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30

SYMBOLS = b"#*$%&|<>"
NOTICE = re.compile(rb"licen[sc]ed? (?:under|by)|\blicen[sc]e\b|copyright|all rights reserved|cookies?\b|terms of (?:use|service)", re.IGNORECASE)
BINS = np.array([0.001, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95])
#: Indices of what a line shows itself: five binned shares, its length, flags, its place in the text, links and punctuation.
OWN = 9 * 5 + 8 + 4 + 4 + 4 + 6
#: And of what each neighbour shows: symbols, capitals, length, how it ends, links, punctuation, or that there is none.
BESIDE = 9 + 9 + 8 + 2 + 4 + 6 + 1
DIMENSIONS = OWN + 2 * BESIDE
SLOTS = 12 + 2 * 6
#: Slots that the weak labels are made of; a line hides them in so large a share of cases as the field learns.
RULED, HIDDEN = (0, 1, 2, 3, 4, 6, 7), 0.4
LINK = re.compile(rb"https?://|www\.|\.(?:com|org|net|html?)\b", re.IGNORECASE)
SIGNS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


class Text:
    """The words of a text by line, and what the base rules count."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        lines = raw.split(b"\n")
        self.by_line = [ws for ws in (x.split() for x in lines) if ws]
        self.lines = [x for x in lines if x.split()]
        self.words = [w for ws in self.by_line for w in ws]
        self.hashes = word_hashes(self.words)
        self.n_words = len(self.words)
        self.word_chars = len(b"".join(self.words).decode("utf-8", "surrogatepass"))
        self.n_symbols = sum(map(raw.count, (bytes([c]) for c in SYMBOLS)))
        seen: set[bytes] = set()
        self.repeated = []
        for x in self.lines:
            self.repeated.append(x in seen)
            seen.add(x)
        self.n_dup_lines = sum(self.repeated)
        self.n_repeat_words = self._repeat_words()

    def _repeat_words(self) -> int:
        found = windows(self.hashes, WINDOW)
        if len(found) < 2:
            return 0
        _, place, count = np.unique(found, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[place] >= 2)
        change = np.zeros(self.n_words + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
        return int((np.cumsum(change[:-1]) > 0).sum())

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED_PERCENT * self.n_words

    def shares(self) -> np.ndarray:
        """For each line: shares of words with symbols, in capitals, with digits, equal to the word before, and of distinct words."""
        out = np.empty((len(self.by_line), 5))
        at = 0
        for i, ws in enumerate(self.by_line):
            n, joined = len(ws), b" ".join(ws)
            h = self.hashes[at : at + n]
            at += n
            symbolic = upper = digits = 0
            if any(c in joined for c in SYMBOLS):
                symbolic = sum(any(c in w for c in SYMBOLS) for w in ws)
            if not joined.islower():
                upper = sum(len(w) > 1 and w.isupper() for w in ws)
            if any(c in joined for c in b"0123456789"):
                digits = sum(any(48 <= c <= 57 for c in w) for w in ws)
            out[i] = symbolic / n, upper / n, digits / n, (h[1:] == h[:-1]).sum() / n, len(np.unique(h)) / n
        return out


def weak_labels(t: Text, shares: np.ndarray) -> np.ndarray:
    """1 (boilerplate) for lines of symbols, capitals, repeated words, notices and lines seen before; else 0."""
    lengths = np.array([len(ws) for ws in t.by_line])
    notices = np.array([bool(NOTICE.search(x)) for x in t.lines])
    return ((shares[:, 0] >= 0.1) | ((shares[:, 1] >= 0.35) & (lengths >= 3)) | (shares[:, 3] >= 0.4) | ((shares[:, 4] <= 0.3) & (lengths >= 12)) | notices | np.array(t.repeated)).astype(np.int64)


def line_features(t: Text, shares: np.ndarray) -> np.ndarray:
    """Feature indices of each line (lines x SLOTS, -1: none): its own, and those of the lines before and after it."""
    n = len(t.by_line)
    lengths = np.array([len(ws) for ws in t.by_line])
    out = np.full((n, SLOTS), -1)
    binned = np.searchsorted(BINS, shares, side="right")
    length = np.searchsorted([2, 4, 8, 16, 32, 64, 128], lengths, side="right")
    ended = np.array([x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in t.lines])
    links = np.minimum(np.array([len(LINK.findall(x)) if b"." in x or b"://" in x else 0 for x in t.lines]), 3)
    signs = np.searchsorted([0.005, 0.02, 0.05, 0.1, 0.2], np.array([(len(x) - len(x.translate(None, SIGNS))) / len(x) for x in t.lines]), side="right")
    for k in range(5):
        out[:, k] = 9 * k + binned[:, k]
    out[:, 5] = 45 + length
    out[:, 6] = np.where(t.repeated, 53, -1)
    out[:, 7] = np.where([bool(NOTICE.search(x)) for x in t.lines], 54, -1)
    out[:, 8] = np.where(ended, 55, 56)
    out[:, 9] = 57 + np.where(np.arange(n) == 0, 0, np.where(np.arange(n) == n - 1, 1, np.where(np.arange(n) < 3, 2, 3)))
    out[:, 10] = 61 + links
    out[:, 11] = 65 + signs
    shown = np.stack([binned[:, 0], 9 + binned[:, 1], 18 + length, 26 + ended, 28 + links, 32 + signs], axis=1)
    for first, slot, mine, other in ((OWN, 12, slice(1, n), slice(0, n - 1)), (OWN + BESIDE, 18, slice(0, n - 1), slice(1, n))):
        out[:, slot] = first + BESIDE - 1
        out[mine, slot : slot + 6] = first + shown[other]
    return out


def hidden(features: np.ndarray, key: int) -> np.ndarray:
    """The features as a line that is learnt from shows them: some lines hide what the weak labels are made of, so that
    the rest, and the neighbours, have to tell. key: the same lines hide it whenever they are read."""
    out = features.copy()
    some = np.random.default_rng(key % (1 << 63)).random(len(out)) < HIDDEN
    out[np.ix_(some, RULED)] = -1
    return out


def fit(documents: DataFrame, limit: int = TRAIN_ROWS) -> crf.Model:
    """Learn from weakly labelled lines of at most `limit` documents, the first by a hash of their id; whole texts.

    Ties go by the id, an id that is repeated gives its smallest text, null texts and rows without an id are not learnt
    from. Without documents the model calls every line content.
    """
    chosen = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def hashed(rows):
        out = {"key": [], "lines": [], "features": [], "labels": []}
        for i, text in zip(rows["doc_id"], rows["text"]):
            t = Text(text)
            if t.lines:
                shares = t.shares()
                f, y = line_features(t, shares), weak_labels(t, shares)
                for name, value in zip(out, (int(i), len(y), f.astype("<i2").tobytes(), y.astype("<i1").tobytes())):
                    out[name].append(value)
        return out

    rows = sorted(map_rows(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), hashed, "key long, lines int, features binary, labels binary").collect())
    if not rows:
        return crf.Model(np.zeros(DIMENSIONS, np.float32), np.array([0.0, -8.0]), np.array([[0.0, -8.0], [0.0, -8.0]]))
    return fit_lines([(r.key, np.frombuffer(r.features, "<i2").astype(np.int64).reshape(r.lines, -1), np.frombuffer(r.labels, "<i1").astype(np.int64)) for r in rows])


def fit_lines(found: list) -> crf.Model:
    """The field of [(key, features, labels)]: each text is learnt from twice, as it is and with lines hidden."""
    return crf.fit([(f, y) for _, f, y in found] + [(hidden(f, key), y) for key, f, y in found], DIMENSIONS, epochs=12, cells=1 << 12)


def label(documents: DataFrame, model: crf.Model) -> DataFrame:
    """The base counts, the share of words in content lines, the boilerplate lines' numbers (among lines with words)
    and the verdict; one row for each row, repeated ones alike, an empty table gives none, other columns are not read. A null
    or empty text, or one without words, fails the base rules; texts of any length are labelled whole."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        m = sent.value
        texts = [Text(t) for t in rows["text"]]
        feats = [line_features(t, t.shares()) if t.lines else np.empty((0, SLOTS), int) for t in texts]
        labels = crf.viterbi(m, [np.where(f < 0, 0.0, m.weights[f]).sum(1) for f in feats])
        out = {k: [] for k in ("content_share", "boilerplate_lines", "kept")}
        for t, y in zip(texts, labels):
            lengths = np.array([len(ws) for ws in t.by_line], int)
            share = float(lengths[y == 0].sum() / t.n_words) if t.n_words else 0.0
            out["content_share"].append(share)
            out["boilerplate_lines"].append(np.flatnonzero(y).tolist())
            out["kept"].append(not t.base_failed and share >= CONTENT_SHARE)
        for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
            out[k] = [getattr(t, k) for t in texts]
        return out | {"doc_id": rows["doc_id"]}

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, boilerplate_lines array<int>")


def op10_quality_rules(spark, sf_dir):
    """Null and empty texts fail the base rules, repeated rows have the same verdict, null ids are kept; see label()."""
    documents = table(spark, sf_dir, "documents")
    return label(documents, fit(documents))
