"""Operator 5: toxic spans by a linear-chain conditional random field over words.

Labelled tokens come from labelled documents: a word (or a word's beginning) that occurs in toxic documents
far more often than chance allows, counted once per family of near copies, is a toxic token there. The field sees a
word's beginning, end and shape and the words beside it; as it learns, some tokens hide what they are, so that their
neighbours have to tell, and words that it never met are judged by company and form.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import held_out, map_rows, shingles, table
from .quality_classifier import training_sample

#: The most labelled rows that a fit reads, and the dimensions of the hashed features.
TRAIN_ROWS = 4000
DIMENSIONS = 1 << 20
#: Lengths of the word beginnings that are features, beside the whole word, and of its ends.
PREFIXES, SUFFIXES = (4, 5, 6, 7), (3, 4)
#: The share of training tokens that hide their own features.
HIDDEN = 0.3
#: A feature is toxic from this log likelihood ratio and this share of toxic families on.
EVIDENCE, PURITY = 12.0, 0.9
#: A token is an offending one from this marginal on.
OFFENDING = 0.5

WORD = re.compile(r"[^\W_]+")


def keys(word: str) -> list[bytes]:
    return [b"=" + word.encode()] + [b"^" + word[:k].encode() for k in PREFIXES if len(word) >= k]


def _own(word: str) -> list[bytes]:
    """What a word shows of itself: the word, beginnings, ends, and whether it mixes letters with other signs."""
    kind = b"mixed" if any(c.isdigit() for c in word) else b"plain"
    return [*keys(word.lower()), *[b"$" + word[-k:].lower().encode() for k in SUFFIXES if len(word) > k], b"!" + kind]


OWN = 2 + len(PREFIXES) + len(SUFFIXES)


def _slot(key: bytes, dimensions: int) -> int:
    return xxhash.xxh3_64_intdigest(key) % dimensions


def slots(word: str, dimensions: int = DIMENSIONS) -> list[int]:
    """The word's own features (-1: none), then the one by which it speaks for the next word, and for the one before."""
    out = [_slot(k, dimensions) for k in _own(word)]
    beside = word.lower().encode()
    return out + [-1] * (OWN - len(out)) + [_slot(b"<" + beside, dimensions), _slot(b">" + beside, dimensions)]


def features(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Feature indices of a sequence of word numbers (positions x slots, -1: none); table: slots() of each word."""
    out = np.full((len(words), OWN + 2), -1, np.int64)
    out[:, :OWN] = table[words, :OWN]
    out[1:, OWN] = table[words[:-1], OWN]
    out[:-1, OWN + 1] = table[words[1:], OWN + 1]
    return out


def families(texts: list[str]) -> list[int]:
    """Numbers of the groups of near copies: texts that share one of 8 MinHash values of their shingles."""
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, t in enumerate(texts):
        s = shingles(t)
        for k, c in enumerate((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
            j = first.setdefault((k, int((s * np.uint64(c)).min())) if len(s) else "empty", i)
            parent[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


#: Words whose emissions a task keeps.
KNOWN_WORDS = 400_000


@dataclass
class Tagger:
    model: crf.Model
    known: dict = field(default_factory=dict, repr=False)
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 3)), repr=False)

    def _weights(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own emission, to the next word's and to that of the one before."""
        w, s = self.model.weights, slots(word, len(self.model.weights))
        return sum(float(w[i]) for i in s[:OWN] if i >= 0), float(w[s[OWN]]), float(w[s[OWN + 1]])

    def emissions(self, text: str | None) -> np.ndarray:
        ws = WORD.findall(text) if text else []
        if not ws:
            return np.empty(0)
        if len(self.known) >= KNOWN_WORDS:
            self.known, self.table = {}, np.empty((0, 3))
        fresh = sorted({w for w in ws if w not in self.known})  # not set minus keys(), which walks all that is known
        if fresh:
            first = len(self.known)
            self.known.update(zip(fresh, range(first, first + len(fresh))))
            if first + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table[:first], np.empty((first + 2 * len(fresh) + 1024, 3))])
            self.table[first : first + len(fresh)] = [self._weights(w) for w in fresh]
        x = self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))]
        out = x[:, 0].copy()
        out[1:] += x[:-1, 1]
        out[:-1] += x[1:, 2]
        return out

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """The probability of being toxic of each word of each text."""
        return crf.marginals(self.model, [self.emissions(t) for t in texts])


def lexicon(docs, labels: list[int], family: list[int]) -> set[bytes]:
    """Features whose toxic families outnumber what the share of toxic documents would give.

    docs: a function that gives each document's set of features in turn; it is read twice, so that one set is held at a time.
    """
    toxic_families, all_families = {f for f, y in zip(family, labels) if y}, set(family)
    base = min(max(len(toxic_families) / max(len(all_families), 1), 1e-3), 0.5)
    has: dict[bytes, set] = defaultdict(set)
    for found, f, y in zip(docs(), family, labels):
        if y:
            for k in found:
                has[k].add(f)
    least = EVIDENCE / np.log(1 / base)
    has = {k: v for k, v in has.items() if len(v) >= least}
    clean: dict[bytes, set] = {k: set() for k in has}
    for found, f, y in zip(docs(), family, labels):
        if not y:
            for k in found & clean.keys():
                clean[k].add(f)
    out = set()
    for k, v in has.items():
        t, c = len(v), len(v) + len(clean[k] - v)
        q = min(t / c, 1 - 1e-9)
        if q >= PURITY and t * np.log(q / base) + (c - t) * np.log((1 - q) / (1 - base)) >= EVIDENCE:
            out.add(k)
    return out


def fit(documents: DataFrame, labels: DataFrame, mod: int = 5, limit: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> Tagger:
    """Learn on the driver from at most `limit` labelled rows outside the held-out fold, whole texts.

    Ties at the edge of the sample go by a hash of the id, then the id; contradictory labels both count, an id that is
    repeated gives its smallest text. Without labelled rows the tagger knows no toxic word and scores stay near 0.
    """
    rows = sorted(training_sample(documents, labels, "toxic", mod, limit).collect(), key=lambda r: (r.doc_id, r.label, r.text))
    y, family = [r.label for r in rows], families([r.text for r in rows])
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(r.text.lower())], np.int32) for r in rows]
    del rows
    words = list(number)
    toxic = lexicon(lambda: ({k for i in np.unique(d).tolist() for k in keys(words[i])} for d in docs), y, family)
    table = np.array([slots(w, dimensions) for w in words], np.int32).reshape(len(words), OWN + 2)
    bad = np.array([any(k in toxic for k in keys(w)) for w in words], bool)
    turn, sequences = np.random.default_rng(5), []
    for d, label in zip(docs, y):
        if len(d):
            x = features(table, d)
            x[turn.random(len(d)) < HIDDEN, :OWN] = -1
            sequences.append((x.astype(np.int32), (bad[d] & bool(label)).astype(np.int8)))
    model = crf.fit(sequences, dimensions) if sequences else crf.Model(np.zeros(dimensions, np.float32), np.array([0.0, -8.0]), np.array([[0.0, -8.0], [0.0, -8.0]]))
    return Tagger(model)


def score(documents: DataFrame, tagger: Tagger, mod: int = 5) -> DataFrame:
    """doc_id, held_out, score (the largest marginal; 0 without words), predicted, n_offending and the offending
    words' offsets (code points) with their marginals; one row for each row, null and empty texts score 0, an empty table
    gives no rows, texts of any length are scored whole; other columns are not read."""
    sent = documents.sparkSession.sparkContext.broadcast(tagger)

    def scored(rows):
        p = sent.value.marginals(rows["text"])
        best = [float(x.max()) if len(x) else 0.0 for x in p]
        found = []
        for t, x, s in zip(rows["text"], p, best):
            spans = [m.span() for m in WORD.finditer(t)] if s >= OFFENDING else []
            found.append([{"start": spans[i][0], "stop": spans[i][1], "marginal": float(x[i])} for i in np.flatnonzero(x >= OFFENDING)] if spans else [])
        return {"doc_id": rows["doc_id"], "held_out": [held_out(i, mod) for i in rows["doc_id"]], "score": best, "predicted": [int(s >= 0.5) for s in best], "n_offending": [len(x) for x in found], "offending": found}

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, held_out boolean, score double, predicted int, n_offending long, offending array<struct<start:long,stop:long,marginal:double>>")


def op5_toxicity(spark, sf_dir):
    """Null and empty texts score 0, repeated rows score alike, null ids are held out; see fit() and score()."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
