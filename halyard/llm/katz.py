"""Operator 1: a Katz backoff language model.

Slices of documents send their distinct n-grams to buckets by history (the commonest histories are split by word), and
get back counts and what the backoff weights need. Counts, and per history the terms of its weight, are stored in
tables partitioned by order. Probabilities are evaluated order by order, from single words up, for every token.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, Workspace, groups_for, held_out, held_out_column, mix, order_of, span_hashes, table, word_spans
from .exchange import LOW48, ROW, Round, batch, decode, digits, encode, relay_tasks, rows, runs, spread, stored_slices

ORDER = 2
#: Counts up to this one are discounted by Good-Turing; larger ones give up this share.
CUTOFF, LARGE = 5, 1e-3
FOLD = 10
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20

END = U64(xxhash.xxh3_64_intdigest(b""))
START = U64(0x5354415254)
#: Words are told apart by 40 bits within a history of a bucket.
LOW40 = U64((1 << 40) - 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 0 to CUTOFF from the count of counts n[0..CUTOFF + 1], and LARGE's for all above.

    Good-Turing with the largest cutoff at which all factors lie between 0 and 1; absolute discounting if there is none.
    """
    out = np.full(CUTOFF + 2, 1 - LARGE)
    out[0] = 0
    for k in range(CUTOFF, 0, -1):
        r = np.arange(1, k + 1)
        if not n[1 : k + 2].all():
            continue
        a = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - a) / (1 - a) if a < 1 else np.zeros(k)
        if ((d > 0) & (d < 1)).all():
            out[1 : k + 1] = d
            return out
    d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out[1 : CUTOFF + 1] = 1 - d / np.arange(1, CUTOFF + 1)
    return out


@dataclass
class Facts:
    """What a level's counts say about the whole corpus."""

    tokens: int
    types: int
    discount: np.ndarray

    def times(self, r: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        return self.discount[np.minimum(r, CUTOFF + 1)] * r


@dataclass
class Model:
    """What every task knows: the training documents, facts by level, buckets."""

    documents: int
    facts: list
    buckets: int = 0

    def unknown(self) -> float:
        """The probability of all words that training never saw, as one word."""
        one = self.facts[0]
        return max(one.rest, 1 / (one.tokens + 1.0)) if one.tokens else 1.0

    def single(self, r: np.ndarray) -> np.ndarray:
        """Probabilities of single words with the counts r."""
        one = self.facts[0]
        p = np.where(r > 0, one.times(r) / max(one.tokens, 1), 1.0) * one.scale
        p[r == 0] = self.unknown()
        return p


class Words(Round):
    """Records: a word and its count. Answer: its count in all training documents."""

    spec = {"word": "key64", "count": "small"}
    answer_spec = {"count": "small"}
    ticket_spec: dict = {}
    routed = "word"
    level = 1

    def merge(self, columns, hop):
        order = order_of(columns["bucket"], columns["word"])
        bucket, word = columns["bucket"][order], columns["word"][order]
        start = np.append(0, np.flatnonzero((word[1:] != word[:-1]) | (bucket[1:] != bucket[:-1])) + 1)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        return {"bucket": bucket[start], "word": word[start], "count": np.add.reduceat(columns["count"][order], start)}, inverse, {}

    def settle(self, merged, place):
        known = merged["count"] > 0
        count = merged["count"][known]
        model = {"kind": "model", "place": place, "n": len(count), "data": encode({"word": merged["word"][known], "count": count}, {"word": "key64", "count": "small"})}
        return {"count": merged["count"]}, [model, _facts_row(count)]


def _facts_row(count: np.ndarray) -> dict:
    of = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)
    return {"kind": "facts", "facts": [int(count.sum()), len(count), *of[1 : CUTOFF + 2].tolist()]}


#: A bucket's part of a level's tables: its histories, how many followers each has, what its weight needs; then the followers.
MODEL_SPEC = {"histories": "key48", "sizes": "small", "terms": CUTOFF + 2, "words": "key40", "counts": "small"}


class Grams(Round):
    """Records: a history and a word, the count, the word's count (level 2) or probability (above it) at the level below,
    and whether the source wants the history's terms (at the first record of the history's run). A record with word 0
    and count 0 only asks for terms. Answer: the count, and for each asking record its history's terms.

    Discounts are not known yet, so the terms are sums that they turn into its weight: the followers' counts by value
    up to CUTOFF and above, and the followers' probabilities at the level below.
    """

    answer_spec = {"count": "small", "terms": CUTOFF + 2}
    ticket_spec = {"asked": "flag", "which": "small"}

    def __init__(self, ways: list[int], level: int, below: Model):
        super().__init__(ways)
        self.level, self.below = level, below
        self.spec = {"history": "runs48", "word": "key40", "count": "small", "lower": "small" if level == 2 else "real", "asked": "flag"}

    def merge(self, columns, hop):
        order = order_of(columns["bucket"], columns["history"], columns["word"])
        bucket, history, word = (columns[c][order] for c in ("bucket", "history", "word"))
        new = np.append(True, (history[1:] != history[:-1]) | (bucket[1:] != bucket[:-1]))
        start = np.flatnonzero(new | np.append(True, word[1:] != word[:-1]))
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        head = np.flatnonzero(new[start])  # first merged record of each history's run
        run = np.cumsum(new[start]) - 1
        wanted = np.zeros(len(head), bool)
        wanted[run[inverse[columns["asked"]]]] = True
        asked = np.zeros(len(start), bool)
        asked[head[wanted]] = True
        lower = np.maximum.reduceat(columns["lower"][order], start)  # equal but for records that only ask
        merged = {"bucket": bucket[start], "history": history[start], "word": word[start], "count": np.add.reduceat(columns["count"][order], start), "lower": lower, "asked": asked}
        return merged, inverse, {"asked": columns["asked"], "which": np.where(columns["asked"], (np.cumsum(asked) - 1)[inverse], 0)}

    def settle(self, merged, place):
        known = merged["count"] > 0
        h, count, lower = merged["history"][known], merged["count"][known], merged["lower"][known]
        if self.level == 2:
            lower = self.below.single(lower)
        first = runs(h)
        followers = np.diff(np.append(first, len(h)))
        of = np.repeat(np.arange(len(first)), followers)
        terms = np.stack([np.bincount(of, (count == r) * r, len(first)) for r in range(1, CUTOFF + 1)] + [np.bincount(of, np.where(count > CUTOFF, count, 0), len(first)), np.bincount(of, lower, len(first))])
        asked = merged["history"][merged["asked"]]
        at = np.minimum(np.searchsorted(h[first], asked), max(len(first) - 1, 0))
        answer = np.zeros((CUTOFF + 2, len(asked)))
        if len(first):
            answer = terms[:, at] * (h[first][at] == asked)
        model = {"kind": "model", "place": place, "n": len(h), "data": encode({"histories": h[first], "sizes": followers, "terms": terms, "words": merged["word"][known], "counts": count}, MODEL_SPEC)}
        return {"count": merged["count"], "terms": answer}, [model, _facts_row(count)]

    def pick(self, answer, inverse, ticket):
        return {"count": answer["count"][inverse], "terms": answer["terms"][:, ticket["which"][ticket["asked"]]]}


class _Level:
    """A slice's distinct n-grams of a level: which one each token ends, and what is known of them."""

    def __init__(self, history: np.ndarray, word: np.ndarray, train: np.ndarray, words: int):
        """history: number of each token's history in the slice; word: its word's; train: tokens to count."""
        place, found = pd.factorize(history * words + word)
        self.place = place
        self.history, self.word = found // words, found % words
        self.local = np.bincount(place, train, len(found)).astype(np.int64)
        self.some = np.empty(len(found), np.int64)
        self.some[place] = np.arange(len(place))  # a token that ends it


class _Slice:
    """The tokens of a slice's documents, one document behind the other, and their n-grams."""

    def __init__(self, row: dict, documents: int):
        raw = np.frombuffer(zstandard.decompress(row["texts"]).translate(LOWER), np.uint8)
        self.slice_id, self.doc_ids, self.documents = row["slice_id"], row["doc_ids"], documents
        held = np.array([held_out(i, FOLD) for i in self.doc_ids], bool)
        starts, stops = word_spans(raw)
        n = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(row["sizes"])])))
        self.sizes = n + 1
        ends = np.cumsum(self.sizes) - 1
        keys = np.empty(ends[-1] + 1, U64)
        keys[ends] = END
        keys[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = span_hashes(raw, starts, stops)
        self.held = held
        self.first = np.append(0, ends[:-1] + 1)
        self.train = np.repeat(~held, self.sizes)
        self.word, self.keys = pd.factorize(keys)
        self.n = len(keys)
        self.levels: list[_Level] = []
        self.history_key: list[np.ndarray] = []

    def level(self, number: int) -> _Level:
        """The n-grams of `number` words."""
        while len(self.levels) < number:
            if not self.levels:
                history, keys = np.zeros(self.n, np.int64), np.zeros(1, U64)
            else:
                # the history of a token is the n-gram that the token before it ends; history 0 is a document's start
                last = self.levels[-1]
                history = np.append(0, last.place[:-1] + 1)
                history[self.first] = 0
                keys = np.append(START, mix(self.history_key[-1][last.history] * U64(0x9E3779B97F4A7C15) + self.keys[last.word]))
            self.history_key.append(keys)
            self.levels.append(_Level(history, self.word, self.train, len(self.keys)))
        return self.levels[number - 1]

    def records(self, number: int, model: Model, evaluated: list):
        """The records of a level by bucket, the n-gram of each (-1: none), and the history of each asking one."""
        x = self.level(number)
        if number == 1:
            bucket = spread(self.keys[x.word], model.buckets)
            order = order_of(bucket)
            return {"bucket": bucket[order], "word": self.keys[x.word][order], "count": x.local[order]}, order, None
        counts, keys = self.history_counts(number, evaluated), self.history_key[number - 1]
        asked = np.zeros(len(keys), bool)
        asked[x.history[np.unique(x.place[~self.train])]] = True
        # a history with many tokens is dealt by its words over as many buckets as it is worth, each of which is asked
        parts = np.maximum(np.minimum(np.ceil(counts * 4.0 * model.buckets / max(model.facts[0].tokens, 1)), model.buckets).astype(np.int64), 1)
        dealt = lambda i, part: spread(mix(keys[i] + part.astype(U64) * U64(0xD6E8FEB86659FD93)), model.buckets)
        hot = np.flatnonzero(asked & (parts > 1))
        query = np.repeat(hot, parts[hot])
        part = np.arange(len(query)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot])
        none = np.zeros(len(query), np.int64)
        history = np.append(x.history, query)
        bucket = np.append(dealt(x.history, ((self.keys[x.word] >> U64(50)) % parts[x.history].astype(U64)).astype(np.int64)), dealt(query, part))
        lower = evaluated[number - 2][0 if number == 2 else 1][x.some]
        order = order_of(bucket, history)
        history, bucket = history[order], bucket[order]
        head = np.append(True, (history[1:] != history[:-1]) | (bucket[1:] != bucket[:-1])) & asked[history]
        columns = {"bucket": bucket, "history": keys[history] & LOW48, "word": np.append(self.keys[x.word] & LOW40, none.astype(U64))[order], "count": np.append(x.local, none)[order], "lower": np.append(lower, none)[order], "asked": head}
        return columns, np.append(np.arange(len(x.word)), none - 1)[order], history[head]

    def evaluate(self, answers: dict, model: Model, upto: int):
        """(counts of the n-gram each token ends, its probability), level by level; answers: {level: answer columns}."""
        p = None
        out = []
        for number in range(1, upto + 1):
            _, gram, histories = self.records(number, model, out)
            x, facts, answer = self.level(number), model.facts[number - 1], answers[number]
            found = np.zeros(len(x.word), np.int64)
            found[gram[gram >= 0]] = answer["count"][gram >= 0]
            r = found[x.place]
            if number == 1:
                p = model.single(r)
            else:
                counts = self.history_counts(number, out)
                left, seen = np.zeros(len(counts)), np.zeros(len(counts))
                np.add.at(left, histories, facts.discount[1:] @ answer["terms"][:-1])
                np.add.at(seen, histories, answer["terms"][-1])
                h = x.history[x.place]
                # the weight: what the counts of the history leave, over what its followers leave at the level below
                given = 1 - left / np.maximum(counts, 1)
                weight = np.where(counts > 0, np.maximum(given, 0) / np.maximum(1 - seen, 1e-300), 1.0)
                p = np.where(r > 0, facts.times(r) / np.maximum(counts[h], 1), weight[h] * p)
            out.append((r, p))
        return out

    def history_counts(self, number: int, evaluated) -> np.ndarray:
        """Training counts of the slice's histories of a level from the second on."""
        last = self.level(number - 1)
        counts = np.empty(len(last.word) + 1, np.int64)
        counts[1:] = evaluated[number - 2][0][last.some]
        counts[0] = self.documents
        return counts


def _facts(found: DataFrame, number: int) -> Facts:
    names = [f"f{i}" for i in range(CUTOFF + 3)]
    row = found.where("kind = 'facts'").agg(*(F.coalesce(F.sum(F.col("facts")[i]), F.lit(0)).alias(names[i]) for i in range(len(names)))).first()
    counts = np.array([0, *row[2:]], float)
    facts = Facts(row[0], row[1], discounts(counts))
    if number == 1:
        given = facts.discount[1 : CUTOFF + 1] @ (np.arange(1, CUTOFF + 1) * counts[1 : CUTOFF + 1])
        large = facts.tokens - np.arange(1, CUTOFF + 1) @ counts[1 : CUTOFF + 1]
        facts.rest = 1 - (given + facts.discount[-1] * large) / max(facts.tokens, 1)
        least = 1 / (facts.tokens + 1.0)
        facts.scale = 1.0 if facts.rest >= least or not facts.tokens else (1 - least) / (1 - facts.rest)
    return facts


def _answers(right: pa.Table, rounds: list[Round]) -> dict:
    level = right.column("level").to_numpy()
    return {r.level: r.answers(right.filter(pa.array(level == r.level))) for r in rounds}


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_KIND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(s: _Slice, evaluated, model: Model):
    one = model.facts[0]
    r, p = evaluated[0][0], evaluated[-1][1]
    base = np.log10((r + 0.1) / (one.tokens + 0.1 * (one.types + 1)))
    add = lambda x: np.add.reduceat(x, s.first)
    return pa.table([pa.array(s.doc_ids, pa.int64()), pa.array(s.held), pa.array(s.sizes), pa.array(add((r > 0).astype(np.int64))), pa.array(np.full(len(s.sizes), one.tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))], schema=SCORED_KIND)


def _first_sender(first: Words, model: Model):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = _Slice(row, model.documents)
                yield batch(first.send(s.slice_id, s.records(1, model, [])[0]))

    return run


def _sender(rounds: list[Round], model: Model):
    def run(key, left, right):
        if not left.num_rows:
            return rows([])
        s = _Slice(left.to_pylist()[0], model.documents)
        evaluated = s.evaluate(_answers(right, rounds[:-1]), model, len(rounds) - 1)
        return rows(rounds[-1].send(s.slice_id, s.records(len(rounds), model, evaluated)[0]))

    return run


def _finisher(rounds: list[Round], model: Model):
    def run(key, left, right):
        if not left.num_rows:
            return SCORED_KIND.empty_table()
        s = _Slice(left.to_pylist()[0], model.documents)
        return _scored(s, s.evaluate(_answers(right, rounds), model, len(rounds)), model)

    return run


def fit_and_score(workspace: Workspace, documents: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[DataFrame], Model]:
    """(scores, the tables of each level, Model); the tables and what the scores are read from last as long as the workspace."""
    ways, tasks = digits(groups_for(documents, BUCKET_BYTES, 64)), relay_tasks(documents)
    sliced = stored_slices(workspace, documents, SLICE_BYTES)
    model = Model(documents.where(~held_out_column("doc_id", FOLD)).count(), [])
    rounds: list[Round] = [Words(ways)]
    model.buckets = rounds[0].buckets
    tables, answered = [], []

    def asked(sent):
        found, answers = rounds[-1].run(workspace, sent, f"katz-{len(rounds)}", tasks)
        tables.append(found)
        answered.append(answers.withColumn("level", F.lit(len(rounds))))
        model.facts.append(_facts(found, len(rounds)))
        return functools.reduce(DataFrame.unionByName, answered).groupBy("source")

    known = asked(sliced.mapInArrow(_first_sender(rounds[0], model), ROW))
    for number in range(2, order + 1):
        rounds.append(Grams(ways, number, Model(model.documents, model.facts[:1])))
        known = asked(sliced.groupBy("slice_id").cogroup(known).applyInArrow(_sender(list(rounds), model), ROW))
    return sliced.groupBy("slice_id").cogroup(known).applyInArrow(_finisher(rounds, model), SCORED), tables, model


def train_and_score(spark: SparkSession, documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all.

    A null or empty text is its end token alone; rows with a null id are held out; repeated rows all count and score
    alike; an empty table gives no rows. Words that training never saw are one unknown word. A text of any length is in
    one slice. Columns but doc_id and text are not read. Nothing but the result is left in the shared folder.
    """
    with Workspace(spark, "katz") as workspace:
        return workspace.result(fit_and_score(workspace, documents, order)[0])


def op1_katz(spark, sf_dir):
    """Null and empty texts have their end token alone, null ids are held out, repeated rows score alike; see train_and_score()."""
    return train_and_score(spark, table(spark, sf_dir, "documents"))
