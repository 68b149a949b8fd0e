"""Operator 4: exact substring deduplication with fixed-block anchors.

Every document's non-overlapping blocks of BLOCK words are the index; all its rolling windows of BLOCK words probe it.
A repeat of WIDTH = 2 * BLOCK - 1 words holds a whole indexed block of the other text, so none is missed. Around the
hits the windows of WIDTH words are compared by 96-bit keys; runs of repeated windows are the maximal exact repeats.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import U64, Workspace, groups_for, order_of, span_hashes, table, windows, word_spans
from .exchange import LOW48, NO_ID, ROW, Round, batch, digits, relay_tasks, rows, runs, spread, stored_slices

WIDTH = 13
#: Text of a slice, and input for each hash bucket.
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20


def block_of(width: int) -> int:
    return (width + 1) // 2


class Anchors(Round):
    """Who has a block? Records: a key with an id and whether that document has it as an indexed block. A key's
    records are its largest document, and the smallest that has it as a block. Answer: a document has it as a block
    and a larger one as a window."""

    spec = {"key": "key48", "id": "id", "flag": "flag"}
    answer_spec = {"hit": "flag"}
    ticket_spec: dict = {}
    routed = "key"

    def records(self, key: np.ndarray, top: np.ndarray, low: np.ndarray, hop: int = 0) -> tuple[dict, np.ndarray]:
        """Records of distinct keys (low: NO_ID without a block), by place and id, and for each key its first record."""
        two = low < top
        key, ids = np.append(key, key[two]), np.append(top, low[two])
        flag = np.append((low == top) & (low < NO_ID), np.ones(two.sum(), bool))
        bucket = spread(key, self.buckets)
        order = order_of(self.place(bucket, hop), ids)
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        return {"bucket": bucket[order], "key": key[order], "id": ids[order], "flag": flag[order]}, at[: len(top)]

    def merge(self, columns, hop):
        order = order_of(columns["key"])
        key, ids = columns["key"][order], columns["id"][order]
        start = runs(key)
        low = np.minimum.reduceat(np.where(columns["flag"][order], ids, NO_ID), start)
        merged, place = self.records(key[start], np.maximum.reduceat(ids, start), low, hop)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.repeat(place, np.diff(np.append(start, len(order))))
        return merged, inverse, {}

    def settle(self, merged, place):
        order = order_of(merged["key"])
        start = runs(merged["key"][order])
        ids = merged["id"][order]
        low = np.minimum.reduceat(np.where(merged["flag"][order], ids, NO_ID), start)
        hit = np.empty(len(order), bool)
        hit[order] = np.repeat(low < np.maximum.reduceat(ids, start), np.diff(np.append(start, len(order))))
        return {"hit": hit}, []


class Repeats(Round):
    """Which window of the whole width also starts in a smaller document? Records: a 96-bit key in two halves, and the
    smallest document of the source that has it. Answers lie by the records' places, so no key comes back."""

    spec = {"key": "key48", "more": "key48", "id": "id"}
    answer_spec = {"hit": "flag"}
    ticket_spec = {"larger": "flag"}
    routed = "key"

    def merge(self, columns, hop=0):
        order = order_of(columns["key"], columns["more"], columns["id"])
        key, more, ids = (columns[c][order] for c in ("key", "more", "id"))
        start = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (more[1:] != more[:-1])) + 1)
        length = np.diff(np.append(start, len(order)))
        merged = {"bucket": spread(key[start], self.buckets), "key": key[start], "more": more[start], "id": ids[start]}
        again = order_of(self.place(merged["bucket"], hop), merged["id"])
        at = np.empty(len(start), np.int64)
        at[again] = np.arange(len(start))
        inverse, larger = np.empty(len(order), np.int64), np.empty(len(order), bool)
        inverse[order] = np.repeat(at, length)
        larger[order] = ids > np.repeat(ids[start], length)
        return {c: x[again] for c, x in merged.items()}, inverse, {"larger": larger}

    def settle(self, merged, place):
        return {"hit": np.zeros(len(merged["key"]), bool)}, []  # merged once more, none is smaller than the smallest

    def pick(self, answer, inverse, ticket):
        return {"hit": answer["hit"][inverse] | ticket["larger"]}


@dataclass
class _Slice:
    """The documents of a slice by id, and windows over their words."""

    row: dict

    def __post_init__(self):
        self.raw = zstandard.decompress(self.row["texts"])
        data = np.frombuffer(self.raw, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(self.row["sizes"])])
        self.ids = np.array([NO_ID if i is None else i for i in self.row["doc_ids"]], np.int64)
        self.starts, self.stops = word_spans(data)
        self.hashes = span_hashes(data, self.starts, self.stops)
        self.first = np.searchsorted(self.starts, self.bounds)  # of each document's words
        self.sizes = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)

    def whole(self, width: int) -> np.ndarray:
        """Starts of the windows that lie in one document."""
        return np.flatnonzero(self.doc[width - 1 :] == self.doc[: len(self.doc) - width + 1]) if len(self.doc) >= width else np.empty(0, int)

    def anchors(self, width: int, round: Anchors):
        """The records of the first round, each probing window's start and its record's place."""
        block = block_of(width)
        start = self.whole(block)
        start = start[self.sizes[self.doc[start]] >= width]
        key = windows(self.hashes, block)[start] & LOW48 if len(start) else np.empty(0, U64)
        ids = self.ids[self.doc[start]]
        indexed = (start - self.first[self.doc[start]]) % block == 0
        order = order_of(key)
        k, d = key[order], ids[order]
        cut = runs(k)
        if not len(cut):
            return None, start, cut
        low = np.minimum.reduceat(np.where(indexed[order], d, NO_ID), cut)
        columns, place = round.records(k[cut], d[np.append(cut[1:], len(d)) - 1], low)
        of = np.empty(len(start), np.int64)
        of[order] = np.repeat(place, np.diff(np.append(cut, len(d))))
        return columns, start, of

    def repeats(self, width: int, hit: np.ndarray, start: np.ndarray, of: np.ndarray, round: Repeats):
        """The records of the second round, the starts of the windows of the whole width that hold a hit, and each
        one's record and whether the slice itself has it in a smaller document."""
        block = block_of(width)
        at = np.zeros(len(self.hashes) + block + 1, np.int64)
        at[start[hit[of]] + 1] = 1
        total = np.cumsum(at)
        wide = self.whole(width)
        wide = wide[total[wide + block] > total[wide]]
        if not len(wide):
            return None, wide, wide, wide
        a, b = (windows(self.hashes, width, k)[wide] & LOW48 for k in (1, 2))
        columns, of, ticket = round.merge({"key": a, "more": b, "id": self.ids[self.doc[wide]]})
        return columns, wide, of, ticket["larger"]

    def gone(self, width: int, wide: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Words that a repeated window covers."""
        change = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(change, wide[repeated], 1)
        np.add.at(change, wide[repeated] + width, -1)
        return np.cumsum(change[:-1]) > 0


def _probe(width: int, first: Anchors):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                columns, _, _ = _Slice(row).anchors(width, first)
                if columns:
                    yield batch(first.send(row["slice_id"], columns))

    return run


def _opened(left, right, width: int, first: Anchors, second: Repeats):
    """(slice, records of the second round, the starts of their windows, their records, own repeats)."""
    s = _Slice(left.to_pylist()[0])
    columns, start, of = s.anchors(width, first)
    hits = first.answers(right)["hit"] if columns else np.empty(0, bool)
    return s, *s.repeats(width, hits, start, of, second)


def _extend(width: int, first: Anchors, second: Repeats):
    def run(key, left, right):
        if not left.num_rows:
            return rows([])
        s, columns, *_ = _opened(left, right, width, first, second)
        return rows(second.send(s.row["slice_id"], columns) if columns else [])

    return run


def _finish(width: int, first: Anchors, second: Repeats, kind, make):
    def run(key, left, right):
        out = []
        if left.num_rows:
            step = right.column("step").to_numpy()
            s, columns, wide, of, own = _opened(left, right.filter(pa.array(step == 1)), width, first, second)
            repeated = np.zeros(0, bool)
            if columns:
                repeated = own | second.answers(right.filter(pa.array(step == 2)))["hit"][of]
            gone = s.gone(width, wide, repeated) if repeated.any() else None
            for i, doc_id in enumerate(s.row["doc_ids"]):
                ws = s.raw[s.bounds[i] : s.bounds[i + 1]].split()
                out.append(make(doc_id, ws, gone[s.first[i] : s.first[i + 1]] if gone is not None else np.zeros(len(ws), bool)))
        return pa.Table.from_pylist(out, kind)

    return run


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digest(doc_id, ws, gone):
    kept = [w for w, g in zip(ws, gone.tolist()) if not g] if gone.any() else ws
    return {"doc_id": doc_id, "n_words": len(ws), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


SPANS = "doc_id long, n_words long, repeats array<struct<start:long,stop:long>>, kept string"


def _spans(doc_id, ws, gone):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return {"doc_id": doc_id, "n_words": len(ws), "repeats": [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])], "kept": b" ".join(w for w, g in zip(ws, gone) if not g).decode("utf-8", "surrogatepass")}


def dedupe(spark: SparkSession, documents: DataFrame, width: int = WIDTH, digests: bool = False) -> DataFrame:
    """A row for each row of documents: its repeats as word spans and the kept words, or digests of them.

    A word goes if a window over it also starts in a document with a smaller id; null ids are above all others,
    rows of one id do not repeat each other, null and empty texts have no words, an empty table gives none. A text of
    any length is one document of one slice. Other columns are not read. Nothing but the result is left in the shared folder.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = DIGEST if digests else SPANS
    kind = to_arrow_schema(spark.createDataFrame([], schema).schema)
    ways, tasks = digits(groups_for(documents, BUCKET_BYTES, 64)), relay_tasks(documents)
    first, second = Anchors(ways), Repeats(ways)
    with Workspace(spark, "substrings") as workspace:
        sliced = stored_slices(workspace, documents, SLICE_BYTES)
        _, hits = first.run(workspace, sliced.mapInArrow(_probe(width, first), ROW), "anchors", tasks)
        sent = sliced.groupBy("slice_id").cogroup(hits.groupBy("source")).applyInArrow(_extend(width, first, second), ROW)
        _, repeats = second.run(workspace, sent, "repeats", tasks)
        both = hits.withColumn("step", F.lit(1)).unionByName(repeats.withColumn("step", F.lit(2)))
        return workspace.result(sliced.groupBy("slice_id").cogroup(both.groupBy("source")).applyInArrow(_finish(width, first, second, kind, _digest if digests else _spans), schema))


def op4_substring_dedup(spark, sf_dir):
    """Null and empty texts have no words and lose none; a repeated row is not a repeat of itself; see dedupe()."""
    return dedupe(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
w AS (SELECT doc_id, i, array_to_string(a[i + 1 : i + 13], ' ') AS win FROM (SELECT doc_id, a, unnest(range(len(a) - 12)) AS i FROM d WHERE len(a) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM w JOIN f USING (win) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS j FROM d),
k AS (SELECT t.doc_id, count(*) AS n_words, count(r.j) AS n_removed, string_agg(word, ' ' ORDER BY t.j) FILTER (WHERE r.j IS NULL) AS kept
      FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.j = r.j GROUP BY t.doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
