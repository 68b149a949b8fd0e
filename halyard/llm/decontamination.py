"""Operator 2: benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the power of two that bounds their shingle count. For a partition of bound L every
document is a row of passages of 1.5 L shingles at steps of L / 2, so that an item lies whole in one of them and its
Jaccard similarity with that passage is bounded from below by its size, however long the document is. Passages and
items that share a MinHash value are candidates, verified by exact containment of the item's shingles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped
from .common import U64, constants, map_rows, table, text_parts, windows, word_hashes, words, written

WIDTH = 5
THRESHOLD = 0.8
#: At 0.8 containment the similarity is 1/4 at least, so all HASHES values differ with probability (3/4)^64 at most: 1e-8.
HASHES = 64
#: Bytes of items (shingles and MinHash values) that one pass over the documents searches for: what a broadcast index holds, about.
INDEX_BYTES = 32 << 20
TABLE_BITS = 22

_A = (constants(HASHES, 31) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (constants(HASHES, 37) >> U64(32)).astype(np.uint32)
_NUMBER = np.arange(HASHES, dtype=U64)[:, None] << U64(32)


def shingle_row(text: str | None) -> np.ndarray:
    """Hashes of the runs of WIDTH words in lower case (A-Z), in text order; shorter texts have none."""
    return windows(word_hashes(words(text, True)), WIDTH)


def least_values(row: np.ndarray, step: int) -> np.ndarray:
    """HASHES MinHash values of each block of `step` shingles (a power of two): HASHES x blocks."""
    x = (row >> U64(32)).astype(np.uint32)
    each = max(step, 4096)
    parts = []
    for a in range(0, len(x), each):
        v = x[None, a : a + each] ^ _B[:, None]
        v *= _A[:, None]
        parts.append(np.minimum.reduceat(v, np.arange(0, v.shape[1], step), axis=1))
    return np.concatenate(parts, axis=1)


def _place(keys: np.ndarray) -> np.ndarray:
    return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Partition:
    """The items of one size class: their MinHash values, sorted, and a bit table before them."""

    bound: int
    keys: np.ndarray
    items: np.ndarray
    seen: np.ndarray = field(repr=False)

    @property
    def step(self) -> int:
        return max(self.bound // 2, 1)


class Index:
    def __init__(self, items: list[tuple[int, np.ndarray]]):
        """items: (item_id, its shingles in any order); those without shingles can't be found and are left out."""
        found = [(i, np.unique(s)) for i, s in items if len(s)]
        self.ids = [i for i, _ in found]
        self.sets = [s for _, s in found]
        by: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            by.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        self.partitions = []
        for bound, members in sorted(by.items()):
            keys = np.concatenate([(least_values(self.sets[k], 1 << (len(self.sets[k]) - 1).bit_length()).astype(U64) | _NUMBER).ravel() for k in members])
            owner = np.repeat(members, HASHES)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << TABLE_BITS, bool)
            seen[_place(keys)] = True
            self.partitions.append(Partition(bound, keys[order], owner[order], seen))

    def candidates(self, row: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a passage of their size class."""
        out: set[int] = set()
        if not len(row) or not self.partitions:
            return out
        step = self.partitions[0].step
        blocks = least_values(row, step)
        for p in self.partitions:
            while step < p.step:
                if blocks.shape[1] % 2:
                    blocks = np.concatenate([blocks, blocks[:, -1:]], axis=1)
                blocks, step = np.minimum(blocks[:, ::2], blocks[:, 1::2]), step * 2
            passages = blocks
            for k in (1, 2):
                if blocks.shape[1] > k:
                    passages = np.minimum(passages[:, : blocks.shape[1] - k], blocks[:, k:]) if passages.shape[1] > blocks.shape[1] - k else passages
            keys = passages.astype(U64) | _NUMBER
            keys = keys[p.seen[_place(keys)]]
            if len(keys):
                keys = np.unique(keys)
                a, b = np.searchsorted(p.keys, keys, "left"), np.searchsorted(p.keys, keys, "right")
                for i, j in zip(a, b):
                    out.update(p.items[i:j].tolist())
        return out

    def search(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
        """(item, its shingles that the text has) of the items whose containment reaches the threshold."""
        row = shingle_row(text)
        found = self.candidates(row)
        if not found:
            return []
        row = np.unique(row)
        out = []
        for k in sorted(found):
            s = self.sets[k]
            at = np.searchsorted(row, s)
            at[at == len(row)] = 0
            shared = int((row[at] == s).sum())
            if shared / len(s) >= threshold:
                out.append((k, shared))
        return out


def indexes(benchmark: DataFrame):
    """An index for each block of about INDEX_BYTES of items, so that what is sent to the executors at once is bounded;
    an item that is larger alone is a block of its own."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    hashed = written(map_rows(rows, lambda r: {"item_id": r["item_id"], "shingles": [np.unique(shingle_row(t)).tobytes() for t in r["text"]]}, "item_id long, shingles binary").distinct(), "items")  # an item that is repeated counts once
    blocks = -(-(hashed.agg(F.sum(F.octet_length("shingles") + HASHES * 12)).first()[0] or 0) // INDEX_BYTES)
    for k in range(blocks):
        some = hashed.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == k).collect()
        yield Index(sorted(((r.item_id, np.frombuffer(r.shingles, U64)) for r in some), key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes())))
    dropped(hashed)


def search(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared, containment, for each row of documents and item of which
    the document, anywhere, has `threshold` of the shingles.

    Where that share lies in one passage, a pair is missed with a probability of 1e-8 at most. An item in pieces that lie
    passages apart has fewer values in common with each: of items of 60 to 400 words cut into 2, 4 and 8 such pieces, tests
    find at least 0.99, 0.97 and 0.8. Null, empty and short texts and items hold nothing, null ids are kept, a repeated
    row has its rows again, a repeated item counts once, empty tables give no rows; other columns are not read."""
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    out = spark.createDataFrame([], schema)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(rows, sent=sent):
            x = sent.value
            found = [(i, k, n) for i, t in zip(rows["doc_id"], rows["text"]) for k, n in x.search(t, threshold)]
            size = [len(x.sets[k]) for _, k, _ in found]
            return {"doc_id": [i for i, _, _ in found], "item_id": [x.ids[k] for _, k, _ in found], "n_shingles": size, "n_shared": [n for *_, n in found], "containment": [n / m for (*_, n), m in zip(found, size)]}

        out = out.unionByName(map_rows(docs, run, schema))
    return out


def clean(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with all their columns, that hold no test item as search() defines it. No row is shuffled."""
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for part, texts in text_parts(batches):
                yield part.filter(pa.array([not sent.value.search(t, threshold) for t in texts], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op2_decontamination(spark, sf_dir):
    """Null, empty and short texts hold no item; each repeated row has its own result; see search()."""
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(len(a) - 4), lambda i: array_to_string(a[i + 1 : i + 5], ' '))) AS g FROM d WHERE len(a) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(len(a) - 4), lambda i: array_to_string(a[i + 1 : i + 5], ' '))) AS g FROM b WHERE len(a) >= 5),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(n_shared AS BIGINT) AS n_shared, n_shared / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared / n_shingles >= 0.8
"""
