"""Operator 3: packing token sequences by sums of squares.

A document goes into the open bin after which the squared counts of open bins, by residual gap, add up to the
least; a bin is opened where none fits. Documents are taken by falling length, in hash groups of bounded size.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for, map_rows, table

CAPACITY = 1024
END = 2
#: One packing group for so many bytes of the input; each group ends with a few bins that are not full.
GROUP_BYTES = 64 << 20

#: Below this code point the rank file's pattern and the tokenizer file split alike (tests hold them against each other).
SAME_BELOW = 0x3000
_ODD = re.compile(f"[{chr(SAME_BELOW)}-\U0010ffff]|<\\|endoftext\\|>")
_made: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the tokenizer file. Its ranks, where they lie beside it, give the same ids faster for most texts."""

    def __init__(self, path: str):
        self.path, self.slow, self.fast = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast and not _ODD.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones, behind a first one of what is left over."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, total, capacity)]


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each document; a null or empty text is its end token alone, a text of any length is cut
    whole, repeated rows have their pieces each, an empty table has none. Other columns are not read."""
    path = path or vocabulary()

    def run(rows):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for i, t in zip(rows["doc_id"], rows["text"]):
            ids = np.append(encoder(path).ids(t), np.array([end], "<u4"))
            for k, (s, n) in enumerate(cut(len(ids), capacity)):
                for name, value in zip(out, (i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                    out[name].append(value)
        return out

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(lengths, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the order given; no item is longer than a bin."""
    lengths = np.asarray(lengths, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        k = -1
        have = count[s:capacity]
        if s < capacity and have.any():
            change = 2 * (count[: capacity - s] - have) + 2
            change[0] = 1 - 2 * have[0]  # the bin is full and counts no more
            change[have == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
        if k < 0:
            b, gap, made = made, capacity, made + 1
        else:
            gap = k + s
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(found: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. Ties in length go by id, piece and checksum; repeated rows are packed each.

    Pieces are dealt to the groups by their place in the input, so no id fills a group; an empty table gives no rows.
    """
    grouped = found.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kind = found.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(key, t):
        t = t.drop_columns(["group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = place(t.column("length").to_numpy(), capacity)
        return t.append_column("sequence_id", pa.array((key[0].as_py() << 40) + bins)).append_column("offset", pa.array(offsets))

    return grouped.groupBy("group").applyInArrow(run, f"{kind}, sequence_id long, offset long")


def op3_packing(spark, sf_dir):
    """Null and empty texts are their end token alone, repeated rows are packed each; see pieces() and pack()."""
    documents = table(spark, sf_dir, "documents")
    return pack(pieces(documents), groups_for(documents, GROUP_BYTES, 1))
