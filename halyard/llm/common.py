"""Helpers that the text operators share: word hashing, Arrow maps, shared tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Workspace, fresh_path, written  # noqa: F401

U64 = np.uint64
#: Texts are handed to the Python functions in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The planner's size of the input (file sizes for tables), or its text's where the planner has none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found >> 50:
        strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        found = df.agg(F.sum(sum(strings, F.lit(16).cast("long")))).first()[0] or 0
    return found


def groups_for(df: DataFrame, each: int, least: int = 8) -> int:
    """A number of hash groups that grows with the input, so that each group stays near `each` bytes of it."""
    return max(least, -(-input_bytes(df) // each))


# ---------------------------------------------------------------- words and hashes
def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def order_of(*keys: np.ndarray) -> np.ndarray:
    """The stable order by the keys, the first one first.

    As many bits of the keys as fit are packed above the index and sorted as plain numbers, several times as fast as an
    indirect sort; runs that those bits leave equal though the keys differ are sorted by the keys themselves.
    """
    n = len(keys[0])
    low = max(n - 1, 1).bit_length()
    room, packed, cut = 64 - low, np.arange(n, dtype=U64), False
    if n < 2:
        return np.arange(n)
    for k in keys:
        least = k.min()
        k = k.astype(U64, copy=False) - least.astype(U64)
        bits = int(k.max()).bit_length()
        if bits > room:
            cut, k, bits = True, k >> U64(bits - room), room
        if bits:
            packed |= k << U64(low + room - bits)
        room -= bits
        if cut:
            break
    packed.sort()
    order = (packed & U64((1 << low) - 1)).astype(np.int64)
    if cut:
        packed >>= U64(low)
        same = packed[1:] == packed[:-1]
        differ = np.zeros(n - 1, bool)
        at = np.flatnonzero(same)
        for k in keys:
            differ[at] |= k[order[at]] != k[order[at + 1]]
        if differ.any():
            run = np.append(0, np.cumsum(~same))
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[1:][differ]] = True
            some = np.flatnonzero(mixed[run])
            sub = order[some]
            order[some] = sub[np.lexsort((sub, *[k[sub] for k in reversed(keys)], run[some]))]
    return order


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but the ASCII blanks [\\x20\\x09-\\x0D], as UTF-8; lower: A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), U64, len(ws))


#: Masks of the first 0 to 8 bytes, and the longest word that is hashed by lanes of 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LANES = 64


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words in an array of bytes."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ((raw - np.uint8(9)) > 4) & (raw != 32)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at the spans, all at once; words of one length up to 8 bytes never collide."""
    size = stops - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    at = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw) + 1,), (1,))  # the 8 bytes from each place on
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D))
    long = size > LANES
    for k in range(0, LANES, 8):
        some = np.flatnonzero((size > k) & ~long)
        if not len(some):
            break
        lane = at[starts[some] + k] & _FIRST[np.minimum(size[some] - k, 8)]
        out[some] = mix(out[some] ^ (lane * U64(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : stops[i]].tobytes())
    return out


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.zeros(n, U64)
    for k, c in enumerate(constants(width, seed)):
        total += hashes[k : k + n] * c
    return mix(total)


def shingles(text: str | None, width: int = 5, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of 1 to width-1 words has one shingle of all of them."""
    ws = words(text, lower)
    if not ws:
        return np.empty(0, U64)
    if len(ws) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), len(ws))], U64)
    return np.unique(windows(word_hashes(ws), width))


def held_out(doc_id, mod: int) -> bool:
    """crc32 of the id as text, modulo mod, is 0; a null id counts as held out, so that nothing is learnt from it."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % mod == 0


def held_out_column(doc_id: str, mod: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == 0, F.lit(True))


# ---------------------------------------------------------------- Arrow maps
def _slices(sizes, most: int):
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_rows(df: DataFrame, function, schema: str, weigh: str | None = "text", most: int = SLICE_BYTES) -> DataFrame:
    """function(dict of column lists) -> dict of columns, over slices of about `most` bytes of column `weigh`."""
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = None

    def run(batches):
        nonlocal arrow
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.coalesce(pc.binary_length(batch.column(weigh)), 0).to_pylist() if weigh else [0] * batch.num_rows
            for a, b in _slices(sizes, most):
                part = batch.slice(a, b - a)
                found = function({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([_array(found[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def text_parts(batches, column: str = "text", most: int = SLICE_BYTES):
    """(part of a batch, its texts) in slices of about `most` bytes, so that few texts are Python strings at once."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.coalesce(pc.binary_length(batch.column(at)), 0).to_pylist()
        for a, b in _slices(sizes, most):
            part = batch.slice(a, b - a)
            yield part, part.column(at).to_pylist()


def _array(values, kind):
    return values if isinstance(values, pa.Array) else pa.array(values, kind)
