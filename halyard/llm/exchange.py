"""Packed exchange of records by key. Sources (slices of documents) send records with distinct keys to buckets, what
lies under equal keys is merged there, and each source gets back what the bucket settled for each of its records.

A row on the way holds the records of one source for one place, as one compressed blob a column. A slice deals its
records to at most FIRST places, whatever the number of buckets. Where there are more buckets, relays merge the records
of many sources of a place into batches, which deal them on to at most WAYS places as sources of their own, and hand the
answers down. So rows and bytes follow the records, with one more hop each time the buckets grow by WAYS.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _slices, groups_for, input_bytes

#: A null doc_id is taken as this one: above every other.
NO_ID = np.iinfo(np.int64).max
LOW48 = U64((1 << 48) - 1)
#: The most places to which a slice deals its records, and a relay's batch.
FIRST, WAYS = 256, 2048
#: Records that a relay merges at once, and input for each relay task.
RELAY_RECORDS = 1 << 20
RELAY_BYTES = 256 << 20
#: The most buckets of a stored table.
MOST_STORED = 50_000


# ---------------------------------------------------------------- slices
def slices(documents: DataFrame, most: int) -> DataFrame:
    """slice_id, doc_ids, sizes, texts: documents in slices of about `most` bytes of text, by id within a slice;
    their texts (null: empty), each with a line end behind it, are one compressed blob; sizes are in bytes.

    The slice numbers hold for one run of the plan only: see stored_slices().
    """
    schema = "slice_id long, doc_ids array<long>, sizes array<long>, texts binary"
    kind = pa.schema([("slice_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def made():
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or ""))
            raw = [(texts[k] or "").encode("utf-8", "surrogatepass") + b"\n" for k in order]
            return pa.RecordBatch.from_pylist([{"slice_id": number, "doc_ids": [ids[k] for k in order], "sizes": list(map(len, raw)), "texts": zstandard.compress(b"".join(raw), 3)}], kind)

        for batch in batches:
            t = batch.column("text").to_pylist()
            i = batch.column("doc_id").to_pylist()
            for a, b in _slices([len(x or "") for x in t], most):
                n = sum(len(x or "") for x in t[a:b])
                if ids and size + n > most:
                    yield made()
                    number, ids, texts, size = number + 1, [], [], 0
                ids += i[a:b]
                texts += t[a:b]
                size += n
        if ids:
            yield made()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def stored_slices(workspace, documents: DataFrame, most: int) -> DataFrame:
    """slices() as a table in buckets of slice_id: joins on slice_id move the other side only."""
    number = min(max(8, input_bytes(documents) // most), MOST_STORED)
    return workspace.bucketed(slices(documents, most), "slices", number, "slice_id")


# ---------------------------------------------------------------- columns on the way
def _low_bytes(keys: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _packed(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes, as high bytes are alike."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _pack_steps(values: np.ndarray) -> bytes:
    """Integers as differences, small ones of either sign in the low bytes."""
    step = np.diff(values, prepend=np.int64(0)).astype("<i8")
    return _packed((step << 1) ^ (step >> 63))


def _unpack_steps(data: bytes) -> np.ndarray:
    folded = _unpacked(data, "<i8")
    return np.cumsum(((folded >> 1) & np.int64(0x7FFFFFFFFFFFFFFF)) ^ -(folded & 1))


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in an array."""
    return np.append(0, np.flatnonzero(values[1:] != values[:-1]) + 1) if len(values) else np.empty(0, int)


def _pack_runs(values: np.ndarray) -> bytes:
    start = runs(values)
    return len(start).to_bytes(4, "little") + _low_bytes(values[start], 6) + _packed(np.diff(np.append(start, len(values))).astype("<u4"))


def _unpack_runs(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.repeat(_from_low_bytes(data[4 : 4 + 6 * n], 6), _unpacked(data[4 + 6 * n :], "<u4"))


#: How a column is written. table: a matrix, whose last axis is not that of the records.
CODECS = {
    "key64": (lambda x: _low_bytes(x, 8), lambda d, n: _from_low_bytes(d, 8)),
    "key48": (lambda x: _low_bytes(x, 6), lambda d, n: _from_low_bytes(d, 6)),
    "key40": (lambda x: _low_bytes(x, 5), lambda d, n: _from_low_bytes(d, 5)),
    "runs48": (_pack_runs, lambda d, n: _unpack_runs(d)),
    "small": (lambda x: _packed(x.astype("<u4")), lambda d, n: _unpacked(d, "<u4").astype(np.int64)),
    "large": (lambda x: _packed(x.astype("<i8")), lambda d, n: _unpacked(d, "<i8")),
    "real": (lambda x: _packed(x.astype("<f8")), lambda d, n: _unpacked(d, "<f8")),
    "flag": (lambda x: np.packbits(x).tobytes(), lambda d, n: np.unpackbits(np.frombuffer(d, np.uint8), count=n).astype(bool)),
    "id": (_pack_steps, lambda d, n: _unpack_steps(d)),
}


def table_codec(rows: int) -> tuple:
    return lambda x: _packed(x.astype("<f8")), lambda d, n: _unpacked(d, "<f8").reshape(rows, -1)


def _codec(kind):
    return table_codec(kind) if isinstance(kind, int) else CODECS[kind]


def encode(columns: dict, spec: dict, part=slice(None)) -> list[bytes]:
    return [_codec(kind)[0](columns[name][..., part]) for name, kind in spec.items()]


def decode(data: list[bytes], spec: dict, n: int) -> dict:
    return {name: _codec(kind)[1](d, n) for (name, kind), d in zip(spec.items(), data)}


def stacked(parts: list[dict]) -> dict:
    return {name: np.concatenate([p[name] for p in parts], axis=-1) for name in parts[0]}


# ---------------------------------------------------------------- the rounds
#: kind: sent (records), answer (to a source), ticket (of a relay: how a source's records went on), model and facts (the reducers' own).
ROW = "kind string, place long, source long, origin long, n long, data array<binary>, facts array<long>"
_KIND = pa.schema([("kind", pa.string()), *((c, pa.int64()) for c in ("place", "source", "origin", "n")), ("data", pa.list_(pa.binary())), ("facts", pa.list_(pa.int64()))])


def rows(found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, _KIND)


def batch(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, _KIND)


@dataclass
class Round:
    """One question of all sources. Subclasses say what records are: `spec` and `answer_spec` name the columns of
    records and of answers and how they are written; `ticket_spec` those that pick() needs of a source's own records;
    `routed` the column, if there is one, whose spread() is the bucket, which else goes along.

    A round is a value that tasks get; `digits` are the ways of each hop, whose product is the number of buckets.
    """

    digits: list[int]
    most: int = field(default_factory=lambda: RELAY_RECORDS)

    spec = answer_spec = ticket_spec = routed = None

    def merge(self, columns: dict, hop: int) -> tuple[dict, np.ndarray, dict]:
        """Records of many sources as those of one: sorted by place of the hop, with the merged record of each record,
        and the ticket columns of the given records."""
        raise NotImplementedError

    def settle(self, merged: dict, place: int) -> tuple[dict, list[dict]]:
        """Answer columns for the merged records of a whole bucket, and rows of the bucket's own."""
        raise NotImplementedError

    def pick(self, answer: dict, inverse: np.ndarray, ticket: dict) -> dict:
        """Answer columns of a source from those of the merged records."""
        return {name: x[..., inverse] for name, x in answer.items()}

    @property
    def buckets(self) -> int:
        return math.prod(self.digits)

    def place(self, bucket: np.ndarray, hop: int = 0) -> np.ndarray:
        """Where a hop takes the records of the buckets; the last hop, and any behind it, to the bucket itself."""
        return bucket // math.prod(self.digits[hop + 1 :])

    # ---- on the way there
    def send(self, source: int, columns: dict, hop: int = 0) -> list[dict]:
        """Rows for the next places from records that are sorted by place."""
        place = self.place(columns["bucket"], hop)
        columns = columns | {"rest": columns["bucket"] % math.prod(self.digits[hop + 1 :])}
        spec = self._spec(hop)
        cuts = runs(place)
        return [{"kind": "sent", "place": int(place[a]), "source": source, "n": int(b - a), "data": encode(columns, spec, slice(a, b))} for a, b in zip(cuts, np.append(cuts[1:], len(place)))]

    def _spec(self, hop: int) -> dict:
        return self.spec | ({"rest": "small"} if math.prod(self.digits[hop + 1 :]) > 1 and not self.routed else {})

    def _received(self, row: dict, hop: int) -> dict:
        found = decode(row["data"], self._spec(hop), row["n"])
        if self.routed:
            return found | {"bucket": spread(found[self.routed], self.buckets)}
        rest = math.prod(self.digits[hop + 1 :])
        return found | {"bucket": row["place"] * rest + found.pop("rest", np.zeros(row["n"], np.int64))}

    def _relay(self, hop: int):
        """Batches of records of one place, dealt on; tickets say what became of each source's records."""

        def run(batches):
            task, number = TaskContext.get().partitionId() << 32, 0
            held, size = [], 0

            def passed_on():
                nonlocal number
                merged, inverse, ticket = self.merge(stacked([c for _, c in held]), hop + 1)
                out, at = self.send(task + number, merged, hop + 1), 0
                for r, _ in held:
                    some = slice(at, at + r["n"])
                    at += r["n"]
                    out.append({"kind": "ticket", "place": r["place"], "source": task + number, "origin": r["source"], "n": r["n"], "data": [_packed(inverse[some].astype("<u4")), *encode(ticket, self.ticket_spec, some)]})
                number += 1
                held.clear()
                return batch(out)

            for b in batches:
                for r in b.to_pylist():
                    if held and (held[0][0]["place"] != r["place"] or size >= self.most):
                        yield passed_on()
                        size = 0
                    held.append((r, self._received(r, hop)))
                    size += r["n"]
            if held:
                yield passed_on()

        return run

    def _handed_down(self):
        """The answers to a batch, as answers to the sources that it was made of."""

        def run(key, left, right):
            out, answer = [], None
            for r in left.to_pylist():
                if answer is None:
                    answer = self.answers(right)
                ticket = decode(r["data"][1:], self.ticket_spec, r["n"])
                found = self.pick(answer, _unpacked(r["data"][0], "<u4"), ticket)
                out.append({"kind": "answer", "place": r["place"], "source": r["origin"], "n": r["n"], "data": encode(found, self.answer_spec)})
            return rows(out)

        return run

    def _settled(self):
        def run(key, table):
            found = table.to_pylist()
            merged, inverse, ticket = self.merge(stacked([self._received(r, len(self.digits) - 1) for r in found]), len(self.digits))
            answer, out = self.settle(merged, found[0]["place"])
            at = 0
            for r in found:
                some = slice(at, at + r["n"])
                at += r["n"]
                own = self.pick(answer, inverse[some], {name: x[..., some] for name, x in ticket.items()})
                out.append({"kind": "answer", "place": r["place"], "source": r["source"], "n": r["n"], "data": encode(own, self.answer_spec)})
            return rows(out)

        return run

    def answers(self, table: pa.Table) -> dict:
        """All answers to a source, in the order of its records."""
        found = sorted(table.to_pylist(), key=lambda r: r["place"])
        return stacked([decode(r["data"], self.answer_spec, r["n"]) for r in found])

    def run(self, workspace, sent: DataFrame, tag: str, tasks: int) -> tuple[DataFrame, DataFrame]:
        """(what the buckets found, the answers to the sources); tasks: about how many relay tasks the input is worth."""
        tickets = []
        for hop in range(len(self.digits) - 1):
            shares = max(1, tasks // math.prod(self.digits[: hop + 1]))
            dealt = sent.withColumn("share", F.pmod(F.xxhash64("source"), F.lit(shares))).repartition(max(tasks, 1), "place", "share").sortWithinPartitions("place").drop("share")
            moved = workspace.table(dealt.mapInArrow(self._relay(hop), ROW), f"{tag}-relay", "kind")
            tickets.append(moved.where("kind = 'ticket'"))
            sent = moved.where("kind = 'sent'")
        found = workspace.table(sent.groupBy("place").applyInArrow(self._settled(), ROW), tag, "kind")
        answers = found.where("kind = 'answer'")
        for t in reversed(tickets):
            answers = workspace.table(t.groupBy("source").cogroup(answers.groupBy("source")).applyInArrow(self._handed_down(), ROW), f"{tag}-answers")
        return found, answers


def digits(buckets: int) -> list[int]:
    """The ways of each hop for at least so many buckets."""
    if buckets <= FIRST:
        return [buckets]
    rest, hops = -(-buckets // FIRST), 1
    while WAYS**hops < rest:
        hops += 1
    each = math.ceil(rest ** (1 / hops))
    return [FIRST] + [each + (each**hops < rest)] * hops


def relay_tasks(documents: DataFrame) -> int:
    return groups_for(documents, RELAY_BYTES, 1)


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(20)) % U64(buckets)).astype(np.int64)
