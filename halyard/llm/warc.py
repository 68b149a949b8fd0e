"""Operator 9: a deterministic sharded WARC writer, and its reader.

Records lie in the order of (page_id, url, digest, number among equal rows). Shards are runs of cells of page_id whose
borders follow from exact sums of bytes, so the same rows give the same files whatever their layout. Tasks roll the
files of a shard by compressed size under temporary names, and the files of the attempts that the manifest names are
renamed when all are written. Headers and digests are made anew.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import until_exit
from .common import Workspace, fresh_path, table, written

#: Files are closed at the first record that ends beyond so many compressed bytes.
ROLL_BYTES = 64 << 20
#: About so many bytes of records for each shard, and the most shards beside those that a heavy cell is split into.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 100_000
#: The most cells that the range of page_id is cut into; what a record has beside its payload, about.
CELLS, HEAD_BYTES = 16_384, 700
#: Equal rows beyond so many are dealt to shards of their own. A key with a larger share of all rows than 1 / HEAVY is heavy.
CHUNK, HEAVY = 1 << 16, 4096
#: Every record's date: a parameter, so that the same pages give the same bytes.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, sequence int, name string, temporary string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id, url, digest: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(('page', page_id, url, digest, number)))}>"


def _block(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id, url, number: int, digest: str, length: int, payload: bytes | None, first: tuple | None = None, date: str = DATE) -> bytes:
    """A response with its payload, or without one a revisit of the record of the page and address `first`.

    digest: SHA-1 of the payload in hexadecimal digits; number: of the record among those of equal rows.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if payload is None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id, url, digest, number)), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(digest))), ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(body).digest()))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*first, digest, 0)), ("WARC-Refers-To-Date", date)]
        if first[0] is not None:
            fields.append(("X-Refers-To-Page-ID", str(first[0])))
    return _block(fields, body)


KEY = ("page_id", "url", "digest")


def payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(html).alias("digest"), html.alias("html"))


def roles(rows: DataFrame, least: int = 0) -> DataFrame:
    """For each distinct row (page_id, url, digest): n, how many there are; length of the payload; and, from `least`
    bytes on, the page and address of the first row of that payload, and whether it is this one.

    First is the smallest page_id (null last), then url. Only digests move, not payloads, and partial aggregates
    leave one row of a repeated key or payload in a task.
    """
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.octet_length("html")).cast("long").alias("length"))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = keys.where(F.col("length") >= least).groupBy("digest").agg(F.min(place).alias("first"))
    return keys.join(first, "digest", "left").select(*KEY, "n", "length", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), place.eqNullSafe(F.col("first")).alias("is_first"), F.col("first").isNull().alias("small"))


def cells_of(keys: DataFrame, each: int, shards: int | None):
    """(the cell of a page_id as a column, [(cell, its first shard, the number of its shards)], rows); at most CELLS + 3 cells.

    Cells are equally wide; a shard takes neighbouring ones up to `each` bytes, and a cell beyond that has several shards.
    """
    weight = F.col("n") * HEAD_BYTES + F.when(F.col("is_first"), F.col("length")).when(F.col("small"), F.col("length") * F.col("n")).otherwise(0)
    low, high, total, rows = keys.agg(F.min("page_id"), F.max("page_id"), F.sum(weight), F.sum("n")).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) // CELLS))
    cell = F.coalesce(F.expr(f"page_id div {width}L"), F.lit(1 << 62))
    each = max(1, -(-total // shards)) if shards and total else max(each, -(-(total or 0) // MOST_SHARDS))
    out, shard, held = [], 0, 0
    for c, w in sorted(keys.groupBy(cell.alias("cell")).agg(F.sum(weight).alias("w")).collect()):
        if held and held + w > each:
            shard, held = shard + 1, 0
        many = -(-w // each) if w > each else 1
        out.append((c, shard, many))
        if many > 1:
            shard, held = shard + many, 0
        else:
            held += w
    return cell, out, rows or 0


def sorted_records(workspace: Workspace, pages: DataFrame, shards: int | None = None, least: int = 0) -> DataFrame:
    """Rows by shard and key: a key's payload (kind 0), then its runs of records (kind 1: the first number, and how many)."""
    spark = pages.sparkSession
    rows = payloads(pages)
    keys = workspace.table(roles(rows, least), "keys")
    cell, found, total = cells_of(keys, SHARD_BYTES, shards)
    borders = F.broadcast(spark.createDataFrame(found, "cell long, shard long, many long"))  # at most CELLS + 3 rows
    # a heavy key's payload is wanted once, so its rows meet in partial aggregates; there are at most HEAVY such keys
    heavy = keys.where((F.col("n") * HEAVY > total) & (F.col("n") > 1)).select(*(F.col(k).alias(f"heavy_{k}") for k in KEY))
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"heavy_{k}"))
    once = rows.join(F.broadcast(heavy), same, "left_semi").groupBy(*KEY).agg(F.min("html").alias("html"))
    body = rows.join(F.broadcast(heavy), same, "left_anti").unionByName(once).withColumns({"kind": F.lit(0), "number": F.lit(0).cast("long")})
    runs = keys.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).withColumn("n", F.least(F.col("n") - F.col("number"), F.lit(CHUNK).cast("long"))).withColumn("kind", F.lit(1))
    both = body.unionByName(runs, allowMissingColumns=True).withColumn("cell", cell).join(borders, "cell")
    dealt = F.pmod(F.xxhash64("url", "digest", F.when(F.coalesce("small", F.lit(False)), 0).otherwise(F.col("number"))), "many")
    order = ["shard", F.col("page_id").isNull(), "page_id", "url", "digest", "kind", "number"]
    number = max([shard + many for _, shard, many in found], default=1)
    return both.withColumn("shard", F.col("shard") + dealt).drop("cell", "many").repartitionByRange(number, "shard").sortWithinPartitions(*order)


@dataclass
class _Roll:
    files: object
    folder: str
    shard: int
    attempt: str
    sequence: int = -1
    out: object = None

    def open(self):
        self.sequence += 1
        self.name = f"part-{self.shard:06d}-{self.sequence:04d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{self.attempt}"
        self.out = self.files.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.records = self.bytes = 0
        self.sha = hashlib.sha256()
        self.write(_block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def write(self, record: bytes):
        data = _member(record)
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self):
        self.out.close()
        self.out = None
        return {"shard": self.shard, "sequence": self.sequence, "name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def write(spark: SparkSession, pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shards: int | None = None, least: int = 0) -> DataFrame:
    """Write the archives into `folder` (a URI that driver and executors share) and return their manifest.

    The same rows give the same files. A failed or repeated attempt leaves only temporary files, which go at the end;
    the manifest names every archive. Null pages and addresses are written without them, a null html is an empty payload,
    an empty table makes no file. Equal rows, and rows with equal payloads of `least` bytes, are revisits of the first.
    """
    from pyarrow import fs

    kind = pa.schema([("shard", pa.int32()), ("sequence", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        to, payload, of = None, None, None
        for b in batches:
            for r in b.to_pylist():
                key = r["page_id"], r["url"], r["digest"]
                if r["kind"] == 0:
                    if of != key:
                        payload, of = r["html"].encode("utf-8"), key
                    continue
                if to is None or to.shard != r["shard"]:
                    if to is not None and to.out is not None:
                        yield pa.RecordBatch.from_pylist([to.close()], kind)
                    to = _Roll(files, root, r["shard"], attempt)
                for number in range(r["number"], r["number"] + r["n"]):
                    if to.out is None:
                        to.open()
                    response = r["small"] or (r["is_first"] and number == 0)
                    if response and of != key:
                        raise ValueError(f"page {r['page_id']} has no payload")
                    to.write(page_record(r["page_id"], r["url"], number, r["digest"], r["length"], payload if response else None, (r["first_page"], r["first_url"])))
                    if to.bytes >= roll:
                        yield pa.RecordBatch.from_pylist([to.close()], kind)
        if to is not None and to.out is not None:
            yield pa.RecordBatch.from_pylist([to.close()], kind)

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{root}/_temporary", recursive=True)
    with Workspace(spark, "warc") as workspace:
        manifest = written(sorted_records(workspace, pages, shards, least).mapInArrow(run, MANIFEST), "warc-manifest")
    _commit(manifest, folder)
    files.delete_dir(f"{root}/_temporary")
    return manifest


def _commit(manifest: DataFrame, folder: str) -> None:
    """Rename each file that the manifest names; a renaming that was done before is left."""

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if files.get_file_info(f"{root}/{r['temporary']}").type != fs.FileType.NotFound:
                    files.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
                if files.get_file_info(f"{root}/{r['name']}").size != r["bytes"]:
                    raise OSError(f"{r['name']} is not whole")
            yield pa.RecordBatch.from_pydict({"done": pa.array([batch.num_rows], pa.int64())})

    manifest.mapInArrow(run, "done long").agg(F.sum("done")).collect()


def parse(stream):
    """(type, headers, body) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        body = stream.read(int(head["content-length"]))
        yield head.get("warc-type"), head, body


def _long(x):
    return int(x) if x is not None else None


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each page record: digests of responses are taken from their payloads and held against the headers."""
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                out = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for what, head, body in parse(stream):
                        if what not in ("response", "revisit"):
                            continue
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        http, _, payload = body.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                        if what == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{name}: {head['warc-record-id']} does not have the payload of its digest")
                        out.append({"page_id": _long(head.get("x-page-id")), "payload_bytes": size, "payload_digest": digest, "record_type": what, "refers_to": _long(head.get("x-refers-to-page-id"))})
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_pylist(out, kind)
                            out = []
                yield pa.RecordBatch.from_pylist(out, kind)

    names = manifest.select("name")
    return names.repartition(max(1, names.count())).mapInArrow(run, RECORDS)


def op9_warc(spark, sf_dir):
    """A null html is an empty payload; repeated rows are records of their own, the first of them the response. The
    archives are read back when the result is; they go when the driver ends."""
    folder = fresh_path(spark, "warc-archives")
    manifest = write(spark, table(spark, sf_dir, "pages"), folder)
    until_exit(spark, folder)
    return read(spark, manifest, folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(p.h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
