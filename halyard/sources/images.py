"""Image files as tables: discovery, fingerprints, pixels and capture metadata."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("jpg", "jpeg", "png", "webp")
#: Exif tags: orientation, time of capture, its offset (fixed values).
ORIENTATION, CAPTURED, OFFSET, EXIF = 0x0112, 0x9003, 0x9011, 0x8769


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, filename, size, mtime, fingerprint and status (supported or unsupported) of all files under root.

    The fingerprint follows path, size and time (to the millisecond), so it misses edits that keep all three.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    stamp = F.unix_millis("modificationTime") * 1000000
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size"), "modificationTime",
        F.sha2(F.to_json(F.struct(stamp.alias("mtime_ns"), "path", F.col("length").alias("size"))), 256).alias("fingerprint"),
        F.when(suffix.isin(*SUFFIXES), "supported").otherwise("unsupported").alias("status"),
    )


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path, content hash and capture metadata of the supported files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)).select("path", F.sha2("content", 256).alias("sha256"), "content")
    kind = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("orientation", pa.int32()), ("capture_time", pa.string()), ("capture_timezone", pa.string())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"path": r["path"], "sha256": r["sha256"]} | exif(r["content"]) for r in batch.to_pylist()], kind)

    return files.mapInArrow(run, "path string, sha256 string, orientation int, capture_time string, capture_timezone string")


def images(spark: SparkSession, root: str) -> DataFrame:
    """id (the path) and image of the image source; files that it can't decode have an image of height -1."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(root).select(F.col("image.origin").alias("id"), "image")


def exif(data: bytes) -> dict:
    """orientation, capture_time (ISO, naive) and capture_timezone of a JPEG or PNG; 1 and nulls where there are none."""
    out = {"orientation": 1, "capture_time": None, "capture_timezone": None}
    block = _block(data)
    if block is None:
        return out
    try:
        order = {b"II": "<", b"MM": ">"}[block[:2]]
        tags = _tags(block, order, struct.unpack(order + "I", block[4:8])[0])
        if EXIF in tags:
            tags |= _tags(block, order, tags[EXIF])
    except (KeyError, struct.error, IndexError):
        return out
    if tags.get(ORIENTATION) in range(1, 9):
        out["orientation"] = tags[ORIENTATION]
    if m := re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", str(tags.get(CAPTURED, ""))):
        out["capture_time"] = "{}-{}-{}T{}:{}:{}".format(*m.groups())
    if tags.get(OFFSET):
        out["capture_timezone"] = str(tags[OFFSET])[:8]
    return out


def _block(data: bytes) -> bytes | None:
    """The TIFF structure of the metadata."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if data[at + 1] == 0xDA:
                return None
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = struct.unpack(">I", data[at : at + 4])[0]
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _tags(block: bytes, order: str, at: int) -> dict:
    out = {}
    for k in range(struct.unpack(order + "H", block[at : at + 2])[0]):
        entry = block[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind == 3:
            out[tag] = struct.unpack(order + "H", entry[8:10])[0]
        elif kind == 4:
            out[tag] = struct.unpack(order + "I", entry[8:12])[0]
        elif kind == 2:
            start = struct.unpack(order + "I", entry[8:12])[0]
            raw = entry[8 : 8 + count] if count <= 4 else block[start : start + count]
            out[tag] = raw.split(b"\0")[0].decode("ascii", "replace")
    return out


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) that the header of a JPEG, PNG or WEBP states, before anything is decoded; else null."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    return None


def too_large(files: DataFrame, most: int = 80_000_000) -> DataFrame:
    """path, width, height of files (path, content) whose header states more than `most` pixels; they need not be decoded."""
    kind = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32())])

    def run(batches):
        for batch in batches:
            found = [(r["path"], dimensions(r["content"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{"path": p, "width": d[0], "height": d[1]} for p, d in found if d and d[0] * d[1] > most], kind)

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int")
