import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import pixels
from halyard.sources import images
from halyard.streaming import sessions


def png(a: np.ndarray, exif: bytes = b"") -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(orientation=6, taken="2025:01:02 03:04:05", offset="-06:00"):
    text = [taken.encode() + b"\0", offset.encode() + b"\0"]
    first = struct.pack("<H", 2) + struct.pack("<HHIHH", images.ORIENTATION, 3, 1, orientation, 0) + struct.pack("<HHII", images.EXIF, 4, 1, 38) + struct.pack("<I", 0)
    base = 38 + 2 + 24 + 4
    second = struct.pack("<H", 2) + struct.pack("<HHII", images.CAPTURED, 2, len(text[0]), base) + struct.pack("<HHII", images.OFFSET, 2, len(text[1]), base + len(text[0])) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + first + second + b"".join(text)


def test_exif():
    got = images.exif(png(np.zeros((2, 2, 3), np.uint8), tiff()))
    assert got == {"orientation": 6, "capture_time": "2025-01-02T03:04:05", "capture_timezone": "-06:00"}
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff()) + 8) + b"Exif\0\0" + tiff() + b"\xff\xda"
    assert images.exif(jpeg) == got
    for bad in (b"", b"\xff\xd8", b"text", png(np.zeros((2, 2, 3), np.uint8), b"II*\0")):
        assert images.exif(bad) == {"orientation": 1, "capture_time": None, "capture_timezone": None}


def test_files_to_features(spark, tmp_path):
    a = pixels.scene(5, 96)
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.png").write_bytes(png(a))
    (tmp_path / "sub" / "copy.PNG").write_bytes(png(a))
    (tmp_path / "broken.jpg").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_text("x")
    root = "file://" + str(tmp_path)
    status = {r.filename: r.status for r in images.discover(spark, root).collect()}
    assert status == {"one.png": "supported", "copy.PNG": "supported", "broken.jpg": "supported", "note.txt": "unsupported"}
    assert images.contents(spark, root).where(F.col("path").endswith("ng") | F.col("path").endswith("NG")).select("sha256").distinct().count() == 1
    got = {r.id.rpartition("/")[2]: r for r in pixels.measure_images(images.images(spark, root)).collect()}
    assert got["broken.jpg"].error and got["one.png"].error is None
    assert got["one.png"].p_hi == got["copy.PNG"].p_hi and got["one.png"].width == 96
    assert got["one.png"].laplacian_variance == pytest.approx(pixels.measures(a)["laplacian_variance"])


def test_measures_follow_the_picture():
    board = np.kron(np.indices((16, 16)).sum(0) % 2, np.ones((8, 8)))[..., None].repeat(3, 2) * 200 + 20
    soft = np.stack([pixels.blurred(board[..., 0], 3)] * 3, -1)
    m = pixels.measures
    assert m(board)["laplacian_variance"] > 5 * m(soft)["laplacian_variance"]
    flat = lambda v: np.full((32, 32, 3), float(v))
    assert m(flat(4))["underexposed"] == 1 and m(flat(251))["overexposed"] == 1 and m(flat(128))["entropy_bits"] == 0
    noisy = flat(128) + np.random.default_rng(0).normal(0, 8, (32, 32, 3))
    assert m(noisy)["noise"] > 1 > m(flat(128))["noise"]
    assert m(np.dstack([board[..., 0], board[..., 1] * 0, board[..., 2] * 0]))["colorfulness"] > m(board)["colorfulness"]


def test_hashes_survive_resizing_and_tell_pictures_apart():
    a, b = pixels.scene(1, 128), pixels.scene(2, 128)
    bits = lambda x: np.array([x["p_hi"], x["p_lo"]], np.uint64)
    near = lambda x, y: sum(bin(int(v)).count("1") for v in bits(x) ^ bits(y))
    small = pixels.resize(a, 96, 96)
    assert near(pixels.hashes(a), pixels.hashes(small)) <= 4 < near(pixels.hashes(a), pixels.hashes(b))
    g, c = pixels.verification(a)
    assert np.linalg.norm(g) == pytest.approx(1) and sum(c) == pytest.approx(0)
    assert pixels.reduced(a, 64).shape == (64, 64, 3) and pixels.reduced(a, 999).shape == a.shape


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, t * 3000 + u) for u in range(5) for t in (0, 1, 2, 9, 10, 30)]
    df = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "in")
    df.write.parquet(path)
    batch = {tuple(r) for r in sessions.sessions(df).collect()}
    stream = sessions.sessions(spark.readStream.schema(df.schema).parquet(path))
    assert {tuple(r) for r in sessions.drained(stream).collect()} == batch and len(batch) == 15


def test_incremental_stream_adds_nothing_twice(spark, tmp_path):
    source, store = str(tmp_path / "in"), "file://" + str(tmp_path / "store")
    spark.range(5).write.parquet(source)
    run = lambda n: sessions.incremental(spark, spark.readStream.schema("id long").parquet(source), store, ["id"], lambda x: x, "file://" + str(tmp_path / f"ck{n}")).awaitTermination()
    run(0)
    spark.range(3, 9).write.mode("append").parquet(source)
    run(1)
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == list(range(9))
