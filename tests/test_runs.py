import struct

import numpy as np
from pyspark.sql import functions as F

from halyard.operators import pixels, runs
from halyard.sources import images
from tests.test_media import png


def test_limits_and_pages(spark):
    df = spark.createDataFrame([("s", i, 10 if i != 2 else 99) for i in range(6)], "k string, i int, size long")
    got = [r.accepted for r in runs.within_limits(df, ["k"], ["i"], 3, 50, 1000).orderBy("i").collect()]
    assert got == [True, True, False, True, False, False]
    assert [r.i for r in runs.page(df, ["i"], 2, 1).collect()] == [2, 3]


def test_failures(spark):
    df = spark.createDataFrame([("a", None), ("b", "ValueError: " + "x" * 3000)], "id string, error string")
    r = runs.failures(df, "r", "decode").first()
    assert (r.path, r.type, len(r.message)) == ("b", "ValueError", 2000)


def test_headers_orientation_and_thumbnails(spark, tmp_path):
    a = pixels.scene(3, 40)[:30]
    assert images.dimensions(png(a)) == images.dimensions(pixels.png(a)) == (40, 30)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 7, 9, 1) + b"xyz"
    assert images.dimensions(jpeg) == (9, 7) and images.dimensions(b"RIFF") is None
    turned = {o: pixels.oriented(a, o) for o in range(1, 9)}
    assert turned[6].shape == (40, 30, 3) and (turned[3] == a[::-1, ::-1]).all() and (turned[8] == a.transpose(1, 0, 2)[::-1]).all() and (turned[6] == a.transpose(1, 0, 2)[:, ::-1]).all()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(a))
    (tmp_path / "in" / "bad.png").write_bytes(b"x")
    files = spark.read.format("binaryFile").load("file://" + str(tmp_path / "in"))
    assert images.too_large(files, 1199).count() == 1 and images.too_large(files, 1200).count() == 0
    got = {r.id.rpartition("/")[2]: r for r in pixels.thumbnails(images.images(spark, "file://" + str(tmp_path / "in")), 20).collect()}
    assert images.dimensions(bytes(got["a.png"].png)) == (20, 15) and got["bad.png"].error
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "t.png").write_bytes(pixels.png(a))
    back = images.images(spark, "file://" + str(tmp_path / "out")).select(F.col("image.data").alias("d")).first().d
    assert (np.frombuffer(back, np.uint8).reshape(30, 40, 3)[..., ::-1] == a).all()
