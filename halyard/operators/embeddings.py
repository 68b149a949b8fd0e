"""Embeddings by a given model: preprocessing, batches on the executors, checks of what comes back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pixels import resize


def prepared(rgb: np.ndarray, edge: int, crop: int, mean, std, smooth: bool = False) -> np.ndarray:
    """The centre crop of the image whose shorter side is made `edge`, normalised, channels first."""
    h, w = rgb.shape[:2]
    f = edge / min(h, w)
    a = resize(rgb, max(crop, round(h * f)), max(crop, round(w * f)), smooth)
    i, j = (a.shape[0] - crop) // 2, (a.shape[1] - crop) // 2
    return ((a[i : i + crop, j : j + crop, :3] / 255 - np.asarray(mean)) / np.asarray(std)).transpose(2, 0, 1).astype(np.float32)


def checked(vectors: np.ndarray, dimensions: int) -> list[str | None]:
    """What is wrong with each vector: its size, values that are not finite, or a length that is not 1."""
    out: list[str | None] = []
    for v in vectors:
        v = np.asarray(v)
        if v.shape != (dimensions,):
            out.append("wrong size")
        elif not np.isfinite(v).all():
            out.append("not finite")
        else:
            out.append(None if abs(np.linalg.norm(v) - 1) <= 1e-4 else "not of length 1")
    return out


def encode(images: DataFrame, load: Callable[[], Callable[[list], np.ndarray]], dimensions: int, batch: int = 16) -> DataFrame:
    """id, vector, error for rows of id and image; load() makes the model once a task, and it gets `batch` images at a time.

    To use a cache, encode only what operators.incremental.missing() finds, and upsert. One bad image fails alone.
    """
    kind = pa.schema([("id", pa.string()), ("vector", pa.list_(pa.float32())), ("error", pa.string())])

    def run(batches):
        model = load()
        for b in batches:
            rows = b.to_pylist()
            for at in range(0, len(rows), batch):
                out, good, arrays = [], [], []
                for r in rows[at : at + batch]:
                    im = r["image"]
                    if im is None or im["height"] <= 0:
                        out.append({"id": r["id"], "vector": None, "error": "not an image that can be decoded"})
                    else:
                        a = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], im["nChannels"])
                        good.append(r["id"])
                        arrays.append(a[..., 2::-1] if im["nChannels"] >= 3 else np.repeat(a[..., :1], 3, axis=2))
                if good:
                    found = model(arrays)
                    for i, v, wrong in zip(good, found, checked(found, dimensions)):
                        out.append({"id": i, "vector": None if wrong else np.asarray(v, np.float32).tolist(), "error": wrong})
                yield pa.RecordBatch.from_pylist(out, kind)

    return images.select("id", "image").mapInArrow(run, "id string, vector array<float>, error string")
