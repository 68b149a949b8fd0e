"""Measures and hashes of decoded images: NumPy kernels behind one Arrow map. Pixels never leave their task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EDGE = 1024
#: Luma weights of red, green and blue (fixed values).
LUMA = np.array([0.299, 0.587, 0.114])


def _lanczos(x):
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _triangle(x):
    return np.maximum(1 - np.abs(x), 0)


def _weights(n: int, m: int, kernel, support: float) -> np.ndarray:
    """m x n matrix that resamples n values to m, widening the kernel when it shrinks."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    w = kernel((np.arange(n)[None, :] - centre[:, None]) / scale)
    w[np.abs(np.arange(n)[None, :] - centre[:, None]) > support * scale] = 0
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, smooth: bool = True) -> np.ndarray:
    kernel, support = (_lanczos, 3.0) if smooth else (_triangle, 1.0)
    a, b = _weights(image.shape[0], height, kernel, support), _weights(image.shape[1], width, kernel, support)
    out = np.tensordot(a, image.astype(float), (1, 0))
    return np.clip(np.moveaxis(np.tensordot(b, out, (1, 1)), 0, 1), 0, 255)


def reduced(rgb: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """The image within edge x edge; never enlarged."""
    h, w = rgb.shape[:2]
    if max(h, w) <= edge:
        return rgb.astype(float)
    f = edge / max(h, w)
    return resize(rgb, max(1, round(h * f)), max(1, round(w * f)))


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(float) @ LUMA


def _pad(g, r):
    return np.pad(g, r, mode="reflect") if min(g.shape) > r else np.pad(g, r, mode="edge")


def _slide(g, kernel):
    """Correlation with a square kernel; the border is mirrored without its edge."""
    r = kernel.shape[0] // 2
    p = _pad(g, r)
    out = np.zeros_like(g)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * p[i : i + g.shape[0], j : j + g.shape[1]]
    return out


def blurred(g: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(round(4 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = _pad(g, r)
    rows = sum(k[i] * p[i : i + g.shape[0]] for i in range(2 * r + 1))
    return sum(k[i] * rows[:, i : i + g.shape[1]] for i in range(2 * r + 1))


LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)


def measures(rgb: np.ndarray) -> dict[str, float]:
    """Raw measures of an RGB image of at most EDGE a side."""
    g = gray(rgb)
    p = np.histogram(g, 256, (0, 256))[0] / g.size
    p = p[p > 0]
    smooth = blurred(g)
    flat = np.hypot(_slide(smooth, SOBEL), _slide(smooth, SOBEL.T)) < 10
    residual = (g - smooth)[flat]
    r, gr, b = (rgb[..., i].astype(float) for i in range(3))
    rg, yb = r - gr, (r + gr) / 2 - b
    low, high = np.percentile(g, [5, 95])
    return {
        "laplacian_variance": _slide(g, LAPLACE).var(), "mean_luminance": g.mean() / 255, "underexposed": (g < 16).mean(), "overexposed": (g > 240).mean(),
        "low_clipping": (g <= 1).mean(), "high_clipping": (g >= 254).mean(), "channel_clipping": ((rgb <= 1) | (rgb >= 254)).mean(),
        "contrast_p95_p5": high - low, "entropy_bits": float(-(p * np.log2(p)).sum()), "noise": float(np.median(np.abs(residual - np.median(residual)))) if len(residual) else 0.0,
        "colorfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())),
    }


def _bits(flags: np.ndarray) -> tuple[int, int]:
    hi, lo = np.packbits(flags.ravel()).view(">u4").tolist()
    return hi, lo


def hashes(rgb: np.ndarray) -> dict[str, int]:
    """Average, difference and frequency hashes, in halves, the first pixel in the highest bit."""
    g = gray(rgb)
    a = resize(g, 8, 8)
    d = resize(g, 8, 9)
    s = resize(g, 32, 32)
    n = np.arange(32)
    dct = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 64) * np.sqrt(2 / 32)
    dct[0] /= np.sqrt(2)
    f = (dct @ s @ dct.T)[:8, :8]
    p = f > np.median(f.ravel()[1:])
    p[0, 0] = False
    out = {}
    for name, flags in (("p", p), ("d", d[:, 1:] > d[:, :-1]), ("a", a > a.mean())):
        out[f"{name}_hi"], out[f"{name}_lo"] = _bits(flags)
    return out


def verification(rgb: np.ndarray) -> tuple[list[float], list[float]]:
    """A centred unit vector of 32 x 32 grays, and the mean colour less its mean."""
    g = resize(gray(rgb), 32, 32).ravel()
    g -= g.mean()
    n = np.linalg.norm(g)
    colour = rgb[..., :3].reshape(-1, 3).mean(0) / 255
    return (g / n if n > 1e-6 else np.zeros_like(g)).tolist(), (colour - colour.mean()).tolist()


_RAW = ("laplacian_variance", "mean_luminance", "underexposed", "overexposed", "low_clipping", "high_clipping", "channel_clipping", "contrast_p95_p5", "entropy_bits", "noise", "colorfulness")
_HASH = ("p_hi", "p_lo", "d_hi", "d_lo", "a_hi", "a_lo")
SCHEMA = "id string, width int, height int, " + ", ".join(f"{c} double" for c in _RAW) + ", " + ", ".join(f"{c} long" for c in _HASH) + ", gray array<double>, chroma array<double>, error string"


def measured(id_, rgb: np.ndarray) -> dict:
    small = reduced(rgb)
    g, c = verification(small)
    return {"id": id_, "width": rgb.shape[1], "height": rgb.shape[0], "gray": g, "chroma": c, "error": None} | {k: float(v) for k, v in measures(small).items()} | hashes(small)


def measure_images(images: DataFrame) -> DataFrame:
    """A feature row for each row of the image source (id, image); what can't be decoded or measured has an error instead."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(images.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    im = row["image"]
                    if im is None or im["height"] <= 0:
                        raise ValueError("not an image that can be decoded")
                    a = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], im["nChannels"])
                    rgb = a[..., 2::-1] if im["nChannels"] >= 3 else np.repeat(a[..., :1], 3, axis=2)
                    out.append(measured(row["id"], rgb))
                except Exception as e:  # one image's failure is that image's row
                    out.append({"id": row["id"], "error": f"{type(e).__name__}: {e}"[:2000]})
            yield pa.RecordBatch.from_pylist(out, kind)

    return images.select("id", "image").mapInArrow(run, SCHEMA)


def scene(seed: int, edge: int = 64) -> np.ndarray:
    """A seeded picture: rectangles on a gradient, with noise."""
    pick = np.random.default_rng(seed)
    x = np.linspace(0, 1, edge)
    a = np.stack([np.outer(x, 1 - x) * 400 * pick.random() + 60 * pick.random() for _ in range(3)], axis=-1)
    for _ in range(24):
        i, j = pick.integers(0, edge, 2)
        a[i : i + pick.integers(2, edge // 2), j : j + pick.integers(2, edge // 2)] = pick.integers(0, 256, 3)
    return np.clip(a + pick.normal(0, 3, a.shape), 0, 255).astype(np.uint8)


def oriented(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The picture upright, from its metadata's orientation (1 to 8)."""
    if orientation in (5, 6, 7, 8):
        rgb = rgb.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        rgb = rgb[:, ::-1]
    if orientation in (3, 4, 7, 8):
        rgb = rgb[::-1]
    return rgb


def png(rgb: np.ndarray) -> bytes:
    """An RGB picture as PNG."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    a = np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(a[..., :3]))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def thumbnails(images: DataFrame, edge: int = 512) -> DataFrame:
    """id, png and error of small copies, at most `edge` a side."""
    kind = pa.schema([("id", pa.string()), ("png", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                im = row["image"]
                if im is None or im["height"] <= 0:
                    out.append({"id": row["id"], "png": None, "error": "ValueError: not an image that can be decoded"})
                    continue
                a = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], im["nChannels"])
                out.append({"id": row["id"], "png": png(reduced(a[..., 2::-1] if im["nChannels"] >= 3 else np.repeat(a[..., :1], 3, axis=2), edge)), "error": None})
            yield pa.RecordBatch.from_pylist(out, kind)

    return images.select("id", "image").mapInArrow(run, "id string, png binary, error string")
