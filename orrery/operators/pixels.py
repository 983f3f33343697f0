"""Measures of decoded images, in Arrow batches of numpy arrays: brightness, sharpness, hashes, structural similarity, colours.

Images come from Spark's own decoder (height, width, channels, bytes in the order
blue, green, red), so no image library is needed. Hashes use a bilinear reduction
and are not those of other libraries bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THUMB = 160
#: Window and spread of structural similarity.
SSIM_WINDOW, SSIM_SIGMA = 11, 1.5


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, width, height, channels, pixels)`` of the images below ``folder``; those that cannot be decoded have a null width."""
    d = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder).select("image.*")
    ok = F.col("width") > 0
    return d.select(F.col("origin").alias("path"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"), F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))


def as_array(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """(height, width, 3) of red, green, blue."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def reduced(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with the filter widened by the reduction."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        centre = (np.arange(m) + 0.5) * n / m
        w = np.maximum(0.0, 1 - np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale)
        return w / w.sum(axis=1, keepdims=True)

    return weights(x.shape[0], height) @ x @ weights(x.shape[1], width).T


def thumb(rgb: np.ndarray, side: int = THUMB) -> np.ndarray:
    return reduced(gray(rgb), side, side)


def sharpness(x: np.ndarray) -> float:
    """Variance of the Laplacian (four neighbours, edges mirrored)."""
    p = np.pad(x, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())


def perceptual_hash(rgb: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """64 bits: which low frequencies of a reduced image lie above their median; the first bit is the highest."""
    n = size * factor
    k = np.arange(n)
    cosines = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (cosines @ reduced(gray(rgb), n, n) @ cosines.T)[:size, :size]
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def ssim(a: np.ndarray, b: np.ndarray, span: float = 255.0) -> float:
    """Mean structural similarity of two gray images of one size, over windows that lie within them."""
    at = np.arange(SSIM_WINDOW) - SSIM_WINDOW // 2
    w = np.exp(-(at**2) / (2 * SSIM_SIGMA**2))
    w /= w.sum()
    a, b = a.astype(np.float64), b.astype(np.float64)

    def blurred(x: np.ndarray) -> np.ndarray:
        rows = sum(c * x[i : x.shape[0] - SSIM_WINDOW + 1 + i] for i, c in enumerate(w))
        return sum(c * rows[:, i : x.shape[1] - SSIM_WINDOW + 1 + i] for i, c in enumerate(w))

    ma, mb = blurred(a), blurred(b)
    va, vb, cov = blurred(a * a) - ma * ma, blurred(b * b) - mb * mb, blurred(a * b) - ma * mb
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value from 0 to 1."""
    x = rgb.astype(np.float64) / 255.0
    top, low = x.max(axis=-1), x.min(axis=-1)
    d = top - low
    safe = np.where(d > 1e-12, d, 1.0)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.where(d > 1e-12, h, 0.0), np.where(top > 1e-12, d / np.maximum(top, 1e-12), 0.0), top


#: Centres of hue bands, their half-width, and least saturation and value.
HUES = {"yellow": (1 / 6, 0.25, 0.35), "red": (0.0, 0.25, 0.35), "green": (1 / 3, 0.25, 0.25), "blue": (2 / 3, 0.25, 0.25)}
BAND = 0.06


def colour_shares(rgb: np.ndarray) -> dict[str, float]:
    """The share of pixels that are white, black, yellow, red, green and blue."""
    h, s, v = hsv(rgb)
    out = {"white": (s <= 0.20) & (v >= 0.85), "black": v <= 0.12}
    for name, (centre, least_s, least_v) in HUES.items():
        away = np.abs((h - centre + 0.5) % 1.0 - 0.5)
        out[name] = (away <= BAND) & (s >= least_s) & (v >= least_v)
    return {k: float(m.mean()) if m.size else 0.0 for k, m in out.items()}


def measured(images: DataFrame, key: str = "path") -> DataFrame:
    """``(key, width, height, brightness, sharpness, phash)``: means of a gray thumb, three places; null where the image could not be decoded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for k, w, h, c, data in zip(d[key], d["width"], d["height"], d["channels"], d["pixels"]):
                if data is None or not (w and w > 0):
                    rows.append((k, None, None, None, None, None))
                    continue
                rgb = as_array(int(w), int(h), int(c), data)
                t = thumb(rgb)
                rows.append((k, int(w), int(h), round(float(t.mean()), 3), round(sharpness(t), 3), perceptual_hash(rgb)))
            out = pd.DataFrame(rows, columns=[key, "width", "height", "brightness", "sharpness", "phash"])
            for c in ("width", "height", "phash"):
                out[c] = pd.array([None if x is None or x != x else int(x) for x in (r[["width", "height", "phash"].index(c) + (1 if c != "phash" else 3)] for r in rows)], dtype="Int64")
            yield out

    kind = dict(images.dtypes)[key]
    return images.select(key, "width", "height", "channels", "pixels").mapInPandas(run, f"`{key}` {kind}, width int, height int, brightness double, sharpness double, phash long")


def refined(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``ssim`` of the gray thumbs in columns ``a`` and ``b`` (arrays of side x side numbers)."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            n = int(len(p) ** 0.5)
            out.append(ssim(np.asarray(p, float).reshape(n, n), np.asarray(q, float).reshape(n, n)))
        return pd.Series(out, dtype=float)

    return pairs.withColumn("ssim", F.pandas_udf(run, "double")(F.col(a), F.col(b)))


def best_by_ssim(candidates: DataFrame, thumbs: DataFrame, query: str = "q", ref: str = "r") -> DataFrame:
    """``(q, r, ssim)``: of each query's candidates the most similar, ties to the nearest by rank; thumbs are (id, thumb)."""
    from pyspark.sql import Window

    t = lambda s: thumbs.select(F.col("id").alias(s), F.col("thumb").alias(f"_{s}"))
    d = refined(candidates.join(t(query), query).join(t(ref), ref), f"_{query}", f"_{ref}").drop(f"_{query}", f"_{ref}")
    w = Window.partitionBy(query).orderBy(F.desc("ssim"), "rank")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(query, ref, "ssim")


def masked_geometry(points: np.ndarray, box: np.ndarray) -> dict[str, float]:
    """Of a polygon and its box, in pixels: share of the box, circularity, solidity, aspect ratio, by the polygon itself rather than by a drawn mask."""
    x, y = points[:, 0], points[:, 1]
    area = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
    length = float(np.hypot(np.diff(np.append(x, x[0])), np.diff(np.append(y, y[0]))).sum())
    hull = _hull_area(points)
    w, h = float(np.ptp(x)), float(np.ptp(y))
    size = max(float((box[2] - box[0]) * (box[3] - box[1])), 1e-12)
    return {"mask_per_box": area / size, "mask_circularity": 4 * np.pi * area / length**2 if length else 0.0, "mask_solidity": area / hull if hull else 0.0, "mask_ar": max(w, h) / max(min(w, h), 1e-12)}


def _hull_area(points: np.ndarray) -> float:
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return 0.0

    def chain(q: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out

    ring = np.array(chain(p)[:-1] + chain(p[::-1])[:-1])
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
