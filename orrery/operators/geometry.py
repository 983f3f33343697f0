"""Crop rectangles, letterboxes, boxes of keypoints and polygon areas, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def crop(x1: Column, y1: Column, w: Column, h: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """Struct left, top, right, bottom in whole pixels of the box with a margin (share of its sides), cut at the image; null where nothing is left."""
    left = F.greatest(F.lit(0), F.floor(x1 - margin * w))
    top = F.greatest(F.lit(0), F.floor(y1 - margin * h))
    right = F.least(width, F.ceil(x1 + w + margin * w))
    bottom = F.least(height, F.ceil(y1 + h + margin * h))
    whole = F.struct(*(c.cast("long").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))))
    return F.when((right > left) & (bottom > top), whole)


def square(x1: Column, y1: Column, w: Column, h: Column, width: Column, height: Column, margin: float = 0.0, margin_px: float = 0.0) -> Column:
    """Struct left, top, right, bottom of the square about the box with its margins, no larger than the image and slid inside; null where nothing is left."""
    side = F.least(F.greatest(w * (1 + 2 * margin), h * (1 + 2 * margin)) + 2 * margin_px, width, height)
    left = F.least(F.greatest(x1 + w / 2 - side / 2, F.lit(0.0)), width - side)
    top = F.least(F.greatest(y1 + h / 2 - side / 2, F.lit(0.0)), height - side)
    out = F.struct(*(c.cast("long").alias(n) for c, n in ((left, "left"), (top, "top"), (left + side, "right"), (top + side, "bottom"))))
    return F.when((out["right"] > out["left"]) & (out["bottom"] > out["top"]), out)


def letterbox(w: Column, h: Column, to_w: int, to_h: int) -> Column:
    """Struct scale, w, h, pad_x, pad_y that fits ``w`` x ``h`` into a frame.

    Sides are rounded half to even and at least a pixel; the pads lie left and
    above.
    """
    scale = F.least(F.lit(float(to_w)) / w, F.lit(float(to_h)) / h)
    nw, nh = (F.greatest(F.lit(1), F.bround(x * scale)).cast("long") for x in (w, h))
    pad = lambda to, n: F.floor((F.lit(to) - n) / 2).cast("long")
    return F.struct(scale.alias("scale"), nw.alias("w"), nh.alias("h"), pad(to_w, nw).alias("pad_x"), pad(to_h, nh).alias("pad_y"))


#: What a side's target bounds: the long or the short side, always or only where it is larger; or a square.
RESIZES = ("none", "long", "short", "cap-long", "cap-short", "square")


def resized(w: Column, h: Column, mode: str, size: int | None = None, square_mode: str = "pad") -> Column:
    """Struct w, h after resizing (rounded half to even, a pixel at least); a square is padded or cropped from its long side's size, or distorted."""
    if mode not in RESIZES or square_mode not in ("pad", "crop", "distort"):
        raise ValueError(f"unknown resize {mode} {square_mode}")
    as_is = F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"))
    if mode == "none" or size is None:
        return as_is
    if mode == "square" and square_mode == "distort":
        return F.struct(F.lit(size).cast("long").alias("w"), F.lit(size).cast("long").alias("h"))
    by = F.least(w, h) if mode in ("short", "cap-short") else F.greatest(w, h)
    scale = F.lit(float(size)) / by
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale)).cast("long")
    new = F.struct(side(w).alias("w"), side(h).alias("h"))
    return F.when(by <= size, as_is).otherwise(new) if mode.startswith("cap") else new


def clip(ring: np.ndarray, box: np.ndarray) -> np.ndarray:
    """(n, 2) points of a ring's part within x1, y1, x2, y2: cut by one side's line after another (Sutherland and Hodgman); repeated points go."""
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(ring):
            break
        before = np.roll(ring, 1, axis=0)
        inside, was = sign * ring[:, axis] >= sign * limit, sign * before[:, axis] >= sign * limit
        d = ring[:, axis] - before[:, axis]
        at = np.where(d == 0, 0.0, (limit - before[:, axis]) / np.where(d == 0, 1.0, d))
        crossing = before + at[:, None] * (ring - before)
        crossing[:, axis] = limit
        both = np.stack([crossing, ring], axis=1).reshape(-1, 2)
        ring = both[np.stack([inside != was, inside], axis=1).ravel()]
    keep = np.any(ring != np.roll(ring, 1, axis=0), axis=1) if len(ring) > 1 else np.ones(len(ring), bool)
    return ring[keep]


def clipped(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The ring (x, y)* of a polygon's part within a rectangle, in Arrow batches; empty for fewer than three points."""

    def run(rings: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        boxes = np.stack([a, b, c, d], axis=1).astype(float)
        return pd.Series([[] if r is None or len(r) < 6 else clip(np.asarray(r, float).reshape(-1, 2), box).ravel().tolist() for r, box in zip(rings, boxes)])

    return F.pandas_udf(run, "array<double>")(points, *(x.cast("double") for x in (x1, y1, x2, y2)))


def clipped_area(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Area of a polygon's part within a rectangle."""

    def run(rings: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for r, box in zip(rings, np.stack([a, b, c, d], axis=1).astype(float)):
            p = clip(np.asarray(r, float).reshape(-1, 2), box) if r is not None and len(r) >= 6 else np.zeros((0, 2))
            out.append(abs(float(p[:, 0] @ np.roll(p[:, 1], -1) - p[:, 1] @ np.roll(p[:, 0], -1))) / 2 if len(p) > 2 else 0.0)
        return pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double")(points, *(x.cast("double") for x in (x1, y1, x2, y2)))


CROP_ID = r"^([^:]+):(.+):(box|polygon):(\d+)$"


def crop_id(split: Column, image: Column, kind: Column, index: Column) -> Column:
    return F.concat_ws(":", split, image, kind, index.cast("string"))


def parsed_crop_id(text: Column) -> Column:
    """Struct split, image, kind, index; null for other strings."""
    part = lambda i: F.regexp_extract(text, CROP_ID, i)
    return F.when(text.rlike(CROP_ID), F.struct(part(1).alias("split"), part(2).alias("image"), part(3).alias("kind"), part(4).cast("int").alias("index")))


#: Degrees, counter-clockwise, that set right what a model names.
TURNS = {"correct": 0, "rotate_90_clockwise": 270, "rotate_180": 180, "rotate_90_counter_clockwise": 90}


def orientation(tag: Column, model_class: Column) -> Column:
    """Struct method, ccw_degrees, unchanged: the file's own tag decides where there is one, else the model's class."""
    turns = F.create_map(*(F.lit(x) for kv in TURNS.items() for x in kv))
    degrees = F.when(tag.isNotNull(), F.lit(None).cast("int")).otherwise(F.try_element_at(turns, model_class))
    return F.struct(F.when(tag.isNotNull(), "exif").otherwise("model").alias("method"), degrees.alias("ccw_degrees"), F.when(tag.isNotNull(), tag == 1).otherwise(degrees == 0).alias("unchanged"))


def box_of_keypoints(points: Column, margin: float = 0.0) -> Column:
    """Struct cx, cy, w, h of the visible of keypoints (x, y, v)*; sides are at least 1e-6 and grow by twice the margin; null if none is visible."""
    n = F.floor(F.size(points) / 3).cast("int")
    seen = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(points, i * 3 + 2) > 0)
    xs = F.transform(seen, lambda i: F.get(points, i * 3))
    ys = F.transform(seen, lambda i: F.get(points, i * 3 + 1))
    mid = lambda a: (F.array_min(a) + F.array_max(a)) / 2
    side = lambda a: F.greatest(F.array_max(a) - F.array_min(a), F.lit(1e-6)) * (1 + 2 * margin)
    return F.when(F.size(seen) > 0, F.struct(mid(xs).alias("cx"), mid(ys).alias("cy"), side(xs).alias("w"), side(ys).alias("h")))


def polygon_area(points: Column) -> Column:
    """Area within a ring of (x, y)*, whichever way it runs; 0 for fewer than three points."""
    n = F.floor(F.size(points) / 2).cast("int")
    at = lambda i, k: F.get(points, (i % n) * 2 + k)
    twice = F.reduce(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1))
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(0.0)
