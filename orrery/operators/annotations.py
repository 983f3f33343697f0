"""Selection, relabelling and suppression of annotations (one row for each)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import written


def size_rule(w: Column, h: Column, area: Column, min_box: float | None = None, min_side: float | None = None, min_area_frac: float | None = None) -> Column:
    """The first size rule that a box of ``w`` x ``h`` pixels fails, of min_box, min_side, min_area_frac; null if none."""
    rule = F.lit(None).cast("string")
    for name, bad in (
        ("min_area_frac", None if min_area_frac is None else w * h / area < min_area_frac),
        ("min_side", None if min_side is None else F.greatest(w, h) < min_side),
        ("min_box", None if min_box is None else F.sqrt(w * h) < min_box),
    ):
        if bad is not None:
            rule = F.when(bad, F.lit(name)).otherwise(rule)
    return rule


def remap(df: DataFrame, col: str, mapping: dict[str, str | None], others: str | None = None) -> DataFrame:
    """Renames classes; a class mapped to None goes, one not mapped stays or becomes ``others``."""
    c = F.col(col)
    new = c if others is None else F.lit(others)
    for old, to in mapping.items():
        new = F.when(c == old, F.lit(to).cast("string")).otherwise(new)
    return df.withColumn(col, new).where(F.col(col).isNotNull())


def iou(a: str, b: str, inclusive: bool = False, eps: float = 0.0) -> Column:
    """Overlap of boxes given by columns ``a``x1, y1, x2, y2 and ``b``..., over their union; 0 without a union."""
    one = 1.0 if inclusive else 0.0
    c = lambda s, n: F.col(f"{s}{n}")
    side = lambda n: F.greatest(F.lit(0.0), F.least(c(a, f"{n}2"), c(b, f"{n}2")) - F.greatest(c(a, f"{n}1"), c(b, f"{n}1")) + one)
    area = lambda s: (c(s, "x2") - c(s, "x1") + one) * (c(s, "y2") - c(s, "y1") + one)
    inter = side("x") * side("y")
    union = area(a) + area(b) - inter + eps
    return F.when(union > 0, inter / union).otherwise(0.0)


def duplicate_boxes(df: DataFrame, image: str, label: str, ann: str, threshold: float = 0.99) -> DataFrame:
    """Pairs (ann_a < ann_b) of one image and label that overlap by ``threshold`` or more.

    The join is within an image and label, which bounds it by the boxes of one image.
    """
    side = lambda s: df.select(F.col(image).alias("image"), F.col(label).alias("label"), F.col(ann).alias(f"ann_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = side("a").join(side("b"), ["image", "label"]).where("ann_a < ann_b")
    return pairs.where(iou("a_", "b_") >= threshold).select("image", "label", "ann_a", "ann_b")


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -scores))


def suppressed(boxes: np.ndarray, scores: np.ndarray, ids: np.ndarray, limit: float, labels: np.ndarray | None = None, inclusive: bool = True) -> np.ndarray:
    """Whether each box stays: best scores first (ties by id), a box goes where a kept one overlaps it beyond ``limit``.

    With labels, only boxes of other labels suppress. ``inclusive`` counts edge
    pixels, as pixel boxes do; shares of an image take plain areas.
    """
    order = _order(scores, ids)
    b = boxes[order]
    one = 1.0 if inclusive else 0.0
    area = np.maximum(b[:, 2] - b[:, 0] + one, 0.0) * np.maximum(b[:, 3] - b[:, 1] + one, 0.0)
    tags = None if labels is None else labels[order]
    alive = np.ones(len(b), bool)
    for i in range(len(b) - 1):
        if not alive[i]:
            continue
        rest = b[i + 1 :]
        w = np.minimum(rest[:, 2], b[i, 2]) - np.maximum(rest[:, 0], b[i, 0]) + one
        h = np.minimum(rest[:, 3], b[i, 3]) - np.maximum(rest[:, 1], b[i, 1]) + one
        inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        hit = inter > limit * (area[i + 1 :] + area[i] - inter + (1e-9 if inclusive else 0.0))
        alive[i + 1 :] &= ~(hit if tags is None else hit & (tags[i + 1 :] != tags[i]))
    keep = np.zeros(len(b), bool)
    keep[order[alive]] = True
    return keep


def in_groups(df: DataFrame, by: list[str], order: list[Column | str], columns: list[str], choose: Callable[..., np.ndarray]) -> DataFrame:
    """Rows that ``choose`` marks in each group of ``by``, given the arrays of ``columns``.

    Groups are dealt by hash, sorted, and met one after another in a task, so many
    small groups cost no call of their own and a task holds one group at a time.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for d in parts:
            if not len(d):
                continue
            d = d if held is None or not len(held) else pd.concat([held, d])
            first = np.flatnonzero(d["_r"].to_numpy() == 1)
            held = d.iloc[first[-1] :]
            yield marked(d.iloc[: first[-1]], first)
        if held is not None and len(held):
            yield marked(held, np.zeros(1, int))

    def marked(d: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        ends = np.append(first[first < len(d)], len(d))
        keep = np.ones(len(d), bool)
        arrays = [d[c].to_numpy() for c in columns]
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if y - x > 1:
                keep[x:y] = choose(*(a[x:y] for a in arrays))
        return d[keep].drop(columns="_r")

    return df.withColumn("_r", rank).mapInPandas(run, df.schema)


def nms(df: DataFrame, by: list[str], limit: float, ann: str = "ann", across: str | None = None, inclusive: bool = True) -> DataFrame:
    """Non-maximum suppression within ``by``; with ``across`` only boxes of another value of that column suppress. An image's boxes meet in one task."""

    def choose(x1, y1, x2, y2, score, ids, labels=None) -> np.ndarray:
        return suppressed(np.stack([x1, y1, x2, y2], 1).astype(float), score.astype(float), ids, limit, labels, inclusive)

    return in_groups(df, by, [F.desc("score"), ann], ["x1", "y1", "x2", "y2", "score", ann, *([across] if across else [])], choose)


def top_k(df: DataFrame, by: list[str], k: int, ann: str = "ann") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), ann)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def postprocess(df: DataFrame, image: str = "image", label: str = "label", nms_limit: float | None = None, k: int | None = None, cross_limit: float | None = None) -> DataFrame:
    """Suppression within classes, the best k of each class, then suppression across classes."""
    if nms_limit is not None:
        df = nms(df, [image, label], nms_limit)
    if k is not None:
        df = top_k(df, [image, label], k)
    return df if cross_limit is None else nms(df, [image], cross_limit, across=label)


def average_precision(df: DataFrame, by: str, n_truth: int | Column, order: list[str]) -> DataFrame:
    """(by, ap): area under the precision envelope of predictions by falling score.

    Ranks count within ranges of the order, from what the ranges before hold, so
    a group's predictions need not fit in one task.
    """
    truth = F.lit(n_truth) if isinstance(n_truth, int) else n_truth
    line = [F.desc("score"), *order]
    d = df.withColumn("_truth", truth).repartitionByRange(by, *line).withColumn("_part", F.spark_partition_id())
    d = written(d.select(by, "score", "tp", "_truth", "_part", *(x for x in order if x not in (by, "score"))), "ranges")
    parts = Window.partitionBy("_by").orderBy("_at")
    before, after = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)

    def beside(x: DataFrame, sums: DataFrame) -> DataFrame:
        return x.join(F.broadcast(sums), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at"))).drop("_by", "_at")

    keys = [F.col(by).alias("_by"), F.col("_part").alias("_at")]
    held = d.groupBy(*keys).agg(F.sum(F.col("tp").cast("long")).alias("h"), F.count("*").alias("c"))
    held = held.select("_by", "_at", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_{x}") for x in "hc"))
    within = Window.partitionBy(by, "_part").orderBy(*line)
    down = within.rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(by, "_part").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)  # from the end: a frame to the end would be walked anew for each row
    hits = F.col("_h") + F.coalesce(F.sum(F.col("tp").cast("long")).over(down), F.lit(0))
    d = beside(d, held).withColumns({"_rate": hits / (F.col("_c") + F.count("*").over(down)), "_k": F.count("*").over(down)})
    best = d.groupBy(*keys).agg(F.max("_rate").alias("m")).select("_by", "_at", F.max("m").over(after).alias("_later"))
    d = beside(d.withColumn("best", F.max("_rate").over(up)), best).withColumn("best", F.greatest("best", "_later"))
    return d.where("tp").groupBy(by).agg((F.sum("best") / F.first("_truth")).alias("ap"))
