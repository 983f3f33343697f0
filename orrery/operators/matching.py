"""Matching of predictions with truths, of boxes with polygons, and what follows from matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.annotations import iou

EDGES = ("x1", "y1", "x2", "y2")


def candidates(pred: DataFrame, truth: DataFrame, by: list[str], least: float) -> DataFrame:
    """``(by..., p, t, iou)``: pairs that overlap by ``least`` or more."""
    side = lambda d, s: d.select(*by, F.col("ann").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in EDGES))
    pairs = side(pred, "p").join(side(truth, "t"), by).withColumn("iou", iou("p_", "t_"))
    return pairs.where(F.col("iou") >= least).select(*by, "p", "t", "iou")


def first_free(pairs: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Of ``pairs`` (by..., p, t, ...) those taken when each in ``order`` is taken if both its ends are still free.

    A group's pairs meet in one task, in order; only pairs that qualify are there.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used_p: set = set()
        used_t: set = set()
        for d in parts:
            keep = np.zeros(len(d), bool)
            for i, (r, p, t) in enumerate(zip(d["_r"].tolist(), d["p"].tolist(), d["t"].tolist())):
                if r == 1:
                    used_p, used_t = set(), set()
                if p not in used_p and t not in used_t:
                    keep[i] = True
                    used_p.add(p)
                    used_t.add(t)
            yield d[keep].drop(columns="_r")

    return pairs.withColumn("_r", rank).mapInPandas(run, pairs.schema)


def matched(pred: DataFrame, truth: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """``pred`` with ``tp``: greedy one-to-one matches within ``by``, best overlap first; ties by prediction, then truth id."""
    hits = first_free(candidates(pred, truth, by, least), by, [F.desc("iou"), "p", "t"]).select(*by, F.col("p").alias("ann"), F.lit(True).alias("tp"))
    return pred.join(hits, [*by, "ann"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def matched_by_score(pred: DataFrame, truth: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """``pred`` with ``tp``: predictions by falling score (ties by id) take their best free truth."""
    pairs = candidates(pred, truth, by, least).join(pred.select(*by, F.col("ann").alias("p"), "score"), [*by, "p"])
    hits = first_free(pairs, by, [F.desc("score"), "p", F.desc("iou"), "t"]).select(*by, F.col("p").alias("ann"), F.lit(True).alias("tp"))
    return pred.join(hits, [*by, "ann"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def counts(marked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row tp, fp, fn of marked predictions."""
    got = marked.agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fp"))
    return got.join(F.broadcast(truth.agg(F.count("*").alias("_n")))).select("tp", "fp", (F.col("_n") - F.col("tp")).alias("fn"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    b = beta * beta
    return F.when((p == 0) & (r == 0), 0.0).otherwise((1 + b) * p * r / F.greatest(b * p + r, F.lit(1e-12)))


def common_stems(a: DataFrame, b: DataFrame, path: str) -> DataFrame:
    """``(stem, path_a, path_b)``: the first record (by path) of each stem that both have."""
    side = lambda d, s: d.groupBy(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("stem")).agg(F.min(path).alias(f"path_{s}"))
    return side(a, "a").join(side(b, "b"), "stem")


def unmatched_stems(a: DataFrame, b: DataFrame, path: str) -> DataFrame:
    """One row: stems that only one side has."""
    side = lambda d: d.select(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("stem")).distinct()
    both = side(a).withColumn("_a", F.lit(True)).join(side(b).withColumn("_b", F.lit(True)), "stem", "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def _associated(own: dict, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n_box: int, n_poly: int) -> tuple[np.ndarray, np.ndarray]:
    """The polygon of each box (-1: none), boxes in order, and which polygons none took: ``own`` maps boxes to polygons of their group, ``pairs`` are (box, polygon, overlap) that qualify, in order of boxes."""
    match, free = np.full(n_box, -1), np.ones(n_poly, bool)
    groups = iter(sorted(own.items()))
    due = next(groups, None)
    for i, j, share in pairs:
        order = np.lexsort((j, -share, i))
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            while due is not None and due[0] <= x:
                match[due[0]], free[due[1]] = due[1], False
                due = next(groups, None)
            if match[x] < 0 and free[y]:
                match[x], free[y] = y, False
    while due is not None:
        match[due[0]], free[due[1]] = due[1], False
        due = next(groups, None)
    return match, free


def with_polygons(boxes: DataFrame, polygons: DataFrame, record: str = "record_id", least: float = 0.5) -> DataFrame:
    """Detections of each record: ``(record, box, polygon, label, score, x1..y2)``.

    Boxes in their order take the polygon of their group, else the free polygon of
    their label that overlaps best, from ``least`` on; polygons that are left stand
    alone. Columns of both: record, ann, label, score, group_id, x1, y1, x2, y2.
    Many records meet one after another in a task, which compares the boxes and
    polygons of some at once.
    """
    cols = ["ann", "label", "group_id", F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(1.0)), F.lit(1.0)).alias("score"), *(F.col(c).cast("double").alias(c) for c in EDGES)]
    both = boxes.where("kind <> 'pose'").select(record, F.lit(0).alias("is_poly"), *cols).unionByName(polygons.select(record, F.lit(1).alias("is_poly"), *cols))
    types = dict(both.dtypes)
    most = 1 << 20

    def settle(t: pa.Table, rec: np.ndarray) -> pa.RecordBatch:
        poly = t.column("is_poly").to_numpy() == 1
        b, p = np.flatnonzero(~poly), np.flatnonzero(poly)
        edges = np.stack([t.column(c).to_numpy() for c in EDGES], 1)
        code = lambda c: t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        label, group = code("label"), code("group_id")
        box, ring = edges[b], edges[p]
        begin, end = np.searchsorted(rec[p], rec[b], "left"), np.searchsorted(rec[p], rec[b], "right")
        first: dict = {}
        own: dict = {}
        if (group[p] >= 0).any() and (group[b] >= 0).any():
            for j in np.flatnonzero(group[p] >= 0).tolist():
                first.setdefault((rec[p[j]], group[p[j]]), j)
            for i in np.flatnonzero(group[b] >= 0).tolist():
                j = first.get((rec[b[i]], group[b[i]]), -1)
                if j >= 0:
                    own[i] = j
        sums = np.cumsum(end - begin)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            x = 0
            while x < len(b):
                y = max(x + 1, int(np.searchsorted(sums, (sums[x - 1] if x else 0) + most, "right")))
                n = (end - begin)[x:y]
                i = np.repeat(np.arange(x, y), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]
                alike = (label[b[i]] == label[p[j]]) & (label[b[i]] >= 0)
                i, j = i[alike], j[alike]
                u, v = box[i], ring[j]
                side = np.maximum(0.0, np.minimum(u[:, 2:], v[:, 2:]) - np.maximum(u[:, :2], v[:, :2]))
                inter = side[:, 0] * side[:, 1]
                size = lambda e: (e[:, 2] - e[:, 0]) * (e[:, 3] - e[:, 1])
                share = inter / np.maximum(size(u) + size(v) - inter, 1e-12)
                hit = share >= least
                yield i[hit], j[hit], share[hit]
                x = y

        match, free = _associated(own, pairs(), len(b), len(p))
        alone = p[free]
        rows = pa.array(np.concatenate([b, alone]))
        none = np.zeros(len(alone), int)
        as_box = pa.array(np.concatenate([b, none]), mask=np.concatenate([np.zeros(len(b), bool), none == 0]))
        at = np.zeros(len(b), int) if not len(p) else p[np.maximum(match, 0)]
        as_poly = pa.array(np.concatenate([at, alone]), mask=np.concatenate([match < 0, none == 1]))
        ann = t.column("ann").combine_chunks()
        take = lambda c: t.column(c).combine_chunks().take(rows)
        return pa.RecordBatch.from_arrays([take(record), ann.take(as_box), ann.take(as_poly), *(take(c) for c in ("label", "score", *EDGES))], [record, "box", "polygon", "label", "score", *EDGES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for d in batches:
            if not d.num_rows:
                continue
            first = np.flatnonzero(d.column("_r").to_numpy() == 1)
            if held and len(first):
                held.append(d.slice(0, first[-1]))
                yield done(held)
                held = [d.slice(first[-1])]
            else:
                # the first batch, or one more of a record that fills batches
                held.append(d)
        if held:
            yield done(held)

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return settle(t, np.cumsum(t.column("_r").to_numpy() == 1))

    w = Window.partitionBy(record).orderBy("is_poly", "ann")
    out = f"`{record}` {types[record]}, box {types['ann']}, polygon {types['ann']}, label {types['label']}, score double, x1 double, y1 double, x2 double, y2 double"
    return both.withColumn("_r", F.row_number().over(w)).mapInArrow(run, out)


def best_overlap(anchors: DataFrame, others: DataFrame, by: list[str], least: float = 0.0) -> DataFrame:
    """``(by..., ann, other, iou)``: for each anchor the other that overlaps it best; ties to the smaller id."""
    pairs = candidates(anchors, others, by, max(least, 1e-12))
    w = Window.partitionBy(*by, "p").orderBy(F.desc("iou"), "t")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, F.col("p").alias("ann"), F.col("t").alias("other"), "iou")


def inside(points: DataFrame, boxes: DataFrame, record: str) -> DataFrame:
    """``(record, point, box)``: points (record, ann, x, y) within rectangles of their record, edges included; each in the smallest that holds it."""
    p = points.select(record, F.col("ann").alias("point"), "x", "y")
    b = boxes.select(record, F.col("ann").alias("box"), *EDGES)
    hit = p.join(b, record).where("x between x1 and x2 and y between y1 and y2")
    w = Window.partitionBy(record, "point").orderBy((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), "box")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(record, "point", "box")


def ranked_candidates(sidecars: DataFrame, images: DataFrame) -> DataFrame:
    """``(sidecar, image)`` by paths: the image of the same stem in the sidecar's folder, else the only one of that stem, else that of the mirrored folder (``labels*`` for ``images``).

    A sidecar without any image is left out; one with several and no mirror fails.
    """
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    s = sidecars.select(F.col("path").alias("sidecar"), stem("path").alias("stem"), folder("path").alias("folder"))
    i = images.select(F.col("path").alias("image"), stem("path").alias("stem"), folder("path").alias("home"))
    mirror = F.array_join(F.transform(F.split("folder", "/"), lambda x: F.when(x.rlike("^labels([_-].*)?$"), "images").otherwise(x)), "/")
    d = s.join(i, "stem").withColumns({"here": F.col("home") == F.col("folder"), "mirrored": F.col("home") == mirror})
    n = d.groupBy("sidecar").agg(F.count_if("here").alias("here"), F.count("*").alias("n"), F.count_if("mirrored").alias("mirrored"), F.min(F.when(F.col("here"), F.col("image"))).alias("a"), F.min("image").alias("b"), F.min(F.when(F.col("mirrored"), F.col("image"))).alias("c"))
    many = F.raise_error(F.concat(F.lit("several images for "), "sidecar")).cast("string")
    pick = F.when(F.col("here") == 1, F.col("a")).when(F.col("here") > 1, many).when(F.col("n") == 1, F.col("b")).when(F.col("mirrored") == 1, F.col("c")).otherwise(many)
    return n.select("sidecar", pick.alias("image"))


def exactly_one(rows: DataFrame, sources: DataFrame, on: list[str], what: str) -> DataFrame:
    """``rows`` joined with the one source row of their key; none, or several, fails."""
    n = sources.groupBy(*on).agg(F.count("*").alias("_n"))
    bad = rows.join(n, on, "left").where(F.coalesce("_n", F.lit(0)) != 1).select(*on).first()
    if bad is not None:
        raise ValueError(f"{what}: not exactly one source for {', '.join(map(str, bad))}")
    return rows.join(sources, on)


def paste_order(crops: DataFrame, image: list[str], area: Column, crop: str) -> DataFrame:
    """``crops`` with ``step``: the order in which an image's crops are pasted back, largest first."""
    return crops.withColumn("step", F.row_number().over(Window.partitionBy(*image).orderBy(F.desc(area), crop)))


def merged_flags(own: Column, crop: Column) -> Column:
    """Two maps of names to booleans; the crop's values win."""
    none = F.create_map().cast("map<string,boolean>")
    a, b = F.coalesce(own, none), F.coalesce(crop, none)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def compared(old: DataFrame, new: DataFrame, record: str, label: str, columns: list[str], tolerance: float = 1e-3) -> DataFrame:
    """``(record, label, ann, other)``: annotations of two datasets, by class in order of their coordinates, that differ beyond ``tolerance`` or have no partner.

    ``ann`` or ``other`` is null where one side has more.
    """
    w = Window.partitionBy(record, label).orderBy(*columns, "ann")
    side = lambda d, s: d.select(record, label, F.row_number().over(w).alias("_at"), F.col("ann").alias("ann" if s == "a" else "other"), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    both = side(old, "a").join(side(new, "b"), [record, label, "_at"], "full")
    near = F.lit(True)
    for c in columns:
        near = near & F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.lit(False))
    return both.where(~near).select(record, label, "ann", "other")
