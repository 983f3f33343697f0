"""What stays of a grounding model's new annotations, and under what class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import annotations as A


def groups(new: DataFrame, record: str = "record_id") -> DataFrame:
    """``new`` with ``key``: boxes and polygons of one group id are one detection, others each their own."""
    own = F.concat_ws(":", F.when(F.col("kind") == "seg", "poly").otherwise("box"), F.col("ann").cast("string"))
    return new.withColumn("key", F.coalesce(F.concat(F.lit("group:"), F.col("group_id").cast("string")), own))


def kept(new: DataFrame, threshold: float, limit: float = 0.5, labels: dict[str, str] | None = None, record: str = "record_id") -> DataFrame:
    """New annotations (record, ann, kind, group_id, label, score, x1..y2 as shares) that stay, under their classes' names.

    Labels follow the prompts' map. A detection's score is the largest of its
    annotations, its box that of a box before that of a polygon; below
    ``threshold`` all of it goes, as does what a better detection of its label
    overlaps beyond ``limit``. What stays loses annotations below the threshold.
    """
    table = F.create_map(*(F.lit(x) for kv in (labels or {}).items() for x in kv)) if labels else None
    d = groups(new, record)
    if table is not None:
        d = d.withColumn("label", F.coalesce(F.try_element_at(table, F.col("label")), F.col("label")))
    first = lambda c: F.min_by(c, F.struct(F.when(F.col("kind") == "seg", 1).otherwise(0).alias("p"), F.col("ann")))
    det = d.groupBy(record, "key").agg(F.max("score").alias("score"), F.min(F.when(F.col("label").isNotNull(), F.col("label"))).alias("label"), F.min("ann").alias("ann"), *(first(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    det = det.where(F.col("score").isNull() | (F.col("score") >= threshold)).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("label", F.coalesce("label", F.lit("")))
    if limit > 0:
        det = A.nms(det, [record, "label"], limit, inclusive=False)
    stay = d.join(det.select(record, "key"), [record, "key"], "left_semi")
    return stay.where(F.col("score").isNull() | (F.col("score") >= threshold)).drop("key")


def with_classes(anns: DataFrame, classes: list[str], record: str = "record_id") -> tuple[DataFrame, list[str]]:
    """``anns`` with ``cls`` by label, and the class list with new labels after the old, in the order first met."""
    new = anns.where(~F.col("label").isin(classes) if classes else F.lit(True)).where("label is not null").groupBy("label").agg(F.min(F.struct(record, "ann")).alias("at")).orderBy("at").collect()  # a row for each new class
    names = [*classes, *(r.label for r in new)]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1 if names else F.lit(None)
    return anns.withColumn("cls", number.cast("int")), names
