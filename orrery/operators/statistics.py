"""Summaries of annotations, routed classes and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_stats(anns: DataFrame, label: str = "label", kind: str = "kind", score: str = "score") -> DataFrame:
    """By label: annotations of each kind, and least, mean and largest score (six places)."""
    of = lambda k: F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).alias(k)
    six = lambda c, n: F.round(c, 6).alias(n)
    return anns.groupBy(label).agg(F.count("*").alias("n"), of("det"), of("seg"), of("pose"), six(F.min(score), "score_min"), six(F.avg(score), "score_mean"), six(F.max(score), "score_max"))


def image_stats(images: DataFrame, anns: DataFrame, key: str) -> DataFrame:
    """One row: images, and how many have annotations or none."""
    some = anns.select(F.col(key)).distinct().withColumn("_some", F.lit(True))
    return images.select(key).join(some, key, "left").agg(F.count("*").alias("images"), F.count("_some").alias("annotated"), (F.count("*") - F.count("_some")).alias("empty"))


def class_stats(rows: DataFrame, classes: str, unlabeled: str = "unlabeled") -> DataFrame:
    """By class of the array ``classes``: records, and those that have other classes too; records without any count as ``unlabeled``."""
    c = F.when(F.size(classes) > 0, F.col(classes)).otherwise(F.array(F.lit(unlabeled)))
    d = rows.select(F.explode(c).alias("class"), (F.size(classes) > 1).alias("_more"))
    return d.groupBy("class").agg(F.count("*").alias("n"), F.count_if("_more").alias("multi"))


def question_stats(items: DataFrame, answer: str, by: str, unique: str) -> DataFrame:
    """By ``by``: questions, those with an answer that is not blank, and distinct values of ``unique``."""
    said = F.coalesce(F.trim(F.col(answer)) != "", F.lit(False))
    return items.groupBy(by).agg(F.count("*").alias("questions"), F.count_if(said).alias("answered"), F.count_distinct(unique).alias(unique + "s"))
