"""Key expressions over record paths and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders at a path's begin that name a split or hold the images.
LAYOUT_FOLDERS = ("train", "val", "valid", "validation", "test", "eval", "images")


def layout_path(path: Column) -> Column:
    """The path without leading split and image folders; its last part always stays."""
    return F.regexp_replace(path, f"^(?:(?:{'|'.join(LAYOUT_FOLDERS)})/)+", "")


def split_key(split: Column) -> Column:
    """The split; null and empty mean train."""
    return F.coalesce(F.nullif(split, F.lit("")), F.lit("train"))


def regex_key(path: Column, pattern: str) -> Column:
    """The first match: its first group if the pattern has one, else all of it; null without a match."""
    import re

    group = 1 if re.compile(pattern).groups else 0
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, group))


def dir_key(path: Column, n: int) -> Column:
    """The ``n``-th folder of the layout path, from 0, or from the end for negative ``n``; null where there is none."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.try_element_at(folders, F.lit(n + 1 if n >= 0 else n))


def attr_key(attributes: Column, name: str) -> Column:
    return F.try_element_at(attributes, F.lit(name)).cast("string")


def file_key(records: DataFrame, keys: DataFrame, path: str = "path", to: str = "key") -> DataFrame:
    """Adds ``to`` from a two-column table (name, value): by layout path, else by file name where only one record has it.

    A name that occurs twice in ``keys`` fails when the rows are read.
    """
    name, value = keys.columns
    once = keys.groupBy(name).agg(F.min(value).alias("_v"), F.count("*").alias("_n"))
    once = once.select(F.col(name).alias("_k"), F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("key table: repeated name "), F.col(name)))).alias("_v"))
    r = records.withColumn("_full", layout_path(F.col(path))).withColumn("_base", F.substring_index(path, "/", -1))
    unique = r.groupBy("_base").agg(F.count("*").alias("_same")).where("_same = 1").select("_base", F.lit(True).alias("_alone"))
    r = r.join(unique, "_base", "left")
    r = r.join(once.select(F.col("_k").alias("_full"), F.col("_v").alias("_a")), "_full", "left")
    r = r.join(once.select(F.col("_k").alias("_base"), F.col("_v").alias("_b")), "_base", "left")
    return r.withColumn(to, F.coalesce("_a", F.when(F.col("_alone"), F.col("_b")))).drop("_full", "_base", "_alone", "_a", "_b")


def record_keys(records: DataFrame, path: str = "path", resolved: str = "path", to: str = "key") -> DataFrame:
    """Adds the layout path as key; where it repeats, with the resolved path after a bar."""
    key = layout_path(F.col(path))
    n = F.count("*").over(Window.partitionBy("_k"))
    return records.withColumn("_k", key).withColumn("_n", n).withColumn(to, F.when(F.col("_n") > 1, F.concat_ws("|", "_k", resolved)).otherwise(F.col("_k"))).drop("_k", "_n")


def sanitized(text: Column) -> Column:
    """Runs of other characters than letters, digits, dot, bar and dash become one underscore; edges are trimmed; empty is ``sample``."""
    t = F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")
    t = F.regexp_replace(t, "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("sample"))
