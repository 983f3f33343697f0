"""Plans for files: flat names, routing, deduplication against a destination, numbering, sampling, and what to do with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import written
from orrery.sources.files import IMAGES

#: Where files that are no images are collected.
COLLECTED = "non_images"


def flat_name(path: Column, mode: str) -> Column:
    """``none`` leaves the path, ``plain`` its name; ``enc-prefix`` puts folders before the name and ``enc-suffix`` after its stem (up to its first dot), by two underscores."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    if mode == "none":
        return path
    if mode == "plain":
        return name
    if mode == "enc-prefix":
        return F.array_join(parts, "__")
    if mode == "enc-suffix":
        stem, rest = F.regexp_extract(name, r"^([^.]*)", 1), F.regexp_extract(name, r"^[^.]*(\..*)?$", 1)
        return F.concat(F.concat_ws("__", stem, F.nullif(F.array_join(folders, "__"), F.lit(""))), rest)
    raise ValueError(f"unknown mode {mode}")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGES)


def new_files(files: DataFrame, existing: DataFrame, size: str = "size", digest: str = "sha1") -> DataFrame:
    """Files whose size and digest the destination has not, and of equal ones the first by path."""
    fresh = files.join(existing.select(size, digest).distinct(), [size, digest], "left_anti")
    first = F.row_number().over(Window.partitionBy(size, digest).orderBy("path"))
    return fresh.withColumn("_r", first).where("_r = 1").drop("_r")


def routed(df: DataFrame, policy: str, path: str = "path", to: str = "to") -> DataFrame:
    """Files that are no images: left as they are (``keep``), left out (``skip``), or under a folder of their own (``collect``)."""
    if policy == "keep":
        return df
    if policy == "skip":
        return df.where(is_image(F.col(path)))
    if policy == "collect":
        return df.withColumn(to, F.when(is_image(F.col(path)), F.col(to)).otherwise(F.concat(F.lit(f"{COLLECTED}/"), F.col(to))))
    raise ValueError(f"unknown policy {policy}")


def sequence_number(path: Column, mode: str) -> Column:
    """The number that a file's name holds as a numbered file; null if it holds none."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    parts = F.split(stem, "__")
    token = F.element_at(parts, -1) if mode == "enc-prefix" else F.get(parts, 0) if mode == "enc-suffix" else stem
    return F.when(token.rlike(r"^\d+$"), token.cast("long"))


def next_number(existing: DataFrame, mode: str, path: str = "path") -> int:
    """One past the largest number among the destination's images."""
    got = existing.where(is_image(F.col(path))).agg(F.max(sequence_number(F.col(path), mode))).first()[0]
    return (got or 0) + 1


def with_rank(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """Adds ``to``: the place of each row from 0 in ``order``, which should have no ties.

    Rows are dealt to ranges of the order, written, and counted by range, so that
    no task meets all of them.
    """
    d = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    d = written(d, "ranges")
    n = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = n.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return d.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def renumbered(df: DataFrame, mode: str, start: int = 1, order: list[str] | None = None, path: str = "path", to: str = "to") -> DataFrame:
    """Images take a number of six digits for their name (the encoded folders stay), in order of their paths; other files keep theirs."""
    images = df.where(is_image(F.col(path)))
    d = with_rank(images, order or [path], "_n")
    number = F.lpad((F.col("_n") + start).cast("string"), 6, "0")
    name = F.element_at(F.split(to, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    parts = F.split(F.regexp_extract(name, r"^(.+?)(\.[^./]*)?$", 1), "__")
    if mode == "enc-prefix":
        stem = F.concat_ws("__", F.nullif(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "__"), F.lit("")), number)
    elif mode == "enc-suffix":
        stem = F.concat_ws("__", number, F.nullif(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "__"), F.lit("")))
    else:
        stem = number
    folder = F.regexp_extract(to, r"^(.*/)?[^/]*$", 1) if mode == "none" else F.lit("")
    named = d.withColumn(to, F.concat(folder, stem, ending)).drop("_n")
    return named.unionByName(df.where(~is_image(F.col(path))))


def actions(df: DataFrame, mode: str = "copy", folder: str | None = None, path: str = "path", to: str = "to", drop: str = "drop") -> DataFrame:
    """``(kind, src, dst, reason)``: what becomes of each file; ``drop`` names why a file goes, if it does."""
    kinds = {"copy": "copy", "move": "move", "hard": "link", "sym": "symlink"}
    if mode not in kinds:
        raise ValueError(f"unknown mode {mode}")
    dst = F.concat(F.lit(f"{folder}/" if folder else ""), F.col(to))
    gone = F.col(drop).isNotNull()
    return df.select(F.when(gone, "drop").otherwise(kinds[mode]).alias("kind"), F.col(path).alias("src"), F.when(~gone, dst).alias("dst"), F.col(drop).alias("reason"))


def placed_flat(df: DataFrame, path: str = "path", to: str = "to") -> DataFrame:
    """Adds ``to``: the file's name; where names repeat, the second by path gets ``_1`` before its ending, and so on."""
    name = F.element_at(F.split(path, "/"), -1)
    n = F.row_number().over(Window.partitionBy("_name").orderBy(path)) - 1
    stem, ending = F.regexp_extract("_name", r"^(.+?)(\.[^./]*)?$", 1), F.regexp_extract("_name", r"^.+?(\.[^./]*)?$", 1)
    d = df.withColumn("_name", name).withColumn("_n", n)
    return d.withColumn(to, F.when(F.col("_n") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ending))).drop("_name", "_n")


def pooled_keys(sources: list[DataFrame], path: str = "path") -> DataFrame:
    """Files of several folders with ``key``: the folder's number and the path, to be sampled as one."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (d.withColumn("key", F.concat(F.lit(f"{i}:"), F.col(path))) for i, d in enumerate(sources)))


def manifest(command: str, source: str, target: str, options: dict, stats: dict) -> dict:
    """What a run of plans did, as written beside its files; empty values are left out."""
    from orrery.sources.configs import pruned

    return pruned({"version": 1, "branch": "prep", "command": command, "src": source, "dst": target, "options": options, "stats": stats})
