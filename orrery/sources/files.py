"""Folders of files as records, files listed and read by tasks, key tables, unions of sources, differences of datasets, and tar shards."""

from __future__ import annotations

import fnmatch
import io
import json
import os
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.session import written

#: File endings of images, names of split folders.
IMAGES = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp")
SPLITS = ("train", "val", "valid", "validation", "test")


def listing(spark: SparkSession, folder: str, endings: tuple[str, ...] = IMAGES) -> DataFrame:
    """``(path, bytes)`` of the files below ``folder`` with one of the endings, paths relative to it; contents are not read."""
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.expr(f"substring_index(path, '{root}', -1)").alias("path"), F.col("length").alias("bytes"))
    return named.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings))


#: Names that a task passes on at once, and bytes of contents.
NAMES, CONTENTS = 10_000, 4 << 20


def _for_tasks(spark: SparkSession, folder: str) -> str | None:
    """``folder`` as a URI that tasks can list (file, hdfs, s3, gs); None for other schemes, patterns and what is not there."""
    from pyarrow import fs

    if any(c in folder for c in "*?[{"):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    try:
        store, path = fs.FileSystem.from_uri(uri)
        return uri if store.get_file_info(path).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def passed_over(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _entries(folder: str, name: str) -> Iterator[tuple[str, bool]]:
    """(name, is a folder) of what is in the folder ``name`` below ``folder``; of a local one, no list is held."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}" if name else root
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(path) as found:
            yield from ((x.name, x.is_dir()) for x in found)
    else:
        yield from ((x.base_name, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(path)))


def walked(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(file)``: paths below ``folder``, a URI that tasks can list, of the files whose names fit ``pattern``.

    Tasks list a folder each, level by level, so that the driver holds no names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.bool_())], ["file", "dir"])
        for batch in batches:
            for home in batch.column(0).to_pylist():
                rows = []
                for name, is_dir in _entries(folder, home):
                    if not passed_over(name) and (is_dir or fnmatch.fnmatchcase(name, pattern)):
                        rows.append((f"{home}/{name}" if home else name, is_dir))
                    if len(rows) == NAMES:
                        yield out(rows)
                        rows = []
                yield out(rows)

    levels, homes = [], spark.createDataFrame([("",)], "file string")
    while True:
        level = written(homes.mapInArrow(run, "file string, dir boolean"), "listed")
        levels.append(level.where("not dir").select("file"))
        homes = level.where("dir").select("file")
        n = homes.count()
        if not n:
            return reduce(DataFrame.unionAll, levels)
        homes = homes.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))


def texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(file, text)``: the JSON files below ``folder`` whose names fit ``pattern``, whole, in the encoding that they begin with.

    Tasks list and read them, and ``file`` is the path below ``folder``. Where tasks
    cannot (see ``_for_tasks``), Spark's readers do; their lists are the driver's.
    """
    uri = _for_tasks(spark, folder)
    decode = lambda data: data.decode(json.detect_encoding(data), "replace")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            names, got, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as f:
                    data = f.read()
                names.append(name)
                got.append(decode(data))
                size += len(data)
                if size >= CONTENTS:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(got)], ["file", "text"])
                    names, got, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(got, pa.string())], ["file", "text"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["file", "text"])

    if uri is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
        base = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
        return found.select(F.substring_index("path", base, -1).alias("file"), "content").mapInArrow(decoded, "file string, text string")
    names = walked(spark, folder=uri, pattern=pattern)
    return names.repartition(8 * spark.sparkContext.defaultParallelism, "file").mapInArrow(read, "file string, text string")


def class_folders(files: DataFrame, multi: bool = False) -> DataFrame:
    """``files`` with split and classes by folder: the first folder may be a split, the last is the class.

    With ``multi``, files of one name and split are one record with all their
    classes, under the smallest path; their sizes must agree.
    """
    part = F.split("path", "/")
    split = F.when((F.size(part) > 2) & part[0].isin(*SPLITS), part[0])
    d = files.withColumn("split", split).withColumn("classes", F.when(F.size(part) > 1, F.array(F.try_element_at(part, F.lit(-2)))).otherwise(F.array().cast("array<string>")))
    if not multi:
        return d
    d = d.withColumn("name", F.element_at(part, F.lit(-1)))
    one = d.groupBy("split", "name").agg(F.min("path").alias("path"), F.min("bytes").alias("bytes"), F.max("bytes").alias("_most"), F.array_sort(F.collect_set(F.try_element_at("classes", F.lit(1)))).alias("classes"))
    same = F.when(F.col("_most") == F.col("bytes"), F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("files of one name differ: "), "name")).cast("long"))
    return one.withColumn("bytes", same).select("path", "bytes", "split", "classes")


def key_table(spark: SparkSession, path: str) -> DataFrame:
    """``(name, v)`` of a CSV file of two columns; a name that comes twice fails."""
    raw = spark.read.csv(path, header=True)
    if len(raw.columns) != 2:
        raise ValueError("a key table has two columns")
    d = raw.toDF("name", "v")
    twice = d.groupBy("name").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['name']} comes twice")
    return d


def union_sources(sources: list[DataFrame], label: str, order: str) -> tuple[DataFrame, DataFrame]:
    """All rows with ``src`` and ``cls``, and ``(cls, label)``: classes are numbered as first met, source by source, then by ``order``."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn("src", F.lit(i)) for i, d in enumerate(sources)))
    first = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(F.struct("src", order)).alias("_at"))
    vocabulary = first.select((F.row_number().over(Window.orderBy("_at", label)) - 1).cast("long").alias("cls"), label)  # a row for each class
    return rows.join(vocabulary, label, "left"), vocabulary


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, status)``: added, removed, changed or same, by a key that is unique on either side."""
    side = lambda d, s: d.select(F.col(key), F.col(value).alias(f"_{s}"), F.lit(True).alias(f"_has_{s}"))
    d = side(old, "a").join(side(new, "b"), key, "full_outer")
    status = F.when(F.col("_has_a").isNull(), "added").when(F.col("_has_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return d.select(key, status.alias("status"))


def vqa_items(questions: DataFrame, answers: DataFrame, predictions: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Questions with the answer and the prediction of their key, null where there is none; of rows that share a key the first by ``order`` (or by all columns) counts."""

    def first(d: DataFrame) -> DataFrame:
        by = [order] if order and order in d.columns else [c for c in d.columns if c != key]
        rest = [c for c in d.columns if c != key]
        return d.groupBy(key).agg(F.min(F.struct(*dict.fromkeys([*by, *rest]))).alias("_v")).select(key, *(F.col("_v")[c].alias(c) for c in rest if c != order))

    return first(questions).join(first(answers), key, "left").join(first(predictions), key, "left")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard, key, ending, image, json)`` of the samples in the tar files below ``folder``; a sample without image or JSON fails."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            for shard, content in zip(d["path"], d["content"]):
                held: dict[str, dict[str, bytes]] = {}
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            stem, _, ending = m.name.rpartition(".")
                            held.setdefault(stem, {})[ending.lower()] = tar.extractfile(m).read()
                rows = []
                for stem, got in held.items():
                    image = next((x for x in IMAGES if x in got), None)
                    if image is None or "json" not in got:
                        raise ValueError(f"{shard}: {stem} is not whole")
                    rows.append((shard, stem, image, got[image], got["json"].decode()))
                yield pd.DataFrame(rows, columns=["shard", "key", "ending", "image", "json"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar").load(folder)
    return files.select("path", "content").mapInPandas(run, "shard string, key string, ending string, image binary, json string")


def shard_plan(rows: DataFrame, order: str, size: str, most_rows: int = 10_000, most_bytes: int = 500_000_000) -> DataFrame:
    """``(order, size, shard)``: rows in order fill a shard until the next one would exceed either bound; a row beyond the bound has a shard of its own.

    One running rule holds over all rows, whatever their partitions: ranges of the
    order are walked one after another, each on an executor, from what the one
    before leaves open; then all are numbered at once.
    """
    src = rows.select(F.col(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    ranged = written(src.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ordered")
    types = dict(src.dtypes)
    parts = sorted(r[0] for r in ranged.select("_part").distinct().collect())  # a row for each range

    def fill(sizes, n: int, total: int):
        """Whether each row opens a shard, and what the last one holds."""
        opens = []
        for b in sizes:
            new = bool(n) and (n >= most_rows or total + b > most_bytes)
            opens.append(new)
            n, total = (1, b) if new else (n + 1, total + b)
        return opens, n, total

    def tail(part: DataFrame, n: int, total: int) -> tuple[int, int, int]:
        """Shards that a range opens and what the last holds, found in one task without moving the range."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            opened, a, b = 0, n, total
            for d in batches:
                opens, a, b = fill(d[size].tolist(), a, b)
                opened += sum(opens)
            yield pd.DataFrame({"opened": [opened], "n": [a], "total": [b]})

        r = part.coalesce(1).sortWithinPartitions(order).mapInPandas(run, "opened long, n long, total long").first()
        return r.opened, r.n, r.total

    starts, shard, n, total = [], 0, 0, 0
    for p in parts:
        starts.append((p, shard, n, total))
        opened, n, total = tail(ranged.where(F.col("_part") == p), n, total)
        shard += opened
    at = {p: (s, a, b) for p, s, a, b in starts}

    def number(d: pd.DataFrame) -> pd.DataFrame:
        s, a, b = at[int(d["_part"].iloc[0])]
        d = d.sort_values(order)
        opens, _, _ = fill(d[size].tolist(), a, b)
        return d.assign(shard=s + pd.Series(opens, index=d.index).cumsum())[[order, size, "shard"]]

    return ranged.groupBy("_part").applyInPandas(number, f"{order} {types[order]}, {size} long, shard int")
