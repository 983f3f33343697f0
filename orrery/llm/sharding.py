"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards. Shards of one size tier are merged, in
runs of similar size, into files of up to the target size: Spark's file planner
packs a tier's files, sorted by size, into partitions of that size, and each
partition writes one file, so nothing is shuffled. Every change is one manifest
version, put in place by a rename that fails if the version exists, so readers
see all of a change or nothing and two writers cannot both win: the loser reads
the new version and tries again. Files that no version has named are never
deleted, since another writer may be about to commit them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.llm.tables import fresh, table
from orrery.session import shared_dir

TARGET = 128 << 20
#: Shards of a tier that start a merge, and the ratio of neighbouring tiers' sizes.
FAN_IN = 4
#: Times that a commit is tried anew after another writer's.
TRIES = 20
#: Seconds that superseded shards stay for readers of older versions.
RETENTION = 7 * 86400.0


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """Shards and manifests below one folder; all file work goes through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()[1:-5]) for x in self._fs.listStatus(folder) if x.getPath().getName().startswith("v"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``{"version", "schema", "time", "arrivals", "shards"}``; version 0 is empty.

        A shard is ``{"path", "bytes", "rows"}``; ``arrivals`` lists ``{"arrival",
        "version", "rows"}`` of all appends so far, in the order of their versions.
        """
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "time": 0.0, "arrivals": [], "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], arrivals: list[dict], schema: dict) -> dict:
        """Puts the version after ``base`` in place; raises Conflict if it exists."""
        new = {"version": base["version"] + 1, "schema": schema, "time": time.time(), "arrivals": arrivals, "shards": shards}
        folder = self._path(f"{self.root}/manifest")
        self._fs.mkdirs(folder)
        temp = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(temp, self._path(f"{self.root}/manifest/v{new['version']:010d}.json"), none)
        except Exception as e:
            self._fs.delete(temp, False)
            if "exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    def _committed(self, change: Callable[[dict], tuple[list[dict], list[dict], dict] | None]) -> dict | None:
        """Commits what ``change`` makes of the newest manifest, again after conflicts; None where it makes nothing of it."""
        for _ in range(TRIES):
            now = self.manifest()
            made = change(now)
            if made is None:
                return None
            try:
                return self.commit(now, *made)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other commits came first")

    def _written(self, folder: str) -> list[tuple[str, int, int]]:
        """(path, bytes, rows) of the shards below a folder; rows come from the files' footers."""
        found, it = [], self._fs.listFiles(self._path(folder), True)
        while it.hasNext():
            x = it.next()
            if x.getPath().getName().startswith("part-"):
                found.append((x.getPath().toString(), x.getLen()))
        if not found:
            return []
        count = self.spark.read.schema("_none int").parquet(*(p for p, _ in found)).groupBy(F.col("_metadata.file_path").alias("f")).count()
        rows = {x.f.split(":", 1)[-1].lstrip("/"): x["count"] for x in count.collect()}
        return [(p, n, int(rows.get(p.split(":", 1)[-1].lstrip("/"), 0))) for p, n in sorted(found)]

    def append(self, df: DataFrame, arrival: str) -> list[dict]:
        """Writes each value of ``arrival`` as shards, in one job, and commits a version for each in order of the values, null first.

        Null and an empty string are arrivals of their own. The column stays in
        the shards like any other.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        name = fresh(df, "_part")
        # folder names hold the value as hex, so that no value needs escapes or is null
        said = F.coalesce(F.concat(F.lit("v"), F.lower(F.hex(F.col(f"`{arrival}`").cast("string")))), F.lit("null"))
        df.withColumn(name, said).write.partitionBy(name).parquet(folder)
        by: dict[str, list[dict]] = {}
        for path, size, rows in self._written(folder):
            by.setdefault(path.rsplit(f"/{name}=", 1)[1].split("/")[0], []).append({"path": path, "bytes": size, "rows": rows})
        if not by:
            return []
        order = df.select(F.col(f"`{arrival}`").alias("a"), said.alias("k")).distinct().orderBy(F.col("a").asc_nulls_first()).collect()  # a row for each version to come
        out = []
        for x in order:
            if x.k in by:
                mine = by.pop(x.k)
                value = None if x.k == "null" else bytes.fromhex(x.k[1:]).decode()
                add = lambda now, mine=mine, value=value: ([*now["shards"], *mine], [*now["arrivals"], {"arrival": value, "version": now["version"] + 1, "rows": sum(s["rows"] for s in mine)}], df.schema.jsonValue())
                out.append(self._committed(add))
        return out

    def tier(self, size: int) -> int:
        """0 for shards of at least three quarters of the target, then 1, 2, ... as sizes fall by the fan-in."""
        n, edge = 0, 0.75 * self.target
        while size < edge and n < 12:
            n, edge = n + 1, edge / self.fan_in
        return n

    def full_tiers(self, manifest: dict) -> dict[int, list[dict]]:
        """Tiers below the target that hold ``fan_in`` shards or more."""
        tiers: dict[int, list[dict]] = {}
        for x in manifest["shards"]:
            if t := self.tier(x["bytes"]):
                tiers.setdefault(t, []).append(x)
        return {t: x for t, x in tiers.items() if len(x) >= self.fan_in}

    def compact(self) -> dict:
        """Merges tiers, smallest shards first, until none has ``fan_in`` shards; each merge is one version.

        If another writer has merged some of the same shards meanwhile, this
        merge's files go and the tiers are looked at anew; appends do not stand in
        its way.
        """
        while True:
            now = self.manifest()
            full = self.full_tiers(now)
            if not full:
                return now
            old = sorted(full[max(full)], key=lambda x: (x["bytes"], x["path"]))
            gone = {x["path"] for x in old}
            merged = [{"path": p, "bytes": n, "rows": r} for p, n, r in self._merge([x["path"] for x in old], StructType.fromJson(now["schema"]))]

            def swap(new: dict, gone=gone, merged=merged):
                if not gone <= {x["path"] for x in new["shards"]}:
                    return None
                return [*(x for x in new["shards"] if x["path"] not in gone), *merged], new["arrivals"], new["schema"]

            done = self._committed(swap)
            if done is None:
                for x in merged:
                    self._fs.delete(self._path(x["path"]), False)
            elif len(merged) >= len(old):  # the session splits files finer than the target
                return done

    def _merge(self, paths: list[str], schema: StructType) -> list[tuple[str, int, int]]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        own = self.spark.newSession()  # settings of its own
        for k, v in {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
            own.conf.set(k, v)
        own.read.schema(schema).parquet(*paths).write.parquet(folder)
        return self._written(folder)

    def vacuum(self, retention: float = RETENTION) -> list[str]:
        """Deletes shards that only versions name which were superseded ``retention`` seconds ago or more; returns their paths.

        Such versions can then no longer be read. Files that no version names are
        left alone: they may belong to a commit to come.
        """
        every = [self.manifest(v) for v in self.versions()]
        now = time.time()
        old = [m for m, after in zip(every, every[1:]) if now - after["time"] >= retention]
        kept = {x["path"] for m in every[len(old) :] for x in m["shards"]}
        gone = sorted({x["path"] for m in old for x in m["shards"]} - kept)
        for path in gone:
            self._fs.delete(self._path(path), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing was appended")
        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(*(x["path"] for x in m["shards"]))


def sharded(docs: DataFrame, arrival: str, root: str, target: int = TARGET) -> DataFrame:
    """Appends ``docs`` by arrival, compacts, and reads the newest version: the rows of ``docs``, whole and once each.

    Null arrivals are one arrival of their own; repeated rows stay as often as
    they come; columns may have any names. An empty table commits nothing and
    reads as empty. Superseded shards go at once, since no one reads the store's
    older versions.
    """
    store = ShardStore(docs.sparkSession, root, target)
    store.append(docs, arrival)
    if not store.version():
        return docs.where("false")
    store.compact()
    store.vacuum(0.0)
    return store.read()


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` through appends and compaction, with what the manifests say.

    ``version`` and ``version_rows`` are those of the row's arrival, ``total_rows``
    the rows of all shards of the newest version, ``compact`` whether no tier of it
    could be merged further.
    """
    docs = table(spark, sf_dir, "documents").withColumn("arrival", F.pmod("doc_id", F.lit(8)).cast("int"))
    root = f"{shared_dir(spark)}/orrery/shards-{uuid.uuid4().hex}"
    out = sharded(docs, "arrival", root)
    store = ShardStore(spark, root)
    last = store.manifest()
    said = spark.createDataFrame([(x["arrival"], x["version"], x["rows"]) for x in last["arrivals"]], "a string, version long, version_rows long")  # a row for each append
    text = F.coalesce("text", F.lit(""))
    return out.join(F.broadcast(said), F.col("arrival").cast("string").eqNullSafe(F.col("a")), "left").select(
        "doc_id",
        F.char_length(text).cast("long").alias("n_chars"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        "arrival",
        "version",
        "version_rows",
        F.lit(sum(x["rows"] for x in last["shards"])).cast("long").alias("total_rows"),
        F.lit(not store.full_tiers(last)).alias("compact"),
    )


ORACLE = """
SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS text_sha256, CAST(doc_id % 8 AS INTEGER) AS arrival,
       dense_rank() OVER (ORDER BY doc_id % 8 NULLS FIRST) AS version, count(*) OVER (PARTITION BY doc_id % 8) AS version_rows,
       count(*) OVER () AS total_rows, TRUE AS compact
FROM documents
"""
