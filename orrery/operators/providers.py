"""Models as providers: a registry, jobs that run in Arrow batches, and resuming by what is done.

A provider loads once in a task and answers batches. Finished jobs are appended
to a table under a run's id, so a run that ended early goes on with the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions.arrays import in_order
from orrery.session import shared_dir

#: Jobs answered at once.
BATCH = 32


class Provider(Protocol):
    """What a model must offer. ``schema`` are the columns of a result besides ``job``."""

    schema: str

    def load(self) -> None: ...

    def answer(self, jobs: pd.DataFrame) -> pd.DataFrame: ...


_providers: dict[str, Callable[..., Provider]] = {}
_aliases: dict[str, str] = {}


def register(name: str, make: Callable[..., Provider], aliases: tuple[str, ...] = ()) -> None:
    _providers[name] = make
    _aliases.update(dict.fromkeys(aliases, name))


def provider(name: str, **options) -> Provider:
    """The provider of a name or alias; an unknown one fails with those there are."""
    key = _aliases.get(name, name)
    if key not in _providers:
        raise KeyError(f"no provider {name}; there are: {', '.join(sorted(_providers))}")
    return _providers[key](**options)


def providers() -> list[str]:
    return sorted(_providers)


def run_id(model: str, options: dict, jobs: DataFrame) -> str:
    """An id of the model, its options and all jobs, whatever their order."""
    n = jobs.agg(F.count("*"), F.sum(F.xxhash64(*jobs.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([model, options, int(n[0]), str(n[1])], sort_keys=True, default=str).encode()).hexdigest()[:16]


def run(jobs: DataFrame, model: Provider, batch: int = BATCH) -> DataFrame:
    """``(job, ...)``: a result of each job (columns job and what the model takes). A job without a result fails."""
    out = StructType.fromDDL(f"job string, {model.schema}")

    def answers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = False
        for d in parts:
            for at in range(0, len(d), batch):
                if not loaded:
                    model.load()
                    loaded = True
                some = d.iloc[at : at + batch].reset_index(drop=True)
                got = model.answer(some)
                if len(got) != len(some):
                    raise ValueError(f"{len(some)} jobs, {len(got)} results")
                got.insert(0, "job", some["job"].astype(str))
                yield got[out.names]

    return jobs.withColumn("job", F.col("job").cast("string")).mapInPandas(answers, out)


def resumed(spark: SparkSession, jobs: DataFrame, model: Provider, name: str, options: dict | None = None, parts: int = 1, no_resume: bool = False) -> DataFrame:
    """``run``, in ``parts`` written one after another under the run's id; jobs that are done already are not run again."""
    folder = f"{shared_dir(spark)}/orrery/runs/{run_id(name, options or {}, jobs)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if no_resume and fs.exists(path):
        fs.delete(path, True)
    schema = StructType.fromDDL(f"job string, {model.schema}")
    done = lambda: spark.read.schema(schema).parquet(folder) if fs.exists(path) else spark.createDataFrame([], schema)
    for i in range(parts):
        todo = jobs.where(F.pmod(F.xxhash64("job"), F.lit(parts)) == i).join(done().select("job"), "job", "left_anti")
        run(todo, model).write.mode("append").parquet(folder)
    return done()


# results into records


def classified(results: DataFrame, threshold: float | None = None, probs: str = "probs") -> DataFrame:
    """``results`` with ``label`` and ``score``: the most probable class (array of label, score; ties to the first), without a label below ``threshold``."""
    best = F.aggregate(probs, F.get(probs, 0), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    d = results.withColumn("_b", F.when(F.size(probs) > 0, best))
    label = F.col("_b.label") if threshold is None else F.when(F.col("_b.score") >= threshold, F.col("_b.label"))
    return d.withColumn("label", label).withColumn("score", F.col("_b.score")).drop("_b")


def appended(records: DataFrame, results: DataFrame, record: str, column: str, item: Column, order: str = "job") -> DataFrame:
    """``records`` with what results give appended to an array, in order of the job."""
    new = results.groupBy(record).agg(F.transform(in_order(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))), "o"), lambda s: s["x"]).alias("_new"))
    none = F.array().cast(records.schema[column].dataType)
    return records.join(new, record, "left").withColumn(column, F.concat(F.coalesce(column, none), F.coalesce(F.col("_new").cast(records.schema[column].dataType), none))).drop("_new")


class Stub:
    """A model without weights: probabilities by hash of the input, for tests and dry runs."""

    schema = "probs array<struct<label:string,score:double>>, answer string"

    def __init__(self, labels: tuple[str, ...] = ("a", "b"), column: str = "question"):
        self.labels, self.column, self.loads = labels, column, 0

    def load(self) -> None:
        self.loads += 1

    def answer(self, jobs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x in jobs[self.column].astype(str):
            h = hashlib.sha256(x.encode()).digest()
            total = sum(h[: len(self.labels)]) or 1
            probs = [{"label": k, "score": b / total} for k, b in zip(self.labels, h)]
            rows.append((probs, max(probs, key=lambda p: p["score"])["label"]))
        return pd.DataFrame(rows, columns=["probs", "answer"])


register("stub", Stub, ("test",))
