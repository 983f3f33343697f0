"""Reading of the corpus tables, and taking documents out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import written

#: Ids that a broadcast may hold; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has it."""
    while name.lower() in {x.lower() for x in df.columns}:
        name = "_" + name
    return name


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids`` (one column); null ids stay, and ``docs`` may have any other columns."""
    name = fresh(docs, "_gone")
    gone = ids.toDF(name)
    gone = written(gone.where(gone[name].isNotNull()).distinct(), "dropped")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_anti")
