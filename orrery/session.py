"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Only used by local sessions that name no shared folder, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Spark's settings while a table is written: a query's shuffle files go when it has ended, and what is sent to Python at once is small.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine, as the tests and the benchmark use it."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orrery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset and gets a local folder; on a cluster
    that is an error, since executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/orrery/{spark.sparkContext.applicationId}"


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The session's settings of ``WRITING`` within, and as they were after."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage: what follows reads files that outlive any executor.
    ``dropped`` removes a table that nothing reads again, ``clear`` all tables of
    the application.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads again."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote; results that were not saved can then no longer be read."""
    _delete(spark, _folder(spark))
