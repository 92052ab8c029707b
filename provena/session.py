"""Session set-up and the shared folder every lineage cut goes through."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes: list[dict[str, SparkSession]] = []


def build_session(app: str = "provena", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = "file://" + os.path.join(tempfile.gettempdir(), "provena-checkpoints")
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and reread it: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _scopes:
        _scopes[-1][path] = spark
    with small_batches(spark), freed_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "4m"):
    """Jobs run inside send at most so many bytes at once to a Python worker, which then needs little memory for long texts."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def one_at_once(spark: SparkSession):
    """Jobs run inside give a row at once to a Python function of rows, for rows that are large; else a hundred wait together."""
    return _setting(spark, "spark.sql.execution.python.udf.maxRecordsPerBatch", "1")


def freed_shuffles(spark: SparkSession):
    """Queries run inside drop their shuffle files when they end; else these stay until the driver happens to collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Sets that bound for the session, unless it has a smaller one: for results that run only after a call has returned."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    n = int(now.rstrip("kmg") or 0) * units.get(now[-1:], 1)
    if n <= 0 or n > int(size[:-1]) * units[size[-1]]:
        spark.conf.set(key, size)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder or file through its own file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remove(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote, once nothing that is still to run reads them; others are left alone."""
    for df in tables:
        if path := getattr(df, "cut_path", None):
            delete_path(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut inside the block are removed at its end, but for those given to what the block gets; they pass to an outer block."""
    made: dict[str, SparkSession] = {}
    kept: list[str] = []
    _scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.cut_path)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        for path, spark in made.items():
            if path not in kept:
                delete_path(spark, path)
            elif _scopes:
                _scopes[-1][path] = spark


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, none with more than twice its share of the rows; else left as it is.

    A file has as many splits as its bytes ask for, but all rows of a row group fall to one of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n >= cores:
        rows = [r["rows"] for r in df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("rows")).collect()]
        if max(rows, default=0) * cores <= 2 * sum(rows):
            return df
    return df.repartition(max(n, cores))
