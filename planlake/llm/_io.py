"""Reading the given tables and cutting lineage with tables written to the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Sides of at most so many bytes may be broadcast; every caller has another way beyond it.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="planlake-")


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a session that runs in one process gets a folder of its own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def free(name: str, columns: Sequence[str]) -> str:
    """name, or name with underscores before it, so that it is none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for one action; names have ``__`` for dots."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Written:
    """A table in the shared folder: it outlives executors and has no lineage."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def leave(self) -> DataFrame:
        """The table, for a result that is read later: it is deleted when the session's file system closes."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        return self.df


def written(df: DataFrame, tag: str) -> Written:
    """Write df and read it back. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/planlake/{uuid.uuid4().hex}-{tag}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return Written(spark.read.schema(df.schema).parquet(path), path)
