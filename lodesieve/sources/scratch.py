"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing a table and reading it again.
The folder comes from ``spark.checkpoint.dir``, which every executor can reach,
so a lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` wins.  Where it is unset, a local
    session gets a temporary folder; a cluster session gets an error, since a
    folder of one machine would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    folder = getattr(shared_folder, "local", None)
    if folder is None:
        folder = shared_folder.local = "file://" + tempfile.mkdtemp(prefix="lodesieve-")
    return folder


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one run; they go when the program ends, or with ``drop``."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and give back the written table, with no lineage behind it."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def close(self) -> None:
        with contextlib.suppress(Exception):
            delete(self.spark, self.root)
