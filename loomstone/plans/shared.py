"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where one machine is all."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loomstone-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table or folder, wherever its file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Steps:
    """The tables of one job: ``steps(df, tag)`` writes df as Parquet in the shared folder and reads it back.

    Unlike a local checkpoint this survives lost executors, and later stages start from files. ``drop``
    deletes tables that nothing reads any more, ``drop_all_but`` those that the job's result doesn't read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/loomstone-{uuid.uuid4().hex}", []

    def __call__(self, df: DataFrame, tag: str = "step") -> DataFrame:
        path = f"{self.root}/{len(self.tables)}-{tag}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *done: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is d for d in done):
                delete(self.spark, path)

    def drop_all_but(self, *needed: DataFrame) -> None:
        self.drop(*[table for table, _ in self.tables if not any(table is n for n in needed)])


def materialise(df: DataFrame, tag: str = "step") -> DataFrame:
    """One table of a job that has no others to delete."""
    return Steps(df.sparkSession)(df, tag)
