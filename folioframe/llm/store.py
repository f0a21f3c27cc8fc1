"""Intermediate tables in the folder that the cluster shares.

``scratch`` is a folder of this application under ``spark.checkpoint.dir``;
only on a local master may that setting be missing (tests, a laptop), where a
folder of its own is made and removed with the process.  ``save`` writes a
DataFrame there and reads it back: lineage ends at files that outlive any
executor, and Spark deletes the shuffle files behind it when the write ends.

A table belongs to the ``Scope`` in whose ``with`` block it was saved and is
deleted by that scope alone; tables saved outside of any scope stay until
``clear`` removes the application's folder, as a DataFrame that was returned
may still be read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[Scope] = []


class Scope:
    """An owner of saved tables: ``with scope:`` records what save writes, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scopes.remove(self)

    def drop(self, keep: int = 0) -> None:
        """Delete the scope's tables but for the last ``keep``; only once nothing that reads them is to run."""
        for path in self.paths[: len(self.paths) - keep]:
            delete(self.spark, path)
        self.paths = self.paths[len(self.paths) - keep :]


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession) -> str:
    """The application's folder for intermediate tables."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("folioframe.scratch.dir", None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="folioframe-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        top = "file://" + made
        spark.conf.set("folioframe.scratch.dir", top)
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/folioframe-{sc.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application."""
    delete(spark, scratch(spark))


def save(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """df written to the scratch folder and read back; its schema is kept."""
    return saved(df, name, partitions)[0]


def saved(df: DataFrame, name: str, partitions: list[str] | None = None) -> tuple[DataFrame, str]:
    """Like save, and the path."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].paths.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=partitions)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free(name: str, taken: list[str]) -> str:
    """name, or with as many underscores before it as it takes to differ from all taken names (case ignored)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key() -> Column:
    """A key of id and text; null ids and null texts have one too."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), "text")
