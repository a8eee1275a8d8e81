"""A folder that driver and executors share, and small files of the package put there."""

from __future__ import annotations

import atexit
import importlib.resources
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own; on a cluster it is an error, as executors don't share local folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veridane-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where.rstrip('/')}/veridane-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet. What is there goes when the application ends."""
    folder = shared_dir(spark)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(cleared, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def cleared(folder: str) -> None:
    """Deletes an application's folder, through Spark's own file system, if Spark still runs."""
    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None and folder.endswith(context.applicationId):
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def package_text(package: str, name: str) -> str:
    return importlib.resources.files(package).joinpath(name).read_text(encoding="utf-8")


#: Paths of package files that are there already, by application, package and name.
_SHIPPED: dict[tuple[str, str, str], str] = {}


def shipped(spark: SparkSession, package: str, name: str) -> str:
    """The path, for Spark's readers, of a small file of the package, written by Spark itself, once an application."""
    key = (shared_dir(spark), package, name)
    if key not in _SHIPPED:
        path = fresh(spark, name)
        spark.createDataFrame([(package_text(package, name).removesuffix("\n"),)], "value string").coalesce(1).write.text(path)
        _SHIPPED[key] = path
    return _SHIPPED[key]


def shipped_folder(spark: SparkSession, package: str, names: list[str]) -> str:
    """A folder with small files of the package, each under its own name, put there once an application."""
    key = (shared_dir(spark), package, "")
    if key not in _SHIPPED:
        folder = fresh(spark, package)
        for name in names:
            spark.createDataFrame([(package_text(package, name).removesuffix("\n"),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
        _SHIPPED[key] = folder
    return _SHIPPED[key]
