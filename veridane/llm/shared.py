"""Tables in the folder that driver and executors share; they cut lineage and outlive a lost executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from veridane.sources.scratch import shared_dir

#: Paths written within each scope() that is open here; each thread has its own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _SCOPES.get()[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veridane_path = path
    return out


def path_of(table: DataFrame) -> str | None:
    """Where written() has put a table."""
    return getattr(table, "_veridane_path", None) if "_veridane_path" in vars(table) else None


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables through Spark's own file system."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    for t in tables:
        if (path := path_of(t)) is not None:
            removed(t.sparkSession, [path])


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, all tables written within but those put into the list it gives; these go to the scope around it, if there is one."""
    made: list[str] = []
    keep: list[DataFrame] = []
    around = _SCOPES.get()
    mark = _SCOPES.set((*around, made))
    try:
        yield keep
    finally:
        _SCOPES.reset(mark)
        held = {path_of(t) for t in keep}
        for paths in around[-1:]:
            paths.extend(p for p in made if p in held)
        removed(spark, [p for p in made if p not in held])
