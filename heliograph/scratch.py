"""Intermediate results in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}
_OPTIONS: dict[str, dict[str, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a temporary one for a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        base = _OWN[context.applicationId]
    return base.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def new_table(spark: SparkSession, label: str) -> str:
    name = f"{label}_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def keep(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = new_dir(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by_key(df: DataFrame, key: str, label: str, row_group: int = 1 << 20) -> str:
    """Write df to the shared folder in the order of key, over all files, in row groups of about so many bytes: whoever looks for some keys opens few of them. Gives the folder."""
    path = new_dir(df.sparkSession, label)
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.size", str(row_group)).parquet(path)
    return path


def set_option(spark: SparkSession, key: str, value: str) -> None:
    """Set a session option until clear(), which puts back what it was."""
    _OPTIONS.setdefault(spark.sparkContext.applicationId, {}).setdefault(key, spark.conf.get(key, None))
    spark.conf.set(key, value)


@contextmanager
def options_for(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Session options for what is written inside."""
    old = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clear(spark: SparkSession) -> int:
    """Remove every folder and table that this application's operators made, put back the session options that they set, and give the number of folders and tables. Call it when their results are written; scope() does it for a part of an application."""
    for key, old in _OPTIONS.pop(spark.sparkContext.applicationId, {}).items():
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    paths, tables = (made.pop(spark.sparkContext.applicationId, []) for made in (_MADE, _TABLES))
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths) + len(tables)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What operators make inside is removed at the end, and options that they set there are put back; what was made before, or outside, stays. Write a result before its scope ends. Scopes may lie in one another."""
    app = spark.sparkContext.applicationId
    outer = [(made, made.pop(app, None)) for made in (_MADE, _TABLES, _OPTIONS)]
    try:
        yield
    finally:
        clear(spark)
        for made, before in outer:
            if before is not None:
                made[app] = before
