"""Extension: new records as a stream, merged batch by batch into versioned state; and counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _versions(spark: SparkSession, state_dir: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/{n}/_SUCCESS")))


def maintain(stream: DataFrame, state_dir: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, hold: int = 3) -> StreamingQuery:
    """Keep state_dir/version=N: each batch merges into the version before and writes the next; the last `hold` versions stay.

    A new checkpoint goes on from the state that is there: it notes the version at which it began, so a batch that is run
    again writes its own version again, from the same one before.
    """
    spark = stream.sparkSession
    note = f"{checkpoint}/began"
    try:
        began = spark.read.json(note, schema="version long").first()["version"]
    except AnalysisException:
        began = max(_versions(spark, state_dir), default=-1)
        spark.createDataFrame([(began,)], "version long").coalesce(1).write.json(note)

    def step(batch: DataFrame, number: int) -> None:
        version = began + 1 + number
        before = batch.sparkSession.read.parquet(f"{state_dir}/version={version - 1}") if version else None
        merge(before, batch).write.mode("overwrite").parquet(f"{state_dir}/version={version}")
        for old in _versions(spark, state_dir):
            if old <= version - hold:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/version={old}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def latest_state(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.parquet(f"{state_dir}/version={_versions(spark, state_dir)[-1]}")
