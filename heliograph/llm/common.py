"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import keep as spool
from ..scratch import new_dir, new_table, set_option

__all__ = ["id_text", "new_dir", "new_table", "parallelism", "spool", "table", "wide_rows", "with_row"]

#: Rows that hold whole texts or blocks are large, so Spark reads and hands them over a few hundred at a time.
WIDE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def wide_rows(spark: SparkSession) -> None:
    for key, value in WIDE_ROWS.items():
        set_option(spark, key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    wide_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(documents: DataFrame) -> DataFrame:
    """The two columns that text operators need, whatever else the table carries; null text stays null."""
    wide_rows(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_row(documents: DataFrame, carry: list[str], result: str) -> tuple[DataFrame, StructType]:
    """id_text, with the columns in carry as one struct `row` behind it if there are any; and result's schema with the same struct."""
    schema = StructType.fromDDL(result)
    if not carry:
        return id_text(documents), schema
    wide_rows(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*carry).alias("row"))
    return rows, schema.add(rows.schema["row"])
