"""Batches of extraction jobs as state: creating, adding, updating, what is pending, what to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import patch

JOB = "job_id string, batch_id string, source string, status string, attempts int, problems int, error string, created_at timestamp, updated_at timestamp"


def create(sources: DataFrame, batch_id: str, now: Column) -> DataFrame:
    """A pending job for each different source of a batch."""
    return sources.select("source").distinct().select(
        F.substring(F.sha2(F.concat_ws("\x1f", F.lit(batch_id), "source"), 256), 1, 16).alias("job_id"), F.lit(batch_id).alias("batch_id"), "source", F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), F.lit(0).alias("problems"), F.lit(None).cast("string").alias("error"), now.alias("created_at"), now.alias("updated_at"),
    )


def add(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with new ones, by job_id; a job that is there stays as it is."""
    return jobs.unionByName(new.dropDuplicates(["job_id"]).join(jobs.select("job_id"), "job_id", "left_anti"), allowMissingColumns=True)


def update(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Non-null columns of changes (by job_id) replace those of jobs, and updated_at is now."""
    return patch(jobs, changes.withColumn("updated_at", now), "job_id", None)


def pending(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """Of each batch the pending jobs that were created first, at most limit of them."""
    nth = F.row_number().over(Window.partitionBy("batch_id").orderBy("created_at", "job_id"))
    return jobs.where("status = 'pending'").withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def of_batch(jobs: DataFrame, batch_id: str) -> DataFrame:
    return jobs.where(F.col("batch_id") == batch_id)


def resume(jobs: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Jobs of interrupted batches that are to run again: pending ones, those that were in progress, and failed ones that have attempts left."""
    again = (F.col("status") == "in_progress") | ((F.col("status") == "failed") & (F.coalesce("attempts", F.lit(0)) < most_attempts))
    return jobs.where((F.col("status") == "pending") | again).withColumn("status", F.lit("pending"))
