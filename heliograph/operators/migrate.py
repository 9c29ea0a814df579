"""Migrations in steps: each step's tables and the note that it is done appear together, so a run that stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versioned
from . import resolve as E
from . import state as U
from . import taxonomy as Y

LEDGER = "nth int, step string, version int, finished_at timestamp"
#: The table of the versions' folder that holds the ledger.
NAME = "ledger"

Step = tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The steps that are done (LEDGER), with the version that each made."""
    have = versioned.manifest(spark, path)
    return versioned.read(spark, path, NAME) if NAME in have else spark.createDataFrame([], LEDGER)


def run(spark: SparkSession, path: str, steps: list[Step], inputs: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, ledger) after all steps, which are named functions from the tables so far to those that they make or change.

    A step's tables are published with its entry in the ledger, as one version. A run that finds steps done begins with the first that
    is not, on the tables of the latest version; inputs are what the first step sees beside them. Raises if the steps
    done are not the first of these steps, as then it is another migration's folder.
    """
    if len({name for name, _ in steps}) < len(steps):
        raise ValueError("every step needs a name of its own")
    done = [r["step"] for r in ledger(spark, path).orderBy("nth").collect()]
    if done != [name for name, _ in steps][: len(done)]:
        raise ValueError(f"{path} has the steps of another migration: {', '.join(done)}")

    def tables() -> dict[str, DataFrame]:
        return {**inputs, **{name: versioned.read(spark, path, name) for name in versioned.manifest(spark, path) if name != NAME}}

    for nth, (name, step) in enumerate(steps[len(done) :], len(done)):
        made = step(tables())
        version = max(versioned.versions(spark, path), default=0) + 1
        entry = spark.range(1).select(F.lit(nth).alias("nth"), F.lit(name).alias("step"), F.lit(version).alias("version"), F.current_timestamp().alias("finished_at"))
        versioned.publish(spark, path, {**made, NAME: ledger(spark, path).unionByName(entry)})
    return tables(), ledger(spark, path)


def domains_to_topics(embed: Callable[[DataFrame], DataFrame], least: float, domain: str = "domain") -> list[Step]:
    """The steps from plain domain names to topics: tables `problems` (id, and the domain) and `topics` in; `topics` and `belongs` (edges) out.

    Names become area topics; those without a vector get one (embed adds `vector`); near topics of the migration become one, under the
    longest name, and edges follow; topics count their problems. `merged` tells which topic went into which.
    """

    def topics(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        known = t["topics"].select("id", "name", "level", "parent_id")
        all_, edges = Y.from_domains(t["problems"], known, domain)
        return {"topics": all_, "belongs": edges}

    def vectors(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        areas = embed(t["topics"].where("level = 'area'").select("id", "name"))
        return {"vectors": areas.select("id", F.col("vector").cast("array<double>").alias("vector"))}

    def merged(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        mine = t["belongs"].select(F.col("dst").alias("id")).distinct()
        groups = E.near_groups(t["vectors"].join(mine, "id", "left_semi"), least).select("id", "component").join(t["topics"].select("id", "name"), "id")
        kept = E.canonical(groups.withColumn("created_at", F.lit(0)))
        went = groups.join(kept, "component").where("id <> keep_id").select("id", "keep_id")
        return {"merged": went}

    def rewired(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        edges = E.rewire(t["belongs"], t["merged"])
        left = t["topics"].join(t["merged"].select("id"), "id", "left_anti")
        return {"belongs": edges, "topics": U.with_counter(left, edges, "problem_count")}

    return [("topics", topics), ("vectors", vectors), ("merged", merged), ("rewired", rewired)]
