"""Curated lists as rows: seed models, labelled pairs, denied terms. They come as parsed mappings, or as a YAML file where a parser is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import integrate as I
from ..operators import resolve as E

MODEL = "name string, description string, aliases array<string>, architecture string, model_type string, year_introduced int, introducing_paper_doi string"
PAIR = "a string, b string, label string, a_description string, b_description string"


def read(path: str) -> object:
    """Parsed YAML; raises where no parser is installed."""
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("reading YAML needs the yaml package; pass parsed mappings instead") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _rows(spark: SparkSession, entries: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], schema)


def models(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Seed models; raises if one has no name or a name comes twice."""
    names = [(e.get("name") or "").strip() for e in entries]
    if not all(names) or len({n.lower() for n in names}) < len(names):
        raise ValueError("every seed model needs a name of its own")
    return _rows(spark, [{**e, "name": n, "aliases": list(e.get("aliases") or [])} for e, n in zip(entries, names)], MODEL)


def pairs(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Labelled pairs (same or different); raises at one that is not complete."""
    for k, e in enumerate(entries):
        if not e.get("a") or not e.get("b") or e.get("label") not in ("same", "different"):
            raise ValueError(f"pair {k}: a, b and a label of same or different are needed")
    return _rows(spark, entries, PAIR)


def denied(entries: list[dict | str], *more: str) -> tuple[str, ...]:
    """Lower-case terms of a deny list (strings, or mappings with `term`) and further ones, sorted."""
    terms = [e if isinstance(e, str) else e.get("term") for e in entries]
    return tuple(sorted({t.strip().lower() for t in (*terms, *more) if t and t.strip()}))


def load_models(state: DataFrame, seeds: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(models, report) after seeds (of models(), with `vector`) as canonical models: each is merged into a near model or created; seeds that were loaded before merge into themselves.

    state: id, name, description, aliases, vector, is_canonical and more. report: one row, created and merged.
    """
    made = F.substring(F.sha2(F.concat(F.lit("seed/"), F.lower("name")), 256), 1, 16)
    nth = F.row_number().over(Window.orderBy("name"))  # curated lists are short
    incoming = seeds.withColumns({"id": made, "is_canonical": F.lit(True)}).withColumn("ordinal", nth)
    incoming = incoming.select("ordinal", *(c for c in incoming.columns if c in state.columns))
    again = incoming.join(state.select("id"), "id", "left_semi")
    new, outcome = I.create_or_merge(E.merge_into(state, again), incoming.join(state.select("id"), "id", "left_anti"), threshold)
    first = outcome.agg(F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("merged"))
    return new, first.select("created", (F.col("merged") + again.agg(F.count("*")).scalar()).alias("merged"))
