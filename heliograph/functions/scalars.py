"""Small column functions of ingestion and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beginnings of lines that are page furniture (in lower case).
FURNITURE = ("preprint.", "under review", "proceedings of")
# Kinds of constraint, and the words that lead to one if none is named.
CONSTRAINTS = ("computational", "data", "methodological", "theoretical")
CONSTRAINT_HINTS = (("computational", ("compute", "gpu", "memory")), ("data", ("dataset", "annotation")), ("methodological", ("method", "algorithm")), ("theoretical", ("theory",)))


def page_furniture(line: Column) -> Column:
    """Whether a trimmed line is a page number ("7", "- 7 -", "Page 7 of 9"), an archive stamp or a running title."""
    low = F.lower(line)
    number = F.regexp_replace(low, r"^(page\s+|-\s*)|(\s*of\s+\d+|\s*-)$", "")
    titled = F.array_max(F.array(*(low.startswith(x) for x in FURNITURE)))
    return (number.rlike(r"^\d+$") & (~low.contains("of") | low.startswith("page")) & (low.startswith("-") == low.endswith("-"))) | low.rlike(r"^arxiv:\d{4}\.\d{4,5}") | titled


def constraint_type(value: Column) -> Column:
    v = F.trim(F.lower(value))
    out = F.when(v.isin(*CONSTRAINTS), v)
    for kind, words in CONSTRAINT_HINTS:
        out = out.when(v.rlike("|".join(words)), kind)
    return out.otherwise("methodological")


def tokens_estimate(prompt: Column, system: Column, answer: int) -> Column:
    return F.floor((F.coalesce(F.length(prompt), F.lit(0)) + F.coalesce(F.length(system), F.lit(0))) / 4) + answer


def retry_after(header: Column, message: Column) -> Column:
    """Seconds to wait: the header's, else "try again in 20ms" or "1.8s" of the message."""
    found = r"(?i)try again in ([\d.]+)\s*(ms|s)\b"
    n = F.regexp_extract(message, found, 1).try_cast("double")
    return F.coalesce(header.try_cast("double"), F.when(F.lower(F.regexp_extract(message, found, 2)) == "ms", n / 1000).otherwise(n))


def backoff(attempt: Column, first: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(factor), attempt), F.lit(most))


def download_failure(message: Column) -> Column:
    return F.when(message.contains("404"), "failed_404").otherwise("failed_blocked")


def problem_number(value: Column) -> Column:
    """N of "problem N" or of a plain integer, else null."""
    return F.coalesce(F.regexp_extract(F.lower(value), r"problem\s*(\d+)", 1).try_cast("int"), F.trim(value).try_cast("int"))


def numbered_ends(relations: DataFrame, problems: DataFrame, by: str) -> DataFrame:
    """Relations whose ends are numbers of the text's problems (by, ordinal from 1, statement) get their statements; numbers out of range drop the relation, and unnumbered ones stay."""
    p = lambda end: problems.select(by, F.col("ordinal").alias(f"{end}_no"), F.substring("statement", 1, 100).alias(f"{end}_text"))
    r = relations.withColumn("source_no", problem_number(F.col("source"))).withColumn("target_no", problem_number(F.col("target")))
    both = (F.coalesce("source_no", F.lit(0)) != 0) & (F.coalesce("target_no", F.lit(0)) != 0)
    found = r.join(p("source"), [by, "source_no"], "left").join(p("target"), [by, "target_no"], "left")
    kept = found.where(~both | (F.col("source_text").isNotNull() & F.col("target_text").isNotNull()))
    return kept.select(*(F.when(both, F.col(f"{c}_text")).otherwise(F.col(c)).alias(c) if c in ("source", "target") else F.col(c) for c in relations.columns))
