"""Point lookups, pages and structured search. Descending order puts nulls first, ascending order last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = ("domain", "area", "subtopic")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int")


def page(rows: DataFrame, *order: Column, limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(*order).offset(offset).limit(limit)


def get(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.where(F.col(key) == value)


def best_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first in order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def topics_by_name(topics: DataFrame) -> DataFrame:
    """Of topics with one name the deepest, then the least id."""
    return best_by(topics, "name", level_rank(F.col("level")).desc(), F.col("id"))


def contains_ci(column: str, text: str | None) -> Column:
    return F.lit(True) if text is None else F.lower(column).contains(text.lower())


def structured_search(problems: DataFrame, belongs: DataFrame, extracted: DataFrame, papers: DataFrame, topic_ids: DataFrame | None = None, status: str | None = None, year_from: int | None = None, year_to: int | None = None, top_k: int = 10) -> DataFrame:
    """Problems under any of the topics, with the status, from a paper of these years; newest first, score 1."""
    out = problems
    if status is not None:
        out = out.where(F.col("status") == status)
    if topic_ids is not None:
        under = belongs.join(topic_ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        out = out.join(under, "id", "left_semi")
    if year_from is not None or year_to is not None:
        fits = papers.where((F.col("year") >= (year_from if year_from is not None else -(1 << 31))) & (F.col("year") <= (year_to if year_to is not None else (1 << 31) - 1)))
        dated = extracted.join(fits.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        out = out.join(dated, "id", "left_semi")
    return out.orderBy(F.col("created_at").desc_nulls_first(), "id").limit(top_k).withColumn("score", F.lit(1.0))


def top_by_confidence(rows: DataFrame, group: str, confidence: str, ordinal: str, least: float = 0.5, most: int = 10) -> DataFrame:
    """Rows of enough confidence; of a group with more than `most` of them, the most confident, in their order."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.col(confidence).desc(), ordinal))
    return rows.where(F.col(confidence) >= least).withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
