"""The review queue: priorities, deadlines, escalation, pages and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import one_per_key


def priority(top_score: Column) -> Column:
    """5 and more for less certain candidates, 10 at most and without any."""
    return F.when(top_score.isNull(), 10).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), 5 + ((1 - top_score) * 5).cast("int"))))


def hours(priority: Column) -> Column:
    return F.when(priority <= 3, 24).when(priority <= 6, 168).otherwise(720)


def word(priority: Column) -> Column:
    return F.when(priority <= 3, "high").when(priority <= 6, "medium").otherwise("low")


def escalation(rounds: Column, max_rounds: Column, evaluator: Column, certainty: Column) -> Column:
    return F.when(rounds >= max_rounds, "max_rounds_exceeded").when(evaluator == "escalate", "evaluator_escalate").when(certainty < 0.7, "arbiter_low_confidence").otherwise("unknown")


def enqueue(mentions: DataFrame, suggestions: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """A pending review for each mention (id): its best suggestions (query_id, id, score), priority and deadline."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id")))
    best = F.sort_array(F.collect_list(F.struct("score", "id")), False)
    s = suggestions.withColumn("nth", nth).where(F.col("nth") <= most).groupBy(F.col("query_id").alias("mention_id")).agg(best.alias("suggested"), F.max("score").alias("top"))
    p = priority(F.col("top"))
    return (
        mentions.select(F.col("id").alias("mention_id")).join(s, "mention_id", "left")
        .select("mention_id", "suggested", p.alias("priority"), (now + F.make_interval(hours=hours(p))).alias("sla_deadline"), F.lit("pending").alias("status"))
    )


def pending(reviews: DataFrame, limit: int = 20, most: int | None = None) -> DataFrame:
    rows = reviews.where("status = 'pending'")
    rows = rows if most is None else rows.where(F.col("priority") <= most)
    return rows.orderBy("priority", F.col("sla_deadline").asc_nulls_last(), "mention_id").limit(limit)


def resolve(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions (mention_id, resolution, concept_id, resolved_by); linking needs a concept, and a resolved review stays as it is."""
    decisions = one_per_key(decisions.where("resolution is not null and resolved_by is not null and (resolution <> 'linked' or concept_id is not null)"), "mention_id")
    d = decisions.select("mention_id", F.col("resolution").alias("r"), F.col("concept_id").alias("c"), F.col("resolved_by").alias("u"))
    hit = F.col("r").isNotNull() & (F.col("status") != "resolved")
    new = {"status": F.lit("resolved"), "resolution": F.col("r"), "concept_id": F.col("c"), "resolved_by": F.col("u")}
    have = reviews.columns
    rows = reviews.withColumns({k: F.lit(None).cast("string") for k in new if k not in have})
    return rows.join(d, "mention_id", "left").select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def assign(reviews: DataFrame, assignments: DataFrame, now: Column) -> DataFrame:
    """Give reviews (by mention_id) to a person: status, assigned_to and assigned_at; of several assignments the last by `ordinal`. Resolved ones stay as they are."""
    d = one_per_key(assignments, "mention_id").select("mention_id", F.col("user_id").alias("u"))
    hit = F.col("u").isNotNull() & (F.col("status") != "resolved")
    rows = reviews.withColumns({k: F.lit(None).cast(t) for k, t in (("assigned_to", "string"), ("assigned_at", "timestamp")) if k not in reviews.columns})
    new = {"status": F.lit("assigned"), "assigned_to": F.col("u"), "assigned_at": now}
    return rows.join(d, "mention_id", "left").select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def unassign(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """Return assigned reviews (mention_id) to the queue."""
    hit = reviews.join(ids.select("mention_id", F.lit(True).alias("hit")).distinct(), "mention_id", "left")
    back = F.col("hit") & (F.col("status") == "assigned")
    new = {"status": F.lit("pending"), "assigned_to": F.lit(None).cast("string"), "assigned_at": F.lit(None).cast("timestamp")}
    return hit.select(*(F.when(back, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in reviews.columns))


def refined(concepts: DataFrame, statements: DataFrame, now: Column) -> DataFrame:
    """Concepts after refinement: those that to_refine() names and for which there is a new statement (id, statement) take it, at the next version."""
    due = to_refine(concepts).select("id").join(one_per_key(statements, "id").select("id", F.col("statement").alias("new_statement")), "id").where("trim(new_statement) <> ''")
    hit = F.col("new_statement").isNotNull()
    new = {"canonical_statement": F.col("new_statement"), "version": F.coalesce("version", F.lit(0)) + 1, "last_refined_at_count": F.col("mention_count"), "updated_at": now}
    return concepts.join(due, "id", "left").select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in concepts.columns))


def to_refine(concepts: DataFrame) -> DataFrame:
    """Concepts that have just come to a mark of mentions and that no person has edited."""
    return concepts.where(~F.coalesce("human_edited", F.lit(False)) & F.col("mention_count").isin(5, 10, 25, 50) & (F.coalesce("last_refined_at_count", F.lit(0)) < F.col("mention_count")))
