"""Entity resolution: duplicate groups, canonical names, alias unions, collisions across kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..scratch import keep
from .match import components


def distinct_vectors(nodes: DataFrame) -> DataFrame:
    """(id, vector): each vector once, under the least id that has it. Null vectors and those without a direction (zero, or with a null or infinite part) are near to nothing and take no part."""
    v = nodes.select("id", F.col("vector").cast("array<double>").alias("vector"))
    return v.where(V.whole() & F.exists("vector", lambda x: x != 0)).groupBy("vector").agg(F.min("id").alias("id"))


def near_groups(nodes: DataFrame, least: float, block: int = V.BLOCK) -> DataFrame:
    """nodes (id, vector, ...) with `component`: the least id that each reaches over pairs at a cosine of least (above 0) or more, among all pairs. Equal vectors count as one."""
    if not 0 < least <= 1:
        raise ValueError(f"least must be in (0, 1]; got {least}")
    reps = keep(distinct_vectors(nodes).select("id", "vector"), "reps")
    found = groups(keep(V.connections(reps, least, block), "near"), reps)
    of = found.select("component", F.col("vector").alias("same"))
    rows = nodes.join(of, F.col("vector").cast("array<double>") == F.col("same"), "left").drop("same")
    return rows.withColumn("component", F.coalesce("component", "id"))


def groups(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with `component`, the least id that they reach over pairs (src, dst); their own id where they have none."""
    return nodes.join(components(pairs), "id", "left").withColumn("component", F.coalesce("component", "id"))


def canonical(members: DataFrame, name: str = "name", made: str = "created_at") -> DataFrame:
    """For each component the id of the longest name, the older of equals, then the least id."""
    best = F.min_by("id", F.struct(-F.length(name), F.col(made), F.col("id")))
    return members.groupBy("component").agg(best.alias("keep_id"), F.count("*").alias("members"))


def rewire(edges: DataFrame, kept: DataFrame, end: str = "dst") -> DataFrame:
    """Edges with merged nodes (id -> keep_id) replaced at one end, each edge once."""
    m = kept.select(F.col("id").alias(end), "keep_id")
    return edges.join(m, end, "left").withColumn(end, F.coalesce("keep_id", end)).drop("keep_id").select(*edges.columns).distinct()


def alias_union(name: Column, old: Column, new: Column) -> Column:
    """Sorted union of aliases, without nulls and blanks; name joins them."""
    both = F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()), F.array(name))
    return F.array_sort(F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (F.trim(x) != ""))))


def merge_into(canon: DataFrame, incoming: DataFrame, on: str = "id", most_aliases: int = 20, ordinal: str = "ordinal") -> DataFrame:
    """Merge incoming entities, any number for a key and in the order of `ordinal`, into the canonical ones that they matched.

    A canonical name stays; others give way to the first canonical incoming name. Other attributes keep their value and take
    the first one that is not null or empty where they have none. Names and aliases of all unite, sorted, without the name
    itself, most_aliases of them. The embedding stays. Incoming keys that canon lacks change nothing.
    """
    at = F.col(ordinal) if ordinal in incoming.columns else F.lit(0)
    text = {f.name for f in canon.schema if f.dataType.simpleString() == "string"}
    plain = [c for c in canon.columns if c not in (on, "name", "aliases", "is_canonical", "embedding", "vector")]
    told = lambda c: F.col(c).isNotNull() & (F.col(c) != "") if c in text else F.col(c).isNotNull()
    flag = F.coalesce(F.col("is_canonical"), F.lit(False)) if "is_canonical" in incoming.columns else F.lit(False)
    none = F.array().cast("array<string>")
    by = incoming.groupBy(on).agg(
        F.min_by("name", F.when(flag, F.struct(at, F.col("name")))).alias("in_canonical"),
        F.bool_or(flag).alias("in_flag"),
        *(F.min_by(c, F.when(told(c), F.struct(at, F.col(c)))).alias(f"in_{c}") for c in plain if c in incoming.columns),
    )
    # the least names, one more than are wanted, as the name itself may be among them
    names = incoming.select(on, F.explode(F.concat(F.array("name"), F.coalesce("aliases", none))).alias("n")).where("trim(n) <> ''").distinct()
    least = names.withColumn("nth", F.row_number().over(Window.partitionBy(on).orderBy("n"))).where(F.col("nth") <= most_aliases + 1)
    by = by.join(least.groupBy(on).agg(F.collect_list("n").alias("in_names")), on, "left")
    has = "is_canonical" in canon.columns
    canonical = F.coalesce(F.col("is_canonical"), F.lit(False)) if has else F.lit(True)
    name = F.when(~canonical, F.coalesce("in_canonical", "name")).otherwise(F.col("name"))
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("in_names", none), F.array_compact(F.array("name")))))
    value = {
        "name": name,
        "aliases": F.slice(F.filter(every, lambda x: ~x.eqNullSafe(name) & (F.trim(x) != "")), 1, most_aliases),
        "is_canonical": canonical | F.coalesce("in_flag", F.lit(False)),
        **{c: F.when(told(c), F.col(c)).otherwise(F.coalesce(f"in_{c}", c)) for c in plain if c in incoming.columns},
    }
    return canon.join(by, on, "left").select(*(value[c].alias(c) if c in value else F.col(c) for c in canon.columns))


# Kinds of extracted entity, in the order in which they are told.
KINDS = ("concept", "model", "method")


def collisions(entities: DataFrame) -> DataFrame:
    """Surfaces that one paper uses under several kinds. entities: paper, kind, name, aliases.

    Returns paper, surface, kinds (sorted) and exact (some entity has the surface as its name).
    """
    flags = sum((F.when(F.col("kind") == k, 1 << n).otherwise(0) for n, k in enumerate(KINDS)), F.lit(0))
    surface = F.explode_outer(F.filter(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    rows = entities.select("paper", flags.alias("flag"), F.lower(F.trim("name")).alias("name"), surface.alias("surface")).where("surface is not null")  # outer: worked out once
    by = rows.groupBy("paper", "surface").agg(F.bit_or("flag").alias("flags"), F.bool_or(F.col("name") == F.col("surface")).alias("exact"))
    kinds = F.array_sort(F.array_compact(F.array(*(F.when(F.col("flags").bitwiseAND(F.lit(1 << n)) != 0, k) for n, k in enumerate(KINDS)))))
    return by.where(F.bit_count("flags") >= 2).select("paper", "surface", kinds.alias("kinds"), "exact")


def ambiguous(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """(pair, paper, surface, trigger, kind, id): the members of every pair or triple of entities that one paper tells under several kinds.

    entities: paper, id (unique in its paper), kind, name, aliases, vector (of the name), ordinal. A shared surface, trimmed and lower-cased,
    takes the first entity of each kind ("exact" if it is the name of one, else "alias"). Names of different kinds that no
    shared surface has paired are held against each other by cosine ("embedding"); equal names of a kind count once, as
    their first entity. Null vectors are near to nothing.
    """
    name = F.lower(F.trim("name"))
    surface = F.explode_outer(F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    told = entities.select("paper", "id", "kind", "ordinal", name.alias("own"), surface.alias("surface")).where("surface is not null").repartition("paper", "surface")  # once, for both groupings
    first = told.groupBy("paper", "surface", "kind").agg(F.min_by("id", F.struct("ordinal", "id")).alias("id"), F.bool_or(F.col("own") == F.col("surface")).alias("exact"))
    by = first.groupBy("paper", "surface").agg(F.collect_list(F.struct("kind", "id")).alias("members"), F.bool_or("exact").alias("exact"), F.count_if(F.col("kind").isin(*KINDS)).alias("n"))
    shared = by.where("n >= 2").withColumn("trigger", F.when(F.col("exact"), "exact").otherwise("alias"))
    cheap = keep(shared.select(F.to_json(F.struct("paper", "surface", "trigger")).alias("pair"), "paper", "surface", "trigger", F.inline("members")), "cheap")
    paired = cheap.select("paper", "id").distinct()
    left = entities.where(F.col("kind").isin(*KINDS)).join(paired, ["paper", "id"], "left_anti").withColumn("low", name)
    reps = left.groupBy("paper", "kind", "low").agg(F.min_by(F.struct("id", "name", "vector"), F.struct("ordinal", "id")).alias("r")).select("paper", "kind", "r.id", "r.name", "r.vector")
    reps = keep(reps, "reps")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    near = V.near_within(reps.select("id", "paper", rank.alias("rank"), "vector"), "paper", least)
    ends = near.join(reps.select("id", "paper", F.col("name").alias("surface")), ["paper", "id"]).withColumn("pair", F.to_json(F.struct("paper", "id", "other")))
    ends = ends.select("pair", "paper", "surface", F.lit("embedding").alias("trigger"), F.explode(F.array("id", "other")).alias("id"))
    fuzzy = ends.join(reps.select("paper", "id", "kind"), ["paper", "id"])
    columns = ["pair", "paper", "surface", "trigger", "kind", "id"]
    return keep(cheap.select(*columns).unionByName(fuzzy.select(*columns)), "ambiguous")


def normalize(entities: DataFrame, pairs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities left, audit) of pairs (of ambiguous()) after decisions (pair, picked, confidence, reason).

    A decision counts if it picks a kind of the pair with a confidence of 0.7 or more: members of other kinds are dropped.
    Else both stay and the audit tells why. audit: paper, surface, trigger, picked, dropped_kinds, rejection_reason.
    """
    d = decisions.groupBy("pair").agg(F.max_by(F.struct("picked", "confidence", "reason"), "confidence").alias("d")).select("pair", "d.*")
    kinds = pairs.groupBy("pair", "paper", "surface", "trigger").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # three at most
    good = F.array_contains("kinds", F.col("picked")) & (F.coalesce("confidence", F.lit(0.0)) >= 0.7)
    judged = kinds.join(d, "pair", "left").withColumn("picked", F.when(good, F.col("picked")))
    dropped = F.when(F.col("picked").isNotNull(), F.filter("kinds", lambda k: k != F.col("picked"))).otherwise(F.array().cast("array<string>"))
    audit = judged.select("pair", "paper", "surface", "trigger", "picked", dropped.alias("dropped_kinds"), F.when(F.col("picked").isNull(), F.coalesce("reason", F.lit("unknown"))).alias("rejection_reason"))
    gone = pairs.join(judged.select("pair", "picked"), "pair").where("picked is not null and kind <> picked").select("paper", "id").distinct()
    return entities.join(gone, ["paper", "id"], "left_anti").select(*entities.columns), audit


def audit_json(audit: DataFrame) -> DataFrame:
    """(paper, normalization_audit): a paper's audit rows as JSON text; papers without one have no row."""
    row = F.struct("surface", "trigger", "picked", "dropped_kinds", "rejection_reason")
    return audit.groupBy("paper").agg(F.to_json(F.array_sort(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("normalization_audit"))


def excerpt(entities: DataFrame, most: int = 4000) -> DataFrame:
    """(paper, excerpt): quoted passages of a paper's entities by kind and ordinal, cut at `most` characters."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "ordinal", F.substring("quoted_text", 1, most).alias("q")))), lambda x: x["q"])
    return entities.groupBy("paper").agg(F.substring(F.array_join(ordered, " ... "), 1, most).alias("excerpt"))
