"""Extraction results into the graph: mentions, concepts, routing, sequential merging, run reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles as A
from ..functions import models as G
from ..functions import text as T
from ..functions import vector as V
from ..scratch import keep
from ..sources import connectors as N
from ..sources import papers as P
from . import resolve as E
from . import search as S


def mentions(extracted: DataFrame) -> DataFrame:
    """Extracted problems (paper, ordinal, statement, quoted_text, confidence) as mentions with ids of their own content."""
    return extracted.select(
        F.substring(F.sha2(F.concat_ws("\x1f", "paper", F.col("ordinal").cast("string"), "statement"), 256), 1, 16).alias("id"),
        "paper", "statement", F.coalesce(F.nullif("quoted_text", F.lit("")), F.col("statement")).alias("quoted_text"), F.lit("Unknown").alias("section"), F.lit("pending").alias("review_status"),
    )


def integrate(found: DataFrame, routes: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instance_of, new concepts, escalated) of mentions (id, statement).

    routes: query_id, id, route of matched mentions; decisions: mention, decision (link, create_new, human_review)
    of those that went to debate. Unmatched mentions, and those decided so, become concepts of their own.
    """
    r = routes.select(F.col("query_id").alias("mention"), F.col("id").alias("concept"), "route")
    one = found.select(F.col("id").alias("mention"), "statement").join(r, "mention", "left").join(decisions, "mention", "left")
    debated = F.col("route").isin("evaluator", "debate")
    fate = F.when(F.col("route") == "auto_link", "link").when(debated, F.coalesce("decision", F.lit("create_new"))).otherwise("create_new")
    done = one.withColumn("fate", fate)
    made = done.where("fate = 'create_new'").select(F.concat(F.lit("c-"), "mention").alias("id"), F.col("statement").alias("canonical_statement"), F.lit(1).alias("mention_count"), "mention")
    linked = done.where("fate = 'link'").select(F.col("mention").alias("src"), F.col("concept").alias("dst"), F.when(debated, "agent").otherwise("auto").alias("match_method"))
    edges = linked.unionByName(made.select(F.col("mention").alias("src"), F.col("id").alias("dst"), F.lit("auto").alias("match_method")))
    return edges, made.drop("mention"), done.where("fate = 'human_review'").select("mention", "concept")


def _fold(threshold: float, kind: str) -> Callable[[pa.Table], pa.Table]:
    """Rows in order (fixed ones first): each joins the nearest kept one at the threshold or more, of equals the one kept first, else is kept. best and best_score are what it found among those kept before this table."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("turn", "ascending"), ("ordinal", "ascending"), ("id", "ascending")])
        ids, fixed = rows["id"].to_pylist(), np.array(rows["turn"].to_pylist()) == 0
        found, score = rows["best"].to_pylist(), rows["best_score"].to_pylist()
        x = V.unit_rows(rows)
        held, at, out = np.empty_like(x), [], []
        for k, own in enumerate(ids):
            near, how = found[k], score[k]
            if at and not fixed[k] and x[k].any():
                s = np.round(held[: len(at)] @ x[k], 9)
                b = int(s.argmax())
                if s[b] >= threshold and (near is None or s[b] > how):
                    near, how = ids[at[b]], float(s[b])
            if fixed[k] or near is None:
                near, how = own, None
                held[len(at)] = x[k]
                at.append(k)
            out.append((own, near, len(at) if near == own else 0))
        return pa.table({"id": pa.array([o[0] for o in out], V.ARROW[kind]), "keep_id": pa.array([o[1] for o in out], V.ARROW[kind]), "nth": pa.array([o[2] for o in out], pa.int64())})

    return run


def _settle(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """What a run of rows, in order, tells of itself: a row near a kept one before it is merged; one that is blocked, or near an undecided one before it, stays undecided; any other is kept."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x, blocked = V.unit_rows(rows), rows["blocked"].to_pylist()
        state = np.zeros(len(x), np.int8)  # 0 undecided, 1 kept, 2 merged
        for r in range(len(x)):
            near = state[:r][V.rounded(x[:r] @ x[r]) >= threshold]
            state[r] = 2 if (near == 1).any() else 0 if blocked[r] or (near == 0).any() else 1
        return pa.table({"id": rows["id"], "state": pa.array(state.astype(np.int32))})

    return run


def first_greedy(nodes: DataFrame, threshold: float, size: int = V.BLOCK) -> tuple[DataFrame, int]:
    """(kept, rounds): ids (long, their order) of the nodes (id, vector, fixed; different vectors with a direction) that stay when each goes, in order, if a kept one before it is near, and fixed ones stay whatever they are near to.

    That is the first maximal set without near pairs. Many nodes are decided at once: in a round, every run of `size` nodes in order goes as
    far as it can without those before it, and what is near to newly kept nodes is merged everywhere. Only nodes with an undecided near
    one in an earlier run wait, so the first run that has any is always decided; when no more than `size` are left, one task settles them.
    """
    kept = [keep(nodes.where("fixed").select("id", "vector"), "kept")]
    rest = keep(nodes.where("not fixed").select("id", "vector"), "rest")

    def without(rows: DataFrame, near: DataFrame) -> DataFrame:
        """rows that are near to none of `near`."""
        hit = A.join(rows, near, threshold, lambda x, y: pa.table({"id": x["id"].filter(pa.array((V._cosines(V._matrix(x), V._matrix(y)) >= threshold).any(1)))}), "id bigint", size)
        return rows.join(hit.distinct(), "id", "left_anti")

    def waiting(x: pa.Table, y: pa.Table) -> pa.Table:
        near = V._cosines(V._matrix(x), V._matrix(y)) >= threshold
        of_x, of_y = (np.array(t["run"]) for t in (x, y))
        later, earlier = (near & (of_y[None, :] < of_x[:, None])).any(1), (near & (of_x[:, None] < of_y[None, :])).any(0)
        return pa.table({"id": pa.concat_arrays([t["id"].combine_chunks().filter(pa.array(w)) for t, w in ((x, later), (y, earlier))])})

    if not kept[0].isEmpty():
        rest = keep(without(rest, kept[0]), "rest")
    rounds = 0
    while left := rest.count():
        rounds += 1
        if left <= size:
            runs = rest.withColumn("run", F.lit(0).cast("long")).withColumn("blocked", F.lit(False))
        else:
            runs = keep(rest.withColumn("run", F.floor(F.col("id") / size)), "runs")
            hit = A.join(runs, runs, threshold, waiting, "id bigint", size, upper=True).distinct().withColumn("blocked", F.lit(True))
            runs = runs.join(hit, "id", "left").fillna(False, ["blocked"])
        settled = runs.withColumn("length", F.size("vector")).groupBy("length", "run").applyInArrow(_settle(threshold), "id bigint, state int")
        settled = keep(settled.join(rest, "id"), "settled")
        new = settled.where("state = 1").select("id", "vector")
        kept.append(new)
        rest = keep(without(settled.where("state = 0").select("id", "vector"), new), "rest") if left > size else rest.limit(0)
    return reduce(DataFrame.unionByName, kept), rounds


def merge_in_order(entities: DataFrame, threshold: float, size: int = V.BLOCK, block: str | None = None) -> DataFrame:
    """Sequential merging: in the order of `ordinal`, each entity (id, vector) joins the nearest kept one at a cosine of the threshold or more, else is kept itself.

    The result depends on the order, as with inserts one after another; rows with `fixed` (if there is such a column) were
    there before and are kept whatever they are near to. Which rows are kept is found in a few rounds over all rows
    (first_greedy()); then every other row looks for its nearest among those that were kept before it. With `block`, rows only
    meet those with the same value of that column, which by contract are few (one paper's entities). Vectors that are null, zero
    or not finite merge with nothing. Returns id and keep_id.
    """
    if threshold <= 0:
        raise ValueError(f"threshold must be above 0; got {threshold}")
    fixed = F.coalesce("fixed", F.lit(False)) if "fixed" in entities.columns else F.lit(False)
    kind = dict(entities.dtypes)["id"]
    rows = entities.select("id", F.col("vector").cast("array<double>").alias("vector"), "ordinal", F.when(fixed, 0).otherwise(1).alias("turn"), *([F.col(block).alias("block")] if block else []))
    if block:
        none = {"best": F.lit(None).cast(kind), "best_score": F.lit(None).cast("double")}
        return rows.withColumns(none).groupBy("block").applyInArrow(_fold(threshold, kind), f"id {kind}, keep_id {kind}, nth bigint").select("id", "keep_id")
    # numbers in order, with gaps between the parts of a sort
    ordered = keep(rows.orderBy("turn", "ordinal", "id").select("id", "vector", "turn").withColumn("at", F.monotonically_increasing_id()), "ordered")
    able = keep(ordered.where(V.whole() & F.exists("vector", lambda x: x != 0)), "able")
    nodes = able.groupBy("vector").agg(F.min("at").alias("id"), (F.min("turn") == 0).alias("fixed"))
    first, _ = first_greedy(keep(nodes, "nodes"), threshold, size)
    first = keep(first, "first")
    stays = first.select("id").unionByName(able.where("turn = 0").select(F.col("at").alias("id"))).distinct().withColumnRenamed("id", "at")
    others = able.join(stays, "at", "left_anti").select(F.col("at").alias("id"), "vector")

    def nearest(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("id")
        score = np.where(np.array(y["id"])[None, :] < np.array(x["id"])[:, None], V._cosines(V._matrix(x), V._matrix(y)), -2.0)
        best = score.argmax(1)  # of equals the one kept first
        good = np.flatnonzero(score[np.arange(len(best)), best] >= threshold)
        return pa.table({"at": x["id"].take(pa.array(good)), "near": y["id"].take(pa.array(best[good])), "score": pa.array(score[good, best[good]])})

    found = A.join(keep(others, "others"), first, threshold, nearest, "at bigint, near bigint, score double", size)
    found = found.groupBy("at").agg(F.min_by("near", F.struct(-F.col("score"), F.col("near"))).alias("near"))
    merged = found.join(ordered.select(F.col("at").alias("near"), F.col("id").alias("keep_id")), "near").select("at", "keep_id")
    return ordered.join(merged, "at", "left").select("id", F.coalesce("keep_id", "id").alias("keep_id"))


def create_or_merge(state: DataFrame, incoming: DataFrame, threshold: float, most_aliases: int = 20) -> tuple[DataFrame, DataFrame]:
    """(new state, outcome): incoming entities one after another, each merged into the nearest entity at the threshold or more, which may be an incoming one that came before, or created.

    state and incoming: id, name, aliases, vector and any further columns; incoming has `ordinal` too. A merge is that of
    resolve.merge_into; the kept vector stays. outcome: id, entity_id, created. Thresholds above 1 merge nothing. Raises if an
    incoming id is in the state already or comes twice, as the outcome tells entities apart by their ids.
    """
    ids = state.select("id", F.lit(0).alias("n")).distinct().unionByName(incoming.select("id", F.lit(1).alias("n")))
    if not ids.groupBy("id").agg(F.count("*").alias("rows"), F.max("n").alias("new")).where("rows > 1 and new = 1").isEmpty():
        raise ValueError("an incoming id is in the state, or comes twice")
    both = state.select("id", "vector", F.lit(0).cast("long").alias("ordinal"), F.lit(True).alias("fixed")).unionByName(incoming.select("id", "vector", F.col("ordinal").cast("long").alias("ordinal"), F.lit(False).alias("fixed")))
    outcome = keep(merge_in_order(both, threshold).join(incoming.select("id"), "id"), "merges") if threshold <= 1 else incoming.select("id", F.col("id").alias("keep_id"))
    made = incoming.join(outcome.where("id = keep_id").select("id"), "id")
    merged = incoming.withColumnRenamed("id", "own").join(outcome.where("id <> keep_id").withColumnRenamed("id", "own"), "own").withColumnRenamed("keep_id", "id").drop("own")
    canon = state.unionByName(made.select(*(c for c in incoming.columns if c in state.columns)), allowMissingColumns=True)
    return E.merge_into(canon, merged, "id", most_aliases), outcome.select("id", F.col("keep_id").alias("entity_id"), (F.col("id") == F.col("keep_id")).alias("created"))


def create_or_merge_described(state: DataFrame, incoming: DataFrame, threshold: float, describe: Callable[[str], str], check: Callable[[str, str], bool], most_aliases: int = 20) -> tuple[DataFrame, DataFrame]:
    """As create_or_merge(); entities that it touched and that still have no description get one that describe gives for the name and check accepts."""
    new, outcome = create_or_merge(state, incoming, threshold, most_aliases)
    new = keep(new, "merged")
    touched = outcome.select(F.col("entity_id").alias("id")).distinct()
    told = G.describe(new.join(touched, "id", "left_semi").select(*new.columns), "name", describe, check)
    return told.unionByName(new.join(touched, "id", "left_anti").select(*new.columns)), outcome


def paper_entities(documents: DataFrame, extractors: dict[str, Callable[[str], list[dict]]], key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities, failures) of texts with different keys: the sections that entity extractors read, once through all of them (kind -> function).

    entities: id, paper (the key), kind, ordinal (in its kind), name, aliases, description; ones without a name are left out.
    failures: paper, extractor, error.
    """
    sections = T.segment_with_abstract(documents, key, text)
    texts = T.extractor_text(sections, key).select(F.col(key).alias("id"), "text")
    done = keep(G.extract_all(texts, "text", extractors), "extracted")
    item = "array<struct<name:string,aliases:array<string>,description:string>>"
    each = F.array(*(F.struct(F.lit(k).alias("kind"), G.result(k, item).alias("items")) for k in extractors))
    rows = done.select(F.col("id").alias("paper"), F.inline(each)).select("paper", "kind", F.posexplode("items").alias("ordinal", "e")).where("trim(e.name) <> ''")
    made = F.substring(F.sha2(F.concat_ws("\x1f", F.col("paper").cast("string"), "kind", F.col("ordinal").cast("string")), 256), 1, 16)
    return rows.select(made.alias("id"), "paper", "kind", "ordinal", F.trim("e.name").alias("name"), "e.aliases", "e.description"), G.failures(done).withColumnRenamed("id", "paper")


def integrate_entities(states: dict[str, DataFrame], entities: DataFrame, threshold: float) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new states, edges) after a paper's or many papers' entities (of paper_entities(), with `vector`), kind by kind, in the order of papers and their entities: each is merged into a near one or created.

    states: kind -> id, name, aliases, description, vector and more. edges: src (paper), dst (entity), kind, each once.
    """
    ordered = keep(entities.orderBy("paper", "ordinal", "id").withColumn("ordinal", F.monotonically_increasing_id()), "entities")
    out, edges = {}, []
    for kind, state in states.items():
        mine = ordered.where(F.col("kind") == kind)
        out[kind], outcome = create_or_merge(state, mine.select("id", "name", "aliases", "description", "vector", "ordinal"), threshold)
        edges.append(outcome.join(mine.select("id", "paper"), "id").select(F.col("paper").alias("src"), F.col("entity_id").alias("dst"), F.lit(kind).alias("kind")).distinct())
    return out, reduce(DataFrame.unionByName, edges)


def relations(texts: DataFrame, problems: DataFrame, key: str = "doc_id", text: str = "text", similar: float = 0.7, least: float = 0.5) -> DataFrame:
    """(key, source, target, relation, confidence, evidence, method) between the problems (key, ordinal, statement) of texts: from cues in the text, and from statements with like words; of each pair and type the most confident, of `least` or more.

    Statements with the same words are one for the second, and `same_words` leads from the first of them to the others.
    """
    cues = T.cue_relations(texts, problems, key, text).withColumn("method", F.lit("textual_cue"))
    first = problems.groupBy(key, "ordinal").agg(F.min("statement").alias("statement"))
    near = S.similar_texts(first, key, "ordinal", "statement", similar)
    named = near.join(first.select(key, F.col("ordinal").alias("source"), F.substring("statement", 1, 100).alias("s")), [key, "source"]).join(first.select(key, F.col("ordinal").alias("target"), F.substring("statement", 1, 100).alias("t")), [key, "target"])
    like = named.select(key, F.col("s").alias("source"), F.col("t").alias("target"), "relation", F.col("score").alias("confidence"), F.format_string("word overlap %.2f", "score").alias("evidence"), (1000 + F.col("source")).cast("int").alias("ordinal"), F.lit("semantic_similarity").alias("method"))
    found = cues.unionByName(like).where(F.col("confidence") >= least).withColumn("ordinal", F.struct("ordinal", "source", "target"))
    return T.best_relations(found, within=[key]).drop("ordinal", "stored_type")


def process_texts(documents: DataFrame, extractor: Callable[[str], list[dict]], key: str = "doc_id", text: str = "text", top_n: int = 3, least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sections, problems, relations, failures) of texts with different keys.

    Texts are cut into sections, extractor turns the likeliest of them into problems (mappings of statement, quoted_text
    and confidence), those of enough confidence are related with one another. problems: key, ordinal, section, statement,
    quoted_text, confidence; failures: key, section, error.
    """
    sections = keep(T.segment_with_abstract(documents, key, text), "sections")
    some = T.top_sections(sections, key, top_n).select(F.concat_ws("\x1f", F.col(key).cast("string"), F.col("nth").cast("string")).alias("id"), key, F.col("section_type").alias("section"), "nth", "content")
    items, failures = G.extract(some, "content", extractor, "statement string, quoted_text string, confidence double")
    found = items.where((F.col("confidence") >= least) & (F.trim("statement") != "")).join(some.drop("content"), "id")
    at = F.row_number().over(Window.partitionBy(key).orderBy("nth", "statement"))
    problems = keep(found.select(key, at.alias("ordinal"), "section", "statement", F.coalesce("quoted_text", "statement").alias("quoted_text"), "confidence"), "problems")
    return sections, problems, relations(documents, problems, key, text), failures.join(some.drop("content", "nth"), "id").drop("id")


def process_urls(urls: DataFrame, fetch: Callable[[str], bytes], to_pages: Callable[[bytes], list[str]], extractor: Callable[[str], list[dict]], top_n: int = 3, least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sections, problems, relations, failures) of documents behind addresses (column url), from fetching on; key: path. Pages are cleaned and joined before they are cut.

    failures: path, section, error; section is null where a document could not be fetched or read, had no text, or looks scanned (then what
    text it has goes on all the same).
    """
    found = keep(N.fetched_pages(urls, fetch, to_pages), "pages")
    texts = keep(N.full_text(found.withColumn("text", T.clean(F.col("text")))), "texts")
    sections, problems, related, failed = process_texts(texts.where("text <> ''").select("path", "text"), extractor, "path", "text", top_n, least)
    none = F.lit(None).cast("string").alias("section")
    unread = found.where("error is not null").select("path", none, "error")
    bare = texts.join(unread.select("path"), "path", "left_anti").where("scanned or text = ''").select("path", none, F.when(F.col("text") == "", "no text").otherwise("looks scanned").alias("error"))
    return sections, problems, related, failed.select("path", "section", "error").unionByName(unread).unionByName(bare)


def import_outcome(known: Column, failed: Column, update: bool) -> Column:
    return F.when(failed, "error").when(known & F.lit(update), "updated").when(known, "skipped").otherwise("created")


def best_full_text(candidates: DataFrame, least: int = 250) -> DataFrame:
    """Of each paper's downloads (paper, ordinal, text, error) the first that is long enough, else the last failure."""
    good = F.coalesce(F.length("text"), F.lit(0)) >= least
    by = candidates.groupBy("paper").agg(F.min_by("text", F.when(good, F.col("ordinal"))).alias("text"), F.max_by("error", F.when(~good, F.col("ordinal"))).alias("error"))
    return by.select("paper", "text", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("too_short"))).alias("failure"))


def rows_per_run(outcomes: DataFrame, most_errors: int = 100) -> DataFrame:
    """One report per run (trace_id): counts of outcomes, and messages by paper of its first errors, most_errors at most. errors_of_runs() has them all."""
    one = F.row_number().over(Window.partitionBy("trace_id", "outcome").orderBy("paper", "message"))
    shown = F.when((F.col("outcome") == "error") & (F.col("nth") <= most_errors), F.struct("paper", "message"))
    return outcomes.withColumn("nth", one).groupBy("trace_id").agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "skipped", "error")),
        F.map_from_entries(F.array_sort(F.collect_list(shown))).alias("errors"),
    )


def errors_of_runs(outcomes: DataFrame) -> DataFrame:
    """(trace_id, paper, message): every error of every run, a row each."""
    return outcomes.where("outcome = 'error'").select("trace_id", "paper", "message")


def skippable(papers: DataFrame, taxonomy_hash: str) -> DataFrame:
    """Papers whose extraction is complete under the present taxonomy."""
    return papers.where((F.col("taxonomy_hash") == taxonomy_hash) & ~F.coalesce("extraction_incomplete", F.lit(False)))


def has_footprint(papers: DataFrame, extracted: DataFrame) -> DataFrame:
    """Papers (doi) from which something was extracted (edges src, dst)."""
    return papers.join(extracted.select(F.col("dst").alias("doi")), "doi", "left_semi")


def problem_mentions(found: DataFrame, as_of: Column) -> DataFrame:
    """Extracted problems (paper, ordinal, statement, quoted_text, confidence, section, assumptions, constraints, datasets, metrics, baselines) as rows of schema.NODES["mention"]."""
    m = mentions(found).drop("section").withColumnRenamed("paper", "paper_doi")
    more = found.select(F.col("paper").alias("paper_doi"), F.col("statement"), F.col("ordinal"), "section", *(c for c in ("assumptions", "constraints", "datasets", "metrics", "baselines") if c in found.columns))
    ids = more.withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", "paper_doi", F.col("ordinal").cast("string"), "statement"), 256), 1, 16)).drop("paper_doi", "statement", "ordinal").dropDuplicates(["id"])
    return m.dropDuplicates(["id"]).join(ids, "id").withColumn("section", F.coalesce("section", F.lit("Unknown"))).withColumns({"created_at": as_of, "updated_at": as_of})


def extraction_metadata(papers: DataFrame, runs: DataFrame) -> DataFrame:
    """Papers (doi) with what their latest extraction run (doi, ordinal, taxonomy_hash, failed array<string>) tells: hash, failed extractors as comma-separated text, and whether it is incomplete."""
    last = runs.groupBy("doi").agg(F.max_by(F.struct("taxonomy_hash", "failed"), "ordinal").alias("r"))
    row = last.select("doi", F.col("r.taxonomy_hash").alias("taxonomy_hash"), F.array_join(F.array_sort(F.coalesce("r.failed", F.array().cast("array<string>"))), ",").alias("failed_extractors"), (F.size(F.coalesce("r.failed", F.array().cast("array<string>"))) > 0).alias("extraction_incomplete"))
    return papers.drop("taxonomy_hash", "failed_extractors", "extraction_incomplete").join(row, "doi", "left")


def import_papers(papers: DataFrame, found: DataFrame, update: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers, outcomes): found records by DOI are created, or update known ones with what they tell, or are skipped; those without a DOI are errors. papers and found: doi and attributes; outcomes: doi, outcome, message.

    A DOI that was found more than once counts once, by the first `ordinal` if there is one.
    """
    at = [F.col("ordinal")] if "ordinal" in found.columns else []
    same = [c for c in papers.columns if c in found.columns and c != "doi"]
    one = found.where("doi is not null and doi <> ''").groupBy("doi").agg(F.min_by(F.struct(*same), F.struct(*at, F.struct(*(F.col(c).cast("string") for c in same)))).alias("f"))
    known = papers.select("doi", F.lit(True).alias("known")).distinct()
    outcome = one.join(known, "doi", "left").select("doi", import_outcome(F.coalesce("known", F.lit(False)), F.lit(False), update).alias("outcome"), F.lit(None).cast("string").alias("message"))
    bad = found.where("doi is null or doi = ''").select(F.lit(None).cast("string").alias("doi"), F.lit("error").alias("outcome"), F.lit("no DOI").alias("message"))
    new = one.join(known, "doi", "left_anti").select("doi", "f.*")
    out = papers.join(one, "doi", "left") if update else papers
    value = {c: F.coalesce(F.col(f"f.{c}"), F.col(c)) for c in same} if update else {}
    out = out.select(*(value[c].alias(c) if c in value else F.col(c) for c in papers.columns))
    return out.unionByName(new, allowMissingColumns=True), outcome.unionByName(bad)


def import_author_papers(papers: DataFrame, authors: DataFrame, authored: DataFrame, records: DataFrame, who: DataFrame, as_of_year: int, update: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(papers, authors, authored, outcomes) after importing the records (in normal form) that list one of the authors in `who` (column semantic_scholar_id), with all their authors.

    Outcomes are those of import_papers(); edges of authorship that are there stay as they are.
    """
    outside = lambda a: F.coalesce(a["external_ids"]["semantic_scholar"], a["external_ids"]["s2"])
    listed = records.select("doi", F.explode("authors").alias("a")).select("doi", outside(F.col("a")).alias("semantic_scholar_id"))
    mine = listed.join(who.select("semantic_scholar_id").distinct(), "semantic_scholar_id", "left_semi").select("doi").distinct()
    found = keep(records.join(mine, "doi", "left_semi"), "authored")
    new_papers, outcomes = import_papers(papers, P.graph_papers(found, as_of_year), update)
    new_authors, edges = P.link_authors(authors, P.paper_authors(found))
    fresh = edges.join(authored.select("src", "dst"), ["src", "dst"], "left_anti")
    return new_papers, new_authors, authored.unionByName(fresh, allowMissingColumns=True), outcomes
