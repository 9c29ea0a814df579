"""Registered queries over the surrogate graph and the sample tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as C
from .. import stored as D
from ..functions import models as G
from ..functions import scalars as X
from ..functions import text as T
from ..functions import vector as V
from ..operators import aggregates as A
from ..operators import batch as B
from ..operators import integrate as I
from ..operators import match as M
from ..operators import migrate as Z
from ..operators import reads as R
from ..operators import resolve as E
from ..operators import review as Q
from ..operators import search as S
from ..operators import state as U
from ..operators import taxonomy as Y
from ..graph import Graph
from ..scratch import keep_by_key, new_dir
from ..sources import connectors as N
from ..sources import lookups as L
from ..sources import papers as P
from ..sources import versioned as K
from ..sources.surrogate import SQL, load, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "topic_problem_rollup"


def query(sql: str | None, graph: bool = True):
    """Register a function under its name; sql begins with further common tables ("WITH ...") or a select."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if graph:
                body = f"WITH RECURSIVE {SQL},\n{body[5:]}" if body.startswith("WITH ") else f"WITH RECURSIVE {SQL}\n{body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return add


# --- hierarchy and patterns ---------------------------------------------------------------------------------------


@query("""WITH up AS (SELECT id AS src, id AS dst FROM topic UNION ALL SELECT up.src, t.parent_id FROM up JOIN topic t ON up.dst = t.id WHERE t.parent_id IS NOT NULL)
SELECT r.name AS domain, p.status, count(DISTINCT p.id) AS n_problems
FROM up JOIN topic r ON up.dst = r.id AND r.level = 'domain' JOIN belongs b ON b.dst = up.src JOIN problem p ON p.id = b.src GROUP BY r.name, p.status""")
def topic_problem_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    domains = g.nodes["topic"].where("level = 'domain'").select(F.col("id").alias("root"), F.col("name").alias("domain"))
    under = M.closure(g.edges["subtopic_of"], 2).join(domains, F.col("dst") == F.col("root")).select(F.col("src").alias("topic"), "domain")
    hits = g.edges["belongs_to"].join(under, F.col("dst") == F.col("topic")).select(F.col("src").alias("id"), "domain").distinct()
    return hits.join(g.nodes["problem"].select("id", "status"), "id").groupBy("domain", "status").agg(F.count("*").alias("n_problems"))


@query("""WITH up AS (SELECT id AS src, id AS dst, 0 AS depth FROM topic UNION ALL SELECT up.src, t.parent_id, depth + 1 FROM up JOIN topic t ON up.dst = t.id WHERE t.parent_id IS NOT NULL)
SELECT src, dst, CAST(depth AS INTEGER) AS depth FROM up""")
def topic_closure(spark: SparkSession, d: str) -> DataFrame:
    return M.closure(load(spark, d).edges["subtopic_of"], 2)


@query("SELECT c.parent_id AS id, count(*) AS n_children, min(c.name) AS first_child FROM topic c WHERE c.parent_id IS NOT NULL GROUP BY c.parent_id")
def topic_children(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    rows = M.hop(g.nodes["topic"].select("id", F.col("name").alias("child")), g.edges["subtopic_of"], g.nodes["topic"].select("id"))
    return rows.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"))


@query("SELECT dst AS author, src AS paper, author_position, title, coalesce(year, 0) AS year FROM authored JOIN paper ON paper.id = src WHERE dst = 'A7'")
def papers_by_author(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    rows = M.hop(g.nodes["paper"].select("id", "title", "year"), g.edges["authored_by"].where("dst = 'A7'"), R.get(g.nodes["author"], "id", "A7").select("id"))
    return rows.select(F.col("dst").alias("author"), F.col("src").alias("paper"), "author_position", "title", F.coalesce("year", F.lit(0)).alias("year"))


@query("""WITH pairs AS (SELECT c.src AS id, c.dst AS other, 'outgoing' AS direction FROM cites c UNION ALL SELECT c.dst, c.src, 'incoming' FROM cites c WHERE c.src <> c.dst)
SELECT id, other, direction FROM pairs WHERE id IN ('10.1/1', '10.1/2', '10.1/3')""")
def related_both_ways(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(f"10.1/{i}",) for i in (1, 2, 3)], "id string")
    return M.around(load(spark, d).edges["cites"], ids)


@query("SELECT p.id, count(c.dst) AS n_refs, CAST(count(CASE WHEN t.year < p.year THEN 1 END) AS BIGINT) AS n_older FROM paper p LEFT JOIN cites c ON c.src = p.id LEFT JOIN paper t ON t.id = c.dst GROUP BY p.id")
def references_of_papers(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    papers = g.nodes["paper"].select("id", "year")
    by = M.hop(papers, g.edges["cites"], papers.withColumnRenamed("year", "ref_year")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_refs"), F.count_if(F.col("ref_year") < F.col("year")).alias("n_older"))
    return papers.select("id").join(by, "id", "left").fillna(0, ["n_refs", "n_older"])


@query("SELECT id FROM paper WHERE id NOT IN (SELECT dst FROM cites) AND id NOT IN (SELECT dst FROM extracted)")
def papers_without_use(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return M.exists(M.exists(g.nodes["paper"], g.edges["cites"], "dst", negate=True), g.edges["extracted_from"], "dst", negate=True).select("id")


_BFS = """WITH ranked AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM {edges}) WHERE n <= 3),
walk AS (SELECT '10.1/1' AS id, 0 AS depth UNION SELECT r.dst, depth + 1 FROM walk JOIN ranked r ON r.src = walk.id WHERE depth < 3)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id"""


@query(_BFS.format(edges="cites"))
def citation_bfs_out(spark: SparkSession, d: str) -> DataFrame:
    return M.bfs(load(spark, d).edges["cites"], spark.createDataFrame([("10.1/1",)], "id string"), 3, "out", fan_out=3)


@query(_BFS.format(edges="(SELECT dst AS src, src AS dst FROM cites)"))
def citation_bfs_in(spark: SparkSession, d: str) -> DataFrame:
    return M.bfs(load(spark, d).edges["cites"], spark.createDataFrame([("10.1/1",)], "id string"), 3, "in", fan_out=3)


@query(_BFS.format(edges="(SELECT src, dst FROM cites UNION SELECT dst, src FROM cites)"))
def citation_bfs_both(spark: SparkSession, d: str) -> DataFrame:
    return M.bfs(load(spark, d).edges["cites"], spark.createDataFrame([("10.1/1",)], "id string"), 3, "both", fan_out=3)


@query("""WITH few AS (SELECT id, CASE WHEN length(statement) > 20 THEN left(statement, 20) || '...' ELSE statement END AS label FROM problem ORDER BY id LIMIT 100),
links AS (SELECT e.src, e.dst, 'extracted_from' AS kind FROM extracted e JOIN few s ON s.id = e.src UNION ALL SELECT b.src, b.dst, 'belongs_to' FROM belongs b JOIN few s ON s.id = b.src)
SELECT src, dst, kind, label FROM links JOIN few ON few.id = links.src""")
def graph_view(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    label = F.when(F.length("statement") > 20, F.concat(F.substring("statement", 1, 20), F.lit("..."))).otherwise(F.col("statement"))
    some = R.page(g.nodes["problem"], F.col("id"), limit=100).select(F.col("id").alias("src"), label.alias("label"))
    kinds = [g.edges[k].select("src", "dst", F.lit(k).alias("kind")) for k in ("extracted_from", "belongs_to")]
    return kinds[0].unionByName(kinds[1]).join(some, "src").select("src", "dst", "kind", "label")


# --- reads -------------------------------------------------------------------------------------------------------


@query("SELECT id, status, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM problem WHERE status = 'open' ORDER BY created_at DESC NULLS FIRST, id LIMIT 50 OFFSET 20")
def list_problems_page(spark: SparkSession, d: str) -> DataFrame:
    rows = R.page(load(spark, d).nodes["problem"], F.col("created_at").desc_nulls_first(), F.col("id"), limit=50, offset=20, where=F.col("status") == "open")
    return rows.select("id", "status", F.to_date("created_at").cast("string").alias("day"))


@query("SELECT id, title, coalesce(y, 0) AS year FROM (SELECT id, title, year AS y FROM paper) ORDER BY y DESC NULLS FIRST, id LIMIT 200")
def list_papers_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(load(spark, d).nodes["paper"].select("id", "title", "year"), F.col("year").desc_nulls_first(), F.col("id"), limit=200).fillna(0, ["year"])


@query("SELECT id, title FROM paper WHERE contains(lower(title), 'o') AND venue = (SELECT min(venue) FROM paper) ORDER BY title, id LIMIT 100")
def list_filtered_page(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d).nodes["paper"]
    least = papers.agg(F.min("venue").alias("venue"))
    return R.page(papers.join(F.broadcast(least), "venue").where(R.contains_ci("title", "O")).select("id", "title"), F.col("title"), F.col("id"), limit=100)


@query("""SELECT name, id, level FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE level WHEN 'subtopic' THEN 1 WHEN 'area' THEN 2 ELSE 3 END, id) AS n FROM topic) WHERE n = 1""")
def topic_by_name_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return R.topics_by_name(load(spark, d).nodes["topic"]).select("name", "id", "level")


@query("""SELECT p.id, CAST(1.0 AS DOUBLE) AS score FROM problem p WHERE status = 'open'
AND EXISTS (SELECT 1 FROM belongs b JOIN topic t ON t.id = b.dst WHERE b.src = p.id AND t.parent_id = 'N3')
AND EXISTS (SELECT 1 FROM extracted e JOIN paper q ON q.id = e.dst WHERE e.src = p.id AND q.year BETWEEN 1995 AND 2005) ORDER BY created_at DESC NULLS FIRST, p.id LIMIT 40""")
def structured_search(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    topics = g.nodes["topic"].where("parent_id = 'N3'").select("id")
    return R.structured_search(g.nodes["problem"], g.edges["belongs_to"], g.edges["extracted_from"], g.nodes["paper"], topics, "open", 1995, 2005, 40).select("id", "score")


@query("""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events WHERE value >= 0.5) WHERE n <= 10""", graph=False)
def top_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    return R.top_by_confidence(table(spark, d, "events"), "event_type", "value", "event_id").select("event_type", "event_id", "value")


# --- aggregates and health ------------------------------------------------------------------------------------------


@query("SELECT status, count(*) AS n FROM problem GROUP BY status")
def stats_by_status(spark: SparkSession, d: str) -> DataFrame:
    return A.counts_by(load(spark, d).nodes["problem"], "status")


@query("SELECT t.name, count(*) AS n FROM belongs b JOIN topic t ON t.id = b.dst GROUP BY t.name")
def stats_by_topic(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return A.counts_by(g.edges["belongs_to"].join(g.nodes["topic"].select(F.col("id").alias("dst"), "name"), "dst"), "name")


@query("""WITH old AS (SELECT t.id, CASE WHEN length(t.id) % 2 = 0 THEN coalesce(n, 0) ELSE 1 END AS c FROM topic t LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM belongs GROUP BY dst) ON dst = t.id)
SELECT old.id, CAST(c AS BIGINT) AS old_problem_count, coalesce(n, 0) AS new_problem_count FROM old LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM belongs GROUP BY dst) ON dst = old.id WHERE c <> coalesce(n, 0)""")
def reconcile_topic_counts(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    right = U.with_counter(g.nodes["topic"], g.edges["belongs_to"], "problem_count")
    drifted = right.withColumn("problem_count", F.when(F.length("id") % 2 == 0, F.col("problem_count")).otherwise(1))
    return A.reconcile(drifted, {"problem_count": g.edges["belongs_to"]})


@query("""SELECT p.id, coalesce(i.n, 0) AS citation_count, coalesce(o.n, 0) AS reference_count FROM paper p
LEFT JOIN (SELECT dst, count(*) AS n FROM cites GROUP BY dst) i ON i.dst = p.id LEFT JOIN (SELECT src, count(*) AS n FROM cites GROUP BY src) o ON o.src = p.id""")
def citation_counts(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return A.degree_counts(g.nodes["paper"], g.edges["cites"])


_FAILED = "CASE WHEN quality = 1 THEN NULL WHEN doc_id % 3 = 0 THEN 'topics, models' WHEN doc_id % 3 = 1 THEN 'models,, ' ELSE 'concepts' END"


def _completeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr("doc_id", "quality = 0 AS extraction_incomplete", f"{_FAILED} AS failed_extractors")


@query(f"""SELECT extractor, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labels) AS share FROM (SELECT trim(x) AS extractor FROM (SELECT unnest(string_split({_FAILED}, ',')) AS x FROM labels)) WHERE extractor <> '' GROUP BY extractor""", graph=False)
def completeness_health(spark: SparkSession, d: str) -> DataFrame:
    return A.completeness(_completeness(spark, d))


@query(f"SELECT doc_id FROM labels WHERE quality = 0 AND contains({_FAILED}, 'models')", graph=False)
def incomplete_by_extractor(spark: SparkSession, d: str) -> DataFrame:
    return _completeness(spark, d).where(~A.is_complete() & F.col("failed_extractors").contains("models")).select("doc_id")


@query("""SELECT 'problem_without_topic' AS check_name, count(*) AS n, count(*) = 0 AS passed FROM problem WHERE id NOT IN (SELECT src FROM belongs)
UNION ALL SELECT 'paper_without_author', count(*), count(*) = 0 FROM paper WHERE id NOT IN (SELECT src FROM authored)
UNION ALL SELECT 'nodes_topic', count(*), count(*) > 0 FROM topic UNION ALL SELECT 'nodes_problem', count(*), count(*) > 0 FROM problem
UNION ALL SELECT 'nodes_paper', count(*), count(*) > 0 FROM paper UNION ALL SELECT 'nodes_author', count(*), count(*) > 0 FROM author
UNION ALL SELECT 'edges_subtopic_of', count(*), count(*) > 0 FROM topic WHERE parent_id IS NOT NULL UNION ALL SELECT 'edges_belongs_to', count(*), count(*) > 0 FROM belongs
UNION ALL SELECT 'edges_extracted_from', count(*), count(*) > 0 FROM extracted UNION ALL SELECT 'edges_authored_by', count(*), count(*) > 0 FROM authored
UNION ALL SELECT 'edges_cites', count(*), count(*) > 0 FROM cites""")
def sanity_checks(spark: SparkSession, d: str) -> DataFrame:
    return A.sanity(load(spark, d), {"problem_without_topic": ("problem", "belongs_to"), "paper_without_author": ("paper", "authored_by")})


@query("""SELECT 'subtopic_of' AS kind, count(*) AS n FROM topic WHERE parent_id IS NOT NULL UNION ALL SELECT 'belongs_to', count(*) FROM belongs
UNION ALL SELECT 'extracted_from', count(*) FROM extracted UNION ALL SELECT 'authored_by', count(*) FROM authored UNION ALL SELECT 'cites', count(*) FROM cites""")
def edge_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_histogram(load(spark, d))


@query("""WITH j AS (SELECT user_id % 10 AS batch, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, event_id % 7 AS problems FROM events),
a AS (SELECT batch, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(problems) AS BIGINT) AS problems FROM j GROUP BY batch)
SELECT *, CASE WHEN total > 0 THEN 100.0::DOUBLE * (completed + failed) / total ELSE 0 END AS percent_done, CASE WHEN completed + failed > 0 THEN 100.0::DOUBLE * completed / (completed + failed) ELSE 0 END AS percent_good FROM a""", graph=False)
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "events").selectExpr("user_id % 10 AS batch", "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS status", "event_id % 7 AS problems")
    return A.progress(jobs, "batch")


# --- vectors: the query set is every row whose id is divisible by 20 --------------------------------------------------

_VEC = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings),
near AS (SELECT q.id AS query_id, n.id, n.label, q.label AS query_label, round(list_cosine_similarity(q.vector, n.vector), 9) AS score FROM v q, v n WHERE q.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near)
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows.where("id % 20 = 0"), rows


@query(_VEC + "SELECT query_id, id, round(score, 6) AS score FROM ranked WHERE rank <= 10", graph=False)
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.scores(*_vectors(spark, d), 10).withColumn("score", F.round("score", 6))


@query(_VEC + "SELECT query_id, id, round(score, 6) AS score FROM ranked WHERE rank <= 10 AND label = 3", graph=False)
def knn_post_filter(spark: SparkSession, d: str) -> DataFrame:
    queries, rows = _vectors(spark, d)
    return V.scores(queries, rows, 10).join(rows.where("label = 3").select("id"), "id").select("query_id", "id", F.round("score", 6).alias("score"))


@query(_VEC + """, near30 AS (SELECT *, 0.7 * score + 0.3 * 0.5 AS s FROM ranked WHERE rank <= 30 AND label < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM near30) SELECT query_id, id, round(s, 6) AS score FROM r WHERE n <= 10""", graph=False)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return S.hybrid(*_vectors(spark, d), [F.col("label") < 5]).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_VEC + "SELECT query_id, id, round(score, 6) AS score FROM ranked WHERE rank <= 10 AND score >= 0.35 AND query_id <> id", graph=False)
def find_similar(spark: SparkSession, d: str) -> DataFrame:
    return S.similar(*_vectors(spark, d), 0.35).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_VEC + """, c AS (SELECT query_id, id, score, least(1.0, score + CASE WHEN query_label = label THEN 0.2 ELSE 0 END) AS f FROM ranked WHERE rank <= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, id) AS n FROM c)
SELECT query_id, id, CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.8 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'rejected' END AS confidence,
CASE WHEN score >= 0.95 THEN 'auto_link' WHEN score >= 0.8 THEN 'evaluator' WHEN score >= 0.5 THEN 'debate' ELSE 'new_concept' END AS route FROM r WHERE n = 1""", graph=False)
def match_and_route(spark: SparkSession, d: str) -> DataFrame:
    queries, rows = _vectors(spark, d)
    found = V.scores(queries, rows, 10)
    same = found.join(queries.select(F.col("id").alias("query_id"), F.col("label").alias("l")), "query_id").join(rows.select("id", "label"), "id").where("l = label")
    return S.routes(S.candidates(found, same.select(F.col("query_id").alias("mention"), F.col("id").alias("concept"), F.lit(0.2).alias("boost"))))


@query(_VEC + ", p AS (SELECT query_label = label AS same, score FROM near WHERE query_id <> id), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold), "
"""a AS (SELECT threshold, count(*) FILTER (same AND score >= threshold) AS tp, count(*) FILTER (NOT same AND score >= threshold) AS fp, count(*) FILTER (NOT same AND score < threshold) AS tn, count(*) FILTER (same AND score < threshold) AS fn FROM t, p GROUP BY threshold),
b AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM a)
SELECT threshold, tp, fp, tn, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM b""", graph=False)
def calibration_sweep(spark: SparkSession, d: str) -> DataFrame:
    queries, rows = _vectors(spark, d)
    marks = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    return A.sweep_of_bins(V.score_bins(queries, rows, marks), marks).select("threshold", "tp", "fp", "tn", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"SELECT threshold, f1 FROM ({{sweep}}) WHERE f1 > 0 ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1", graph=False)
def calibration_recommend(spark: SparkSession, d: str) -> DataFrame:
    return A.recommended(calibration_sweep(spark, d))


ORACLE_SQL["calibration_recommend"] = ORACLE_SQL["calibration_recommend"].format(sweep=ORACLE_SQL["calibration_sweep"])


@query("""SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""", graph=False)
def cosine_of_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return rows.join(nxt, "vec_id").select(F.col("vec_id").alias("id"), F.round(V.cosine("embedding", "after"), 6).alias("score"))


@query("""SELECT p_partkey AS id, md5(CASE WHEN p_size % 3 > 0 THEN p_name || ' Assumptions: ' || array_to_string([p_brand, p_type, p_name, p_brand][1:least(3, p_size % 5)], '; ') ELSE p_name END) AS problem, md5(CASE WHEN p_size > 25 THEN p_brand || ': ' || p_type ELSE p_brand END) AS entity FROM part WHERE p_size % 5 > 0 OR p_size % 3 = 0""", graph=False)
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where("p_size % 5 > 0 OR p_size % 3 = 0")
    assumed = F.when(F.col("p_size") % 3 > 0, F.slice(F.array("p_brand", "p_type", "p_name", "p_brand"), 1, (F.col("p_size") % 5).cast("int")))
    problem = V.embedding_text(F.col("p_name"), F.coalesce(assumed, F.array().cast("array<string>")))
    return rows.select(F.col("p_partkey").alias("id"), F.md5(problem).alias("problem"), F.md5(V.named_text(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")))).alias("entity"))


@query("""WITH m AS (SELECT src AS id, min(dst) AS paper FROM extracted GROUP BY src),
b AS (SELECT DISTINCT x.id AS mention, k.dst AS concept FROM m x JOIN cites c ON c.src = x.paper JOIN m y ON y.paper = c.dst AND y.id <> x.id JOIN belongs k ON k.src = y.id) SELECT concept, count(*) AS n FROM b GROUP BY concept""")
def citation_boosts(spark: SparkSession, d: str) -> DataFrame:
    """How many mentions each concept is boosted for, as a paper that theirs cites mentions it."""
    g = load(spark, d)
    mentions = g.edges["extracted_from"].groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("paper"))
    return S.citation_boost(mentions, g.edges["cites"], g.edges["belongs_to"].withColumnRenamed("dst", "concept")).groupBy("concept").agg(F.count("*").alias("n"))


# --- resolution ---------------------------------------------------------------------------------------------------

_COMPONENTS = _VEC.replace("WITH v", "WITH RECURSIVE v", 1).replace("WHERE q.id % 20 = 0", "WHERE q.id < n.id") + """, e AS (SELECT query_id AS src, id AS dst FROM near WHERE score >= 0.38),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), reach AS (SELECT src AS id, src AS other FROM b UNION SELECT reach.id, b.dst FROM reach JOIN b ON b.src = reach.other),
comp AS (SELECT v.id, v.label, coalesce(min(reach.other), v.id) AS component FROM v LEFT JOIN reach ON reach.id = v.id GROUP BY v.id, v.label)
"""


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    _, rows = _vectors(spark, d)
    return E.near_groups(rows, 0.38).select("id", "label", "component")


@query(_COMPONENTS + "SELECT id, component FROM comp", graph=False)
def dedup_components(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d).select("id", "component")


@query(_COMPONENTS + ", named AS (SELECT id, component, 'topic ' || id AS name FROM comp) SELECT component, first(id ORDER BY length(name) DESC, id) AS keep_id, count(*) AS members FROM named GROUP BY component", graph=False)
def canonical_of_components(spark: SparkSession, d: str) -> DataFrame:
    named = _dedup(spark, d).withColumn("name", F.concat(F.lit("topic "), "id")).withColumn("created_at", F.lit(0))
    return E.canonical(named)


@query("""WITH kept AS (SELECT c.id, 'N' || (n.n_nationkey - n.n_nationkey % 5) || substr(c.id, position('-' IN c.id)) AS keep_id FROM topic c JOIN nation n ON c.parent_id = 'N' || n.n_nationkey WHERE c.level = 'subtopic')
SELECT DISTINCT b.src, coalesce(k.keep_id, b.dst) AS dst FROM belongs b LEFT JOIN kept k ON k.id = b.dst""")
def topic_merge_rewire(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    key = F.regexp_extract("parent_id", r"(\d+)", 1).cast("int")
    kept = g.nodes["topic"].where("level = 'subtopic'").select("id", F.concat(F.lit("N"), key - key % 5, F.regexp_extract("id", r"(-.*)", 1)).alias("keep_id"))
    return E.rewire(g.edges["belongs_to"], kept)


_ENT = "SELECT l_orderkey AS paper, CASE l_linenumber % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'method' ELSE 'concept' END AS kind, p_brand AS name, p_type AS alias FROM lineitem JOIN part ON p_partkey = l_partkey"


@query(f"""WITH e AS ({_ENT}), s AS (SELECT paper, kind, lower(trim(name)) AS name, unnest([lower(trim(name)), lower(trim(alias))]) AS surface FROM e)
SELECT paper, surface, array_to_string(list_sort(list_distinct(list(kind))), '|') AS kinds, bool_or(name = surface) AS exact FROM s GROUP BY paper, surface HAVING count(DISTINCT kind) >= 2""", graph=False)
def cross_kind_collisions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'method' ELSE 'concept' END")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    found = E.collisions(rows.select(F.col("l_orderkey").alias("paper"), kind.alias("kind"), F.col("p_brand").alias("name"), F.array("p_type").alias("aliases")))
    return found.withColumn("kinds", F.array_join("kinds", "|"))


@query("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_brand, p_type, p_name])), '|') AS aliases FROM part""", graph=False)
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(E.alias_union(F.col("p_name"), F.array("p_brand", "p_type"), F.array("p_type", F.lit(" "))), "|").alias("aliases"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 AND NOT p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS name, coalesce(CASE WHEN p_size > 25 THEN p_type END, CASE WHEN p_partkey % 3 = 0 THEN 'seen' END) AS architecture,
(p_partkey % 5 = 0) OR (p_partkey % 3 = 0 AND p_size % 2 = 0) AS is_canonical FROM part""", graph=False)
def canonical_merge_matrix(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    canon = part.selectExpr("p_partkey AS id", "p_brand AS name", "CASE WHEN p_size > 25 THEN p_type END AS architecture", "p_partkey % 5 = 0 AS is_canonical", "array(p_name) AS aliases")
    incoming = part.where("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "p_type AS name", "'seen' AS architecture", "p_size % 2 = 0 AS is_canonical", "array(p_name) AS aliases")
    return E.merge_into(canon, incoming).select("id", "name", "architecture", "is_canonical")


@query("""SELECT p_partkey % 700 AS id, first(CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'kept ' || p_partkey % 700 END ORDER BY CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END, p_partkey) AS name, first(p_brand ORDER BY p_partkey) FILTER (p_size > 25) AS architecture, CAST(first(p_size ORDER BY p_partkey) AS INTEGER) AS year_introduced,
count(*) AS n_incoming, bool_or(p_partkey % 4 = 0) AS is_canonical, array_to_string(list_sort(list_distinct(list_concat(list(p_name), list(p_type), ['kept ' || any_value(p_partkey % 700)]))), '|') AS every FROM part GROUP BY p_partkey % 700""", graph=False)
def merge_many_into_one(spark: SparkSession, d: str) -> DataFrame:
    """Several incoming entities a canonical one; `every` is its name and its aliases."""
    part = table(spark, d, "part")
    incoming = part.selectExpr("p_partkey % 700 AS id", "p_name AS name", "array(p_type) AS aliases", "CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS architecture", "p_size AS year_introduced", "p_partkey % 4 = 0 AS is_canonical", "p_partkey AS ordinal")
    canon = part.selectExpr("p_partkey % 700 AS id").distinct().selectExpr("id", "'kept ' || id AS name", "CAST(NULL AS array<string>) AS aliases", "CAST(NULL AS STRING) AS architecture", "CAST(NULL AS INT) AS year_introduced", "false AS is_canonical")
    merged = E.merge_into(canon, incoming, most_aliases=1000).join(incoming.groupBy("id").agg(F.count("*").alias("n_incoming")), "id")
    return merged.select("id", "name", "architecture", "year_introduced", "n_incoming", "is_canonical", F.array_join(F.array_sort(F.array_union("aliases", F.array("name"))), "|").alias("every"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_type AS description, p_brand AS brand, p_partkey % 40 = 0 AS fixed FROM part),
k AS (SELECT brand, first(id ORDER BY fixed DESC, id) AS keep_id FROM p GROUP BY brand), m AS (SELECT p.id, CASE WHEN fixed THEN p.id ELSE keep_id END AS entity_id, fixed, name, description FROM p JOIN k USING (brand))
SELECT e.entity_id, o.name, count(*) FILTER (NOT e.fixed AND e.id <> e.entity_id) AS n_merged, bool_or(NOT e.fixed AND e.id = e.entity_id) AS created, coalesce(CASE WHEN NOT o.fixed THEN o.description END, first(e.description ORDER BY e.id) FILTER (e.id <> e.entity_id)) AS description,
array_to_string(list_sort(list_distinct(list(e.name) FILTER (e.name <> o.name)))[1:20], '|') AS aliases FROM m e JOIN m o ON o.id = e.entity_id GROUP BY e.entity_id, o.name, o.fixed, o.description""", graph=False)
def create_or_merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a unit vector for each brand: every fortieth is there before, the others come in order."""
    brand = F.substring("p_brand", 7, 9).cast("int")
    vector = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.when(i == brand, 1.0).otherwise(0.0))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.col("p_type").alias("description"), vector.alias("vector"))
    state = rows.where("id % 40 = 0").withColumn("description", F.lit(None).cast("string"))
    new, outcome = I.create_or_merge(state, rows.where("id % 40 <> 0").withColumn("ordinal", F.col("id")), 0.9)
    n = outcome.groupBy(F.col("entity_id").alias("id")).agg(F.count_if(~F.col("created")).alias("n_merged"), F.bool_or("created").alias("created"))
    rows = new.join(n, "id", "left").fillna(0, ["n_merged"]).fillna(False, ["created"])
    return rows.select(F.col("id").alias("entity_id"), "name", "n_merged", "created", "description", F.when(F.size("aliases") > 0, F.array_join("aliases", "|")).alias("aliases"))


_PAIRED = """WITH e AS (SELECT l_orderkey AS paper, l_linenumber AS ordinal, l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'method' ELSE 'concept' END AS kind, lower(p_name) AS name, lower(p_type) AS alias, p_brand AS brand FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) JOIN part ON p_partkey = l_partkey),
s AS (SELECT DISTINCT paper, kind, id, ordinal, name, unnest([name, alias]) AS surface FROM e),
c AS (SELECT paper, surface, bool_or(name = surface) AS exact FROM s GROUP BY paper, surface HAVING count(DISTINCT kind) >= 2),
cheap AS (SELECT paper, surface, CASE WHEN exact THEN 'exact' ELSE 'alias' END AS trigger, kind, first(id ORDER BY ordinal, id) AS id FROM s JOIN c USING (paper, surface) GROUP BY paper, surface, exact, kind),
l AS (SELECT paper, kind, name, first(id ORDER BY ordinal, id) AS id, first(brand ORDER BY ordinal, id) AS brand FROM e WHERE (paper, id) NOT IN (SELECT (paper, id) FROM cheap) GROUP BY paper, kind, name),
near AS (SELECT a.paper, a.name AS surface, a.kind AS ak, a.id AS aid, b.kind AS bk, b.id AS bid FROM l a JOIN l b ON a.paper = b.paper AND a.brand = b.brand AND a.kind < b.kind AND (a.kind, b.kind) <> ('method', 'model') UNION ALL SELECT a.paper, a.name, a.kind, a.id, b.kind, b.id FROM l a JOIN l b ON a.paper = b.paper AND a.brand = b.brand AND a.kind = 'model' AND b.kind = 'method'),
pairs AS (SELECT paper, surface, trigger, kind, id, paper || surface || trigger AS pair FROM cheap UNION ALL SELECT paper, surface, 'embedding', ak, aid, aid || '-' || bid FROM near UNION ALL SELECT paper, surface, 'embedding', bk, bid, aid || '-' || bid FROM near)
"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as entities of three kinds, with a unit vector for each brand."""
    brand = F.substring("p_brand", 7, 9).cast("int")
    vector = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.when(i == brand, 1.0).otherwise(0.0))
    kind = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'method' ELSE 'concept' END")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = lines.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("ordinal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), kind.alias("kind"), F.lower("p_name").alias("name"), F.array(F.lower("p_type")).alias("aliases"), vector.alias("vector"))


@query(_PAIRED + "SELECT paper, surface, trigger, kind, id FROM pairs", graph=False)
def ambiguous_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.ambiguous(_entities(spark, d)).select("paper", "surface", "trigger", "kind", "id")


@query(_PAIRED + """, k AS (SELECT pair, paper, surface, trigger, list_sort(list(DISTINCT kind)) AS kinds FROM pairs GROUP BY pair, paper, surface, trigger),
d AS (SELECT *, CASE WHEN paper % 2 = 0 THEN kinds[1] END AS picked FROM k),
gone AS (SELECT DISTINCT p.paper, p.id FROM pairs p JOIN d USING (pair) WHERE picked IS NOT NULL AND kind <> picked)
SELECT 'left' AS what, count(*) AS n FROM e WHERE (paper, id) NOT IN (SELECT (paper, id) FROM gone) UNION ALL SELECT 'resolved', count(*) FROM d WHERE picked IS NOT NULL
UNION ALL SELECT 'rejected', count(*) FROM d WHERE picked IS NULL UNION ALL SELECT 'dropped_kinds', CAST(sum(len(kinds) - 1) AS BIGINT) FROM d WHERE picked IS NOT NULL UNION ALL SELECT 'papers', count(DISTINCT paper) FROM d""", graph=False)
def cross_entity_normalization(spark: SparkSession, d: str) -> DataFrame:
    """Papers with even keys get a decision for the first kind of every pair, the others a doubtful one."""
    entities = _entities(spark, d)
    pairs = E.ambiguous(entities)
    told = pairs.groupBy("pair", "paper").agg(F.min("kind").alias("picked"))
    decisions = told.select("pair", "picked", F.when(F.col("paper") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"), F.lit("doubtful").alias("reason"))
    left, audit = E.normalize(entities, pairs, decisions)
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n")
    dropped = audit.agg(F.sum(F.size("dropped_kinds")).cast("long").alias("n")).select(F.lit("dropped_kinds").alias("what"), "n")
    return n(left, "left").unionByName(n(audit.where("picked is not null"), "resolved")).unionByName(n(audit.where("picked is null"), "rejected")).unionByName(dropped).unionByName(n(E.audit_json(audit), "papers"))


# --- text ----------------------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, replace(replace(nfc_normalize(text), '. ', '.' || chr(10)), 'the ', 'the-' || chr(10)) AS text FROM documents"


def _lined(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), F.lit("the "), F.lit("the-\n"))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


@query(rf"""WITH d AS ({_LINES}), k AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 3 OR trim(x) = ''), chr(10)) AS t FROM d),
h AS (SELECT doc_id, regexp_replace(t, '([\pL\pN_]+)-\s*\n\s*([a-z])', '\1\2', 'g') AS t FROM k)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS hash FROM h""", graph=False)
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _lined(spark, d).select("doc_id", F.md5(T.clean(F.col("text"))).alias("hash"))


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents under headings: every third one gets an introduction before it and limitations after it."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1. Introduction\n"), "text", F.lit("\nLimitations\n"), F.substring("text", 1, 200))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


_SECTIONS = r"""WITH s AS (SELECT doc_id, text AS body, substr(text, 1, 200) AS tail, doc_id % 3 = 0 AS cut, length(text) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, 'introduction' AS section_type, regexp_replace(body, '^\s+|\s+$', '', 'g') AS content, 0 AS start_char FROM s WHERE cut
UNION ALL SELECT doc_id, 'limitations', regexp_replace(tail, '^\s+|\s+$', '', 'g'), n + 17 FROM s WHERE cut),
f AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS words FROM p),
o AS (SELECT doc_id, section_type, content, start_char FROM f WHERE words >= 20
UNION ALL SELECT doc_id, 'unknown', CASE WHEN cut THEN '1. Introduction' || chr(10) || body || chr(10) || 'Limitations' || chr(10) || tail ELSE body END, 0 FROM s WHERE NOT cut OR doc_id NOT IN (SELECT doc_id FROM f WHERE words >= 20))
"""


@query(_SECTIONS + "SELECT doc_id, section_type, CAST(start_char AS INTEGER) AS start_char, md5(content) AS hash FROM o", graph=False)
def segment_sections(spark: SparkSession, d: str) -> DataFrame:
    return T.segment(_sectioned(spark, d)).select("doc_id", "section_type", "start_char", F.md5("content").alias("hash"))


@query(r"""WITH s AS (SELECT doc_id, 'Abstract: ' || text AS lead, length(text) AS n, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'abstract' AS section_type, 0 AS start_char, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS hash FROM s WHERE words >= 20
UNION ALL SELECT doc_id, 'introduction', CAST(n + 11 AS INTEGER), md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) FROM s WHERE words >= 20
UNION ALL SELECT doc_id, 'unknown', 0, md5('Abstract: ' || text || chr(10) || 'Introduction' || chr(10) || text) FROM s WHERE words < 20""", graph=False)
def sections_with_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an abstract before an introduction of the same text."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Abstract: "), "text", F.lit("\nIntroduction\n"), "text").alias("text"))
    return T.segment_with_abstract(rows).select("doc_id", "section_type", "start_char", F.md5("content").alias("hash"))


@query(_SECTIONS + ", j AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY start_char) FILTER (section_type = 'introduction' AND content <> '') AS t FROM o GROUP BY doc_id) SELECT doc_id, md5(coalesce(t, '')) AS hash FROM j", graph=False)
def entity_section_text(spark: SparkSession, d: str) -> DataFrame:
    return T.extractor_text(T.segment(_sectioned(spark, d))).select("doc_id", F.md5("text").alias("hash"))


@query(_SECTIONS + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE section_type WHEN 'limitations' THEN 1 WHEN 'introduction' THEN 5 ELSE 50 END, start_char) AS n FROM o WHERE length(content) >= 100)
SELECT doc_id, section_type, CAST(n AS INTEGER) AS nth FROM r WHERE n <= 1""", graph=False)
def section_priority(spark: SparkSession, d: str) -> DataFrame:
    return T.top_sections(T.segment(_sectioned(spark, d)), top_n=1).select("doc_id", "section_type", "nth")


_CUES = ", ".join(f"('{k}', '{c}')" for k, cs in T.CUES.items() for c in cs)


@query(f"""WITH c(relation, cue) AS (VALUES {_CUES}), t AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 2 = 0 THEN text || ' This builds on and questions it.' ELSE text END AS text FROM conversations WHERE text IS NOT NULL)
SELECT id, relation, cue, md5(substr(text, greatest(1, instr(lower(text), cue) - 100), least(length(text) + 1, instr(lower(text), cue) + length(cue) + 100) - greatest(1, instr(lower(text), cue) - 100))) AS hash FROM t JOIN c ON contains(lower(text), cue)""", graph=False)
def cue_relations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("text IS NOT NULL").selectExpr("conv_id * 100 + turn AS id", "CASE WHEN turn % 2 = 0 THEN text || ' This builds on and questions it.' ELSE text END AS text")
    return T.cue_hits(rows, "id").select("id", "relation", "cue", F.md5("context").alias("hash"))


_WORDSET = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''))"


@query(f"""SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END, 9) AS score
FROM (SELECT conv_id, turn, {_WORDSET.format("text")} AS x FROM conversations) a JOIN (SELECT conv_id, turn, {_WORDSET.format("text")} AS y FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""", graph=False)
def jaccard_of_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("text"), F.col("after")), 9).alias("score"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_sort({_WORDSET.format("text")}) AS s FROM conversations WHERE text IS NOT NULL), r AS (SELECT conv_id, s, min(turn) AS turn FROM w WHERE len(s) > 0 GROUP BY conv_id, s),
p AS (SELECT a.conv_id, least(a.turn, b.turn) AS source, greatest(a.turn, b.turn) AS target, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) AS score FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.s < b.s)
SELECT conv_id, source, target, 'related_to' AS relation, round(score, 9) AS score FROM p WHERE score >= 0.7::DOUBLE
UNION ALL SELECT DISTINCT w.conv_id, r.turn, w.turn, 'same_words', 1.0::DOUBLE FROM w JOIN r ON r.conv_id = w.conv_id AND r.s = w.s WHERE w.turn <> r.turn""", graph=False)
def jaccard_relations(spark: SparkSession, d: str) -> DataFrame:
    """All similar turns of a conversation; jaccard_of_neighbours is the score of each turn and the next one."""
    return S.similar_texts(table(spark, d, "conversations"), "conv_id", "turn").withColumn("score", F.round("score", 9))


@query("""WITH r AS (SELECT event_id AS ordinal, 'user ' || user_id % 50 AS source, 'kind ' || event_type AS target, CASE event_id % 3 WHEN 0 THEN 'extends' WHEN 1 THEN 'related_to' ELSE 'depends_on' END AS relation, round(value, 1) AS confidence FROM events)
SELECT source, target, relation, ordinal, CASE WHEN relation <> 'related_to' THEN relation END AS stored_type FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY confidence DESC, ordinal) AS n FROM r) WHERE n = 1""", graph=False)
def relation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id AS ordinal", "'user ' || user_id % 50 AS source", "'kind ' || event_type AS target", "CASE event_id % 3 WHEN 0 THEN 'extends' WHEN 1 THEN 'related_to' ELSE 'depends_on' END AS relation", "round(value, 1) AS confidence")
    return T.best_relations(rows).select("source", "target", "relation", "ordinal", "stored_type")


_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"


@query(f"""WITH c(relation, cue, o) AS (SELECT relation, cue, row_number() OVER () - 1 FROM (VALUES {_CUES}) v(relation, cue)), t AS (SELECT conv_id, text || ' This builds on and questions it.' AS text FROM conversations WHERE turn = 0 AND text IS NOT NULL),
h AS (SELECT conv_id, relation, cue, o, substr(text, greatest(1, instr(lower(text), cue) - 100), least(length(text) + 1, instr(lower(text), cue) + length(cue) + 100) - greatest(1, instr(lower(text), cue) - 100)) AS context FROM t JOIN c ON contains(lower(text), cue)),
q AS (SELECT conv_id, turn, 'This builds on and questions it ' || turn % 3 AS statement FROM conversations WHERE text IS NOT NULL), p AS (SELECT *, list_sort(list_distinct({_WORDS.format("statement")})) AS s FROM q),
m AS (SELECT h.*, p.turn, p.statement, row_number() OVER (PARTITION BY h.conv_id, relation, cue ORDER BY turn, statement) AS n FROM h JOIN p ON p.conv_id = h.conv_id WHERE CAST(len(list_intersect(s, {_WORDS.format("context")})) AS DOUBLE) / greatest(1, len(s)) > 0.3),
cues AS (SELECT conv_id, relation, o, first(left(statement, 100) ORDER BY n) AS source, first(left(statement, 100) ORDER BY n DESC) AS target, 0.6::DOUBLE AS confidence FROM m WHERE n <= 2 GROUP BY conv_id, relation, cue, o HAVING count(*) = 2),
r AS (SELECT conv_id, s, first(statement ORDER BY turn) AS statement, min(turn) AS turn FROM p WHERE len(s) > 0 GROUP BY conv_id, s),
near AS (SELECT a.conv_id, 'related_to' AS relation, 1000 + a.turn AS o, left(a.statement, 100) AS source, left(b.statement, 100) AS target, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) AS confidence FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.turn < b.turn),
same AS (SELECT DISTINCT p.conv_id, 'same_words' AS relation, 1000 + r.turn AS o, left(r.statement, 100) AS source, left(p.statement, 100) AS target, 1.0::DOUBLE AS confidence FROM p JOIN r ON r.conv_id = p.conv_id AND r.s = p.s AND r.turn <> p.turn),
al AS (SELECT * FROM cues UNION ALL SELECT * FROM near WHERE confidence >= 0.7 UNION ALL SELECT * FROM same),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, left(source, 50), left(target, 50), relation ORDER BY confidence DESC, o, source, target) AS n FROM al WHERE confidence >= 0.5)
SELECT conv_id, relation, md5(source) AS source, md5(target) AS target, round(confidence, 9) AS confidence FROM best WHERE n = 1""", graph=False)
def relations_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's first turn is the text; every turn tells a problem, in three wordings."""
    c = table(spark, d, "conversations").where("text is not null")
    texts = c.where("turn = 0").select("conv_id", F.concat("text", F.lit(" This builds on and questions it.")).alias("text"))
    return I.relations(texts, c.select("conv_id", F.col("turn").alias("ordinal"), F.concat(F.lit("This builds on and questions it "), F.col("turn") % 3).alias("statement")), "conv_id").select("conv_id", "relation", F.md5("source").alias("source"), F.md5("target").alias("target"), F.round("confidence", 9).alias("confidence"))


@query(r"""WITH m AS (SELECT conv_id, conv_id * 100 + turn AS mention_id, text FROM conversations), w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS word FROM conversations WHERE turn = 0)
SELECT DISTINCT mention_id, conv_id || ':' || word AS entity_id FROM m JOIN w USING (conv_id) WHERE lower(word) NOT IN ('which', 'people') AND regexp_matches(lower(text), '(^|[^\pL\pN\pM_])' || lower(word) || '($|[^\pL\pN\pM_])')""", graph=False)
def alias_linker(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    mentions = c.select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("mention_id"), "text")
    words = c.where("turn = 0").select("conv_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), 0))).alias("word"))
    entities = words.select("conv_id", F.concat("conv_id", F.lit(":"), "word").alias("entity_id"), T.surfaces(F.col("word"), F.lit(None), ("which", "people")).alias("surfaces"))
    return T.alias_links(mentions, entities, "conv_id")


# --- sources --------------------------------------------------------------------------------------------------------

_IDENT = "CASE p_partkey % 8 WHEN 0 THEN '10.1234/' || p_partkey WHEN 1 THEN 'arXiv:2106.' || lpad(CAST(p_partkey % 99999 AS STRING), 5, '0') WHEN 2 THEN 'W' || p_partkey WHEN 3 THEN 'https://doi.org/10.1/' || p_partkey WHEN 4 THEN '2106.' || lpad(CAST(p_partkey % 99999 AS STRING), 5, '0') || 'v2' WHEN 5 THEN lpad(CAST(p_partkey AS STRING), 40, 'a') WHEN 6 THEN ' doi:10.5/x ' ELSE p_name END"


@query(f"""WITH i AS (SELECT p_partkey, {_IDENT} AS v FROM part) SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'openalex' WHEN 3 THEN 'doi' WHEN 4 THEN 'arxiv' WHEN 5 THEN 'semantic_scholar' WHEN 6 THEN 'doi' END AS kind,
CASE WHEN p_partkey % 8 IN (1, 4) THEN replace(v, 'arXiv:', '') ELSE v END AS preprint FROM i""", graph=False)
def identifier_type(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_IDENT} AS v")
    return rows.select("p_partkey", P.identifier_type(F.col("v")).alias("kind"), F.when(F.col("p_partkey") % 8 == 7, F.col("v")).otherwise(P.preprint_id(F.col("v"))).alias("preprint"))


@query(r"""SELECT conv_id, turn, nullif(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' '), '') AS text FROM conversations WHERE text IS NOT NULL""", graph=False)
def reconstruct_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Texts are first turned into an inverted index, then read back from it."""
    places = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.posexplode_outer(T.words(F.col("text"))).alias("p", "word"))
    words = places.groupBy("conv_id", "turn", "word").agg(F.collect_list("p").alias("at"))
    index = words.groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "at")))).alias("index"))
    return index.select("conv_id", "turn", P.abstract_of(F.col("index")).alias("text"))


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE '10.1/' || p_partkey % 700 END AS doi, p_name AS title, 1990 + p_size % 35 AS year, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS venue, p_size AS cites, p_partkey AS o FROM part)
SELECT doi, first(title ORDER BY length(title) DESC, o) AS title, CAST(max(year) AS INTEGER) AS year, first(venue ORDER BY o) FILTER (venue <> '') AS venue, CAST(max(cites) AS BIGINT) AS citation_count, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'a' END AS source FROM p WHERE doi IS NOT NULL GROUP BY doi
UNION ALL SELECT doi, title, year, venue, cites, 'a' FROM p WHERE doi IS NULL""", graph=False)
def merge_papers_by_doi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(
        "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE '10.1/' || p_partkey % 700 END AS doi", "p_name AS title", "CAST(NULL AS STRING) AS abstract", "CAST(1990 + p_size % 35 AS INT) AS year", "CAST(NULL AS STRING) AS publication_date", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS venue",
        "CAST(NULL AS STRING) AS pdf_url", "CAST(p_size AS BIGINT) AS citation_count", "CAST(NULL AS BIGINT) AS reference_count", "false AS is_open_access", "array(p_type) AS fields", "map('k' || p_partkey, p_name) AS external_ids",
        "CAST(array() AS array<struct<name:string,position:int,affiliations:array<string>,external_ids:map<string,string>>>) AS authors", "'a' AS source", "p_partkey AS ordinal")
    return P.merged(rows).select("doi", "title", "year", "venue", "citation_count", "source")


@query("SELECT '10.1/' || l_partkey AS doi, 'line of ' || min(l_suppkey) AS title FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY l_partkey", graph=False)
def stub_creation(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("10.1/"), "p_partkey").alias("doi"))
    least = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    refs = least.select(F.concat(F.lit("10.1/"), "l_partkey").alias("doi"), F.concat(F.lit("line of "), "s").alias("title"), F.lit(None).cast("int").alias("year"))
    return P.stubs(refs, known).select("doi", "title")


@query("SELECT p_partkey, array_to_string(list_distinct(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'https://arxiv.org/pdf/2106.1.pdf' END, CASE WHEN p_partkey % 2 = 0 THEN 'https://arxiv.org/pdf/2106.1.pdf' END], lambda x: x IS NOT NULL)), '|') AS urls FROM part", graph=False)
def candidate_pdf_urls(spark: SparkSession, d: str) -> DataFrame:
    url, pre = F.when(F.col("p_partkey") % 3 == 0, "https://arxiv.org/pdf/2106.1.pdf"), F.when(F.col("p_partkey") % 2 == 0, "2106.1v3")
    return table(spark, d, "part").select("p_partkey", F.array_join(P.pdf_urls(url, pre), "|").alias("urls"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), o AS (SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY s) AS position FROM a)
SELECT '10.1/' || p AS src, 'Supplier ' || s AS name, position AS author_position, s % 3 = 0 AS known FROM o""", graph=False)
def author_order(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a part as its authors, in the order of their keys; every third one is known before, by one of two ids."""
    some = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    outside = lambda k: F.when(k % 2 == 0, F.create_map(F.lit("semantic_scholar"), F.concat(F.lit("s"), k))).otherwise(F.create_map(F.lit("orcid"), F.concat(F.lit("0000-"), k)))
    author = lambda k: F.struct(F.concat(F.lit("Supplier "), k).alias("name"), F.lit(0).alias("position"), F.array().cast("array<string>").alias("affiliations"), outside(k).alias("external_ids"))
    lists = some.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list("l_suppkey")), author).alias("authors"))
    listed = P.paper_authors(lists.select(F.concat(F.lit("10.1/"), "l_partkey").alias("doi"), "authors"))
    s = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("known "), "s_suppkey").alias("id"), F.concat(F.lit("Supplier "), "s_suppkey").alias("name"), F.array().cast("array<string>").alias("affiliations"), F.when(F.col("s_suppkey") % 2 != 0, F.concat(F.lit("0000-"), "s_suppkey")).alias("orcid"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("s"), "s_suppkey")).alias("semantic_scholar_id"))
    authors, edges = P.link_authors(s, listed)
    return edges.join(authors.select(F.col("id").alias("dst"), "name"), "dst").select("src", "name", F.col("author_position").cast("long").alias("author_position"), F.col("dst").startswith("known").alias("known"))


@query("""WITH l AS (SELECT l_orderkey % 500 AS src, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS p FROM lineitem), known AS (SELECT DISTINCT src FROM l WHERE src % 2 = 0), r AS (SELECT l.* FROM l JOIN known USING (src)),
new AS (SELECT p, min('10.2/' || src) AS src FROM r WHERE p IS NOT NULL AND p % 5 <> 0 GROUP BY p)
SELECT '10.2/' || src AS src, count(*) AS n_references, count(*) FILTER (p IS NULL) AS skipped_no_doi, count(DISTINCT p) FILTER (p % 3 <> 0 OR src % 4 <> 0) AS edges_created, (SELECT count(*) FROM new WHERE new.src = '10.2/' || r.src) AS stubs_created FROM r GROUP BY r.src
UNION ALL SELECT 'again', (SELECT count(*) FROM r), (SELECT count(*) FROM r WHERE p IS NULL), 0, 0""", graph=False)
def citation_population(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as references; papers of even sources are known, with every fifth part, and some edges. The second run creates nothing."""
    lines = table(spark, d, "lineitem")
    refs = lines.select(F.concat(F.lit("10.2/"), F.col("l_orderkey") % 500).alias("src"), F.when(F.col("l_linenumber") != 7, F.concat(F.lit("10.1/"), "l_partkey")).alias("doi"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"))
    known = lines.where("l_orderkey % 500 % 2 = 0").selectExpr("'10.2/' || l_orderkey % 500 AS doi").distinct().unionByName(lines.where("l_partkey % 5 = 0").selectExpr("'10.1/' || l_partkey AS doi").distinct())
    papers = known.select("doi", F.lit("known").alias("title"), F.lit(False).alias("is_stub"))
    cites = lines.where("l_partkey % 3 = 0 AND l_orderkey % 500 % 4 = 0 AND l_linenumber <> 7").selectExpr("'10.2/' || l_orderkey % 500 AS src", "'10.1/' || l_partkey AS dst").distinct()
    papers, cites, report = P.populate_citations(papers, cites, refs)
    again = P.populate_citations(papers, cites, refs)[2]
    total = again.agg(*(F.sum(c).cast("long").alias(c) for c in ("n_references", "skipped_no_doi", "edges_created", "stubs_created"))).select(F.lit("again").alias("src"), "*")
    return report.unionByName(total)


@query("""SELECT '10.1/' || p_partkey AS doi, p_name AS title, CASE WHEN p_size > 20 THEN 1990 + p_size ELSE 2024 END AS year, 's' || p_partkey AS semantic_scholar_id, 1 AS n_authors FROM part WHERE p_partkey % 10 <> 0""", graph=False)
def graph_papers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(
        "CASE WHEN p_partkey % 10 <> 0 THEN '10.1/' || p_partkey END AS doi", "p_name AS title", "CASE WHEN p_size > 20 THEN CAST(1990 + p_size AS INT) END AS year", "p_brand AS venue", "CAST(NULL AS STRING) AS abstract", "CAST(NULL AS STRING) AS pdf_url",
        "map('S2', 's' || p_partkey) AS external_ids", "array(named_struct('name', p_brand)) AS authors")
    return P.graph_papers(rows, 2024).select("doi", "title", "year", "semantic_scholar_id", F.size("authors").alias("n_authors"))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'updated' ELSE 'created' END AS outcome, count(*) AS n, count(DISTINCT p_name) AS names FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1 UNION ALL SELECT 'error', count(*), 0 FROM part WHERE p_partkey % 7 = 0""", graph=False)
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Records found twice; every third paper is there before, every seventh record has no DOI."""
    found = table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 7 <> 0 THEN '10.1/' || p_partkey END AS doi", "p_name AS title", "p_partkey AS ordinal")
    papers = found.where("ordinal % 3 = 0 AND doi IS NOT NULL").select("doi", F.lit("old").alias("title"))
    new, outcomes = I.import_papers(papers, found.unionByName(found.where("doi is not null").withColumn("title", F.lit("later")).withColumn("ordinal", F.col("ordinal") + 1_000_000_000)), True)
    return outcomes.join(new, "doi", "left").groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("title").alias("names"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 3 THEN p_name END AS name, CAST(p_size AS INTEGER) AS size FROM part""", graph=False)
def decoded_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON text, as text of that text, and once more."""
    once = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size")))
    again = lambda c: F.regexp_replace(F.regexp_replace(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')), "\n", " "), "\t", " ")
    value = F.when(F.col("p_partkey") % 3 == 0, once).when(F.col("p_partkey") % 3 == 1, again(once)).otherwise(again(again(once)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.decode_json(value, "name string, size int").alias("r")).select("id", "r.name", "r.size")


# --- state and review ------------------------------------------------------------------------------------------------


@query("""WITH delta AS (SELECT name, level, parent_id, 'seen' AS description FROM topic WHERE level <> 'subtopic' UNION ALL SELECT r_name, 'area', CAST(NULL AS VARCHAR), 'new' FROM region)
SELECT coalesce(t.name, d.name) AS name, coalesce(t.level, d.level) AS level, coalesce(t.parent_id, d.parent_id) AS parent_id, d.description FROM topic t FULL OUTER JOIN delta d ON t.name = d.name AND t.level = d.level AND t.parent_id IS NOT DISTINCT FROM d.parent_id""")
def upsert_topic(spark: SparkSession, d: str) -> DataFrame:
    topics = load(spark, d).nodes["topic"].withColumn("description", F.lit(None).cast("string"))
    delta = topics.where("level <> 'subtopic'").select("name", "level", "parent_id", F.lit("seen").alias("description"))
    more = topics.where("level = 'domain'").select("name", F.lit("area").alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit("new").alias("description"))
    return U.upsert_topics(topics, delta.unionByName(more)).select("name", "level", "parent_id", "description")


@query("""WITH new AS (SELECT 'O' || o_orderkey AS src, 'N' || o_orderkey % 30 AS dst FROM orders), e AS (SELECT src, dst FROM belongs UNION SELECT src, dst FROM new WHERE dst IN (SELECT id FROM topic))
SELECT t.id, coalesce(n, 0) AS problem_count FROM topic t LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) ON dst = t.id""")
def link_idempotent(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    new = table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("N"), F.col("o_orderkey") % 30).alias("dst"))
    once = U.link(g.edges["belongs_to"], new, g.nodes["problem"], g.nodes["topic"])
    return U.with_counter(g.nodes["topic"], U.link(once, new, g.nodes["problem"], g.nodes["topic"]), "problem_count").select("id", "problem_count")


@query("SELECT t.id, count(b.src) AS problem_count FROM topic t LEFT JOIN belongs b ON b.dst = t.id AND b.src NOT LIKE '%7' GROUP BY t.id")
def unlink_counted(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    left = U.unlink(g.edges["belongs_to"], g.edges["belongs_to"].where("src LIKE '%7'"))
    return U.with_counter(g.nodes["topic"], left, "problem_count").select("id", "problem_count")


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE 'new' END AS origin, count(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT 'rejected', count(*) FROM orders WHERE o_orderkey % 2 = 0""", graph=False)
def insert_unless_known(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("'O' || o_orderkey AS id", "'Order ' || o_orderkey AS statement", "o_orderkey AS ordinal")
    state = rows.where("ordinal % 2 = 0").select("id", "statement", F.lit("kept").alias("origin"))
    delta = rows.selectExpr("CASE WHEN ordinal % 2 = 0 THEN 'X' || ordinal ELSE id END AS id", "' ' || upper(statement) AS statement", "'new' AS origin", "ordinal")
    new, bad = U.insert(state, delta)
    return A.counts_by(new, "origin").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("origin"), "n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderstatus END AS status, 1 + CAST(o_orderkey % 3 = 0 AS INTEGER) AS version FROM orders""", graph=False)
def patch_versions(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "1 AS version")
    return U.patch(state, state.where("id % 3 = 0").select("id", F.lit("patched").alias("status")))


@query("""SELECT 'extracted' AS kind, count(*) AS n FROM extracted WHERE src NOT IN (SELECT src FROM extracted WHERE dst IN ('10.1/5', '10.1/6'))
UNION ALL SELECT 'problem', count(*) FROM problem WHERE id NOT IN (SELECT src FROM extracted WHERE dst IN ('10.1/5', '10.1/6'))
UNION ALL SELECT 'topic', count(*) FROM topic WHERE level <> 'subtopic' OR id NOT IN (SELECT dst FROM belongs) OR id IN (SELECT dst FROM belongs WHERE src NOT IN (SELECT src FROM extracted WHERE dst IN ('10.1/5', '10.1/6')))
UNION ALL SELECT 'shared_subtopic_of', count(*) FROM topic WHERE id IN (SELECT dst FROM belongs WHERE src IN (SELECT src FROM extracted WHERE dst IN ('10.1/5', '10.1/6'))) AND id IN (SELECT dst FROM belongs WHERE src NOT IN (SELECT src FROM extracted WHERE dst IN ('10.1/5', '10.1/6')))""")
def purge_paper(spark: SparkSession, d: str) -> DataFrame:
    g, shared = U.purge(load(spark, d), spark.createDataFrame([("10.1/5",), ("10.1/6",)], "doi string"), "problem", "topic", "extracted_from", "belongs_to")
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(g.edges["extracted_from"], "extracted").unionByName(n(g.nodes["problem"], "problem")).unionByName(n(g.nodes["topic"], "topic")).unionByName(n(shared, "shared_subtopic_of"))


_SCORE = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", F.expr(f"CAST({_SCORE} AS DOUBLE)").alias("score"))
    p = Q.priority(F.col("score"))
    return events.select(F.col("event_id").alias("mention_id"), p.alias("priority"), (F.col("ts") + F.make_interval(hours=Q.hours(p))).alias("sla_deadline"), F.when(F.col("event_id") % 4 == 0, "assigned").otherwise("pending").alias("status"))


_REVIEWS = f"""WITH s AS (SELECT event_id, ts, CAST({_SCORE} AS DOUBLE) AS score FROM events), p AS (SELECT *, CASE WHEN score IS NULL THEN 10 ELSE greatest(1, least(10, 5 + CAST(trunc((1 - score) * 5) AS INTEGER))) END AS priority FROM s),
r AS (SELECT event_id AS mention_id, priority, ts + to_hours(CASE WHEN priority <= 3 THEN 24 WHEN priority <= 6 THEN 168 ELSE 720 END) AS sla_deadline, CASE WHEN event_id % 4 = 0 THEN 'assigned' ELSE 'pending' END AS status FROM p)
"""


@query(_REVIEWS + "SELECT mention_id, CAST(priority AS INTEGER) AS priority, strftime(sla_deadline, '%Y-%m-%d %H:%M:%S') AS sla, status FROM r", graph=False)
def review_priority_sla(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("mention_id", "priority", F.date_format("sla_deadline", "yyyy-MM-dd HH:mm:ss").alias("sla"), "status")


@query(_REVIEWS + "SELECT mention_id, CAST(priority AS INTEGER) AS priority FROM r WHERE status = 'pending' AND priority <= 7 ORDER BY priority, sla_deadline, mention_id LIMIT 20", graph=False)
def review_queue_page(spark: SparkSession, d: str) -> DataFrame:
    return Q.pending(_reviews(spark, d), 20, 7).select("mention_id", "priority")


@query("""SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN 'max_rounds_exceeded' WHEN event_id % 7 = 0 THEN 'evaluator_escalate' WHEN (event_id % 10) / 10.0 < 0.7 THEN 'arbiter_low_confidence' ELSE 'unknown' END AS reason FROM events""", graph=False)
def escalation_reason(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select("event_id", Q.escalation(F.col("event_id") % 5, F.lit(3), F.when(F.col("event_id") % 7 == 0, "escalate").otherwise("approve"), (F.col("event_id") % 10) / 10.0).alias("reason"))


@query("""WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'create_new' ELSE 'retry' END AS decision, (event_id % 10) / 10.0 AS c, 1 + event_id % 4 AS r FROM events)
SELECT event_id, CASE WHEN c < 0.7 AND r < 3 THEN 'retry' WHEN decision = 'retry' AND r < 3 THEN 'retry' WHEN decision = 'retry' THEN 'link' WHEN c < 0.7 THEN 'human_review' ELSE decision END AS route FROM a""", graph=False)
def arbiter_routing(spark: SparkSession, d: str) -> DataFrame:
    decision = F.expr("CASE event_id % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'create_new' ELSE 'retry' END")
    return table(spark, d, "events").select("event_id", S.arbiter_route(decision, (F.col("event_id") % 10) / 10.0, 1 + F.col("event_id") % 4).alias("route"))


@query("""WITH r AS (SELECT event_id, event_id % 2 = 0 AS linked, event_id % 4 = 0 AS has, event_id % 8 = 1 AS done FROM events WHERE event_id % 3 = 0)
SELECT event_id AS mention_id, CASE WHEN NOT done AND (NOT linked OR has) THEN 'resolved' WHEN done THEN 'resolved' ELSE 'pending' END AS status, CASE WHEN NOT done AND (NOT linked OR has) THEN CASE WHEN linked THEN 'linked' ELSE 'rejected' END END AS resolution FROM r""", graph=False)
def review_resolution(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_id % 3 = 0")
    reviews = e.selectExpr("event_id AS mention_id", "CASE WHEN event_id % 8 = 1 THEN 'resolved' ELSE 'pending' END AS status")
    decisions = e.selectExpr("event_id AS mention_id", "CASE WHEN event_id % 2 = 0 THEN 'linked' ELSE 'rejected' END AS resolution", "CASE WHEN event_id % 4 = 0 THEN 'c1' END AS concept_id", "'u' AS resolved_by")
    return Q.resolve(reviews, decisions).select("mention_id", "status", "resolution")


@query("""WITH r AS (SELECT user_id % 40 AS src, event_id % 60 AS dst, CASE event_id % 4 WHEN 0 THEN 'extends' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'depends_on' ELSE 'reframes' END AS relation, value, event_id AS o FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY src, dst, relation ORDER BY o) AS n FROM r),
k AS (SELECT DISTINCT src, dst, relation FROM r WHERE src < 5 AND dst < 50 AND src <> dst),
j AS (SELECT f.*, CASE WHEN f.dst >= 50 THEN 'not_found' WHEN f.src = f.dst THEN 'self' WHEN k.src IS NOT NULL OR n > 1 THEN 'exists' ELSE 'linked' END AS reason FROM f LEFT JOIN k ON k.src = f.src AND k.dst = f.dst AND k.relation = f.relation)
SELECT reason, relation, count(*) AS n, round(sum(CASE WHEN reason = 'linked' THEN value END), 4) AS confidence FROM j GROUP BY reason, relation""", graph=False)
def typed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations with a confidence: new ones are linked, others rejected with a reason."""
    e = table(spark, d, "events")
    new = e.selectExpr("user_id % 40 AS src", "event_id % 60 AS dst", "CASE event_id % 4 WHEN 0 THEN 'extends' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'depends_on' ELSE 'reframes' END AS relation", "value AS confidence", "event_id AS ordinal")
    have = new.where("src < 5 AND dst < 50 AND src <> dst").select("src", "dst", "relation", F.lit(None).cast("double").alias("confidence")).distinct()
    ids = spark.range(60)
    edges, rejects = U.related(have, new, ids, ids.where("id < 50"))
    linked = edges.where("confidence is not null").groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence")).withColumn("reason", F.lit("linked"))
    return linked.unionByName(rejects.groupBy("reason", "relation").agg(F.count("*").alias("n")).withColumn("confidence", F.lit(None).cast("double")))


@query("""WITH e AS (SELECT event_id, event_id % 3 = 0 AS given, event_id % 5 = 0 AS taken FROM events) SELECT event_id AS mention_id, CASE WHEN event_id % 8 = 1 THEN 'resolved' WHEN given AND NOT taken THEN 'assigned' ELSE 'pending' END AS status, CASE WHEN event_id % 8 <> 1 AND given AND NOT taken THEN 'second' END AS assigned_to FROM e""", graph=False)
def review_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every third review is given to two people one after the other, every fifth goes back."""
    e = table(spark, d, "events")
    reviews = e.selectExpr("event_id AS mention_id", "CASE WHEN event_id % 8 = 1 THEN 'resolved' ELSE 'pending' END AS status")
    given = e.where("event_id % 3 = 0").select(F.col("event_id").alias("mention_id"), F.explode(F.array(F.struct(F.lit("first").alias("user_id"), F.lit(2).alias("ordinal")), F.struct(F.lit("second").alias("user_id"), F.lit(3).alias("ordinal")))).alias("g")).select("mention_id", "g.*")
    assigned = Q.assign(reviews, given, F.lit("2024-01-01").cast("timestamp"))
    return Q.unassign(assigned, e.where("event_id % 5 = 0").selectExpr("event_id AS mention_id")).select("mention_id", "status", "assigned_to")


@query("""WITH c AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id) SELECT id, CASE WHEN n IN (5, 10, 25, 50) AND id % 3 <> 0 THEN 'new' ELSE 'old' END AS canonical_statement, CAST(1 + (n IN (5, 10, 25, 50) AND id % 3 <> 0)::INTEGER AS INTEGER) AS version FROM c""", graph=False)
def refined_concepts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").cast("int").alias("mention_count"))
    rows = c.withColumns({"canonical_statement": F.lit("old"), "version": F.lit(1), "last_refined_at_count": F.lit(0), "human_edited": F.col("id") % 3 == 0, "updated_at": F.lit(None).cast("timestamp")})
    return Q.refined(rows, c.select("id", F.lit("new").alias("statement")), F.lit("2024-01-01").cast("timestamp")).select("id", "canonical_statement", "version")


@query("""WITH j AS (SELECT event_id, user_id % 20 AS b, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS s, event_id % 5 AS attempts FROM events)
SELECT CAST(b AS VARCHAR) AS batch_id, least(10, count(*) FILTER (s = 'pending')) AS n_next, count(*) FILTER (s = 'pending' OR s = 'in_progress' OR (s = 'failed' AND attempts < 3)) AS n_again FROM j GROUP BY b""", graph=False)
def batch_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs are created from sources, then updated by what became of them."""
    e = table(spark, d, "events")
    now = F.lit("2024-01-01").cast("timestamp")
    jobs = B.create(e.selectExpr("CAST(event_id AS STRING) AS source"), "all", now).withColumn("batch_id", F.lit(None).cast("string"))
    change = e.selectExpr("CAST(event_id AS STRING) AS source", "CAST(user_id % 20 AS STRING) AS batch_id", "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS status", "CAST(event_id % 5 AS INT) AS attempts")
    jobs = B.update(jobs, change.join(jobs.select("job_id", "source"), "source").drop("source"), now)
    n = lambda rows, name: rows.groupBy("batch_id").agg(F.count("*").alias(name))
    return n(jobs, "all").join(n(B.pending(jobs), "n_next"), "batch_id", "left").join(n(B.resume(jobs), "n_again"), "batch_id", "left").fillna(0, ["n_next", "n_again"]).select("batch_id", "n_next", "n_again")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'deprecated' ELSE o_orderstatus END AS status FROM orders""", graph=False)
def soft_deleted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status")
    gone = rows.where("id % 5 = 0").select("id")
    return U.soft_delete(rows, gone.unionByName(gone))


@query("""WITH s AS (SELECT user_id AS m, event_id AS c, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS n, max(value) OVER (PARTITION BY user_id) AS top FROM events),
e AS (SELECT m, string_agg(CAST(c AS VARCHAR), ',' ORDER BY n) AS suggested, any_value(top) AS top FROM s WHERE n <= 5 GROUP BY m), p AS (SELECT *, CAST(greatest(1, least(10, 5 + trunc((1 - top) * 5))) AS INTEGER) AS priority FROM e)
SELECT m AS mention_id, suggested, priority, CASE WHEN priority <= 3 THEN 'high' WHEN priority <= 6 THEN 'medium' ELSE 'low' END AS word, strftime(TIMESTAMP '2024-01-01' + to_hours(CASE WHEN priority <= 3 THEN 24 WHEN priority <= 6 THEN 168 ELSE 720 END), '%Y-%m-%d %H:%M:%S') AS sla FROM p""", graph=False)
def review_enqueue(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    found = Q.enqueue(e.select(F.col("user_id").alias("id")).distinct(), e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score")), F.lit("2024-01-01").cast("timestamp"))
    ids = F.array_join(F.transform("suggested", lambda x: x["id"].cast("string")), ",")
    return found.select("mention_id", ids.alias("suggested"), "priority", Q.word(F.col("priority")).alias("word"), F.date_format("sla_deadline", "yyyy-MM-dd HH:mm:ss").alias("sla"))


@query("""SELECT CAST(user_id % 10 AS BIGINT) AS client, CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 7) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 100 + event_id % 7 END) AS BIGINT) AS total_tokens FROM events GROUP BY user_id % 10""", graph=False)
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").selectExpr("user_id % 10 AS client", "event_id % 100 AS prompt_tokens", "event_id % 7 AS completion_tokens", "CASE WHEN event_id % 3 = 0 THEN 1 END AS total_tokens")
    return A.usage(calls, "client")


@query("""SELECT conv_id, turn, CAST(floor((coalesce(length(text), 0) + length(role)) / 4) + 100 AS BIGINT) AS tokens, CASE WHEN length('s:op:a=' || conv_id || ':b=' || text) > 200 THEN 's:op:' || substr(md5('s:op:a=' || conv_id || ':b=' || text), 1, 16) ELSE coalesce('s:op:a=' || conv_id || ':b=' || text, 's:op:a=' || conv_id) END AS cache_key FROM conversations""", graph=False)
def call_estimates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.tokens_estimate(F.col("text"), F.col("role"), 100).cast("long").alias("tokens"), P.cache_key("s", "op", b=F.col("text"), a=F.col("conv_id")).alias("cache_key"))


@query("""SELECT doc_id FROM labels WHERE doc_id % 2 = 0 AND quality = 1""", graph=False)
def skippable_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers extracted under the present taxonomy; the last of two runs counts."""
    l = table(spark, d, "labels")
    runs = l.select(F.col("doc_id").alias("doi"), F.lit(1).alias("ordinal"), F.lit("old").alias("taxonomy_hash"), F.array(F.lit("models")).alias("failed"))
    later = l.select(F.col("doc_id").alias("doi"), F.lit(2).alias("ordinal"), F.when(F.col("doc_id") % 2 == 0, "now").otherwise("other").alias("taxonomy_hash"), F.when(F.col("quality") == 0, F.array(F.lit("topics"))).alias("failed"))
    papers = I.extraction_metadata(l.select(F.col("doc_id").alias("doi")).distinct(), runs.unionByName(later))
    return I.skippable(papers, "now").select(F.col("doi").alias("doc_id"))


# --- schema, taxonomy, integration -----------------------------------------------------------------------------------


@query("""SELECT rule, count(*) AS n FROM (SELECT 'year' AS rule FROM paper WHERE year > 2020 UNION ALL SELECT 'title_length' FROM paper WHERE venue LIKE '%1' UNION ALL SELECT 'unique' FROM paper WHERE venue LIKE '%2') GROUP BY rule""")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d).nodes["paper"]
    odd = p.select(F.col("id").alias("doi"), F.when(F.col("venue").endswith("1"), "x").otherwise(F.col("title")).alias("title"), F.when(F.col("year") > 2020, 3000).otherwise(F.col("year")).alias("year"), "venue")
    return A.counts_by(C.violations(odd.unionByName(odd.where("venue LIKE '%2'").withColumn("title", F.lit("again")).withColumn("year", F.lit(2000))), "paper"), "rule")


_KIND = "CASE event_id % 6 WHEN 0 THEN ' Data ' WHEN 1 THEN 'GPU bound' WHEN 2 THEN 'new dataset' WHEN 3 THEN 'theory of x' WHEN 4 THEN event_type ELSE 'algorithm' END"


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'data' WHEN 1 THEN 'computational' WHEN 2 THEN 'data' WHEN 3 THEN 'theoretical' ELSE 'methodological' END AS kind,
CASE event_id % 3 WHEN 0 THEN CAST(event_id % 50 AS DOUBLE) WHEN 1 THEN round((event_id % 50) / 1000.0, 9)::DOUBLE END AS wait FROM events""", graph=False)
def extraction_scalars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.expr(_KIND)).withColumn("n", (F.col("event_id") % 50).cast("string"))
    header = F.when(F.col("event_id") % 3 == 0, F.col("n"))
    message = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("Please try again in "), "n", F.lit("ms."))).otherwise("no hint")
    return e.select("event_id", X.constraint_type(F.col("k")).alias("kind"), F.round(X.retry_after(header, message), 9).alias("wait"))


@query("""WITH p AS (SELECT conv_id, turn + 1 AS ordinal, left(text, 100) AS s FROM conversations), r AS (SELECT conv_id, turn, 'Problem ' || (turn + 1) AS source, CASE WHEN turn % 2 = 0 THEN CAST(turn + 2 AS VARCHAR) ELSE 'other' END AS target FROM conversations)
SELECT r.conv_id, r.turn, md5(CASE WHEN target = 'other' THEN source ELSE a.s END) AS source, md5(CASE WHEN target = 'other' THEN target ELSE b.s END) AS target
FROM r LEFT JOIN p a ON a.conv_id = r.conv_id AND a.ordinal = r.turn + 1 LEFT JOIN p b ON b.conv_id = r.conv_id AND b.ordinal = r.turn + 2 WHERE target = 'other' OR (a.s IS NOT NULL AND b.s IS NOT NULL)""", graph=False)
def relation_number_mapping(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    problems = c.select("conv_id", (F.col("turn") + 1).cast("int").alias("ordinal"), F.col("text").alias("statement"))
    relations = c.select("conv_id", "turn", F.concat(F.lit("Problem "), F.col("turn") + 1).alias("source"), F.when(F.col("turn") % 2 == 0, (F.col("turn") + 2).cast("string")).otherwise("other").alias("target"))
    return X.numbered_ends(relations, problems, "conv_id").select("conv_id", "turn", F.md5("source").alias("source"), F.md5("target").alias("target"))


@query("""SELECT d.id, d.name, count(DISTINCT a.id) AS n_areas, string_agg(DISTINCT a.name, ',' ORDER BY a.name) AS areas, count(s.id) AS n_subtopics
FROM topic d LEFT JOIN topic a ON a.parent_id = d.id LEFT JOIN topic s ON s.parent_id = a.id WHERE d.level = 'domain' GROUP BY d.id, d.name""")
def taxonomy_export(spark: SparkSession, d: str) -> DataFrame:
    tree = Y.export(load(spark, d).nodes["topic"])
    names = F.transform("areas", lambda a: a["name"])
    total = F.aggregate("areas", F.lit(0).cast("long"), lambda n, a: n + F.size(a["subtopics"]))
    return tree.select("id", "name", F.size("areas").cast("long").alias("n_areas"), F.array_join(names, ",").alias("areas"), total.alias("n_subtopics"))


@query("SELECT t.id, t.level, concat_ws('/', d.name, a.name, t.name) AS path FROM topic t LEFT JOIN topic a ON a.id = t.parent_id LEFT JOIN topic d ON d.id = a.parent_id")
def taxonomy_paths(spark: SparkSession, d: str) -> DataFrame:
    return Y.flatten(load(spark, d).nodes["topic"])


@query("""SELECT 'parent' AS problem, count(*) AS n FROM topic WHERE level = 'subtopic' UNION ALL SELECT 'level', count(*) FROM topic WHERE level = 'area' AND id LIKE '%3'""")
def taxonomy_checks(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d).nodes["topic"]
    level = F.when((F.col("level") == "area") & F.col("id").endswith("3"), "field").otherwise(F.col("level"))
    nodes = t.select(F.col("id").alias("path"), F.when(F.col("level") != "subtopic", F.col("parent_id")).alias("parent_path"), "name", level.alias("level"))
    return A.counts_by(Y.problems(nodes), "problem")


@query("""WITH n AS (SELECT DISTINCT o_orderpriority AS name FROM orders) SELECT name, count(*) AS n_problems FROM n JOIN orders ON o_orderpriority = name GROUP BY name""", graph=False)
def topic_migration(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit(" "), "o_orderpriority").alias("domain"))
    topics, edges = Y.from_domains(rows, load(spark, d).nodes["topic"])
    return U.with_counter(topics, edges, "n_problems").where("n_problems > 0").select("name", "n_problems")


@query("""WITH f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'link' WHEN 1 THEN 'create_new' WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'human_review' ELSE 'create_new' END ELSE 'create_new' END AS fate FROM events)
SELECT 'instance_of' AS kind, count(*) AS n FROM f WHERE fate <> 'human_review' UNION ALL SELECT 'new_concept', count(*) FROM f WHERE fate = 'create_new' UNION ALL SELECT 'escalated', count(*) FROM f WHERE fate = 'human_review'""", graph=False)
def mention_integration(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    found = e.selectExpr("event_id AS id", "event_type AS statement").withColumn("id", F.col("id").cast("string"))
    routes = e.where("event_id % 5 < 4").selectExpr("CAST(event_id AS STRING) AS query_id", "'c' AS id", "CASE event_id % 5 WHEN 0 THEN 'auto_link' WHEN 2 THEN 'evaluator' WHEN 3 THEN 'debate' ELSE 'new_concept' END AS route")
    decisions = e.where("event_id % 5 = 2").selectExpr("CAST(event_id AS STRING) AS mention", "CASE event_id % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'human_review' ELSE 'create_new' END AS decision")
    edges, made, up = I.integrate(found, routes, decisions)
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(edges, "instance_of").unionByName(n(made, "new_concept")).unionByName(n(up, "escalated"))


@query("""WITH RECURSIVE v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS at, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
near AS (SELECT b.at, a.at AS before, round(list_cosine_similarity(a.vector, b.vector), 9) AS score FROM v a JOIN v b ON a.at < b.at),
close AS (SELECT * FROM near WHERE score >= 0.35),
step AS (SELECT CAST(0 AS BIGINT) AS at, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS best
UNION ALL SELECT s.at + 1, CASE WHEN min(c.before) IS NULL THEN list_append(s.kept, s.at + 1) ELSE s.kept END, first(c.before ORDER BY c.score DESC, c.before) FILTER (c.before IS NOT NULL)
FROM step s LEFT JOIN close c ON c.at = s.at + 1 AND list_contains(s.kept, c.before) WHERE s.at < (SELECT count(*) FROM v) GROUP BY s.at, s.kept)
SELECT v.id, coalesce(k.id, v.id) AS keep_id FROM step JOIN v ON v.at = step.at LEFT JOIN v k ON k.at = step.best""", graph=False)
def sequential_merge(spark: SparkSession, d: str) -> DataFrame:
    _, rows = _vectors(spark, d)
    return I.merge_in_order(rows.select("id", "vector", F.col("id").alias("ordinal")), 0.35)


@query("""WITH o AS (SELECT user_id % 7 AS trace_id, event_id AS paper, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 'updated' WHEN event_id % 3 = 0 THEN 'skipped' ELSE 'created' END AS outcome FROM events)
SELECT trace_id, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS error, CAST(count(*) FILTER (outcome = 'error') AS INTEGER) AS n_messages FROM o GROUP BY trace_id""", graph=False)
def ingestion_report(spark: SparkSession, d: str) -> DataFrame:
    known, failed = F.col("event_id") % 3 == 0, F.col("event_id") % 11 == 0
    outcome = F.when(F.col("user_id") % 2 == 0, I.import_outcome(known, failed, True)).otherwise(I.import_outcome(known, failed, False))
    rows = table(spark, d, "events").select((F.col("user_id") % 7).alias("trace_id"), F.col("event_id").cast("string").alias("paper"), outcome.alias("outcome"), F.lit("failed").alias("message"))
    messages = I.errors_of_runs(rows).groupBy("trace_id").agg(F.count("*").cast("int").alias("n_messages"))
    return I.rows_per_run(rows).drop("errors").join(messages, "trace_id", "left").fillna(0, ["n_messages"])


@query("""WITH c AS (SELECT conv_id AS paper, turn AS ordinal, text, CASE WHEN turn % 2 = 0 THEN 'HTTP 404' ELSE 'refused' END AS error, coalesce(length(text), 0) >= 250 AS good FROM conversations)
SELECT paper, md5(first(text ORDER BY ordinal) FILTER (good)) AS hash, CASE WHEN count(*) FILTER (good) = 0 THEN CASE WHEN contains(first(error ORDER BY ordinal DESC), '404') THEN 'failed_404' ELSE 'failed_blocked' END END AS failure FROM c GROUP BY paper""", graph=False)
def full_text_choice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("paper"), F.col("turn").alias("ordinal"), "text", F.when(F.col("turn") % 2 == 0, "HTTP 404").otherwise("refused").alias("error"))
    best = I.best_full_text(c)
    return best.select("paper", F.md5("text").alias("hash"), F.when(F.col("failure").isNotNull(), X.download_failure(F.col("failure"))).alias("failure"))


# --- providers, lookups and publications ------------------------------------------------------------------------------

_PROVIDER = "heliograph.sources.providers.StoredRecords"


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_partkey), w AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT -n_nationkey - 1 FROM nation)
SELECT CAST(k AS VARCHAR) AS id, p_name AS name, coalesce(p_size, 0) AS size, coalesce(c.n, 0) AS n_authors, CASE WHEN p_partkey IS NULL THEN 'not found' END AS error FROM w LEFT JOIN part ON p_partkey = k LEFT JOIN c ON l_partkey = k""", graph=False)
def looked_up_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of a provider by id, and what belongs to each, in requests of 500 ids; ids that it does not know are failures."""
    pairs = keep_by_key(table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "authored")
    options = {"records": keep_by_key(table(spark, d, "part"), "p_partkey", "records"), "key": "p_partkey", "kind.authors": pairs, "kind.authors.key": "l_partkey"}
    wanted = table(spark, d, "part").where("p_partkey % 3 = 0").selectExpr("CAST(p_partkey AS STRING) AS id")
    none = table(spark, d, "nation").selectExpr("CAST(-n_nationkey - 1 AS STRING) AS id")
    found, failed = L.lookup(wanted.unionByName(none), _PROVIDER, options, "p_name string, p_size int")
    authors, _ = L.lookup(wanted, _PROVIDER, options, "l_suppkey long", "authors")
    rows = found.select("id", F.col("p_name").alias("name"), F.col("p_size").alias("size")).unionByName(failed, allowMissingColumns=True)
    return rows.join(authors.groupBy("id").agg(F.count_distinct("l_suppkey").alias("n_authors")), "id", "left").fillna(0, ["size", "n_authors"])


@query("""SELECT 'second' AS source, p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'o') AND p_size BETWEEN 10 AND 30 UNION ALL SELECT 'third', p_partkey, p_name FROM part WHERE contains(lower(p_name), 'o') AND p_size BETWEEN 10 AND 30""", graph=False)
def records_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three sources under one query, page by page; the filters are theirs to apply, and one source is not asked."""
    options = {"records": f"{d}/part.parquet", "key": "p_partkey", "search": "p_name"}
    rows = N.provider_records(spark, {k: (_PROVIDER, options) for k in ("first", "second", "third")}, "source string, p_partkey long, p_name string, p_size int", "O", page_size=500)
    return rows.where("source IN ('second', 'third') AND p_size >= 10 AND p_size <= 30").select("source", F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


@query("""WITH o AS (SELECT event_type, event_id, CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'created' END AS outcome FROM events)
SELECT event_type AS run, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'error') AS error, count(*) FILTER (outcome = 'created') AS stored FROM o GROUP BY event_type""", graph=False)
def published_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run's report and the state that it made, published at once and read back from the same version."""
    outcomes = table(spark, d, "events").select(F.col("event_type").alias("trace_id"), "event_id", F.when(F.col("event_id") % 11 == 0, "error").otherwise("created").alias("outcome"))
    report = outcomes.groupBy(F.col("trace_id").alias("run")).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "error")))
    path = new_dir(spark, "published")
    K.publish(spark, path, {"state": outcomes.where("outcome = 'created'"), "report": report.limit(0)})
    version = K.publish(spark, path, {"report": report})
    stored = K.read(spark, path, "state", version).groupBy(F.col("trace_id").alias("run")).agg(F.count("*").alias("stored"))
    return K.read(spark, path, "report", version).join(stored, "run", "left").fillna(0, ["stored"])


# --- the stored graph, and counters that follow changes ------------------------------------------------------------------


def _stored(spark: SparkSession, d: str) -> D.StoredGraph:
    g = load(spark, d)
    some = Graph({"paper": g.nodes["paper"].select("id", "year")}, {"cites": g.edges["cites"]})
    return D.save(some, {"cites": {"dst": ("paper", ["year"])}})


@query("""SELECT p.id, coalesce(i.n, 0) AS citation_count, coalesce(o.n, 0) AS reference_count FROM paper p
LEFT JOIN (SELECT dst, count(*) AS n FROM cites GROUP BY dst) i ON i.dst = p.id LEFT JOIN (SELECT src, count(*) AS n FROM cites GROUP BY src) o ON o.src = p.id""")
def stored_citation_counts(spark: SparkSession, d: str) -> DataFrame:
    """citation_counts over bucketed tables: no shuffle of nodes or edges."""
    return _stored(spark, d).degree_counts("paper", "cites")


@query("SELECT p.id, count(c.dst) AS n_refs, CAST(count(CASE WHEN t.year < p.year THEN 1 END) AS BIGINT) AS n_older FROM paper p LEFT JOIN cites c ON c.src = p.id LEFT JOIN paper t ON t.id = c.dst GROUP BY p.id")
def stored_references(spark: SparkSession, d: str) -> DataFrame:
    """references_of_papers over bucketed tables: edges carry the year of the paper that they lead to."""
    g = _stored(spark, d)
    by = g.hop("paper", "cites").groupBy("id").agg(F.count("*").alias("n_refs"), F.count_if(F.col("dst_year") < F.col("year")).alias("n_older"))
    return g.nodes("paper").select("id").join(by, "id", "left").fillna(0, ["n_refs", "n_older"])


@query("""WITH c AS (SELECT src, dst, CAST(substr(src, 2) AS BIGINT) AS k FROM belongs), after AS (SELECT src, dst FROM c WHERE k % 7 > 1 AND k % 11 <> 0 UNION SELECT src, dst FROM c WHERE k % 7 = 1)
SELECT t.id, count(a.src) AS problem_count FROM topic t LEFT JOIN after a ON a.dst = t.id GROUP BY t.id""")
def counters_by_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Links and unlinks, mixed and repeated, added to counters that are never counted anew."""
    g = load(spark, d)
    k = F.substring("src", 2, 20).cast("long")
    full = g.edges["belongs_to"].distinct()
    old = full.where(k % 7 > 0)
    off = old.where((k % 11 == 0)).select("src", "dst", F.lit(False).alias("linked"), F.lit(1).alias("ordinal"))
    back = full.where(k % 7 == 1).select("src", "dst", F.lit(True).alias("linked"), F.lit(2).alias("ordinal"))
    never = full.where(k % 7 == 0).select("src", "dst", F.lit(False).alias("linked"), F.lit(3).alias("ordinal"))
    twice = full.where(k % 7 == 0).select("src", "dst", F.lit(True).alias("linked"), F.lit(1).alias("ordinal"))
    counted = U.with_counter(g.nodes["topic"], old, "problem_count")
    _, deltas = U.edge_changes(old, off.unionByName(back).unionByName(never).unionByName(twice))
    return U.add_to_counter(counted, deltas, "problem_count").select("id", "problem_count")


# --- several extractors in one pass, and a migration in steps ---------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id * 100 + turn AS id, text FROM conversations)
SELECT id, CASE WHEN text IS NOT NULL THEN array_to_string(regexp_extract_all(text, '[0-9]+'), ',') END AS numbers, coalesce(length(text), -1) AS chars, coalesce(len(regexp_extract_all(text, '[^ ]+')), -1) AS words,
CASE WHEN text IS NULL THEN 'no text' WHEN length(text) % 3 = 0 THEN 'ValueError: a third' ELSE 'ok' END AS last_status FROM t""", graph=False)
def extractors_in_one_pass(spark: SparkSession, d: str) -> DataFrame:
    """Four extractors over each turn, one of which fails at a third of them; nested results stored as text and loaded again."""
    import re

    def third(text: str) -> list:
        if len(text) % 3 == 0:
            raise ValueError("a third")
        return []

    extractors = {"numbers": lambda t: [{"name": n} for n in re.findall("[0-9]+", t)], "sizes": lambda t: {"chars": len(t), "deep": {"words": [x for x in t.split(" ") if x]}}, "plain": len, "third": third}
    done = G.extract_all(table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), "text", extractors)
    back = P.loaded_properties(P.stored_properties(done), "id long, results variant, status map<string,string>")
    numbers = F.transform(G.result("numbers", "array<struct<name:string>>"), lambda x: x["name"])
    words = F.size(G.result("sizes.deep.words", "array<string>"))
    chars = F.when(G.result("plain", "int") == G.result("sizes.chars", "int"), G.result("plain", "long"))
    return back.select("id", F.array_join(numbers, ",").alias("numbers"), F.coalesce(chars, F.lit(-1)).alias("chars"), F.coalesce(words, F.lit(-1)).cast("long").alias("words"), F.element_at("status", "third").alias("last_status"))


@query("""WITH n AS (SELECT o_orderpriority AS name, substr(sha256('migrated/' || o_orderpriority), 1, 16) AS id, length(o_orderpriority) % 2 AS parity, count(*) AS n FROM orders GROUP BY o_orderpriority)
SELECT first(name ORDER BY length(name) DESC, id) AS name, CAST(sum(n) AS BIGINT) AS problem_count, count(*) AS members, CAST(4 AS BIGINT) AS steps FROM n GROUP BY parity""", graph=False)
def migration_in_steps(spark: SparkSession, d: str) -> DataFrame:
    """Domain names to topics in four steps, each published with its entry in the ledger; names of even and of odd length are near one another."""
    problems = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"))
    embed = lambda t: t.withColumn("vector", F.when(F.length("name") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    topics = spark.createDataFrame([], "id string, name string, level string, parent_id string")
    tables, ledger = Z.run(spark, new_dir(spark, "migration"), Z.domains_to_topics(embed, 0.9), {"problems": problems, "topics": topics})
    members = tables["merged"].groupBy(F.col("keep_id").alias("id")).agg((F.count("*") + 1).alias("members"))
    steps = ledger.agg(F.count("*")).scalar()
    return tables["topics"].join(members, "id", "left").fillna(1, ["members"]).select("name", "problem_count", "members", steps.alias("steps"))
