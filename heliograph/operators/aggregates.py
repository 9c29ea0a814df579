"""Statistics, counter reconciliation, health checks and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def reconcile(nodes: DataFrame, counters: dict[str, DataFrame]) -> DataFrame:
    """Nodes whose counter columns differ from the distinct edges (src, dst) that arrive: id, and for each counter its old and new value."""
    out = nodes.select("id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"old_{c}") for c in counters))
    for c, edges in counters.items():
        real = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias(f"new_{c}")).withColumnRenamed("dst", "id")
        out = out.join(real, "id", "left").fillna(0, [f"new_{c}"])
    return out.where(reduce(lambda a, b: a | b, (F.col(f"old_{c}") != F.col(f"new_{c}") for c in counters)))


def degree_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, citation_count (distinct edges in) and reference_count (distinct edges out)."""
    edges = edges.select("src", "dst").distinct()
    into = edges.groupBy("dst").agg(F.count("*").alias("citation_count")).withColumnRenamed("dst", "id")
    out = edges.groupBy("src").agg(F.count("*").alias("reference_count")).withColumnRenamed("src", "id")
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").fillna(0, ["citation_count", "reference_count"])


def is_complete(flag: str = "extraction_incomplete") -> Column:
    """A null flag counts as complete."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def completeness(papers: DataFrame, failed: str = "failed_extractors") -> DataFrame:
    """Share of all papers at which each extractor failed; failed is a comma-separated list with blanks."""
    one = papers.withColumn("extractor", F.explode_outer(F.transform(F.split(failed, ","), lambda x: F.trim(x)))).select("extractor")
    total = papers.agg(F.count("*")).scalar()
    by = one.where("extractor <> ''").groupBy("extractor").agg(F.count("*").alias("n"))
    return by.select("extractor", (F.col("n") / total).alias("share"))


def sanity(graph: Graph, orphans: dict[str, tuple[str, str]]) -> DataFrame:
    """(check_name, n, passed): nodes of a label without an outgoing edge of a type, and totals, which must not be zero. Every node table is read once, with all its checks."""
    one = lambda name, n, ok: F.struct(F.lit(name).alias("check_name"), n.alias("n"), ok.alias("passed"))
    rows = []
    for label, nodes in graph.nodes.items():
        mine = {name: kind for name, (of, kind) in orphans.items() if of == label}
        for kind in mine.values():
            nodes = nodes.join(graph.edges[kind].select(F.col("src").alias("id")).distinct().withColumn(f"__{kind}", F.lit(True)), "id", "left")
        checks = [(f"nodes_{label}", F.count("*"), True), *((name, F.count_if(F.col(f"__{kind}").isNull()), False) for name, kind in mine.items())]
        got = nodes.agg(*(n.alias(name) for name, n, _ in checks))
        rows.append(got.select(F.inline(F.array(*(one(name, F.col(name), (F.col(name) > 0) if total else (F.col(name) == 0)) for name, _, total in checks)))))
    for kind, edges in graph.edges.items():
        rows.append(edges.agg(F.count("*").alias("n")).select(F.lit(f"edges_{kind}").alias("check_name"), "n", (F.col("n") > 0).alias("passed")))
    return reduce(DataFrame.unionByName, rows)


def edge_histogram(graph: Graph) -> DataFrame:
    return graph.untyped().groupBy("kind").agg(F.count("*").alias("n"))


def progress(jobs: DataFrame, batch: str, status: str = "status") -> DataFrame:
    """Per batch: total, one count for each status, and the shares done and succeeded, in percent."""
    n = lambda s: F.count_if(F.col(status) == s)
    done = F.col("completed") + F.col("failed")
    return (
        jobs.groupBy(batch)
        .agg(F.count("*").alias("total"), *(n(s).alias(s) for s in ("pending", "in_progress", "completed", "failed")), F.coalesce(F.sum("problems"), F.lit(0)).cast("long").alias("problems"))
        .withColumn("percent_done", F.when(F.col("total") > 0, 100.0 * done / F.col("total")).otherwise(0.0))
        .withColumn("percent_good", F.when(done > 0, 100.0 * F.col("completed") / done).otherwise(0.0))
    )


def threshold_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """pairs: score and same. Confusion counts, precision, recall and F1 at every threshold; zero where a denominator is."""
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return sweep_of_bins(pairs.groupBy("same", reached.cast("int").alias("bin")).agg(F.count("*").alias("n")), thresholds)


def sweep_of_bins(bins: DataFrame, thresholds: list[float]) -> DataFrame:
    """The same from counts (same, bin, n), where bin is the number of thresholds (ascending) that a score reaches."""
    hit = lambda k, same, over: F.coalesce(F.sum(F.when((F.col("same") == same) & ((F.col("bin") > k) == over), F.col("n"))), F.lit(0))
    row = bins.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), hit(k, True, True).alias("tp"), hit(k, False, True).alias("fp"), hit(k, False, False).alias("tn"), hit(k, True, False).alias("fn")) for k, t in enumerate(thresholds))).alias("rows"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = F.col("precision"), F.col("recall")
    return (
        row.select(F.inline("rows"))
        .withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", share(2 * p * r, p + r))
    )


def recommended(sweep: DataFrame) -> DataFrame:
    """The threshold of the best F1, then precision, then threshold; nothing where no F1 is above zero."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", "precision", "threshold"))
    return sweep.where("f1 > 0").agg(best.alias("b")).where("b is not null").select("b.threshold", "b.f1")


def duplicates_of(rows: DataFrame, *key: str) -> DataFrame:
    """Violations of a uniqueness constraint."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def current_version(spark: SparkSession, versions: DataFrame) -> DataFrame:
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def with_version(spark: SparkSession, versions: DataFrame, version: int, at: Column) -> DataFrame:
    """versions with one more row, unless that version or a later one is there."""
    new = spark.range(1).select(F.lit(version).alias("version"), at.alias("applied_at"))
    return versions.unionByName(new.join(versions.where(F.col("version") >= version).limit(1).select(F.lit(1).alias("v")), F.lit(True), "left_anti"), allowMissingColumns=True)


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Sums of token usage (prompt_tokens, completion_tokens); their sum where a call tells no total_tokens."""
    total = F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    return calls.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")), F.coalesce(F.sum(total), F.lit(0)).alias("total_tokens"))


def report_lines(sweep: DataFrame) -> DataFrame:
    """A threshold sweep as lines of text, by threshold."""
    return sweep.orderBy("threshold").select(F.format_string("%.2f  tp %d  fp %d  tn %d  fn %d  p %.3f  r %.3f  f1 %.3f", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1").alias("line"))
