"""Bibliographic records of three kinds of source: identifiers, normal form, merging, stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of identifiers.
DOI = r"^10\.\d{4,}/"
PREPRINT = r"(?i)^\d{4}\.\d{4,5}(v\d+)?$|^[a-z-]+/\d{7}$"
PREPRINT_ANYWHERE = r"(?i)(?:arxiv[:\.])?(\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)"
CATALOGUE = r"(?i)^W\d+$"
CITATION_INDEX = r"(?i)^[a-f0-9]{40}$"

#: The normal form of a paper, whatever its source (a schema as text).
PAPER = (
    "doi string, title string, abstract string, year int, publication_date string, venue string, pdf_url string, citation_count long, reference_count long, is_open_access boolean, "
    "fields array<string>, external_ids map<string,string>, authors array<struct<name:string,position:int,affiliations:array<string>,external_ids:map<string,string>>>, source string"
)


def identifier_type(value: Column) -> Column:
    v = F.trim(value)
    low = F.lower(v)
    return (
        F.when(low.startswith("doi:") | v.startswith("https://doi.org/"), "doi")
        .when(low.startswith("arxiv:") | v.startswith("https://arxiv.org/"), "arxiv")
        .when(v.startswith("https://openalex.org/"), "openalex")
        .when(v.rlike(DOI), "doi")
        .when(v.rlike(PREPRINT), "arxiv")
        .when(v.rlike(CATALOGUE), "openalex")
        .when(v.rlike(CITATION_INDEX), "semantic_scholar")
    )


def preprint_id(value: Column) -> Column:
    """The preprint id anywhere in the value, else the value."""
    return F.coalesce(F.nullif(F.regexp_extract(value, PREPRINT_ANYWHERE, 1), F.lit("")), value)


def catalogue_id(value: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(value, r"(?i)^(?:https://openalex\.org/)?(W\d+)$", 1), F.lit("")), value)


def preprint_pdf(value: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), F.regexp_replace(value, r"v\d+$", ""), F.lit(".pdf"))


def preprint_page(value: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), preprint_id(value))


def abstract_of(index: Column) -> Column:
    """Text of an inverted index (word -> places): words by place, of a place's words the last entered, gaps skipped."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(entries)
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.lit(1), F.size(ordered))), lambda a, b: F.struct(a["w"].alias("w"), (F.coalesce(b["p"], F.lit(-1)) != a["p"]).alias("keep")))
    return F.nullif(F.array_join(F.transform(F.filter(pairs, lambda x: x["keep"]), lambda x: x["w"]), " "), F.lit(""))


def pdf_urls(pdf_url: Column, preprint: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(F.nullif(pdf_url, F.lit("")), preprint_pdf(F.nullif(preprint, F.lit(""))))))


def from_citation_index(raw: DataFrame) -> DataFrame:
    """raw: paperId, externalIds, title, abstract, year, publicationDate, venue, openAccessPdf, citationCount, referenceCount, isOpenAccess, fieldsOfStudy, authors."""
    authors = F.transform("authors", lambda a, i: F.struct(a["name"].alias("name"), (i + 1).alias("position"), F.array().cast("array<string>").alias("affiliations"), F.create_map(F.lit("s2"), a["authorId"]).alias("external_ids")))
    return raw.select(
        F.nullif(F.col("externalIds")["DOI"], F.lit("")).alias("doi"), "title", "abstract", F.col("year").cast("int").alias("year"), F.col("publicationDate").alias("publication_date"), "venue",
        F.col("openAccessPdf.url").alias("pdf_url"), F.col("citationCount").cast("long").alias("citation_count"), F.col("referenceCount").cast("long").alias("reference_count"),
        F.coalesce("isOpenAccess", F.lit(False)).alias("is_open_access"), F.col("fieldsOfStudy").alias("fields"),
        F.map_concat(F.coalesce("externalIds", F.create_map().cast("map<string,string>")), F.create_map(F.lit("S2"), F.col("paperId"))).alias("external_ids"), authors.alias("authors"), F.lit("semantic_scholar").alias("source"),
    )


def from_preprints(raw: DataFrame) -> DataFrame:
    """raw: id, title, summary, published, doi, pdf_url, categories, authors. The year is the date's, else that of the id."""
    two = F.regexp_extract("id", r"^(\d{2})\d{2}\.", 1).try_cast("int")
    year = F.coalesce(F.substring("published", 1, 4).try_cast("int"), F.when(two < 50, 2000 + two).otherwise(1900 + two))
    authors = F.transform("authors", lambda a, i: F.struct(a["name"].alias("name"), (i + 1).alias("position"), F.array_compact(F.array(a["affiliation"])).alias("affiliations"), F.create_map().cast("map<string,string>").alias("external_ids")))
    return raw.select(
        F.nullif("doi", F.lit("")).alias("doi"), "title", F.col("summary").alias("abstract"), year.alias("year"), F.substring("published", 1, 10).alias("publication_date"), F.lit("arXiv").alias("venue"), "pdf_url",
        F.lit(None).cast("long").alias("citation_count"), F.lit(None).cast("long").alias("reference_count"), F.lit(True).alias("is_open_access"), F.col("categories").alias("fields"),
        F.create_map(F.lit("ArXiv"), F.col("id")).alias("external_ids"), authors.alias("authors"), F.lit("arxiv").alias("source"),
    )


def from_catalogue(raw: DataFrame) -> DataFrame:
    """raw: id, doi, title, abstract_inverted_index, publication_year, publication_date, venue, oa_url, is_oa, cited_by_count, referenced_works_count, concepts, authors."""
    authors = F.transform("authors", lambda a, i: F.struct(a["name"].alias("name"), (i + 1).alias("position"), a["affiliations"].alias("affiliations"), F.create_map(F.lit("openalex"), F.regexp_replace(a["id"], r"^https://openalex\.org/", "")).alias("external_ids")))
    return raw.select(
        F.regexp_replace("doi", r"^https://doi\.org/", "").alias("doi"), "title", abstract_of(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_year").cast("int").alias("year"), "publication_date", "venue", F.col("oa_url").alias("pdf_url"),
        F.col("cited_by_count").cast("long").alias("citation_count"), F.col("referenced_works_count").cast("long").alias("reference_count"), F.coalesce("is_oa", F.lit(False)).alias("is_open_access"), F.col("concepts").alias("fields"),
        F.create_map(F.lit("OpenAlex"), catalogue_id(F.col("id"))).alias("external_ids"), authors.alias("authors"), F.lit("openalex").alias("source"),
    )


def merged(papers: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of one DOI as one row; papers without a DOI pass through.

    First non-empty of venue and PDF; longest title, abstract and date (the first of equals); latest year; highest counts;
    authors of the row that tells most of them; fields and ids of all. A single row stays as it is.
    """
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.col(ordinal)))
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col(ordinal)))
    detail = F.aggregate("authors", F.lit(0), lambda n, a: n + F.size(a["affiliations"]) + F.size(a["external_ids"]))
    by = papers.where("doi is not null").groupBy("doi").agg(
        longest("title").alias("title"), longest("abstract").alias("abstract"), F.max("year").alias("year"), longest("publication_date").alias("publication_date"), first("venue").alias("venue"), first("pdf_url").alias("pdf_url"),
        F.max("citation_count").alias("citation_count"), F.max("reference_count").alias("reference_count"), F.bool_or("is_open_access").alias("is_open_access"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"),
        F.map_from_entries(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.map_entries("external_ids").alias("e")))), lambda x: x["e"]))).alias("external_ids"),
        F.max_by("authors", F.struct(detail, -F.col(ordinal))).alias("authors"), F.when(F.count("*") > 1, "merged").otherwise(F.min("source")).alias("source"),
    )
    return by.unionByName(papers.where("doi is null").select(*by.columns))


def stubs(references: DataFrame, papers: DataFrame) -> DataFrame:
    """Referenced papers (doi, title, year) that are not known, once each, marked as stubs."""
    new = references.where("doi is not null and doi <> ''").groupBy("doi").agg(F.min("title").alias("title"), F.min("year").alias("year"))
    return new.join(papers.select("doi"), "doi", "left_anti").withColumn("is_stub", F.lit(True))


def graph_papers(records: DataFrame, as_of_year: int) -> DataFrame:
    """Records in normal form as rows of the graph's papers; those without a DOI have none. A missing year is as_of_year."""
    outside = lambda *names: F.coalesce(*(F.col("external_ids")[n] for n in names))
    return records.where("doi is not null and doi <> ''").select(
        "doi", "title", F.transform("authors", lambda a: a["name"]).alias("authors"), "venue", F.coalesce("year", F.lit(as_of_year)).alias("year"), "abstract",
        outside("arxiv", "ArXiv").alias("arxiv_id"), outside("openalex", "OpenAlex").alias("openalex_id"), outside("semantic_scholar", "S2").alias("semantic_scholar_id"), "pdf_url",
    )


def paper_authors(records: DataFrame) -> DataFrame:
    """(doi, position, name, affiliations, orcid, semantic_scholar_id): the authors of records with a DOI, one row each, positions from 1 in the order of the list."""
    a = records.where("doi is not null and doi <> ''").select("doi", F.posexplode("authors").alias("i", "a"))
    outside = lambda *names: F.nullif(F.coalesce(*(F.col("a.external_ids")[n] for n in names)), F.lit(""))
    return a.select("doi", (F.col("i") + 1).alias("position"), "a.name", "a.affiliations", outside("orcid", "ORCID").alias("orcid"), outside("semantic_scholar", "s2").alias("semantic_scholar_id"))


def told_by(rows: DataFrame, c: str, known: DataFrame, place: Column) -> DataFrame:
    """rows with what known rows (c, once each, and more) tell. Rows without c tell nothing; they go by their place, as one task would get them all."""
    keyed = rows.withColumns({"__none": F.col(c).isNull(), "__key": F.coalesce(c, place)})
    return keyed.join(known.withColumn("__none", F.lit(False)).withColumnRenamed(c, "__key"), ["__none", "__key"], "left").drop("__none", "__key")


def link_authors(authors: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authors, edges): listed authors (of paper_authors()) are the known ones with their citation-index id, else with their ORCID, else new ones; edges lead from papers to them with author_position.

    New authors with one id are one; those without any id are one for each place in a list. Of a paper's places for one
    author the first counts. authors: id, name, affiliations, orcid, semantic_scholar_id; ids of new ones follow from theirs.
    """
    by = lambda rows, c, name: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(name))
    place = F.concat_ws("\x1f", "doi", F.col("position").cast("string"))
    made = F.substring(F.sha2(F.coalesce(F.concat(F.lit("s2:"), "semantic_scholar_id"), F.concat(F.lit("orcid:"), "orcid"), F.concat(F.lit("at:"), place)), 256), 1, 16)
    found = told_by(told_by(listed, "semantic_scholar_id", by(authors, "semantic_scholar_id", "id1"), place), "orcid", by(authors, "orcid", "id2"), place).withColumn("known", F.coalesce("id1", "id2"))
    own = found.where("known is null").withColumn("id", made)
    # an entry with an ORCID only is the new author with that ORCID and a citation-index id, if there is one
    told = by(own.where("semantic_scholar_id is not null"), "orcid", "id3")
    own = told_by(own, "orcid", told, place).withColumn("id", F.when(F.col("semantic_scholar_id").isNull(), F.coalesce("id3", "id")).otherwise(F.col("id")))
    first = F.min_by(F.struct("name", "affiliations"), F.struct("doi", "position"))
    new = own.groupBy("id").agg(first.alias("f"), F.max("orcid").alias("orcid"), F.max("semantic_scholar_id").alias("semantic_scholar_id"))
    rows = new.select("id", F.col("f.name").alias("name"), F.col("f.affiliations").alias("affiliations"), "orcid", "semantic_scholar_id")
    ends = found.where("known is not null").select("doi", F.col("known").alias("id"), "position").unionByName(own.select("doi", "id", "position"))
    edges = ends.groupBy(F.col("doi").alias("src"), F.col("id").alias("dst")).agg(F.min("position").alias("author_position"))
    return authors.unionByName(rows.select(*(c for c in rows.columns if c in authors.columns)), allowMissingColumns=True), edges


def populate_citations(papers: DataFrame, cites: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, cites, report) after the references (src, doi, title, year) of papers: those without a DOI are dropped, unknown ones become stubs, and every pair is an edge once.

    Citing papers that are not known link nothing. report: src, n_references, skipped_no_doi, edges_created, stubs_created
    (a stub counts for the least paper that names it). Running it again creates nothing.
    """
    known = references.join(papers.select(F.col("doi").alias("src")).distinct(), "src", "left_semi")
    good = known.where("doi is not null and doi <> ''")
    new = stubs(good.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)"))), papers)
    pairs = good.select("src", F.col("doi").alias("dst")).distinct()
    fresh = pairs.join(cites.select("src", "dst"), ["src", "dst"], "left_anti")
    count = lambda rows, name: rows.groupBy("src").agg(F.count("*").alias(name))
    named = pairs.join(new.select(F.col("doi").alias("dst")), "dst", "left_semi").groupBy("dst").agg(F.min("src").alias("src"))
    report = known.groupBy("src").agg(F.count("*").alias("n_references"), F.count_if(F.col("doi").isNull() | (F.col("doi") == "")).alias("skipped_no_doi"))
    report = report.join(count(fresh, "edges_created"), "src", "left").join(count(named, "stubs_created"), "src", "left").fillna(0, ["edges_created", "stubs_created"])
    return papers.unionByName(new.select(*(c for c in new.columns if c in papers.columns)), allowMissingColumns=True), cites.unionByName(fresh, allowMissingColumns=True), report


def stored_properties(rows: DataFrame) -> DataFrame:
    """Rows as a property store takes them: structs, maps and arrays of them as JSON text (null stays null), plain values and lists as they are."""
    nested = lambda t: "struct<" in t or "map<" in t or t == "variant" or "variant>" in t
    return rows.select(*(F.to_json(c).alias(c) if nested(t) else F.col(c) for c, t in rows.dtypes))


def loaded_properties(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of stored_properties() with the columns of schema again; JSON text that does not fit is null."""
    from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

    def value(f) -> Column:
        kind = f.dataType
        if isinstance(kind, VariantType):
            return F.try_parse_json(f.name)
        if isinstance(kind, StructType | MapType) or isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | MapType):
            return F.when(F.try_parse_json(f.name).isNotNull(), decode_json(F.col(f.name), kind.simpleString()))
        return F.col(f.name).cast(kind)

    return rows.select(*(value(f).alias(f.name) for f in StructType.fromDDL(schema) if f.name in rows.columns))


def decode_json(value: Column, schema: str) -> Column:
    """JSON text as the schema; text that was encoded as text again, up to twice more, is decoded first. Null where it does not fit."""
    once = lambda v: F.coalesce(F.when(F.trim(v).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")), v)
    return F.from_json(once(once(value)), schema)


def cache_key(source: str, operation: str, **params: Column) -> Column:
    """Non-null parameters in the order of their names; long keys are hashed."""
    parts = F.concat_ws(":", F.lit(source), F.lit(operation), *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in sorted(params.items())))
    return F.when(F.length(parts) > 200, F.concat_ws(":", F.lit(source), F.lit(operation), F.substring(F.md5(parts), 1, 16))).otherwise(parts)
