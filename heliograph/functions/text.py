"""Text operators: cleaning, section segmentation, relation cues, similarity and alias links."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..scratch import keep

# Section types, with the headings that name them (in lower case, with single spaces). An appendix may bear a letter, too.
HEADINGS = {
    "abstract": ("abstract", "summary"),
    "introduction": ("introduction", "overview"),
    "related_work": ("related work", "prior work", "literature review", "related research"),
    "background": ("background", "preliminaries", "problem statement", "problem formulation", "problem definition"),
    "methods": ("method", "methods", "methodology", "approach", "technique", "techniques", "algorithm", "framework", "model", "our approach", "our framework", "our method", "our model", "our proposed approach", "our proposed framework", "our proposed method", "our proposed model", "proposed approach", "proposed framework", "proposed method", "proposed model"),
    "experiments": ("experiment", "experiments", "experimental", "evaluation", "empirical study", "empirical evaluation", "empirical analysis", "setup", "experimental setup", "experiment setting", "experiment settings", "experiment setup", "experimental setting", "experimental settings", "experiments setting", "experiments settings", "experiments setup"),
    "results": ("result", "results", "findings", "experimental result", "experimental result analysis", "experimental result and analysis", "experimental result and discussion", "experimental result discussion", "experimental results", "experimental results analysis", "experimental results and analysis", "experimental results and discussion", "experimental results discussion", "result analysis", "result and analysis", "result and discussion", "result discussion", "results analysis", "results and analysis", "results and discussion", "results discussion"),
    "discussion": ("discussion", "analysis", "interpretation"),
    "limitations": ("limitation", "limitations", "current limitation", "current limitations", "potential limitation", "potential limitations", "weakness", "weaknesses", "potential weakness", "potential weaknesses", "threat to validity", "threats to validity", "limitation and directions", "limitation and future work", "limitations and directions", "limitations and future work"),
    "future_work": ("future work", "future direction", "future directions", "future research", "directions for future work", "directions for future research", "direction for future work", "direction for future research", "next step", "next steps", "open issue", "open issues", "open problem", "open problems", "open question", "open questions"),
    "conclusion": ("conclusion", "conclusions", "concluding remark", "concluding remarks", "summary and conclusion", "summary and conclusions", "conclusion and future work", "conclusions and future work"),
    "acknowledgments": ("acknowledgments", "acknowledgment", "acknowledgements", "acknowledgement"),
    "references": ("references", "reference", "bibliography", "literature", "cited literature"),
    "appendix": ("appendix", "appendices", "supplementary material", "supplementary information"),
}
# Section types whose headings bear no number.
UNNUMBERED = ("abstract", "acknowledgments", "references", "appendix")


def _headings() -> dict[str, str]:
    """Every heading with its type."""
    lettered = {f"appendix{gap}{letter}": "appendix" for gap in ("", " ") for letter in "abcdefghijklmnopqrstuvwxyz"}
    return lettered | {h: kind for kind, of in HEADINGS.items() for h in of}


# The lower, the likelier a section holds problems.
PRIORITY = {
    "limitations": 1, "future_work": 2, "discussion": 3, "conclusion": 4, "introduction": 5, "results": 6, "experiments": 7, "methods": 8,
    "related_work": 9, "background": 10, "abstract": 11, "unknown": 50, "acknowledgments": 99, "references": 100, "appendix": 100,
}
# Phrases that hint at a relation.
CUES = {
    "extends": ("builds on", "extends", "further explores", "advances", "expands upon", "improves upon", "enhances", "augments", "goes beyond", "taking further"),
    "contradicts": ("conflicts with", "challenges", "contrary to", "contradicts", "opposes", "in contrast to", "disputes", "refutes", "questions", "undermines"),
    "depends_on": ("requires", "prerequisite", "depends on", "relies on", "assumes", "presupposes", "contingent on", "needs", "based on", "building upon"),
    "reframes": ("redefines", "alternative view", "new perspective", "reconceptualizes", "reformulates", "recasts", "reinterprets", "different framing", "another way to view", "alternative formulation"),
    "supersedes": ("replaces", "supersedes", "obsoletes", "makes obsolete", "renders unnecessary", "subsumes", "encompasses"),
    "specializes": ("specializes", "focuses on", "narrows", "specific case of", "particular instance", "special case", "restricted to"),
    "generalizes": ("generalizes", "broader than", "extends to", "applies more broadly", "more general form", "abstracts", "wider scope"),
}
# Relation types that the graph stores.
STORED = ("extends", "contradicts", "depends_on", "reframes")


#: White space in Unicode.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def dehyphenate(text: Column) -> Column:
    """A word that a hyphen cuts at the end of a line goes on with the small letter on the next; the pattern begins with the hyphen, so nothing else in a text is tried. A letter that one match has taken does not begin another."""
    return F.regexp_replace(text, r"(?U)(?!\G)-(?<=\w-)\s*\n\s*([a-z])", "$1")


def normal_space(text: Column) -> Column:
    one = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")  # a single blank stays as it is
    lines = F.regexp_replace(one, r"\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"(?m) $", "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def nfc(text: Column) -> Column:
    """Unicode in composed form; only texts that are not plain ASCII leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def clean(text: Column, min_line: int = 3, drop: Callable[[Column], Column] | None = None) -> Column:
    """Compose accents, drop short lines (blank ones stay) and those for which drop holds, rejoin broken words, collapse white space, trim."""
    kept = nfc(text)
    if drop is not None:
        kept = F.array_join(F.filter(F.split(kept, "\n"), lambda x: ~drop(F.trim(x))), "\n")
    if min_line > 1:  # a line of 1 to min_line - 1 characters between blanks
        inner = rf"(?:[^\n]{{0,{min_line - 3}}}[^ \n])?" if min_line > 2 else ""
        kept = F.regexp_replace(kept, rf"(?md)^ *[^ \n]{inner} *(?:\n|\z)", "")
    return strip(normal_space(dehyphenate(kept)))


def section_type(line: Column) -> Column:
    """The section type that the whole line names, perhaps after a number, else null."""
    of: dict[str, list[str]] = {}
    for name, kind in _headings().items():
        of.setdefault(kind, []).append(name)

    def kind(h: Column, kinds: list[str]) -> Column:
        out = F.when(h.isin(*of[kinds[0]]), kinds[0])
        for k in kinds[1:]:
            out = out.when(h.isin(*of[k]), k)
        return out

    plain = F.regexp_replace(F.trim(line), r"\s{2,}|[^\S ]", " ")
    bare = lambda h: F.trim(F.regexp_replace(h, r"^\d+\.? ?", ""))
    numbered = lambda h: F.when(F.substring(h, 1, 1).between("0", "9"), let(bare(h), lambda x: kind(x, [k for k in of if k not in UNNUMBERED]))).otherwise(kind(h, list(of)))
    return let(F.lower(plain), numbered)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def at_least(text: Column, n: int) -> Column:
    """The text has n words or more; it is read no further than that."""
    return text.rlike(rf"(?U)^\s*(?:\S+\s+){{{n - 1}}}\S") if n > 0 else text.isNotNull()


def _starts() -> str:
    """A place where a line begins as headings do, perhaps with a number before."""
    first = sorted({h.split()[0] for h in _headings()})
    return rf"(?mdiu)^(?= *(?:\d+\.?[^\S\n]*)?(?:{'|'.join(first)})(?:[^\S\n]|$))"


def _sections(rows: DataFrame, max_heading: int, min_words: int) -> DataFrame:
    """rows (k, t) with cut, the sections of the text t as an array; a text without any long enough is one `unknown` section. The text is split where lines begin like headings, so only those are looked at closer; each step is a projection of its own, so that nothing is worked out twice."""
    none = F.array().cast("array<struct<title:string,section_type:string,start_char:int,size:int>>")
    text = F.col("t")

    def step(at: Column, piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        kind = F.when(F.length(F.trim(line)).between(1, max_heading), section_type(line))
        add = F.transform(F.array_compact(F.array(kind)), lambda k: F.struct(F.trim(line).alias("title"), k.alias("section_type"), at["at"].alias("start_char"), F.length(line).alias("size")))
        return F.struct((at["at"] + F.length(piece)).alias("at"), F.concat(at["heads"], add).alias("heads"))

    heads = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("heads")), step, lambda at: at["heads"])
    body = lambda h, end: strip(F.substring(text, h["start_char"] + h["size"] + 1, end - h["start_char"] - h["size"]))
    end = lambda i: F.coalesce(F.get("heads", i + 1)["start_char"], F.length(text))
    cut = F.transform("heads", lambda h, i: F.struct(h["section_type"].alias("section_type"), h["title"].alias("title"), body(h, end(i)).alias("content"), h["start_char"].alias("start_char")))
    whole = F.array(F.struct(F.lit("unknown").alias("section_type"), F.lit("").alias("title"), text.alias("content"), F.lit(0).alias("start_char")))
    found = rows.select("*", F.split("t", _starts()).alias("pieces")).select("*", heads.alias("heads")).select("*", F.filter(cut, lambda s: at_least(s["content"], min_words)).alias("long"))
    return found.select("*", F.when(text.isNotNull(), F.when(F.size("long") > 0, F.col("long")).otherwise(whole)).alias("cut"))


def _rows(cut: DataFrame, sections: Column, key: str) -> DataFrame:
    """A row for each section. The outer form keeps the optimizer from working every section out once more in a filter below; nulls go afterwards."""
    return cut.select(F.col("k").alias(key), F.inline_outer(sections)).where("section_type is not null")


def segment(documents: DataFrame, key: str = "doc_id", text: str = "text", max_heading: int = 100, min_words: int = 20) -> DataFrame:
    """(key, section_type, title, content, start_char): texts cut at their headings, short sections left out; a text without any is one `unknown` section.

    Every row is cut for itself, whatever its key; null texts have no section.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return _rows(_sections(rows, max_heading, min_words), F.col("cut"), key)


# How the line after an abstract begins, in lower case; a number may stand before the word.
AFTER_ABSTRACT = ("introduction", "1.", "i.")


def segment_with_abstract(documents: DataFrame, key: str = "doc_id", text: str = "text", max_heading: int = 100, min_words: int = 20) -> DataFrame:
    """As segment(), but an abstract at the very beginning that runs up to an introduction is a section of its own, and what follows it is cut."""
    word = AFTER_ABSTRACT[0]

    def follows(line: Column) -> Column:
        low = F.lower(strip(line))
        unnumbered = strip(F.ltrim(strip(F.ltrim(low, F.lit("0123456789"))), F.lit(".")))
        numbered = F.substring(low, 1, 1).between("0", "9") & F.startswith(unnumbered, F.lit(word))
        return numbered | F.exists(F.array(*map(F.lit, AFTER_ABSTRACT)), lambda m: F.startswith(low, m))

    opening = F.regexp_extract(F.col("whole"), r"(?i)^abstract\s*[:\-]?\s*", 0)
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("whole")).select("*", opening.alias("opening"))
    lines = F.when(F.col("opening") != "", F.split(F.expr("substring(whole, length(opening) + 1)"), "\n"))
    rows = rows.select("*", lines.alias("lines"))
    at = F.array_min(F.filter(F.transform("lines", lambda line, i: F.when((i > 0) & follows(line), i)), lambda i: i.isNotNull()))
    rows = rows.select("*", F.array_join(F.slice("lines", 1, at), "\n").alias("before")).select("*", strip(F.col("before")).alias("body"))
    lead = F.when(at_least(F.col("body"), min_words), F.length("opening") + F.length("before")).otherwise(0)
    rows = rows.select("k", "whole", "body", lead.alias("lead")).select("*", F.expr("substring(whole, lead + 1)").alias("t"))
    cut = _sections(rows, max_heading, min_words)
    first = F.array(F.struct(F.lit("abstract").alias("section_type"), F.lit("Abstract").alias("title"), F.col("body").alias("content"), F.lit(0).alias("start_char")))
    rest = F.transform("cut", lambda s: F.struct(s["section_type"].alias("section_type"), s["title"].alias("title"), s["content"].alias("content"), (s["start_char"] + F.col("lead")).alias("start_char")))
    return _rows(cut, F.when(F.col("lead") > 0, F.concat(first, rest)).otherwise(rest), key)


# Sections that entity extractors read.
ENTITY_SECTIONS = ("abstract", "introduction", "methods", "experiments")


def extractor_text(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the sections that entity extractors read, stripped and joined in the order of the text; empty where a text has none."""
    body = strip(F.col("content"))
    wanted = F.when(F.col("section_type").isin(*ENTITY_SECTIONS) & (body != ""), F.struct("start_char", body.alias("content")))
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(wanted)), lambda s: s["content"]), "\n\n").alias("text"))


def priority(section: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[section]


def top_sections(sections: DataFrame, key: str = "doc_id", top_n: int = 3, min_chars: int = 100) -> DataFrame:
    """Of each text its likeliest sections for problems, without references and short ones."""
    good = sections.where((F.col("section_type") != "references") & (F.length("content") >= min_chars))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(priority(F.col("section_type")), "start_char"))
    return good.withColumn("nth", nth).where(F.col("nth") <= top_n)


def cue_hits(documents: DataFrame, key: str = "doc_id", text: str = "text", around: int = 100) -> DataFrame:
    """(key, relation, cue, context): the first place of every cue in a text."""
    low = F.lower(text)
    cues = F.array(*(F.struct(F.lit(k).alias("relation"), F.lit(c).alias("cue")) for k, cs in CUES.items() for c in cs))
    hit = F.filter(cues, lambda c: low.contains(c["cue"]))
    one = documents.select(key, text, F.inline_outer(hit)).where("cue is not null")  # as in _rows()
    at = F.expr(f"instr(lower({text}), cue)")
    start = F.greatest(F.lit(1), at - around)
    return one.select(key, "relation", "cue", F.substring(F.col(text), start, F.least(F.length(text) + 1, at + F.length("cue") + around) - start).alias("context"))


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when(F.size(F.array_union(x, y)) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def share_in(a: Column, context: Column) -> Column:
    """Share of the words of a that context has."""
    x = F.array_distinct(words(F.lower(a)))
    return F.size(F.array_intersect(x, words(F.lower(context)))) / F.greatest(F.lit(1), F.size(x))


def cue_relations(documents: DataFrame, problems: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """(key, source, target, relation, confidence, evidence, ordinal) of texts and their problems (key, ordinal, statement).

    At the first place of every cue the two first problems more than `least` of whose words stand around it are related, at
    a confidence of 0.6. A context keeps the least two of its matches, so a text with many problems is no large group.
    """
    hits = cue_hits(documents, key, text).withColumn("hit", F.xxhash64(key, "relation", "cue", "context"))
    near = hits.join(problems.select(key, F.col("ordinal").alias("at"), "statement"), key).where(share_in(F.col("statement"), F.col("context")) > least)
    nth = F.row_number().over(Window.partitionBy(key, "relation", "cue", "context").orderBy("at", "statement"))
    two = near.withColumn("nth", nth).where("nth <= 2").groupBy(key, "relation", "cue", "context").agg(
        F.count("*").alias("n"), F.min_by(F.substring("statement", 1, 100), "nth").alias("source"), F.max_by(F.substring("statement", 1, 100), "nth").alias("target"))
    order = {c: i for i, c in enumerate(c for cs in CUES.values() for c in cs)}
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("cue")]
    return two.where("n = 2").select(key, "source", "target", "relation", F.lit(0.6).alias("confidence"), F.trim("context").alias("evidence"), place.alias("ordinal"))


def best_relations(relations: DataFrame, ordinal: str = "ordinal", within: list[str] = ()) -> DataFrame:
    """Of relations (of the same text, by the columns within) with the same ends (first 50 characters) and type the most confident, the first of equals."""
    k = [*within, F.substring("source", 1, 50), F.substring("target", 1, 50), F.col("relation")]
    nth = F.row_number().over(Window.partitionBy(*k).orderBy(F.col("confidence").desc(), ordinal))
    return relations.withColumn("nth", nth).where("nth = 1").drop("nth").withColumn("stored_type", F.when(F.col("relation").isin(*STORED), F.col("relation")))


def surfaces(name: Column, aliases: Column, deny: tuple[str, ...], least: int = 4) -> Column:
    """Names that may be looked for: long enough and not on the deny list."""
    all_ = F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))
    return F.filter(all_, lambda x: x.isNotNull() & (F.length(x) >= least) & ~F.lower(x).isin(*deny))


#: Words of a surface by which it is looked for; what follows them is checked then.
NGRAM = 3
_EDGE = "\x01"


def _tokens(text: Column) -> Column:
    """Runs of word characters, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def _edged(text: Column) -> Column:
    """A text in small letters with a mark at every word boundary, so that whole words are found as plain text."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit(_EDGE), F.lit(" "))), r"(?U)\b", _EDGE)


def alias_links(mentions: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    """(mention_id, entity_id): an entity of the same paper (column on) whose surface stands in the mention as whole words.

    Mentions and surfaces meet by their paper and the surface's first words, three at most, as mentions have them side by
    side. A surface of one plain word is found by that; a longer one is then looked for in the text, between word
    boundaries. Surfaces without a letter or digit meet all mentions of their paper. Case does not matter. Papers, texts and
    surfaces that are null link nothing.
    """
    m = mentions.where("text is not null").select(F.col(on).alias("paper"), "mention_id", F.col("text").alias("whole"))
    known = entities.select(F.col(on).alias("paper"), "entity_id", F.explode(F.array_distinct("surfaces")).alias("surface")).where("surface is not null and surface <> ''")
    known = known.select("paper", "entity_id", "surface", F.slice(_tokens(F.col("surface")), 1, NGRAM).alias("first"))
    known = known.select("paper", "entity_id", "surface", F.size("first").alias("n"), F.array_join("first", " ").alias("gram"))
    sizes = known.agg(F.max("n").alias("most"), F.bool_or(F.col("n") == 0).alias("bare")).first()

    def runs(n: int) -> Column:
        if n == 1:
            return F.col("tokens")
        every = F.transform(F.sequence(F.lit(1), F.size("tokens") - (n - 1)), lambda i: F.array_join(F.slice("tokens", i, n), " "))
        return F.when(F.size("tokens") >= n, every).otherwise(F.array().cast("array<string>"))

    bare = [F.array(F.lit(""))] if sizes["bare"] else []
    lists = [*bare, *map(runs, range(1, (sizes["most"] or 0) + 1))] or [F.array().cast("array<string>")]
    grams = m.select("paper", "mention_id", _tokens(F.col("whole")).alias("tokens")).select("paper", "mention_id", F.explode_outer(F.array_distinct(F.concat(*lists))).alias("gram")).where("gram is not null")  # as in _rows()
    met = keep(grams.join(known, ["paper", "gram"]).select("paper", "mention_id", "entity_id", "surface", (F.lower("surface") == F.col("gram")).alias("plain"), "n"), "met")
    sure = (F.col("n") == 1) & F.col("plain")
    edged = F.concat(F.lit(_EDGE), F.btrim(_edged(F.col("surface")), F.lit(_EDGE)), F.lit(_EDGE))
    doubtful = met.where(~sure).select("paper", "mention_id", "entity_id", edged.alias("edged")).distinct()
    checked = doubtful.join(m, ["paper", "mention_id"]).where(F.contains(_edged(F.col("whole")), F.col("edged")))
    return met.where(sure).select("mention_id", "entity_id").unionByName(checked.select("mention_id", "entity_id")).distinct()
