"""Connectors: paged record sources through the Python data source API, Atom feeds, files with pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..scratch import set_option
from .providers import provider

ATOM = "totalResults long, entry array<struct<id:string,title:string,summary:string,published:string,doi:string,author:array<struct<name:string,affiliation:string>>,category:array<struct<_term:string>>,link:array<struct<_href:string,_title:string,_rel:string>>>>"


class PagedSource(DataSource):
    """Records page by page. Options: `fetch`, a dotted name of a function (query, offset, limit) -> list of mappings;
    query, limit (records in all) and page_size. Every page is a partition, so pages are fetched in parallel and again if a task is."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "offset long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.query = options["fetch"], options.get("query", "")
        self.limit, self.page_size = int(options.get("limit", "100")), int(options.get("page_size", "25"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(0, self.limit, self.page_size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, _, function = self.fetch.rpartition(".")
        at = partition.value
        for k, record in enumerate(getattr(import_module(module), function)(self.query, at, min(self.page_size, self.limit - at))):
            yield at + k, json.dumps(record)


def records(spark: SparkSession, fetch: str, query: str, schema: str, limit: int = 100, page_size: int = 25) -> DataFrame:
    """Typed records; those that do not fit the schema are left out."""
    spark.dataSource.register(PagedSource)
    raw = spark.read.format("paged_records").options(fetch=fetch, query=query, limit=str(limit), page_size=str(page_size)).load()
    return raw.select("offset", F.from_json("record", schema).alias("r")).where("r is not null").select("offset", "r.*")


class RecordSource(DataSource):
    """Records of several providers under one query, as a batch or a stream. Options: providers (JSON: name -> dotted factory and its options), query, page_size, splits (of each provider), most (records of a provider in a batch of a stream).

    Columns are those of the schema that the reader is given, with `source`, the provider's name. Comparisons of single fields
    go to the providers that can filter by them; those on `source` rule providers out before anything is asked. Pages follow one another by
    cursor, splits and providers are read side by side.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_records"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RecordReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _RecordStream(self.options, schema)


_PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


class _Share(InputPartition):
    def __init__(self, source: str, *at):
        super().__init__((source, *at))


class _Records:
    def __init__(self, options: dict, schema: StructType):
        self.providers, self.names = json.loads(options["providers"]), schema.names

    def _provider(self, source: str):
        return provider(*self.providers[source])

    def _rows(self, source: str, records: Iterable[dict]) -> Iterator[tuple]:
        for r in records:
            yield tuple(source if c == "source" else r.get(c) for c in self.names)


class _RecordReader(_Records, DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.query, self.size, self.splits = options.get("query", ""), int(options.get("page_size", "100")), int(options.get("splits", "8"))
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        able = set.intersection(*(set(self._provider(s).fields) for s in self.providers)) if self.providers else set()
        for f in filters:
            field = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) is EqualTo and field == "source":
                self.providers = {k: v for k, v in self.providers.items() if k == f.value}
            elif type(f) is In and field == "source":
                self.providers = {k: v for k, v in self.providers.items() if k in f.value}
            elif type(f) in _PUSHED and field in able:
                self.filters.append((field, _PUSHED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Share(source, split) for source in self.providers for split in self._provider(source).splits(self.splits)] or [_Share("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source, *split = partition.value
        if not split:
            return
        asked, cursor = self._provider(source), None
        while True:
            records, cursor = asked.page(self.query, self.filters, split[0], cursor, self.size)
            yield from self._rows(source, records)
            if cursor is None:
                return


class _RecordStream(_Records, DataSourceStreamReader):
    """Offsets: how many records of each provider, by arrival, were read."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.size, self.most, self.at = int(options.get("page_size", "100")), int(options.get("most", "10000")), None

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.providers, 0)

    def latestOffset(self) -> dict:
        now = {s: self._provider(s).newest() for s in self.providers}
        if self.at is not None:
            now = {s: min(n, self.at.get(s, 0) + self.most) for s, n in now.items()}
        self.at = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for s, stop in end.items():
            begin = start.get(s, 0)
            out += [_Share(s, at, min(stop, at + self.size)) for at in range(begin, stop, self.size)]
        return out or [_Share("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source, start, stop = partition.value
        if start < stop:
            yield from self._rows(source, self._provider(source).arrived(start, stop))

    def commit(self, end: dict) -> None:
        pass


def provider_records(spark: SparkSession, providers: dict[str, tuple[str, dict]], schema: str, query: str = "", page_size: int = 100, splits: int = 8) -> DataFrame:
    """The records of all providers (name -> dotted factory and its options) that answer a query, with the columns of schema, among them `source`."""
    set_option(spark, "spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
    return spark.read.format("provider_records").schema(schema).options(providers=json.dumps(providers), query=query, page_size=str(page_size), splits=str(splits)).load()


def provider_stream(spark: SparkSession, providers: dict[str, tuple[str, dict]], schema: str, page_size: int = 100) -> DataFrame:
    """The records of all providers as they arrive; a query that starts again goes on where its checkpoint says."""
    spark.dataSource.register(RecordSource)
    return spark.readStream.format("provider_records").schema(schema).options(providers=json.dumps(providers), page_size=str(page_size)).load()


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of Atom feeds in the form that sources.papers.from_preprints takes."""
    e = feeds.select(F.explode(F.from_xml(xml, F.lit(ATOM), {"ignoreNamespace": "true"})["entry"]).alias("e"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    link = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    return e.select(
        F.regexp_extract("e.id", r"([^/]+(?:/\d{7})?)$", 1).alias("id"), squeeze(F.col("e.title")).alias("title"), squeeze(F.col("e.summary")).alias("summary"), "e.published", "e.doi", link.alias("pdf_url"),
        F.transform("e.category", lambda c: c["_term"]).alias("categories"), F.col("e.author").alias("authors"),
    )


def _paged(rows: DataFrame, to_pages: Callable[..., list[str]]) -> DataFrame:
    """(path, page_number, text, error) of rows (path and what to_pages takes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, given in zip(b.iloc[:, 0], b.iloc[:, 1]):
                try:
                    out += [(p, k + 1, t, None) for k, t in enumerate(to_pages(given))]
                except Exception as e:  # noqa: BLE001  one unreadable file is one row
                    out.append((p, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return rows.mapInPandas(run, "path string, page_number int, text string, error string")


def pages(spark: SparkSession, path: str, to_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_number, text, error) of files: to_pages is the library that reads the format."""
    return _paged(spark.read.format("binaryFile").load(path).select("path", "content"), to_pages)


def fetched_pages(urls: DataFrame, fetch: Callable[[str], bytes], to_pages: Callable[[bytes], list[str]], at_once: int = 16) -> DataFrame:
    """As pages(), of documents behind addresses (column url), each fetched once, in at_once tasks; a document that cannot be fetched or read is a row with its error."""
    one = urls.where("url is not null").select("url").distinct().repartition(at_once, "url")
    return _paged(one.select(F.col("url").alias("path"), "url"), lambda url: to_pages(fetch(url)))


def full_text(pages_: DataFrame, key: str = "path") -> DataFrame:
    """Texts of non-blank pages in order, their characters and words, and whether the file looks scanned."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("page_number", "text")))), lambda x: x["text"])
    n = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return pages_.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("text"), n.alias("chars"), F.coalesce(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))), F.lit(0)).alias("words"), ((n < 100) & (F.count("page_number") > 0)).alias("scanned"))
