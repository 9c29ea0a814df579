"""Tables that change together: a sink with two-phase commit, and the versions that it makes.

publish() stages every table under one transaction: tasks write files, which nobody reads yet, and tell the driver of
them. When all tables are staged, one small file, the manifest of the next version, is created; from then on readers see all of them,
and those that the transaction did not write as they were. If a task fails, or the driver before that, no manifest names the
staged files, so the old version stays as it was. Two publishers of one version: the second is told to try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of Arrow data after which a task begins another file.
FILE_BYTES = 256 << 20


@dataclass
class _Staged(WriterCommitMessage):
    files: list[str]
    rows: int


class VersionedTables(DataSource):
    """Write only, one table at a time into a transaction. Options: path (a URI), transaction, table."""

    @classmethod
    def name(cls) -> str:
        return "versioned_tables"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.folder = f"{options['path'].rstrip('/')}/staged/{options['transaction']}/{options['table']}"
        self.schema = schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        import pyarrow.parquet as pq

        store, root = _store(self.folder)
        files, rows, out, held = [], 0, None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(root)
                    files.append(f"{uuid.uuid4().hex}.parquet")
                    out, held = pq.ParquetWriter(store.open_output_stream(f"{root}/{files[-1]}"), batch.schema), 0
                out.write_batch(batch)
                rows, held = rows + batch.num_rows, held + batch.nbytes
                if held >= FILE_BYTES:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return _Staged(files, rows)

    def commit(self, messages: list[_Staged | None]) -> None:
        """First phase: the list of the table's files, beside them."""
        store, root = _store(self.folder)
        store.create_dir(root)
        found = [m for m in messages if m is not None]
        with store.open_output_stream(f"{root}/table.json") as f:
            f.write(json.dumps({"files": [n for m in found for n in m.files], "rows": sum(m.rows for m in found), "schema": self.schema.jsonValue()}).encode())

    def abort(self, messages: list[_Staged | None]) -> None:
        store, root = _store(self.folder)
        from pyarrow import fs

        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a folder that are there to be read, ascending."""
    at, store = _files(spark, f"{path.rstrip('/')}/versions")
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """Table -> files, rows and schema of a version, by default the latest."""
    version = version if version is not None else max(versions(spark, path), default=None)
    if version is None:
        return {}
    return json.loads(spark.read.text(f"{path.rstrip('/')}/versions/{version:08}.json", wholetext=True).first()[0])


def read(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a version, by default the latest."""
    have = manifest(spark, path, version)
    if table not in have:
        raise KeyError(f"no table {table} in {path}")
    schema = StructType.fromJson(have[table]["schema"])
    files = [f"{path.rstrip('/')}/{f}" for f in have[table]["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """The number of the new version, in which tables are as given and all others as before: all at once, or nothing."""
    spark.dataSource.register(VersionedTables)
    path, transaction, before = path.rstrip("/"), uuid.uuid4().hex, max(versions(spark, path), default=0)
    new = manifest(spark, path, before) if before else {}
    for name, df in tables.items():
        df.write.format("versioned_tables").options(path=path, transaction=transaction, table=name).mode("append").save()
        told = json.loads(spark.read.text(f"{path}/staged/{transaction}/{name}/table.json", wholetext=True).first()[0])
        new[name] = told | {"files": [f"staged/{transaction}/{name}/{f}" for f in told["files"]]}
    # second phase: created whole under another name, then given its own, which only one can have
    ready, store = _files(spark, f"{path}/versions/.{transaction}")
    final, _ = _files(spark, f"{path}/versions/{before + 1:08}.json")
    out = store.create(ready, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    claim, _ = _files(spark, f"{path}/versions/.claim-{before + 1:08}")
    try:
        store.create(claim, False).close()  # fails if there is one
    except Exception as e:
        raise RuntimeError(f"version {before + 1} is another publisher's; publish again") from e
    if not store.rename(ready, final):
        store.delete(claim, False)
        raise RuntimeError(f"version {before + 1} could not be published")
    return before + 1


def vacuum(spark: SparkSession, path: str, hold: int = 3) -> int:
    """Remove all but the last `hold` versions, and staged transactions that none of those names; the number of transactions removed. Not beside a publisher."""
    path, have = path.rstrip("/"), versions(spark, path)
    stay = {f.split("/")[1] for v in have[-hold:] for t in manifest(spark, path, v).values() for f in t["files"]}
    for v in have[:-hold]:
        at, store = _files(spark, f"{path}/versions/{v:08}.json")
        store.delete(at, False)
    at, store = _files(spark, f"{path}/staged")
    gone = [f.getPath() for f in store.listStatus(at) if f.getPath().getName() not in stay] if store.exists(at) else []
    for g in gone:
        store.delete(g, True)
    return len(gone)
