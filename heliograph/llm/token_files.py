"""Operator 8: token ids in Arrow files of equal-length sequences with masks.

Documents are range-partitioned by doc_id; each task writes Arrow IPC files of bounded size whose record batches hold
fixed-size lists (ids and mask), so any sequence is a slice of a memory-mapped buffer, and beside each a second one
with the documents of the file. Files are read back a record batch at a time, whatever the store. Ids are 16 bits wide where the tokenizer's vocabulary allows, else 32; an
id that does not fit is an error. A task attempt writes
files of its own and only those named in the manifest count, so retries and lost executors do no harm.

Null or empty texts are one end token; rows with null doc_ids come first; rows with equal doc_ids follow
each other by text; other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, new_dir, parallelism, spool
from .tokens import encoder

#: Ids after which a task begins another file; a document is never cut.
FILE_TOKENS = 64 << 20
MANIFEST = "part int, nth int, path string, docs_path string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def id_kind(vocab_size: int, end_id: int) -> tuple[str, pa.DataType]:
    """How ids are stored: as narrow as every id of the vocabulary and the end token allow."""
    return ("<u2", pa.uint16()) if max(vocab_size, end_id + 1) <= 1 << 16 else ("<u4", pa.uint32())


def narrowed(ids: bytes, dtype: str) -> np.ndarray:
    """Ids (little-endian unsigned 32-bit) as dtype; raises on one that does not fit."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) > np.iinfo(dtype).max:
        raise ValueError(f"token id {int(wide.max())} does not fit {dtype}")
    return wide.astype(dtype)


def write(documents: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 2, seq_len: int = 1024, batch_sequences: int = 256) -> DataFrame:
    """Write the files; gives the manifest, one row per file in the order of doc_id."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        dtype, kind = id_kind(enc.vocab_size, end_id)
        schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root)
        nth, name, sink, writer = 0, "", None, None
        doc_ids, starts, lengths, held, held_n, total = [], [], [], [], 0, 0

        def put(last: bool) -> None:
            nonlocal held, held_n
            flat = np.concatenate(held) if held else np.empty(0, dtype)
            n = -(-len(flat) // seq_len) if last else len(flat) // (seq_len * batch_sequences) * batch_sequences
            whole, rest = flat[: n * seq_len], flat[n * seq_len :]
            mask = np.ones(n * seq_len, dtype=bool)
            mask[len(whole) :] = False
            whole = np.concatenate([whole, np.zeros(n * seq_len - len(whole), dtype)])
            for at in range(0, n, batch_sequences):
                cut = slice(at * seq_len, min(n, at + batch_sequences) * seq_len)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), seq_len) for x in (whole, mask)]
                writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))
            held, held_n = [rest], len(rest)

        def begin() -> None:
            nonlocal name, sink, writer
            name = f"{root}/part-{part:06d}-{nth:04d}-{uuid.uuid4().hex}"
            sink = store.open_output_stream(f"{name}.arrow")
            writer = pa.ipc.new_file(sink, schema)

        def finish() -> pa.RecordBatch:
            nonlocal nth, writer, doc_ids, starts, lengths, held, held_n, total
            put(True)
            writer.close()
            sink.close()
            with store.open_output_stream(f"{name}.docs.arrow") as f, pa.ipc.new_file(f, DOCS) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], schema=DOCS))
            row = {"part": [part], "nth": [nth], "path": [f"{name}.arrow"], "docs_path": [f"{name}.docs.arrow"], "n_docs": [len(doc_ids)], "n_tokens": [total]}
            nth, writer = nth + 1, None
            doc_ids, starts, lengths, held, held_n, total = [], [], [], [], 0, 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("docs_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                for doc_id, ids in zip(piece.column(0).to_pylist(), enc.encode([t or "" for t in piece.column(1).to_pylist()])):
                    if writer is None:
                        begin()
                    ids = narrowed(ids + end, dtype)
                    doc_ids.append(doc_id)
                    starts.append(total)
                    lengths.append(len(ids))
                    held.append(ids)
                    held_n += len(ids)
                    total += len(ids)
                    if total >= FILE_TOKENS:
                        yield finish()
                if held_n >= seq_len * batch_sequences:
                    put(False)
        if writer is not None:
            yield finish()

    spark = documents.sparkSession
    ordered = id_text(documents).repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return spool(ordered.mapInArrow(run, MANIFEST), "manifest").orderBy("part", "nth")


def read(spark: SparkSession, out_dir: str, manifest: DataFrame, seq_len: int = 1024) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids (little-endian unsigned 32-bit), read back from the files."""
    files, base = [], 0
    for r in manifest.select("part", "path", "docs_path", "n_tokens").toLocalIterator():  # one row per file
        files.append((r["path"], r["docs_path"], base))
        base += r["n_tokens"]
    listed = spark.createDataFrame(files, "path string, docs_path string, base long").repartition(max(1, len(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(out_dir)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for path, docs_path, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                source = pa.memory_map(path) if local else store.open_input_file(path)
                reader = pa.ipc.open_file(source)
                opened: dict[int, np.ndarray] = {}

                def values(b: int, reader: pa.ipc.RecordBatchFileReader = reader, opened: dict[int, np.ndarray] = opened) -> np.ndarray:
                    """The ids of one record batch; the last that was asked for stays."""
                    if b not in opened:
                        opened.clear()
                        opened[b] = reader.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True)
                    return opened[b]

                size = max(1, len(values(0)))  # of every batch but the last
                docs = pa.ipc.open_file(store.open_input_file(docs_path)).read_all()
                ids, kept, held = [], 0, 0
                starts, lengths = docs["start"].to_numpy(), docs["n_tokens"].to_numpy()

                def out(lo: int, hi: int, ids: list) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([docs["doc_id"].slice(lo, hi - lo).combine_chunks(), pa.array(starts[lo:hi] + base), pa.array(lengths[lo:hi]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

                for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
                    parts = []
                    while n:
                        b, at = divmod(s, size)
                        cut = values(b)[at : at + n]
                        parts.append(cut.astype("<u4").tobytes())
                        s, n = s + len(cut), n - len(cut)
                    ids.append(b"".join(parts))
                    held += len(ids[-1])
                    if held > 8 << 20:
                        yield out(kept, k + 1, ids)
                        ids, kept, held = [], k + 1, 0
                if ids:
                    yield out(kept, len(starts), ids)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def export(documents: DataFrame, tokenizer_path: str, end_id: int = 2, seq_len: int = 1024) -> DataFrame:
    """Write documents to new files in the shared folder and read them back."""
    spark = documents.sparkSession
    out_dir = new_dir(spark, "tokens")
    return read(spark, out_dir, write(documents, tokenizer_path, out_dir, end_id, seq_len), seq_len)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
