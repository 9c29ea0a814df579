"""Blocks of whole documents, and a way to ask of hashes held in blocks which ones occur elsewhere.

Documents are packed as they stand into blocks of a few MB (zstd), kept as a table bucketed by block, so
that verdicts on a block meet its text without moving the text again. A text that is larger than a block is cut
into parts, a block each, which overlap so that every window lies whole in the part that it begins in. A question is asked in three steps:
every block sends its distinct hashes, once each and delta-coded, to hash ranges; a range judges them; the
verdict goes back to the block as bits. A hash that a third of all rows share is one entry a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from .common import new_dir, new_table, parallelism, wide_rows
from .common import spool as keep

BLOCK_BYTES = 2 << 20
#: Bytes of text in a bucket of blocks, and how many buckets there are at most (Spark's own limit).
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 100_000
RANGE_VALUES = 1_000_000
SCHEMA = "block_id long, doc_ids array<long>, sizes array<long>, n_bytes long, body binary, doc_key long, start long, own long"
SENT = "range int, block_id long, n int, payload binary"
VERDICT = "block_id long, range int, n int, bits binary"

_MIX = 0x9E3779B97F4A7C15
_K = 0xD6E8FEB86659FD93  # odd: invertible modulo 2**64
_K_INVERSE = pow(_K, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def with_extra(ddl: str, field: str, kind: DataType) -> StructType:
    """A schema and one more field, whose type is that of the carried columns."""
    return StructType([*StructType.fromDDL(ddl), StructField(field, kind)])


def make(documents: DataFrame, normal: Callable[[bytes], tuple[bytes, int]], joint: bytes, carry: list[str], cut: Callable[[bytes, int], Iterator[tuple[int, int, bytes, int]]]) -> tuple[DataFrame, int, bool]:
    """The table of blocks, the bytes of all texts, and whether one may have parts. normal: a text's bytes -> (bytes to keep, size); empty ones are not joined into the body.

    cut: what is kept of a long text, and the bytes that a part should have -> parts as (start, own size, bytes, size with
    the overlap). A part is a block with doc_key (the same for the parts of a text), start and own. The columns in carry go
    along as they are, as one struct for each document.
    """
    spark = documents.sparkSession
    wide_rows(spark)
    extra = F.struct(*carry) if carry else F.lit(None).cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), extra.alias("extra"))
    block_bytes = BLOCK_BYTES
    total, long = rows.agg(F.sum(F.octet_length("text")), F.coalesce(F.bool_or(F.octet_length("text") > block_bytes), F.lit(False))).first()
    total = total or 0
    schema = with_extra(SCHEMA, "extras", ArrayType(rows.schema["extra"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, extras, sizes, bodies, held = [], [], [], [], 0

        def block(ids: list, sizes: list, body: bytes, extra: pa.Array, *part: int | None) -> pa.RecordBatch:
            nonlocal made
            cols = [[base + made], [ids], [sizes], [len(body)], [pack(body)], *([x] for x in part)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            more = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), extra)
            made += 1
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), more], schema.names)

        def out() -> pa.RecordBatch:
            nonlocal ids, extras, sizes, bodies, held
            now = block(ids, sizes, joint.join(bodies), pa.concat_arrays(extras), None, None, None)
            ids, extras, sizes, bodies, held = [], [], [], [], 0
            return now

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                begin = 0
                for k, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    data, size = normal((text or "").encode("utf-8", "surrogatepass"))
                    if len(data) > block_bytes:
                        if begin < k:
                            extras.append(part.column(2).slice(begin, k - begin))
                        begin, doc_key = k + 1, base + made
                        for start, own, piece, n in cut(data, block_bytes):
                            yield block([doc_id], [n], piece, part.column(2).slice(k, 1), doc_key, start, own)
                        continue
                    ids.append(doc_id)
                    sizes.append(size)
                    if data:
                        bodies.append(data)
                    held += len(data)
                    if held >= BLOCK_BYTES or len(ids) >= 100_000:
                        extras.append(part.column(2).slice(begin, k + 1 - begin))
                        begin = k + 1
                        yield out()
                if begin < part.num_rows:
                    extras.append(part.column(2).slice(begin))
        if ids:
            yield out()

    n, name = max(parallelism(spark), min(MOST_BUCKETS, math.ceil(total / BUCKET_BYTES))), new_table(spark, "blocks")
    packed = rows.mapInArrow(run, schema).repartition(n, "block_id")
    packed.write.bucketBy(n, "block_id").option("compression", "none").option("path", new_dir(spark, "blocks")).format("parquet").saveAsTable(name)
    return spark.table(name), total, long


class Rolling:
    """Hashes of spans of one block's body: a polynomial over random values of bytes, modulo 2**64, then mixed."""

    def __init__(self, body: np.ndarray):
        n = len(body)
        self.inverse = _powers(_K_INVERSE, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[body] * _powers(_K, n + 1)[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.inverse[start])

    def fixed(self, length: int) -> np.ndarray:
        n = max(0, len(self.prefix) - length)
        return mix((self.prefix[length : length + n] - self.prefix[:n]) * self.inverse[:n])


_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int, n: int) -> np.ndarray:
    have = _POWERS.get(k)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (1 << 17))
        have = np.full(size, k, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS.clear() if len(_POWERS) > 2 else None
        _POWERS[k] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def encode(values: np.ndarray, *flags: np.ndarray) -> bytes:
    """Sorted distinct values as deltas in byte planes, with bits of flags."""
    deltas = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes()
    return pack(planes + b"".join(np.packbits(f).tobytes() for f in flags))


def decode(n: int, data: bytes, flags: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(unpack(data), np.uint8)
    values = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).reshape(-1), dtype=np.uint64)
    size = -(-n // 8)
    return values, *(np.unpackbits(raw[8 * n + k * size : 8 * n + (k + 1) * size], count=n).astype(bool) for k in range(flags))


def range_cuts(values: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted 64-bit values pass from range to range."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.r_[0, np.searchsorted(values, edges), len(values)]


def ranges_for(count: float) -> int:
    return max(1, math.ceil(count / RANGE_VALUES))


def send(block_id: int, values: np.ndarray, ranges: int, *flags: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    cuts = range_cuts(values, ranges)
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a < b:
            yield k, block_id, b - a, encode(values[a:b], *(f[a:b] for f in flags))


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["range", "block_id", "n", "payload"])


def judged(sent: DataFrame, judge: Callable[..., np.ndarray], flags: int) -> DataFrame:
    """Verdicts. judge(values, owner, *flags) -> a bool for each value; owner numbers the blocks of this range."""

    def run(table: pa.Table) -> pa.Table:
        ids, ns, data = (table[c].to_pylist() for c in ("block_id", "n", "payload"))
        parts = [decode(n, d, flags) for n, d in zip(ns, data)]
        own = np.repeat(np.arange(len(ns)), ns)
        good = judge(np.concatenate([p[0] for p in parts]), own, *(np.concatenate([p[1 + k] for p in parts]) for k in range(flags)))
        cuts = np.cumsum([0, *ns])
        bits = [pack(np.packbits(good[a:b]).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"block_id": table["block_id"], "range": table["range"], "n": table["n"], "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("range").applyInArrow(run, VERDICT)


def verdict(table: pa.Table) -> np.ndarray:
    """The bools of one block, in the order of the values it sent."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("range", "n", "bits"))))
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(unpack(b), np.uint8), count=n).astype(bool) for _, n, b in rows)])


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of values, where groups start in it, and each value's group number."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(values) else np.zeros(0, bool)
    group = np.empty(len(values), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def meet(blocks: DataFrame, verdicts: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """run(block, its verdicts) for every block; only the verdicts are shuffled."""
    return blocks.groupBy("block_id").cogroup(verdicts.groupBy("block_id")).applyInArrow(run, schema)


def opened(table: pa.Table) -> tuple[int, list, pa.Array, np.ndarray, np.ndarray]:
    """block_id, doc_ids, extras, sizes and body of a block."""
    one = {c: table[c][0] for c in table.column_names}
    return one["block_id"].as_py(), one["doc_ids"].values.to_pylist(), one["extras"].values, one["sizes"].values.to_numpy(), np.frombuffer(unpack(one["body"].as_py()), np.uint8)


def finished(blocks: DataFrame, found: DataFrame, remove: Callable, part: Callable, assemble: Callable, schema: StructType, long: bool) -> DataFrame:
    """Rows of all documents: remove(block, found) makes those of whole documents; part(block, found) what assemble() makes a document of, from all its parts."""
    if not long:
        return meet(blocks, found, remove, schema)
    found = keep(found, "found")
    kind = StructType([*StructType.fromDDL(PART), StructField("extra", extra_kind(blocks))])
    parts = meet(blocks.where("doc_key is not null"), found, lambda b, f: part(b, f) if b.num_rows else _none(kind), kind)
    whole = meet(blocks.where("doc_key is null"), found, lambda b, f: remove(b, f) if b.num_rows else _none(schema), schema)
    return whole.unionByName(parts.groupBy("doc_key").applyInArrow(assemble, schema))


PART = "doc_key long, start long, doc_id long, body binary, spans array<struct<start:long,stop:long>>"


def part_row(table: pa.Table, doc_id: int | None, body: bytes, spans: list[dict], extra: pa.Array) -> pa.Table:
    """A part's own text, and the spans (in its document) that its windows remove."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({"doc_key": table["doc_key"][:1], "start": table["start"][:1], "doc_id": pa.array([doc_id], pa.int64()), "body": pa.array([body], pa.binary()), "spans": pa.array([spans], kind), "extra": extra})


def _none(schema: StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def extra_kind(blocks: DataFrame) -> DataType:
    return blocks.schema["extras"].dataType.elementType
