"""Operator 3: SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set if over half of a document's shingle hashes have it. Fingerprints are grouped
first, so copies are one row. Each 64-bit fingerprint is cut into s segments (three, or two where there are
so many fingerprints that values of short segments crowd); if two fingerprints differ in at most r bits, then
some segment differs in at most r//s of them (the later segments in one less, by the remainder). Small
Hamming balls of each segment are enumerated and looked up by an equi-join, and whole distances are verified.

Pairs are never written: while there are classes with a fingerprint near one of another class, each joins
the least class that it is near to (a minimum, taken within the tasks of the join), so that a round at least
halves the classes that are still apart, and a crowd of near copies costs one row a class.

Null or empty texts have fingerprint zero and link like any other; rows with equal doc_ids stand each for
itself; a null doc_id never names a component unless all of it are null; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, spool

SEED = 42
#: Segments of a fingerprint as (lowest bit, width), by their number.
SEGMENTS = {2: ((0, 32), (32, 32)), 3: ((0, 21), (21, 21), (42, 22))}
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = 4) -> list[int]:
    """XXH64 of each run of size words (all words if fewer); words part at ASCII white space, A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list. Bits are summed eight at a time in the bytes of a word, 255 hashes at most."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
    if not len(flat):
        return out
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(hashes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = (np.cumsum(sizes) - sizes)[owner] + 255 * nth
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    full = owner[first]
    for bit in range(8):
        sums = np.add.reduceat((flat >> np.uint64(bit)) & _LANES, at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(documents: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                fp = majority_bits([shingle_hashes(t, size) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return id_text(documents).mapInArrow(run, "doc_id long, fp long")


def balls(radius: int, segments: int) -> list[tuple[int, list[int]]]:
    """For each segment the differences to enumerate, within the segment."""
    out = []
    for k, (_, width) in enumerate(SEGMENTS[segments]):
        r = radius // segments - (k > radius % segments)
        out.append((k, [sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(width), n)]))
    return out


def segments_for(count: int, radius: int) -> int:
    """The cheaper number of segments: probes of a fingerprint, each with the entries that chance puts under one value."""
    cost = lambda s: sum(len(m) for _, m in balls(radius, s)) * (8 + count / (1 << min(w for _, w in SEGMENTS[s])))
    return min(SEGMENTS, key=cost)


def matches(nodes: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """(a, b, class_a, class_b) of fingerprints (fp, class) that differ in 1 to radius bits and have different classes; once or more."""
    cut = lambda masks: F.array(*(
        F.struct(F.lit(k).alias("segment"), F.lit(at).alias("at"), F.lit((1 << width) - 1).cast("long").alias("ones"), F.lit(flip).cast("long").alias("flip"))
        for k, (at, width) in enumerate(SEGMENTS[segments]) for flip in masks[k]
    ))
    value = F.expr("(shiftrightunsigned(fp, p.at) & p.ones) ^ p.flip").alias("value")
    look = nodes.withColumn("p", F.explode(cut([m for _, m in balls(radius, segments)]))).select(F.col("fp").alias("a"), F.col("class").alias("class_a"), "p.segment", value)
    index = nodes.withColumn("p", F.explode(cut([[0]] * segments))).select(F.col("fp").alias("b"), F.col("class").alias("class_b"), "p.segment", value)
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (F.col("class_a") != F.col("class_b"))
    return look.join(index, ["segment", "value"]).where(near).select("a", "b", "class_a", "class_b")


def trees(choice: DataFrame, label: str = "trees") -> DataFrame:
    """(node, root) of nodes that each chose their least neighbour (node, parent): two that chose each other are a root, and the others follow their parents up, twice as far in each round."""
    up = choice.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    mutual = (F.col("above") == F.col("node")) & (F.col("node") < F.col("parent"))
    now = spool(choice.join(up, "parent").select("node", F.when(mutual, F.col("node")).otherwise(F.col("parent")).alias("parent")), label)
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        after = spool(now.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), label)
        now = after.select("node", "parent")
        if after.where("moved").isEmpty():
            return now.withColumnRenamed("parent", "root")


def classes(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, class) of the fingerprints (fp) that have another within radius: equal classes for those connected by such steps."""
    segments = segments_for(nodes.count(), radius)
    now, alone = nodes.select("fp", F.col("fp").alias("class")), True
    while True:
        found = matches(now, radius, segments).groupBy(F.col("class_a").alias("node")).agg(F.min("class_b").alias("parent"))
        choice = spool(found, "links")
        if choice.isEmpty():
            return now.limit(0) if alone else now
        root = trees(choice).withColumnRenamed("node", "class")
        # whatever is near to nothing in the first round never will be
        joined = now.join(root, "class", "inner" if alone else "left")
        now, alone = spool(joined.select("fp", F.coalesce("root", "class").alias("class")), "classes"), False


def near_duplicates(documents: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of those connected) of every row."""
    fps = spool(fingerprints(documents, size), "fingerprints")
    nodes = spool(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    members = classes(nodes.select("fp"), radius)
    names = members.join(nodes, "fp").groupBy("class").agg(F.min("first_id").alias("component_id"))
    named = members.join(names, "class").select("fp", "component_id")
    found = spool(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "named")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
