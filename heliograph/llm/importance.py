"""Operator 12: importance resampling towards a target distribution, over hashed word features.

Features of a text are its runs of 1 to n words, filed in buckets by crc32. A bucket's gain says how much more the
target has of it than the corpus; a document's weight is the mean gain of its features, and a draw without
replacement takes the highest weights plus Gumbel noise from the id. Long texts are cut at word boundaries
into chunks that carry the next n - 1 words: a chunk counts the features that start among its own words, so every
feature is counted once. Chunks of long texts are dealt out to tasks of their own; what they count is summed by
document. Bucket counts are summed in tasks first, so one row for each task and bucket is shuffled at most, and the
driver sees one number for each bucket.

A null text has no words. Documents without words weigh 0; those with fewer than LEAST_WORDS words are never drawn and do
not count for the size of the draw. A null doc_id has a weight but no score, is never drawn and does not count either;
rows of one doc_id are documents of their own with the same noise, and where all is equal their order is that of weight, then of
n_features, else any; other columns are ignored; an empty target is one that has nothing of any bucket; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parallelism, spool, wide_rows

BUCKETS = 10_000
WORDS_IN_RUN = 2
#: Texts of more bytes go through in chunks of so many words.
LONG_BYTES = 1 << 16
CHUNK_WORDS = 4096
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Letters, digits and all bytes beyond ASCII make words, A-Z as a-z; every other byte parts them.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def buckets_of(words: list[bytes], own: int, longest: int = WORDS_IN_RUN) -> np.ndarray:
    """Buckets of the runs of 1 to longest words that start among the first own words."""
    sums = list(map(crc32, words))
    out = [sums[:own]]
    for more in range(1, longest):
        sums = list(map(crc32, words[more:], map(crc32, repeat(b" "), sums)))  # a run is the one before, a space and a word
        out.append(sums[:own])
    return np.fromiter((x for part in out for x in part), np.uint32, sum(map(len, out))) % np.uint32(BUCKETS)


def chunks_of(words: list[bytes], size: int = CHUNK_WORDS, longest: int = WORDS_IN_RUN) -> Iterator[tuple[list[bytes], int]]:
    """Words of each chunk, with those carried over from the next one, and how many are its own."""
    for at in range(0, len(words), size):
        yield words[at : at + size + longest - 1], min(size, len(words) - at)


def chunked(documents: DataFrame) -> DataFrame:
    """row (a number of each document), doc_id, body and own (null: the whole body is a text, else so many of its words). Long texts are cut, and their chunks dealt out."""
    spark = documents.sparkSession
    wide_rows(spark)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > LONG_BYTES, F.lit(False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                row, doc_id = batch.column("row").slice(k, 1), batch.column("doc_id").slice(k, 1)
                for words, own in chunks_of(words_of(text.as_py())):
                    yield pa.RecordBatch.from_arrays([row, doc_id, pa.array([b" ".join(words)], pa.binary()), pa.array([own], pa.int32())], ["row", "doc_id", "body", "own"])
                yield pa.RecordBatch.from_arrays([row, doc_id, pa.array([b""], pa.binary()), pa.array([0], pa.int32())], ["row", "doc_id", "body", "own"])  # a text without words is a document too

    schema = "row long, doc_id long, body binary, own int"
    short = rows.where(~long).select("row", "doc_id", F.col("text").cast("binary").alias("body"), F.lit(None).cast("int").alias("own"))
    return short.unionByName(rows.where(long).mapInArrow(cut, schema).repartition(parallelism(spark)))


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Own words and buckets of each row."""
    for body, own in zip(batch.column("body").to_pylist(), batch.column("own").to_pylist()):
        words = (body or b"").translate(_WORD).split()
        n = len(words) if own is None else own
        yield n, buckets_of(words, n)


def bucket_counts(documents: DataFrame) -> np.ndarray:
    """How many features of all documents each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, found in _features(batch):
                total += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in chunked(documents.select(F.lit(None).cast("long").alias("doc_id"), "text")).select("body", "own").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, one added to each count."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(n, len(found), int(gain[found].sum())) for n, found in _features(batch)]
            cols = [batch.column("row"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (zip(*got) if got else ([], [], []))), batch.column("own").is_valid()]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_words", "n_features", "total", "part"])

    counted = chunked(documents).mapInArrow(run, "row long, doc_id long, n_words long, n_features long, total long, part boolean")
    counted = spool(counted, "weights")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "total")]
    whole = counted.where("not part").select("doc_id", "n_words", "n_features", "total")
    parts = counted.where("part").groupBy("row", "doc_id").agg(*sums).select("doc_id", "n_words", "n_features", "total")
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, nullif(n_features, 0))) div nullif(n_features, 0)"))
    return whole.unionByName(parts).select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight"))


def noise(seed: int = SEED):
    """Gumbel noise in thousandths from the hash of seed:doc_id; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    A rank is the number of documents with a higher score and the place among those of the same score. Scores are whole
    numbers within about 70 000 of zero (logarithms of counts, and noise from 32 bits), so the table of their counts is
    small whatever the corpus; only scores that reach into the draw are sorted, each for itself.
    """
    found = weights(documents, gains(bucket_counts(documents), bucket_counts(target)))
    scored = spool(found.withColumn("score", F.col("weight") + noise(seed)), "scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    over = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    higher = spool(counts.withColumn("higher", F.coalesce(F.sum("n").over(over), F.lit(0))), "score-counts")
    draw = percent * (higher.agg(F.sum("n")).first()[0] or 0) // 100
    reach = higher.where(F.col("higher") < draw).select("score", "higher")
    nth = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", F.desc("weight"), F.desc("n_features")))
    lowest = reach.agg(F.min("score")).first()[0]
    inside = able & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    drawn = scored.where(inside).withColumn("nth", nth).join(F.broadcast(reach), "score").withColumn("rank", F.col("higher") + F.col("nth"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank")
    rest = scored.where(~F.coalesce(inside, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*columns, rank).unionByName(rest)
