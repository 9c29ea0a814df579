"""Operator 5: quality classifier with random Fourier features, ridge scores and isotonic calibration.

Statistics of whole texts (never labels, language, source or ids) are scaled and mapped to random cosine
features, which approximate a Gaussian kernel. Every partition sums its normal equations; the sums are
added in two steps, so the driver sees a few small matrices. Scores are calibrated on labelled rows that the
ridge did not see (every third by a hash of the id), by pooling adjacent violators over score bins counted on
the cluster; where either share has no row, both steps use all of them.

Null or empty texts have the statistics of an empty text and are scored too; labels that are null, or
whose doc_id is null or unknown, teach nothing; a document with several labels counts once for each;
repeated rows are scored each for itself; other columns are ignored; without any label the score is 0.5;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, spool
from .language import held_out

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "other_punct", "high_byte", "space", "newline",
    "distinct_words", "same_as_before", "top_word", "distinct_lines", "mean_line", "byte_entropy", "symbol_words", "upper_words", "long_words", "ends_sentence",
)
COSINES = 192
WIDTH = 2.5
RIDGE = 1e-3
BINS = 2000
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # 0 letters and rest, 1 upper, 2 digit, 3 symbol, 4 other punctuation, 5 high, 6 space, 7 newline
_CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:], _CLASS[[32, 9, 13, 11, 12]], _CLASS[10] = 1, 2, 5, 6, 7
_CLASS[[ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"]] = 3
_CLASS[[ord(c) for c in "\"'(),-.:;?[]"]] = 4


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=counts, minlength=8) / n
    share = counts[counts > 0] / n
    words = data.split()
    w = max(1, len(words))
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    return [
        math.log1p(n), math.log1p(len(words)), min(30.0, (n - by[6] * n) / w), by[1], by[2], by[3], by[4], by[5], by[6], by[7],
        len(tally) / w, repeats / w, max(tally.values(), default=0) / w, len(set(lines)) / len(lines), math.log1p(n / len(lines)), float(-(share * np.log2(share)).sum()),
        min(3.0, by[3] * n / w), min(3.0, by[1] * n / w), sum(len(x) > 15 for x in words) / w, min(3.0, counts[46] / w * 10),
    ]


def features(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return id_text(documents).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weight: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        phi = math.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.turn + self.phase)
        return np.concatenate([phi, np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.array(table.column("stats").to_pylist(), np.float64).reshape(-1, len(FEATURES))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels, both ascending."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist()):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(labelled: DataFrame, cosines: int = COSINES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 5) -> Model | None:
    """labelled: stats, y (0 or 1) and calibrate (which rows are for the calibration)."""
    k = len(FEATURES)
    shares = {r["calibrate"] for r in labelled.select("calibrate").distinct().collect()}
    learn, level = (labelled.where("not calibrate"), labelled.where("calibrate")) if len(shares) == 2 else (labelled, labelled)
    got = learn.agg(F.count("*").alias("n"), *(f(F.col("stats")[i]).alias(f"{a}{i}") for i in range(k) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not got["n"]:
        return None
    rng = np.random.default_rng(seed)
    scale = np.array([got[f"s{i}"] for i in range(k)])
    model = Model(np.array([got[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / width / math.sqrt(k / 4), (k, cosines)), rng.uniform(0, 2 * math.pi, cosines))
    d = cosines + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((d, d + 1))
        for batch in batches:
            if batch.num_rows:
                phi = model.cosines(_matrix(batch))
                a += phi.T @ np.column_stack([phi, np.array(batch.column("y").to_pylist(), np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["a"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros(d * (d + 1))
        for batch in batches:
            for b in batch.column(0).to_pylist():
                a += np.frombuffer(b)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["a"])

    few = learn.mapInArrow(sums, "a binary").repartition(8).mapInArrow(added, "a binary").collect()
    a = sum(np.frombuffer(bytes(r["a"])) for r in few).reshape(d, d + 1)
    model.weight = np.linalg.solve(a[:, :d] + ridge * got["n"] * np.diag(np.r_[np.ones(d - 1), 0]) / d, a[:, d])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch))), batch.column("y")], ["raw", "y"])

    bins = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * BINS / 3)
    counted = level.mapInArrow(scored, "raw double, y double").groupBy(bins.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("w")).orderBy("x").collect()
    model.knots, model.levels = isotonic(*(np.array([float(r[c]) for r in counted]) for c in ("x", "y", "w")))
    return model


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on labels whose crc32 of the id modulo 5 is not 0, then score every document."""
    found = spool(features(documents), "stats")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("doc_id"), 5, 0))
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = fit(spool(found.join(known, "doc_id").select("stats", "y", third.alias("calibrate")), "labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(model.score(_matrix(batch)), 0, 1) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = found.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
