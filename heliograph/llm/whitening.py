"""Operator 13: embedding whitening from exact integer moments.

An entry c becomes the integer x = floor(256 c). Distinct x-vectors are found by a hash aggregate; every
partition of them multiplies slices of digits: x is split into limbs of LIMB bits, so that float64 BLAS products of
limbs are exact integers, and the products of all pairs of limbs are put together as big integers. Partial sums meet
by matrix row, so a task adds one row of them and the driver sees one matrix for each vector length, whatever the
number of vectors. With n vectors, their sums S and products G the covariance is (n G - S S') / n^2, without
any rounding before the last division: the same number that products of centred values give. It is decomposed in double
precision; where eigenvalues are so far apart that double precision loses the small ones, the basis is made
better in fixed-point integers. Rows are then projected in tasks.

Vectors that are null or hold null or non-finite entries take no part; a zero vector does. Vectors of different
length are different spaces, each with a fit of its own (the driver holds one matrix for each length), and an empty
vector has no component, so no row. 256 c outside the range of a long becomes the nearest long. Rows of one id are
different rows; copies give equal rows and count once in the fit; a null id stays null; other columns are ignored; an
empty table gives no rows. A component without variance has null `whitened` (and no part in identity_error); where
nothing varies, `explained` and `identity_error` are null too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool

SCALE = 256
LIMB = 15
#: Products of two limbs are below 2**30, so sums over this many rows stay exact in float64.
EXACT_ROWS = 1 << 23
COMPONENTS = 4
#: Bits behind the point of the fixed-point basis, and the spread of eigenvalues beyond which it is needed.
POINT = 256
SPREAD = 1e7
#: An eigenvalue below this share of the largest one is no variance.
NOTHING = 2.0**-200
#: Entries below this are projected in double precision, larger ones as integers.
PLAIN = 1 << 24

MOMENTS = "length int, line int, n long, numbers string"
RESULT = "vec_id long, component int, n long, deviation string, whitened double, explained double"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x (int64) as float64 digits, low ones first: x = sum of limbs[k] << (LIMB k). The last one has the sign."""
    out = []
    while x.size and (int(x.max()) >= 1 << LIMB or int(x.min()) < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


class Gram:
    """n, the sums and the products of integer vectors, exact."""

    def __init__(self, d: int):
        self.n, self.d, self.pending = 0, d, 0
        self.sums, self.products = np.zeros(d, object), np.zeros((d, d), object)
        self.by_limb: dict[tuple[int, int], np.ndarray] = {}
        self.line: dict[int, np.ndarray] = {}

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), EXACT_ROWS):
            part = limbs(x[at : at + EXACT_ROWS])
            for i, a in enumerate(part):
                self.line[i] = self.line.get(i, 0) + a.sum(0).astype(np.int64)
                for j in range(i, len(part)):
                    self.by_limb[i, j] = self.by_limb.get((i, j), 0) + (a.T @ part[j]).astype(np.int64)
            self.pending += len(part[0])
            if self.pending >= 1 << 32:
                self.join()
        self.n += len(x)

    def join(self) -> None:
        """What has been summed limb by limb becomes big integers."""
        for i, s in self.line.items():
            self.sums = self.sums + s.astype(object) * (1 << LIMB * i)
        for (i, j), p in self.by_limb.items():
            big = p.astype(object) * (1 << LIMB * (i + j))
            self.products = self.products + (big if i == j else big + big.T)
        self.by_limb, self.line, self.pending = {}, {}, 0


def _text(numbers) -> str:
    return ",".join(map(str, numbers))


def _big(text: str) -> np.ndarray:
    return np.array(list(map(int, text.split(","))), object)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """length, x and the rows of each run of equal lengths."""
    for batch in batches:
        length = batch.column("length").to_numpy()
        for cut in np.split(np.arange(len(length)), np.flatnonzero(length[1:] != length[:-1]) + 1) if len(length) else ():
            part = batch.slice(int(cut[0]), len(cut))
            yield int(length[cut[0]]), part.column("x").flatten().to_numpy().reshape(len(cut), -1), part


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x and length of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"), F.size("v").alias("length"))


def moments(distinct: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """n, sums and products for each length, from partial sums that meet by line of the matrix (line -1 has the sums)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, Gram] = {}
        for d, x, _ in _by_length(batches):
            of.setdefault(d, Gram(d)).add(x)
        for d, g in of.items():
            g.join()
            for line, numbers in enumerate([g.sums, *g.products], -1):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([line], pa.int32()), pa.array([g.n]), pa.array([_text(numbers)])], ["length", "line", "n", "numbers"])

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for part in parts:
            for d, line, n, text in zip(*(c.to_pylist() for c in part.columns)):
                have = total.setdefault((d, line), [0, 0])
                have[0] += n
                have[1] = have[1] + _big(text)
        rows = [(d, line, n, _text(numbers)) for (d, line), (n, numbers) in total.items()]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["length", "line", "n", "numbers"])

    met = distinct.mapInArrow(partial, MOMENTS).repartition("length", "line").mapInArrow(added, MOMENTS)
    lines: dict[int, dict[int, tuple[int, np.ndarray]]] = {}
    for r in met.collect():
        lines.setdefault(r["length"], {})[r["line"]] = r["n"], _big(r["numbers"])
    return {d: (of[-1][0], of[-1][1], np.array([of[k][1] for k in range(d)], object).reshape(d, d)) for d, of in lines.items()}


def _fixed(a: np.ndarray) -> np.ndarray:
    """Doubles as integers with POINT bits behind the point, exactly if they are not too small."""
    m, e = np.frexp(a)
    whole = np.ldexp(m, 53).astype(np.int64).astype(object)
    shift = (e - 53 + POINT).astype(object)
    return np.array([w << s if s >= 0 else w >> -s for w, s in zip(whole.ravel(), shift.ravel())], object).reshape(a.shape)


def _float(a: np.ndarray, over: int) -> np.ndarray:
    return np.array([int(v) / over for v in a.ravel()], np.float64).reshape(a.shape)


def basis(c: np.ndarray, over: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, of the matrix of integers c / over, and eigenvectors in fixed point, one a column.

    Where eigenvalues spread widely, the basis is turned again and again: in it the matrix is graded, so that plane
    rotations by ratios of its entries find what a decomposition at one scale loses.
    """
    d, one = len(c), 1 << POINT
    e, q = np.linalg.eigh(_float(c, over))
    fixed = _fixed(q[:, ::-1])
    e = np.maximum(e[::-1], 0)
    if not e[0] or e[min(COMPONENTS, d) - 1] > e[0] / SPREAD:
        return e, fixed
    for _ in range(rounds):
        fixed = (fixed * (3 * one) - fixed.dot(fixed.T.dot(fixed) >> POINT)) >> (POINT + 1)  # orthonormal again
        seen = fixed.T.dot(c.dot(fixed)) >> POINT  # over * one times the matrix in this basis
        diagonal = _float(np.diag(seen), over * one)
        turn, far = _rotations(seen, d)
        fixed = fixed.dot(turn) >> POINT
        if far < 2.0**-70:
            break
    order = np.argsort(-diagonal, kind="stable")
    return np.maximum(diagonal[order], 0), fixed[:, order]


def _rotations(a: np.ndarray, d: int) -> tuple[np.ndarray, float]:
    """A sweep of plane rotations over a symmetric matrix of integers: what they come to in fixed point, and the largest angle."""
    a, one, far = a.copy(), 1 << POINT, 0.0
    nothing = max(map(abs, np.diag(a))) >> 200
    turn = np.zeros((d, d), object)
    turn[np.arange(d), np.arange(d)] = one
    for i in range(d):
        for j in range(i + 1, d):
            if abs(a[i, j]) <= nothing or (a[i, j] * a[i, j]) << 200 <= abs(a[i, i] * a[j, j]):
                continue
            gap = (int(a[j, j]) - int(a[i, i])) << POINT
            theta = gap // (2 * int(a[i, j]))  # fixed point, any size
            root = isqrt((theta * theta) + (one << POINT))
            t = (one << POINT) // (abs(theta) + root) * (1 if theta >= 0 else -1)
            cos = (one << POINT) // isqrt((t * t) + (one << POINT))
            sin = (t * cos) >> POINT
            far = max(far, abs(sin) / one)
            for m, axes in ((a, "rows"), (a, "columns"), (turn, "columns")):
                x, y = (m[i].copy(), m[j].copy()) if axes == "rows" else (m[:, i].copy(), m[:, j].copy())
                p, r = (x * cos - y * sin) >> POINT, (x * sin + y * cos) >> POINT
                if axes == "rows":
                    m[i], m[j] = p, r
                else:
                    m[:, i], m[:, j] = p, r
    return turn, far


@dataclass
class Fit:
    """One length: n vectors with sums, the first components as integers with POINT bits, their eigenvalues, and their shares of the trace."""

    n: int
    sums: list[int]
    axes: list[list[int]]
    values: list[float]
    explained: list[float | None]

    def __post_init__(self):
        self.mean = np.array([sum(a * s for a, s in zip(axis, self.sums)) / (self.n << POINT) for axis in self.axes])  # along each axis
        self.plain = _float(np.array(self.axes, object), 1 << POINT).reshape(-1, len(self.sums))
        self.live = np.array([v > max(self.values) * NOTHING for v in self.values], bool)
        self.root = np.sqrt(np.where(self.live, self.values, 1.0))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(row, component); 0 where a component has no variance."""
        out = (x @ self.plain.T - self.mean) / self.root
        for r in np.flatnonzero(np.maximum(x.max(1), -(x.min(1) + 1)) >= PLAIN):
            y = [self.n * v - s for v, s in zip(x[r].tolist(), self.sums)]
            out[r] = [sum(a * b for a, b in zip(y, axis)) / (self.n << POINT) for axis in self.axes] / self.root
        return np.where(self.live, out, 0.0)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, as n^2 x.x - 2 n x.S + S.S."""
        small, most = int(x.max(initial=0)) < PLAIN and int(x.min(initial=0)) > -PLAIN, max(map(abs, self.sums))
        if small and most * PLAIN * len(self.sums) < 1 << 62:
            squares, cross = (x * x).sum(1).tolist(), (x @ np.array(self.sums, np.int64)).tolist()
        else:
            rows = x.tolist()
            squares, cross = [sum(v * v for v in r) for r in rows], [sum(v * s for v, s in zip(r, self.sums)) for r in rows]
        own = sum(s * s for s in self.sums)
        return [self.n * self.n * q - 2 * self.n * c + own for q, c in zip(squares, cross)]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length from distinct x-vectors (columns x and length)."""
    out = {}
    for d, (n, sums, products) in moments(distinct).items():
        c = n * products - np.outer(sums, sums)
        values, axes = basis(c, n * n)
        trace = int(np.trace(c)) / (n * n)
        axes = axes[:, :components].T
        signed = [a * (1 if a[np.abs(a).argmax()] >= 0 else -1) for a in axes]
        out[d] = Fit(n, [int(s) for s in sums], [[int(v) for v in a] for a in signed], values[:components].tolist(), [v / trace if trace else None for v in values[:components].tolist()])
    return out


def identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """For each length the largest absolute entry of the whitened vectors' covariance, less the identity. Sums are centred in each batch and merged."""
    kind, names = "length int, n long, mean array<double>, spread array<double>", ["length", "n", "mean", "spread"]

    def put(have: tuple | None, n: int, mean: np.ndarray, spread: np.ndarray) -> tuple:
        if have is None:
            return n, mean, spread
        gap, all_n = mean - have[1], have[0] + n
        return all_n, have[1] + gap * (n / all_n), have[2] + spread + np.outer(gap, gap) * (have[0] * n / all_n)

    def rows(of: dict) -> Iterator[pa.RecordBatch]:
        for d, (n, mean, spread) in of.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([spread.ravel().tolist()], pa.list_(pa.float64()))], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple] = {}
        for d, x, _ in _by_length(batches):
            w = fits[d].whiten(x)
            mean = w.mean(0)
            of[d] = put(of.get(d), len(w), mean, (w - mean).T @ (w - mean))
        yield from rows(of)

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple] = {}
        for part in parts:
            for d, n, mean, spread in zip(*(c.to_pylist() for c in part.columns)):
                of[d] = put(of.get(d), n, np.array(mean), np.array(spread).reshape(len(mean), -1))
        yield from rows(of)

    of: dict[int, tuple] = {}
    for r in distinct.mapInArrow(partial, kind).repartition("length").mapInArrow(added, kind).collect():
        of[r["length"]] = put(of.get(r["length"]), r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(len(r["mean"]), -1))
    out: dict[int, float | None] = {}
    for d, (n, _, spread) in of.items():
        live = fits[d].live
        out[d] = float(np.abs(spread[np.ix_(live, live)] / n - np.eye(live.sum())).max()) if live.any() else None
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal(38,0); null beyond that), whitened, explained and identity_error of each row that takes part and each of the first components."""
    rows = spool(vectors(embeddings), "whole-numbers")
    distinct = spool(rows.select("x", "length").distinct(), "distinct-vectors")
    fits = fit(distinct, components)
    errors = identity_errors(distinct, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            d, x, part = batch
            of, m = fits[d], part.num_rows
            k = len(of.axes)
            white = of.whiten(x)
            cells = pa.array(white.ravel(), mask=np.tile(~of.live, m))
            each = np.repeat(np.arange(m), k)
            cols = [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, of.n)), pa.array(list(map(str, of.deviation(x)))).take(pa.array(each)), cells, pa.array(of.explained * m, pa.float64()), pa.array([errors[d]] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.mapInArrow(run, f"{RESULT}, identity_error double")
    return found.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
