"""Embedding whitening from an exact integer scatter.

Components become whole numbers x = floor(scale c) + shift. Tasks subtract the shift again, so that numbers are short, and sum the
products of z = (1, x - shift) with itself: rows, sums and cross-products in one table. Numbers are cut into limbs of 20 bits, whose products
over a block of rows are exact in doubles, and added up as Python's whole numbers of any size; a task sends each sum once, in limbs of 30
bits, and Spark adds these up per pair of dimensions. The driver gets (d + 1)(d + 2) / 2 sums, whatever the number of rows, and forms
n XtX - S St exactly (the shift drops out); only then the numbers become doubles, are divided by n squared and decomposed by eigh.

A second pass measures the covariance of what is whitened, centred within each task before multiplying and merged by means; the third gives the rows.

Edge cases: rows are dropped as `vectors.usable` says (null or non-finite components, another length than most); a null id and repeated rows stay;
components of a scatter without full rank (an eigenvalue of at most d epsilon times the largest) have a null `whitened` and do not enter `identity_error`,
which is null if none is left; `explained` is null if all vectors are equal. floor(scale c) beyond 2**62 is clipped to it. `deviation` is null where
it does not fit a long; `deviation_digits` has it always. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release
from .vectors import ROWS, floors, limb_fields, limbs, matrix, unlimbed, usable

#: Scale and offset of whole numbers, components returned.
SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: Bits of a factor within a task; limbs of a sum of products: 6 x 30 bits hold 2**40 products of 62 bits each way.
BITS, LIMBS = 20, 6
#: Blocks whose sums of products fit a long.
FLUSH = 512


class Scatter:
    """Exact sums of products of the columns of (1, y) over all rows added."""

    def __init__(self, width: int) -> None:
        self.total = np.zeros((width + 1, width + 1), object)
        self._held: dict[int, np.ndarray] = {}
        self._blocks = 0

    def add(self, y: np.ndarray) -> None:
        """Rows of longs."""
        for at in range(0, len(y), ROWS):
            block = y[at : at + ROWS]
            z = np.concatenate((np.ones((len(block), 1), np.int64), block), 1)
            top = max(int(z.max()), -int(z.min()))
            parts = []
            while top >> BITS:
                parts.append((z & ((1 << BITS) - 1)).astype(np.float64))
                z, top = z >> BITS, top >> BITS
            parts.append(z.astype(np.float64))
            for a, left in enumerate(parts):
                for b, right in enumerate(parts):
                    held = self._held.setdefault(a + b, np.zeros(self.total.shape, np.int64))
                    held += (left.T @ right).astype(np.int64)  # whole numbers of at most 52 bits
            self._blocks += 1
            if self._blocks == FLUSH:
                self.flush()

    def flush(self) -> np.ndarray:
        for place, held in self._held.items():
            self.total = self.total + (held.astype(object) << (BITS * place))
        self._held, self._blocks = {}, 0
        return self.total


def scatter(rows: DataFrame, width: int, scale: float = SCALE) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and XtX of the whole numbers floor(scale c) of all rows (v), exactly, as Python's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = Scatter(width), False
        for batch in batches:
            some = some or batch.num_rows > 0
            sums.add(floors(matrix(batch.column("v"), width), scale))
        if some:
            i, j = np.triu_indices(width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, limbs(sums.flush()[i, j], LIMBS))], names=["i", "j", *[f"l{k}" for k in range(LIMBS)]])
        release()

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), *limb_fields(LIMBS)])
    found = rows.select("v").mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).toArrow()
    z = np.zeros((width + 1, width + 1), object)
    i, j = found.column("i").to_numpy(), found.column("j").to_numpy()
    z[i, j] = z[j, i] = unlimbed([found.column(f"l{k}").to_numpy() for k in range(LIMBS)])
    return int(z[0, 0]), z[0, 1:], z[1:, 1:]


@dataclass
class Whitening:
    """What whitens: the exact n and S (of floor(scale c)), unit eigenvectors in columns and eigenvalues by falling eigenvalue, and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: float

    @property
    def known(self) -> np.ndarray:
        """Which components the scatter determines."""
        least = len(self.sums) * np.finfo(float).eps * max(self.values[0], 0) if len(self.values) else 0
        return self.values > least

    def offsets(self, values: np.ndarray) -> np.ndarray:
        """n x - S exactly: longs if they fit, else Python's whole numbers."""
        y = floors(values, self.scale)
        top = max((abs(int(s)) for s in self.sums), default=0) + self.n * int(np.abs(y).max(initial=0))
        if top < 1 << 62:
            return y * self.n - self.sums.astype(np.int64)
        return y.astype(object) * self.n - self.sums

    def project(self, offsets: np.ndarray, most: int) -> np.ndarray:
        """The whitened components; NaN where the scatter determines none."""
        k = min(most, len(self.values))
        root = np.sqrt(np.where(self.known[:k], self.values[:k], np.nan))
        return offsets.astype(np.float64) / self.n @ self.vectors[:, :k] / root


def squares(offsets: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    if offsets.dtype == object:
        return (offsets * offsets).sum(1).tolist()
    mask = (1 << 21) - 1
    parts = [offsets & mask, (offsets >> 21) & mask, offsets >> 42]
    places = [np.zeros(len(offsets), np.int64) for _ in range(5)]
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            places[a + b] += (left * right).sum(1)  # 42 bits each
    return [s0 + (s1 << 21) + (s2 << 42) + (s3 << 63) + (s4 << 84) for s0, s1, s2, s3, s4 in zip(*[p.tolist() for p in places], strict=True)]


def decomposed(n: int, sums: np.ndarray, cross: np.ndarray, scale: float = SCALE) -> Whitening:
    """Whitening of an exact scatter: doubles appear with the quotient of whole numbers, rounded once."""
    exact = n * cross - np.outer(sums, sums)
    covariance = np.array([[value / (n * n) for value in row] for row in exact.tolist()], float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[lead, np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values, sum(exact.diagonal().tolist()) / (n * n), scale)


def identity_error(rows: DataFrame, fitted: Whitening, most: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the components that are determined."""
    width, known = len(fitted.sums), np.flatnonzero(fitted.known[:most])
    k = len(known)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            values = matrix(batch.column("v"), width)
            for at in range(0, len(values), ROWS):
                w = fitted.project(fitted.offsets(values[at : at + ROWS]), most)[:, known]
                m, own = len(w), w.mean(0)
                gap, w = own - mean, w - own
                spread += w.T @ w + np.outer(gap, gap) * (n * m / (n + m))
                mean += gap * (m / (n + m))
                n += m
        if n:
            i, j = np.triu_indices(k)
            values = spread + n * np.outer(mean, mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((i, np.full(k, -1))).astype(np.int32)), pa.array(np.concatenate((j, np.arange(k))).astype(np.int32)), pa.array(np.concatenate((values[i, j], n * mean)))], names=["i", "j", "s"])
        release()

    found = rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    i, j, s = (found.column(c).to_numpy() for c in ("i", "j", "s"))
    sums, products = np.zeros(k), np.zeros((k, k))
    sums[j[i < 0]] = s[i < 0]
    products[i[i >= 0], j[i >= 0]] = s[i >= 0]
    upper = np.triu(products - np.outer(sums, sums) / fitted.n) / fitted.n
    return float(np.abs(upper - np.eye(k)).max())


def fit(rows: DataFrame, width: int, scale: float = SCALE) -> Whitening | None:
    n, sums, cross = scatter(rows, width, scale) if width else (0, None, None)
    return decomposed(n, sums, cross, scale) if n else None


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE, most: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    rows, width = usable(df, vec_id, vector)
    kind = rows.schema["i"].dataType
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, (kind, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.StringType()), strict=True)])
    fitted = fit(rows, width, scale)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    k, error = min(most, width), identity_error(rows, fitted, most)
    shares = fitted.values[:k] / fitted.trace if fitted.trace else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = part.num_rows
                offsets = fitted.offsets(matrix(part.column("v"), width))
                w = fitted.project(offsets, most).ravel()
                exact = squares(offsets)
                each = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())
                columns = [
                    part.column("i").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n)),
                    deviation.take(each),
                    pa.array(w, mask=np.isnan(w)),
                    pa.nulls(m * k, pa.float64()) if shares is None else pa.array(np.tile(shares, m)),
                    pa.nulls(m * k, pa.float64()) if error is None else pa.array(np.full(m * k, error)),
                    pa.array(list(map(str, exact))).take(each),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return rows.mapInArrow(run, schema)
