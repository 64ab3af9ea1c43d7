"""Vector code compression: product codes whose nearest entries come from a ball tree for each part position.

Components become whole numbers floor(scale c); a vector is cut into `PARTS` consecutive parts. Codebooks are learnt on all rows by
rounds of assignment and means: tasks assign their rows and send a sum for each entry and component, Spark adds these up, and the driver
gets 256 x d sums a round, whatever the number of rows.

The tree of a part position splits its entries by the median of their widest component; a ball has a whole-numbered centre and a radius
rounded up. A row first goes down to the leaf of the nearer centres, which bounds its distance. Then all rows of a block go through the tree
together: a ball is visited by those rows for which (distance to the centre, rounded down, less the radius) is not beyond the bound, rounded up. Equality visits too,
so that no tied entry is missed; the lower index wins a tie. Squared distances are exact: products of whole numbers in doubles while below 2**53, Python's
whole numbers otherwise; that of the entry found is computed again from the whole numbers themselves, and the search fails if the two differ.

Edge cases: rows are dropped as `vectors.usable` says (null or non-finite components, another length than most); of the first rows by id, nulls last,
equal ids are ordered by their vectors; with fewer than 256 rows there are as many entries; a length that PARTS does not divide makes the last part shorter (or
empty, code 00); equal entries keep the lower index; null labels are one label. floor(scale c) beyond 2**62 is clipped to it; an error or a sum of
errors that does not fit a long is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, release, written
from .vectors import ROWS, floors, limb_fields, limbs, matrix, unlimbed, usable

SCALE, PARTS, ENTRIES, ROUNDS = 1024.0, 4, 256, 4
#: Entries of a leaf; relative margin of rounded distances (a root and a conversion err by less).
LEAF, MARGIN = 16, 2.0**-50
#: Limbs of a sum of components: 3 x 30 bits hold 2**27 rows a task of 62 bits each.
LIMBS = 3


def _rows(entries: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where all squared distances between numbers of that size are exact, else as Python's."""
    return entries.astype(np.float64) if _exact(entries) else entries.astype(object)


def _exact(values: np.ndarray) -> bool:
    if not values.size:
        return True
    top = max(int(values.max()), -int(values.min()))
    return values.shape[1] * (2 * top) ** 2 < 1 << 53


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and y; both doubles or both Python's numbers."""
    if x.dtype != object:
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    out = np.empty((len(x), len(y)), object)
    for k, row in enumerate(y):
        out[:, k] = ((x - row) ** 2).sum(1)
    return out


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    members: np.ndarray  # of a leaf, ascending; else empty
    inside: tuple[Ball, ...]


class Tree:
    """A ball tree over the entries of a part position."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF) -> None:
        self.whole, self.entries, self.leaf = entries, _rows(entries), leaf
        self.root = self._ball(np.arange(len(entries)))
        self.visited = 0  # rows times leaves, for tests

    def _ball(self, members: np.ndarray) -> Ball:
        own = self.whole[members].astype(object)
        centre = np.array([c // len(own) for c in own.sum(0)], object).reshape(1, own.shape[1])
        reach = max(int(s) for s in ((own - centre) ** 2).sum(1)) if own.shape[1] else 0
        radius = float(reach) ** 0.5 * (1 + MARGIN)
        if len(members) <= self.leaf or not own.shape[1]:
            return Ball(centre, radius, members, ())
        widest = int(np.argmax([float(max(c) - min(c)) for c in own.T]))
        order = members[np.argsort(own[:, widest].astype(np.float64), kind="stable")]
        return Ball(centre, radius, members[:0], tuple(self._ball(np.sort(half)) for half in (order[: len(order) // 2], order[len(order) // 2 :])))

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Index of and exact squared distance to the nearest entry of each row of longs, the lower index of equal ones."""
        n = len(values)
        exact = _exact(values) and self.entries.dtype != object
        x = values.astype(np.float64 if exact else object)
        entries = self.entries if exact else self.whole.astype(object)
        best = np.full(n, np.inf) if exact else np.array([1 << 200] * n, object)
        index = np.full(n, len(self.whole), np.int64)

        def try_leaf(ball: Ball, at: np.ndarray) -> None:
            self.visited += len(at)
            d = _distances(x[at], entries[ball.members])
            place = np.array(d.argmin(1), np.int64) if exact else np.array([min(range(len(row)), key=row.__getitem__) for row in d], np.int64)
            low, who = d[np.arange(len(at)), place], ball.members[place]
            better = (low < best[at]) | ((low == best[at]) & (who < index[at]))
            better = better.astype(bool)
            best[at[better]], index[at[better]] = low[better], who[better]

        def to_centre(ball: Ball, at: np.ndarray) -> np.ndarray:
            return _distances(x[at], ball.centre.astype(x.dtype))[:, 0].astype(np.float64)

        def descend(ball: Ball, at: np.ndarray) -> None:
            if not len(at):
                return
            if not ball.inside:
                return try_leaf(ball, at)
            left, right = ball.inside
            nearer = to_centre(left, at) <= to_centre(right, at)
            descend(left, at[nearer])
            descend(right, at[~nearer])

        def visit(ball: Ball, at: np.ndarray) -> None:
            if not len(at):
                return
            away, bound = np.sqrt(to_centre(ball, at)), np.sqrt(best[at].astype(np.float64))
            lowest = away - ball.radius - (away + ball.radius) * MARGIN
            at = at[lowest <= bound * (1 + MARGIN)]
            if not ball.inside:
                if len(at):
                    try_leaf(ball, at)
                return
            for part in ball.inside:
                visit(part, at)

        everything = np.arange(n)
        descend(self.root, everything)
        visit(self.root, everything)
        gap = values - self.whole[index] if exact else values.astype(object) - self.whole[index].astype(object)
        found = (gap * gap).sum(1).tolist()
        if any(a != b for a, b in zip(found, best.tolist(), strict=True)):
            raise ArithmeticError("a distance found by the tree is not that of the whole numbers")
        return index, found


def bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    each = -(-width // parts)
    return [(min(k * each, width), min((k + 1) * each, width)) for k in range(parts)]


@dataclass
class Codebooks:
    """For each part position the entries, one a row, as whole numbers."""

    entries: list[np.ndarray]
    scale: float = SCALE

    def trees(self) -> list[Tree]:
        return [Tree(e) for e in self.entries]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, in decimal and parted by commas."""
        return hashlib.sha256(",".join(str(int(c)) for part in self.entries for c in part.ravel()).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for: the middle of each whole number's range."""
        return [(int(c) + 0.5) / self.scale for k, part in enumerate(self.entries) for c in part[int(code[2 * k : 2 * k + 2], 16)]]


def _means(rows: DataFrame, width: int, books: Codebooks) -> Codebooks:
    """One round: every row to its nearest entries, every entry to the floor of its rows' mean; an entry without rows stays."""
    spark, cuts = rows.sparkSession, bounds(width, len(books.entries))
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees()
        sums = [np.zeros(e.shape, object) for e in shared.value.entries]
        counts = [np.zeros(len(e), np.int64) for e in shared.value.entries]
        for batch in batches:
            values = floors(matrix(batch.column("v"), width), books.scale)
            for at in range(0, len(values), ROWS):
                for p, (a, b) in enumerate(cuts):
                    own = values[at : at + ROWS, a:b]
                    index, _ = trees[p].nearest(own)
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    own = own[order] if _exact(own) else own[order].astype(object)
                    sums[p][used] += np.add.reduceat(own, first, axis=0).astype(object)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
        for p, (total, count) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(count)
            if len(used) and total.shape[1]:
                m = total.shape[1]
                columns = [np.full(len(used) * m, p, np.int32), np.repeat(used, m).astype(np.int32), np.tile(np.arange(m, dtype=np.int32), len(used)), np.repeat(count[used], m), *limbs(total[used].ravel(), LIMBS)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "e", "c", "n", *[f"l{k}" for k in range(LIMBS)]])
        release()

    schema = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("p", "e", "c")], T.StructField("n", T.LongType()), *limb_fields(LIMBS)])
    found = rows.select("v").mapInArrow(run, schema).groupBy("p", "e", "c").agg(F.sum("n").alias("n"), *[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).toArrow()
    p, e, c, n = (found.column(name).to_numpy() for name in ("p", "e", "c", "n"))
    mean = unlimbed([found.column(f"l{k}").to_numpy() for k in range(LIMBS)]) // n.astype(object) if len(n) else np.zeros(0, object)
    entries = [book.copy() for book in books.entries]
    for k, book in enumerate(entries):
        own = p == k
        book[e[own], c[own]] = mean[own].astype(np.int64)
    return Codebooks(entries, books.scale)


def learnt(rows: DataFrame, width: int, scale: float = SCALE, parts: int = PARTS, most: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all rows (i, v); None without rows."""
    if not width:
        return None
    first = rows.select("i", "v").orderBy(F.col("i").asc_nulls_last(), "v").limit(most).collect()
    start = floors(np.array([r.v for r in first], np.float64), scale)
    books = Codebooks([start[:, a:b].copy() for a, b in bounds(width, parts)], scale)
    for _ in range(rounds):
        books = _means(rows, width, books)
    return books


def encoded(rows: DataFrame, width: int, books: Codebooks) -> DataFrame:
    """All columns of rows but v, with code and error."""
    cuts, shared = bounds(width, len(books.entries)), rows.sparkSession.sparkContext.broadcast(books)
    kept = [f for f in rows.schema.fields if f.name != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = floors(matrix(part.column("v"), width), books.scale)
                found = [tree.nearest(values[:, a:b]) for tree, (a, b) in zip(trees, cuts, strict=True)]
                digits = np.stack([index for index, _ in found], 1).astype(np.uint8).tobytes().hex()
                step = 2 * len(found)
                codes = [digits[k : k + step] for k in range(0, len(digits), step)]
                errors = [sum(each) for each in zip(*[d for _, d in found], strict=True)]
                new = [pa.array(codes, pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *new], names=[*[f.name for f in kept], "code", "error"])
        release()

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **kw) -> DataFrame:
    """One row a usable row: vec_id, code, error, label_error, codebooks_sha256."""
    rows, width = usable(df, vec_id, vector, label=label)
    kind = rows.schema["i"].dataType
    books = learnt(rows, width, **kw)
    if books is None:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", kind), *[T.StructField(c, t) for c, t in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))]]))
    key = F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = written(encoded(rows, width, books).withColumn("k", key).drop("label"))
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy("k").agg(F.when(F.count("error") == F.count("*"), exact).try_cast("long").alias("label_error"), F.count("*").alias("w"))
    found = hot_join(coded, totals, "k", "w")
    return found.select(F.col("i").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
