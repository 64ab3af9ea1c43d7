"""Quality scores by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (label 1 over label 0). The utility of a document is
linear in its features and P(a before b) is the logistic function of the difference of utilities,
so the weights minimise the logistic loss on feature differences. Features are how a text looks (classes of bytes, lengths,
repetition) and what it says: shares of its words and of its character trigrams, each hashed into `BUCKETS` buckets. The cut is the quantile of the
labelled utilities at the share of label 0, and the score puts that cut at `threshold`.

The fit takes at most `most_labelled` labelled rows, those with the smallest hashes of their ids,
and `pairs` pairs drawn from them with a fixed seed; scoring takes every whole text.

Edge cases: a null or empty text has its own feature vector (all counts 0) and is scored by it;
rows without a label or id do not train; repeated labels each count; of documents that share an id one text trains; without both labels every
score is 0.5 and every document is accepted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, extend, flat, per_row, pieces, span_hashes, spans

MOST_LABELLED, PAIRS, THRESHOLD, SEED = 20_000, 20_000, 0.3, 7
#: Looks, buckets of words and of trigrams, penalty of squared weights, and how much more those of buckets are held back.
LOOKS, BUCKETS, PENALTY, LEXICAL = 13, 128, 0.001, 30.0
#: Classes of bytes: letters of either case, digits, sentence marks, marks of stress, other marks, line ends, beyond ASCII.
_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~", b"\n\r")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_BITS = BUCKETS.bit_length() - 1
FEATURES = LOOKS + 2 * BUCKETS


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One line of features for each text."""
    rows = len(offs) - 1
    kind = _CLASS[data]
    counts = np.bincount(np.repeat(np.arange(rows, dtype=np.int32) * np.int32(9), np.diff(offs)) + kind, minlength=rows * 9).reshape(rows, 9).astype(float)
    starts, ends = spans(~SPACE[data], offs)
    bounds = np.searchsorted(starts, offs)
    n = np.diff(bounds)
    h = span_hashes(data, starts, ends)
    word_row = np.repeat(np.arange(rows), n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
    order = np.lexsort((h, word_row))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (word_row[1:] != word_row[:-1])
    distinct = np.bincount(word_row, weights=first, minlength=rows)
    words, size, letters = np.maximum(n, 1), np.maximum(np.diff(offs), 1), np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 8], 1)
    low = LOWER[data].astype(np.uint32)
    tri = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) if len(low) > 2 else low[:0]
    tri = (tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
    inner = np.repeat(np.arange(rows, dtype=np.int32), np.maximum(np.diff(offs) - 2, 0))
    at = np.flatnonzero(_within(offs, len(tri)))
    hashed = [_shares(word_row, (h >> np.uint64(64 - _BITS)).astype(np.int64), rows), _shares(inner, tri[at].astype(np.int64), rows)]
    looks = np.stack(
        [
            counts[:, 1] / letters,
            np.sqrt(counts[:, 2] / size),
            counts[:, 3] / words,
            np.sqrt(counts[:, 4] / words),
            np.sqrt(counts[:, 5] / words),
            counts[:, 6] / words,
            counts[:, 7] / size,
            counts[:, 8] / size,
            np.sqrt(per_row(again, bounds) / words),
            np.log1p(distinct) / np.log1p(words),
            np.minimum(per_row(ends - starts, bounds) / words, 40),
            np.log1p(n),
            letters / size,
        ],
        1,
    )
    return np.concatenate((looks, *hashed), 1)


def _within(offs: np.ndarray, n: int) -> np.ndarray:
    """Places at which a trigram of one text starts."""
    ok = np.ones(n, bool)
    for back in (1, 2):
        at = offs[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def _shares(row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
    """Square roots of the shares of buckets in each row."""
    n = np.bincount(row * np.int64(BUCKETS) + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    return np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1))


@dataclass
class Ranker:
    """Centre, scale and weights of the features; cut and slope of the score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        u = self.slope * (((x - self.centre) / self.scale) @ self.weights - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(u, -60, 60)))


def weight_of(n: int) -> np.ndarray:
    """How much each weight is held back."""
    return np.where(np.arange(n) < LOOKS, 1.0, LEXICAL)


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, threshold: float = THRESHOLD, penalty: float = PENALTY, block: int = 10_000) -> Ranker:
    """Weights by Newton steps on the logistic loss of feature differences, summed over blocks of pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = x.shape[1]
    if not len(good) or not len(bad):
        return Ranker(np.zeros(n), np.ones(n), np.zeros(n), float(np.log(threshold / (1 - threshold))), 1.0, threshold)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - centre) / scale
    draw = np.random.default_rng(SEED)
    a, b = draw.choice(good, pairs), draw.choice(bad, pairs)
    w, held = np.zeros(n), penalty * weight_of(n)
    for _ in range(25):
        slope, curve = -held * w, np.diag(held)
        for k in range(0, pairs, block):
            d = z[a[k : k + block]] - z[b[k : k + block]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -60, 60)))
            slope += d.T @ (1 - p) / pairs
            curve += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    u = z @ w
    s = np.sort(u)
    cut = (s[len(bad) - 1] + s[len(bad)]) / 2
    slope = 3.0 / max(1e-9, np.median(u[good]) - np.median(u[bad]))
    return Ranker(centre, scale, w, float(cut), float(2 * slope), threshold)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED, **kw) -> Ranker:
    """Learn from the labelled rows that are not held out."""
    chosen = labels.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("i is not null and y in (0, 1)")
    chosen = chosen.where(~held_out("i")).orderBy(F.xxhash64("i"), "i", "y").limit(most_labelled)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).join(F.broadcast(chosen.select("i").distinct()), "i", "left_semi")
    # of rows that share an id one learns, so that no more than most_labelled come to the driver
    rows = texts.groupBy("i").agg(F.min_by("t", F.xxhash64("t")).alias("t")).join(F.broadcast(chosen), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                x = features(*flat(part.column("t"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("y"), pa.array([row.tobytes() for row in x], pa.binary())], names=["i", "y", "x"])

    got = rows.select("i", "y", "t").mapInArrow(run, "i long, y int, x binary").toArrow().sort_by([("i", "ascending"), ("y", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, FEATURES).astype(float)
    return learn(x, got.column("y").to_numpy(), **kw)


def score(docs: DataFrame, model: Ranker, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the score of each text; a column named like it is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            for part in pieces(batch, text):
                yield part, [pa.array(model.score(features(*flat(part.column(text)))))]

    return extend(docs, run, [(name, T.DoubleType())])


def rated(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, doc_id, text, threshold=threshold, **kw)
    kept = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return score(kept, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns, whatever their names."""
    model = fit(docs, labels, doc_id, text, threshold=threshold, **kw)
    names = docs.columns
    rows = docs.toDF(*[f"_{k}" for k in range(len(names))])
    return score(rows, model, f"_{names.index(text)}", "rank").where(F.col("rank") >= threshold).drop("rank").toDF(*names)
