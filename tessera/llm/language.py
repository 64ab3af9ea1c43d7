"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order `ORDER` over the characters of lower-cased words with a space on
either side; histories stay within a word. N-grams are kept as sorted arrays of 64-bit hashes, one
array an order, with a column for each language of the discounted probability and of the weight
that the n-gram, as a history, leaves to the next lower order. A text goes to the language with the
lowest cross-entropy per character; the softmax of the negative cross-entropies, at a temperature
fitted on labelled texts that the counts leave out, is its score, and a text whose cross-entropy
lies beyond what those texts show for the language is not accepted.

Counts cover every labelled text that may train but one in 64, which calibrates (`most_calibrating` of these at most). Continuation
counts, discounts, probabilities and weights are worked out in Spark from all n-grams, whatever their number, so what is gathered
grows with the input. The arrays are broadcast to score with while all languages' n-grams of all orders are `most_grams` at most, which is counted
first. Beyond that nothing is dropped: the tables stay in Spark, every distinct n-gram of the texts is priced by joins with them, order by order, and a text's n-grams are
joined with their prices, the hot ones by a broadcast. Both ways give the same costs.

Edge cases: a null text, or one without a letter, is `und` with score 0; very long texts are taken
whole, in one row; repeated rows count as often as they stand; labels that are null or empty do not
train; without any labelled text everything is `und`; an empty table gives an empty result; letters are those of Unicode (category L), so
digits, number signs and Roman numeral signs are none; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, pieces, release, written

ORDER, MOST_GRAMS, MOST_CALIBRATING, UND = 5, 6_000_000, 2_000, "und"
#: Bytes of text and distinct words taken at once.
PIECE, BLOCK = 6_000_000, 20_000
#: Letters with the marks that they carry.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_M = np.uint64(0x9E3779B97F4A7C15)


def _words(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens as words between spaces, the token of each place, the bounds of each text."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(col, "")).cast(pa.large_string()))
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    words = [" ".join(["", *found, ""]) if (found := _LETTERS.findall(t)) else "" for t in coded.dictionary.to_pylist()]
    return words, coded.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters, the word of each and its place in the word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    return chars, np.repeat(np.arange(len(words)), size), np.arange(len(chars)) - np.repeat(begin, size)


def _grams(chars: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order, the ends of its n-grams and their hashes."""
    h = np.zeros(len(chars), np.uint64)
    for k in range(1, ORDER + 1):
        new = chars.copy()
        new[1:] += h[:-1] * _M
        h = new
        at = np.flatnonzero(place >= k - 1)
        yield k, at, h[at]


def _counts(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram that ends at each character but a word's first, as distinct strings, and how often each stands."""
    chars, word, place = _characters(words)
    grams, counts = [], []
    for k, at, h in _grams(chars, place):
        own = place[at] > 0 if k == ORDER else (place[at] == k - 1) & (k > 1)
        at, h = at[own], h[own]
        if len(at):
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            wide = np.zeros((len(first), ORDER), np.uint32)
            for c in range(k):
                wide[:, c] = chars[at[first] - k + 1 + c] - np.uint64(1)
            grams.append(wide.view(f"U{ORDER}")[:, 0])
            counts.append(np.bincount(inverse, weights=weights[word[at]]).astype(np.int64))
    return (np.concatenate(grams), np.concatenate(counts)) if grams else (np.zeros(0, "U1"), np.zeros(0, np.int64))


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of hashes in a sorted array: places, and whether they are there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return row, keys[row] == h


@dataclass
class Model:
    """Languages; for each order the sorted hashes, probabilities and weights; temperature and limits."""

    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    unigram: np.ndarray
    floor: float
    temperature: float = 25.0
    limits: np.ndarray | None = None

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log2 probability of each word in each language, and its predicted characters."""
        out = np.zeros((len(words), len(self.languages)))
        for k in range(0, len(words), BLOCK):
            out[k : k + BLOCK] = self._block(words[k : k + BLOCK])
        return out, np.maximum(np.fromiter(map(len, words), np.int64, len(words)) - 1, 0)

    def _block(self, words: list[str]) -> np.ndarray:
        chars, word, place = _characters(words)
        orders = [chars]
        for _ in range(1, ORDER):
            new = chars.copy()
            new[1:] += orders[-1][:-1] * _M
            orders.append(new)
        at = np.flatnonzero(place > 0)
        longest = np.minimum(place[at], ORDER - 1)
        key = np.choose(longest, [o[at] for o in orders]) ^ longest.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)  # each n-gram once
        own, reach = at[first], longest[first]
        p = np.full((len(own), len(self.languages)), self.floor) * self.unigram
        for k, (keys, alpha, _) in enumerate(self.tables):
            live = np.flatnonzero(reach >= k)
            if k:  # where the history is known: weight of the lower order
                before, known = _find(self.tables[k - 1][0], orders[k - 1][own[live] - 1])
                live = live[known]
                p[live] *= self.tables[k - 1][2][before[known]]
            row, known = _find(keys, orders[k][own[live]])
            p[live[known]] += alpha[row[known]]
        cost = -np.log2(p)
        return np.stack([np.bincount(word[at], weights=cost[which, j], minlength=len(words)) for j in range(len(self.languages))], 1) if self.languages else np.zeros((len(words), 0))

    def entropies(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, and its predicted characters."""
        words, which, bounds = _words(col)
        cost, size = self.costs(words)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        n = np.bincount(text, weights=size[which], minlength=len(bounds) - 1) if len(which) else np.zeros(len(bounds) - 1)
        total = np.stack([np.bincount(text, weights=cost[which, j], minlength=len(bounds) - 1) for j in range(cost.shape[1])], 1) if cost.shape[1] else np.zeros((len(n), 0))
        return total / np.maximum(n, 1)[:, None], n


def levels(counted: DataFrame) -> list[DataFrame]:
    """For each order from 1: l, g, n (language, n-gram, count): whole counts of the longest n-grams and of those that begin a word, of different preceding characters for the rest. counted: l, g, n."""
    out, carried = [], None
    for k in range(ORDER, 0, -1):
        own = counted.where(F.length("g") == k)
        both = own if carried is None else own.unionByName(carried)
        level = written(both.groupBy("l", "g").agg(F.sum("n").alias("n")))
        carried = level.select("l", F.substring("g", 2, ORDER).alias("g"), F.lit(1).cast("long").alias("n"))
        out.append(level)
    return out[::-1]


def smoothed(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of one order: l, g, alpha (discounted probability) and l, g, gamma (weight that a history g leaves to the next lower order), of all n-grams."""
    size = level.groupBy("l").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    once, twice = F.col("once"), F.col("twice")
    d = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
    facts = F.broadcast(size.select("l", d.alias("d")))  # a row a language
    rows = level.join(facts, "l").withColumn("c", F.expr("substring(g, 1, length(g) - 1)"))
    total = rows.groupBy("l", "c").agg(F.sum("n").alias("total"))
    alpha = written(rows.join(total, ["l", "c"]).select("l", "g", "c", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("alpha")))
    gamma = alpha.groupBy("l", "c").agg((1 - F.sum("alpha")).alias("gamma"))
    return alpha.select("l", "g", "alpha"), gamma.select("l", F.col("c").alias("g"), "gamma")


@dataclass
class Joined:
    """A model whose tables stay in Spark: alpha and gamma of each order, weights of the empty history, and what the arrays' model has."""

    languages: list[str]
    tables: list[tuple[DataFrame, DataFrame]]
    unigram: np.ndarray
    floor: float
    temperature: float = 25.0
    limits: np.ndarray | None = None

    def prices(self, grams: DataFrame) -> DataFrame:
        """g and cost (an array by language) of distinct n-grams (g): orders from the lowest, each weighted by what the history leaves and added to by what the n-gram has."""
        start = F.array(*[F.struct(F.lit(name).alias("l"), F.lit(float(self.floor * u)).alias("p")) for name, u in zip(self.languages, self.unigram, strict=True)])
        now = grams.select("g", F.explode(start).alias("s")).select("g", "s.l", "s.p")
        for k in range(1, ORDER + 1):
            fits = F.length("g") >= k
            end = F.when(fits, F.expr(f"right(g, {k})"))
            if k > 1:
                before = self.tables[k - 1][1].select(F.col("l").alias("_l"), F.col("g").alias("_h"), F.col("gamma").cast("float").cast("double").alias("_gamma"))
                now = now.join(before, (F.col("l") == F.col("_l")) & (F.expr(f"substring(right(g, {k}), 1, {k - 1})") == F.col("_h")) & fits, "left")
                now = now.select("g", "l", (F.col("p") * F.coalesce("_gamma", F.lit(1.0))).alias("p"))
            own = self.tables[k - 1][0].select(F.col("l").alias("_l"), F.col("g").alias("_g"), F.col("alpha").cast("float").cast("double").alias("_alpha"))
            now = now.join(own, (F.col("l") == F.col("_l")) & (end == F.col("_g")), "left").select("g", "l", (F.col("p") + F.coalesce("_alpha", F.lit(0.0))).alias("p"))
        row = F.array_sort(F.collect_list(F.struct("l", (-F.log2("p")).alias("cost"))))
        return now.groupBy("g").agg(F.transform(row, lambda x: x["cost"]).alias("cost"))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """key, n (predicted characters) and ce (cross-entropy by language) of texts (key, t); those without a letter have no row."""
        kind = texts.schema["key"].dataType

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    words, which, _ = _words(batch.column("t").slice(k, 1))
                    n = np.bincount(which, minlength=len(words))
                    grams, counts = _counts(words, n)
                    if len(grams):
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column("key")[k].as_py()] * len(grams), batch.column("key").type), pa.array(grams.tolist(), pa.string()), pa.array(counts)], names=["key", "g", "n"])
            release()

        found = written(texts.mapInArrow(count, T.StructType([T.StructField("key", kind), T.StructField("g", T.StringType()), T.StructField("n", T.LongType())])))
        each = written(found.groupBy("g").agg(F.count("*").alias("w")))
        priced = written(self.prices(each.select("g")).join(each, "g"))
        rows = hot_join(found, priced, "g", "w")
        sums = [F.sum(F.col("n") * F.get("cost", F.lit(k))).alias(f"s{k}") for k in range(len(self.languages))]
        total = rows.groupBy("key").agg(F.sum("n").alias("n"), *sums)
        return total.select("key", F.col("n").cast("double").alias("n"), F.array(*[F.col(f"s{k}") / F.col("n") for k in range(len(self.languages))]).alias("ce"))


def _hashes(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of one length, as in scoring."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    wide = np.array(grams, str)
    rows = wide.view(np.uint32).reshape(len(grams), -1).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = h * _M + rows[:, c]
    return h


def build(counted: DataFrame, most_grams: int = MOST_GRAMS) -> Model | Joined:
    """Interpolated Kneser-Ney tables from the longest n-grams of each language and their counts (l, g, n): as arrays, or as tables in Spark if there are more than most_grams."""
    made = [smoothed(level) for level in levels(counted)]
    sizes = [alpha.groupBy("l").count().collect() for alpha, _ in made]
    languages = sorted({r.l for rows in sizes for r in rows})
    first = {r.l: r.gamma for r in made[0][1].collect()}  # a row a language
    unigram = np.array([first.get(name, 1.0) for name in languages])
    if sum(r["count"] for rows in sizes for r in rows) > most_grams:
        letters = made[0][0].select("g").union(made[1][1].select("g")).distinct().count()
        return Joined(languages, made, unigram, 1 / (2 * letters + 100))
    tables = []

    def columns(table: pa.Table, value: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k, name in enumerate(languages):
            own = table.filter(pc.equal(table["l"], name))
            yield k, _hashes(own["g"].to_numpy()), own[value].to_numpy()

    for k in range(ORDER):
        alphas = list(columns(made[k][0].toArrow(), "alpha"))
        gammas = list(columns(made[k + 1][1].toArrow(), "gamma")) if k + 1 < ORDER else []
        keys = np.unique(np.concatenate([h for _, h, _ in [*alphas, *gammas]])) if alphas else np.zeros(0, np.uint64)
        alpha, gamma = np.zeros((len(keys), len(languages)), np.float32), np.ones((len(keys), len(languages)), np.float32)
        for to, parts in ((alpha, alphas), (gamma, gammas)):
            for lang, h, values in parts:
                to[np.searchsorted(keys, h), lang] = values
        tables.append((keys, alpha, gamma))
    return Model(languages, tables, unigram, 1 / (2 * len(tables[0][0]) + 100))


def may_train(doc_id: str = "doc_id", folds: int = 3, out: int = 1) -> Column:
    """False for held-out documents and those without an id."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % folds != out, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_grams: int = MOST_GRAMS, most_calibrating: int = MOST_CALIBRATING) -> Model | Joined:
    """Learn from labelled documents that may train; one in 64 calibrates and is not counted."""
    rows = docs.where(may_train(doc_id)).select(F.col(f"`{doc_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where("l <> '' and t is not null")
    aside = F.pmod(F.xxhash64("i"), F.lit(64)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", PIECE):
                words, which, bounds = _words(part.column("t"))
                coded = pc.dictionary_encode(part.column("l"))
                of = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(bounds))
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    n = np.bincount(which[of == k], minlength=len(words))
                    some = np.flatnonzero(n)
                    grams, counts = _counts([words[x] for x in some.tolist()], n[some])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(counts)], names=["l", "g", "n"])
        release()

    counted = written(rows.where(~aside).select("t", "l").mapInArrow(count, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n")))
    model = build(counted, most_grams)
    chosen = rows.where(aside).select("i", F.xxhash64("i", "t").alias("h"), "t", "l")
    limit = chosen.select("i", "h").distinct().orderBy("h", "i").limit(most_calibrating)
    some = chosen.join(F.broadcast(limit), ["i", "h"], "left_semi").dropDuplicates(["i", "h"])
    if isinstance(model, Joined):
        # a key of its own for each text, whatever ids say
        keyed = written(some.select(F.concat_ws("/", "i", "h").alias("key"), "t", "l"))
        some = model.entropies(keyed.select("key", "t")).join(keyed.select("key", "l"), "key").select("l", "ce", "n").toPandas()
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "t", PIECE):
                    ce, n = shared.value.entropies(part.column("t"))
                    yield pa.RecordBatch.from_arrays([part.column("l"), pa.array(ce.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["l", "ce", "n"])

        some = some.select("t", "l").mapInArrow(costs, "l string, ce array<double>, n double").toPandas()
    calibrate(model, np.array(some.ce.tolist(), float).reshape(len(some), len(model.languages)), some.n.to_numpy(), some.l.tolist())
    return model


def calibrate(model: Model, ce: np.ndarray, n: np.ndarray, labels: list[str], least: int = 20) -> None:
    """Temperature with the least log loss, and for each language the largest cross-entropy that is accepted: the mean of its own texts and four deviations more."""
    model.limits = np.full(len(model.languages), np.inf)
    if len(labels) < least or not model.languages:
        return
    at = {name: k for k, name in enumerate(model.languages)}
    known = np.array([x in at for x in labels]) & (n > 0)
    ce, y = ce[known], np.array([at[x] for x, ok in zip(labels, known, strict=True) if ok], np.int64)
    if not len(y):
        return

    def loss(t: float) -> float:
        z = -t * (ce - ce.min(1, keepdims=True))
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    model.temperature = min((2.0**k for k in range(-2, 6)), key=loss)
    for k in range(len(model.languages)):
        own = ce[(y == k) & (ce.argmin(1) == k), k]
        if len(own) >= 5:
            model.limits[k] = own.mean() + 4 * max(own.std(), 0.05)


def _told(model: Model | Joined, ce: np.ndarray, n: np.ndarray, reject: bool) -> list[pa.Array]:
    """lang_pred, score, cross_entropy and accepted of texts by their cross-entropies and predicted characters."""
    if not model.languages:
        ce, n = np.zeros((len(n), 1)), np.zeros(len(n))
    best = ce.argmin(1)
    low = ce[np.arange(len(ce)), best]
    score = np.where(n > 0, 1 / np.exp(-model.temperature * (ce - low[:, None])).sum(1), 0.0)
    fine = (n > 0) & (low <= model.limits[best] if model.languages else False)
    names = [model.languages[b] if ok else UND for b, ok in zip(best.tolist(), (fine if reject else n > 0).tolist(), strict=True)]
    return [pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(fine)]


TOLD = ["lang_pred", "score", "cross_entropy", "accepted"]


def identify(docs: DataFrame, model: Model | Joined, doc_id: str = "doc_id", text: str = "text", reject: bool = True) -> DataFrame:
    """One row a document: doc_id, lang_pred, score, cross_entropy, accepted; with reject, a text that is not accepted is `und`."""
    kept = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([kept.schema["doc_id"], *[T.StructField(c, t) for c, t in zip(TOLD, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)]])
    if isinstance(model, Joined):
        return _identified(kept, model, reject, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_told(shared.value, *shared.value.entropies(part.column("text")), reject)], names=["doc_id", *TOLD])
        release()

    return kept.mapInArrow(run, schema)


def _identified(kept: DataFrame, model: Joined, reject: bool, schema: T.StructType) -> DataFrame:
    """identify by joins: distinct texts are priced once, known by two hashes, and rows take their text's costs."""
    key = F.concat_ws("/", F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")), F.length("text"))
    rows = kept.select("doc_id", key.alias("key"), "text")
    found = written(model.entropies(rows.where("text is not null").dropDuplicates(["key"]).select("key", F.col("text").alias("t"))))
    weights = rows.groupBy("key").agg(F.count("*").alias("w"))
    every = written(weights.join(found, "key", "left").select("key", "w", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("ce", F.array(*[F.lit(0.0)] * len(model.languages))).alias("ce")))
    plain = Joined(model.languages, [], model.unigram, model.floor, model.temperature, model.limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ce = np.array(batch.column("ce").to_pylist(), float).reshape(batch.num_rows, len(plain.languages))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_told(plain, ce, batch.column("n").to_numpy(), reject)], names=["doc_id", *TOLD])

    return hot_join(rows.select("doc_id", "key"), every, "key", "w").select("doc_id", "n", "ce").mapInArrow(run, schema)


def predicted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **kw) -> DataFrame:
    """Every document's language, nothing rejected: doc_id, held_out, lang_pred, score, cross_entropy, accepted."""
    out = identify(docs, fit(docs, doc_id, text, lang, **kw), doc_id, text, reject=False)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
