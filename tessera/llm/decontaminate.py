"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about `shard` bytes in a task. Its words become integer symbols; a word that no
benchmark item has can be in no match, so it ends a stretch, and stretches shorter than the
shortest window are left out of the index: all that a window could be found in is indexed. Over that stands a suffix array
by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix and suffix positions sampled by text position.
Windows whose words the shard holds are searched backward together; the rows found are located by LF steps to a sample.

Benchmark items are taken in blocks of `block_chars` characters. One block is collected and broadcast at a time, and let go before
the next; a benchmark of one block is done in one pass over the documents without a shuffle. With more, the hits of each pass
(no texts) are written, and joined to the documents by id and hash of the text in the end.

Edge cases: a null or empty text has no words and no hits; an item without words is ignored, and so
is one without an id; repeated items or rows count as they stand, with item ids as a set; an empty
benchmark leaves every document clean; a text longer than a shard is a shard of its own. Input columns named like a
result are replaced by it; clean() adds none and keeps all, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WORD, extend, flat, per_row, pieces, span_hashes, spans, written

#: Words of a window, characters of benchmark text that are broadcast at once, bytes of a shard.
WINDOW, BLOCK_CHARS, SHARD = 10, 8_000_000, 64_000_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer array, a shorter one before its extensions."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n > 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            break
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of any symbol in a prefix, one bit of the symbol a level."""

    def __init__(self, s: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (s >> bit) & 1
            ranks = np.zeros(len(s) + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, ranks, len(s) - int(ranks[-1])))
            s = np.concatenate((s[ones == 0], s[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at.copy()
        for bit, ranks, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = ranks[low], ranks[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    """Self-index of an integer sequence: 0 stands once, at its end; 1 ends a stretch; the words follow, up to `top`."""

    def __init__(self, s: np.ndarray, top: int, sample: int = 8) -> None:
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=top + 1))))
        self.ranks = WaveletMatrix(self.bwt, top)
        self.marked = order % sample == 0
        self.at = np.where(self.marked, order, -1)
        self.n = len(s)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns, one a line; from the last symbol to the first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.first[c] + self.ranks.rank(c, low[live])
            high[live] = self.first[c] + self.ranks.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: LF steps until a sampled position."""
        out, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        row = rows.copy()
        while len(live):
            done = self.marked[row]
            out[live[done]] = self.at[row[done]] + steps
            live, row = live[~done], row[~done]
            c = self.bwt[row]
            row = self.first[c] + self.ranks.rank(c, row)
            steps += 1
        return out


class Phrases:
    """The distinct windows of benchmark items as arrays of word ids, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 2) for w in _WORDS.findall(text.encode().lower())]
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(words[k : k + size]), set()).add(number[item])
        self.by_size = [(size, np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for size, w in sorted(found.items())]
        self.least = min(found, default=0)
        words = list(self.ids)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        self.hashes = np.unique(span_hashes(data, np.concatenate(([0], ends[:-1])) if words else ends, ends))


def _stretches(data: np.ndarray, offs: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """Words of a piece: starts, ends, bounds by row; and the words of its stretches with 1 after each, by place (-1 for the 1) and symbol."""
    low = LOWER[data]
    starts, ends = spans(WORD[low], offs)
    bounds = np.searchsorted(starts, offs)
    none = np.zeros(0, np.int64)
    if not len(starts) or not phrases.by_size:
        return starts, ends, bounds, none, none
    h = span_hashes(low, starts, ends)
    known = phrases.hashes[np.minimum(np.searchsorted(phrases.hashes, h), len(phrases.hashes) - 1)] == h
    a, b = spans(known, bounds)
    long = b - a >= phrases.least
    a, b = a[long], b[long]
    if not len(a):
        return starts, ends, bounds, none, none
    size = b - a + 1
    at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    inner = np.ones(len(at), bool)
    inner[np.cumsum(size) - 1] = False
    raw = low.tobytes()
    seq = np.ones(len(at), np.int64)
    seq[inner] = [phrases.ids.get(raw[x:y], 1) for x, y in zip(starts[at[inner]].tolist(), ends[at[inner]].tolist(), strict=True)]
    return starts, ends, bounds, np.where(inner, at, -1), seq


def _found(seq: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Occurrences of windows in a shard's symbols: places, lengths, numbers of windows, and for each window its items."""
    held = np.zeros(len(phrases.ids) + 2, bool)
    held[seq] = True
    index, place, length, number, of = None, [], [], [], []
    for size, patterns, items in phrases.by_size:
        own = np.flatnonzero(held[patterns].all(1))  # windows whose words the shard holds
        if not len(own):
            continue
        if index is None:
            index = FMIndex(np.append(seq[:-1], 0), len(phrases.ids) + 1)
        lo, hi = index.search(patterns[own])
        some = np.flatnonzero(hi > lo)
        n = (hi - lo)[some]
        rows = np.repeat(lo[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        place.append(index.locate(rows))
        length.append(np.full(len(rows), size))
        number.append(np.repeat(np.arange(len(some)) + len(of), n))
        of += [items[k] for k in own[some].tolist()]
    if not place:
        return *(np.zeros(0, np.int64) for _ in range(3)), of
    return np.concatenate(place), np.concatenate(length), np.concatenate(number), of


def hits(parts: list[tuple[np.ndarray, np.ndarray]], phrases: Phrases) -> Iterator[tuple[np.ndarray, ...]]:
    """For each piece (bytes, offsets) of a shard: starts, ends, bounds by row of its words, hit flag by word, (row, item) pairs."""
    cut = [_stretches(data, offs, phrases) for data, offs in parts]
    ends = np.cumsum([len(x[4]) for x in cut])
    seq = np.concatenate([x[4] for x in cut]) if cut else np.zeros(0, np.int64)
    place, length, number, of = _found(seq, phrases) if len(seq) else (*(np.zeros(0, np.int64) for _ in range(3)), [])
    order = np.argsort(place, kind="stable")
    place, length, number = place[order], length[order], number[order]
    edge = np.searchsorted(place, np.concatenate(([0], ends)))
    for k, (starts, stops, bounds, at, own) in enumerate(cut):
        mine = slice(edge[k], edge[k + 1])
        cover = np.zeros(len(starts) + 1, np.int64)
        word = at[place[mine] - (ends[k] - len(own))]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + length[mine], -1)
        doc = np.searchsorted(bounds, word, "right") - 1
        seen = np.unique(np.stack((doc, number[mine]), 1), axis=0)
        pairs = np.array(sorted({(d, i) for d, w in seen.tolist() for i in of[w]}), np.int64).reshape(-1, 2)
        yield starts, stops, bounds, np.cumsum(cover[:-1]) > 0, pairs


def _usable(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("i is not null and t is not null")


def _shards(batches: Iterator[pa.RecordBatch], text: str, shard: int) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """Pieces of about `shard` bytes together."""
    kept, size = [], 0
    for batch in batches:
        for part in pieces(batch, text):
            data, offs = flat(part.column(text))
            kept.append((part, data, offs))
            size += len(data)
            if size >= shard:
                yield kept
                kept, size = [], 0
    if kept:
        yield kept


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _runs(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["start", "end"]))


_FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("item_ids", T.ArrayType(T.StringType())), ("words", _RUNS), ("spans", _RUNS)]


def _without(col: pa.Array, cuts: pa.Array) -> pa.Array:
    """The texts without the byte ranges of each row."""
    rows = np.flatnonzero(pc.list_value_length(cuts).to_numpy(zero_copy_only=False) > 0)
    if not len(rows):
        return col
    values = col.to_pylist()
    for r in rows.tolist():
        raw, at, kept = values[r].encode(), 0, []
        for x in cuts[r].as_py():
            kept.append(raw[at : x["start"]])
            at = x["end"]
        values[r] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(values, col.type)


def _extended(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]], text: str, cleaned: bool) -> DataFrame:
    """All columns of docs and the results of run, or with `cleaned` the texts without their spans. One function does both: two in a stage take two workers a task, which stay for all later stages."""
    if not cleaned:
        return extend(docs, run, _FIELDS)

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, found in run(batches):
            yield part, [_without(part.column(text), found[-1])]

    return extend(docs, clear, [("cleaned", docs.schema[text].dataType)])


def _pass(docs: DataFrame, phrases: Phrases, text: str, shard: int, cleaned: bool = False) -> DataFrame:
    """All columns of docs (by place) and: n_words, n_hit, item_ids, words (runs of hit words), spans (their byte ranges); or cleaned."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for group in _shards(batches, text, shard):
            for (part, _, offs), (starts, ends, bounds, hit, pairs) in zip(group, hits([x[1:] for x in group], shared.value), strict=True):
                items: list[list[str]] = [[] for _ in range(part.num_rows)]
                for row, k in pairs.tolist():
                    items[row].append(shared.value.items[k])
                a, b = spans(hit, bounds)
                where = np.searchsorted(a, bounds)
                n = np.diff(where)
                first, shift = np.repeat(bounds[:-1], n), np.repeat(offs[:-1], n)
                yield part, [pa.array(np.diff(bounds)), pa.array(per_row(hit, bounds)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), _runs(a - first, b - first, where), _runs(starts[a] - shift, ends[b - 1] - shift, where)]

    return _extended(docs, run, text, cleaned)


def _merged(docs: DataFrame, found: DataFrame, text: str, cleaned: bool = False) -> DataFrame:
    """The same from the hits of several passes: found has th (of the text), item_ids and words."""
    names = docs.columns
    each = found.groupBy("th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
    joined = docs.withColumn("th", _th(text)).join(each, "th", "left").select(*names, "item_ids", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            for part in pieces(batch, text):
                data, offs = flat(part.column(text))
                low = LOWER[data]
                starts, ends = spans(WORD[low], offs)
                bounds = np.searchsorted(starts, offs)
                cover = np.zeros(len(starts) + 1, np.int64)
                for row, runs in enumerate(part.column("_hit_words").to_pylist()):
                    for r in runs or ():
                        cover[bounds[row] + r["start"]] += 1
                        cover[bounds[row] + r["end"]] -= 1
                hit = np.cumsum(cover[:-1]) > 0
                a, b = spans(hit, bounds)
                where = np.searchsorted(a, bounds)
                n = np.diff(where)
                first, shift = np.repeat(bounds[:-1], n), np.repeat(offs[:-1], n)
                items = pa.array([x or [] for x in part.column("_hit_items").to_pylist()], pa.list_(pa.string()))
                yield part, [pa.array(np.diff(bounds)), pa.array(per_row(hit, bounds)), items, _runs(a - first, b - first, where), _runs(starts[a] - shift, ends[b - 1] - shift, where)]

    out = _extended(joined.withColumnsRenamed({"item_ids": "_hit_items", "words": "_hit_words"}), run, text, cleaned)
    return out.drop("_hit_items", "_hit_words")


def _th(text: str) -> Column:
    """128 bits of a text; equal texts have equal hits, so no id is needed."""
    return F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, block_chars: int, shard: int, cleaned: bool = False) -> DataFrame:
    """docs with columns by place, and the results or cleaned."""
    usable = _usable(benchmark, item, item_text)
    total = usable.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    block = lambda k: Phrases([(r.i, r.t) for r in (usable.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else usable).collect()], window)
    if n == 1:
        return _pass(docs, block(0), text, shard, cleaned)
    found = None
    rows = docs.select(F.col(text), _th(text).alias("th"))
    for k in range(n):
        part = written(_pass(rows, block(k), text, shard).where("n_hit > 0").select("th", "item_ids", "words"))
        found = part if found is None else found.unionByName(part)
    return _merged(docs, found.dropDuplicates(), text, cleaned)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard: int = SHARD) -> DataFrame:
    """All columns of docs and: n_words, n_hit, item_ids (sorted strings), words and spans (ranges of words and bytes of hit runs)."""
    results = ["n_words", "n_hit", "item_ids", "words", "spans"]
    docs = docs.drop(*results)
    names = docs.columns
    own = docs.toDF(*[f"_{k}" for k in range(len(names))])
    return _scanned(own, benchmark, f"_{names.index(text)}", item, item_text, window, block_chars, shard).toDF(*names, *results)


def annotate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """One row a document: its id, n_words, n_hit, n_items, items_sha256, contaminated."""
    kept = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{kw.get('text', 'text')}`").cast("string").alias("text"))
    out = scan(kept, benchmark, **{k: v for k, v in kw.items() if k != "text"})
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard: int = SHARD) -> DataFrame:
    """The documents with the spans that scan() finds cut out of their texts; all columns stay, nulls too."""
    names = docs.columns
    t = f"_{names.index(text)}"
    own = docs.toDF(*[f"_{k}" for k in range(len(names))])
    cleaned = _scanned(own, benchmark, t, item, item_text, window, block_chars, shard, cleaned=True)
    return cleaned.select(*[F.col("cleaned" if c == t else c) for c in own.columns]).toDF(*names)


def digest(items: list[str]) -> str:
    """The form of items_sha256, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
