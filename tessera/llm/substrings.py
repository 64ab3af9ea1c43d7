"""Exact substring dedup: every byte covered by a 50-byte string that also starts in a document with a smaller id goes.

Equal strings are found by column-wise construction of a suffix array over many short documents at once
(`insertion`): each round inserts the next symbol of every document, from its last to its first. The symbol goes into the collection's
Burrows-Wheeler transform at the place of the document's suffix; its rank there, counted in one sequential
pass, is the place of the longer suffix, which a second sequential pass inserts; and the
common prefixes of what was inserted, and of what stands after it, are brought up to date. Two passes read and write
files from front to back; files of over `block` entries are external (unlinked scratch files of one task, made
again if it runs again). In the end strings that agree stand next to each other with common prefixes of their whole length.

The documents of the construction are fragments, so there are at most 84 rounds, whatever the longest text.
Every 50-byte string is dealt by its anchor, the leftmost of its 16-byte substrings with the
smallest hash: equal strings have equal anchors. Strings in a row with equal anchors form one fragment, of at most `MOST` strings.
First only anchors' hashes are dealt, and those in one document alone are put aside; then
the fragments of the others. The bytes of fragments that a piece of the corpus holds more than once are dealt
once, and the others as references, so a passage in any share of the documents comes to a task once a piece. Equal
fragments are one document of the construction, with the ids of all its copies; it is marked as repeated, and its strings are classes even where no other fragment has them (where none may have any of them, the first string stands for all). A fragment that is not
repeated needs no construction if no other has its anchor, or none of its strings has a hash that another string has. What goes is what the construction finds: without it nothing is removed.

The corpus is first packed into compressed pieces in the shared folder, `LOT` of them a lot, whose names tie the steps together. Anchors are dealt
to shelves of up to `SHELF` buckets: a lot and a shelf exchange one row, as a split and a partition of Spark's do one block, and what a shelf holds
is settled bucket by bucket. So rows between the steps are few however many pieces and buckets there are.

Edge cases: a null text is empty; a text shorter than 50 bytes loses nothing; rows with equal ids
are one document for the comparison but keep rows of their own; a row without an id comes before all others;
very long texts form pieces of their own; text of a short period, one byte over and over say, makes no more fragments than any other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, partitions, pieces, release, span_hashes, spans, written

#: Bytes of a string and of an anchor; strings of a fragment; bytes of a piece of the corpus; text bytes for each bucket of anchors; entries of a file that are read at once.
LENGTH, ANCHOR, MOST, PIECE, BUCKET, BLOCK = 50, 16, 35, 2_000_000, 2_500_000, 4_000_000
#: Bytes of a collection that one construction takes, unless a single anchor has more: its files then fit a processor's cache.
COLLECTION = 150_000
#: Pieces of a lot (255 at most), buckets of a shelf, lots or shelves that a task takes in turn: tasks grow with the input.
LOT, SHELF, TURN = 8, 8, 8
#: No symbol: no UTF-8 text has this byte.
NONE = 255
#: Level of compression of what is dealt, bits of a place in a packed hash.
LEVEL = 6
_PLACE = 28
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


_PRESS, _EXPAND = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, len(a)))], np.int64).tobytes()
    return _PRESS.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int32, np.uint32, np.int64, np.uint64)}


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = _EXPAND.decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for k in range(n):
        kind, size = _KINDS[int(head[2 * k])], int(head[2 * k + 1])
        out.append(np.frombuffer(raw, kind, size, at))
        at += kind.itemsize * size
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest of three kinds."""
    return next((x.astype(k) for k in (np.uint8, np.int32) if not len(x) or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max)), x)


def _runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> bytes:
    """Pieces, places in order, as differences, and sizes."""
    no, start, size = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((start, no))
    return _pack(no[order].astype(np.uint8), _small(np.diff(start[order], prepend=0)), _small(size[order]))


def _unruns(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    no, start, size = _unpack(raw)
    return no, np.cumsum(start, dtype=np.int64), size.astype(np.int64)


def fragments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with the same anchor: hash of the anchor, place of the first string, number of strings."""
    n, width = len(data), length - anchor + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < length:
        return none
    eight = np.ndarray(n - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    m = n - anchor + 1
    g = eight[:m] * _C1
    for at in range(8, anchor, 8):
        g ^= g >> np.uint64(29)
        g += eight[at : at + m] * _C2
    g *= _C3
    g ^= g >> np.uint64(32)
    low = (g >> np.uint64(_PLACE) << np.uint64(_PLACE)) | (np.arange(m, dtype=np.uint64) & np.uint64((1 << _PLACE) - 1))
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    whole = np.ones(len(low), bool)  # strings within one text
    for k in np.flatnonzero(np.diff(offs) > 0).tolist():
        end = int(offs[k + 1])
        whole[max(int(offs[k]), end - length + 1) : end] = False
    place = low & np.uint64((1 << _PLACE) - 1)
    new = np.ones(len(low), bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stops = np.flatnonzero((new | ~whole)[1:]) + 1
    stops = np.append(stops, len(low))
    count = stops[np.searchsorted(stops, first, "right")] - first
    where = place[first].astype(np.int64)
    if m > 1 << _PLACE:  # places beyond the packed bits
        where += (first - where + (1 << _PLACE) - 1) // (1 << _PLACE) * (1 << _PLACE)
    return _evened(g[where], first, count)


def _evened(h: np.ndarray, first: np.ndarray, count: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments in a row with one anchor (text of a short period has many) joined, and cut to `most` strings."""
    if not len(h):
        return h, first, count
    begins = np.ones(len(h), bool)
    begins[1:] = (h[1:] != h[:-1]) | (first[1:] != first[:-1] + count[:-1])
    at = np.flatnonzero(begins)
    h, first, count = h[at], first[at], np.add.reduceat(count, at)
    parts = -(-count // most)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    h, first, count = (np.repeat(x, parts) for x in (h, first, count))
    return h, first + k * most, np.minimum(count - k * most, most)


def _scratch(n: int, kind: type, in_memory: int) -> np.ndarray:
    """An array in memory, or in an unlinked file that goes with its last reference."""
    if n <= in_memory:
        return np.empty(n, kind)
    file = tempfile.TemporaryFile()
    file.truncate(n * np.dtype(kind).itemsize)
    return np.memmap(file, kind, "r+", shape=(n,))


def _common(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes two places of a text agree in, `most` at the most: eight at a time."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 0
    while len(live):
        x = eight[a[live] + step] ^ eight[b[live] + step]
        same = (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)  # trailing bytes that are zero
        out[live] = step + np.where(x == 0, 8, same)
        step += 8
        live = live[(x == 0) & (step < most[live])]
    return np.minimum(out, most)


#: An entry of a collection's file: where the suffix starts, then a byte each for the symbol before it, its common prefix with the entry before, and its length.
_SYMBOL, _PREFIX, _LEFT = (np.uint64(x) for x in (16, 8, 0))
_START, _BYTE = np.uint64(24), np.uint64(255)
#: Which byte of an entry in memory is its symbol.
_SYMBOL_AT = 2 if np.little_endian else 5


def insertion(text: np.ndarray, at: np.ndarray, size: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix order of documents of at most 255 bytes that stand one after the other in a text: start of each suffix (the empty ones first), the symbol before it (NONE at a document's start) and the common prefix with the suffix before it, `length` at most.

    Equal suffixes are in order of their documents."""
    m, whole, end = len(at), len(at) + int(size.sum()), at + size
    eight = np.ndarray(len(text), "<u8", np.concatenate((text, np.zeros(8, np.uint8))), strides=(1,))
    old, new = (_scratch(whole, np.uint64, block) for _ in range(2))
    n, blank = m, np.uint64(NONE) << _SYMBOL
    old[:n] = end.astype(np.uint64) << _START | blank
    docs, place, hist = np.arange(m), np.arange(m), np.zeros(256, np.int64)
    for column in range(1, int(size.max()) + 1 if m else 1):
        live = size[docs] >= column
        docs, place = docs[live], place[live]  # places rise
        start = end[docs] - column
        symbol = text[start]
        # first pass: the symbols enter the transform and are ranked
        rank, before = np.empty(len(docs), np.int64), np.zeros(256, np.int64)
        entry = (symbol.astype(np.uint64) ^ np.uint64(NONE)) << _SYMBOL  # what makes NONE the symbol
        for low in range(0, n, block):
            high = min(n, low + block)
            own = slice(*np.searchsorted(place, (low, high)))
            old[place[own]] ^= entry[own]
            part = old[low:high].view(np.uint8)[_SYMBOL_AT::8].copy()
            order = np.argsort(part, kind="stable")
            ranked = np.empty(high - low, np.int32)
            ranked[order] = np.arange(high - low, dtype=np.int32)
            count = np.bincount(part, minlength=256)
            rank[own] = (before - (np.cumsum(count) - count))[symbol[own]] + ranked[place[own] - low]
            before += count
        hist += np.bincount(symbol, minlength=256)
        to = (m + np.cumsum(hist) - hist)[symbol] + rank
        order = np.argsort(to)
        docs, place, start = docs[order], to[order], start[order]
        # second pass: the longer suffixes are inserted
        after = place - np.arange(len(place))  # entries of the old file before each
        entry = start.astype(np.uint64) << _START | blank | np.uint64(column)
        for low in range(0, n, block):
            high = min(n, low + block)
            own = slice(np.searchsorted(after, low, "left" if low == 0 else "right"), np.searchsorted(after, high, "right"))
            first = low + own.start
            mine = place[own] - first
            kept = np.ones(high - low + len(mine), bool)
            kept[mine] = False
            out = new[first : first + len(kept)]
            out[kept] = old[low:high]
            out[mine] = entry[own]
        n += len(place)
        old, new = new, old
        # common prefixes of what is new and of what stands after it
        follow = place + 1
        follow = follow[np.append(follow[:-1] != place[1:], follow[-1:] < n)]
        changed = np.concatenate((place, follow))
        changed = changed[changed > m]
        a, b = old[changed - 1], old[changed]
        least = np.minimum(np.minimum(a & _BYTE, b & _BYTE).astype(np.int64), length)
        common = _common(eight, (a >> _START).astype(np.int64), (b >> _START).astype(np.int64), least)
        old[changed] = (b & ~(_BYTE << _PREFIX)) | common.astype(np.uint64) << _PREFIX
    old = old[:n]
    return (old >> _START).astype(np.int64), (old >> _SYMBOL).astype(np.uint8), (old >> _PREFIX).astype(np.uint8)


def classes(text: np.ndarray, at: np.ndarray, size: np.ndarray, length: int = LENGTH, block: int = BLOCK, repeated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the strings of documents that equal another, or that stand in a repeated document (one of several copies), in order, and the class of each (from 0, rising): neighbours in suffix order with common prefixes of the whole length."""
    start, _, common = insertion(text, at, size, length, block)
    same = np.append(common >= length, False)
    told = same[:-1] | same[1:]
    if repeated is not None and len(start):
        doc = np.minimum(np.searchsorted(at, start, "right") - 1, len(at) - 1)
        told |= repeated[doc] & (at[doc] + size[doc] - start >= length)
    some = np.flatnonzero(told)
    return start[some], np.cumsum(~same[some]) - 1


def sieved(text: np.ndarray, at: np.ndarray, n: np.ndarray, some: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of some fragments (places, numbers of strings) those with a string whose 64-bit hash another string has too: the others share nothing, and need no construction."""
    own = n[some]
    start = np.repeat(at[some] - np.cumsum(own) + own, own) + np.arange(own.sum())
    _, which, count = np.unique(span_hashes(text, start, start + length), return_inverse=True, return_counts=True)
    return some[np.unique(np.repeat(np.arange(len(some)), own)[count[which] > 1])]


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def distinct(text: np.ndarray, at: np.ndarray, size: np.ndarray, block: int = 50_000) -> np.ndarray:
    """A number for each fragment; equal numbers have equal bytes. Fragments are sorted by a hash of eight-byte words and each is compared with the one before."""
    eight = np.ndarray(max(0, len(text) - 7), "<u8", np.ascontiguousarray(text), strides=(1,))
    h = size.astype(np.uint64) * _C3
    for step in range(0, int(size.min()) - 7 if len(size) else 0, 8):
        h = (h ^ (h >> np.uint64(29))) * _C1 + eight[at + step]
    h = (h ^ (h >> np.uint64(29))) * _C2 + eight[at + size - 8]
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (size[order][1:] == size[order][:-1])
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), block):
        own = pairs[k : k + block]
        n = size[order[own]]
        differs = _gather(text, at[order[own]], n) != _gather(text, at[order[own - 1]], n)
        same[own] = np.diff(np.concatenate(([0], np.cumsum(differs)))[np.concatenate(([0], np.cumsum(n)))]) == 0
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(~same) - 1
    return group


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The corpus in pieces: name of the lot, number in it and blob (ids, whether an id is null, offsets, bytes), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, no = uuid.uuid4().hex, 0
        for batch in batches:
            for part in pieces(batch, "t", PIECE):
                if no == LOT:
                    lot, no = uuid.uuid4().hex, 0
                data, offs = flat(part.column("t"))
                ids = part.column("i")
                blob = _pack(ids.fill_null(-(2**63)).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), offs, data)
                yield pa.RecordBatch.from_arrays([pa.array([lot]), pa.array([no], pa.int32()), pa.array([blob], pa.binary()), pa.array([len(data)], pa.int64())], names=["lot", "no", "blob", "n"])
                no += 1

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return written(rows.mapInArrow(run, "lot string, no int, blob binary, n long"))


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    for v, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        yield v, rows


def _grouped(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows with equal values of a column that they are sorted by."""
    key, rows = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            if rows and row[name] != key:
                yield key, rows
                rows = []
                release()
            key = row[name]
            rows.append(row)
    if rows:
        yield key, rows
    del rows
    release()


def _dealt(df: DataFrame, run: Callable, schema: str, by: str, tasks: int) -> DataFrame:
    return df.repartition(max(partitions(df.sparkSession), tasks), by).sortWithinPartitions(by).mapInArrow(run, schema)


def _turns(rows: np.ndarray, anchor: np.ndarray, size: np.ndarray, most: int = COLLECTION) -> Iterator[np.ndarray]:
    """Rows in collections of about `most` bytes, no anchor in two of them: equal strings have equal anchors."""
    order = np.argsort(anchor, kind="stable")
    rows, anchor, total = rows[order], anchor[order], np.cumsum(size[order])
    edges = np.concatenate((np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(rows)])) if len(rows) else []
    begin = filled = 0
    for end in np.asarray(edges, np.int64).tolist():
        if total[end - 1] - filled >= most or end == len(rows):
            yield rows[begin:end]
            begin, filled = end, total[end - 1]


def _settled(own: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, data: np.ndarray, copy_of: np.ndarray, copy_own: np.ndarray, copy_first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's fragments, whose bytes stand one after the other, and of copies of them (row, document, place): the runs of bytes to remove, as the row (copies behind fragments), the place in its piece and the size.

    Equal fragments are one document of the construction, which knows if it is repeated; a string goes from those of its documents that are not the smallest of its class."""
    size = count + length - 1
    at = np.cumsum(size) - size
    group = distinct(data, at, size)
    rep = np.unique(group, return_index=True)[1]
    group = np.concatenate((group, group[copy_of]))
    own, first = np.concatenate((own, copy_own)), np.concatenate((first, copy_first))
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, group, own)
    lead = own == low[group]
    repeated = np.zeros(len(rep), bool)
    repeated[group[~lead]] = True
    n = count[rep]
    ends = np.cumsum(n)
    begins = ends - n
    gone, seen = np.zeros(int(ends[-1]), bool), np.zeros(int(ends[-1]), bool)  # strings of distinct fragments: of the smallest documents, of the others
    # the construction is for fragments that may share strings with others of their anchor, and for repeated ones: of those that share none
    # the first string stands for all, as their documents agree in the whole fragment
    _, which, several = np.unique(anchor[rep], return_inverse=True, return_counts=True)
    mixed = np.zeros(len(rep), bool)
    mixed[sieved(data, at[rep], n, np.flatnonzero(several[which] > 1), length)] = True
    alone = repeated & ~mixed
    taken = np.where(alone, length, size[rep])
    # collections of either kind by themselves: the second end after `length` rounds
    for part in chain.from_iterable(_turns(x, anchor[rep[x]], taken[x]) for x in (np.flatnonzero(mixed), np.flatnonzero(alone))):
        sizes = taken[part]
        places = np.cumsum(sizes) - sizes
        start, cls = classes(_gather(data, at[rep[part]], sizes), places, sizes, length, repeated=repeated[part])
        if len(start):
            doc = np.searchsorted(places, start, "right") - 1
            ids = low[part[doc]]
            least = np.minimum.reduceat(ids, np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))))
            string = begins[part[doc]] + start - places[doc]
            gone[string] = ids > least[cls]
            seen[string] = True
    whole = np.where(alone, seen[begins], np.logical_and.reduceat(seen, begins))
    by = np.argsort(group, kind="stable")
    by = by[lead[by]]
    edge = np.searchsorted(group[by], np.arange(len(rep) + 1))
    a, b = spans(gone, np.concatenate(([0], ends)))
    frag = np.searchsorted(ends, a, "right")
    each = np.diff(edge)[frag]
    run = np.repeat(np.arange(len(a)), each)
    row = by[np.repeat(edge[frag] - np.cumsum(each) + each, each) + np.arange(each.sum())]
    # a document that is not the smallest with its fragment loses what the construction has found of it: all of it
    rest = np.flatnonzero(~lead & whole[group])
    start = np.concatenate((first[row] + (a - begins[frag])[run], first[rest]))
    return np.concatenate((row, rest)), start, np.concatenate(((b - a)[run], n[group[rest]])) + length - 1


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The packed corpus, and for its lots the pieces, places and sizes of runs of bytes to remove (lot, blob)."""
    corpus = packed(docs, doc_id, text)
    total = corpus.agg(F.sum("n")).first()[0] or 0
    shelves = max(2 * partitions(docs.sparkSession), -(-total // (SHELF * bucket)), 1)
    subs = max(1, min(SHELF, -(-total // (shelves * bucket))))

    def known(piece_ids: np.ndarray, offs: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments' documents, and whether the piece itself has the anchor in several documents."""
        own = piece_ids[np.searchsorted(offs, first, "right") - 1]
        _, at = np.unique(h, return_inverse=True)
        low, high = np.full(at.max() + 1, np.iinfo(np.int64).max), np.full(at.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, at, own)
        np.maximum.at(high, at, own)
        return own, (low < high)[at]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of each lot by shelf, one for each piece that has it."""
        lot, held = None, []

        def out() -> pa.RecordBatch:
            h = np.concatenate(held)
            dealt = [(b, _pack(np.sort((h[rows] >> np.uint64(32)).astype(np.uint32)))) for b, rows in _split((h % np.uint64(shelves)).astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int64()), pa.array([lot] * len(dealt), pa.string()), pa.array([x for _, x in dealt], pa.binary())], names=["shelf", "lot", "blob"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["lot"] != lot:
                    yield out()
                    held = []
                lot = row["lot"]
                _, _, offs, data = _unpack(row["blob"])
                held.append(np.unique(fragments(data, offs, length)[0]))
        if held:
            yield out()
        release()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _grouped(batches, "shelf"):
            each = [_unpack(r["blob"])[0] for r in rows]
            values, count = np.unique(np.concatenate(each), return_counts=True)
            twice = values[count > 1]
            out = [(r["lot"], (u := np.unique(x))[np.isin(u, twice, assume_unique=True)]) for r, x in zip(rows, each, strict=True)]
            out = [(p, x) for p, x in out if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([b] * len(out), pa.int64()), pa.array([_pack(x) for _, x in out], pa.binary())], names=["lot", "shelf", "blob"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments of shared anchors, by shelf and bucket."""
        names = ["shelf", "lot", "blob"]
        for lot, rows in _grouped(batches, "lot"):
            wanted = np.concatenate([_unpack(r["blob"])[0].astype(np.uint64) * np.uint64(shelves) + np.uint64(r["shelf"]) for r in rows if r["shelf"] >= 0] or [np.zeros(0, np.uint64)])
            texts, found, copies, base, rank = [], [], [], 0, 0
            for r in rows:
                if r["shelf"] >= 0:
                    continue
                ids, _, offs, data = _unpack(r["blob"])
                h, first, count = fragments(data, offs, length)
                if not len(h):
                    continue
                key = (h >> np.uint64(32)) * np.uint64(shelves) + h % np.uint64(shelves)
                own, twice = known(ids, offs, h, first)
                some = np.flatnonzero(np.isin(key, wanted) | twice)
                if not len(some):
                    continue
                h, first, count, own = h[some], first[some], count[some], own[some]
                # equal fragments of the piece: one with its bytes, the others as copies of it
                group = distinct(data, first, count + length - 1)
                lead = np.zeros(len(group), bool)
                lead[np.unique(group, return_index=True)[1]] = True
                place = np.empty(group.max() + 1, np.int64)
                place[group[lead]] = rank + np.arange(lead.sum())
                rest = ~lead
                copies.append((np.full(rest.sum(), r["no"], np.uint8), place[group[rest]], own[rest], first[rest]))
                found.append((np.full(lead.sum(), r["no"], np.uint8), base + first[lead], first[lead], count[lead], own[lead], h[lead]))
                texts.append(data)
                base, rank = base + len(data), rank + int(lead.sum())
            if not found:
                continue
            no, at, first, count, own, h = (np.concatenate(x) for x in zip(*found, strict=True))
            copy_no, copy_of, copy_own, copy_first = (np.concatenate(x) for x in zip(*copies, strict=True))
            text, anchor = np.concatenate(texts), (h >> np.uint64(32)).astype(np.uint32)
            shelf = (h % np.uint64(shelves)).astype(np.int64)
            of_shelf = dict(_split(shelf[copy_of]))
            del texts, found, copies
            out, where = [], np.empty(len(h), np.int64)
            for b, r in _split(shelf):
                r = r[np.argsort(anchor[r] % subs, kind="stable")]
                where[r] = np.arange(len(r))
                c = of_shelf.get(b, np.zeros(0, np.int64))
                c = c[np.argsort(where[copy_of[c]], kind="stable")]
                out.append((b, _pack(no[r], np.diff(own[r], prepend=0), _small(np.diff(first[r], prepend=0)), _small(count[r]), anchor[r], _gather(text, at[r], count[r] + length - 1), copy_no[c], _small(np.diff(where[copy_of[c]], prepend=0)), _small(np.diff(copy_own[c], prepend=0)), _small(np.diff(copy_first[c], prepend=0)))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([lot] * len(out)), pa.array([x for _, x in out], pa.binary())], names=names)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "shelf"):
            out: dict[str, list[tuple]] = {}
            names, parts, copies, edges, ends, turns = [], [], [], [], [], []
            for r in rows:
                no, own, first, count, anchor, data, copy_no, copy_of, copy_own, copy_first = _unpack(r["blob"])
                count = count.astype(np.int64)
                names.append(r["lot"])
                parts.append((no, np.cumsum(own, dtype=np.int64), np.cumsum(first, dtype=np.int64), count, anchor, data))
                copies.append((copy_no, *(np.cumsum(x, dtype=np.int64) for x in (copy_of, copy_own, copy_first))))
                edges.append(np.searchsorted(anchor % subs, np.arange(subs + 1)))
                ends.append(np.concatenate(([0], np.cumsum(count + length - 1)))[edges[-1]])
                turns.append(np.searchsorted(copies[-1][1], edges[-1]))
            for k in range(subs):
                own = [[x[e[k] : e[k + 1]] for x in p[:5]] + [p[5][z[k] : z[k + 1]]] for p, e, z in zip(parts, edges, ends, strict=True)]
                if not any(len(x[0]) for x in own):
                    continue
                more = [[x[t[k] : t[k + 1]] for x in c] for c, t in zip(copies, turns, strict=True)]
                no, ids, first, count, anchor, data = (np.concatenate(x) for x in zip(*own, strict=True))
                sizes = np.array([len(x[0]) for x in own])
                copy_no, copy_of, copy_own, copy_first = (np.concatenate(x) for x in zip(*more, strict=True))
                copy_of = copy_of + np.repeat(np.cumsum(sizes) - sizes - [e[k] for e in edges], [len(x[0]) for x in more])
                of = np.concatenate((np.repeat(np.arange(len(own)), sizes), np.repeat(np.arange(len(own)), [len(x[0]) for x in more])))
                no = np.concatenate((no, copy_no))
                row, start, size = _settled(ids, first, count, anchor, data, copy_of, copy_own, copy_first, length)
                for p, r in _split(of[row]):
                    out.setdefault(names[p], []).append((no[row[r]], start[r], size[r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([_runs(x) for x in out.values()], pa.binary())], names=["lot", "blob"])

    dealt = corpus.select("lot", "blob").mapInArrow(hashes, "shelf long, lot string, blob binary")
    lots = -(-total // (LOT * PIECE))
    wanted = _dealt(dealt, shared, "lot string, shelf long, blob binary", "shelf", shelves // TURN)
    both = wanted.select("lot", "shelf", F.lit(0).alias("no"), "blob").unionByName(corpus.select("lot", F.lit(-1).cast("long").alias("shelf"), "no", "blob"))
    cuts = _dealt(both, cut, "shelf long, lot string, blob binary", "lot", lots // TURN)
    return corpus, _dealt(cuts, settled, "lot string, blob binary", "shelf", shelves // TURN)


def _kept(corpus: DataFrame, gone: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(ids, null ids, offsets, bytes, mask of removed bytes) for each piece."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "lot"):
            runs = [_unruns(r["blob"]) for r in rows if r["no"] < 0]
            no, start, size = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3
            for r in rows:
                if r["no"] >= 0:
                    ids, null, offs, data = _unpack(r["blob"])
                    cover, own = np.zeros(len(data) + 1, np.int64), no == r["no"]
                    np.add.at(cover, start[own], 1)
                    np.add.at(cover, start[own] + size[own], -1)
                    yield run(ids, null.astype(bool), offs, data, np.cumsum(cover[:-1]) > 0)

    both = gone.select("lot", F.lit(-1).alias("no"), "blob").unionByName(corpus.select("lot", "no", "blob"))
    total = corpus.agg(F.sum("n")).first()[0] or 0
    return _dealt(both, each, schema, "lot", total // (LOT * PIECE) // TURN)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def rows(ids: np.ndarray, null: np.ndarray, offs: np.ndarray, data: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        a, _ = spans(gone, offs)
        sums = np.concatenate(([0], np.cumsum(gone)))
        kept, ends = data[~gone].tobytes(), (offs - sums[offs]).tolist()
        sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(np.diff(offs)), pa.array(np.diff(sums[offs])), pa.array(np.diff(np.searchsorted(a, offs))), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _kept(*removed(docs, doc_id, text, **kw), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """doc_id and the remaining bytes of each document."""

    def rows(ids: np.ndarray, null: np.ndarray, offs: np.ndarray, data: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        sums = np.concatenate(([0], np.cumsum(gone)))
        kept, ends = data[~gone].tobytes(), (offs - sums[offs]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array([kept[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "kept"])

    return _kept(*removed(docs, doc_id, text, **kw), rows, "doc_id long, kept binary")
