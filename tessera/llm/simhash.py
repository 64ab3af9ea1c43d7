"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most `most`
bits differ in at most `most` bytes, so they share at least 8 - most positional bytes: the
guaranteed minimum. The index posts each distinct fingerprint under its (position, byte) pairs; as a pair
shares that many, the first that it shares is among the first `most` + 1 positions, and only these are posted.
In a posting the shared positional bytes of each pair are tallied; pairs that reach the minimum, and
whose first shared position is the posting's, are retained and verified by their differing bits.
What is verified leaves the task as a spanning forest, never as all pairs of a group.

A posting of more than `limit` members is posted again by a further (position, byte) pair, up to
as many pairs as the minimum; one that is too long even then meets in pairs of blocks of `limit` members. So
no task holds more than a posting of `limit` members, and the work follows the number of fingerprints.

Equal fingerprints are one node, so copies never meet each other. Components come from alternating
large-star and small-star rounds over the links, each round checkpointed in the shared folder.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked like
any other; repeated rows stay rows of their own, and so do rows that share an id but not their text; an empty table gives
an empty result; the id column may be of any integer type, and a null id joins its class but is its smallest id only where it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat, partitions, pieces, release, written

#: Words of a shingle, differing bits of a link, hash seed; members of a posting that meet at once.
SHINGLE, BITS, SEED, LIMIT = 4, 4, 42, 4096


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text."""
    return int(_fingerprints([text], width)[0])


def _fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()  # bytes: A-Z and ASCII white space only
        n = len(words)
        if n == 0:
            counts.append(0)
        elif n <= width:
            hashes.append(digest(b" ".join(words), SEED))
            counts.append(1)
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            stops, begins = (ends[width - 1 :] - 1).tolist(), [0, *ends[: n - width].tolist()]
            hashes += [digest(line[a:b], SEED) for a, b in zip(begins, stops, strict=True)]
            counts.append(n - width + 1)
    out = np.zeros(len(texts), np.uint64)
    counts = np.array(counts, np.int64)
    if not hashes:
        return out
    h = np.array(hashes, np.uint64)
    some = np.flatnonzero(counts)
    begins = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
    ones = np.empty((len(some), 64), np.int64)
    for lo in range(0, 64, 8):  # eight bits at a time
        byte = ((h >> np.uint64(lo)) & np.uint64(255)).astype(np.uint8)
        ones[:, lo : lo + 8] = np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little"), begins, axis=0, dtype=np.int64)
    bits = ones * 2 > counts[some][:, None]
    out[some] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def fingerprinted(col: pa.Array, width: int) -> np.ndarray:
    """The fingerprints of a string column."""
    data, offs = flat(col)
    raw = data.tobytes()
    at = offs.tolist()
    return _fingerprints([raw[a:b] for a, b in zip(at, at[1:], strict=False)], width)


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """i, t and th: id, text and a hash of the text; the last tells rows with one id apart."""
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), t.alias("t"), F.xxhash64(t).alias("th"))


def fingerprints(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """i, th and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                fps = fingerprinted(part.column("t"), width)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("th"), pa.array(fps.view(np.int64))], names=["i", "th", "fp"])
        release()

    return rows.mapInArrow(run, "i long, th long, fp long")


def places(depth: int, least: int) -> list[tuple[int, ...]]:
    """The first `depth` positions that a pair with `least` shared positions of 8 may share."""
    return [c for c in combinations(range(8), depth) if all(p <= 8 - least + k for k, p in enumerate(c))]


def keys(fps: np.ndarray, depth: int, least: int) -> np.ndarray:
    """A posting key for each fingerprint (row) and each choice of positions (column): the choice, then its bytes."""
    out = []
    for number, chosen in enumerate(places(depth, least)):
        key = np.full(len(fps), number, np.uint64)
        for p in chosen:
            key = (key << np.uint64(8)) | ((fps >> np.uint64(8 * p)) & np.uint64(255))
        out.append(key)
    return np.stack(out, 1).view(np.int64)


def tally(x: np.ndarray) -> np.ndarray:
    """How many positional bytes a pair shares, from the exclusive or of its fingerprints."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))


def retained(a: np.ndarray, b: np.ndarray, number: np.ndarray, depth: int, most: int) -> np.ndarray:
    """Places of the pairs of a posting whose tally reaches the minimum, where the posting is that of the first positions they share, and whose bits agree."""
    least = max(1, 8 - most)
    x = a ^ b
    at = np.flatnonzero(tally(x) >= least)
    at = at[np.bitwise_count(x[at]) <= most]
    first = np.ones(len(at), bool)
    for k, chosen in enumerate(places(depth, least)):
        own = np.flatnonzero(number[at] == k)
        before = sum(0xFF << (8 * p) for p in range(chosen[-1]) if p not in chosen)  # positions that must not be shared
        first[own] = tally(x[at[own]] | np.uint64(~before & 0xFFFFFFFFFFFFFFFF)) == 0
    return at[first]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def near(fps: np.ndarray, group: np.ndarray, number: np.ndarray, side: np.ndarray, depth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the retained pairs of positions within groups, which are sorted. Sides: 0 and 1 meet each other only, 2 meets itself."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    stop = np.searchsorted(group, group, "right")
    at, step, held = np.arange(len(fps)), 1, 0
    while len(at):
        live = at + step < stop[at]
        at = at[live]
        b = at + step
        ok = retained(fps[at], fps[b], number[at], depth, most)
        ok = ok[(side[at[ok]] == 2) | (side[at[ok]] != side[b[ok]])]
        if len(ok):
            found.append((at[ok], b[ok]))
            held += len(ok)
        if held > 1_000_000:  # a forest in place of its pairs
            root = _forest(len(fps), *(np.concatenate(x) for x in zip(*found, strict=True)))
            moved = np.flatnonzero(root != np.arange(len(fps)))
            found, held = [(moved, root[moved])], len(moved) % 1_000_000
        step += 1
    root = _forest(len(fps), *(np.concatenate(x) for x in zip(*found, strict=True)))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return moved, root[moved]


def _posted(nodes: DataFrame, depth: int, least: int) -> DataFrame:
    """key, fp, rep: a row for each choice of positions, or for those that go on from the key where nodes has one."""
    deeper = "key" in nodes.columns
    starts = np.array([[c[: depth - 1] == d for c in places(depth, least)] for d in places(depth - 1, least)]) if deeper else None

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            key = keys(fps, depth, least)
            if deeper:
                number = (batch.column("key").to_numpy() >> np.int64(8 * (depth - 1))).astype(np.int64)
                row, column = np.nonzero(starts[number])
            else:
                row, column = (x.ravel() for x in np.indices(key.shape))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key[row, column]), batch.column("fp").take(take), batch.column("rep").take(take)], names=["key", "fp", "rep"])

    kind = nodes.schema["rep"].dataType.simpleString()
    return nodes.mapInArrow(post, f"key long, fp long, rep {kind}")


def _met(posted: DataFrame, depth: int, most: int) -> DataFrame:
    """Links of the postings: key, i, j, side, fp, rep."""
    names = ("key", "i", "j", "side", "fp", "rep")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            key, i, j, side, fp = (rows.column(c).to_numpy() for c in names[:5])
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            a, b = near(fp.view(np.uint64), group, key >> np.int64(8 * depth), side, depth, most)
            rep = rows.column("rep").combine_chunks()
            return pa.RecordBatch.from_arrays([rep.take(pa.array(a)), rep.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch.select(names)])
            kept = now if kept is None else pa.concat_tables([kept, now])
            same = np.logical_and.reduce([kept.column(c).to_numpy() == kept.column(c)[-1].as_py() for c in names[:3]])
            done = int(np.argmax(same))  # the open posting waits
            if done:
                yield out(kept.slice(0, done))
                kept = kept.slice(done)
        if kept is not None:
            yield out(kept)
        release()

    kind = posted.schema["rep"].dataType.simpleString()
    dealt = posted.repartition(partitions(posted.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(meet, f"a {kind}, b {kind}")


def links(nodes: DataFrame, most: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints that join all within `most` bits; a forest of each task's pairs. nodes: fp, rep."""
    least = max(1, 8 - most)
    alone = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")]
    rows, found = nodes.select("fp", "rep"), None
    for depth in range(1, least + 1):
        posted = _posted(rows, depth, least)
        counts = posted.groupBy("key").count().where(F.col("count") > limit)
        hot = written(counts)
        long = not hot.isEmpty()
        short = posted.join(hot, "key", "left_anti") if long else posted
        part = _met(short.select("key", *alone, "fp", "rep"), depth, most)
        found = part if found is None else found.unionByName(part)
        if not long:
            return found
        rows = posted.join(hot.select("key"), "key", "left_semi")
    # too long by all positions: each block meets itself and each other block once
    rows = rows.join(hot.select("key", F.ceil(F.col("count") / limit).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return found.unionByName(_met(rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "fp", "rep"), least, most))


def starred(edges: DataFrame) -> bool:
    """Whether each u of the edges (u, v), v smaller, has one edge and is no v: then v is the smallest of its component."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").count() == 0


def components(edges: DataFrame, out: Scratch | None = None) -> DataFrame:
    """node and component (its smallest member) for every node of a link, by large-star and small-star rounds until all are stars. Each round's table goes when the next is written; the result is a table of out, or stays."""
    with Scratch(edges.sparkSession) as now, Scratch(edges.sparkSession) as then:
        edges = now.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
        while not starred(edges):
            # large star: every larger neighbour to the smallest of the neighbourhood
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = large.distinct()
            # small star: every smaller neighbour, and the node, to the smallest
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
            edges = then.written(small.distinct())
            now.drop()
            now, then = then, now
        return (out.written if out else written)(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct()))


def classed(marked: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """marked (i, th, key) and r, the row that stands for its class: the smallest id, then the smallest th; a null id comes last. found: node and component of keys."""
    row = F.struct(F.col("i").isNull().alias("n"), "i", "th")
    nodes = marked.groupBy(key).agg(F.min(row).alias("own"))
    nodes = nodes.join(found, F.col(key) == F.col("node"), "left").select(key, "own", F.coalesce("component", key).alias("c"))
    low = nodes.groupBy("c").agg(F.min("own").alias("r"))
    of = nodes.join(low, "c").select(F.col(key).alias("_k"), "r")
    return marked.join(of, F.col(key) == F.col("_k")).drop("_k")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, most: int = BITS, limit: int = LIMIT) -> DataFrame:
    """A row for each row of docs: i, th, fp and r, the row that stands for its class (struct of null id, id, th)."""
    marked = written(fingerprints(named(docs, doc_id, text), width))
    nodes = written(marked.select("fp").distinct().withColumn("rep", F.col("fp")))
    return classed(marked, "fp", components(links(nodes, most, limit)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    return classes(docs, doc_id, text, **kw).select(F.col("i").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("r.i").alias("component_id"))


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their classes (i, th, r), with all columns; of rows with the same id and text one. Columns travel by place, so any names may stand beside each other."""
    names = docs.columns
    places = [f"_{k}" for k in range(len(names))]
    i, t = (places[names.index(c)] for c in (doc_id, text))
    gone = found.where(~(F.col("i").eqNullSafe(F.col("r.i")) & (F.col("th") == F.col("r.th")))).select(F.col("i").alias("gone_i"), F.col("th").alias("gone_th")).distinct()
    rows = docs.toDF(*places)
    th = F.xxhash64(F.col(t).cast("string"))
    left = rows.join(gone, F.col(i).cast("long").eqNullSafe(F.col("gone_i")) & (th == F.col("gone_th")), "left_anti")
    if not found.groupBy("i", "th").count().where("count > 1").isEmpty():
        left = left.dropDuplicates([i, t])
    return left.toDF(*names)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents with one row kept of each class of SimHash links."""
    return one_of_each(docs, classes(docs, doc_id, text, **kw), doc_id, text)
