"""Near-duplicates by SimHash, each link checked by the Jaccard similarity of whole texts, and an exact complement for what SimHash can't see.

SimHash goes first: fingerprints of the same shingles, the byte-position index with count filtering and `simhash.BITS`
differing bits propose pairs, which are verified on whole texts; alike ones are joined. Texts of a likeness of LIKE may
differ in more bits than the index guarantees, though, so prefix filtering looks for links between what SimHash left apart:

Put all shingles in any one order: of two sets that share at least LIKE of their union, the first
n - ceil(LIKE n) + 1 shingles of each (n: its size) share one. These prefixes are posted, and of the
postings only those of two different sets or more go on, which is a small part. All else works on that part:

1. Each member of a posting is paired with the posting's leader of its class of sizes, unless SimHash has joined them, so a posting
   of any length gives as many pairs as it has members. The pairs are verified on whole texts and
   joined into components; a large group of near copies is mostly one component after this.
2. Members of a posting in different components are paired where their sizes, and their places in the two
   prefixes, leave room for likeness; what step 1 has verified or SimHash has proposed is left out. These pairs are verified too.

Every alike pair shares a prefix shingle, so it lies in one component after step 1 or is verified in
step 2: no link is lost, nothing is estimated, and no group meets in one task. A sample of
the documents decides the order only (frequent shingles last) and which postings are dealt over several tasks.

Equal sets are one node, known by two 64-bit hashes. Texts of fewer words than a shingle are one shingle; texts
without words, null texts too, are one class. Words are as in SimHash: ASCII white space parts them, A-Z are lowered.
Rows are known by their id and a hash of their text, so rows that share an id but not their text have classes of
their own. A null id joins its class but is its smallest id only where it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER, SPACE, Scratch, flat, partitions, pieces, release, released, small_batches, span_hashes, spans, written
from .simhash import classed, components, named, one_of_each

#: Words of a shingle; likeness as a fraction.
WIDTH, LIKE = 5, (4, 5)
#: One document in SAMPLE helps to order shingles: those in SEEN of them or more come last, ORDERED shingles at most; postings of those in SPREAD or more are dealt over PARTS tasks.
SAMPLE, SEEN, ORDERED, SPREAD, PARTS = 8, 3, 1 << 20, 200, 16
#: Members of a posting that meet in one task; longer postings meet in pairs of such blocks.
BLOCK = 20_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * by
    return h ^ (h >> np.uint64(29))


def shingles(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and the rows' bounds."""
    low = LOWER[data]
    starts, ends = spans(~SPACE[low], offs)
    words = _mixed(span_hashes(low, starts, ends), _MIX[0])
    first = np.searchsorted(starts, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    at = np.arange(len(words))
    left = first[1:][row] - at  # words from here to the row's end
    begins = np.flatnonzero((left >= width) | (at == first[:-1][row]))
    h, row, left = np.zeros(len(begins), np.uint64), row[begins], left[begins]
    for k in range(width):
        inside = left > k
        h[inside] = _mixed(h[inside] + words[begins[inside] + k] + np.uint64(k + 1), _MIX[1])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offs)))


def _sets(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offs = flat(part.column("t"))
    return shingles(data, offs, width)


def _keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set."""
    keys = []
    for by in _MIX[1:]:
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(_mixed(h + by, by), out=sums[1:])
        keys.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return keys[0], keys[1]


def _binary(k1: np.ndarray, k2: np.ndarray) -> pa.Array:
    """Both hashes as one key of 16 bytes."""
    both = np.ascontiguousarray(np.stack((k1, k2), 1).astype(">u8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(k1), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def _prefixes(h: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the prefix of each row by (rank, hash): places, rows, and places in the prefix."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, rank, row))
    most = np.where(n > 0, n + 1 - -(-n * LIKE[0] // LIKE[1]), 0)
    at = np.arange(len(h)) - bounds[:-1][row]
    own = at < most[row]
    return order[own], row[own], at[own]


def _ranked(h: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, counts[at], 0)


def marks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """i, th, k, the key of the row's set of shingles, and fp, the SimHash fingerprint of the row's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                fps = simhash.fingerprinted(part.column("t"), width)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("th"), _binary(*_keys(*_sets(part, width))), pa.array(fps.view(np.int64))], names=["i", "th", "k", "fp"])
        release()

    return rows.mapInArrow(run, "i long, th long, k binary, fp long")


def proposed(marked: DataFrame, scratch: Scratch, most: int = simhash.BITS) -> DataFrame:
    """Pairs (a, b) of sets that the SimHash index joins: a forest of those with equal fingerprints or within `most` bits."""
    sets = marked.select("fp", "k").distinct()
    nodes = scratch.written(sets.groupBy("fp").agg(F.min("k").alias("rep")))
    equal = sets.join(nodes, "fp").select(F.col("rep").alias("x"), F.col("k").alias("y"))
    pairs = equal.union(simhash.links(nodes, most)).where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sampled documents and their counts; they change the order of shingles, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                yield pa.RecordBatch.from_arrays([pa.array(_sets(part, width)[0].view(np.int64))], names=["s"])
        release()

    with released(rows.sparkSession):
        drawn = rows.where(F.pmod(F.xxhash64("i", "th"), F.lit(SAMPLE)) == 0).mapInArrow(run, "s long")
        found = drawn.groupBy("s").count().where(F.col("count") >= SEEN).orderBy(F.desc("count"), "s").limit(ORDERED).toArrow()
    known = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], found.column("count").to_numpy()[order]


def postings(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Prefix entries that two different sets or more share: s, n (size of the set), p (place in the prefix), k."""
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(rows, width))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        seen: set[int] = set()  # sets of this task: copies post once
        for batch in batches:
            for part in pieces(batch, "t"):
                h, bounds = _sets(part, width)
                k1, k2 = _keys(h, bounds)
                fresh = np.zeros(len(k1), bool)
                for r, key in enumerate(k1.tolist()):
                    if key not in seen:
                        seen.add(key)
                        fresh[r] = True
                rank = _ranked(h, known, counts)
                at, row, p = _prefixes(h, bounds, rank)
                own = fresh[row]
                at, row, p = at[own], row[own], p[own]
                salt = np.where(rank[at] >= SPREAD, (k1[row] % np.uint64(PARTS)).astype(np.int32) + 1, 0).astype(np.int32)
                columns = [h[at].view(np.int64), salt, np.diff(bounds)[row].astype(np.int32), p.astype(np.int32), k1[row].view(np.int64), k2[row].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "salt", "n", "p", "k1", "k2"])
        release()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each s with different sets, one a set; a row waits for the one after it."""
        held, before = None, False  # the last row, and whether the one before it has its s

        def out(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            s, _, n, p, k1, k2 = (c[keep] for c in cols)
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(n), pa.array(p), _binary(k1.view(np.uint64), k2.view(np.uint64))], names=["s", "n", "p", "k"])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("s", "salt", "n", "p", "k1", "k2")]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate((a, b)) for a, b in zip(held, cols, strict=True)]
            s, _, _, _, k1, k2 = cols
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            cols = [c[new] for c in cols]
            s, salt = cols[0], cols[1]
            same = s[1:] == s[:-1]
            keep = np.concatenate((same, [False])) | np.concatenate(([before], same)) | (salt > 0)
            keep[-1] = False
            yield out(cols, keep)
            before = bool(same[-1]) if len(same) else before
            held = [c[-1:] for c in cols]
        if held is not None:
            yield out(held, np.array([before or held[1][0] > 0]))
        release()

    posted = rows.mapInArrow(post, "s long, salt int, n int, p int, k1 long, k2 long")
    return posted.repartition(partitions(rows.sparkSession), "s", "salt").sortWithinPartitions("s", "k1", "k2").mapInArrow(share, "s long, n int, p int, k binary")


def _room(n: Column, p: Column, m: Column, q: Column) -> Column:
    """Whether sets of n and m shingles may be alike if the first that they share is at place p and q."""
    n, m = n.cast("long"), m.cast("long")
    return sum(LIKE) * (1 + F.least(n - 1 - p, m - 1 - q)) >= LIKE[0] * (n + m)


def _joined(entries: DataFrame, joined: DataFrame) -> DataFrame:
    """s, n, p, k and o, the component of k (itself where it has none). joined: node and component."""
    return entries.join(joined, entries.k == joined.node, "left").select("s", "n", "p", "k", F.coalesce("component", "k").alias("o"))


def led(entries: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a posting with the leader of its class of sizes, where joined (node, component) leaves them apart."""
    sized = _joined(entries, joined).withColumn("c", F.floor(F.log(LIKE[1] / LIKE[0], F.col("n"))))
    leaders = sized.groupBy("s", "c").agg(F.min(F.struct("k", "n", "p", "o")).alias("l"), F.count("*").alias("m")).where("m > 1").drop("m")
    pairs = sized.join(leaders, ["s", "c"]).where((F.col("o") != F.col("l.o")) & _room(F.col("n"), F.col("p"), F.col("l.n"), F.col("l.p")))
    return pairs.select(F.col("l.k").alias("a"), F.col("k").alias("b")).distinct()


def _meeting(s: np.ndarray, block: np.ndarray, n: np.ndarray, p: np.ndarray, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a posting in different components with room for likeness; rows are sorted by (s, n). Blocks: 0 and 1 meet each other only, 2 meets itself."""
    found: list[np.ndarray] = []
    at, step = np.arange(len(s)), 1
    while True:
        at = at[at + step < len(s)]
        b = at + step
        live = (s[at] == s[b]) & (n[at] * LIKE[1] >= n[b] * LIKE[0])
        at, b = at[live], b[live]  # sizes rise, so no later step has room either
        if not len(at):
            break
        ok = (c[at] != c[b]) & ((block[at] == 2) | (block[at] != block[b]))
        ok &= sum(LIKE) * (1 + np.minimum(n[at] - 1 - p[at], n[b] - 1 - p[b])) >= LIKE[0] * (n[at] + n[b])
        if ok.any():
            found.append(np.unique(k[at[ok]] * np.int64(1 << 31) + k[b[ok]]))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found))]
        step += 1
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> np.int64(31), both & np.int64((1 << 31) - 1)


def apart(entries: DataFrame, joined: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of members of a posting that joined (node, component) leaves apart."""
    own = _joined(entries, joined).withColumnRenamed("o", "c")
    mixed = own.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low <> high").select("s", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    rows = own.join(mixed, "s").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    # block i meets itself and each other block once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("*", other.alias("other")).select("s", "n", "p", "k", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept = ("s", "n", "p", "k", "c", "i", "j", "side"), None

        def out(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            s, n, p, i, j, side = (rows.column(c).to_numpy().astype(np.int64) for c in ("s", "n", "p", "i", "j", "side"))
            nodes = rows.column("k").combine_chunks().dictionary_encode()
            group = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            comps = rows.column("c").combine_chunks().dictionary_encode().indices.to_numpy()
            a, b = _meeting(group, side, n, p, comps, nodes.indices.to_numpy().astype(np.int64))
            return pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(a)), nodes.dictionary.take(pa.array(b))], names=["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch.select(names)])
            kept = now if kept is None else pa.concat_tables([kept, now])
            last = [kept.column(c)[-1].as_py() for c in ("s", "i", "j")]
            open_at = np.logical_and.reduce([kept.column(c).to_numpy() == v for c, v in zip(("s", "i", "j"), last, strict=True)])
            done = int(np.argmax(open_at))  # the open group waits
            if done:
                yield out(kept.slice(0, done))
                kept = kept.slice(done)
        if kept is not None:
            yield out(kept)
        release()

    dealt = rows.repartition(partitions(entries.sparkSession), "s", "i", "j").sortWithinPartitions("s", "i", "j", "n")
    return dealt.mapInArrow(meet, "x binary, y binary").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(pairs: DataFrame, rows: DataFrame, marked: DataFrame, out: Scratch, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of sets that are alike, by one whole text of each; a table of out."""
    ids = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    one = marked.join(ids, "k", "left_semi").groupBy("k").agg(F.min(F.struct("i", "th")).alias("r"))
    one = one.select("k", F.col("r.i").alias("_i"), F.col("r.th").alias("_th"))
    texts = rows.join(one, F.col("i").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_th"))).select("k", "t")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            for part in pieces(batch, "t"):
                keys, z = [], []
                for k, t in zip(part.column("k").to_pylist(), part.column("t").to_pylist(), strict=True):
                    if k not in seen:  # a repeated row
                        seen.add(k)
                        keys.append(k)
                        z.append(press.compress((t or "").encode()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(z, pa.binary())], names=["k", "z"])
        release()

    scratch = Scratch(rows.sparkSession)
    packed = scratch.written(texts.mapInArrow(pack, "k binary, z binary").groupBy("k").agg(F.first("z").alias("z")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            za, zb = batch.column("za"), batch.column("zb")
            at, keep = 0, []
            while at < batch.num_rows:
                texts: dict[bytes, bytes] = {}
                size, end = 0, at
                while end < batch.num_rows and size < 1_000_000:
                    for key, z in ((a[end], za[end]), (b[end], zb[end])):
                        if key not in texts:
                            texts[key] = expand.decompress(z.as_py())
                            size += len(texts[key])
                    end += 1
                offs = np.concatenate(([0], np.cumsum([len(t) for t in texts.values()])))
                h, bounds = shingles(np.frombuffer(b"".join(texts.values()), np.uint8), offs, width)
                place = {key: k for k, key in enumerate(texts)}
                for k in range(at, end):
                    x, y = place[a[k]], place[b[k]]
                    both = np.concatenate((h[bounds[x] : bounds[x + 1]], h[bounds[y] : bounds[y + 1]]))
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(same * sum(LIKE) >= LIKE[0] * len(both) > 0)
                at = end
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    second = pairs.join(packed.select(F.col("k").alias("b"), F.col("z").alias("zb")), "b")
    both = second.join(packed.select(F.col("k").alias("a"), F.col("z").alias("za")), "a").select("a", "b", "za", "zb")
    with scratch, small_batches(rows.sparkSession, 500):
        return out.written(both.mapInArrow(check, "a binary, b binary"))


def united(rows: DataFrame, marked: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """node and component of all sets with a link. Each further step starts from the components of those before it, which are stars already.

    Tables between steps are deleted as soon as what they serve is written, and so are shuffle files; the last components stay."""
    with Scratch(rows.sparkSession) as steps, Scratch(rows.sparkSession) as links:
        tried = steps.written(proposed(marked, steps))
        found = components(verified(tried, rows, marked, links, width), steps)
        links.drop()
        entries = steps.written(postings(rows, width))
        first = steps.written(led(entries, found).join(tried, ["a", "b"], "left_anti"))
        found = _extended(found, verified(first, rows, marked, links, width), steps)
        links.drop()
        rest = links.written(apart(entries, found, block).join(tried.unionByName(first), ["a", "b"], "left_anti"))
        return _extended(found, verified(rest, rows, marked, links, width))


def _extended(found: DataFrame, linked: DataFrame, out: Scratch | None = None) -> DataFrame:
    """The components (node, component) with further links (a, b)."""
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked), out)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: i, th and r, the row that stands for its class (struct of null id, id, th)."""
    rows = named(docs, doc_id, text)
    marked = written(marks(rows, width))
    return classed(marked, "k", united(rows, marked, width, block))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row a document: doc_id, component_id (smallest id reachable over alike documents)."""
    return classes(docs, doc_id, text, **kw).select(F.col("i").alias("doc_id"), F.col("r.i").alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents with one row kept of each class."""
    return one_of_each(docs, classes(docs, doc_id, text, **kw), doc_id, text)
