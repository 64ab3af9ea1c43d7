"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo the prime 2**31 - 1 and for two bases, the polynomial hash
of every prefix over its code points; the hash of any span is a difference of two entries times a
power of the base's inverse, so equality of spans takes constant time and the longest common extension of two positions a
binary search over lengths. A fingerprint keeps, for each of `BINS` residues of the span hashes, the
smallest hash of a span of `SPAN` code points that falls there (12 bits of it, with the empty bin
marked), so the share of equal bins that are not empty in both estimates how many spans two texts have in common.

The edited form of a document takes the last half of its code points from the next document in
order of ids. Rows go once by range of ids into partitions with their texts compressed; the first
row of each partition goes to the partition before it as well, so that no order is made in one task.

Edge cases: a null text is empty; a text shorter than a span has one span, itself; empty texts have
equal fingerprints, of likeness 1 with each other and 0 with any other; rows with equal ids are ordered by the hash
of their texts; one document alone follows itself; rows without an id come first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pieces, release

PRIME, BASES = (1 << 31) - 1, (911_382_323, 972_663_749)
#: Code points of a span, bins, digits of each; code points compared at once, spans hashed at once.
SPAN, BINS, DIGITS, CHARS, BLOCK = 12, 64, 3, 400_000, 200_000
#: What a text counts besides its code points: its sketches take memory however short it is.
ROW = 500
_P = np.uint64(PRIME)
_powers: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        step = base % PRIME
        while len(have) < n:
            have = np.concatenate((have, _mod(have * np.uint64(step))))
            step = step * step % PRIME
        _powers[base] = have
    return _powers[base]


class Prefixes:
    """Prefix arrays of a sequence of code points (of one text, or of several that stand one after the other)."""

    def __init__(self, codes: np.ndarray, bases: tuple[int, ...] = BASES) -> None:
        self.n, self.bases = len(codes), bases
        self.sums = []
        for base in bases:
            terms = _mod((codes.astype(np.uint64) + np.uint64(1)) * _power(base, self.n)[: self.n])
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])  # below 2**62 for 2**31 code points
            self.sums.append(_mod(_mod(sums)))

    def spans(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of spans (62 bits), equal for equal spans of any sequence."""
        out = np.zeros(np.shape(start), np.uint64)
        for base, sums in zip(self.bases, self.sums, strict=True):
            d = _mod(sums[start + length] + _P - sums[start])
            out = (out << np.uint64(31)) | _mod(d * _power(pow(base, -1, PRIME), self.n + 1)[start])
        return out

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of position i here and j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.spans(np.array([i]), middle)[0] == other.spans(np.array([j]), middle)[0]:
                low = middle
            else:
                high = middle - 1
        return low


def sketches(texts: list[str]) -> np.ndarray:
    """For each text, the smallest span hash of every bin (12 bits and one; 0 for an empty bin)."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    begin = ends - size
    count = np.where(size > 0, np.maximum(size - SPAN + 1, 1), 0)
    low = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    whole = np.cumsum(count)  # spans before the end of each text
    for first in range(0, int(whole[-1]) if len(texts) else 0, BLOCK):
        span = np.arange(first, min(first + BLOCK, int(whole[-1])))
        text = np.searchsorted(whole, span, "right")
        start = begin[text] + span - (whole - count)[text]
        at, stop = start[0], min(len(codes), start[-1] + SPAN)
        h = Prefixes(codes[at:stop]).spans(start - at, np.minimum(size[text], SPAN))
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum.at(low, text * BINS + (h >> np.uint64(58)).astype(np.int64), h)
    low = low.reshape(-1, BINS)
    return np.where(low == np.iinfo(np.uint64).max, 0, (low ^ (low >> np.uint64(20))) % np.uint64(4095) + np.uint64(1)).astype(np.int64)


def printed(sketch: np.ndarray) -> list[str]:
    """Fingerprints: three hexadecimal digits for each bin."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    wide = np.stack([digits[(sketch >> s) & 15] for s in (8, 4, 0)], 2).reshape(len(sketch), -1)
    return [x.decode() for x in np.ascontiguousarray(wide).view(f"S{BINS * DIGITS}")[:, 0].tolist()] if len(sketch) else []


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either text fills; 1 for two empty texts."""
    filled = ((a > 0) | (b > 0)).sum(1)
    return np.where(filled == 0, 1.0, ((a == b) & (a > 0)).sum(1) / np.maximum(filled, 1))


def fingerprint(text: str | None) -> str:
    return printed(sketches([text or ""]))[0]


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by the first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """part, last, i, packed: rows by range of ids in order, and the first row of each part again as the last of the part before."""
    tasks = partitions(docs.sparkSession)
    n = 4 * tasks
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    ids = rows.select("i")
    edges = ids.where("i is not null").stat.approxQuantile("i", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    edges = sorted({int(e) for e in edges})
    cuts = np.array(edges, np.int64)

    def part_of(i: pa.Array) -> pa.Array:
        """A part holds ids up to its edge; rows without an id are in the first."""
        return pa.array(np.where(i.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, i.fill_null(0).to_numpy(), "left")).astype(np.int32))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([part_of(batch.column("i")), batch.column("i")], names=["part", "i"])

    firsts = ids.mapInArrow(parts, "part int, i long").groupBy("part").agg(F.min("i").alias("low"), F.count(F.when(F.col("i").isNull(), 1)).alias("nulls")).orderBy("part").collect()
    have = [r.part for r in firsts]
    before = {r.part: have[k - 1] for k, r in enumerate(firsts)}  # the first part's first row follows the last part's last
    low = {r.part: None if r.nulls else r.low for r in firsts}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in pieces(batch, "t"):
                out: list[list] = [[], [], [], [], []]
                for p, i, t in zip(part_of(piece.column("i")).to_pylist(), *(piece.column(c).to_pylist() for c in ("i", "t")), strict=True):
                    raw = (t or "").encode()
                    tie, packed = hashlib.md5(raw).digest(), press.compress(raw)
                    for to, last in ((p, 0), *(((before[p], 1),) if i == low[p] else ())):
                        for column, value in zip(out, (to, last, i, tie, packed), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["part", "last", "i", "tie", "packed"])
        release()

    packed = rows.mapInArrow(pack, "part int, last int, i long, tie binary, packed binary")
    return packed.repartition(tasks, "part").sortWithinPartitions("part", "last", F.col("i").asc_nulls_first(), "tie").select("part", "last", "i", "packed")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited"]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of compared() from the rows of _dealt(); so many texts at once as have CHARS code points, each with ROW more."""
    expand = zstandard.ZstdDecompressor()

    def out(pairs: list[tuple]) -> pa.RecordBatch:
        texts, nexts = [p[1] for p in pairs], [p[2] for p in pairs]
        changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
        a, b = sketches(texts), sketches(changed)
        c = np.concatenate((a[1:], sketches(nexts[-1:])))
        for k in range(len(pairs) - 1):
            if nexts[k] is not texts[k + 1]:
                c[k] = sketches([nexts[k]])[0]
        same = common_starts(texts, changed)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array(printed(a)), pa.array(printed(b)), pa.array(likeness(a, b)), pa.array(likeness(a, c)), pa.array(same, pa.int64())],
            names=_NAMES,
        )

    pairs: list[tuple] = []  # id, text, next text
    chars, current = 0, None
    for batch in batches:
        for part, last, i, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "i", "packed")), strict=True):
            if current and current[0] != part:
                current = None
            if last and current is None:  # a further row with the same id
                continue
            text_of = expand.decompress(packed).decode() if packed else ""
            if current:
                pairs.append((current[1], current[2], text_of))
                chars += len(current[2]) + ROW
                if chars > CHARS:
                    yield out(pairs)
                    pairs, chars = [], 0
            current = None if last else (part, i, text_of)
    if pairs:
        yield out(pairs)
    release()


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited (longest common extension with the edited text from the start)."""
    return _dealt(docs, doc_id, text).mapInArrow(_run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long")


def common_starts(a: list[str], b: list[str]) -> list[int]:
    """Longest common extension of each pair from its start: binary search over prefix hashes, all pairs together."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    codes = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
    pa_, pb = Prefixes(codes[0]), Prefixes(codes[1])
    sa, sb = np.cumsum(la) - la, np.cumsum(lb) - lb
    low, high = np.zeros(len(a), np.int64), np.minimum(la, lb)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = pa_.spans(sa, middle) == pb.spans(sb, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        high = np.maximum(low, high)
    return low.tolist()
