"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (wire format: tag, then varint, fixed or length-delimited
value), and its parts are rebuilt: the normaliser (precompiled character map, extra spaces, dummy
prefix), the metaspace marker, the pieces with their scores as a unigram model or, for a BPE model,
as merges in the order of the merged pieces' scores, byte fallback and the decoder.

No piece of a usual model has a marker after another character, so a text is split before each run
of markers without changing its pieces. A batch's distinct chunks are encoded once, multithreaded in
the library, and each text's ids are put together from them; a model with such a piece, or with a
character map, is encoded text by text.

Parity with the sentencepiece library is verified where asked: the normal form of each whole text against the library's, and
the ids of its chunks against the library's for them; decoding is an
exact inverse of encoding for texts whose normal form is the text itself.

Edge cases: a null or empty text has no ids and decodes to the empty text (null stays null when
decoding nulls); very long texts are split like others; repeated rows and empty tables pass
through; input columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Distinct chunks that are encoded as one string; bytes of text taken together; threads of the library in a worker.
RUN, PIECE, THREADS = 20, 2_000_000, 2
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: kinds of model and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    """What the protobuf holds, as far as encoding needs it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            value: int | bytes = varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


def parse(raw: bytes) -> Model:
    """A model from its serialised form."""
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.unk, m.byte_fallback = f.get(3, UNIGRAM), f.get(40, 0), bool(f.get(35, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.extra_spaces, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, by falling score of the whole, then by the ids of the parts."""
    ids = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for p, score, kind in model.pieces:
        if kind == NORMAL and len(p) > 1:
            found += [(-score, ids[p], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return [(x[4], x[5]) for x in sorted(found)]


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, raw: bytes) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import AddedToken, Tokenizer, models, normalizers

        self.raw = raw
        self.model = m = parse(raw)
        if m.kind == BPE:
            vocab = {p: k for k, (p, _, _) in enumerate(m.pieces)}
            own = models.BPE(vocab=vocab, merges=merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
        elif m.kind == UNIGRAM:
            own = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk, byte_fallback=m.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        self.tokenizer = Tokenizer(own)
        users = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER]
        if users:
            self.tokenizer.add_tokens(users)
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        #: Chunks start at a run of markers unless a piece has a marker after another character.
        self.chunked = m.escape and not users and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, UNUSED))
        #: Bytes of normal text that each piece stands for.
        self.lengths = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in m.pieces], np.int64)
        self.bytes_of = {k: int(p[3:5], 16) for k, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}

    def normal(self, text: str) -> str:
        """The normal form: character map, extra spaces, dummy prefix, markers."""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.extra_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def chunks(self, normal: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, one after the other, and how many each text has."""
        if not self.chunked:
            some = [x for x in normal if x]
            return pa.array(some, pa.large_string()), np.array([bool(x) for x in normal], np.int64)
        split = [pa.array(_CHUNK.findall(x), pa.large_string()) for x in normal]  # strings of one text at a time
        return pa.concat_arrays(split) if split else pa.array([], pa.large_string()), np.fromiter(map(len, split), np.int64, len(split))

    def plain(self, text: str) -> str:
        """The text that encoding keeps: the normal form without markers and dummy prefix."""
        text = self.normal(text).replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the bounds of each text's; the last call's chunks stay for parity()."""
        normal = [self.normal(t or "") for t in texts]
        chunks, counts = self.chunks(normal)
        coded = pc.dictionary_encode(chunks)
        words = coded.dictionary.to_pylist()
        pool, begin = self._coded(words)
        size = np.diff(begin)
        which = coded.indices.to_numpy().astype(np.int64)
        n = size[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(begin[:-1][which] - ends[:-1], n) + np.arange(ends[-1])
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
        self.last = (words, pool, begin, which, counts, texts, normal)
        return pool[at], bounds

    def _runs(self, words: list[str]) -> list[str | None]:
        """Runs of chunks to be encoded as one string; None where a chunk would join its neighbours."""
        runs: list[str | None] = []
        for k in range(0, len(words), RUN):
            own = words[k : k + RUN]
            runs.append("".join(own) if self.chunked and all(x[0] == MARK != x[-1] for x in own) else None)
        return runs

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks and the bounds of each chunk's."""
        runs = self._runs(words)
        asked = [x for k, run in enumerate(runs) for x in ([run] if run is not None else words[k * RUN : (k + 1) * RUN])]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)]
        pool = np.concatenate([np.array(x, np.int32) for x in got]) if got else np.zeros(0, np.int32)
        if self.model.unk in pool and any(r is not None for r in runs):  # the length of what an unknown piece stands for isn't known
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.int32), np.concatenate(([0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))))
        # chunks end where the bytes of their ids do
        covered = np.cumsum(self.lengths[pool])
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in words), np.int64, len(words)))
        return pool, np.concatenate(([0], np.searchsorted(covered, ends, "left") + 1)) if len(words) else np.zeros(1, np.int64)

    def parity(self) -> np.ndarray:
        """For each text of the last call, whether the sentencepiece library gives it the same normal form and all its chunks the same ids."""
        words, pool, begin, which, counts, texts, normal = self.last
        self.last = None
        sp, at = processor(self.raw), begin.tolist()
        strip = self.model.dummy_prefix

        def theirs(asked: list[str]) -> list[list[int]]:
            found = sp.encode([x.removeprefix(MARK) if strip else x for x in asked], num_threads=1) if asked else []
            return [x or [sp.piece_to_id(MARK)] for x in found]  # a lone marker can only be asked for as a piece

        same = np.ones(len(words), bool)
        runs = self._runs(words)
        whole = [k for k, run in enumerate(runs) if run is not None]
        again = [k for k, run in enumerate(runs) if run is None]
        for k, ids in zip(whole, theirs([runs[k] for k in whole]), strict=True):
            if ids != pool[at[k * RUN] : at[min(len(words), (k + 1) * RUN)]].tolist():
                again.append(k)
        single = [j for k in again for j in range(k * RUN, min(len(words), (k + 1) * RUN))]
        for j, ids in zip(single, theirs([words[j] for j in single]), strict=True):
            same[j] = ids == pool[at[j] : at[j + 1]].tolist()
        alike = np.fromiter((sp.normalize(t or "") == own for t, own in zip(texts, normal, strict=True)), bool, len(texts))
        return alike & (common.per_row(~same[which], np.concatenate(([0], np.cumsum(counts)))) == 0)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined, markers as spaces, the dummy prefix taken off, controls left out."""
        out, raw = [], bytearray()
        for i in ids:
            piece, _, kind = self.model.pieces[i]
            if kind == BYTE:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(piece.replace(MARK, " "))
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of many id lists, through the bytes of each piece at once where no piece needs more."""
        table, offs = self._table()
        if self.model.unk in ids:
            return [self.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        n = (offs[1:] - offs[:-1])[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(offs[:-1][ids] - ends[:-1], n) + np.arange(ends[-1])
        raw = table[at].tobytes()
        cut = ends[bounds].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
        return [x[1:] if self.model.dummy_prefix and x.startswith(" ") else x for x in out]

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_made"):
            raw = [bytes([self.bytes_of[k]]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for k, (p, _, kind) in enumerate(self.model.pieces)]
            self._made = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        return self._made


@lru_cache(2)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


@lru_cache(2)
def processor(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def _raw(path: str) -> bytes:
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", check: bool = True) -> DataFrame:
    """All columns of docs and: pieces (the ids), n_pieces, parity (null unless checked). The model is read on the driver and broadcast; vocabularies are small."""
    raw = docs.sparkSession.sparkContext.broadcast(_raw(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        own = codec(raw.value)
        for batch in batches:
            for part in common.pieces(batch, text, PIECE):
                ids, bounds = own.encode(part.column(text).to_pylist())
                same = pa.array(own.parity()) if check else pa.nulls(part.num_rows, pa.bool_())
                yield part, [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(bounds)), same]

    return common.extend(docs, run, [("pieces", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("parity", T.BooleanType())])


def decode(rows: DataFrame, model: str = MODEL, ids: str = "pieces", to: str = "decoded") -> DataFrame:
    """All columns and the text of each row's ids; null ids give a null text."""
    raw = rows.sparkSession.sparkContext.broadcast(_raw(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        own = codec(raw.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                col = part.column(ids)
                size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                texts = own.texts(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(size, dtype=np.int64))))
                yield part, [pa.array([None if null else t for t, null in zip(texts, col.is_null().to_pylist(), strict=True)], pa.string())]

    return common.extend(rows, run, [(to, T.StringType())])


def ids_sha256(ids: list[int]) -> str:
    """Digest of little-endian 32-bit ids."""
    return hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def digests(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row a document: doc_id, n_pieces, pieces_sha256, parity, round_trip (decoding gives the normal form's text back), and with `keep` the pieces themselves."""
    raw = docs.sparkSession.sparkContext.broadcast(_raw(model))
    kept = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        names = ["doc_id", "n_pieces", "pieces_sha256", "parity", "round_trip", *["pieces"] * keep]
        for batch in batches:
            for part in common.pieces(batch, "text", PIECE):
                texts = part.column("text").to_pylist()
                ids, bounds = own.encode(texts)
                same, back = own.parity(), own.texts(ids, bounds)
                at = bounds.tolist()
                sha = [hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                plain = [own.plain(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sha), pa.array(same), pa.array([x == y for x, y in zip(plain, back, strict=True)]), *[pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))] * keep], names=names)
        common.release()

    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], *[T.StructField(n, t) for n, t in (("n_pieces", T.LongType()), ("pieces_sha256", T.StringType()), ("parity", T.BooleanType()), ("round_trip", T.BooleanType()), *[("pieces", T.ArrayType(T.IntegerType()))] * keep)]]))
