"""Each operator against brute force on small tables, and its edge cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tessera.llm import common, decontaminate, fingerprints, jaccard, language, lines, pieces, quality, shards, simhash, substrings, urls

DOCS = "doc_id long, text string"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def some_docs(seed=0, n=60):
    """Short prose with copies, near copies, shared passages, nulls, empty texts and repeated rows."""
    rng = random.Random(seed)
    words = ["the", "of", "andré", "straße", "ration", "Erwin", "x1", "niño", "late", "in", "over", "mill", "12", "wind"]
    texts = []
    shared = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 90)))
        kind = rng.randrange(6)
        if kind == 0 and texts:
            t = rng.choice(texts)
        elif kind == 1 and texts:
            t = rng.choice(texts).replace("late", "LATE", 1) + "!"
        elif kind == 2:
            t = f"{t[:50]}\n{shared}\n{t[50:]}"
        texts.append(t)
    texts += [None, "", "   \n\t", "a" * 5000, "é" * 60]
    rows = list(enumerate(texts))
    return [*rows, rows[3], (None, "no id " * 20), (n + 20, shared * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_str(rows):
    return sorted(map(tuple, rows), key=str)


# ---- language


def test_language_is_learnt_and_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.predicted(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def brute_kneser_ney(words, alphabet):
    """P(character | history) by the definition, with dictionaries: words of one language with a space on either side."""
    from collections import Counter

    order = language.ORDER
    raw = {k: Counter() for k in range(1, order + 1)}
    for w in words:
        for e in range(1, len(w)):
            for k in range(1, order + 1):
                if e - k + 1 >= 0:
                    raw[k][w[e - k + 1 : e + 1]] += 1
    counts = {order: dict(raw[order])}
    for k in range(order - 1, 0, -1):
        c = Counter()
        for g in raw[k + 1]:
            c[g[1:]] += 1
        starts = Counter(w[:k] for w in words if k > 1 and len(w) >= k)
        counts[k] = dict(c + starts)
    d = {}
    for k, c in counts.items():
        one, two = (sum(v == x for v in c.values()) for x in (1, 2))
        d[k] = one / (one + 2 * two) if one and two else 0.5

    def p(char, history, k, floor):
        if k == 0:
            return floor
        own = {g: n for g, n in counts[k].items() if g[:-1] == history}
        if not own:
            return p(char, history[1:], k - 1, floor)
        total = sum(own.values())
        return max(own.get(history + char, 0) - d[k], 0) / total + d[k] * len(own) / total * p(char, history[1:], k - 1, floor)

    return lambda char, history, floor: p(char, history[-(order - 1) :], min(order, len(history) + 1), floor)


def test_language_equals_brute_force_kneser_ney(spark):
    """Every probability of a small corpus, against the definition; of each history they sum to one with the floor's share."""
    words = [" abba ", " abba ", " abba ", " abc ", " baba ", " baba ", " cab ", " abcabc ", " c "]
    grams, counts = language._counts(sorted(set(words)), np.array([words.count(w) for w in sorted(set(words))]))
    m = language.build(spark.createDataFrame([("x", g, int(n)) for g, n in zip(grams.tolist(), counts, strict=True)], "l string, g string, n long"))
    want = brute_kneser_ney(words, "abc ")
    for history in (" ", " a", " ab", " ba", " abb", " abca", " zz", " cc"):
        p = []
        for c in "abc z":
            whole, part = m.costs([history + c])[0][0, 0], m.costs([history])[0][0, 0]
            p.append(2 ** (part - whole))
            assert abs(p[-1] - want(c, history, m.floor)) < 1e-5
        assert 0.8 < sum(p[:4]) <= 1.0001  # the floor has the rest


def test_beyond_the_arrays_bound_nothing_is_dropped(spark):
    """With more n-grams than the arrays may hold the tables stay in Spark, and every cost, score and limit is what the arrays give."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9000, None, "en"), (9001, "", "fr"), (9002, "12 !!", None), (None, "the words of a row without an id", "en"), (9003, "der die das " * 3000, None)]
    d = d.unionByName(spark.createDataFrame([*odd, odd[4]], d.schema))
    arrays, joined = language.fit(d), language.fit(d, most_grams=10)
    assert isinstance(joined, language.Joined) and isinstance(arrays, language.Model)
    assert arrays.languages == joined.languages and arrays.temperature == joined.temperature and np.allclose(arrays.limits, joined.limits, atol=1e-4)
    for reject in (False, True):
        a, b = (sorted(map(tuple, language.identify(d, m, reject=reject).collect()), key=str) for m in (arrays, joined))
        assert [r[:2] for r in a] == [r[:2] for r in b] and [r[4] for r in a] == [r[4] for r in b]
        assert np.allclose([r[2:4] for r in a], [r[2:4] for r in b], atol=1e-4)


def test_signs_of_numbers_are_no_letters(spark):
    d = spark.createDataFrame([(k, "der die das und", "de") for k in range(30)] + [(90, "½ ² 12 Ⅷ", None), (91, "ª", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("l", F.lit(1))
    got = {r.doc_id: r.lang_pred for r in language.predicted(d).collect()}
    assert (got[90], got[91]) == ("und", "de")


def test_language_edges(spark, none):
    d = spark.createDataFrame([(k, "der die das und nicht wir sind " * 3, "de") for k in range(30)] + [(k, "the and of we are not with " * 3, "en") for k in range(30, 60)] + [(60, None, "de"), (61, "123 !!", "en"), (62, "und " * 40_000, None), (63, "", "")], "doc_id long, text string, lang string")
    r = {x.doc_id: x for x in language.predicted(d).collect()}
    assert (r[60].lang_pred, r[61].lang_pred, r[63].lang_pred) == ("und",) * 3
    assert r[60].score == 0
    assert r[62].lang_pred == "de"
    assert language.predicted(none.withColumn("lang", F.lit("x"))).count() == 0
    model = language.fit(d)
    model.limits = np.array([0.0] * len(model.languages))
    assert {x.lang_pred for x in language.identify(d, model).collect()} == {"und"}


# ---- substrings


def brute_removed(rows):
    low = {}
    rows = [(-(2**63) if i is None else i, (t or "").encode(), i) for i, t in rows]
    for i, t, _ in rows:
        for k in range(len(t) - 49):
            low[t[k : k + 50]] = min(low.get(t[k : k + 50], i), i)
    out = []
    for i, t, own in rows:
        m = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if low[t[k : k + 50]] < i:
                m[k : k + 50] = True
        out.append((own, len(t), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    return by_str(out)


@pytest.mark.parametrize("bucket", [substrings.BUCKET, 2000])
def test_substrings_equal_brute_force(docs, bucket):
    assert by_str(substrings.report(docs, bucket=bucket).collect()) == brute_removed([(r.doc_id, r.text) for r in docs.collect()])


def test_substrings_empty(none):
    assert substrings.report(none).count() == 0


def test_pieces_and_buckets_exchange_few_rows(spark):
    """Rows between the steps are a lot's and a shelf's, not one for each piece and bucket, which grow with the square of the input."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(270_000))
    d = spark.createDataFrame([(k, text) for k in range(5)], DOCS).coalesce(1)
    corpus, gone = substrings.removed(d, bucket=50_000)
    assert corpus.count() == 5
    assert gone.count() <= 27  # 10.8 MB, shelves of 400,000 bytes, one lot
    assert [r.n_removed for r in substrings.report(d).orderBy("doc_id").collect()] == [0, *[len(text)] * 4]


@pytest.mark.parametrize("block", [10_000, 97])
@pytest.mark.parametrize("length", [4, 30])
def test_insertion_equals_a_naive_suffix_array(block, length):
    """Suffix order, transform and common prefixes of documents of all lengths, short periods and copies among them, in memory and in external files."""
    rng = np.random.default_rng(1)
    docs = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(0, 40, 30)]
    docs += [b"a" * 39, b"ab" * 15, docs[3], docs[4] + b"\0", b"\xfe\0\0", docs[5][1:]]
    size = np.array([len(d) for d in docs])
    at = np.cumsum(size) - size
    start, before, common = substrings.insertion(np.frombuffer(b"".join(docs), np.uint8), at, size, length, block)
    want = sorted((d[k:], i, k) for i, d in enumerate(docs) for k in range(len(d) + 1))
    assert start.tolist() == [int(at[i]) + k for _, i, k in want]
    assert before.tolist() == [docs[i][k - 1] if k else substrings.NONE for _, i, k in want]
    shared = [next((n for n, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(want, want[1:], strict=False)]
    assert common.tolist() == [0, *(min(n, length) for n in shared)]
    found, cls = substrings.classes(np.frombuffer(b"".join(docs), np.uint8), at, size, length, block)
    strings = [s[:length] for s, _, _ in want if len(s) >= length]
    many = sorted({s for s in strings if strings.count(s) > 1})
    text = b"".join(docs)
    assert [many[c] for c in cls] == [text[s : s + length] for s in found.tolist()] == [s for s in strings if s in many]


def test_text_of_a_short_period_makes_few_fragments(spark):
    for period in (b"a", b"abc", b"abcdefghijklmnop"):
        data = np.frombuffer(period * (100_000 // len(period)), np.uint8)
        h, first, count = substrings.fragments(data, np.array([0, len(data)]))
        assert count.sum() == len(data) - 49
        assert (count + 49).sum() < 4.5 * len(data)
        assert (first[1:] == first[:-1] + count[:-1]).all()
    rows = [(3, "ab" * 400), (1, "a" * 700), (2, "x" + "a" * 300 + "y"), (4, "ba" * 30 + "q"), (5, "a" * 2_100_000), (6, "z" * 60)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.report(d).collect()}
    assert got == {1: (0, 0), 2: (300, 1), 3: (0, 0), 4: (60, 1), 5: (2_100_000, 1), 6: (0, 0)}


# ---- pieces


def test_pieces_agree_with_the_library_and_come_back(docs):
    sp = pieces.processor(open(pieces.MODEL, "rb").read())
    rows = pieces.decode(pieces.encode(docs)).collect()
    for r in rows:
        assert list(r.pieces) == sp.encode(r.text or "")
        assert r.parity
        assert r.decoded == sp.decode(sp.encode(r.text or ""))
    assert all(r.round_trip for r in pieces.digests(docs).collect())


def test_pieces_odd_texts():
    c = pieces.Codec(open(pieces.MODEL, "rb").read())
    sp = pieces.processor(c.raw)
    texts = ["", " ", "  a  b ", "\0 x\0", "▁▁a ▁", "日本語 テスト 🎉", "\n\n\ta\n", "<s> hi </s> <0x41>", "a" * 3000, None, "é" * 50 + " " * 70]
    ids, bounds = c.encode(texts)
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == sp.encode(t or "")
        assert c.decode(ids[a:b].tolist()) == sp.decode(ids[a:b].tolist())


def test_unigram_models_are_rebuilt(spark):
    """A tiny unigram model in wire format: the best segmentation by scores."""
    import struct

    def field(n, wire, raw):
        return bytes([n << 3 | wire]) + raw

    def text(n, raw):
        return field(n, 2, bytes([len(raw)]) + raw)

    def piece(p, score, kind=1):
        return text(1, text(1, p.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    raw = piece("<unk>", 0, 2) + piece("▁a", -1.0) + piece("b", -1.5) + piece("▁", -3.0) + piece("a", -2.0) + piece("ab", -1.2) + text(2, field(3, 0, b"\x01")) + text(3, field(3, 0, b"\x01"))
    c = pieces.Codec(raw)
    names = [p for p, _, _ in c.model.pieces]
    ids, _ = c.encode(["ab b"])
    assert [names[i] for i in ids] == ["▁a", "b", "▁", "b"]


def test_character_maps_and_byte_fallback_agree_with_the_library():
    """A unigram model with the library's own character map, all byte pieces and a few words: ids and normal forms of odd texts are the library's."""
    import struct

    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def text(n, raw):
        return varint(n << 3 | 2) + varint(len(raw)) + raw

    def number(n, value):
        return varint(n << 3) + varint(value)

    def piece(p, score, kind=1):
        return text(1, text(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))

    own = pieces.parse(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    assert own.charsmap
    words = [("▁", -3.0), ("a", -2.0), ("b", -2.1), ("ab", -2.2), ("▁ab", -2.3), ("c", -2.4), ("▁c", -4.0), ("1", -5.0), ("abc", -3.0), ("カ", -6.0)]
    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{k:02X}>", -9.0, 6) for k in range(256)) + b"".join(piece(p, s) for p, s in words)
    raw += text(2, number(3, 1) + number(35, 1)) + text(3, text(2, own.charsmap) + number(3, 1) + number(4, 1) + number(5, 1))
    c, sp = pieces.Codec(raw), pieces.processor(raw)
    texts = ["ab abc", "  ab   c ", "①ａｂ", "ｶab", "é ß 🎉", "a\u200bb\tc\n", "", " ", "ﬁ", "abcabcab" * 30]
    ids, bounds = c.encode(texts)
    assert c.parity().all()
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == sp.encode(t), t
        assert c.decode(ids[a:b].tolist()) == sp.decode(ids[a:b].tolist()), t


def test_parity_sees_a_wrong_normaliser(monkeypatch):
    c = pieces.Codec(open(pieces.MODEL, "rb").read())
    monkeypatch.setattr(pieces.Codec, "normal", lambda self, text: "▁" + text.lower().replace(" ", "▁") if text else "")
    c.encode(["Some Text", "plain text"])
    assert c.parity().tolist() == [False, True]


# ---- simhash


def test_what_goes_is_what_the_construction_finds(monkeypatch):
    """Copies, parts that fragments share, and a copy by reference: all of it comes through the construction, and without it nothing goes."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 70).astype(np.uint8)
    other = np.concatenate((text[5:], rng.integers(97, 123, 5).astype(np.uint8)))
    data = np.concatenate((text, text, other))
    ids, first, count, anchor = np.array([4, 2, 9]), np.array([0, 100, 200]), np.array([21, 21, 21]), np.zeros(3, np.uint32)
    copy = np.array([1]), np.array([7]), np.array([300])
    row, start, size = substrings._settled(ids, first, count, anchor, data, *copy, 50)
    assert sorted(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)) == [(0, 0, 70), (2, 200, 65), (3, 300, 70)]
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(substrings, "insertion", lambda *a, **k: (none, none, none))
    assert not len(substrings._settled(ids, first, count, anchor, data, *copy, 50)[0])


def brute_classes(rows):
    marks = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        marks.append((i, sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(marks)))
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= 4:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    low = {}
    for k, (i, _) in enumerate(marks):
        low[root[k]] = min((v for v in (low.get(root[k]), i) if v is not None), default=None)
    return by_str((i, f"{fp:016x}", low[root[k]]) for k, (i, fp) in enumerate(marks))


@pytest.mark.parametrize("limit", [simhash.LIMIT, 3])
def test_simhash_equals_brute_force(docs, limit):
    assert by_str(simhash.near_duplicates(docs, limit=limit).collect()) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_the_tally_rejects_pairs():
    """Two fingerprints in one posting that share too few positional bytes are not retained, however few bits differ; those that share enough are verified."""
    a = np.array([0x0101010101010101] * 3, np.uint64)
    b = np.array([0x0101010100000000 ^ 0x01010101, 0x0101010103030303, 0x01010101FFFFFFFF], np.uint64)
    assert simhash.tally(a ^ b).tolist() == [8, 4, 4]
    few = np.array([0x0303030303010101], np.uint64)  # five bits, three bytes shared
    assert simhash.tally(a[:1] ^ few).tolist() == [3]
    zero = np.zeros(3, np.int64)
    assert len(simhash.retained(a[:1], few, zero[:1], 1, 5)) == 1  # five bits may differ: three bytes are enough
    assert len(simhash.retained(a[:1], few, zero[:1], 1, 4)) == 0
    assert simhash.retained(a, b, zero, 1, 4).tolist() == [0, 1]
    # each pair is retained in one posting only
    x, y = np.array([0x1122334455667788], np.uint64), np.array([0x1122334455667789], np.uint64)
    for depth in (1, 2, 3, 4):
        met = [len(simhash.retained(x, y, np.array([k]), depth, 4)) for k, (p, q) in enumerate(zip(simhash.keys(x, depth, 4)[0], simhash.keys(y, depth, 4)[0], strict=True)) if p == q]
        assert sum(met) == 1


def test_long_postings_are_split(spark):
    """Fingerprints that share seven bytes: every posting is over the limit down to blocks, and no pair is lost."""
    rng = np.random.default_rng(4)
    fps = sorted({0x0102030405060000 | int(x) for x in rng.integers(0, 1 << 16, 300)})
    nodes = spark.createDataFrame([(x, x) for x in fps], "fp long, rep long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes, limit=40)).collect()}
    root = {x: x for x in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == {k: v for k, v in root.items() if sum(w == v for w in root.values()) > 1}


def test_rows_that_share_an_id_keep_their_own_classes(spark):
    words = {w: " ".join(f"{w}{k}" for k in range(30)) for w in "wuv"}
    rows = [(1, words["w"], 1), (5, words["w"], 2), (5, words["u"], 3), (5, words["u"], 3), (None, words["v"], 4), (None, words["w"], 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, gone_i long")
    for op in (simhash, jaccard):
        assert by_str(op.representatives(d).collect()) == by_str([(1, words["w"], 1), (5, words["u"], 3), (None, words["v"], 4)])


def test_chains_of_links_are_followed(spark):
    """Fingerprints in a chain, each four bits from the next, are one class."""
    fps, x = [], 0
    for k in range(16):
        fps.append(x - (1 << 64) if x >> 63 else x)
        x ^= 0xF << (4 * k)
    nodes = spark.createDataFrame([(fp, 100 - k) for k, fp in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    assert got == {100 - k: 85 for k in range(16)}


def test_rounds_end_at_stars(spark, monkeypatch):
    """Links that are stars need no round, a chain none after it is one; so further links start from what is joined."""
    cuts, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: cuts.append(1) or cut(df))
    star = simhash.components(spark.createDataFrame([(1, 2), (3, 1), (7, 8), (8, 7), (9, 9)], "a long, b long"))
    assert {r.node: r.component for r in star.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(cuts) == 1
    more = jaccard._extended(star, spark.createDataFrame([], "a long, b long"))
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, star.collect()))
    assert len(cuts) == 2
    more = jaccard._extended(star, spark.createDataFrame([(3, 8), (9, 10)], "a long, b long"))
    assert {r.node: r.component for r in more.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 9, 10: 9}


def test_one_of_each_class_stays(docs, none):
    wide = docs.withColumn("component_id", F.lit(1)).withColumn("fp", F.lit(2))
    out = simhash.representatives(wide)
    assert out.columns == wide.columns
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((i for i, c in classes.items() if i == c), key=str)
    assert simhash.near_duplicates(none).count() == 0


# ---- jaccard


def brute_alike(rows):
    """doc_id to component by all pairs of five-word sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 9 * same >= 4 * (len(sets[a]) + len(sets[b])) > 0:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root[k]] = min((v for v in (low.get(root[k]), i) if v is not None), default=None)
    return by_str((i, low[root[k]]) for k, (i, _) in enumerate(rows))


def edited_docs():
    """Texts and copies with one to twelve words changed; many differ in more than four bits of a fingerprint."""
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 8, 30, 120, 400)))]
        for changes in (0, 1, 2, 4, 12):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = f"c{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(v)))
    rng.shuffle(rows)
    return rows


def test_jaccard_classes_equal_brute_force(spark, docs, none):
    for rows, block in (([(r.doc_id, r.text) for r in docs.collect()], jaccard.BLOCK), (edited_docs(), 2)):
        d = spark.createDataFrame(rows, DOCS).repartition(3)
        assert by_str(jaccard.near_duplicates(d, block=block).collect()) == brute_alike(rows)
    assert jaccard.near_duplicates(none).count() == 0


def test_the_stage_goes_through_simhash_first(spark, monkeypatch):
    """SimHash joins what lies within four bits; only what it leaves apart goes to the complement, and no link is lost."""
    rng = random.Random(8)
    long, short = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (2000, 60))
    texts = [long, [*long[:-1], "end"], short, ["start", *short[1:-1], "end"]]  # near copies within four bits, and beyond
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    bits = [(simhash.fingerprint(rows[k][1].encode(), 5) ^ simhash.fingerprint(rows[k + 1][1].encode(), 5)).bit_count() for k in (0, 2)]
    assert bits[0] <= 4 < bits[1]
    seen = {}

    def counted(name, df):  # now: what it reads is deleted when the stage ends
        seen[name] = df.count()
        return df

    for name in ("proposed", "led"):
        monkeypatch.setattr(jaccard, name, lambda *a, f=getattr(jaccard, name), name=name: counted(name, f(*a)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}
    assert seen == {"proposed": 1, "led": 1}


def test_the_stage_drops_what_is_alike_and_no_more(spark):
    import corpus_pipeline

    rows = edited_docs()
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == {i for i, c in brute_alike(rows) if i == c}
    simhash_kept = {i for i, _, c in brute_classes(rows) if i == c}
    assert kept - simhash_kept or simhash_kept - kept


# ---- urls


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = ascii_lower(re.match("[^/?#]*", rest)[0]) if rest is not None else ""
    path = re.match("[^?#]*", rest[len(host) :])[0] if rest is not None else ""
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = ["http://A.Example.ORG/es/x?y", "x://com", "x://a.b.com/fr/?q", "nope", None, "://", "http://EXAMPLE.org/en/1#", "http://notexample.org/es/", "http://" + "a." * 3000 + "org/", "s://com/de/", "s://com/de", "s://org?x/", "É://É.ORG/", "a://b://org/", ""]


@pytest.mark.parametrize("most", [urls.MOST_BROADCAST, 0])
def test_urls_equal_brute_force(spark, most):
    pages = spark.createDataFrame(list(enumerate([*URLS, URLS[0]])), "page_id long, url string").withColumn("verdict", F.lit("old"))
    for clash in ("_url", "_best", "_0", "u", "place", "probe", "best", "r", "weight"):
        pages = pages.withColumn(clash, F.lit(clash))
    got = urls.judge(pages, most_broadcast=most).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {k: brute_verdict(u) for k, u in enumerate([*URLS, URLS[0]])}
    assert all(r[c] == c for r in got for c in ("_url", "_best", "_0", "u", "place", "probe", "best", "r", "weight"))
    assert urls.judge(pages.limit(0), most_broadcast=most).count() == 0


@pytest.mark.parametrize("most", [urls.MOST_BROADCAST, 0])
def test_ties_between_rules(spark, most):
    """Of rules with one string block wins, in whatever order; of equally long rules that with the longer host."""
    pages = spark.createDataFrame([(1, "x://a.com/x"), (2, "x://b.a.org/yz/w")], "page_id long, url string")
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("allow", "b.a.org", "/"), ("block", "a.org", "/y")]
    for order in (rules, rules[::-1]):
        got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, order, most_broadcast=most).collect()}
        assert got == {1: ("a.com/x", "block"), 2: ("b.a.org/", "allow")}


@pytest.mark.parametrize("size", [urls.RANGE, 60])
def test_ranges_of_digests(spark, size):
    rules = spark.createDataFrame([("block" if k % 3 else "allow", f"h{k}.com", f"/{'p' * (k % 4)}") for k in range(200)], "verdict string, host string, path string")
    pages = spark.createDataFrame([(k, f"x://sub.h{k % 250}.com/{'p' * (k % 5)}?q") for k in range(500)], "page_id long, url string")
    want = by_str(urls.verdicts(pages, rules=rules).collect())
    assert by_str(urls.dealt(pages, rules, range_bytes=size).select("page_id", "host", "path", "rule", "verdict").collect()) == want


def test_colliding_digests_are_told_apart():
    a = urls.DigestArray([("block", "evil.com", "/"), ("allow", "good.com", "/")])
    a.arrays[0][:] = xxhash.xxh64_intdigest("good.com/")  # both under one digest
    at = a.mapped().probe(["good.com/", "bad.com/"])
    raw = a.arrays[2].tobytes()
    assert raw[a.arrays[1][at[0]] : a.arrays[1][at[0] + 1]] == b"good.com/"
    assert at[1] == -1


def test_no_rules(spark):
    assert urls.verdicts(spark.createDataFrame([(1, "a://b.org/")], "page_id long, url string"), rules=[]).first().verdict == "allow"


# ---- lines


def test_lines_follow_templates(spark):
    base = "the service took 12 ms to answer the last request of the day"
    d = spark.createDataFrame([(k, f"own text number {'abcdefghij'[k]} only\n{base.replace('12', str(k))}\nshort {k}") for k in range(7)] + [(7, None), (8, ""), (None, base), (20, "x" * 40_000 + "1\n" + base)], DOCS).withColumn("gone", F.lit("kept"))
    got = {r.doc_id: r for r in lines.dedup(d).collect()}
    assert got[None].text == base  # no id: first
    assert got[0].text == "own text number a only\nshort 0"
    assert got[7].text is None
    assert got[8].text == ""
    assert got[20].text == "x" * 40_000 + "1"
    assert got[3].gone == "kept"


def test_a_varying_quarter_is_one_field(spark):
    words = "we met at the old mill near the river on a cold day in may again".split()
    rows = []
    for k in range(6):
        w = list(words)
        w[4] = f"{'abcdef'[k]}word"
        rows.append((k, " ".join(w)))
    assert [r.n_dropped for r in lines.report(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()] == [0, 1, 1, 1, 1, 1]


def test_the_stage_drops_short_lines_too(spark):
    """Lines of one and two tokens recur like any other; numbers alone stay."""
    import corpus_pipeline

    d = spark.createDataFrame([(k, f"Les.\nAnd ornd.\n{'段落' * 40}\npage {k}\n{k}\n12 {k}\n\nown{'abcdef'[k]}") for k in range(6)], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, d, "").collect()}
    assert got[0] == d.where("doc_id = 0").first().text
    assert [got[k] for k in range(1, 6)] == [f"{k}\n12 {k}\n\nown{'abcdef'[k]}" for k in range(1, 6)]


def test_few_lines_go_to_the_join(spark):
    """Lines of templates that do not recur stay out of the join; all lines of those that do are in it."""
    rows = [(k, f"{(k + 1) * 'a'} own line\nshared by all of them") for k in range(40)]
    found = lines.leaves(spark.createDataFrame(rows, DOCS))
    assert (found.count(), lines.sieved(found, lines.recurring(found)).count()) == (80, 40)


def test_lines_plan_is_native(spark, docs, none):
    plan = lines.report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert lines.report(none).count() == 0


# ---- fingerprints


def test_fingerprints_equal_brute_force(docs, none):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = (fingerprints.sketches([x]) for x in (t, e, following))
        common_start = next((n for n in range(min(len(t), len(e))) if t[n] != e[n]), min(len(t), len(e)))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.printed(a)[0], fingerprints.printed(b)[0], float(fingerprints.likeness(a, b)[0]), float(fingerprints.likeness(a, c)[0]), common_start))
    assert by_str(fingerprints.compared(docs).collect()) == by_str(want)
    assert fingerprints.compared(none).count() == 0


def test_sketches_by_their_definition():
    """Bins of span hashes with whole numbers in Python: the prefix polynomial of each span of twelve code points, for both bases, and the smallest mixed hash of each bin."""
    p, mask = fingerprints.PRIME, (1 << 64) - 1

    def sketch(text):
        low = {}
        spans = [text[k : k + fingerprints.SPAN] for k in range(max(1, len(text) - fingerprints.SPAN + 1))] if text else []
        for s in spans:
            h = 0
            for base in fingerprints.BASES:
                h = h << 31 | sum((ord(c) + 1) * pow(base, k, p) for k, c in enumerate(s)) % p
            h = h * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 32
            h = h * 0xD6E8FEB86659FD93 & mask
            low[h >> 58] = min(low.get(h >> 58, h), h)
        return [(low[b] ^ low[b] >> 20) % 4095 + 1 if b in low else 0 for b in range(fingerprints.BINS)]

    rng = random.Random(2)
    texts = ["", "a", "short text", "ß" * 40, "".join(chr(rng.choice((97, 98, 0x20, 0x1F600, 0x10FFFF))) for _ in range(700)), "the quick brown fox jumps over the lazy dog " * 3]
    got = fingerprints.sketches(texts)
    assert got.tolist() == [sketch(t) for t in texts]
    assert fingerprints.printed(got) == ["".join(f"{x:03x}" for x in row) for row in got.tolist()]
    a, b = got[5], got[4]
    filled = [k for k in range(fingerprints.BINS) if a[k] or b[k]]
    assert fingerprints.likeness(got[5:6], got[4:5])[0] == sum(a[k] == b[k] != 0 for k in filled) / len(filled)


def test_span_equality_and_extensions():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, 400), rng.integers(0, 3, 300)
    b[50:150] = a[200:300]
    pa, pb = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for i, j in [(200, 50), (230, 80), (0, 0), (399, 299), (10, 20)]:
        n = 0
        while i + n < 400 and j + n < 300 and a[i + n] == b[j + n]:
            n += 1
        assert pa.extension(i, pb, j) == n
        assert (pa.spans(np.array([i]), min(5, 400 - i, 300 - j)) == pb.spans(np.array([j]), min(5, 400 - i, 300 - j)))[0] == (a[i : i + min(5, 400 - i, 300 - j)] == b[j : j + min(5, 400 - i, 300 - j)]).all()


def test_blocks_do_not_change_a_sketch(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(5000))
    whole = fingerprints.sketches([text, "x", "", text])
    monkeypatch.setattr(fingerprints, "BLOCK", 37)
    assert (fingerprints.sketches([text, "x", "", text]) == whole).all()
    assert (whole[0] == whole[3]).all()


def test_texts_without_characters_fill_no_batch_without_bound():
    """Empty texts take memory for their sketches too, so they are not held until the task ends."""
    import pyarrow as pa

    n = 5000
    rows = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array([b""] * n)], names=["part", "last", "i", "packed"])
    sizes = [b.num_rows for b in fingerprints._run(iter([rows]))]
    assert sum(sizes) == n - 1
    assert max(sizes) <= fingerprints.CHARS // fingerprints.ROW + 1


def test_one_document_follows_itself(spark):
    r = fingerprints.compared(spark.createDataFrame([(5, "abcdef")], DOCS)).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


# ---- shards


def test_shards_keep_every_row_and_versions(spark, docs, none, tmp_path):
    store = shards.Store(spark, str(tmp_path / "s"), target=40_000)
    for k in range(6):
        store.append(docs.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 6 == k), rows=5)
    before = store.manifest()
    after = store.compact(last=True)
    assert len(after["files"]) < len(before["files"])
    assert sum(f["rows"] for f in after["files"]) == docs.count()
    assert sum(f["bytes"] * 2 < store.target for f in after["files"]) <= 1
    assert not store.due(after["files"])
    assert by_str(store.read().collect()) == by_str(docs.collect()) == by_str(store.read(before["version"]).collect())
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(before, [], None)
    assert store.vacuum() > 0
    assert by_str(store.read().collect()) == by_str(docs.collect())
    assert shards.listing(none).count() == 0


def test_two_writers_never_make_one_version(spark, docs, tmp_path):
    """Of many that commit after the same version, one wins; what a dead writer left goes after the grace period only."""
    from concurrent.futures import ThreadPoolExecutor

    store = shards.Store(spark, str(tmp_path / "s"))
    base = store.append(docs)

    def attempt(k):
        try:
            return store.commit(base, [*base["files"], {"name": f"x{k}", "bytes": 1, "rows": 1}], None)["files"][-1]["name"]
        except RuntimeError:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [x for x in pool.map(attempt, range(12)) if x]
    assert len(won) == 1
    assert store.manifest()["files"][-1]["name"] == won[0]
    store = shards.Store(spark, str(tmp_path / "t"))
    store.append(docs)
    store._write(docs, None)  # never committed
    assert store.vacuum() == 0
    assert store.vacuum(grace_seconds=-5) > 0
    assert by_str(store.read().collect()) == by_str(docs.collect())


def test_arrivals_are_one_write(spark, docs, tmp_path):
    store = shards.sharded(docs.withColumn("part", F.lit("mine")), str(tmp_path / "s"), arrivals=5, target=40_000)
    assert store.manifest()["version"] > 5
    assert by_str(store.read().collect()) == by_str((*r, "mine") for r in docs.collect())


def test_shards_run_no_python(spark, docs):
    assert not re.search("Python|Pandas|Arrow", shards.listing(docs)._jdf.queryExecution().toString())


# ---- quality


def test_quality_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.rated(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_weights_are_where_the_pairwise_loss_is_flat():
    """The logistic loss of feature differences over drawn pairs: its gradient, by differences of the loss itself, is nothing at the learnt weights."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(120, 4)), rng.integers(0, 2, 120)
    x[:, 1] += y
    m = quality.learn(x, y, pairs=500)
    z = (x - m.centre) / m.scale
    draw = np.random.default_rng(quality.SEED)
    d = z[draw.choice(np.flatnonzero(y == 1), 500)] - z[draw.choice(np.flatnonzero(y == 0), 500)]

    def loss(w):
        return float(np.mean([np.log1p(np.exp(-v @ w)) for v in d]) + (quality.PENALTY * quality.weight_of(len(w)) / 2 * w**2).sum())

    for k in range(4):
        e = np.zeros(4)
        e[k] = 1e-4
        assert abs(loss(m.weights + e) - loss(m.weights - e)) / 2e-4 < 1e-5
    assert m.weights[1] > max(abs(m.weights[[0, 2, 3]]))


def test_words_and_characters_are_features():
    """Texts of one look but other words differ in their hashed features only."""
    a, b = (common.flat(__import__("pyarrow").array([t])) for t in ("aabb ccdd eeff.", "ggbb hhdd iiff."))
    x, y = quality.features(*a)[0], quality.features(*b)[0]
    assert np.allclose(x[: quality.LOOKS], y[: quality.LOOKS])
    assert not np.allclose(x[quality.LOOKS :], y[quality.LOOKS :])
    lexical = x[quality.LOOKS :].reshape(2, -1)
    assert np.allclose((lexical**2).sum(1), 1)  # square roots of shares


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.rated(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r.predicted == 1 and abs(r.score - 0.5) < 1e-9 for r in out)
    wide = docs.withColumn("score", F.lit("mine")).withColumn("held_out", F.lit(3))
    assert quality.accepted(wide, labels).columns == wide.columns
    assert quality.rated(none, labels).count() == 0


# ---- decontamination


def brute_hits(docs, bench, window=10):
    wanted = {}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for item, text in bench:
        w = word.findall(ascii_lower(text))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and item is not None else 0):
            wanted.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, text in docs:
        w = word.findall(ascii_lower(text))
        hit, items = set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    items |= wanted[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return by_str(out)


@pytest.fixture(scope="module")
def bench(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and r.doc_id is not None]
    items = [(100 + k, " ".join(t.split()[2 : 2 + n])) for k, ((_, t), n) in enumerate(zip(rows, [3, 8, 10, 11, 25, 40, 1, 12] * 20, strict=False)) if k % 3 == 0]
    return spark.createDataFrame([*items, items[0], (7, None), (8, "!!"), (None, "over the wind"), (9, "ZZ top")], "item_id long, text string")


@pytest.mark.parametrize(("chars", "shard"), [(decontaminate.BLOCK_CHARS, decontaminate.SHARD), (decontaminate.BLOCK_CHARS, 1), (2000, decontaminate.SHARD)])
def test_hits_equal_brute_force(docs, bench, chars, shard):
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert by_str(decontaminate.annotate(docs, bench, block_chars=chars, shard=shard).collect()) == want
    assert sum(r[5] for r in want) > 5


def test_one_block_of_the_benchmark_is_held(docs, bench, monkeypatch):
    """Blocks are collected in turn, and none is larger than it must be."""
    sizes, make = [], decontaminate.Phrases.__init__
    monkeypatch.setattr(decontaminate.Phrases, "__init__", lambda self, items, window: sizes.append(sum(len(t) for _, t in items)) or make(self, items, window))
    one = decontaminate.annotate(docs, bench).where("contaminated").count()
    many = decontaminate.clean(docs, bench, block_chars=200)
    assert len(sizes) > 3
    assert max(sizes[1:]) < sizes[0] / 2
    kept = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert sum(kept[r.doc_id] != r.text for r in many.collect() if r.doc_id is not None) <= one


def test_cleaning_takes_one_worker_a_task(docs, bench):
    """Searching and cutting are one Python function: two in a stage would take two workers a task, which stay for later stages."""
    for chars in (decontaminate.BLOCK_CHARS, 2000):
        plan = decontaminate.clean(docs, bench, block_chars=chars)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_cleaning_cuts_spans(spark, none):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Before. One two, three four five six seven eight nine ten! after"), (2, "one two three"), (3, None), (4, "")], DOCS).withColumn("spans", F.lit("mine")).withColumn("TEXTS", F.lit(1))
    out = decontaminate.clean(d, b)
    assert out.columns == d.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["Before. ! after", "one two three", None, ""]
    assert decontaminate.annotate(none, b).count() == 0
    assert decontaminate.annotate(d, b.limit(0)).where("contaminated").count() == 0


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    s = np.concatenate((rng.integers(1, 5, 300), [0]))
    index = decontaminate.FMIndex(s, 4, sample=5)
    patterns = rng.integers(1, 5, (40, 3))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(298) if (s[k : k + 3] == p).all()]


# ---- names, lengths, and texts of all kinds, for every operator

CLASHES = ["_0", "_1", "_2", "i", "t", "th", "fp", "k", "r", "rep", "doc", "mark", "pos", "gone", "gone_i", "gone_doc", "leaf", "first", "rank", "cleaned", "spans", "_own", "_hash", "_doc", "_gone", "_mark", "_rank", "_dropped", "component", "node", "piece", "blob", "bucket"]


def test_any_column_may_stand_beside_an_operators_own(spark, bench):
    """Every operator that returns the documents keeps columns named like its own helpers, their values too."""
    d = spark.createDataFrame([(k, f"own words {'abcdef'[k]} of mine\nthe same long line in all of them here\nend {k}") for k in range(6)], DOCS)
    for c in CLASHES:
        d = d.withColumn(c, F.concat(F.lit(f"{c}:"), "doc_id"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    outs = {
        "lines": lines.dedup(d), "simhash": simhash.representatives(d), "jaccard": jaccard.representatives(d), "quality": quality.accepted(d, labels), "decontaminate": decontaminate.clean(d, bench),
        "pieces": pieces.encode(d).drop("pieces", "n_pieces", "parity"), "scan": decontaminate.scan(d, bench).drop("n_words", "n_hit", "item_ids", "words", "spans"),
    }
    for name, out in outs.items():
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c}:{r.doc_id}" for c in CLASHES if c in out.columns), name
        assert set(d.columns) - set(out.columns) <= {"spans"}, name
    for report in (language.predicted(d.withColumn("lang", F.lit("x"))), substrings.report(d), simhash.near_duplicates(d), lines.report(d), fingerprints.compared(d), shards.listing(d), quality.rated(d, labels), decontaminate.annotate(d, bench), pieces.digests(d)):
        assert report.count() == 6


def test_one_very_long_text(spark):
    """A text of over two million characters, longer than any piece, goes whole through every operator."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10_000)}" for _ in range(345_000)]
    text, tail = " ".join(words), " ".join(f"t{k}" for k in range(60))
    d = spark.createDataFrame([(1, tail, "en"), (2, f"{text} {tail}", "en"), (3, None, None), (4, "", "en")], "doc_id long, text string, lang string")
    assert len(text) > 2 * common.CHUNK_BYTES
    r = {x.doc_id: x for x in substrings.report(d).collect()}
    assert (r[2].n_bytes, r[2].n_removed, r[2].n_spans) == (len(text) + 1 + len(tail), len(tail), 1)
    assert by_str((i, f"{simhash.fingerprint((t or '').encode()):016x}") for i, t in ((1, tail), (2, f"{text} {tail}"), (3, None), (4, ""))) == by_str((x.doc_id, x.fingerprint) for x in simhash.near_duplicates(d).collect())
    b = spark.createDataFrame([(7, " ".join(words[-12:])), (8, " ".join(words[:11]))], "item_id long, text string")
    hit = {x.doc_id: (x.n_words, x.n_hit, x.n_items) for x in decontaminate.annotate(d, b).collect()}
    assert hit == {1: (60, 0, 0), 2: (345_060, 23, 2), 3: (0, 0, 0), 4: (0, 0, 0)}
    p = {x.doc_id: x for x in pieces.digests(d, keep=True).collect()}
    assert all(x.parity and x.round_trip and len(x.pieces) == x.n_pieces for x in p.values())
    assert p[2].n_pieces > 500_000
    assert {x.doc_id: x.n_chars for x in fingerprints.compared(d).collect()} == {1: len(tail), 2: len(text) + 1 + len(tail), 3: 0, 4: 0}
    assert all(0 <= x.score <= 1 for x in quality.rated(d, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")).collect())


# ---- shared helpers


def test_any_names_may_stand_beside_each_other(spark):
    df = spark.createDataFrame([(1, "a", 2)], ["doc_id", "text", "a.b c"]).withColumn("score", F.lit(9))
    out = common.extend(df, lambda batches: ((b, [b.column("doc_id")]) for b in batches), [("score", df.schema["doc_id"].dataType)])
    assert out.columns == ["doc_id", "text", "a.b c", "score"]
    assert tuple(out.first()) == (1, "a", 2, 1)
