"""Codes and whitening against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import codes, vectors, whitening

ROWS = "vec_id long, embedding array<double>, label int, code string, i string"


def some_vectors(n=330, width=8, seed=0, wide=1.0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.gauss(0, wide) for _ in range(width)]
        if k % 3 == 0:  # a third are one vector
            v = [0.25, -0.125, 0.5, 0.75, -1.0, 0.0, 1.0, 0.3][:width]
        rows.append((k * 7 % n, v, None if k % 7 == 0 else k % 4, "x", "y"))
    rows += [(n, None, 1, "x", "y"), (n + 1, [], 1, "x", "y"), (n + 2, [None] + [0.0] * (width - 1), 1, "x", "y"), (n + 3, [math.nan] + [0.0] * (width - 1), 1, "x", "y"), (n + 4, [math.inf] + [0.0] * (width - 1), 1, "x", "y"), (n + 5, [1.0], 1, "x", "y")]
    return [*rows, (10 % n, [0.1] * width, 3, "x", "y"), rows[4], (None, rows[5][1], 2, "x", "y")]


def good(rows, width=8):
    return [r for r in rows if r[1] and len(r[1]) == width and all(c is not None and math.isfinite(c) for c in r[1])]


def plain_codes(rows, width=8, entries=256, rounds=4):
    kept = good(rows, width)
    whole = [[math.floor(1024 * c) for c in r[1]] for r in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    each = -(-width // 4)
    cuts = [(min(k * each, width), min(k * each + each, width)) for k in range(4)]
    books = [[whole[k][a:b] for k in first] for a, b in cuts]

    def assign():
        out = []
        for w in whole:
            found = []
            for (a, b), book in zip(cuts, books, strict=True):
                found.append(min((sum((x - y) ** 2 for x, y in zip(w[a:b], e, strict=True)), k) for k, e in enumerate(book)))
            out.append(found)
        return out

    for _ in range(rounds):
        near = assign()
        for p, (a, b) in enumerate(cuts):
            for e in range(len(books[p])):
                own = [w[a:b] for w, f in zip(whole, near, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in near]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    fits = lambda x: x if x < 1 << 63 else None
    return [(r[0], "".join(f"{k:02x}" for _, k in f), fits(e), fits(by_label[r[2]]), digest) for r, f, e in zip(kept, near, errors, strict=True)]


def by_str(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("width,wide,entries", [(8, 1.0, 256), (8, 1e9, 32), (6, 1.0, 16), (3, 0.01, 256)])
def test_codes_equal_a_plain_version(spark, width, wide, entries):
    rows = some_vectors(width=width, wide=wide, seed=width)
    got = codes.compressed(spark.createDataFrame(rows, ROWS).repartition(3), most=entries).collect()
    assert by_str(got) == by_str(plain_codes(rows, width, entries))


def test_codes_of_few_and_no_rows(spark):
    rows = some_vectors(n=5)
    assert by_str(codes.compressed(spark.createDataFrame(rows, ROWS)).collect()) == by_str(plain_codes(rows))
    assert codes.compressed(spark.createDataFrame([], ROWS)).collect() == []
    assert codes.compressed(spark.createDataFrame([r for r in rows if r[1] is None], ROWS)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "huge"])
def test_tree_finds_the_lowest_index_of_the_nearest(kind):
    rng = np.random.default_rng(3)
    entries = {
        "spread": rng.integers(-900, 900, (256, 5)),
        "grid": rng.integers(0, 3, (200, 4)),  # ties everywhere
        "copies": np.repeat(rng.integers(-50, 50, (10, 4)), 25, 0),
        "huge": rng.integers(-(1 << 61), 1 << 61, (40, 3)),
    }[kind]
    tree = codes.Tree(entries, leaf=4)
    values = np.concatenate((entries[:60], rng.integers(entries.min(), entries.max() + 1, (150, entries.shape[1]))))
    index, found = tree.nearest(values)
    for v, i, d in zip(values.tolist(), index, found, strict=True):
        assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(entries.tolist()))


def test_tree_leaves_out_far_balls():
    rng = np.random.default_rng(5)
    centres = rng.integers(-100_000, 100_000, (16, 4)).repeat(16, 0)
    entries = centres + rng.integers(-20, 20, centres.shape)
    tree = codes.Tree(entries)
    tree.nearest(entries[rng.integers(0, 256, 1000)])
    assert tree.visited < 1000 * 6  # of 16 leaves, one of them twice


def test_decoded_code_is_near_its_vector(spark):
    rows = some_vectors()
    df, width = vectors.usable(spark.createDataFrame(rows, ROWS), "vec_id", "embedding")
    books = codes.learnt(df, width)
    for r in codes.encoded(df, width, books).where("error = 0").collect():
        assert any(max(abs(a - b) for a, b in zip(books.decoded(r.code), v, strict=True)) <= 0.5 / 1024 for i, v, *_ in good(rows) if i == r.i)


def exact_scatter(rows):
    whole = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    n, d = len(whole), len(whole[0])
    sums = [sum(c) for c in zip(*whole, strict=True)]
    cross = [[n * sum(w[i] * w[j] for w in whole) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return whole, n, sums, cross


@pytest.mark.parametrize("wide", [1.0, 3e4, 1e14])
def test_whitening_is_exact_until_the_decomposition(spark, wide):
    rows = some_vectors(wide=wide)
    got = whitening.whitened(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    kept = good(rows)
    whole, n, sums, cross = exact_scatter(kept)
    assert len(got) == 8 * len(kept) and {r.n for r in got} == {n}
    big = [sum((n * x - s) ** 2 for x, s in zip(w, sums, strict=True)) for w in whole]
    assert sorted(int(r.deviation_digits) for r in got if r.component == 1) == sorted(big)
    assert all(r.deviation == (int(r.deviation_digits) if int(r.deviation_digits) < 1 << 63 else None) for r in got)
    v = np.array([[float(Fraction(c, n * n)) for c in row] for row in cross])
    values = np.linalg.eigvalsh(v)[::-1]
    shares = {r.component: r.explained for r in got}
    assert np.allclose([shares[k + 1] for k in range(8)], values / np.trace(v), rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-6
    w = {(r.vec_id, r.component): r.whitened for r in got}
    ids = sorted({r.vec_id for r in got if r.vec_id not in (None, 10)})
    for k in range(1, 9):  # the projection is linear in x - S/n, with unit length times 1/sqrt(e)
        x = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(whole[[r[0] for r in kept].index(i)], sums, strict=True)] for i in ids])
        y = np.array([w[i, k] for i in ids])
        direction = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose(v @ direction, values[k - 1] * direction, atol=1e-7 * np.abs(values[0] * direction).max())
        assert math.isclose(direction @ v @ direction, 1, rel_tol=1e-6)


def test_whitening_without_full_rank_and_without_rows(spark):
    flat = [(k, [float(k), 2.0 * k, 1.0], 0, "x", "y") for k in range(20)]
    got = whitening.whitened(spark.createDataFrame(flat, ROWS)).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True}
    assert max(r.identity_error for r in got) < 1e-9
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5], 0, "x", "y")] * 3, ROWS)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    assert whitening.whitened(spark.createDataFrame([], ROWS)).collect() == []


def test_more_components_than_asked(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, rng.normal(size=40).tolist(), 0, "x", "y") for k in range(100)], ROWS)
    got = whitening.whitened(df).groupBy("vec_id").agg(F.max("component").alias("m"), F.count("*").alias("c")).collect()
    assert {(r.m, r.c) for r in got} == {(32, 32)}


def test_scatter_of_any_size():
    rng = np.random.default_rng(2)
    y = rng.integers(-(1 << 61), 1 << 61, (300, 3))
    s = whitening.Scatter(3)
    s.add(y)
    z = np.concatenate((np.ones((300, 1), object), y.astype(object)), 1)
    assert (s.flush() == z.T @ z).all()
    parts = vectors.limbs(np.array([-(10**40), 10**40, 0, -1], object), 6)
    assert vectors.unlimbed(parts).tolist() == [-(10**40), 10**40, 0, -1]
