"""Scores against a plain optimiser, and texts, ids and tables at the edges that other tests leave out."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import numpy as np
from tessera.llm import common, language, lines, pieces, quality, shards, urls

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def plain_scores(texts, rows, threshold):
    """Scores of texts by the definition: rows (id, text, label) give drawn pairs; the loss is minimised by accelerated gradient steps; the cut is the quantile of sorted utilities."""
    feature = lambda t: quality.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].astype(np.float32).astype(float)
    rows = sorted((i, y, feature(t).astype(np.float32).tobytes(), t) for i, t, y in rows)
    x, y = np.array([feature(t) for *_, t in rows]), np.array([r[1] for r in rows])
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / dev
    draw = np.random.default_rng(quality.SEED)
    a, b = draw.choice(np.flatnonzero(y == 1), quality.PAIRS), draw.choice(np.flatnonzero(y == 0), quality.PAIRS)
    pairs, count = np.unique(np.stack((a, b), 1), axis=0, return_counts=True)
    d, share = z[pairs[:, 0]] - z[pairs[:, 1]], count / count.sum()
    held = np.full(z.shape[1], quality.PENALTY)
    held[quality.LOOKS :] *= quality.LEXICAL
    w = before = np.zeros(z.shape[1])
    step = 1 / (np.linalg.eigvalsh((d * share[:, None]).T @ d).max() / 4 + held.max())
    for k in range(30_000):
        v = w + k / (k + 3) * (w - before)
        grad = held * v - (d / (1 + np.exp(d @ v))[:, None] * share[:, None]).sum(0)
        before, w = w, v - step * grad
        if np.abs(grad).max() < 1e-9:
            break
    u = z @ w
    ranked, n_bad = sorted(u), int((y == 0).sum())
    cut = (ranked[n_bad - 1] + ranked[n_bad]) / 2
    scale = 6.0 / (np.median(u[y == 1]) - np.median(u[y == 0]))
    at = scale * (np.array([(feature(t) - mean) / dev @ w for t in texts]) - cut) + np.log(threshold / (1 - threshold))
    return 1 / (1 + np.exp(-at))


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "plain", "words", "of", "prose", "follow", "here"]) for _ in range(rng.randrange(8, 60))) + "."
    bad = lambda: "".join(rng.choice("$%&!! XQ#<>12") for _ in range(rng.randrange(20, 200)))
    rows = [(k, good() if k % 3 else bad() + (good() if k % 2 else ""), int(k % 3 > 0)) for k in range(60)]
    rows += [(60, "", 0), (61, None, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS)
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in quality.rated(docs, labels).collect()}
    import zlib

    out = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    want = plain_scores([t for _, t, _ in rows], [r for r in rows if r[0] not in out], quality.THRESHOLD)
    assert {i for i, v in got.items() if v[2]} == out
    assert np.allclose([got[i][0] for i, *_ in rows], want, atol=2e-4)
    assert all(got[i][1] == (got[i][0] >= 0.3) for i, *_ in rows)


def test_repeated_ids_do_not_widen_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, y, f=quality.learn, **kw: seen.append(len(x)) or f(x, y, **kw))
    rows = [(1, f"text {k}") for k in range(50)] + [(2, "other words"), (3, "more words"), (4, "$$$")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], LABELS)
    quality.fit(spark.createDataFrame(rows, DOCS), labels)
    assert seen and seen[0] <= 4


def test_one_very_long_text_goes_through_the_others_too(spark):
    """Languages, urls, lines and shards take a text longer than any chunk whole."""
    rng = random.Random(2)
    words = [f"{rng.choice('abc')}{rng.randrange(10_000)}" for _ in range(200_000)]
    long = "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
    assert len(long) > common.CHUNK_BYTES
    d = spark.createDataFrame([(k, f"the plain words of {k}", "en") for k in range(8)] + [(9, long, "en"), (10, "le petit mot " * 9, "fr")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.predicted(d).collect()}.keys() == set(range(11)) - {8}
    r = {x.doc_id: x for x in lines.report(d).collect()}[9]
    assert r.n_lines == 20_000 and r.n_dropped == 0 and r.kept_sha256 == hashlib.sha256(long.encode()).hexdigest()
    s = {x.doc_id: x for x in shards.listing(d).collect()}[9]
    assert s.n_bytes == len(long) and s.text_sha256 == hashlib.sha256(long.encode()).hexdigest()
    path = "/fr/" + "x" * 1_500_000
    p = spark.createDataFrame([(1, f"http://a.com{path}?q", None), (2, "http://" + "h." * 600_000 + "com/de/", None), (3, None, None)], "page_id long, url string, html string")
    got = {x.page_id: (x.path, x.rule, x.verdict) for x in urls.verdicts(p).collect()}
    assert got[1] == (path, "com/fr/", "allow") and got[2][1:] == ("com/de/", "block") and got[3] == ("", None, "allow")


def test_one_very_long_text_goes_through_all_stages(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10_000)}" for _ in range(220_000))
    assert len(long) > common.CHUNK_BYTES
    docs = spark.createDataFrame([(1, "some few words of prose"), (2, long), (3, long + " more words"), (4, "other words stand here")], DOCS)
    for t, schema in (("labels", LABELS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "pieces":
            break
        texts = {r.doc_id: r.text for r in docs.collect()}
        # without labels and benchmark all stay but the near copy of the long text
        assert set(texts) == ({1, 2, 3, 4} if name in ("quality", "lines") else {1, 2, 4}) and texts[2] == long
    assert {r.doc_id for r in docs.where("parity and round_trip").collect()} == {1, 2, 4}


def test_pieces_of_an_empty_table(spark):
    out = pieces.digests(spark.createDataFrame([], DOCS))
    assert out.collect() == [] and "doc_id" in out.columns
