"""Archives against a plain reader, and reading by ranges."""

from __future__ import annotations

import gzip
import hashlib
import io
import random

import pytest
from tessera.llm import warc
from tessera.llm.common import written

PAGES = "page_id long, url string, html string, kind string"


def some_pages():
    rng = random.Random(4)
    long = ["é" * 600, "<p>" + "x" * 1500, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(200_000))]
    rows = [(k, f"http://a/{k}", rng.choice([*long[:2], "short", "", None, f"page {k} " * 300]), "clash") for k in range(60)]
    rows += [(60, None, long[2], "clash"), (61, "http://b\r\nX: y", long[2], "clash"), (None, "http://c", long[0], "clash"), (None, "http://c", "alone " * 300, "clash"), (None, "http://d", "alone " * 300, "clash")]
    return [*rows, rows[3], rows[3]]


def plain(rows):
    best = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 1000:
            best.setdefault(h, []).append(i)
    best = {h: max((i for i in ids if i is not None), default=None) for h, ids in best.items()}
    out = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        r = best.get(h)
        revisit = r is not None and i != r
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", r if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_a_plain_version(spark):
    rows = some_pages()
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_are_plain_gzip_and_any_ranges_give_the_same(spark, tmp_path):
    rows = some_pages()
    to = f"file://{tmp_path}/w"
    manifest = written(warc.archived(warc.payloads(spark.createDataFrame(rows, PAGES).coalesce(1)), to, most=30_000))
    names = [r.file for r in manifest.collect()]
    assert len(names) > 1  # archives are rolled
    text = b"".join(gzip.decompress((tmp_path / "w" / n).read_bytes()) for n in names)
    assert text.count(b"WARC/1.1\r\n") == len(rows) and text.count(b"WARC-Type: revisit") == sum(r[3] == "revisit" for r in plain(rows))
    assert b"\r\nX: y" not in text  # a url can't add a header
    for split in (97, 1000, 50_000, 1 << 30):
        found = warc.records(manifest, to, split, keep=True).collect()
        assert len(found) == len(rows) and not any(r.broken for r in found)
        for r in found:
            if r.kind == "response":
                assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest == r.declared_digest and len(r.payload) == r.payload_bytes


def nested(tmp_path, cut=0):
    """An archive with a record whose payload is an archive, stored by deflate as it is."""
    inner = b"".join(b"".join(warc.member(*warc.record("response", f"urn:in{k}", "u", "d", 5, "9", None), b"inner")) for k in range(40))
    parts, ids = [], []
    for k, payload in enumerate((b"first" * 10, inner, b"last" * 10)):
        digest = hashlib.sha1(payload).hexdigest()
        parts.append(b"".join(warc.member(*warc.record("response", f"urn:out{k}", "u", digest, len(payload), str(k), None), payload, level=0 if k == 1 else 6)))
        ids.append(f"urn:out{k}")
    data = b"".join(parts)
    (tmp_path / "n.warc.gz").write_bytes(data[: len(data) - cut])
    return ids, len(data) - cut


@pytest.mark.parametrize("split", [300, 1111, 3000])
def test_an_archive_inside_a_record_is_no_record(spark, tmp_path, split):
    ids, size = nested(tmp_path)
    manifest = spark.createDataFrame([("n.warc.gz", size, 3)], warc.MANIFEST)
    loose = warc.scanned(warc.ranges(manifest, split), f"file://{tmp_path}")
    assert {r.record_id for r in loose.collect()} > set(ids)  # single ranges are misled
    found = warc.records(manifest, f"file://{tmp_path}", split).collect()
    assert sorted(r.record_id for r in found) == ids and not any(r.broken for r in found)


def test_broken_members_are_told(spark, tmp_path):
    _, size = nested(tmp_path, cut=9)
    manifest = spark.createDataFrame([("n.warc.gz", size, 3)], warc.MANIFEST)
    found = {r.record_id: r.broken for r in warc.records(manifest, f"file://{tmp_path}").collect()}
    assert found == {"urn:out0": False, "urn:out1": False, "urn:out2": True}


def test_magic_without_a_record(tmp_path):
    junk = warc.MAGIC + b"\x00" * 20 + gzip.compress(b"no record\r\n\r\n") + b"\x1f\x8b"
    good = b"".join(warc.member(*warc.record("response", "urn:a", "u", "d", 3, None, None), b"abc"))
    (tmp_path / "j").write_bytes(junk + good + b"\x1f")
    disk, _ = warc.opened(f"file://{tmp_path}")
    found = list(warc.owned(warc.Source(disk, f"{tmp_path}/j"), 0, 1 << 20, keep=True))
    assert [(r.offset, r.payload, r.broken) for r in found] == [(len(junk), b"abc", False)]
    assert io.BytesIO(good).read(3) == warc.MAGIC


def test_revisits_of_a_hot_payload_and_unknown_responses(spark):
    rows = [(k, "u", "hot " * 400 if k % 3 else f"own {k} " * 200, "x") for k in range(600)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    lost = spark.createDataFrame([("f", 0, 0, 9, "revisit", "urn:x", "u", "1", "urn:gone", "d", None, None, False, None)], warc.READ)
    assert [tuple(r) for r in warc.resolved(lost).collect()] == [("1", "u", "revisit", "urn:x", None, None, None)]
