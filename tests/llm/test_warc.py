"""WARC writing, reading and salvage."""

import hashlib

import pytest

from spindle.llm import warc
from spindle.session import scratch_path


def archive(n=6, gz=True):
    parts = []
    for i in range(n):
        p = f"<html>{i} {'x' * 300}</html>".encode()
        r = warc.record_bytes("response", f"http://h/{i}", f"urn:page:{i}", p, hashlib.sha1(p).hexdigest(), None, len(p))
        parts.append(warc.gzip_member(r) if gz else r)
    return parts


@pytest.mark.parametrize("gz", [True, False])
def test_damage_is_skipped_and_logged(gz):
    parts = archive(gz=gz)
    whole = b"".join(parts)
    names = lambda out: [x.headers["warc-record-id"] for x in out if isinstance(x, warc.Record)]
    assert names(warc.salvage(whole)) == [f"<urn:page:{i}>" for i in range(6)]
    for damage in (lambda b: b[:20], lambda b: b"\x00" * len(b), lambda b: b[:-40] + b"?" + b[-39:], lambda b: b + b"junk"):
        bad = [*parts]
        bad[2] = damage(parts[2])
        out = list(warc.salvage(b"".join(bad)))
        found = names(out)
        assert [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)] == [x for x in found if x != "<urn:page:2>"]
        gaps = [x for x in out if isinstance(x, warc.Gap)]
        assert gaps and sum(g.length for g in gaps) + sum(map(len, (parts[i] for i in (0, 1, 3, 4, 5)))) + (
            len(parts[2]) if "<urn:page:2>" in found else 0) == len(b"".join(bad))
    assert list(warc.salvage(b"")) == []
    assert [type(x) for x in warc.salvage(b"no archive")] == [warc.Gap]
    truncated = list(warc.salvage(whole[:-30]))
    assert len(names(truncated)) == 5 and isinstance(truncated[-1], warc.Gap)


@pytest.mark.parametrize("gz", [True, False])
def test_records_with_long_addresses_are_read_back(gz):
    uri = "data:text/html," + "x" * 300_000
    r = warc.record_bytes("response", uri, "urn:page:7", b"page", hashlib.sha1(b"page").hexdigest(), None, 4)
    parts = archive(2, gz)
    out = list(warc.salvage(parts[0] + (warc.gzip_member(r) if gz else r) + parts[1]))
    assert all(isinstance(x, warc.Record) for x in out) and len(out) == 3
    assert out[1].headers["warc-target-uri"] == uri and out[1].payload == b"page"


def test_odd_pages(spark):
    big = "é" * 700
    rows = [(1, "u", big, "x"), (2, None, big, "x"), (3, "a\r\nb", big, "x"), (4, "u", None, "x"), (5, "u", "", "x"), (6, "u", "small", "x"),
            (7, "u", "small", "x"), (8, "u", "WARC/1.1\r\n\r\n" * 100, "x"), (8, "u", "WARC/1.1\r\n\r\n" * 100, "x"), (9, "u", "l" * 3_000_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string").drop("payload_bytes").repartition(3)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(df, folder)
    records, gaps = warc.read_archives(manifest, folder)
    got = {}
    for r in records.collect():
        got.setdefault(r.record_id, []).append(r)
    assert gaps.count() == 0 and sum(map(len, got.values())) == len(rows)
    one = lambda i: got[f"urn:page:{i}"][0]
    assert (one(1).record_type, one(1).refers_to, one(2).refers_to, one(3).record_type) == ("revisit", "urn:page:3", "urn:page:3", "response")
    assert one(1).payload_bytes == 1400 and one(1).payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert one(6).record_type == one(7).record_type == "response" and one(4).payload_bytes == 0
    assert [r.record_type for r in got["urn:page:8"]] == ["response", "response"]
    assert bytes(one(3).payload) == big.encode() and len(one(9).payload) == 3_000_000
    empty = warc.write_archives(df.where("page_id < 0"), scratch_path(spark, "warc-none"))
    assert empty.count() == 0 and warc.read_archives(empty, folder)[0].count() == 0


def test_shared_digests_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", "y" * 1500 if i % 2 else "z" * 1200 + str(i // 4)) for i in range(40)], "page_id long, url string, html string")
    rows = lambda: sorted((r.page_id, r.refers_to or -1) for r in warc.mark_revisits(df, "page_id", "html").collect())
    want = rows()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert rows() == want and (1, 39) in want


@pytest.mark.parametrize("junk", [b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n", b"\x1f\x8b\x08WARC/1.1\r\n", b"WARC/1.1 ", b"-WARC/1.1\r\nA: b"])
def test_salvage_takes_linear_time(junk):
    import time

    took = []
    good = archive(2, gz=False)
    for n in (1 << 19, 1 << 21):
        t = time.perf_counter()
        out = list(warc.salvage(good[0] + junk * (n // len(junk)) + b"\r\n" + good[1]))
        took.append(time.perf_counter() - t)
        assert [x.headers["warc-record-id"] for x in out if isinstance(x, warc.Record)] == ["<urn:page:0>", "<urn:page:1>"]
    assert took[1] < 8 * took[0] + 1


def test_header_end_is_found_far_away_and_not_behind_a_version_line():
    url = "http://h/" + "u" * 300_000
    p = b"x" * 10
    r = warc.record_bytes("response", url, "urn:page:1", p, hashlib.sha1(p).hexdigest(), None, len(p))
    (got,) = warc.salvage(r)
    assert got.payload == p
    inner = warc.record_bytes("response", "http://h/2", "urn:page:2", r, hashlib.sha1(r).hexdigest(), None, len(r))
    (got,) = warc.salvage(inner)  # a record as payload
    assert got.payload == r
