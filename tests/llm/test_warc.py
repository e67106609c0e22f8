import base64
import hashlib
import io
import os
import zlib

import pytest

from constella.llm import _store, warc


def rows(spark, data, path, **more):
    pages = spark.createDataFrame(data, "page_id long, url string, html string, sha string, first int")
    assert warc.write_captures(pages, path, **more) == len(data)
    got = warc.resolve_revisits(warc.assemble(warc.read_records(spark, path)))
    return got


def test_round_trip(spark):
    big = "x" * 300_000 + "é\r\n\r\nWARC/1.1"
    data = [(1, "http://a/1", "same", "q", 1), (2, "http://a/2", "same", "q", 1), (3, None, None, None, None), (4, "u\r\nWARC-Type: response", "", "q", 1), (5, "b", big, "q", 1), (6, "b", big, "q", 1), (7, "c", "only", "q", 1)]
    got = {r.page_id: r for r in rows(spark, data, _store.new_path(spark, "t")).collect()}
    assert len(got) == 7
    for page_id, url, html, *_ in data:
        raw = (html or "").encode()
        first = max(p for p, _, h, *_ in data if (h or "") == (html or ""))
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == page_id else ("revisit", first))
        assert r.response.payload == (raw if first == page_id else None)
        assert r.request.type == "request" and r.metadata.fields["page-id"] == str(page_id)
        assert r.request.target_uri == (url and url.replace("\r", "%0D").replace("\n", "%0A"))


def test_small_payloads_and_repeated_rows(spark):
    got = rows(spark, [(1, "u", "ab", "", 1), (2, "u", "ab", "", 1), (3, "u", "long one", "", 1), (4, "u", "long one", "", 1), (4, "u", "long one", "", 1)], _store.new_path(spark, "t"), min_revisit_bytes=3).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id != 3) == [(1, "response", None), (2, "response", None), (4, "response", None), (4, "response", None)]
    assert [(r.record_type, r.refers_to) for r in got if r.page_id == 3] == [("revisit", 4)]


def test_empty_table(spark):
    path = _store.new_path(spark, "t")
    assert rows(spark, [], path).count() == 0


def parsed(raw):
    return [(r["type"], r.get("error")) for r in warc.parse_archive(io.BytesIO(raw))]


def one(k, level=1):
    return warc._capture(k, f"http://x/{k}", f"body {k}".encode() * (1 + k * 40), warc.payload_digest(b""), None, "2000-01-01T00:00:00Z", ("p", 0, k), level)


def unpacked(raw):
    out = b""
    while raw:
        d = zlib.decompressobj(31)
        out, raw = out + d.decompress(raw), d.unused_data
    return out


THREE = [("request", None), ("response", None), ("metadata", None)]


@pytest.mark.parametrize("chunk", [16, 100, 1 << 18])
def test_archives_of_any_layout(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    by_record = one(1) + one(2) + one(300)
    whole = zlib.compressobj(1, zlib.DEFLATED, 31)
    plain = unpacked(by_record)
    for raw in (by_record, plain, whole.compress(plain) + whole.flush()):
        rows = list(warc.parse_archive(io.BytesIO(raw)))
        assert [(r["type"], r["error"]) for r in rows] == THREE * 3
        assert [r["payload"] for r in rows if r["type"] == "response"] == [f"body {k}".encode() * (1 + k * 40) for k in (1, 2, 300)]
        assert len({(r["offset"], r["position"]) for r in rows}) == 9
    assert parsed(b"") == [] and parsed(b"\r\n\r\n") == []


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_damaged_archives_give_rows(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    raw, plain = one(1) + one(2), unpacked(one(1) + one(2))
    kinds = lambda x: [k for k, _ in parsed(x)]
    assert kinds(raw[:-80]) == ["request", "response", "metadata", "request", "response", "error"]
    # A byte in the middle of the first response: its record is lost, all others stay.
    second = len(zlib.decompressobj(31).decompress(raw)) and len(raw) - len(unused(raw))
    broken = bytearray(raw)
    broken[second + 14] ^= 0xFF
    got = kinds(bytes(broken))
    assert got.count("error") >= 1 and [k for k in got if k != "error"][0] == "request" and [k for k in got if k != "error"][-3:] == ["request", "response", "metadata"]
    bad = plain.replace(b"Content-Length: 0", b"Content-Length: many", 1) if b"Content-Length: 0" in plain else plain.replace(b"Content-Length: ", b"Content-Length: x", 1)
    got = parsed(bad)
    assert [k for k, _ in got].count("error") == 1 and "Content-Length" in dict(got)["error"] and len(got) == 6
    assert kinds(b"junk that is no record at all") == ["error"] and kinds(b"\x1f\x8b\x08 not gzip") == ["error"]
    assert kinds(plain[:-30])[-1] == "error" and kinds(b"WARC/1.1\r\nno end") == ["error"]
    assert kinds(raw + b"tail that is no gzip member") == [k for k, _ in THREE] * 2 + ["error"]


def unused(raw):
    d = zlib.decompressobj(31)
    d.decompress(raw)
    return d.unused_data


def archive(spark, records):
    path = _store.new_path(spark, "t")
    os.makedirs(path.removeprefix("file://"))
    with open(path.removeprefix("file://") + "/crawl.warc.gz", "wb") as out:
        for kind, record_id, links, body in records:
            out.write(warc._record(kind, record_id, [("WARC-Concurrent-To", x) for x in links] + [("Content-Type", "application/warc-fields" if kind == "metadata" else "text/plain")], body, 1))
    return path


def test_transactions_are_linked_either_way(spark):
    path = archive(spark, [
        ("warcinfo", "<w>", [], b"x"),
        # The usual layout of crawlers: all name the response.
        ("response", "<r1>", [], b"one"), ("request", "<q1>", ["<r1>"], b""), ("metadata", "<m1>", ["<r1>"], b"k: 1"),
        # All name the request; two responses name one request.
        ("request", "<q2>", [], b""), ("response", "<r2>", ["<q2>"], b"two"), ("metadata", "<m2>", ["<q2>"], b"k: 2"), ("response", "<r3>", ["<q2>"], b"three"),
        # The metadata record names the request, and the request the response.
        ("metadata", "<m4>", ["<q4>"], b"k: 4"), ("request", "<q4>", ["<r4>"], b""), ("response", "<r4>", [], b"four"),
        # The response names both; records of its own; a second metadata record; a request without a response.
        ("response", "<r5>", ["<q5>", "<m5>"], b"five"), ("request", "<q5>", [], b""), ("metadata", "<m5>", [], b"k: 5"), ("resource", "<r6>", [], b"six"),
        ("response", None, [], b"seven"), ("metadata", "<m1b>", ["<r1>"], b"k: 1b"), ("request", "<q8>", ["<gone>"], b""), ("metadata", "<m8>", ["<q8>"], b"k: 8"),
    ])
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    got = sorted(((r.response and r.response.payload or b"").decode(), r.request and r.request.record_id or "", r.metadata and r.metadata.fields.get("k") or "") for r in rows)
    assert got == sorted([("one", "<q1>", "1"), ("two", "<q2>", "2"), ("three", "<q2>", "2"), ("four", "<q4>", "4"), ("five", "<q5>", "5"), ("six", "", ""), ("seven", "", ""), ("", "", "1b"), ("", "<q8>", "8")])
    first, extra = (next(r for r in rows if r.metadata and r.metadata.fields.get("k") == k) for k in ("1", "1b"))
    assert first.transaction_id == extra.transaction_id


def test_null_identifiers(spark):
    data = [(None, "u", "same", "", 1), (5, "u", "same", "", 1), (None, "u", "other", "", 1), (None, "u", "other", "", 1), (None, None, None, None, None)]
    got = rows(spark, data, _store.new_path(spark, "t")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [(0, "response", 0, 0), (0, "response", 0, 5), (0, "response", 0, 5), (0, "revisit", 5, 4), (5, "response", 0, 4)]


def test_only_attempts_that_count_are_read(spark):
    path = _store.new_path(spark, "t")
    pages = spark.createDataFrame([(k, "u", f"text {k}") for k in range(20)], "page_id long, url string, html string").repartition(3)
    assert warc.write_captures(pages, path) == 20
    # What a failed attempt of a task has left behind.
    stray = path.removeprefix("file://") + "/part-00000-9999"
    os.makedirs(stray)
    with open(stray + "/00000.warc.gz", "wb") as out:
        out.write(one(7)[:-5])
    got = warc.resolve_revisits(warc.assemble(warc.read_records(spark, path))).collect()
    assert sorted(r.page_id for r in got) == list(range(20))


def test_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x", "y", 7)], "page_id long, url string, html string, payload string, sha int")
    path = _store.new_path(spark, "t")
    assert warc.write_captures(pages, path) == 1 and warc.read_records(spark, path).count() == 3
