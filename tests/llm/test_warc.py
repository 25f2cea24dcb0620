"""Round trips, and salvage of damaged archives."""

import gzip
import hashlib
import random
import time
import zlib

import pytest

from quarry.llm._tables import new_path
from quarry.llm.warc import EMPTY_MEMBER, read_archives, salvage, write_archives


def record(k: int, payload: bytes, digest: str | None = None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = digest or hashlib.sha256(payload).hexdigest()
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_damage_costs_the_damaged_records_only(pack):
    rng = random.Random(1)
    for trial in range(150):
        parts = [pack(record(k, rng.randbytes(rng.randint(0, 300)) + b"WARC/1.0 \x1f\x8b\x08 \r\n\r\n")) for k in range(8)]
        edges = [0]
        for p in parts:
            edges.append(edges[-1] + len(p))
        data = bytearray(b"".join(parts))
        hurt = set()
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(8)
            at = rng.randrange(edges[k], edges[k + 1])
            data[at] ^= 1 << rng.randrange(8)
            hurt.add(k)
        if trial % 3 == 0:  # cut off
            end = rng.randrange(len(data))
            data = data[:end]
            hurt |= {k for k in range(8) if edges[k + 1] > end}
        pieces = list(salvage(bytes(data)))
        good = {int(p.headers["warc-record-id"][10:-1]) for p in pieces if p.headers is not None and p.headers.get("warc-record-id", "").startswith("<urn:page:")}
        assert good >= set(range(8)) - hurt
        at = 0
        for p in pieces:
            if p.length:
                assert p.start == at
                at += p.length
        assert at == len(data)


def ids(pieces):
    return [int(p.headers["warc-record-id"][10:-1]) for p in pieces if p.headers is not None]


@pytest.mark.parametrize("level", [0, 6])
def test_records_inside_a_member(level):
    records = [record(k, f"payload {k} ".encode() * 20, digest="0" * 64 if k == 40 else None) for k in range(101)]
    pieces = list(salvage(gzip.compress(b"".join(records), level)))
    assert ids(pieces) == [k for k in range(101) if k != 40]
    gaps = [p for p in pieces if p.headers is None]
    assert [(p.reason, p.inner) for p in gaps] == [("payload digest wrong", (sum(map(len, records[:40])), len(records[40])))]
    # cut off, and damaged at a place: what was inflated before is there, once
    whole = gzip.compress(b"".join(record(k, random.Random(k).randbytes(300)) for k in range(101)), level)
    cut = whole[: len(whole) // 2]
    assert len(ids(salvage(cut))) >= 45 and len(set(ids(salvage(cut)))) == len(ids(salvage(cut)))
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 0xFF
    after = gzip.compress(record(500, b"next"))
    got = list(salvage(bytes(hurt) + after))
    assert len(set(ids(got))) == len(ids(got)) and set(range(45)) <= set(ids(got)) and ids(got)[-1] == 500
    assert sum(p.length for p in got if p.headers is None) + got[-1].length == len(whole) + len(after)


def test_search_is_linear():
    began = time.perf_counter()
    for junk in (b"WARC/1.0 ", b"WARC/1.0\r\n", b"WARC/1.0\r\nA: b\r\n", b"\x1f\x8b\x08", b"\x1f\x8b\x08\0\0\0\0\0\0\0"):
        data = junk * (540_000 // len(junk)) + record(3, b"x")
        pieces = list(salvage(data))
        assert ids(pieces) == [3] and len(pieces) == 2
    assert time.perf_counter() - began < 20


def test_search_in_long_headers_is_linear():
    began = time.perf_counter()
    good = record(3, b"x")
    for line, tail in ((b"A: WARC/1.0\r\n", b"\r\n"), (b"A: WARC/1.0\r\n", b"Content-Length: 5\r\nWARC-Type: response\r\n\r\n"), (b" WARC/1.0\r\n", b""), (b"A: WARC/1.0\r\n", b"no colon\r\n")):
        pieces = list(salvage(b"WARC/1.0\r\n" + line * 60_000 + tail + good))
        assert ids(pieces) == [3] and len(pieces) == 2
        assert ids(salvage(gzip.compress(b"WARC/1.0\r\n" + line * 60_000 + tail + good, 1))) == [3]
    named = b"\x1f\x8b\x08\x08\0\0\0\0\0\0"
    assert ids(salvage(named.replace(b"\0", b"n") * 60_000 + good)) == [3]
    wrong = b"WARC/1.0\r\nWARC-Payload-Digest: sha256:0\r\n" + b"A: WARC/1.0\r\n" * 60_000 + b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert ids(salvage(wrong + good)) == [5, 3]  # a record without the wrong digest starts behind it
    assert time.perf_counter() - began < 20


def test_member_of_over_a_gibibyte():
    payload = bytes(11 << 20)
    records = [record(k, payload) for k in range(100)]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = b"".join([deflate.compress(r) for r in records] + [deflate.compress(b"junk" * 1_000_000), deflate.compress(record(100, b"last")), deflate.flush()])
    del records
    found = [(p.headers and int(p.headers["warc-record-id"][10:-1]), p.length, p.inner[1]) for p in salvage(data)]
    assert [k for k, _, _ in found] == [*range(100), None, 100] and found[100][2] == 4_000_000 and {n for _, n, _ in found} == {len(data)}
    cut = [p for p in salvage(data[: len(data) // 2])]
    assert len([p for p in cut if p.headers is not None and p.length == 0]) >= 45 and cut[-1].reason == "member cut off"


def test_long_urls(spark):
    rows = [(k, "http://a/" + "u" * n, "page") for k, n in enumerate((3, 70_000, 5_000_000, 66_000))]
    path = new_path(spark, "test-warc")
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert sorted((int(r["page_id"]), r["uri"], r["payload"]) for r in read_archives(spark, path).collect()) == [(k, u, b"page") for k, u, _ in rows]


def test_folded_headers():
    data = record(1, b"x").replace(b"WARC-Type: response", b"WARC-Type:\r\n response")
    assert ids(salvage(data)) == [1]


def test_failed_digest_is_a_gap():
    data = record(1, b"x") + record(2, b"y", digest="0" * 64) + EMPTY_MEMBER + record(3, b"z") + b"junk"
    pieces = list(salvage(data))
    assert [(p.headers or {}).get("warc-record-id") for p in pieces] == ["<urn:page:1>", None, "<urn:page:3>", None]
    assert [p.reason for p in pieces] == ["", "payload digest wrong", "", "no member or version line"]
    assert list(salvage(b"")) == []


def test_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.0</p>" * 20
    rows = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "u", big), (None, "u", big), (7, "u", None), (8, "u", ""), (10, "u", "short"), (11, "u", "short"), (12, "u", "z" * 100), (12, "u", "z" * 100), (None, "u", "q" * 200)]
    rows += [(100 + k, "u", f"page {k} " * 30) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as id").repartition(3)
    path = new_path(spark, "test-warc")
    write_archives(pages, path, chunk_bytes=900, chunks_per_file=3)
    got = read_archives(spark, path, part_rows=4).collect()
    assert len(got) == len(rows) and all(r["kind"] == "record" for r in got)
    want = []
    for k, _, html in rows:
        data = (html or "").encode()
        ids = [i for i, _, h in rows if i is not None and h == html and len(data) >= 100]
        first = min(ids) if ids and len([1 for _, _, h in rows if h == html]) > 1 else None
        refers = first if first is not None and first != k else None
        want.append((None if k is None else str(k), len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", None if refers is None else str(refers), None if refers is not None else data))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in got], key=str) == sorted(want, key=str)
    empty = new_path(spark, "test-warc")
    write_archives(pages.limit(0), empty)
    assert read_archives(spark, empty).count() == 0
