import gzip
import hashlib
import io

import pytest

from defgrain.llm import warc


@pytest.fixture(scope="module")
def pages():
    long = "é" * 60  # 120 bytes
    return [
        (5, "http://a/x", long),
        (3, "http://a/y z\r\n", long),
        (9, None, long),
        (3, "http://a/again", long),
        (7, "http://a/s", "x" * 99),
        (8, "http://a/t", "x" * 99),
        (11, "u", "x" * 100),
        (12, "u", "x" * 100),
        (1, "u", None),
        (2, "u", ""),
        (None, "u", "x" * 100),
        (None, "u", "only without an id " * 10),
        (20, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 5),
        (21, "u", "\x1f\x8b\x08 " * 50),
    ]


def expected(pages):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        revisit = len(raw) >= 100 and first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, pages):
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, file string, size int").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr)
    assert got == expected(pages)
    assert warc.round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_splits_own_each_record_once(spark, pages, split):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    folder = warc.folder_for(spark)
    files = warc.write_archives(df, folder, file_bytes=1500)
    assert files.count() > 1
    rows = warc.read_archives(files, folder, split=split).collect()
    assert len(rows) == len(pages) == len({(r["file"], r["offset"]) for r in rows})
    for r in rows:
        if r["warc_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_length"]
        else:
            assert r["payload"] is None and r["refers_to"]
    for r in files.collect():
        with gzip.open(r["file"]) as f:  # an ordinary gzip file of ordinary records
            assert f.read().count(b"WARC-Record-ID") >= r["records"]


def test_every_byte_range_of_a_file():
    parts = [warc.record(i, f"u{i}", bytes([65 + i]) * (400 * i), hashlib.sha256(b"").hexdigest()) for i in range(6)]
    junk = b"\x1f\x8b\x08junk"
    data = parts[0] + junk + b"".join(parts[1:])
    starts, at = [], 0
    for k, p in enumerate(parts):
        starts.append(at)
        at += len(p) + (len(junk) if k == 0 else 0)
    for size in (1, 7, 64, 1000):
        found = [o for a in range(0, len(data), size) for o, _ in warc.records(io.BytesIO(data), a, min(a + size, len(data)), len(data))]
        assert found == starts


def test_broken_members_are_passed_over():
    good = warc.record(1, "u", b"payload", "0" * 64)
    cut = warc.record(2, "u", b"other" * 500, "0" * 64)[:-12]
    other = gzip.compress(b"not a record")
    data = cut + good + other + good
    assert [f[1] for _, f in warc.records(io.BytesIO(data), 0, len(data), len(data))] == ["<urn:page:1>"] * 2


def test_parse():
    assert warc.parse(b"WARC/1.0\r\nContent-Length: 5\r\n\r\nab\r\n\r\n") is None
    assert warc.parse(b"WARC/1.0\r\n\r\n") is None and warc.parse(b"") is None
    kind, *_, payload = warc.parse(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    assert (kind, payload) == ("resource", b"ab")


def test_odd_headers_of_foreign_records_stop_nothing():
    def member(http, length=None):
        block = http + b"\r\n\r\nbody"
        head = b"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Type: application/http\r\nContent-Length: %s\r\n\r\n"
        return head % (length or b"%d" % len(block)) + block + b"\r\n\r\n"

    for value, full in ((b"abc", 4), (b"", 4), (b"-7", 4), (b"1_0", 4), (b"9" * 30, 4), ("٣".encode(), 4), (b" 12 ", 12)):
        assert warc.parse(member(b"HTTP/1.1 200 OK\r\nContent-Length:" + value))[5] == full
    assert warc.parse(member(b"HTTP/1.1 200 OK", b"x")) is None and warc.parse(member(b"HTTP/1.1 200 OK", b"-4")) is None
