"""WARC: mixed and damaged files, rolled files, and shuffled digests."""

import gzip

import numpy as np
import pytest

from capturelab.llm import warc


def rec(i, size=60):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(np.random.RandomState(i).randint(97, 123, size, np.uint8))
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (i, warc.digest(block).encode(), len(block)) + block + b"\r\n\r\n"


def pages(data):
    rows = list(warc.salvage(data))
    return [f["page_id"] for _, _, f, _ in rows if f], [(s, e) for s, e, f, _ in rows if not f]


def test_files_of_plain_records_and_members():
    a, b, c, d = (rec(i) for i in range(4))
    data = a + gzip.compress(b) + c + gzip.compress(d)
    assert pages(data) == ([0, 1, 2, 3], [])
    bad = bytearray(gzip.compress(rec(1, 900)))  # mostly payload
    bad[len(bad) // 2] ^= 255
    assert pages(a + bytes(bad) + gzip.compress(d) + c)[0] == [0, 3, 2]
    assert pages(b"junk" + a) == ([], [(0, 4 + len(a))]) and pages(b"junk\n" + a) == ([0], [(0, 5)])
    # version lines that are no records, numbers too long for a length or an id
    assert pages(b"WARC/1.1\r\n" * 50 + a)[0] == [0]
    assert pages(a.replace(b"Content-Length: ", b"Content-Length: " + b"9" * 5000) + b)[0] == [1]
    assert [f["page_id"] for _, _, f, _ in warc.salvage(a.replace(b"page:0", b"page:" + b"7" * 30)) if f] == [None]
    for cut in range(0, len(data), 7):  # whatever is cut off, what is whole before it is read
        ids, gaps = pages(data[:cut])
        assert ids == list(range(len(ids))) and (gaps or cut in (0, len(a), len(a) + len(gzip.compress(b))) or data[:cut].endswith((b"\r\n\r\n", a[:-4], c[:-4])) or len(ids) >= 1)


@pytest.mark.parametrize("limit", ["FILE_BYTES", "BROADCAST_DIGESTS"])
def test_rolled_files_and_shuffled_digests(spark, tmp_path, monkeypatch, limit):
    rows = [(i, "u", f"<p>{i % 7}" * 30, "x", i) for i in range(60)] + [(None, None, None, None, None), (3, "v", "<p>3" * 30, "y", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, key string, first long").repartition(3)
    want = None
    for value in (getattr(warc, limit), 1500 if limit == "FILE_BYTES" else 0):
        monkeypatch.setattr(warc, limit, value)
        folder = f"{tmp_path}/{limit}{value}"
        warc.write(table, folder)
        got = sorted((tuple(r) for r in warc.read_archives(spark, folder).select("kind", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()), key=str)
        assert want is None or got == want
        want = got
    assert len(want) == 62 and sum(r[2] == "response" for r in want) == 9 and all(r[0] == "record" for r in want)
    if limit == "FILE_BYTES":
        import glob

        assert len(glob.glob(f"{folder}/roll=*/*")) > 3


@pytest.mark.parametrize("piece", [b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03", b"\x1f\x8b\x08\x08abcdef", b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\x03\xff\xff", b"WARC/1.1\r\nContent-Length: 99\r\n", b"WARC/1.0\na: b\r\n\r\n"])
def test_salvage_is_linear(piece):
    import time

    took, tail = [], rec(5)
    for size in (200_000, 400_000):
        began = time.process_time()
        assert pages(piece * (size // len(piece)) + b"\n" + tail)[0] == [5]
        took.append(time.process_time() - began)
    assert took[1] < 4 and took[1] < 3 * took[0] + 0.3, took
