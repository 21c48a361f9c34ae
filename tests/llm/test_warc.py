"""WARC archives: round trips, the record reader, revisits."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from lociframe.llm import warc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, source string, sha1 string, at string"


def digest_of(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def odd_pages(spark):
    texts = [
        "", None, "<p>a</p>", "<p>a</p>", "\n", "\r\n\r\n", "WARC/1.1\r\n\r\n", "é" * 1000, "x" * 64, "x" * 65 + "\n",
        "\n" * 64, "0\r\n\r\n" * 50, "日本😀\n" * 5000, "a\r", "<p>a</p>",
    ]
    rows = [(i, f"http://h/{i}", t, "s", "h", "z") for i, t in enumerate(texts)]
    rows += [(2, "http://h/2", "<p>a</p>", None, None, None)] * 2  # a page three times
    rows += [(None, None, "null id", None, None, None), (None, None, "null id", None, None, None), (None, "u", "<p>a</p>", None, None, None)]
    rows += [(90, "http://h/\r\nWARC-Type: x%0A", "odd url", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(rows, min_bytes=0):
    """(page, bytes, digest, type, refers) of all pages, one of repeated largest ids being the response."""
    groups = {}
    for r in rows:
        groups.setdefault(r.html or "", []).append(r.page_id)
    out = []
    for text, ids in groups.items():
        size, name = len(text.encode()), digest_of(text)
        ids = sorted(ids, key=lambda i: (i is not None, i))
        for i in ids[:-1]:
            out.append((i, size, name, "revisit", ids[-1]) if size >= min_bytes else (i, size, name, "response", None))
        out.append((ids[-1], size, name, "response", None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [64, 1 << 16])
@pytest.mark.parametrize("min_bytes", [0, 8])
def test_round_trip(spark, odd_pages, tmp_path, piece, min_bytes):
    warc.write_archives(odd_pages, str(tmp_path / "w"), min_bytes, piece)
    back = warc.read_archives(spark, str(tmp_path / "w")).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr)
    source = odd_pages.collect()
    assert got == expected(source, min_bytes)
    assert all(r.digest_ok for r in back)
    assert len({r.record_id for r in back}) == len(source)
    assert {(r.page_id, r.target_uri) for r in back} == {(r.page_id, r.url) for r in source}
    # payloads come back piece by piece, with running digests
    pieces = {}
    for r in warc.read_chunks(spark, str(tmp_path / "w")).orderBy("record_id", "chunk_no").collect():
        assert len(r.data) <= piece
        so_far = pieces.setdefault(r.record_id, bytearray())
        so_far += r.data
        assert r.payload_sha1 == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
    texts = {r.record_id: bytes(pieces.get(r.record_id, b"")) for r in back if r.record_type == "response"}
    assert {t.decode() for t in texts.values()} == {r.html or "" for r in source}


def test_files_are_warc(spark, odd_pages, tmp_path):
    """Every record's content length is right, read without the reader under test."""
    warc.write_archives(odd_pages, str(tmp_path / "w"), piece_bytes=64)
    seen = 0
    for file in Path(tmp_path / "w").glob("*.gz"):
        raw = gzip.decompress(file.read_bytes())
        while raw:
            assert raw.startswith(b"WARC/1.1\r\n")
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            block, end = rest[:size], rest[size : size + 4]
            assert end == b"\r\n\r\n"
            if fields["WARC-Type"] == "response":
                body, payload = block.partition(b"\r\n\r\n")[2], b""
                while True:
                    n, _, body = body.partition(b"\r\n")
                    payload += body[: int(n, 16)]
                    assert body[int(n, 16) : int(n, 16) + 2] == b"\r\n"
                    if int(n, 16) == 0:
                        assert body == b"\r\n"
                        break
                    body = body[int(n, 16) + 2 :]
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            raw, seen = rest[size + 4 :], seen + 1
    assert seen == odd_pages.count()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 1000])
def test_coded_length(n):
    body = b"\n" * n
    coded = b"".join(b"%x\r\n%b\r\n" % (len(p), bytes(p)) for p in warc.pieces(body, 64)) + b"0\r\n\r\n"
    assert warc.coded_length(n, 64) == len(coded)


def test_faults_are_found():
    rows = list(warc.response_chunks(1, 0, "u", digest_of("ab\ncd"), b"ab\ncd", 4))
    raw = b"".join(r[2] for r in rows)

    def read(data):
        reader, found = warc.RecordReader(), []
        for line in data[:-1].split(b"\n"):
            found += [r for r in [reader.feed(line)] if r]
        reader.close()
        return found

    assert read(raw)[0]["digest_ok"]
    assert not read(raw.replace(b"ab\nc", b"xb\nc"))[0]["digest_ok"]
    with pytest.raises(ValueError, match="ends inside"):
        read(raw[:-20])
    with pytest.raises(ValueError, match="begins with"):
        read(b"x\n" + raw)
    with pytest.raises(ValueError, match="expected"):
        list(warc.response_chunks(1, 0, "u", digest_of("other"), b"ab", 4))
    # a block of unchunked coding, as other tools write it
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:5:0>\r\nWARC-Payload-Digest: sha1:" + digest_of("hi\n").encode()
    plain += b"\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\n" + b"\r\n\r\n"
    assert read(plain)[0]["digest_ok"]


def test_no_pages(spark, odd_pages, tmp_path):
    warc.write_archives(odd_pages.limit(0), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_query(spark):
    rows = warc.query(spark, FOLDER).collect()
    assert sorted(map(tuple, rows), key=repr) == expected(spark.read.parquet(f"{FOLDER}/pages.parquet").collect())
