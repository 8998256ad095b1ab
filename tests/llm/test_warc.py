import base64
import gzip
import hashlib
import os
import random

import pytest

from foliowire.llm import warc

SCHEMA = "page_id long, url string, html string, row long, chunk string, digest string"


@pytest.fixture
def pages(rows):
    return lambda data: rows([(*r, 1, "x", "y") for r in data], SCHEMA)


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parsed(path):
    """(fields, block) of every record of the files below a folder, by a plain reader of whole files."""
    out = []
    for name in sorted(os.listdir(path.removeprefix("file:"))):
        if not name.endswith(".gz"):
            continue
        data = gzip.open(os.path.join(path.removeprefix("file:"), name)).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            first, *lines = head.split(b"\r\n")
            assert first == b"WARC/1.1"
            fields = dict(line.decode().split(": ", 1) for line in lines)
            size = int(fields["Content-Length"])
            out.append((fields, data[:size]))
            assert data[size:size + 4] == b"\r\n\r\n"
            data = data[size + 4:]
    return out


def body(block):
    """The payload of an HTTP response, transfer coding undone."""
    head, _, rest = block.partition(b"\r\n\r\n")
    if b"chunked" not in head:
        return rest
    out = b""
    while True:
        size, _, rest = rest.partition(b"\r\n")
        n = int(size, 16)
        if not n:
            assert rest == b"\r\n"
            return out
        out, rest = out + rest[:n], rest[n + 2:]


def brute(data, least=0):
    """What the query returns, in the order of identifiers."""
    first, out = {}, []
    for page_id, _, html in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        known = len(payload) >= least and payload in first
        out.append((page_id, len(payload), sha(payload), "revisit" if known else "response", first[payload] if known else None))
        first.setdefault(payload, page_id)
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def awkward(seed):
    rng = random.Random(seed)
    bits = ["\r", "\n", "\r\n", "a", "0", "é", "WARC/1.1", "\r\n\r\n", "漢", "\x00"]
    data = [(i, f"http://host/{i}", "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(120)]
    data += [(1000 + i, None, data[rng.randrange(20)][2]) for i in range(60)]
    return data + [(7, "http://a b\r\nc", None), (7, "x", ""), (None, "x", "copy"), (None, None, "copy"), (2**60 + 1, "x", "copy"), (2**60, "x", "other"),
                   (3, "x", "same"), (3, "x", "same"), (-5, "x", "same"), (11, "x", "\r" * 30), (12, "x", "\n" * 30)]


@pytest.mark.parametrize("least", [0, 5])
def test_equals_brute_force(spark, pages, least):
    data = awkward(1)
    path = warc.archived(pages(data), least_bytes=least, chunk_bytes=7)
    got = [tuple(r)[:5] for r in warc.page_records(spark, path).collect()]
    assert sorted(got, key=key) == sorted(brute(data, least), key=key)


def test_archives_are_well_formed(pages):
    data = awkward(2)
    records = parsed(warc.archived(pages(data), chunk_bytes=16))
    assert {f["WARC-Type"] for f, _ in records} == {"warcinfo", "response", "revisit"}
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    by_id = {f["WARC-Record-ID"]: body(b) for f, b in records if f["WARC-Type"] == "response"}
    payloads = []
    for fields, block in records:
        if fields["WARC-Type"] == "warcinfo":
            continue
        payload = by_id[fields.get("WARC-Refers-To", fields["WARC-Record-ID"])]
        assert fields["WARC-Payload-Digest"] == f"sha1:{sha(payload)}"
        assert body(block) == (payload if fields["WARC-Type"] == "response" else b"")
        payloads.append(payload)
    assert sorted(payloads) == sorted((h or "").encode() for _, _, h in data)
    assert any(f.get("WARC-Target-URI") == "http://a%20b%0D%0Ac" for f, _ in records)


def test_chunks_come_back_in_order_and_bounded(spark, pages):
    text = "".join(random.Random(4).choices("abc\r\né", k=200_000))
    path = warc.archived(pages([(1, "x", text), (2, "x", "")]), chunk_bytes=1000)
    rows = warc.read_archives(spark, path).where("record_type = 'response' and record_id like '<urn:page:1:%'").collect()
    chunks = sorted((r.chunk_no, bytes(r.chunk)) for r in rows if r.chunk is not None)
    assert max(len(c) for _, c in chunks) == 1000
    assert b"".join(c for _, c in chunks) == text.encode()
    closing = [r for r in rows if r.chunk is None]
    assert [(c.chunk_no, c.payload_bytes, c.payload_digest, c.intact) for c in closing] == [(len(chunks), len(text.encode()), sha(text.encode()), True)]


def test_damage_is_seen():
    reader = warc._Records()
    lines = [b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:1:0>", b"WARC-Payload-Digest: sha1:" + sha(b"good").encode(),
             b"Content-Type: application/http; msgtype=response", b"Content-Length: 57", b"", b"HTTP/1.1 200 OK", b"Transfer-Encoding: chunked", b"", b"4",
             b"goOd", b"0", b"", b"", b""]
    rows = [r for line in lines for r in reader.step(line) or ()]
    assert rows[-1][6:] == (4, sha(b"goOd"), False)
    with pytest.raises(ValueError):
        reader.step(b"nonsense")


def test_other_records_are_read_whole(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: text/plain\r\nContent-Length: 9\r\n\r\nab\r\ncd\r\ne\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"urn:x", b"urn:y")))  # one member per record
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    for name in ("<urn:x>", "<urn:y>"):
        own = [r for r in rows if r.record_id == name]
        assert b"".join(bytes(r.chunk) for r in sorted(own, key=lambda r: r.chunk_no) if r.chunk is not None) == b"ab\r\ncd\r\ne"
        assert [r.payload_digest for r in own if r.chunk is None] == [sha(b"ab\r\ncd\r\ne")]


def test_empty_table(spark, pages):
    assert warc.page_records(spark, warc.archived(pages([]))).collect() == []
