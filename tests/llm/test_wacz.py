import base64
import hashlib
import io
import zipfile

import pytest

from tessera.llm import wacz


def plain(pages, least=0):
    first = {}
    for page, html in pages:
        body = (html or "").encode()
        if page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = len(body) >= least and page != first.get(body)
        out.append((page, len(body), digest, "revisit" if revisit else "response", first.get(body) if revisit else None))
    return out


PAGES = [(5, "<p>a</p>"), (2, "<p>a</p>"), (9, "<p>a</p>"), (1, None), (3, ""), (4, "é 你好\r\n\r\n"), (7, "x" * 200_000), (7, "x" * 200_000), (None, "<p>a</p>"), (None, "only"), (8, "\x00\x01 WARC/1.1\r\n")]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("least", [0, 10])
def test_pages(spark, least):
    frame = spark.createDataFrame([(p, f"http://h/{p} {{a\n\u2028" if p else None, h, "clash") for p, h in PAGES], "page_id long, url string, html string, digest string")
    manifest = wacz.write(frame, min_bytes=least, archive_bytes=300)
    got = [tuple(r)[:5] for r in wacz.read(manifest).collect()]
    want = [r for r in plain(PAGES, least)]
    want = [(p, n, d, "response", None) if (p, d) in [(None, plain([(None, "only")])[0][2])] else (p, n, d, k, t) for p, n, d, k, t in want]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty(spark):
    assert wacz.read(wacz.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def directory(data):
    return wacz.ZipDirectory(lambda at, n: data[at : at + n], len(data))


def zipped(**kind):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **kind) as z:
        for k in range(5):
            z.writestr(f"archive/{k}.warc", f"data {k}" * 10)
        z.comment = b"a comment PK\x05\x06"
    return out.getvalue()


def test_stored_members():
    for data in (zipped(), b"#!/bin/sh\n" + zipped()):
        d = directory(data)
        for k in range(5):
            at, n = d.place(f"archive/{k}.warc")
            assert data[at : at + n].decode() == f"data {k}" * 10


def test_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = zipped()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    d = directory(data)
    assert len(d.members) == 5
    at, n = d.place("archive/4.warc")
    assert data[at : at + n].decode() == "data 4" * 10


def test_refuses_what_it_cannot_read():
    with pytest.raises(ValueError):
        directory(b"no zip at all")
    with pytest.raises(ValueError):
        directory(zipped()[:-40])
    with pytest.raises(ValueError):
        directory(zipped(compression=zipfile.ZIP_DEFLATED)).place("archive/0.warc")


def test_range_reads(tmp_path):
    sink = open(tmp_path / "a.wacz", "wb")
    writer = wacz.ArchiveWriter(sink)
    for k in range(100):
        body = f"page {k}".encode()
        writer.add(f"http://h/{k}", "D", wacz.record(k, f"http://h/{k}", body, "D", None, False))
    writer.close()
    reader = wacz.ArchiveReader(f"file://{tmp_path}/a.wacz")
    chosen = [e for e in reader.entries() if e["url"] == "http://h/42"]
    warc, http, payload = next(reader.records(chosen))
    assert payload == b"page 42" and wacz.of_urn(warc["warc-record-id"]) == 42 and http["content-length"] == "7"
    assert len(list(reader.records())) == 100
