"""ARC files of both versions, their conversion, and WARC files."""

from __future__ import annotations

import base64
import gzip
import hashlib

import duckdb
import pytest
from helpers import ODD, documents, empty
from loomspark.llm import archives, registry
from loomspark.llm.archives import ArcError, ArchiveRules, parse_arc, parse_warc


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


V1 = b"""filedesc://old.arc 192.0.2.1 19970101000000 text/plain 76
1 0 Some Crawler
URL IP-address Archive-date Content-type Archive-length

http://a.example/x 192.0.2.7 19961231 text/html 27
HTTP/1.0 200 OK

<p>hi</p>
"""

V2_BODY = b"2 0 Some Crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
V2 = (
    b"filedesc://new.arc 192.0.2.1 19980203040506 text/plain 200 - - 0 new.arc %d\n" % len(V2_BODY) + V2_BODY
    + b"\nhttp://a.example/y z 192.0.2.7 19980203040507 text/html 200 abc - 190 new.arc 10\nhttp://b 1\n\ndns:b.example 192.0.2.7 99990203 text/dns 0 - - 300 new.arc 0\n"
)


def fixed(data: bytes) -> bytes:
    """The sample with the length of its opening body, whatever its text is."""
    head, rest = data.split(b"\n", 1)
    body = rest[: rest.index(b"\n\n") + 2]
    return head.rsplit(b" ", 1)[0] + b" %d\n" % len(body) + rest


def test_headers_of_version_1():
    opening, r = parse_arc(fixed(V1))
    assert (opening.version, opening.fields["URL"]) == (1, "filedesc://old.arc")
    assert r.fields == {"URL": "http://a.example/x", "IP-address": "192.0.2.7", "Archive-date": "19961231", "Content-type": "text/html", "Archive-length": "27"}
    assert bytes(r.body)[17:] == b"<p>hi</p>\n"
    assert archives.http_parts(r.body) == ({}, 17)


def test_headers_of_version_2_and_lengths_over_looks():
    opening, r, dns = parse_arc(V2)
    assert opening.version == 2
    assert r.fields["URL"] == "http://a.example/y z" and r.fields["Filename"] == "new.arc" and r.fields["Result-code"] == "200"
    assert bytes(r.body) == b"http://b 1"  # what looks like a header line inside a body is not one
    assert (dns.fields["URL"], bytes(dns.body)) == ("dns:b.example", b"")


@pytest.mark.parametrize(
    "data", [b"http://a 1 2 3 4\n", b"filedesc://a x\n", V2[:-20] + b"\nhttp://c 1 19980101 text/html 200 - - 0 f 999\nshort", V2 + b"http://c 1 2 3\n", V2 + b"http://c 1 19980101 text/html 200 - - 0 f ten\n", V2 + b"no end", V2.replace(b"2 0 Some", b"7 0 Some")]
)
def test_what_is_no_archive_is_refused(data):
    with pytest.raises(ArcError):
        list(parse_arc(data))


def test_nothing_has_no_records():
    assert list(parse_arc(b"")) == [] and list(parse_warc(b"")) == []


@pytest.mark.parametrize(
    "date, want", [("19970102030405", "1997-01-02T03:04:05Z"), ("1997", "1997-01-01T00:00:00Z"), ("199702", "1997-02-01T00:00:00Z"), ("199702030405061", "1997-02-03T04:05:06Z"), ("19971399", "1990-01-01T00:00:00Z"), ("-", "1990-01-01T00:00:00Z"), ("", "1990-01-01T00:00:00Z")]
)
def test_dates(date, want):
    assert archives.warc_date(date, "1990") == want
    assert archives.warc_date("never") == "1970-01-01T00:00:00Z"


def test_urls_and_types():
    assert archives.safe_url("http://a/b c\né") == "http://a/b%20c%0A%C3%A9"
    assert archives.safe_url(None) == archives.safe_url("") == "-" and archives.safe_url("-") == "%2D"
    assert [archives.warc_type(*x) for x in (("filedesc://a", "", False), ("http://a", "", True), ("http://a", "", False), ("dns:a", "text/dns", False))] == ["warcinfo", "response", "resource", "resource"]


def test_legacy_files_become_warc(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.arc.gz").write_bytes(gzip.compress(fixed(V1)))
    (tmp_path / "in" / "new.arc.gz").write_bytes(gzip.compress(V2))
    archives.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    records = [(f, bytes(b)) for file in sorted((tmp_path / "out").glob("*.gz")) for f, b in parse_warc(gzip.decompress(file.read_bytes()))]
    by_url = {f.get("warc-target-uri"): (f, b) for f, b in records}
    assert sorted(f["warc-type"] for f, _ in records if f["warc-type"] != "warcinfo") == ["resource", "resource", "response"]
    f, b = by_url["http://a.example/x"]
    assert (f["warc-date"], f["content-type"], f["warc-payload-digest"]) == ("1996-12-31T00:00:00Z", "application/http; msgtype=response", f"sha1:{sha('<p>hi</p>' + chr(10))}")
    f, b = by_url["dns:b.example"]
    assert (f["warc-date"], f["content-type"], b) == ("9999-02-03T00:00:00Z", "text/dns", b"")
    assert len({f["warc-record-id"] for f, _ in records}) == len(records)


PAGES = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, None, "same"), (4, "http://a b", None), (5, "-", ""), (None, "http://n", "same"), (None, "x", "alone"), (6, "http://a/1", "HTTP/1.1 200 OK\r\n\r\n\r\nWARC/1.0\r\n\r\n"), (7, "u", "é🙂 \x00"), (8, "v", "long " * 30_000), (9, "w", "dup"), (9, "w", "dup")]


@pytest.mark.parametrize("size, least", [(1, 0), (500, 4), (1 << 24, 100)])
def test_pages_come_back(spark, size, least):
    pages = spark.createDataFrame([(*p, "other", 1) for p in PAGES], "page_id int, url string, html string, key string, at int").repartition(3)
    rows = archives.converted(pages, rules=ArchiveRules(size=size, min_revisit=least)).collect()
    want, seen = [], set()
    for k, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = html or ""
        first = next((p[0] for p in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)) if (p[2] or "") == data))
        again = data in seen and len(data.encode()) >= least
        seen.add(data)
        want.append((k, len(data.encode()), sha(data), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_payloads_are_read_back_whole(spark, tmp_path):
    pages = spark.createDataFrame([(k, u, h) for k, u, h in PAGES if k is not None], "page_id long, url string, html string")
    archives.write_arc(pages, str(tmp_path / "arc"), rules=ArchiveRules(size=300))
    assert {r.version for r in archives.read_arc(spark, str(tmp_path / "arc")).collect()} == {1, 2}
    archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    rows = archives.read_warc(spark, str(tmp_path / "warc"), with_payload=True).where("type = 'response'").collect()
    assert {(r.key, bytes(r.payload)) for r in rows} <= {(k, (h or "").encode()) for k, _, h in PAGES}
    assert {bytes(r.payload) for r in rows} == {(h or "").encode() for k, _, h in PAGES if k is not None}


def test_hot_payloads_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(archives, "few", lambda df, **_: df)
    rows = [(i, f"http://h/{i}", "hot" if i % 3 else f"body {i // 9}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    least = {}
    for i, _, h in rows:
        least.setdefault(h, i)
    got = {r.page_id: (r.record_type, r.refers_to) for r in archives.converted(pages).collect()}
    assert got == {i: (("response", None) if least[h] == i else ("revisit", least[h])) for i, _, h in rows}


def test_empty_and_odd(spark):
    assert archives.converted(empty(spark), key="doc_id", url="source", payload="text").count() == 0
    rows = archives.converted(documents(spark, ODD), key="doc_id", url="source", payload="text").collect()
    assert sorted((r.doc_id or 0, r.payload_bytes) for r in rows) == sorted((i or 0, len((t or "").encode())) for i, t in ODD)


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{d}/pages.parquet')")
    rows = registry.QUERIES["op11_warc"](spark, d).collect()
    names = list(rows[0].asDict())
    assert sorted(map(tuple, rows)) == sorted(con.sql(f"select {', '.join(names)} from ({archives.ORACLE_SQL})").fetchall())
