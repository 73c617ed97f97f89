"""WARC derivatives against records written by hand."""

import base64
import gzip
import hashlib
import json
import time
import uuid

import pytest

from chronotext.llm import warc
from chronotext.llm.common import find_package

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style></head><body><!-- no <p> -->
<nav><a href="/one?x=1&amp;y=2">One</a><a class=k href='two'>Two</a></nav><p>First   line<br>second<p>caf&eacute; &lt;tag&gt;
<script>var t = "<p>not text</p>";</script><img alt="x" src=pic.png></body></html>"""
TEXT = "A & B\nOneTwo\nFirst line\nsecond\ncafé <tag>"
LINKS = [{"path": "a", "url": "/one?x=1&y=2"}, {"path": "a", "url": "two"}, {"path": "img", "url": "pic.png"}]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def response(number: int, payload: bytes, http: str = "Content-Type: text/html; charset=utf-8") -> tuple[str, str, bytes]:
    """(record id, header text, block) of a response record."""
    block = f"HTTP/1.1 200 OK\r\n{http}\r\n\r\n".encode() + payload
    own = f"<urn:uuid:00000000-0000-0000-0000-00000000000{number}>"
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {own}\r\nWARC-Target-URI: http://h/{number}\r\n"
            f"WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n")
    return own, head, block


@pytest.fixture(scope="module")
def sp(spark):
    find_package(spark)
    return spark


def test_golden_records(sp, tmp_path):
    own, head, block = response(1, PAGE.encode())
    (tmp_path / "a.warc").write_bytes(head.encode() + b"\r\n" + block + b"\r\n\r\n")
    got = {r["warc_type"]: r for r in warc.derive(warc.read_responses(sp, str(tmp_path))).collect()}
    text = TEXT.encode()
    r = got["conversion"]
    assert bytes(r["block"]) == text
    mark = uuid.uuid5(uuid.NAMESPACE_URL, f"{own}\nconversion")
    assert r["headers"] == (
        f"WARC/1.1\r\nWARC-Type: conversion\r\nWARC-Record-ID: <urn:uuid:{mark}>\r\nWARC-Refers-To: {own}\r\n"
        f"WARC-Target-URI: http://h/1\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Source-Payload-Digest: {sha1(PAGE.encode())}\r\n"
        f"WARC-Block-Digest: {sha1(text)}\r\nContent-Type: text/plain\r\nContent-Length: {len(text)}\r\n")
    assert json.loads(bytes(got["metadata"]["block"])) == {
        "warc-headers": [line.split(": ", 1) for line in head.split("\r\n")[1:-1]], "http-status": "HTTP/1.1 200 OK",
        "http-headers": [["Content-Type", "text/html; charset=utf-8"]], "block-digest": sha1(block), "payload-digest": sha1(PAGE.encode()),
        "payload-length": len(PAGE.encode()), "title": "A & B", "links": LINKS}


def test_compressed_members_and_charsets(sp, tmp_path):
    latin = response(2, "<p>déjà".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1")
    packed = response(3, gzip.compress(b"<p>packed"), "Content-Encoding: gzip")
    told = response(4, '<meta charset="windows-1252"><p>\x93quoted\x94'.encode("latin-1"), "X: y")
    odd = response(5, b"<p>plain \xff", "Content-Type: text/html; charset=none-such")
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    records = [info] + [head.encode() + b"\r\n" + block + b"\r\n\r\n" for _, head, block in (latin, packed, told, odd)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.derive(warc.read_responses(sp, str(tmp_path))).filter("warc_type = 'conversion'").collect()
    assert {r["refers_to"]: bytes(r["block"]).decode() for r in got} == {
        latin[0]: "déjà", packed[0]: "packed", told[0]: "“quoted”", odd[0]: "plain �"}


@pytest.mark.parametrize("part", ["<a ", "<script ", "<p ", "<title>", "<!--", '<a href="', "<a href=", "</script "])
def test_open_tags_take_linear_time(part):
    page, start = part * 1_000_000, time.time()
    warc.plain_text(page)
    warc.links(page)
    warc.title_of(page)
    assert time.time() - start < 20


def test_tags():
    assert warc.plain_text("a<script>x</SCRIPT >b<!-- > c") == "a b"
    assert warc.plain_text("x<p_y>1<h1-z>2<no tag 3") == "x1\n2<no tag 3"
    assert warc.links("<a title='>' href=x>") == [] and warc.links("<form action = 'a>b'>") == [{"path": "form", "url": "a>b"}]
    assert warc.title_of("<title>never closed") is None
