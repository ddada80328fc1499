"""WARC: round trips, links between records, digests, edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adlayer.llm import warc

PAGE = '<html><head><title> A  B </title></head><body><nav>menu</nav><p>Text &amp; more</p><a href="/x">link</a></body></html>'


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://x.org/", PAGE), (2, None, None), (1, "http://x.org/", PAGE)], "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages)
    sources = {r["record_id"]: r for r in responses.collect()}
    got = warc.derive(responses).collect()
    assert len(got) == 6 and len({r["record_id"] for r in got}) == 4 and len(sources) == 2
    for r in got:
        source = sources[r["refers_to"]]
        assert (r["target_uri"], r["date"]) == (source["target_uri"], source["date"])
        assert r["headers"]["WARC-Source-Block-Digest"] == source["block_digest"] == sha(bytes(source["block"]))
        assert r["headers"]["WARC-Source-Payload-Digest"] == source["payload_digest"]
        assert r["block_digest"] == sha(bytes(r["block"])) and r["headers"]["WARC-Page-ID"] == source["headers"]["WARC-Page-ID"]
    text = next(r for r in got if r["record_type"] == "conversion" and r["target_uri"])
    assert bytes(text["block"]).decode() == "menu\nText & more\nlink"
    meta = json.loads(bytes(next(r for r in got if r["record_type"] == "metadata" and r["target_uri"])["block"]))
    assert meta["html"] == {"title": "A B", "links": [{"tag": "a", "url": "/x"}]}
    assert meta["http"]["headers"][0] == ["Content-Type", "text/html; charset=utf-8"] and meta["warc"]["WARC-Type"] == "response"
    empty = next(r for r in got if r["record_type"] == "conversion" and not r["target_uri"])
    assert bytes(empty["block"]) == b""


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x.org/{i}", PAGE * (i + 1)) for i in range(20)], "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages)
    records = responses.unionByName(warc.derive(responses))
    for compress in (True, False):
        made = [bytes(r["warc"]) for r in warc.formatted(records, compress).collect()]
        folder = tmp_path / str(compress)
        folder.mkdir()
        (folder / "a.warc").write_bytes(b"".join(made[:30]))
        (folder / "b.warc").write_bytes(b"".join(made[30:]))
        back = warc.read(spark, str(folder))
        key = lambda r: (r["record_id"], r["refers_to"], bytes(r["block"]), sorted(r["headers"].items()), r["block_digest"])
        assert sorted(map(key, back.collect()), key=str) == sorted(map(key, records.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=5), st.binary(max_size=30))
def test_parse_gives_what_was_formatted(blocks, tail):
    rows = [{n: None for n in warc._SCHEMA.names} | {"record_type": "response", "record_id": f"<urn:{i}>", "headers": [("X-Y", "z: 1")], "block": b} for i, b in enumerate(blocks)]
    data = b"".join(map(warc.format_record, rows))
    assert [(r["record_id"], r["block"], r["headers"]) for r in warc.parse(io.BytesIO(data))] == [(r["record_id"], r["block"], r["headers"]) for r in rows]
    list(warc.parse(io.BytesIO(tail)))
    found = list(warc.records_in(io.BufferedReader(io.BytesIO(data + tail + warc.CRLF + data))))
    assert [r["block"] for r in found if r["record_type"] == "response"][: len(blocks)] == blocks


@pytest.mark.parametrize("rest", [b"", b"\r\n", b"x\r\n", b"-1\r\n", b"1_0\r\n", b"9" * 5000 + b"\r\n"])
def test_bytes_like_the_mark_of_a_broken_member(rest):
    """The mark without a place is what stands in a file, not a gzip member that broke."""
    mark = b"\xffbroken gzip member at " + rest
    row = {n: None for n in warc._SCHEMA.names} | {"record_type": "response", "record_id": "<urn:1>", "headers": [], "block": b"b"}
    data = warc.format_record(row)
    lost, found = warc.parse(io.BytesIO(mark + warc.CRLF + data))
    assert (lost["record_type"], lost["headers"]) == ("unreadable", [("Offset", "0"), ("Reason", "no record begins here")]) and found["block"] == b"b"
    headers = data.replace(b"Content-Length", mark.removesuffix(warc.CRLF) + b": z\r\nContent-Length")
    assert [r["block"] for r in warc.parse(io.BytesIO(headers))] == [b"b"]


def test_payloads():
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\n\r\n".encode()
    status, headers, payload = warc.split_http(head + gzip.compress("é".encode("latin-1")))
    body, undecoded = warc.plain_payload(payload, headers)
    assert status == "HTTP/1.1 200 OK" and undecoded is None and warc.decoded(body, headers) == "é"
    assert warc.plain_payload(b"broken", headers) == (b"broken", None)
    assert warc.plain_payload(b"x", [("Content-Encoding", "br")]) == (b"x", "br")
    chunked = b"4\r\nWiki\r\n6;a=b\r\npedia \r\n0\r\n\r\n"
    assert warc.plain_payload(chunked, [("Transfer-Encoding", "chunked")]) == (b"Wikipedia ", None) and warc.unchunked(b"plain") == b"plain"
    assert warc.split_http(b"plain") == ("", [], b"plain")
    for charset in ("none-such", "undefined", "idna", "base64"):
        assert warc.decoded("é".encode(), [("Content-Type", f"text/html; charset={charset}")]) == "é"


def response(kind, payload, coding=None):
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n" + (f"Content-Encoding: {coding}\r\n" if coding else "") + "\r\n"
    return dict.fromkeys(warc._SCHEMA.names) | {"record_type": "response", "record_id": "<urn:1>", "block": head.encode() + payload}


def test_forms_of_content():
    made = lambda *x: {r["record_type"]: r["block"] for r in warc.derive_one(response(*x))}
    assert set(made("image/png", b"\x89PNG")) == {"metadata"}
    assert made("text/plain", b"a <b> c")["conversion"] == b"a <b> c" and made("application/json", b'{"a": 1}')["conversion"] == b'{"a": 1}'
    assert made("text/html", b"<form><p>in a form</p></form><script>x</script>")["conversion"] == b"in a form"
    odd = made("text/html", b"?", "br")
    assert set(odd) == {"metadata"} and json.loads(odd["metadata"])["http"]["undecoded"] == "br"


def test_pages_that_differ_only_in_html_have_ids_of_their_own(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b")], "page_id long, url string, html string")
    assert warc.responses_from_pages(pages).select("record_id").distinct().count() == 2


def test_broken_records_are_reported_and_passed():
    row = {n: None for n in warc._SCHEMA.names} | {"record_type": "response", "record_id": "<urn:1>", "headers": [], "block": b"body"}
    good = warc.format_record(row)
    data = good + b"garbage\r\n" + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nrest\r\n" + good + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"
    found = list(warc.records_in(io.BufferedReader(io.BytesIO(data))))
    assert [r["record_type"] for r in found] == ["response", "unreadable", "unreadable", "unreadable", "response", "unreadable"]
    assert found[1]["headers"][0] == ("Offset", str(len(good))) and found[-1]["headers"][1][1] == "5 of 99 bytes"
    zipped = gzip.compress(good) + gzip.compress(good)[:-12]
    assert [r["record_type"] for r in warc.records_in(io.BufferedReader(io.BytesIO(zipped)))][0] == "response"


def test_other_records_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1_000_000)], "page_id long, url string, html string")
    made = warc.derive(warc.responses_from_pages(pages))
    assert warc.derive(made).count() == 0 and made.count() == 2
    assert warc.derive(warc.responses_from_pages(pages.where("false"))).count() == 0


def made_records(n):
    return [{k: None for k in warc._SCHEMA.names} | {"record_type": "response", "record_id": f"<urn:{i}>", "headers": [("X", "y")], "block": f"block {i} ".encode() * 40} for i in range(n)]


def told(data):
    """(ids of the records, places of unreadable spans)."""
    found = list(warc.records_in(io.BufferedReader(io.BytesIO(data))))
    return [r["record_id"] for r in found if r["record_type"] == "response"], [int(r["headers"][0][1]) for r in found if r["record_type"] == "unreadable"]


def test_wrong_lengths_lose_no_whole_record():
    rows = made_records(5)
    good = list(map(warc.format_record, rows))
    own = len(rows[1]["block"])
    ids = lambda *k: [f"<urn:{i}>" for i in k]
    for length in (own + 20, own + 140, own + len(good[2]) + 30, 10**6, 10**15, own - 20):
        wrong = good[1].replace(f"Content-Length: {own}".encode(), f"Content-Length: {length}".encode())
        assert told(b"".join([good[0], wrong, *good[2:]])) == (ids(0, 2, 3, 4), [len(good[0])]), length
        assert told(gzip.compress(good[0]) + gzip.compress(wrong) + gzip.compress(good[2]))[0] == ids(0, 2), length
    assert told(b"".join(good[:2]) + b"lost at the end") == (ids(0, 1), [len(good[0]) + len(good[1])])
    assert told(good[0] + good[1][:-4]) == (ids(0, 1), []) and told(good[0] + good[1][:-10]) == (ids(0), [len(good[0])])
    assert told(b"junk " * 50_000 + b"\n" + good[0]) == (ids(0), [0])
    found, lost = told(good[0] + b"WARC/1.1\r\n" + b"A: b\r\n" * 400_000 + good[1])
    assert found == ids(0, 1) and lost[0] == len(good[0])


def test_broken_members_are_passed():
    rows = made_records(6)
    good = [gzip.compress(warc.format_record(r), mtime=0) for r in rows]
    ids = lambda *k: [f"<urn:{i}>" for i in k]
    at = [sum(map(len, good[:i])) for i in range(7)]
    head = bytearray(good[2])
    head[2] = 7
    assert told(b"".join([*good[:2], bytes(head), *good[3:]])) == (ids(0, 1, 3, 4, 5), [at[2]])
    middle = bytearray(good[2])
    middle[len(middle) // 2 :] = bytes(len(middle) - len(middle) // 2)
    found, lost = told(b"".join([*good[:2], bytes(middle), *good[3:]]))
    assert [x for x in found if x != "<urn:2>"] == ids(0, 1, 3, 4, 5) and at[2] in lost
    cut = b"".join([*good[:2], good[2][:-30], *good[3:]])
    assert [x for x in told(cut)[0] if x != "<urn:2>"] == ids(0, 1, 3, 4, 5)
    assert told(b"".join(good[:3]) + bytes(512) + b"".join(good[3:])) == (ids(*range(6)), [])  # padding
    assert told(b"".join(good[:3]) + b"noise" * 9 + b"".join(good[3:])) == (ids(*range(6)), [at[3]])
    whole = gzip.compress(b"".join(map(warc.format_record, rows * 3000)), mtime=0)
    found, lost = told(whole[: len(whole) // 2])
    assert 1000 < len(found) < 18000 and lost and found == (ids(*range(6)) * 3000)[: len(found)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 400), st.binary(min_size=1, max_size=12))
def test_any_damage_to_one_record_leaves_the_others(place, noise):
    rows = made_records(3)
    good = list(map(warc.format_record, rows))
    hit = bytearray(good[1])
    hit[place : place + len(noise)] = noise.replace(b"W", b"-")
    for pack in (bytes, gzip.compress):
        assert [x for x in told(pack(good[0]) + pack(bytes(hit)) + pack(good[2]))[0] if x in ("<urn:0>", "<urn:2>")] == ["<urn:0>", "<urn:2>"]


def test_line_feeds_alone():
    row = response("text/plain", b"")
    row["block"] = b"HTTP/1.1 200 OK\nContent-Type: text/plain\n\nbody\n\nmore"
    assert {r["record_type"]: r["block"] for r in warc.derive_one(row)}["conversion"] == b"body\n\nmore"


def test_derivatives_in_plain_code(spark, tmp_path):
    """Written by tasks, read back, derived; links, titles and ids again in plain code."""
    pages = spark.createDataFrame([(i, f"http://x.org/{i}", f"<title>t {i}</title><p>one {i}<p>two<a href=/{i}>l</a>" if i % 3 else None) for i in range(40)], "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages.repartition(4))
    assert warc.write(responses, str(tmp_path / "w")) == 40
    got = warc.derive(warc.read(spark, str(tmp_path / "w"))).collect()
    of = {r["headers"]["WARC-Page-ID"] + r["record_type"]: r for r in got}
    assert len(got) == len(of) == 80 and {r["record_id"] for r in got} == {r["record_id"] for r in warc.derive(responses).collect()}
    for i in range(40):
        text, meta = of[f"{i}conversion"], json.loads(bytes(of[f"{i}metadata"]["block"]))
        assert bytes(text["block"]).decode() == (f"one {i}\ntwol" if i % 3 else "") and text["refers_to"] == of[f"{i}metadata"]["refers_to"]
        assert meta["html"] == ({"title": f"t {i}", "links": [{"tag": "a", "url": f"/{i}"}]} if i % 3 else {"title": None, "links": []})
