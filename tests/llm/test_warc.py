import base64
import hashlib

import pytest

from packwright.llm import warc
from packwright.session import fresh_path

PAGES = [
    (1, "http://a/x", "<p>one</p>"), (2, "http://a/y z\n", "<p>two</p>"), (3, None, "<p>one</p>"), (3, None, "<p>one</p>"),
    (None, "http://n", "<p>two</p>"), (4, "http://e", None), (5, "http://e", ""), (None, "u", "alone"), (None, "u", "alone"),
    (6, "http://w", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n\n\n"), (7, "http://u", "é\U0001f600" * 50_000),
]
SCHEMA = "page_id bigint, url string, html string, digest string, file string"


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "d", "f") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("version", [1, 2])
def test_there_and_back(spark, version):
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    rows = warc.report(warc.convert(pages_of(spark, PAGES), arc, out, version)).collect()
    assert len(rows) == len(PAGES)
    payload = {}
    for i, _, html in PAGES:
        payload.setdefault((html or "").encode(), []).append(i)
    for data, ids in payload.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        mine = [r for r in rows if r.payload_digest == digest]
        leader = max(ids, key=lambda i: -1 if i is None else i)
        assert sorted(str(r.page_id) for r in mine) == sorted(map(str, ids))
        assert {r.payload_bytes for r in mine} == {len(data)}
        responses = [r for r in mine if r.record_type == "response"]
        assert [(r.page_id, r.refers_to) for r in responses] == [(leader, None)]
        assert all(r.refers_to == leader for r in mine if r.record_type == "revisit")


def test_small_payloads_may_all_be_responses(spark):
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    rows = warc.report(warc.convert(pages_of(spark, PAGES), arc, out, revisit_from_bytes=1)).collect()
    assert [r.record_type for r in rows if r.payload_bytes == 0] == ["response"] * 2
    assert sum(r.record_type == "revisit" for r in rows) == 4


def test_no_pages(spark):
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    assert warc.report(warc.convert(pages_of(spark, []), arc, out)).collect() == []


def test_files_are_archives(spark):
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    warc.convert(pages_of(spark, PAGES, 1), arc, out)
    content = warc._archives(spark, arc).first().content
    records = list(warc.arc_records(bytes(content)))
    assert len(records) == len(PAGES) and {f["Content-type"] for _, f, _ in records} == {"text/html"}
    found = [f for r in warc._archives(spark, out).collect() for f, _ in warc.warc_records(bytes(r.content))]
    kinds = [f["WARC-Type"] for f in found]
    assert kinds.count("warcinfo") >= 1 and kinds.count("response") + kinds.count("revisit") == len(PAGES)
    assert len({f["WARC-Record-ID"] for f in found}) == len(found)
    assert {f["WARC-Date"] for f in found} == {"2024-01-01T00:00:00Z"}
    assert all(f["WARC-Profile"] == warc.REVISIT_PROFILE for f in found if f["WARC-Type"] == "revisit")


def arc(text, version=1):
    import gzip

    block = f"{version} 0 x\n{warc.ARC_FIELDS.get(version, '')}\n"
    tail = " 200 - - 0 f" if version == 2 else ""
    return gzip.compress(f"filedesc://x 0.0.0.0 20200101000000 text/plain{tail} {len(block)}\n{block}\n".encode()) + gzip.compress(text.encode())


def test_arc_by_declared_lengths_over_gzip_members():
    one = "http://a 1.2.3.4 20200101000000 text/html 7\nab\nhttp\n"
    assert [(f["URL"], b) for _, f, b in warc.arc_records(arc(one + one))] == [("http://a", b"ab\nhttp")] * 2
    two = "http://a 1.2.3.4 20200101000000 text/html 200 - - 0 f 2\nab\n"
    assert [(f["Result-code"], b) for _, f, b in warc.arc_records(arc(two, 2))] == [("200", b"ab")]


@pytest.mark.parametrize(
    "data, message",
    [
        (arc("http://a 1.2.3.4 20200101000000 text/html 70\nab\n"), "inside a record"),
        (arc("http://a 20200101000000 text/html 2\nab\n"), "fields"),
        (arc("", 3), "unknown ARC version"),
        (arc("http://a 1.2.3.4 20200101000000 text/html 2\nab\n")[:-9], "gzip member"),
    ],
)
def test_broken_archives_are_errors(data, message):
    with pytest.raises(ValueError, match=message):
        list(warc.arc_records(data))


REAL = [
    ("dns:example.org", "text/dns", b"20200101000000\nexample.org. 10800 IN A 1.2.3.4\n"),
    ("http://a/lf", "text/html", b"HTTP/1.0 200 OK\nServer: x\n\n<p>line feeds</p>\r\n\r\nrest"),
    ("http://a/png", "image/png", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n\x1a\n\x00\xff\xfe\r\n\r\n\x80"),
    ("http://a/latin", "text/html; charset=latin-1", b"HTTP/1.1 200 OK\r\nX: caf\xe9\r\n\r\n" + "caf\u00e9".encode("latin-1")),
    ("http://a/no border", "text/html", b"HTTP/1.1 204 No Content\r\nX-Page-Id: none\r\n"),
    ("ftp://a/file", "", bytes(range(256))),
    ("http://a/again", "image/png", b"HTTP/1.1 200 OK\r\nAge: 1\r\n\r\n\x89PNG\r\n\x1a\n\x00\xff\xfe\r\n\r\n\x80"),
    ("http://a/caf\xe9", "no-type", b""),
]
PAYLOADS = [
    REAL[0][2], b"<p>line feeds</p>\r\n\r\nrest", b"\x89PNG\r\n\x1a\n\x00\xff\xfe\r\n\r\n\x80", b"caf\xe9",
    b"", bytes(range(256)), b"\x89PNG\r\n\x1a\n\x00\xff\xfe\r\n\r\n\x80", b"",
]
HTTP = {1, 2, 3, 4, 6}


def real_archive(version=1):
    block = f"{version} 0 x\n{warc.ARC_FIELDS[version]}\n".encode()
    tail = " 200 - - 0 f" if version == 2 else ""
    out = f"filedesc://x 0.0.0.0 20200101000000 text/plain{tail} {len(block)}\n".encode() + block + b"\n"
    for url, kind, content in REAL:
        out += f"{url} 1.2.3.4 20200102030405 {kind}{tail} {len(content)}\n".encode("latin-1") + content + b"\n"
    return out


@pytest.mark.parametrize("version, packed", [(1, True), (2, True), (1, False)])
def test_archives_of_others(spark, tmp_path, version, packed):
    """Look-ups, bare line feeds, pictures, Latin-1, no border, blanks in fields: payload bytes as they are."""
    import gzip

    data = real_archive(version)
    name = "IA-0001.arc" + ".gz" * packed
    (tmp_path / name).write_bytes(gzip.compress(data) if packed else data)
    folder, out = str(tmp_path), fresh_path(spark, "warc")
    parsed = warc.read_arc(spark, folder, with_payload=True).orderBy("place").collect()
    assert [bytes(r.payload) for r in parsed] == PAYLOADS
    assert [bytes(r.http) + bytes(r.payload) for r in parsed] == [c for _, _, c in REAL]
    assert [(r.url, r.content_type) for r in parsed] == [(u, k) for u, k, _ in REAL]
    assert all(r.page_id is None for r in parsed)

    read = warc.convert_archives(spark, folder, out).collect()
    found = [x for r in warc._archives(spark, out).collect() for x in warc.warc_records(bytes(r.content)) if x[0]["WARC-Type"] != "warcinfo"]
    by_url = {f["WARC-Target-URI"]: (f, block) for f, block in found}
    assert len(read) == len(found) == len(by_url) == len(REAL)
    kinds = {}
    for i, (url, kind, content) in enumerate(REAL):
        fields, block = by_url[warc.header_url(url)]
        digest = base64.b32encode(hashlib.sha1(PAYLOADS[i]).digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}" and fields["WARC-Date"] == "2020-01-02T03:04:05Z"
        kinds.setdefault(PAYLOADS[i], []).append(fields["WARC-Type"])
        if fields["WARC-Type"] == "revisit":
            assert block == (content[: len(content) - len(PAYLOADS[i])] if i in HTTP else b"")
        else:
            assert fields["WARC-Type"] == ("response" if i in HTTP else "resource") and block == content
            if i not in HTTP:
                assert fields["Content-Type"] == (kind or "application/octet-stream")
    assert all(len([k for k in ks if k != "revisit"]) == 1 for ks in kinds.values())
    assert {r.record_id for r in read} == {f["WARC-Record-ID"].strip("<>") for f, _ in found}
    again = warc.convert_archives(spark, folder, fresh_path(spark, "warc")).collect()
    assert sorted(map(str, again)) == sorted(map(str, read))
