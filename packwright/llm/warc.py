"""Legacy archives to WARC.

``write_arc`` puts pages into ARC files (version 1 or 2), ``read_arc`` parses them by the
header line of their version and the declared lengths, ``write_warc`` writes equivalent
WARC records with made-up identifiers, timestamps, types and digests, ``read_warc`` reads
those. Files are written and read by Spark, one per task, so any store it reaches will do.

Archives may be gzip files of any number of members, or plain. Contents are bytes, of any
encoding. A record whose content begins with an HTTP status line is a response: its payload
begins behind the first empty line, CRLF or LF, and is empty where there is none. Any other
record (``dns:`` look-ups, ``ftp:`` files) is a resource, and all of its content is payload.
Record ids are made from file name and place, so converting the same archives again gives
the same ids. An archive is one row while it is read, so it has to stay below 2 GB.
"""

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a record's header line, by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_ID = b"X-Page-Id"
BATCH_BYTES = 8 << 20
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
# The fixed fields stand behind the URL and around the content type; both may hold blanks.
ARC_LINE = {
    1: re.compile(r"(.+) (\S+) (\d{12}(?:\d\d)?) (.*) (\d+)"),
    2: re.compile(r"(.+) (\S+) (\d{12}(?:\d\d)?) (.*) (\S+) (\S+) (\S+) (\d+) (\S+) (\d+)"),
}

RECORD = (
    "file string, place long, page_id long, url string, archive_date string, content_type string, "
    "http binary, payload_bytes long, digest string"
)
READ_BACK = "record_id string, refers_to_id string, page_id long, record_type string, payload_bytes long, digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Archive:
    """A plain file or a gzip stream of any number of members, read by lines and by lengths."""

    def __init__(self, content: memoryview | bytes):
        self.rest, self.at = memoryview(content), 0
        self.plain = bytes(self.rest[:2]) != b"\x1f\x8b"
        self.inflater, self.held, self.done = None, bytearray(), 0

    def _fill(self) -> bool:
        while self.at < len(self.rest) or self.inflater is not None:
            if self.plain:
                self.held += self.rest[self.at : self.at + (1 << 18)]
                self.at += 1 << 18
                return True
            if self.inflater is None:
                self.inflater = zlib.decompressobj(31)
            chunk = self.rest[self.at : self.at + (1 << 18)]
            data = self.inflater.decompress(chunk)
            self.at += len(chunk) - len(self.inflater.unused_data)
            if self.inflater.eof:
                self.inflater = None
            elif not len(chunk):
                raise ValueError("archive ends inside a gzip member")
            if data:
                self.held += data
                return True
        return False

    def _drop(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.done += n
        return out

    def line(self) -> bytes:
        """Up to and with the next line feed; empty at the end."""
        while (found := self.held.find(b"\n")) < 0:
            if not self._fill():
                return self._drop(len(self.held))
        return self._drop(found + 1)

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._fill():
                raise ValueError(f"archive ends {n - len(self.held)} bytes inside a record")
        return self._drop(n)


def http_block(page_id: int | None, size: int) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    if page_id is not None:
        lines.append(f"{PAGE_ID.decode()}: {page_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its empty line, and the payload; no header if it is not HTTP."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    border = EMPTY_LINE.search(content)
    return (content[: border.end()], content[border.end() :]) if border else (content, b"")


def page_id_of(http: bytes) -> int | None:
    """The page id in a header that ``write_arc`` made; null for other headers."""
    for line in http.split(b"\n")[1:]:
        name, _, value = line.partition(b":")
        if name == PAGE_ID and re.fullmatch(rb"-?[0-9]{1,18}", value.strip()):
            return int(value)
    return None


def header_text(line: bytes) -> str:
    """A header line in UTF-8 or, as older archives have it, in Latin-1."""
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def header_url(url: str | None) -> str:
    """A header line is cut at blanks, so blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "unknown:-"


def _batches(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])


def _write(rows: DataFrame, folder: str, ending: str) -> None:
    """The bytes of each row and an ending. Spark's cast to text and its writer leave bytes as they are."""
    rows.select(F.col("value").cast("string")).write.option("lineSep", ending).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED"
    ).text(folder)


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000", version: int = 1) -> None:
    """One ARC file per task: a version block, then a record per page (null html: empty)."""
    fields = ARC_FIELDS[version]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        block = f"{version} 0 packwright\n{fields}\n".encode()
        tail = ["200", "-", "-", "0", "pages.arc"] if version == 2 else []
        begun = False
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                if not begun:
                    first = ["filedesc://pages.arc", "0.0.0.0", date, "text/plain", *tail, str(len(block))]
                    yield " ".join(first).encode() + b"\n" + block
                    begun = True
                payload = html.as_py() or b""
                content = http_block(page_id.as_py(), len(payload)) + payload
                line = [header_url(url.as_py()), "0.0.0.0", date, "text/html", *tail, str(len(content))]
                yield " ".join(line).encode() + b"\n" + content

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(records(batches))

    source = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    _write(source.mapInArrow(write, "value binary"), folder, "\n")


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def arc_records(content) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place in the archive, header fields, content) of each record after the version block."""
    archive, names = Archive(content), None
    while True:
        place, line = archive.done, archive.line()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        text = header_text(line).rstrip("\r\n")
        length = text.rpartition(" ")[2]
        if not length.isdecimal():
            raise ValueError(f"a header line without a length: {text[:200]!r}")
        body = archive.take(int(length))
        if names is None:
            if not text.startswith("filedesc://"):
                raise ValueError("an ARC file begins with a version block")
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = ARC_FIELDS[version].split(" ")
            continue
        values = ARC_LINE[version].fullmatch(text)
        if not values:
            raise ValueError(f"a header line without the fields of version {version}: {text[:200]!r}")
        yield place, dict(zip(names, values.groups())), body


def read_arc(spark: SparkSession, folder: str, with_payload: bool) -> DataFrame:
    """The records of all ARC files, with their payload or only its length and digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("file", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                ("archive_date", pa.string()), ("content_type", pa.string()),
                ("http", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()),
                *([("payload", pa.binary())] if with_payload else []),
            ]
        )
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for place, fields, body in arc_records(content.as_buffer()):
                    http, payload = split_http(body)
                    row = {
                        "file": path.as_py().rsplit("/", 1)[1], "place": place, "page_id": page_id_of(http),
                        "url": fields["URL"], "archive_date": fields["Archive-date"],
                        "content_type": fields["Content-type"], "http": http,
                        "payload_bytes": len(payload), "digest": payload_digest(payload),
                    }
                    if with_payload:
                        row["payload"] = payload
                    rows.append(row)
                    size += 512 + (len(payload) if with_payload else 0)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _archives(spark, folder).mapInArrow(parse, RECORD + (", payload binary" if with_payload else ""))


def decide(records: DataFrame, revisit_from_bytes: int = 0) -> DataFrame:
    """``file, place, record_id, refers_to_id``: the last is null for responses.

    Of records with equal payloads the one with the largest page id is the response; of
    repeated ids the one that stands last, and a null id is below all others. Payloads
    shorter than ``revisit_from_bytes`` are all responses.
    """
    identity = lambda r: F.concat_ws(":", r("file"), r("place"))
    # A name made from a hash, in the form of a UUID.
    uuid = lambda r: F.concat(
        F.lit("urn:uuid:"), F.regexp_replace(F.md5(identity(r)), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-a$4-$5")
    )
    here = lambda name: F.col(name)
    last = records.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "file", "place")).alias("leader"))
    joined = records.join(last, ["digest", "payload_bytes"])
    of_leader = lambda name: F.col("leader")[name]
    itself = (identity(here) == identity(of_leader)) | (F.col("payload_bytes") < revisit_from_bytes)
    return joined.select(
        "file", "place", uuid(here).alias("record_id"), F.when(~itself, uuid(of_leader)).alias("refers_to_id")
    )


def write_warc(records: DataFrame, decisions: DataFrame, folder: str) -> None:
    """A WARC file per task. Records carry their payload; revisits are written without it."""

    def spell(fields: list[tuple[str, str]], block: bytes) -> bytes:
        lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block

    def warc(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        begun = False
        for batch in batches:
            for row in (dict(zip(batch.schema.names, values)) for values in zip(*batch.columns)):
                value = {k: v.as_py() for k, v in row.items() if k != "payload"}
                d = value["archive_date"].ljust(14, "0")
                date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                if not begun:
                    info = b"software: packwright\r\nformat: WARC File Format 1.0\r\n"
                    name = "urn:uuid:" + re.sub(
                        "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", r"\1-\2-5\3-a\4-\5", hashlib.sha256(value["record_id"].encode()).hexdigest()
                    )
                    yield spell(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                        info,
                    )
                    begun = True
                refers = value["refers_to_id"]
                fields = [
                    ("WARC-Type", "revisit" if refers else "response" if value["http"] else "resource"),
                    ("WARC-Record-ID", f"<{value['record_id']}>"),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", header_url(value["url"])),
                    ("WARC-Payload-Digest", f"sha1:{value['digest']}"),
                ]
                if refers:
                    fields += [("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", REVISIT_PROFILE)]
                plain = value["content_type"].strip() or "application/octet-stream"
                fields.append(("Content-Type", "application/http; msgtype=response" if value["http"] else plain))
                yield spell(fields, value["http"] + (b"" if refers else row["payload"].as_py()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(warc(batches))

    joined = records.join(decisions, ["file", "place"]).select(
        "record_id", "refers_to_id", "archive_date", "url", "content_type", "digest", "http",
        F.when(F.col("refers_to_id").isNull(), F.col("payload")).alias("payload"),
    )
    _write(joined.mapInArrow(write, "value binary"), folder, "\r\n\r\n")


def warc_records(content) -> Iterator[tuple[dict[str, str], bytes]]:
    archive = Archive(content)
    while line := archive.line():
        if line != b"WARC/1.0\r\n":
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := archive.line()) not in (b"\r\n", b""):
            name, _, value = header_text(line).rstrip("\r\n").partition(": ")
            fields[name] = value
        yield fields, archive.take(int(fields["Content-Length"]))
        if archive.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it declares")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, refers_to_id, page_id, record_type, payload_bytes, digest`` of all responses,
    resources and revisits. A payload that has not the digest in its header is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("record_id", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()),
                ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()),
            ]
        )
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in warc_records(content.as_buffer()):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    http, payload = (b"", block) if kind == "resource" else split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and payload_digest(payload) != digest:
                        raise ValueError(f"payload and digest of {fields['WARC-Record-ID']} differ")
                    rows.append(
                        {
                            "record_id": fields["WARC-Record-ID"].strip("<>"),
                            "refers_to_id": fields["WARC-Refers-To"].strip("<>") if kind == "revisit" else None,
                            "page_id": page_id_of(http),
                            "record_type": kind,
                            "payload_bytes": len(payload) if kind != "revisit" else None,
                            "digest": digest,
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _archives(spark, folder).mapInArrow(parse, READ_BACK)


def convert(pages: DataFrame, arc: str, warc: str, version: int = 1, revisit_from_bytes: int = 0) -> DataFrame:
    """Pages to ARC files, those to WARC files, and those read back as rows."""
    write_arc(pages, arc, version=version)
    return convert_archives(pages.sparkSession, arc, warc, revisit_from_bytes)


def convert_archives(spark: SparkSession, arc: str, warc: str, revisit_from_bytes: int = 0) -> DataFrame:
    """A folder of ARC files to WARC files, and those read back as rows."""
    decisions = decide(read_arc(spark, arc, with_payload=False), revisit_from_bytes)
    write_warc(read_arc(spark, arc, with_payload=True), decisions, warc)
    return read_warc(spark, warc)


def report(read: DataFrame) -> DataFrame:
    """One row per page record; revisits take the length from the response they refer to."""
    target = read.where(F.col("record_type") != "revisit").select(
        F.col("record_id").alias("refers_to_id"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("target_bytes"),
    )
    return read.join(target, "refers_to_id", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
