"""Legacy ARC archives and their conversion to WARC.

An ARC file begins with a version block, which names the version, 1 or 2, and so the fields of
the header line before every record. The last field is the length of what follows; nothing
else marks the end of a record. Conversion reads header lines by version, takes as many
bytes as declared, and synthesises what WARC wants and ARC lacks: a record id, a
full timestamp, a record type, content types and digests.

Files are streams of gzip members or plain bytes. A task holds one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize
from retentia.llm.files import new_name, open_to_read, open_to_write, spread
from retentia.llm.pretokens import bound_batches

# The header fields of either ARC version, as the version block spells them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP_END = b"\r\n\r\n"
KEY_HEADER = b"X-Page-Id"
KEY_FIELD = "X-Refers-To-Page-Id"
LEVEL = 1
EPOCH_DAY = "20000101"


@dataclass
class ArcRecord:
    """A record of an ARC file: header fields by name in lower case, and its content; ``short`` if the file ended early."""

    fields: dict[str, str]
    content: bytes
    short: bool = False

    @property
    def is_header(self) -> bool:
        return self.fields["url"].startswith("filedesc:")

    @property
    def is_http(self) -> bool:
        return self.content.startswith(b"HTTP/") and self.fields["url"].lower().startswith(("http:", "https:"))

    @property
    def payload(self) -> bytes:
        """What follows the HTTP headers; the whole content of other records."""
        return self.content.partition(HTTP_END)[2] if self.is_http else self.content

    def http_header(self, name: bytes) -> str | None:
        """Value of an HTTP header."""
        for line in self.content.partition(HTTP_END)[0].split(b"\r\n")[1:] if self.is_http else []:
            label, _, value = line.partition(b":")
            if label.strip().lower() == name.lower():
                return value.strip().decode("latin-1")
        return None


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str):
    source = open_to_read(uri)
    magic = source.read(2)
    source.seek(0)
    return gzip.open(source, "rb") if magic == b"\x1f\x8b" else source


def _line(stream) -> bytes:
    """The next line without its end; b"" at the end of the file."""
    if hasattr(stream, "readline"):
        return stream.readline()
    line = b""
    while (char := stream.read(1)) and char != b"\n":
        line += char
    return line + char


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC stream, the version block first.

    Raises ValueError where the version block is missing or names a version other than 1 or 2,
    or where a header line has too few fields or no length.
    """
    names = FIELDS[1].lower().split()
    while line := _line(stream):
        if not line.strip():
            continue
        # A URL may hold spaces; the fields after it cannot.
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if values[0].startswith("filedesc:") or " filedesc:" in values[0]:
            values = line.decode("utf-8", "replace").split()
        elif len(values) < len(names) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        length = int(values[-1])
        content = stream.read(length)
        record = ArcRecord(dict(zip(names, values)), content, len(content) < length)
        if record.is_header:
            version = content[:2].strip()
            if version not in (b"1", b"2"):
                raise ValueError(f"unknown ARC version: {content[:40]!r}")
            names = FIELDS[int(version)].lower().split()
            record.fields |= {"archive-length": values[-1], "version": version.decode()}
        yield record


def arc_header(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 retentia\n{FIELDS[version]}\n\n".encode()
    tail = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail} {len(body)}\n".encode() + body


def arc_record(url: str, date: str, content: bytes, version: int, name: str, offset: int) -> bytes:
    extra = "" if version == 1 else f" 200 {digest(content)} - {offset} {name}"
    return f"{quote(url, safe=':/?#[]@!$&()*+,;=%~')} 0.0.0.0 {date} text/html{extra} {len(content)}\n".encode() + content + b"\n"


def _http(key: int | None, payload: bytes) -> bytes:
    named = b"" if key is None else KEY_HEADER + b": %d\r\n" % key
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + b"Content-Length: %d" % len(payload) + HTTP_END + payload


def write_arc(pages: DataFrame, key: str, url: str, html: str, folder: str) -> DataFrame:
    """Write pages as gzipped ARC files, of version 1 and 2 by turns; one row (``file``, ``records``) per file.

    A null page is an empty payload; a null URL becomes one that names the key.
    ``folder`` must be one that executors share. No shuffle; an empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, sink, offset, records = 1 + part % 2, None, 0, 0
        uri = new_name(folder, f"pages-{part:06d}", ".arc.gz")
        name = uri.rpartition("/")[2]
        for batch in batches:
            for number, address, page in zip(*batch.columns):
                number = number.as_py()
                if sink is None:
                    sink = open_to_write(uri)
                    offset += sink.write(gzip.compress(arc_header(name, version, f"{EPOCH_DAY}000000"), LEVEL, mtime=0))
                payload = (page.as_py() or "").encode()
                second = (number or 0) % 86400
                date = f"{EPOCH_DAY}{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
                target = address.as_py() or f"http://unknown.invalid/{number}"
                if not target.lower().startswith(("http:", "https:")):
                    target = f"http://unknown.invalid/{target}"
                data = arc_record(target, date, _http(number, payload), version, name, offset)
                offset += sink.write(gzip.compress(data, LEVEL, mtime=0))
                records += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "records": [records]})

    chosen = bound_batches(pages).select(column(key).cast("long").alias("k"), column(url).alias("u"), column(html).alias("h"))
    return materialize(chosen.mapInArrow(run, "file string, records long"), "arc-files")


def index_arc(files: DataFrame) -> DataFrame:
    """One row per record of ARC files: ``file``, ``ordinal``, ``key``, ``payload_digest``, ``payload_bytes``, ``http``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with _open(name) as stream:
                    for ordinal, record in enumerate(read_arc(stream)):
                        key = record.http_header(KEY_HEADER)
                        payload = record.payload
                        rows.append((name, ordinal, int(key) if key else None, digest(payload), len(payload), record.is_http))
                yield pa.record_batch(list(map(pa.array, zip(*rows), types)), names)

    names = ["file", "ordinal", "key", "payload_digest", "payload_bytes", "http"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return spread(files.select("file")).mapInArrow(
        run, "file string, ordinal long, key long, payload_digest string, payload_bytes long, http boolean"
    )


def decide_revisits(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``index`` with ``revisit`` and ``refers_to``.

    Of HTTP records with equal payloads of at least ``least_bytes`` bytes, the one with the largest
    key is the response and the others revisit it; equal keys are told apart by file and
    ordinal, and a null key is the smallest. Records with smaller payloads, and those
    that are not HTTP, revisit nothing.
    """
    eligible = F.col("http") & (F.col("payload_bytes") >= least_bytes)
    largest = F.max(F.struct("key", "file", "ordinal"))
    groups = index.filter(eligible).groupBy("payload_digest").agg(largest.alias("original"), F.count(F.lit(1)).alias("count"))
    shared = materialize(groups.filter("count > 1"), "shared-payloads")
    on = F.when(eligible, F.col("payload_digest"))
    found = KeyTable(shared, "payload_digest", stored=True).attach(index, on, ["original"])
    here = F.struct("key", "file", "ordinal")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(here)
    return found.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("original.key"))}).drop("original")


def _warc(kind: str, record: ArcRecord, source: str, ordinal: int, refers_to: int | None) -> bytes:
    """A WARC record made from an ARC record."""
    payload = record.payload
    body = record.content[: len(record.content) - len(payload)] if kind == "revisit" else record.content
    date = record.fields["archive-date"].ljust(14, "0")
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    url = record.fields["url"]
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{source}#{ordinal} {url}")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{identity}>"), ("WARC-Date", when)]
    if kind == "warcinfo":
        fields += [("WARC-Filename", url.removeprefix("filedesc://"))]
    else:
        fields += [("WARC-Target-URI", url), ("WARC-IP-Address", record.fields["ip-address"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        fields += [(KEY_FIELD, str(refers_to))] if refers_to is not None else []
    if record.short:
        fields += [("WARC-Truncated", "length")]
    media = {"warcinfo": "text/plain", "resource": record.fields["content-type"]}.get(kind, "application/http; msgtype=response")
    fields += [("WARC-Block-Digest", f"sha1:{digest(body)}"), ("Content-Type", media), ("Content-Length", str(len(body)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{head}\r\n".encode() + body + HTTP_END


def convert(decided: DataFrame, folder: str) -> DataFrame:
    """Convert the ARC files named in ``decided`` (all their records, with decisions) to WARC files; one row per file.

    HTTP records become response or revisit, the version block warcinfo, any other record
    resource. A file is read once, from its beginning, by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, records, sink, count = None, iter(()), None, 0
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != source:
                    if sink is not None:
                        sink.close()
                        done.append((name, count))
                    source, count = row["file"], 0
                    records = enumerate(read_arc(_open(source)))
                    name = new_name(folder, source.rpartition("/")[2].removesuffix(".gz").removesuffix(".arc"), ".warc.gz")
                    sink = open_to_write(name)
                ordinal, record = next(records)
                if ordinal != row["ordinal"]:
                    raise ValueError(f"{source} has records without decisions")
                kind = "warcinfo" if record.is_header else "revisit" if row["revisit"] else "response" if record.is_http else "resource"
                sink.write(gzip.compress(_warc(kind, record, source.rpartition("/")[2], ordinal, row["refers_to"]), LEVEL, mtime=0))
                count += 1
        if sink is not None:
            sink.close()
            done.append((name, count))
            yield pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["file", "records"])

    rows = decided.select("file", "ordinal", "revisit", "refers_to")
    placed = spread(rows).sortWithinPartitions("file", "ordinal")
    return materialize(placed.mapInArrow(run, "file string, records long"), "warc-files")


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC stream; checks lengths and block digests."""
    while line := _line(stream):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := _line(stream)).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        stored = fields.get("warc-block-digest")
        if len(block) != int(fields["content-length"]) or stored and stored != f"sha1:{digest(block)}":
            raise ValueError(f"damaged WARC record {fields.get('warc-record-id')}")
        yield fields, block


def scan_warc(files: DataFrame) -> DataFrame:
    """One row per HTTP record of WARC files.

    ``key`` and ``refers_to`` long, ``payload_bytes`` (of the full payload, also of a revisit),
    ``payload_digest``, ``record_type``, ``record_id``, ``url`` and ``date``. The digest of a
    response is computed from its payload and must be the one in its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with _open(name) as stream:
                    for fields, block in read_warc(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        record = ArcRecord({"url": fields["warc-target-uri"]}, block)
                        stated = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest(record.payload) != stated:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                        size = len(record.payload) if kind == "response" else int(record.http_header(b"Content-Length"))
                        key, target = record.http_header(KEY_HEADER), fields.get(KEY_FIELD.lower())
                        numbers = int(key) if key else None, size, stated, kind, int(target) if target else None
                        rows.append((*numbers, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]))
                if rows:
                    yield pa.record_batch(list(map(pa.array, zip(*rows), types)), names)

    text, number = pa.string(), pa.int64()
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]
    types = [number, number, text, text, number, text, text, text]
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"
    return spread(files.select("file")).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, key: str, url: str, html: str, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write pages as ARC, convert the archives to WARC with revisits, and read these back (see ``scan_warc``).

    One row per page, repeated rows included; of these, too, only one is the response. Other
    columns are not carried.
    """
    legacy = write_arc(pages, key, url, html, f"{folder}/arc")
    index = materialize(index_arc(legacy), "arc-index")
    return scan_warc(convert(decide_revisits(index, least_bytes), f"{folder}/warc"))
