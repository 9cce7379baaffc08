"""Legacy archive converter: ARC files become WARC files.

`write_arc` writes pages as ARC files, version 1 or 2; `convert` reads ARC files by their version's header
line and declared lengths and writes WARC files with made-up but stable identifiers, ISO timestamps, types
and digests; `read_warc` reads those back record by record. Files are written and read inside tasks through
pyarrow's filesystems, in the folder that driver and executors share, each record its own gzip member. A
task's files get names of their own, and only the manifest of the tasks that succeeded (a Parquet table)
says which count, so a task that runs twice leaves no record twice.

Null html is an empty payload, a null url an urn made from the page id. Payloads equal to one of at least
100 bytes on a page with a smaller id become revisits of it; rows that repeat the smallest id are all
responses. A null page id is never the smallest. Empty tables give no rows. Extra columns are not read. A
record is held in memory whole; files are rolled at FILE_BYTES.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes (before compression) after which a new file is begun.
FILE_BYTES = 16 << 20
#: Equal payloads below this are kept in full.
REVISIT_BYTES = 100
SOFTWARE = "legacy archive converter"
#: First lines of ARC files: the fields that each version's record lines have.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long"


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


class Roller:
    """Writes gzip members to files below a folder and begins a new file when one is full."""

    def __init__(self, folder: str, kind: str, first):
        self.folder, self.kind, self.first = folder, kind, first
        self.out = None
        self.done: list[tuple[str, int, int]] = []

    def _begin(self) -> None:
        self.file = f"{self.folder}/{uuid.uuid4().hex}.{self.kind}.gz"
        fs, path = _open(self.file)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.records, self.bytes, self.at = fs.open_output_stream(path, compression=None), 0, 0, 0
        self._put(self.first(self.file.rpartition("/")[2]))

    def _put(self, data: bytes) -> None:
        member = gzip.compress(data, 1, mtime=0)
        self.out.write(member)
        self.at += len(member)
        self.bytes += len(data)

    def offset(self) -> int:
        """Where the next record will begin."""
        if self.out is None:
            self._begin()
        return self.at

    def write(self, record: bytes) -> None:
        if self.out is None:
            self._begin()
        self._put(record)
        self.records += 1
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.file, self.records, self.bytes))
            self.out = None


def members(uri: str) -> Iterator[bytes]:
    """The gzip members of a file, one at a time; the file is streamed."""
    fs, path = _open(uri)
    with fs.open_input_stream(path, compression=None) as f:
        rest, engine, parts = b"", None, []
        while True:
            if not rest:
                rest = f.read(1 << 20)
                if not rest:
                    break
            if engine is None:
                engine, parts = zlib.decompressobj(31), []
            parts.append(engine.decompress(rest))
            rest = engine.unused_data if engine.eof else b""
            if engine.eof:
                yield b"".join(parts)
                engine = None
    if engine is not None:
        raise ValueError(f"{uri} ends within a record")


# --- ARC


def arc_first(version: int, name: str, date: str) -> bytes:
    """The version block that begins an ARC file; its own length is declared in its first line."""
    body = f"{version} 0 {SOFTWARE}\n{ARC_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_url(url: str | None, page_id) -> str:
    """The url as a field of a line: bytes up to the space and DEL are percent-encoded."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def arc_record(version: int, url: str, date: str, page_id, payload: bytes, offset: int, name: str) -> bytes:
    key = "" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {key}\r\n\r\n".encode()
    checksum = hashlib.md5(payload).hexdigest()
    extra = "" if version == 1 else f" 200 {checksum} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} text/html{extra} {len(head) + len(payload)}\n".encode("utf-8", "surrogatepass") + head + payload + b"\n"


def arc_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the record line, content) of an ARC file, by its version's field list and declared lengths."""
    fields: list[str] = []
    for data in members(uri):
        line, _, rest = data.partition(b"\n")
        values = line.decode("utf-8", "surrogatepass").split(" ")
        length = int(values[-1])
        content = rest[:length]
        if len(content) != length:
            raise ValueError(f"{uri}: a record of {len(content)} bytes declares {length}")
        if values[0].startswith("filedesc:"):
            _, described = content.decode().split("\n")[:2]
            fields = described.split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"{uri}: a record line of {len(values)} fields; its version has {len(fields)}")
        yield dict(zip(fields, values, strict=True)), content


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> DataFrame:
    """pages (page_id, url, html) as ARC files; even tasks write version 1, odd ones version 2. The manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        roller = Roller(folder, "arc", lambda name: arc_first(version, name, date))
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                at = roller.offset()
                roller.write(arc_record(version, arc_url(url, page_id), date, page_id, payload, at, roller.file.rpartition("/")[2]))
        roller.close()
        yield _manifest(roller)

    return cut(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, MANIFEST))


def _manifest(roller: Roller) -> pa.RecordBatch:
    files, records, sizes = zip(*roller.done, strict=True) if roller.done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])


# --- conversion


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, header block, payload) of an HTTP response."""
    head, gap, payload = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").lower()] = value.strip().decode("latin-1")
    return fields, head + gap, payload


def iso_date(date: str) -> str:
    """An ARC date of 4 to 14 digits as WARC-Date; what is missing is the earliest."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page_id: str, digest: str) -> str:
    """The same record gets the same identifier however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id} {digest}')}>"


def page_key(fields: dict[str, str]) -> int | None:
    key = fields.get("x-page-id", "")
    return int(key) if key else None


def warc_type(fields: dict[str, str], content: bytes) -> str:
    """HTTP answers are responses; anything else that an ARC file holds is a resource."""
    return "response" if content.startswith(b"HTTP/") else "resource"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def warc_first(name: str) -> bytes:
    body = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.0\r\n".encode()
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def _per_file(manifest: DataFrame) -> DataFrame:
    """The manifest's rows dealt over tasks in turn, about one file each; adaptive execution doesn't merge them."""
    return manifest.repartition(max(1, min(manifest.count(), 100_000)))


PAYLOADS = "file string, page_id long, payload_bytes long, payload_digest string, url string, date string"


def _content(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    return http_parts(content) if content.startswith(b"HTTP/") else ({}, b"", content)


def payloads(manifest: DataFrame) -> DataFrame:
    """What the conversion must know of every record of the ARC files; no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for line, content in arc_records(file):
                    fields, _, payload = _content(content)
                    rows.append((file, page_key(fields), len(payload), hashlib.sha256(payload).hexdigest(), line["URL"], line["Archive-date"]))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PAYLOADS.split(", ")])

    return _per_file(manifest.select("file")).mapInArrow(run, PAYLOADS)


def revisits(found: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """The records that revisit another: file, page_id, payload_digest and what they refer to.

    The first record of each digest is found by an aggregate that adds up before the shuffle. Many copies
    of one digest then meet that single row in a join, which adaptive execution splits.
    """
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date")))
    originals = found.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("n"), first.alias("first")).where((F.col("n") > 1) & F.col("first").isNotNull())
    return (
        found.select("file", "page_id", "payload_digest")
        .join(originals, "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        .select("file", "page_id", "payload_digest", F.col("first.page_id").alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"))
    )


def converted(line: dict[str, str], content: bytes, to: tuple | None) -> bytes:
    """One ARC record as a WARC record; `to` is (page id, url, ARC date) of the record that it revisits."""
    fields, head, payload = _content(content)
    url, date, key = line["URL"], line["Archive-date"], fields.get("x-page-id", "")
    digest = hashlib.sha256(payload).hexdigest()
    kind = warc_type(fields, content) if to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(url, date, key, digest)), ("WARC-Date", iso_date(date)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if to is not None:
        to_id, to_url, to_date = to
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(to_url, to_date, str(to_id), digest)), ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", iso_date(to_date)), ("X-Refers-To-Page-Id", str(to_id))]
    block = head if to is not None else content
    headers += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response" if head else line["Content-type"])]
    return warc_record(headers, block)


def convert(manifest: DataFrame, folder: str) -> DataFrame:
    """ARC files to WARC files below folder, one for one; returns their manifest.

    A file's revisits come as one row beside it: no more of them than the file has records.
    """
    to = revisits(cut(payloads(manifest))).groupBy("file").agg(F.collect_list(F.struct("page_id", "payload_digest", "to_id", "to_url", "to_date")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = {(r["page_id"], r["payload_digest"]): (r["to_id"], r["to_url"], r["to_date"]) for r in refers or ()}
                roller = Roller(folder, "warc", warc_first)
                for line, content in arc_records(file):
                    fields, _, payload = _content(content)
                    target = known.get((page_key(fields), hashlib.sha256(payload).hexdigest())) if known else None
                    roller.write(converted(line, content, target))
                roller.close()
                yield _manifest(roller)

    return cut(_per_file(cut(manifest.select("file").join(to, "file", "left"))).mapInArrow(run, MANIFEST))


# --- reading WARC


def warc_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a WARC file."""
    for data in members(uri):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{uri}: {lines[0]!r} begins no record")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        length = int(fields["content-length"])
        if rest[length:] != b"\r\n\r\n":
            raise ValueError(f"{uri}: a record doesn't end where its length says")
        yield fields, rest[:length]


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string"


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every response, resource and revisit record of the WARC files, with its payload on request.

    Digests of payloads are computed anew and held against the headers.
    """
    schema = RECORDS + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for fields, block in warc_records(file):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = _content(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "revisit":
                        size, to = int(http.get("content-length", 0)), fields.get("x-refers-to-page-id")
                    else:
                        size, to = len(payload), None
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{file}: the payload of {fields['warc-record-id']} isn't what its digest says")
                    rows.append((page_key(http), size, digest, kind, int(to) if to else None, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"], payload)[: len(names)])
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return _per_file(manifest.select("file")).mapInArrow(run, schema)
