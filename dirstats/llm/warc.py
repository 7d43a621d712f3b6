"""A Spark data source for WARC archives, and pages archived with revisit records.

Reading: whole files are planned into partitions of about the same size. A record's headers are
parsed first; pushed-down predicates on the record type and other headers are tested on them,
and only a record that passes, and whose payload is wanted, is decoded further. Archives written
here note each record's compressed length in its gzip header, so that the rest of an unwanted
record is not even read; other archives are inflated to find a record's end.

Writing: a task writes files of a bounded size, and the driver then lists the files of all
finished tasks in a manifest, so that files of lost or repeated tasks are never read.

Files are opened by pyarrow's file systems: local paths, hdfs:// and the object stores that
pyarrow knows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from dirstats.llm.scratch import new_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, "
    "payload_digest string, refers_to string, payload_length long, "
    "headers map<string,string>, payload binary"
)
#: Columns that are headers, by the header's lower-case name.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_written.json"
HEAD = 4096
#: Bytes of an archive file after which a task begins another, and of a read partition.
FILE_BYTES = 256 * 1024 * 1024
BATCH_ROWS, BATCH_BYTES = 1000, 16 * 1024 * 1024


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header value in one line: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A gzip member with one WARC record and a note of both of its lengths."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 20 + len(body) + 8
    note = struct.pack("<HccHQQ", 20, b"S", b"L", 16, size, len(raw))
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + note + body + tail


def _page_record(row: dict) -> bytes:
    payload = row["payload"] or b""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = row["refers_to"] is not None or row["record_type"] == "revisit"
    headers = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", record_id(row["page_id"])),
        ("WARC-Date", row["date"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", _clean(row["url"])))
    if row["page_id"] is not None:
        headers.append(("X-Page-Id", str(row["page_id"])))
    if revisit:
        headers.append(("WARC-Profile", PROFILE))
        if row["refers_to"] is not None:
            headers.append(("WARC-Refers-To", record_id(row["refers_to"])))
            headers.append(("X-Refers-To-Page", str(row["refers_to"])))
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    return encode_record(headers, http + (b"" if revisit else payload))


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    data = _page_record(row)
                    out.write(data)
                    size += len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        files = [] if self.overwrite else _manifest(system, folder) or []
        files += [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = _open(self.path)
        for message in messages:
            for name in message.files if message is not None else []:
                system.delete_file(f"{folder}/{name}")


def _manifest(system: fs.FileSystem, folder: str) -> list[str] | None:
    name = f"{folder}/{MANIFEST}"
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(name) as f:
        return json.loads(f.read())


@dataclass
class _Files(InputPartition):
    files: list[str]


class _Input:
    """A file read forward, with a little of it held."""

    def __init__(self, source):
        self.source, self.at, self.held = source, 0, b""

    def peek(self, n: int) -> bytes:
        if len(self.held) < n:
            self.held += self.source.read(max(n - len(self.held), 1 << 16))
        return self.held[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.source.seek(self.source.tell() + n - len(self.held))
            self.held = b""


class _Plain:
    """The bytes of one record of an archive that is not compressed."""

    def __init__(self, data: _Input):
        self.data, self.taken = data, 0

    def take(self, n: int) -> bytes:
        got = self.data.peek(n)
        self.data.skip(len(got))
        self.taken += len(got)
        return got

    def give_back(self, some: bytes) -> None:
        self.data.held = some + self.data.held
        self.taken -= len(some)

    def finish(self, size: int) -> None:
        self.data.skip(size - self.taken)
        while self.data.peek(2) == b"\r\n":
            self.data.skip(2)


class _Member:
    """The bytes of one gzip member, inflated as they are taken. A member without a note of its
    length can hold several records."""

    def __init__(self, data: _Input):
        self.data, self.length, self.used = data, None, 0
        self.held, self.taken = b"", 0
        head = data.peek(12)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        if head[3] & 4:
            (extra,) = struct.unpack("<H", head[10:12])
            fields, at = data.peek(12 + extra)[12:], 0
            while at + 4 <= len(fields):
                (n,) = struct.unpack("<H", fields[at + 2 : at + 4])
                if fields[at : at + 2] == b"SL" and n == 16:
                    self.length, _ = struct.unpack("<QQ", fields[at + 4 : at + 20])
                at += 4 + n
        self.inflate = zlib.decompressobj(31)
        self.rest = b""

    def take(self, n: int) -> bytes:
        out = [self.held[:n]]
        self.held = self.held[n:]
        n -= len(out[0])
        while n > 0 and not self.inflate.eof:
            part = self.inflate.unconsumed_tail
            if not part:
                room = 1 << 16 if self.length is None else min(1 << 16, self.length - self.used)
                part = self.data.peek(room)
                if not part:
                    raise ValueError("an archive ends inside of a record")
                self.data.skip(len(part))
                self.used += len(part)
            got = self.inflate.decompress(part, n)
            if self.inflate.eof and self.inflate.unused_data:
                self.data.held = self.inflate.unused_data + self.data.held
            out.append(got)
            n -= len(got)
        found = b"".join(out)
        self.taken += len(found)
        return found

    def give_back(self, some: bytes) -> None:
        self.held = some + self.held
        self.taken -= len(some)

    def finish(self, size: int) -> None:
        """Goes on to the next record of the member, whose first bytes are then held, or to the
        member's end."""
        if self.length is not None:
            self.held = b""
            self.data.skip(self.length - self.used)
            return
        while self.taken < size:
            if not self.take(min(1 << 20, size - self.taken)):
                raise ValueError("a member ends inside of a record")
        self.taken = 0
        while more := self.take(1 << 10):
            if rest := more.lstrip(b"\r\n"):
                self.give_back(rest)
                break
        self.taken = 0


def _headers(text: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a continued line belongs to the one before."""
    out, last = {}, None
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: str, verify: bool, partition_bytes: int):
        self.path, self.payload, self.verify = path.rstrip("/"), payload, verify
        self.partition_bytes = partition_bytes
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Predicates on header columns are tested on the headers; all others stay with Spark."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()) or ())
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[column], "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[column], "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[column], "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[column], "is", None))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        system, folder = _open(self.path)
        names = _manifest(system, folder)
        if names is None:
            found = system.get_file_info(fs.FileSelector(folder))
        else:
            found = system.get_file_info([f"{folder}/{n}" for n in names]) if names else []
        files = sorted(
            ((f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))),
            key=lambda x: (-x[1], x[0]),
        )
        plans: list[_Files] = []
        room = 0
        for path, size in files:
            if not plans or size > room:
                plans.append(_Files([]))
                room = self.partition_bytes
            plans[-1].files.append(path)
            room -= size
        return plans or [_Files([])]

    def _passes(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            own = headers.get(name)
            if own is None or (kind == "in" and own not in value):
                return False
            if kind == "starts" and not own.startswith(value):
                return False
        return True

    def _records(self, source, gzip: bool) -> Iterator[dict]:
        data, member = _Input(source), None
        while (member is not None and member.held) or data.peek(4):
            if not gzip:
                record = _Plain(data)
            elif member is None or not member.held:
                record = member = _Member(data)
            head, end = b"", -1
            while end < 0:
                more = record.take(HEAD)
                if not more:
                    raise ValueError("a record without an end of its headers")
                head += more
                end = head.find(b"\r\n\r\n")
            headers = _headers(head[:end])
            block = int(headers.get("content-length", 0))
            have = head[end + 4 :]
            wanted = self._passes(headers)
            if wanted:
                yield self._row(headers, have, block, record)
            # the record may have been read past its end
            if len(have) > block and record.taken <= len(head):
                record.give_back(have[block:])
            record.finish(end + 4 + block)

    def _row(self, headers: dict[str, str], have: bytes, block: int, record) -> dict:
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        http = headers.get("content-type", "").startswith("application/http")
        have = have[:block]
        body = have.find(b"\r\n\r\n") + 4 if http else 0
        while http and body < 4 and len(have) < block:
            more = record.take(min(HEAD, block - len(have)))
            if not more:
                break
            have += more
            body = have.find(b"\r\n\r\n") + 4
        body = body if not http or body >= 4 else 0
        inner = _headers(have[:body]) if body else {}
        length = inner.get("content-length")
        row["payload_length"] = int(length) if length and length.isdigit() else block - body
        row["headers"] = list(headers.items())
        row["payload"] = None
        kept = self.payload == "all" or self.payload == row["record_type"]
        if kept and row["record_type"] != "revisit":
            rest = record.take(block - len(have)) if block > len(have) else b""
            row["payload"] = have[body:] + rest
            if self.verify:
                digest = base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()
                told = (row["payload_digest"] or "").removeprefix("sha1:")
                if told and told != digest:
                    raise ValueError(f"{row['record_id']}: payload digest {digest}, not {told}")
        return row

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows, size = [], 0
        for name in partition.files:
            with system.open_input_file(name) as source:
                for row in self._records(source, name.endswith(".gz")):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 1000
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema(
    [
        *((c, pa.string()) for c in HEADERS),
        ("payload_length", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder): one row per record, in the columns of SCHEMA.
    Options: payload (all, none, or the one record type whose payloads are decoded; all),
    verify (compare decoded payloads with their digests; false), partitionBytes.

    df.write.format("warc").mode(...).save(folder): df has page_id, url, payload (binary),
    record_type, refers_to (a page_id) and date; revisit records are written without payload.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(
            o["path"],
            o.get("payload", "all"),
            o.get("verify", "false").lower() == "true",
            int(o.get("partitionBytes", FILE_BYTES)),
        )

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def enable(spark: SparkSession) -> None:
    """Make the format known to the session, with predicate push-down for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_roles(pages: DataFrame, from_bytes: int = 0) -> DataFrame:
    """The rows a WARC is written from: of pages with equal payloads of at least from_bytes
    bytes the one with the least page_id is the response and the others revisit it; of several
    rows with that page_id one is the response. A null html is an empty payload. A null page_id
    is a response only if no equal payload has an id, as a revisit could not name it.

    Rows are told apart by number, so pages must read alike twice, as a table does. Payloads are
    shuffled by that number; digests are compared without them. Equal digests meet only within
    their part of the input: of all parts that hold a digest, one row each is compared.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
    )
    named = (
        rows.where(F.octet_length("payload") >= from_bytes)
        .select(
            F.unhex(F.sha1("payload")).alias("digest"),
            F.shiftright("row_id", 33).alias("part"),
            "page_id",
            "row_id",
        )
        .repartition("digest", "part")
    )
    rank = F.struct(F.col("page_id").isNull(), "page_id", "row_id")
    in_parts = named.groupBy("digest", "part").agg(F.min(rank).alias("least"), F.count("*").alias("n"))
    firsts = (
        in_parts.groupBy("digest")
        .agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
        .where("n > 1 and least.page_id is not null")
        .select("digest", F.explode("parts").alias("part"), "least.page_id", "least.row_id")
        .toDF("digest", "part", "first", "response")
    )
    again = (
        named.join(firsts, ["digest", "part"])
        .where("row_id <> response")
        .select("row_id", "first", F.lit("revisit").alias("role"))
    )
    return rows.join(again, "row_id", "left").select(
        "page_id",
        "url",
        "payload",
        F.coalesce("role", F.lit("response")).alias("record_type"),
        F.col("first").alias("refers_to"),
        F.lit("2020-01-01T00:00:00Z").alias("date"),
    )


def archive(pages: DataFrame, path: str, from_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as WARC files under path, a record per row."""
    enable(pages.sparkSession)
    with_roles(pages, from_bytes).write.format("warc").mode("append").save(path)


def records(spark: SparkSession, path: str, payload: str = "all", verify: bool = False) -> DataFrame:
    """The records of the archives under path."""
    enable(spark)
    reader = spark.read.format("warc").option("payload", payload)
    return reader.option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame, path: str | None = None, from_bytes: int = 0) -> DataFrame:
    """Archive pages and read the archives back: one row per row of pages with page_id,
    payload_bytes, payload_digest (base32 SHA-1), record_type and refers_to (the page_id of the
    response that a revisit repeats). Responses are decoded and held against their digests.
    Repeated rows are each archived; other columns are ignored."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    archive(pages, path, from_bytes)
    found = records(spark, path, verify=True).where(
        F.col("record_type").isin("response", "revisit")
    )
    return found.select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        F.col("headers")["x-refers-to-page"].cast("long").alias("refers_to"),
    )
