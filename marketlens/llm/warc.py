"""WARC archives: pages written one gzip member per record, and read back in sequence.

Writing. The SHA-1 of every payload is taken by Spark, and of the records with
equal payloads one is the response; the others are revisit records that hold
the HTTP header alone and refer to it. Each task streams its rows into files of
its own under the archive folder, and returns one manifest row per file. The
manifest is written through Spark's commit, so the files of a failed or
repeated attempt are never listed and never read.

Reading. One sequential pass per file: bytes are inflated as they arrive, one
gzip member per record, the block is framed by its Content-Length, and both
digests of the record are computed over the bytes on the way. A reader holds
one chunk and, if payloads are asked for, one payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.joins import heavy_groups, salted_join
from marketlens.session import ensure_checkpoint_dir, write_through

from .common import FILE, ROW, quoted, with_row_id

MIN_BYTES = 0  # payloads below this many bytes are never revisits
ARCHIVE_BYTES = 1 << 30  # compressed size at which a task begins the next file
CHUNK = 1 << 18
MAX_HEADER = 1 << 26
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "writer int, archive string, records long, bytes long"
RECORDS = ("archive string, offset long, record_type string, record_id string, refers_to_record string, target_uri string, "
           "row_id string, payload_bytes long, payload_digest string, verified boolean")


def _sha1(h) -> str:
    return "sha1:" + base64.b32encode(h.digest()).decode()


def _record_id(file: int, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(file & (1 << 64) - 1) << 64 | row & (1 << 64) - 1)}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record(kind: str, record_id: str, date: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    """One record as one gzip member."""
    head = _header([("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields,
                    ("WARC-Block-Digest", _sha1(hashlib.sha1(block))), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _page_record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(row["digest"]).decode())]
    if row["url"] is not None:  # control characters and spaces would end the field or the line
        fields.append(("WARC-Target-URI", quote(row["url"], safe="".join(chr(c) for c in range(33, 127)))))
    if row["id"] is not None:
        fields.append(("X-Row-Id", quote(row["id"], safe="")))
    me = _record_id(row["file"], row["row"])
    if row["at_file"] is None:
        return record("response", me, date, http + payload, fields)
    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(row["at_file"], row["at_row"]))]
    return record("revisit", me, date, http, fields)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, date: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, part = None, [], TaskContext.get().partitionId()
        try:
            for b in batches:
                for at in range(0, b.num_rows, 64):  # rows become Python objects a few at a time
                    for row in b.slice(at, 64).to_pylist():
                        if out is None:
                            name = f"{folder}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                            system, path = _place(name)
                            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                            out = system.open_output_stream(path, compression=None)
                            info = record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, b"format: WARC File Format 1.1\r\n",
                                          [("Content-Type", "application/warc-fields")])
                            out.write(info)
                            n, size = 0, len(info)
                        data = _page_record(row, date)
                        out.write(data)
                        n, size = n + 1, size + len(data)
                        if size >= limit:
                            out.close()
                            done.append((part, name, n, size))
                            out = None
            if out is not None:
                out.close()
                done.append((part, name, n, size))
                out = None
        finally:
            if out is not None:
                out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["writer", "archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   body_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   date: str | None = None) -> DataFrame:
    """Writes one record per row of ``pages`` and returns the manifest (writer,
    archive, records, bytes), one row per file.

    The payload is the body's UTF-8 bytes (null: empty). Of the rows with equal
    payloads of at least ``min_bytes`` bytes the one with the smallest id is
    the response (a null id last; of rows that repeat it, the first in file
    order) and the others revisit it; all smaller ones are responses. Null url
    or id: the field is left out. ``folder`` must be seen by all executors (by
    default a new one under ``spark.checkpoint.dir``). Payloads move at most
    once, and not at all where the revisits are few enough to be broadcast by
    Spark. An empty table writes no file; other columns are ignored."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_row_id(pages).select(
        F.col(FILE).alias("file"), F.col(ROW).alias("row"), quoted(id_col).alias("id"),
        quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    digests = write_through(rows.select("file", "row", "id", F.unhex(F.sha1("payload")).alias("digest"),
                                        F.octet_length("payload").cast("long").alias("n_bytes")), "payload-digests")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    groups = write_through(digests.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(
        F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select(
        "digest", "n", F.col("first.file").alias("at_file"), F.col("first.row").alias("at_row")), "payload-groups")
    # one payload may be that of a third of all pages
    seen = digests.where(F.col("n_bytes") >= min_bytes).select("digest", "file", "row")
    again = salted_join(seen, groups.drop("n"), ["digest"], hot=heavy_groups(groups, ["digest"], "n"))
    revisits = write_through(again.where("file != at_file or row != at_row").select("file", "row", "at_file", "at_row"), "revisits")
    told = rows.join(revisits, ["file", "row"], "left").select(
        "file", "row", F.col("id").cast("string").alias("id"), "url", "at_file", "at_row",
        F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"),
        F.when(F.col("at_file").isNull(), F.col("payload")).alias("payload"))
    return write_through(told.mapInArrow(_writer(folder, date, archive_bytes), MANIFEST), "warc-manifest")


class _Members:
    """The bytes of a file of gzip members, inflated as they are asked for.
    ``offset`` is where the present member begins."""

    def __init__(self, stream, name: str):
        self.stream, self.name, self.buffer = stream, name, bytearray()
        self.offset = self.used = 0  # compressed bytes: at the member's start, and handed to zlib
        self.rest, self.z = b"", None

    def fail(self, why: str):
        raise ValueError(f"{self.name} at {self.offset}: {why}")

    def next_member(self) -> bool:
        """False at the end of the file."""
        if self.buffer or (self.z is not None and not self.z.eof and self._more()):
            self.fail("bytes after the record")
        if self.z is not None and not self.z.eof:
            self.fail("the member is cut off")
        self.rest = self.rest or self.stream.read(CHUNK)
        if not self.rest:
            return False
        self.offset, self.z = self.used, zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """Inflate one chunk more of this member; False at its end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.rest or self.stream.read(CHUNK)
            if not data:
                self.fail("the member is cut off")
            try:
                out = self.z.decompress(data, CHUNK)
            except zlib.error as e:
                self.fail(str(e))
            left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.used += len(data) - len(left)
            self.rest = left if self.z.eof else b""
            self.buffer += out
            if out:
                return True
        return False

    def until(self, end: bytes) -> bytes:
        """The bytes up to and with ``end``."""
        start = 0
        while (at := self.buffer.find(end, start)) < 0:
            start = max(0, len(self.buffer) - len(end) + 1)
            if len(self.buffer) > MAX_HEADER or not self._more():
                self.fail("a header without an end")
        got = bytes(self.buffer[:at + len(end)])
        del self.buffer[:at + len(end)]
        return got

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in chunks."""
        while n:
            if not self.buffer and not self._more():
                self.fail("the block is shorter than its Content-Length")
            part = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(part)
            yield part


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(stream, name: str, payloads: bool = True) -> Iterator[dict]:
    """The records of one open archive in sequence; the framing is checked,
    and ``verified`` tells whether the digests of the header are those of the
    bytes (of a revisit: of its block; its payload is elsewhere)."""
    members = _Members(stream, name)
    while members.next_member():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            members.fail("no WARC record")
        f = _fields(head)
        if not f.get("content-length", "").isdigit():
            members.fail("no Content-Length")
        kind, http = f.get("warc-type", ""), f.get("content-type", "").startswith("application/http")
        block, body, held, n, inner = hashlib.sha1(), hashlib.sha1(), [], 0, bytearray()
        in_body = not http
        for part in members.exactly(int(f["content-length"])):
            block.update(part)
            if not in_body:
                inner += part
                at = inner.find(b"\r\n\r\n")
                if at < 0:
                    if len(inner) > MAX_HEADER:
                        members.fail("an HTTP header without an end")
                    continue
                in_body, part = True, bytes(inner[at + 4:])
                del inner[at + 4:]
            body.update(part)
            n += len(part)
            if payloads:
                held.append(part)
        if members.until(b"\r\n\r\n") != b"\r\n\r\n":
            members.fail("no record end")
        same = f.get("warc-block-digest", _sha1(block)) == _sha1(block)
        if kind == "revisit":
            n = int(_fields(bytes(inner)).get("content-length", 0))
        else:
            same = same and f.get("warc-payload-digest", _sha1(body)) == _sha1(body)
        row_id = f.get("x-row-id")
        yield {"archive": name, "offset": members.offset, "record_type": kind, "record_id": f.get("warc-record-id"),
               "refers_to_record": f.get("warc-refers-to"), "target_uri": f.get("warc-target-uri"),
               "row_id": None if row_id is None else unquote(row_id), "payload_bytes": n,
               "payload_digest": f.get("warc-payload-digest", _sha1(body)).removeprefix("sha1:"), "verified": same,
               "payload": b"".join(held) if payloads and kind != "revisit" else None}


def _reader(payloads: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * payloads
    types = {"offset": pa.int64(), "payload_bytes": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("archive").to_pylist():
                system, path = _place(name)
                with system.open_input_stream(path, compression=None) as stream:
                    held, size = [], 0
                    for r in read_records(stream, name, payloads):
                        held.append(r)
                        size += len(r["payload"] or b"")
                        if len(held) == 1000 or size > 16 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names=names)

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives of a ``manifest``: RECORDS, and the payload
    where it is asked for. The files of one writer are read by one task.
    Broken framing or a member that is cut off is an error that names the file
    and the offset; a digest that differs sets ``verified`` to false."""
    top = manifest.agg(F.max("writer")).first()[0]
    schema = RECORDS + ", payload binary" * payloads
    return manifest.select("writer", "archive").repartitionById((top or 0) + 1, F.col("writer")).mapInArrow(_reader(payloads), schema)


def page_records(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per response or revisit: (id, payload_bytes, payload_digest,
    record_type, refers_to, verified), ``refers_to`` the id of the response a
    revisit refers to. A revisit is verified when that record is a response
    with the same digest and size. ``records`` is read twice: pass a table."""
    pages = records.where(F.col("record_type").isin("response", "revisit"))
    out = ["record_id", F.col("row_id").cast(id_type).alias("id"), "payload_bytes", "payload_digest", "record_type", "refers_to_record", "verified"]
    responses, revisits = (pages.where(F.col("record_type") == k).select(*out) for k in ("response", "revisit"))
    per_target = write_through(revisits.groupBy("refers_to_record").agg(F.count("*").alias("n")), "targets")
    found = per_target.join(responses.select(
        F.col("record_id").alias("refers_to_record"), F.col("id").alias("refers_to"), F.col("payload_digest").alias("d"),
        F.col("payload_bytes").alias("b")), "refers_to_record").drop("n")
    hot = heavy_groups(per_target, ["refers_to_record"], "n")
    told = salted_join(revisits, found, ["refers_to_record"], "left", hot=hot).withColumn(
        "verified", F.col("verified") & F.coalesce((F.col("d") == F.col("payload_digest")) & (F.col("b") == F.col("payload_bytes")), F.lit(False)))
    cols = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    return responses.withColumn("refers_to", F.lit(None).cast(id_type)).select(*cols).unionByName(told.select(*cols))


def round_trip(pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """``page_records`` of the archives written from ``pages``: one row per
    row of ``pages``."""
    manifest = write_archives(pages, id_col=id_col, **how)
    records = write_through(read_archives(manifest, payloads=False), "warc-records")
    return page_records(records, pages.schema[id_col].dataType.simpleString())
