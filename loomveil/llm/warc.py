"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: pages are hashed where they are read; only digests are grouped, with partial aggregation, so
that one payload may make up any share of the rows.  Pages then meet the table of repeated payloads in
a sort-merge join, whose hot keys Spark splits (adaptive skew join).  Tasks write archives of bounded
size, one gzip member a record, into the shared folder; a manifest table names the archives of tasks
that succeeded, so that files of failed or repeated attempts are never read.

Reading: archives are dealt out by the manifest and read as streams through a bounded window.  After
a failed check (bad gzip data, version line, header, length, or digest) the reader looks for the next
member or version line that starts a valid record, goes on from there, and logs the bytes between as a
quarantined gap; a record whose digest alone fails is passed over to its declared end.  Members are
inflated as streams, and sound records around damage inside one are given.  The window keeps the
compressed bytes of a member until its end, as a search may have to start over behind its first byte.

Defined cases: a null payload is empty; payloads under ``least_bytes`` always make response records;
among equal payloads every row with the largest page_id is a response; control characters in a URL
are percent-encoded; a null URL or page_id is left out of the record; an empty table gives no archive
and no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomveil.llm.shared import new_path

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64_000_000
#: more than the writer makes of a row, which Spark holds to under 2 GiB, with every character of its URL escaped
MAX_RECORD = 1 << 33
CHUNK = 1 << 18
DATE = "2026-01-01T00:00:00Z"
_GZIP = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_ID = "urn:x-page:"

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
GAPS = "path string, first_byte bigint, end_byte bigint, reason string"


def _safe(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record; revisits carry the headers of the reply alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{_ID}{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _open(path: str, mode: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "w":
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each page."""
    own = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col].cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    large = own.where(F.octet_length("payload") >= least_bytes)
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when((F.octet_length("payload") >= least_bytes) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))), F.col("first"))
    return own.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, compressed: bool = True) -> DataFrame:
    """Writes a record per page into archives in folder; returns the manifest, itself a stored table."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        count = size = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            ids, urls, payloads, digests, refers = batch.columns
            for i in range(batch.num_rows):
                data = record_bytes(ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), bytes.fromhex(digests[i].as_py()), refers[i].as_py())
                data = member(data) if compressed else data
                if out is not None and size + len(data) > archive_bytes:
                    yield done()
                    out = None
                if out is None:
                    path, count, size = f"{folder}/archives/{uuid.uuid4().hex}.warc" + ".gz" * compressed, 0, 0
                    out = _open(path, "w")
                out.write(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            yield done()

    with_revisits(pages, least_bytes).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Window:
    """A stream seen through a buffer that moves forward."""

    def __init__(self, stream):
        self.stream, self.base, self.data, self.ended = stream, 0, b"", False

    def end(self, to: int) -> int:
        """Reads up to the byte ``to`` if there is one; returns the end of what is there."""
        if to > self.base + len(self.data) and not self.ended:
            parts = [self.data]
            have = self.base + len(self.data)
            while have < to:
                more = self.stream.read(max(CHUNK, min(to - have, CHUNK * 16)))
                if not more:
                    self.ended = True
                    break
                parts.append(bytes(more))
                have += len(more)
            self.data = b"".join(parts)
        return self.base + len(self.data)

    def get(self, a: int, b: int) -> bytes:
        self.end(b)
        return self.data[a - self.base : b - self.base]

    def forget(self, a: int) -> None:
        if a - self.base >= CHUNK:
            self.data, self.base = self.data[a - self.base :], a

    def find(self, what: bytes, a: int, limit: int | None = None) -> int:
        while True:
            to = a + CHUNK if limit is None else min(a + CHUNK, limit)
            end = min(self.end(to), to)
            at = self.data.find(what, a - self.base, end - self.base)
            if at >= 0:
                return at + self.base
            if end < to or (limit is not None and end >= limit):
                return -1
            a = max(a + 1, end - len(what) + 1)


class Bad(Exception):
    """A failed check; end is where the record was declared to end, if it does end there."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _parse(get, find, end, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a byte; raises Bad."""
    if get(at, at + 7) != _VERSION:
        raise Bad("version line")
    headers: dict[str, str] = {}
    stop = find(b"\r\n", at, at + MAX_RECORD)
    while stop >= 0 and get(stop, stop + 4) != b"\r\n\r\n":
        a, stop = stop + 2, find(b"\r\n", stop + 2, at + MAX_RECORD)
        name, colon, value = get(a, max(a, stop)).decode("utf-8", "replace").partition(":")
        if not colon:
            raise Bad("header")
        headers[name.strip().lower()] = value.strip()
    if stop < 0:
        raise Bad("header")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or int(length) > MAX_RECORD:
        raise Bad("length")
    first, last = stop + 4, stop + 4 + int(length)
    if end(last + 4) < last + 4:
        raise Bad("truncated")
    if get(last, last + 4) != b"\r\n\r\n":
        raise Bad("record end")
    block = get(first, last)
    said = headers.get("warc-block-digest", "")
    if said.lower().startswith("sha1:") and said[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Bad("block digest", last + 4)
    return headers, block, last + 4


class Member:
    """The data of the gzip member at a byte of a window, as a stream; ``to`` is the end of what was read,
    ``failed`` says why the data ends early."""

    def __init__(self, view: Window, at: int):
        self.view, self.to, self.failed, self.unpack = view, at, "", zlib.decompressobj(31)

    def read(self, size: int) -> bytes:
        while not self.unpack.eof and not self.failed:
            chunk = self.view.get(self.to, self.to + CHUNK)
            try:
                data = self.unpack.decompress(chunk, size)
            except zlib.error:
                self.failed = "gzip data"
                break
            self.to += len(chunk) - len(self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail)
            if data:
                return data
            if not chunk:
                self.failed = "truncated member"
        return b""


def _next_start(view: Window, at: int) -> int:
    """The next byte that may start a member or a record; -1 at the end."""
    while True:
        end = view.end(at + CHUNK)
        hits = [h for h in (view.find(_GZIP, at, end), view.find(_VERSION, at, end)) if h >= 0]
        if hits:
            return min(hits)
        if view.ended and end == view.end(at + 2 * CHUNK):
            return -1
        at = max(at + 1, end - 6)


def _plain(view: Window, at: int) -> tuple[dict[str, str], bytes, int]:
    return _parse(view.get, view.find, view.end, at)


def _of_member(view: Window, at: int, expected: bool) -> Iterator[tuple]:
    """Records of the gzip member at a byte, and a gap of the whole member for each run of bytes inside it that
    holds none; last ("end", the byte after the member).  Raises Bad where it is damaged itself, after
    the records that have more data behind them.  A member that was only searched for must start with a version line."""
    member = Member(view, at)
    data = Window(member)
    if data.get(0, len(_VERSION)) != _VERSION and not (expected and data.end(1)):
        raise Bad(member.failed or "version line")
    pos, reason, held = 0, "", None
    while data.end(pos + 1) > pos:
        if held:
            yield "record", *held
            held = None
        try:
            *held, pos = _plain(data, pos)
        except Bad as e:
            reason = reason or str(e)
            pos = e.end or data.find(_VERSION, pos + 1)
            if pos < 0:
                break
        else:
            if reason and not member.failed:
                yield "gap", reason
            reason = ""
        data.forget(pos)
    if member.failed:
        raise Bad(member.failed)
    if held:
        yield "record", *held
    if reason:
        yield "gap", reason
    yield "end", member.to


def salvage(stream) -> Iterator[tuple]:
    """("record", first byte, headers, block) and ("gap", first byte, end byte, reason), in order.

    A record that fails its digest but ends where it should is passed over whole, so that its payload is
    never read as records.  Of a gzip member with many records all sound ones are given; the gaps between
    them have the bounds of the member."""
    view, at, gap, reason = Window(stream), 0, None, ""
    while view.end(at + 1) > at:
        missing: list[str] = []
        try:
            if view.get(at, at + 3) == _GZIP:
                for what, *rest in _of_member(view, at, gap is None):
                    if what == "end":
                        to = rest[0]
                        continue
                    if gap is not None:
                        yield "gap", gap, at, reason
                        gap = None
                    if what == "gap":
                        missing.append(rest[0])
                    else:
                        yield "record", at, *rest
            else:
                headers, block, to = _plain(view, at)
                if gap is not None:
                    yield "gap", gap, at, reason
                    gap = None
                yield "record", at, headers, block
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            at = e.end or _next_start(view, at + 1)
            if at < 0:
                break
        else:
            for why in missing:
                yield "gap", at, to, why
            at = to
        view.forget(at if gap is None else at - 1)
    if gap is not None:
        yield "gap", gap, view.end(view.base + len(view.data) + 1), reason


def _number(value: str | None) -> int | None:
    tail = (value or "").strip("<>").removeprefix(_ID)
    return int(tail) if tail.lstrip("-").isdigit() else None


def page_row(headers: dict[str, str], block: bytes) -> tuple:
    """The row of RECORDS for a record; raises Bad if the payload is not the one that was digested."""
    kind = headers.get("warc-type")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = headers.get("warc-payload-digest", "")
    digest = base64.b32decode(said[5:]).hex() if said.startswith("sha1:") else None
    if kind == "revisit":
        size = next((int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
    else:
        size, own = len(payload), hashlib.sha1(payload).hexdigest()
        if digest is not None and digest != own:
            raise Bad("payload digest")
        digest = own
    return _number(headers.get("warc-record-id")), size, digest, kind, _number(headers.get("warc-refers-to")), headers.get("warc-target-uri")


def _scan(manifest: DataFrame, schema: str, rows) -> DataFrame:
    """Runs rows(path) for each archive of the manifest, as many tasks as archives at most."""
    spark = manifest.sparkSession
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    kinds = [arrow[c.strip().split(" ")[1]] for c in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    if len(held) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks).mapInArrow(read, schema)


def read_pages(manifest: DataFrame) -> DataFrame:
    """The page rows of all records that can be recovered from the archives of a manifest."""

    def rows(path: str) -> Iterator[tuple]:
        with _open(path, "r") as stream:
            for what, _, *rest in salvage(stream):
                if what == "record":
                    try:
                        row = page_row(*rest)
                    except Bad:
                        continue  # logged as a gap by read_gaps
                    yield row

    return _scan(manifest, RECORDS, rows)


def read_gaps(manifest: DataFrame) -> DataFrame:
    """The quarantined byte ranges of the archives of a manifest, with reasons."""

    def rows(path: str) -> Iterator[tuple]:
        with _open(path, "r") as stream:
            for what, first, *rest in salvage(stream):
                if what == "gap":
                    yield path, first, rest[0], rest[1]
                else:
                    try:
                        page_row(*rest)
                    except Bad as e:
                        yield path, first, None, str(e)

    return _scan(manifest, GAPS, rows)


def manifest_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A manifest of given archives, such as ones from elsewhere."""
    return spark.createDataFrame([(p, None, None) for p in paths], MANIFEST)
