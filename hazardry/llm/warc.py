"""WARC archives: a writer of per-record gzip members with revisits, and a salvage reader.

Writing: of equal payloads the row with the largest id is a response, others are revisit records that name
it. Payload digests are grouped (combined before the shuffle), only groups of two or more are joined back. Each task
writes archives of bounded size below the shared folder, under names of its own attempt; the table of archives that
the job commits lists those of the attempts that succeeded, so files of lost attempts are never read.

Reading: an archive is a row of gzip members or of plain records. When a member does not inflate, a version line or length is wrong, or a
block fails its digest, the reader searches for the next member or version line that starts a whole record, logs
the bytes between as a quarantined gap, and goes on. Within a member, which may hold many records and may be cut off or damaged behind some of them, it goes on in the same
way over what inflates. Archives are read by pages and members are inflated by bounded pieces, so time and memory don't grow with an archive's length.

Defined results: ids are whole numbers. A null or empty payload is an empty one; all empty ones are equal (unless shorter than ``least``). Rows that share id and
payload are all responses if that id is the largest. A null id is written as such, and never wins. An empty
table gives no archives. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardry.llm.common import materialise, qualified, shared_path

ARCHIVE_BYTES = 32_000_000
#: Bytes that are inflated at a time.
PIECE = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_RECORD = "archive string, offset long, kind string, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap_bytes long, reason string"
_NAMES = [field.split()[0] for field in _RECORD.split(", ")]
_ARROW = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.int64(), pa.string()]


def digest(raw: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A WARC record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", uri)),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member."""
    made = zlib.compressobj(5, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


@dataclass
class Found:
    """A record that passed all checks."""

    end: int
    fields: dict[str, str]
    block: bytes


def parse(raw, at: int) -> Found:
    """The plain record at an offset; raises ValueError with the reason if a check fails."""
    if raw[at : at + len(VERSION)] != VERSION:
        raise ValueError("no version line")
    close = raw.find(b"\r\n\r\n", at)
    if close < 0:
        raise ValueError("no end of the header")
    fields = {}
    for line in raw[at:close].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    start = close + 4
    end = start + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("wrong content length")
    block = raw[start:end]
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest(block):
        raise ValueError("wrong block digest")
    return Found(end + 4, fields, block)


def inflate(raw, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at an offset inflates to, its end, and the reason where it is damaged or cut off (then the bytes before that)."""
    made, out, place = zlib.decompressobj(31), [], at
    while not made.eof:
        if not (piece := raw[place : place + PIECE]):
            return b"".join(out), place, "member is cut off"
        try:
            out.append(made.decompress(piece))
        except zlib.error:
            return b"".join(out), place, "member does not inflate"
        place += len(piece)
    return b"".join(out), place - len(made.unused_data), ""


class Places:
    """The next place of a pattern, searched for once."""

    def __init__(self, raw, pattern: bytes):
        self.raw, self.pattern, self.place = raw, pattern, -1

    def after(self, at: int) -> int:
        """The first place behind an offset; the length where there is none."""
        if self.place <= at:
            found = self.raw.find(self.pattern, at + 1)
            self.place = found if found >= 0 else len(self.raw)
        return self.place


Event = tuple[int, Found | None, int, str]


def plain_records(raw) -> Iterator[Event]:
    """Whole records and gaps of plain bytes, as salvage() tells them."""
    at, versions = 0, Places(raw, VERSION)
    while at < len(raw):
        start, reason = at, ""
        while at < len(raw):
            try:
                found = parse(raw, at)
                break
            except ValueError as err:
                reason = reason or str(err)
                at = versions.after(at)
        if at > start:
            yield start, None, at - start, reason
        if at < len(raw):
            yield at, found, 0, ""
            at = found.end


def salvage(raw) -> Iterator[Event]:
    """(offset, record, 0, "") for each whole record and (offset, None, bytes, reason) for each gap, in order.

    Records of a member, and gaps within one (counted in inflated bytes), have the member's offset. raw: bytes, or a Remote.
    """
    at, members, versions = 0, Places(raw, MAGIC), Places(raw, VERSION)
    gap, reason = None, ""  # where the open gap starts
    while at < len(raw):
        events: list[Event] = []
        end, why = at, ""
        if raw[at : at + len(MAGIC)] == MAGIC:
            text, end, why = inflate(raw, at)
            events = list(plain_records(text))
            if not any(found for _, found, _, _ in events):
                why = why or (events[0][3] if events else "member without a record")
                events = []
            elif why and events[-1][1] is None:
                events.pop()  # the cut-off rest belongs to the gap that follows
        else:
            try:
                found = parse(raw, at)
                events, end = [(at, found, 0, "")], found.end
            except ValueError as err:
                why = str(err)
        if events:
            if gap is not None:
                yield gap, None, at - gap, reason
                gap = None
            for _, found, size, said in events:
                yield at, found, size, f"within a member: {said}" if found is None else ""
        if why:
            if gap is None:
                gap, reason = at, why if not events else f"{why}, after {len(events)} records"
            at = min(members.after(at), versions.after(at))
        else:
            at = end
    if gap is not None:
        yield gap, None, len(raw) - gap, reason


class Remote:
    """A file read by pages: slices and find() as of bytes, of which a few pages are held."""

    def __init__(self, file, page: int = 1 << 22):
        self.file, self.page, self.size = file, page, file.size()
        self.held: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.size

    def _page(self, k: int) -> bytes:
        if k not in self.held:
            if len(self.held) >= 4:
                del self.held[min(self.held)]
            self.held[k] = self.file.read_at(min(self.page, self.size - k * self.page), k * self.page)
        return self.held[k]

    def __getitem__(self, part: slice) -> bytes:
        start, stop = min(part.start, self.size), min(part.stop, self.size)
        if stop <= start:
            return b""
        first, last = start // self.page, (stop - 1) // self.page
        if last > first + 2:  # a long block passes the pages by
            return self.file.read_at(stop - start, start)
        return b"".join(self._page(k) for k in range(first, last + 1))[start - first * self.page : stop - first * self.page]

    def find(self, pattern: bytes, start: int) -> int:
        while start < self.size:
            near = self[start : start + self.page]
            if (found := near.find(pattern)) >= 0:
                return start + found
            start += max(len(near) - len(pattern) + 1, 1)
        return -1


def _file_system(path: str):
    """The file system of a path that qualified() has made."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def marked(df: DataFrame, id_col: str, uri_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """(id, uri, payload, refers_to): refers_to is null for a response."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")
    ).withColumn("d", F.sha1(F.col("payload").cast("binary")))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("d").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.filter("n > 1").select("d", "target"), "payload-groups")
    large_enough = F.octet_length("payload") >= least
    return rows.join(groups, "d", "left").select("id", "uri", "payload", F.when(large_enough & ~F.col("id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write (id, uri, payload, refers_to) below a folder (a URI); the committed table of (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, where = _file_system(folder)
        store.create_dir(where, recursive=True)
        stem, number, held, size, count = uuid.uuid4().hex, 0, [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{stem}-{number:05d}.warc.gz"
            with store.open_output_stream(f"{where}/{name}", compression=None) as out:
                for part in held:
                    out.write(part)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for page, uri, payload, target in zip(*(batch.column(k) for k in range(4)), strict=True):
                kind = "response" if target.as_py() is None else "revisit"
                part = member(record(kind, f"urn:page:{page.as_py()}", uri.as_py(), payload.as_py().encode(), f"urn:page:{target.as_py()}"))
                held.append(part)
                size, count = size + len(part), count + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size, count = number + 1, [], 0, 0
        if held:
            yield close()

    return materialise(rows.mapInArrow(run, "archive string, records long"), "archives")


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """All records and gaps of the archives that a column ``archive`` names; see _RECORD for the columns.

    ``kind`` is "record" or "gap". One archive is read by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = _file_system(path)
                rows, size = [], 0
                with store.open_input_file(where) as file:
                    for at, found, gap, reason in salvage(Remote(file)):
                        if found is None:
                            rows.append((path, at, "gap", *[None] * 7, gap, reason))
                        else:
                            rows.append((path, at, *_told(found, keep_payload)))
                            size += len(found.block) if keep_payload else 0
                        if size > 8_000_000 or len(rows) >= 5000:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    spark = archives.sparkSession
    tasks = max(1, min(archives.count(), 32 * spark.sparkContext.defaultParallelism))
    return archives.select("archive").repartition(tasks).mapInArrow(run, _RECORD)


def _told(found: Found, keep_payload: bool) -> tuple:
    """The columns of a record from its kind to its gap."""
    get = found.fields.get
    head, _, payload = found.block.partition(b"\r\n\r\n") if found.block.startswith(b"HTTP/") else (b"", b"", found.block)
    whole = get("warc-type") != "revisit"
    told = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
    return (
        "record", get("warc-type"), get("warc-record-id", "").strip("<>"), get("warc-target-uri"), get("warc-refers-to", "").strip("<>") or None,
        digest(payload) if whole else get("warc-payload-digest", "").removeprefix("sha1:"),
        len(payload) if whole else int(told[1]) if told else 0, payload if whole and keep_payload else None, None, None,
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)


def round_trip(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, keep_payload: bool = False) -> DataFrame:
    """Write archives of all rows and read them back."""
    folder = qualified(df.sparkSession, shared_path(df.sparkSession, "warc"))
    return read_archives(write_archives(marked(df, id_col, uri_col, payload_col, least), folder), keep_payload)
