"""WARC records in ZIP-packaged archives.

Written: archives with a stored member of gzipped WARC records and a stored index of their places. Read
without extraction: the end record, the ZIP64 records and the central directory are parsed, the stored
members located, the index read, and records read by ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import file_system, lean, materialize, scratch, ship_code

ARCHIVE_BYTES = 64 * 1024 * 1024
READ_BYTES = 4 * 1024 * 1024
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


# Reading


@dataclass
class Member:
    name: str
    method: int
    flags: int
    packed: int
    size: int
    header: int  # place of the local header


class ZipDirectory:
    """The members of a ZIP file, from its central directory; `read(at, length)` gives ranges of the file."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        tail_at = max(0, size - 22 - 65535)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file, or cut off")
        _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        end = tail_at + at
        count, length, start, end = self._zip64(end, count, length, start)
        shift = end - length - start  # bytes before the first member, as in self-extracting files
        if shift < 0:
            raise ValueError("central directory out of place")
        self.members = {m.name: m for m in self._central(read(start + shift, length), count, shift)}

    def _zip64(self, end: int, count: int, length: int, start: int) -> tuple[int, int, int, int]:
        """The ZIP64 record's values where there is one before the end record, and where the directory ends."""
        locator = self.read(end - 20, 20) if end >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            if 0xFFFFFFFF in (length, start):
                raise ValueError("ZIP64 locator missing")
            return count, length, start, end
        at = struct.unpack_from("<Q", locator, 8)[0]
        record = self.read(at, 56) if at + 56 <= end else b""
        if record[:4] != b"PK\x06\x06":
            at = end - 20 - 56
            record = self.read(at, 56) if at >= 0 else b""
            if record[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record out of place")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
        return count, length, start, at

    @staticmethod
    def _central(data: bytes, count: int, shift: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, names, extras, comment = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = data[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                k += 4 + length
            yield Member(name, method, flags, packed, size, header + shift)
            at += 46 + names + extras + comment

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member are: start, length."""
        m = self.members[name]
        if m.method or m.flags & 1 or m.packed != m.size:
            raise ValueError(f"{name} isn't stored")
        local = self.read(m.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        names, extras = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + names + extras, m.size


def parse_headers(data: bytes) -> tuple[str, dict[str, str], int]:
    """First line, headers by lower-case name, and the length with the empty line."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("headers without an end")
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    headers = {}
    for line in lines:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return first, headers, end + 4


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one unpacked record."""
    version, headers, at = parse_headers(data)
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    block = data[at : at + int(headers["content-length"])]
    _, http, body = parse_headers(block)
    return headers, http, block[body:]


class ArchiveReader:
    """Reads records of an archive by ranges, in order of their places, by its index."""

    def __init__(self, path: str):
        fs, name = file_system(path)
        self.file = fs.open_input_file(name)
        self.directory = ZipDirectory(self._range, self.file.size())

    def _range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("archive cut off")
        return data

    def entries(self) -> list[dict]:
        """Index lines of all index members, as dictionaries with `key` besides their own fields."""
        found = []
        for name in sorted(self.directory.members):
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                for line in filter(None, self._range(*self.directory.place(name)).decode().split("\n")):
                    key, _, rest = line.partition(" {")
                    found.append({"key": key, **json.loads("{" + rest)})
        return found

    def records(self, entries: Iterable[dict] | None = None) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        """The records of index entries (all, if none are given); neighbours share a range of some MB."""
        rows = sorted(self.entries() if entries is None else entries, key=lambda e: (e["filename"], e["offset"]))
        group: list[dict] = []
        for e in [*rows, None]:
            if group and (e is None or e["filename"] != group[0]["filename"] or e["offset"] + e["length"] - group[0]["offset"] > READ_BYTES):
                start, size = self.directory.place("archive/" + group[0]["filename"])
                first, last = group[0]["offset"], group[-1]["offset"] + group[-1]["length"]
                if last > size:
                    raise ValueError("index points beyond its member")
                data = self._range(start + first, last - first)
                for g in group:
                    yield parse_record(zlib.decompress(data[g["offset"] - first : g["offset"] - first + g["length"]], 31))
                group = []
            if e is not None:
                group.append(e)


# Writing


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def of_urn(value: str | None) -> int | None:
    found = value[len("<urn:x-page:") : -1] if value else ""
    return int(found) if found else None


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A whole WARC record; a revisit has no payload, its HTTP header keeps the length of the full one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes one archive to a sink: records as they come, the index at the end."""

    def __init__(self, sink):
        self.sink = sink
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, url: str, digest: str, data: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.data.write(member)
        name = json.dumps({"url": url, "digest": f"sha1:{digest}", "offset": self.at, "length": len(member), "filename": DATA.partition("/")[2]})
        self.lines.append(f"{url.partition('://')[2].replace(' ', '%20')} 19700101000000 {name}".replace("\n", "%0A").replace("\r", "%0D"))
        self.at += len(member)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "".join(line + "\n" for line in sorted(self.lines)))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.sink.close()


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row and returns the manifest of archives.

    Of records with equal payloads (by SHA-1) of at least `min_bytes`, that with the smallest page_id is
    the response and the others revisit it; a null page_id is never the smallest unless all are null.
    Null html is an empty payload, a null url an empty one; repeated rows are each written, with the
    type of their page_id; an empty table gives no archives. Each attempt of a task writes archives of its own names, and only the
    manifest of the successful one counts.
    """
    spark = pages.sparkSession
    ship_code(spark)
    folder = folder or scratch(spark, "archives")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"))

    def run(batches):
        from pyspark import TaskContext

        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        writer, name, done = None, "", []

        def end():
            writer.close()
            done.append((f"{folder}/{name}", len(writer.lines), writer.at))

        for batch in batches:
            for page, url, body, sha, first in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.wacz"
                    writer = ArchiveWriter(fs.open_output_stream(f"{root}/{name}"))
                revisit = len(body) >= min_bytes and page != first
                digest = base32(sha)
                writer.add(url, digest, record(page, url, body, digest, first, revisit))
                if writer.at >= archive_bytes:
                    end()
                    writer = None
        if writer is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    # The aggregated side is dealt out anew by another form of its key, so that Spark can split a hot digest's rows over tasks.
    firsts = firsts.withColumn("of", F.upper("digest")).drop("digest")
    joined = rows.withColumn("of", F.upper("digest")).join(firsts, "of").select("page_id", "url", "payload", "digest", "first")
    return materialize(joined.mapInArrow(lean(run), MANIFEST), "archives")


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives; a response's payload is held against its digest."""
    ship_code(manifest.sparkSession)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[tuple] = []
                for warc, http, payload in ArchiveReader(path).records():
                    digest, kind = warc["warc-payload-digest"].partition(":")[2], warc["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path}: payload and digest differ")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    out.append((of_urn(warc["warc-record-id"]), size, digest, kind, of_urn(warc.get("warc-refers-to")), warc["warc-target-uri"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return manifest.select("path").repartition(max(1, min(manifest.count(), 100_000)), "path").mapInArrow(lean(run), RECORDS)
