"""WARC records in ZIP packages, written by tasks and read back by ranges.

A package is a ZIP file whose members are stored, not compressed: the records,
each a gzip member of its own, an index with one line per record (sort key, time,
JSON object), and a short description. Packages of other writers may hold several
archives and indexes under any names, records also uncompressed. A reader needs the tail of the file, the central directory and the
index; it then reads any record with one range request, and extracts nothing.
ZIP64 directories and extra fields are read wherever they stand and written when
a size needs them or when asked for.

Packages lie in a folder that all executors share, named by a URI that Arrow can
open. Each attempt of a task writes files of its own name, and only those that a
finished task reports are read, so a repeated task leaves at most unused files.

Defined results: a NULL or empty payload is an empty payload; equal payloads of
at least ``min_bytes`` are written once, by the row with the largest id, and the
others refer to it; rows that repeat this id are written in full each; a NULL id
is read back as NULL; a NULL url is left out of the record; an empty table
writes no package and gives no rows; further input columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows, scratch_path, written
from areaindex.session import BROADCAST_BYTES

RECORDS, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of records after which a task begins a new package.
PACKAGE_BYTES = 32 << 20
_RANGE = 4 << 20
_TASK_BYTES = 64 << 20
_DATE, _TIME = "1970-01-01T00:00:00Z", "19700101000000"


# --- ZIP ---------------------------------------------------------------------

# Signatures and layouts of the ZIP format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = (
    b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07",
)
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def write_zip(out, members: list[tuple[str, bytes]], zip64: bool = False) -> None:
    """Write stored members to a binary stream; ``zip64`` forces the 64-bit fields."""
    at, directory = 0, []
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        large = zip64 or size >= _MAX32 or at >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        shown = _MAX32 if large else size
        head = _LOCAL + struct.pack(
            "<HHHHHIIIHH", 45 if large else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)
        ) + raw + extra
        out.write(head)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if large else b""
        directory.append(_CENTRAL + struct.pack(
            "<HHHHHHIIIHHHHHII", 45 if large else 20, 45 if large else 20, 0x800, 0, 0, 0x21, crc, shown, shown,
            len(raw), len(extra), 0, 0, 0, 0, _MAX32 if large else at,
        ) + raw + extra)
        at += len(head) + size
    body = b"".join(directory)
    out.write(body)
    count, end = len(members), at + len(body)
    if zip64 or at >= _MAX32 or count >= _MAX16:
        out.write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(body), at))
        out.write(_LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        out.write(_END + struct.pack("<HHHHIIH", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))
    else:
        out.write(_END + struct.pack("<HHHHIIH", 0, 0, count, count, len(body), at, 0))


def read_range(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"the archive ends before byte {at + size}")
    return data


def stored_members(file, size: int) -> dict[str, tuple[int, int]]:
    """Where the data of each stored member begins and how long it is, from the directories alone."""
    tail_at = max(0, size - 22 - _MAX16)
    tail = read_range(file, tail_at, size - tail_at)
    found = tail.rfind(_END)
    while found >= 0:  # a comment may hold the signature; the true record reaches to the end
        if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
        found = tail.rfind(_END, 0, found)
    if found < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, found + 4)
    if _MAX16 == count or _MAX32 in (length, start):
        locator = read_range(file, tail_at + found - 20, 20) if tail_at + found >= 20 else b""
        if locator[:4] == _LOCATOR64:
            end64 = struct.unpack_from("<IQI", locator, 4)[1]
            head = read_range(file, end64, 56)
            if head[:4] != _END64:
                raise ValueError("the ZIP64 locator points at no ZIP64 record")
            count, length, start = struct.unpack_from("<QQQ", head, 32)
    directory, at, members = read_range(file, start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        (_, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, offset) = struct.unpack_from(
            "<HHHHHHIIIHHHHHII", directory, at + 4
        )
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_note
        place = 0
        while place + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, place)
            if kind == 1:  # 64-bit values stand for exactly those fields that overflow, in this order
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, place + 4))
                plain = next(values) if plain == _MAX32 else plain
                packed = next(values) if packed == _MAX32 else packed
                offset = next(values) if offset == _MAX32 else offset
            place += 4 + width
        if method != 0 or flags & 1:
            continue  # compressed or encrypted members cannot be read by ranges
        local = read_range(file, offset, 30)
        if local[:4] != _LOCAL:
            raise ValueError(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        members[name] = (offset + 30 + n_name + n_extra, plain)
    return members


# --- WARC --------------------------------------------------------------------

def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record_bytes(kind: str, ident, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record, compressed as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http + (payload if kind == "response" else b"")
    named = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if ident is None else ident}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", None if url is None else _one_line(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", None if kind == "response" else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if kind == "response" else f"<urn:page:{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one gzip member."""
    plain = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record is longer or shorter than it says")
    head, _, payload = rest[:length].partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    return fields, http, payload


# --- jobs --------------------------------------------------------------------

def plan_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000
) -> DataFrame:
    """(ident, url, payload, digest, n_bytes, kind, refers_to) per page; revisits carry no payload."""
    body = F.coalesce(col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        col(key).alias("ident"), col(url).cast("string").alias("url"), body.alias("payload"),
        F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"),
    )
    shared = written(
        rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest")
        .agg(F.max("ident").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "keepers",
    )
    keepers = F.broadcast(shared) if 80 * shared.count() <= BROADCAST_BYTES else shared
    revisit = F.col("keeper").isNotNull() & (F.col("n_bytes") >= min_bytes) & ~F.col("ident").eqNullSafe(F.col("keeper"))
    return rows.join(keepers, "digest", "left").select(
        "ident", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "n_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write planned records to packages below ``folder``; (path, n_records, n_bytes) of each package."""
    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        prefix = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}"

        def close(data: bytearray, index: list[str]) -> tuple:
            path = f"{prefix}-{uuid.uuid4().hex}.wacz"
            about = {"profile": "data-package", "resources": [{"name": "records", "path": RECORDS, "bytes": len(data)}]}
            with store.open_output_stream(path) as out:
                write_zip(out, [
                    (RECORDS, bytes(data)), (INDEX, "".join(index).encode()), (ABOUT, json.dumps(about).encode())
                ], zip64)
            return path, len(index), len(data)

        data, index = bytearray(), []
        for ident, url, payload, digest, n_bytes, kind, refers_to in items:
            record = record_bytes(kind, ident, url, payload or b"", digest, n_bytes, refers_to)
            place = {"url": url or "", "digest": f"sha1:{digest}", "offset": str(len(data)), "length": str(len(record)), "filename": RECORDS.rpartition("/")[2]}
            index.append(f"{sort_key(url)} {_TIME} {json.dumps(place)}\n")
            data += record
            if len(data) >= package_bytes:
                yield close(data, index)
                data, index = bytearray(), []
        if index:
            yield close(data, index)

    return map_rows(records, "path string, n_records long, n_bytes long", rows)


def sort_key(url: str | None) -> str:
    """The key of an index line: the host's labels from the last to the first, then port and path; ``-`` without a host."""
    _, found, rest = (url or "").partition("://")
    host, slash, path = rest.partition("/")
    if not found or not host:
        return "-"
    name, _, port = host.rpartition("@")[2].partition(":")
    key = ",".join(reversed(name.lower().split("."))) + (f":{port}" if port else "") + ")" + (slash + path or "/")
    return "".join(key.split()) or "-"


def index_places(lines: bytes, archives: dict[str, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(at, length) within the package for every line of an index.

    A line is a JSON object, by itself or after a key and a time. It names its
    archive by file name or by the member's whole name; it need not where the
    package holds one archive only.
    """
    by_name = {**{name.rpartition("/")[2]: place for name, place in archives.items()}, **archives}
    for line in lines.splitlines():
        brace = line.find(b"{")
        if brace < 0:  # blank, or a header
            continue
        entry = json.loads(line[brace:])
        if "offset" not in entry or "length" not in entry:
            continue
        named = entry.get("filename")
        if named is None and len(archives) == 1:
            place = next(iter(archives.values()))
        elif named in by_name:
            place = by_name[named]
        else:
            raise ValueError(f"an index line names an archive that the package does not hold: {named}")
        at, length = int(entry["offset"]), int(entry["length"])
        if at < 0 or length < 0 or at + length > place[1]:
            raise ValueError("an index line points behind its archive")
        yield place[0] + at, length


def index_entries(packages: DataFrame, folder: str) -> DataFrame:
    """(path, at, length) of every record, from the directories and all indexes of the packages."""
    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for (path,) in items:
            with store.open_input_file(path) as file:
                members = stored_members(file, file.size())
                archives = {n: p for n, p in members.items() if n.endswith((".warc.gz", ".warc"))}
                for name, place in members.items():
                    if name.endswith((".cdxj", ".cdx", ".idx")):
                        yield from ((path, *found) for found in index_places(read_range(file, *place), archives))

    return map_rows(packages.select("path"), "path string, at long, length long", rows)


def _tasks(entries: DataFrame) -> int:
    """Tasks to read the records: by their bytes, not by those of the index, and at least as many as can run, a range each."""
    size = entries.agg(F.sum("length")).first()[0] or 0
    running = 2 * entries.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // _TASK_BYTES), min(running, -(-size // _RANGE)))


def read_records(entries: DataFrame, folder: str, key_type: str = "bigint") -> DataFrame:
    """(ident, url, payload, n_bytes, digest, kind, refers_to): records read by their ranges.

    The payload's digest is computed anew and compared with the record's.
    """
    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        held, file = None, None
        for path, at, length in items:
            if path != held:
                if file is not None:
                    file.close()
                held, file = path, store.open_input_file(path)
            fields, http, payload = parse_record(read_range(file, at, length))
            digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            kind = fields["warc-type"]
            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"a payload in {path} does not have its digest")
            ident = fields["warc-record-id"][len("<urn:page:") : -1]
            other = fields.get("warc-refers-to")
            yield (
                ident or None, fields.get("warc-target-uri"), payload if kind == "response" else None,
                int(http["content-length"]), digest, kind, other[len("<urn:page:") : -1] if other else None,
            )
        if file is not None:
            file.close()

    spread = (
        entries.repartition(_tasks(entries), "path", F.floor(F.col("at") / _RANGE)).sortWithinPartitions("path", "at")
    )
    read = map_rows(
        spread, "ident string, url string, payload binary, n_bytes long, digest string, kind string, refers_to string",
        rows, per_batch=200,
    )
    return read.withColumns({c: F.col(c).cast(key_type) for c in ("ident", "refers_to")})


def round_trip(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000,
    folder: str | None = None, package_bytes: int = PACKAGE_BYTES, zip64: bool = True,
) -> DataFrame:
    """Write every page to packages and read all records back."""
    folder = folder or scratch_path(pages.sparkSession, "packages")
    packages = written(write_packages(plan_records(pages, key, url, payload, min_bytes), folder, package_bytes, zip64), "manifest")
    kind = pages.select(col(key)).schema[0].dataType.simpleString()
    return read_records(written(index_entries(packages, folder), "entries"), folder, kind)
